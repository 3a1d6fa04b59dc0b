"""Queries over their whole tables, against brute force or SQL without a cut."""

import random
from collections import Counter

import duckdb
import pytest
from pyspark.sql import functions as F

from scantling.operators import index, limits, selection
from scantling.plans import registry, semantic
from scantling.sources import views
from tests.compare import same_rows

QUERIES = registry.queries()


def test_tracks_of_all_detections(spark, sf):
    rows = views.read(spark, sf, "track").collect()
    rows.sort(key=lambda r: (r["frame"], r["line"], *(v for k, v in r.asDict().items() if k not in ("frame", "line"))))
    parent = list(range(len(rows)))

    def root(i):
        while parent[i] != i:
            i = parent[i]
        return i

    def share(a, b):
        w, h = min(a["xmax"], b["xmax"]) - max(a["xmin"], b["xmin"]), min(a["ymax"], b["ymax"]) - max(a["ymin"], b["ymin"])
        both = max(w, 0) * max(h, 0)
        area = lambda r: (r["xmax"] - r["xmin"]) * (r["ymax"] - r["ymin"])
        return both / (area(a) + area(b) - both)

    for i, a in enumerate(rows):
        for j in range(i + 1, len(rows)):
            b = rows[j]
            if b["frame"] > a["frame"] + 3:
                break
            if b["frame"] > a["frame"] and a["object_name"] == b["object_name"] and share(a, b) > 0.7:
                x, y = root(i), root(j)
                parent[max(x, y)] = min(x, y)
    tracks = [root(i) for i in range(len(rows))]
    good = {t for t, r in zip(tracks, rows, strict=True) if r["confidence"] > 0.1}
    number = {t: k for k, t in enumerate(sorted(good))}
    want = [(r["frame"] * 10 + r["line"], number[t]) for t, r in zip(tracks, rows, strict=True) if t in good]
    got = QUERIES["gr1_build_tracks"](spark, sf).collect()
    assert len({r["row_id"] for r in got}) == len(got)
    assert [(r["row_id"] >> 20, r["ind"]) for r in sorted(got)] == want


@pytest.fixture(scope="module")
def far(tmp_path_factory, spark):
    """A table whose last frame is far beyond 2000."""
    at = tmp_path_factory.mktemp("far")
    rows = [(f, n) for f in (0, 0, 3, 1999, 2001, 2500, 2500, 2500, 2500, 3100) for n in (1,)]
    lines = spark.createDataFrame(rows, "l_orderkey long, l_linenumber int").selectExpr("*", "1L AS l_partkey", "1L AS l_suppkey", "1.0D AS l_quantity", "'A' AS l_returnflag")
    lines.write.parquet(f"{at}/lineitem.parquet")
    lines.where("false").write.parquet(f"{at}/none/lineitem.parquet")
    return str(at)


@pytest.mark.parametrize("name, value", [("a11_dense_counts", lambda n: n), ("j16_dense_zero_fill", lambda n: n), ("a12_presence", lambda n: min(n, 1)), ("a13_clipped_count", lambda n: min(n, 3))])
def test_dense_to_the_last_frame(spark, far, name, value):
    n = Counter({0: 2, 3: 1, 1999: 1, 2001: 1, 2500: 4, 3100: 1})
    want = {f: value(n[f]) for f in range(3101) if name != "j16_dense_zero_fill" or not n[f]}
    got = QUERIES[name](spark, far).collect()
    assert len(got) == len(want) and dict(map(tuple, got)) == want
    assert QUERIES[name](spark, f"{far}/none").count() == 0


#: Queries that once read a part of their table.
WHOLE = (
    "a23_sampling_bound", "a24_one_sided", "gr1_build_tracks", "j04_frame_segment", "meta07_fill_grid", "src07_file_offsets", "src08_stale_files",
    "src10_full_scan", "src11_point_lookup", "src20_proxy_source",
)
NEXT = "/root/testdata/sf0.01"


@pytest.mark.parametrize("name", WHOLE)
def test_whole_input(spark, name):
    con = duckdb.connect()
    for t in views.TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{NEXT}/{t}.parquet'")
    same_rows(QUERIES[name](spark, NEXT), con.execute(registry.oracle_sql()[name]))


def test_trials_of_all_rows(spark):
    proxy = views.read(spark, NEXT, "proxy")
    trials = selection.run_trials(proxy, "precision_naive", selection.Target(budget=300), 3)
    assert QUERIES["as11_trials"](spark, NEXT).collect() == trials.collect()
    assert QUERIES["a10_trial_summary"](spark, NEXT).collect() == selection.summarise(selection.run_trials(proxy, "recall_sqrt", selection.Target(budget=300), 3)).collect()


@pytest.mark.parametrize("name", ["l02_limit_batched", "l03_limit_whole_frames"])
def test_limit_goes_on_beyond_the_best_frames(spark, monkeypatch, name):
    """Only the frames of the least proxies have what is wanted, behind thousands that don't."""
    tiles = spark.range(3000).select(F.col("id").alias("tile_id"), F.col("id").alias("t"), (1 / (F.col("id") + 1)).alias("proxy"), F.when(F.col("id") >= 2900, 12.0).otherwise(0.0).alias("truth"))
    monkeypatch.setattr(semantic, "scored", lambda s, p: tiles)
    got = QUERIES[name](spark, "").collect()
    gap, calls = (3, 8) if name == "l02_limit_batched" else (0, 32)
    assert sorted(map(tuple, got)) == sorted(limits.batched_search([(k, [12.0 if k >= 2900 else 0.0]) for k in range(3000)], 12, 10, gap, calls)) and len(got) == 10


@pytest.mark.parametrize("gap, calls", [(0, 1), (0, 5), (2, 4), (3, 7)])
def test_batches_of_frames_change_nothing(spark, gap, calls):
    rng = random.Random(gap * 10 + calls)
    frames = [(t, [float(rng.randint(0, 4)) for _ in range(3)]) for t in rng.sample(range(60), 40)]
    rows = [(3 * k + i, t, 1 / (k + 1) - i * 1e-6, y) for k, (t, ys) in enumerate(frames) for i, y in enumerate(ys)]
    tiles = spark.createDataFrame(rows, "tile_id long, t long, proxy double, truth double")
    got = limits.batched_query(tiles, 7, 4, gap, calls, batch=5)
    assert sorted(map(tuple, got.collect())) == sorted(limits.batched_search(frames, 7, 4, gap, calls))


def test_triplets_draw_from_whole_buckets(spark):
    """A bucket with all but one of its tiles in frames close together, one with many tiles, and one with tiles too near only."""
    rows = [(k, 0, k % 5) for k in range(1500)] + [(1500, 0, 5000)]
    rows += [(2000 + k, 1, k) for k in range(1000)] + [(4000 + k, 2, k) for k in range(3)]
    at = {i: (b, f) for i, b, f in rows}
    got = index.triplets(spark.createDataFrame(rows, "tile_id long, b int, f long"), "b", "f").collect()
    assert sorted(r["anchor"] for r in got) == sorted(at)
    for r in got:
        b, f = at[r["anchor"]]
        if r["positive"] is None:
            assert b == 2
        else:
            assert at[r["positive"]][0] == b and abs(at[r["positive"]][1] - f) > 30
        assert at[r["negative"]][0] != b
    assert sum(r["positive"] == 1500 for r in got) == 1500
    assert len({r["positive"] for r in got if at[r["anchor"]][0] == 1}) > 500
    assert len({r["negative"] for r in got if at[r["anchor"]][0] == 0}) > 500
    assert {at[r["negative"]][0] for r in got if at[r["anchor"]][0] == 0} == {1, 2}


def plain_batched(frames, want, limit, gap, batch):
    """The batched search over a list of all frames."""
    left, order = {t: list(s) for t, s in frames}, [t for t, _ in frames]
    totals, working, done, out, calls = Counter(), set(), set(), [], 0
    while len(out) < limit:
        group = []
        for t in order:
            if t in done or any(t + o in working for o in range(-gap, gap + 1) if o):
                continue
            if not left[t]:
                working.discard(t)
                continue
            working.add(t)
            group.append((t, left[t].pop(0)))
            if len(group) == batch:
                break
        if not group:
            break
        for t, s in group:
            calls += 1
            totals[t] += s
            if totals[t] >= want and t not in done:
                out.append((t, len(out) + 1, calls))
                if len(out) >= limit:
                    break
                done.update(range(t - gap, t + gap + 1))
    return out


def test_open_frames_are_all_that_is_held():
    for seed in range(300):
        rng = random.Random(seed)
        frames = [(t, [float(rng.randint(0, 4)) for _ in range(rng.randrange(4))]) for t in rng.sample(range(40), rng.randrange(40))]
        args = rng.randint(1, 9), rng.randint(0, 6), rng.randrange(4), rng.randint(1, 7)
        assert limits.batched_search(iter(frames), *args) == plain_batched(frames, *args)


def test_pages_are_bounded(spark, monkeypatch):
    monkeypatch.setattr(limits, "PAGE", 40)
    df = spark.range(500).select(F.col("id").alias("t"), (F.col("id") % 7).alias("score"))
    got = list(limits.pages(df, limits.BEST, ["t"], 10))
    assert got == [(t,) for t in sorted(range(500), key=lambda t: (-(t % 7), t))]
