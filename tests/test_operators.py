"""Hand-worked cases, brute force and statistical acceptance."""

import math
import random

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from scantling.functions import costs, predicates
from scantling.functions import geometry as g
from scantling.operators import detections as d
from scantling.operators import index, limits, sampling, selection, tiling, tracks
from scantling.operators.graph import components
from scantling.operators.oracle import LabelCache
from scantling.plans.semantic import read
from scantling.sources import connectors
from scantling.streaming import ingest


def value(spark, column):
    return spark.range(1).select(column.alias("v")).first()["v"]


def corners(r):
    return None if r is None else (r["x1"], r["y1"], r["x2"], r["y2"])


@pytest.mark.parametrize("a, b, want", [
    ((0, 0, 2, 2), (0, 0, 1, 1), (0, 0, 1, 1)), ((0, 0, 1, 1), (1, 1, 2, 2), None), ((0, 0, 2, 2), (1, 1, 3, 3), (1, 1, 2, 2)), ((0, 1, 2, 3), (1, 0, 3, 2), (1, 1, 2, 2))])
def test_overlap(spark, a, b, want):
    assert corners(value(spark, g.overlap(g.fixed(*a), g.fixed(*b)))) == want


def test_touching_counts(spark):
    assert value(spark, g.touches(g.fixed(0, 0, 1, 1), g.fixed(1, 1, 2, 2)))


def test_inflaters(spark):
    one = g.fixed(1, 1, 2, 2)
    assert corners(value(spark, g.inflate_linear(one, 0.2))) == (1, 1, 1, 1)
    assert corners(value(spark, g.inflate_least(one, 2))) == (0, 0, 2, 2)


def test_area_filter_keeps_touching(spark):
    assert value(spark, predicates.clear_of(g.rect(F.lit(50), F.lit(50), F.lit(10), F.lit(10)), [g.fixed(50, 50, 100, 100)]))


def test_bitrates(spark):
    assert value(spark, g.bitrate_number(F.lit("5000k"))) == 5e6
    assert value(spark, g.bitrate_text(F.lit(5e6))) == "5000k"
    assert value(spark, g.bitrate_text(F.lit(1000))) is None


def test_network_floor(spark):
    assert value(spark, costs.network(F.lit(100.0))) == costs.NETWORKS["large"]["a"]


def test_propagation_by_hand(spark):
    topk = spark.createDataFrame([(7, 1, 1, 1.0), (7, 2, 2, 3.0), (8, 1, 1, 0.0), (8, 2, 2, 0.0), (9, 1, 2, 5.0)], "tile_id long, rank int, rep_id long, dist double")
    scores = spark.createDataFrame([(1, 4.0), (2, 8.0)], "tile_id long, score double")
    assert {r["tile_id"]: r["score"] for r in index.propagate(topk, scores).collect()} == {7: 5.0, 8: 6.0, 9: 8.0}


def test_components_against_union_find(spark):
    rng = random.Random(5)
    edges = [(rng.randrange(300), rng.randrange(300)) for _ in range(220)] + [(1000 + i, 1001 + i) for i in range(40)] + [(2000, 2000 + i) for i in range(60)]
    parent = {v: v for e in edges for v in e}

    def root(v):
        while parent[v] != v:
            v = parent[v]
        return v

    for a, b in edges:
        ra, rb = root(a), root(b)
        parent[max(ra, rb)] = min(ra, rb)
    got = {r["node"]: r["component"] for r in components(spark.createDataFrame(edges, "u long, v long")).collect()}
    linked = {v for a, b in edges if a != b for v in (a, b)}
    assert got == {v: root(v) for v in linked}


def test_components_of_nothing(spark):
    assert components(spark.createDataFrame([], "u long, v long")).count() == 0


@pytest.mark.parametrize("candidates", [1, 3, 2048])
def test_farthest_first_by_brute_force(spark, sf, candidates):
    """One at a time over all tiles; rows that repeat a vector are ties."""
    tiles = read(spark, sf, "tile").limit(150)
    tiles = tiles.union(tiles.limit(40).withColumn("tile_id", F.col("tile_id") + 10_000))
    rows = sorted((r["tile_id"], r["embedding"]) for r in tiles.collect())
    start = tiles.orderBy(d.hash_order(F.col("tile_id"), 7), "tile_id").limit(10).collect()
    x = np.array([v for _, v in rows], float)
    reps = [r["tile_id"] for r in start]
    while len(reps) < 40:
        chosen = np.array([v for i, v in rows if i in set(reps)], float)
        least = np.min([np.sqrt(((x - c) ** 2).sum(1)) for c in chosen], axis=0)
        reps.append(rows[int(least.argmax())][0])
    got = index.farthest_first(tiles, 40, candidates=candidates).orderBy("place").collect()
    assert [r["rep_id"] for r in got] == reps


def test_nearest_in_blocks(spark, sf):
    tiles = read(spark, sf, "tile").where("tile_id < 120")
    reps = tiles.where("tile_id % 5 = 0")
    want = sorted(map(tuple, index.nearest(tiles, reps, 3).collect()))
    got = sorted(map(tuple, index.nearest(tiles, reps, 3, block_bytes=8 * 64 * 7).collect()))
    assert [r[:3] for r in got] == [r[:3] for r in want] and np.allclose([r[3] for r in got], [r[3] for r in want])


def test_segments_of_unequal_length(spark):
    """Joined segments are longer than others; frames outside of all have none."""
    spans = [(0, 30), (30, 90), (90, 120), (200, 1200), (1200, 1201)]
    tiles = spark.createDataFrame([(a, b, r, c) for a, b in spans for r in (0, 1) for c in (0, 1)], "seg_start long, seg_end long, row_no int, col_no int")
    frames = [0, 29, 30, 35, 65, 89, 90, 100, 119, 120, 150, 199, 200, 777, 1199, 1200, 1201]
    holds = lambda t: [(a, b) for a, b in spans if a <= t < b]
    keys = spark.createDataFrame([(t, t % 2) for t in frames], "t long, row_no int")
    got = sorted((r["t"], r["seg_start"], r["seg_end"], r["row_no"], r["col_no"]) for r in connectors.select_tiles(tiles, keys).collect())
    assert got == sorted((t, a, b, t % 2, c) for t in frames for a, b in holds(t) for c in (0, 1))
    found = connectors.segment_of(keys.select("t"), "t", tiles).collect()
    assert sorted((r["t"], r["seg_start"]) for r in found if r["seg_start"] is not None) == sorted((t, a) for t in frames for a, _ in holds(t)) and len(found) == len(frames)
    plan = {r["seg_start"]: (r["start"], r["length"], r["skip"]) for r in connectors.decode_plan(keys, tiles).collect()}
    assert plan[30] == (30, 60, [t for t in range(30, 90) if t not in frames]) and plan[1200] == (1200, 1, [])
    shown = connectors.decode_plan(keys, tiles)._jdf.queryExecution().executedPlan().toString()
    assert "NestedLoop" not in shown and "Cartesian" not in shown
    assert connectors.select_tiles(tiles.where("false"), keys).count() == 0


boxes = st.lists(st.tuples(st.integers(0, 60), st.integers(0, 60), st.integers(1, 20), st.integers(1, 20)).map(lambda b: (float(b[0]), float(b[1]), float(b[0] + b[2]), float(b[1] + b[3]))), max_size=9)


@given(boxes)
@settings(max_examples=60, deadline=None)
def test_combined_boxes_are_apart_and_cover(found):
    out = tiling.combine(found, tiling.meets)
    assert not any(tiling.meets(a, b) for i, a in enumerate(out) for b in out[i + 1 :])
    assert all(any(o[0] <= b[0] and o[1] <= b[1] and o[2] >= b[2] and o[3] >= b[3] for o in out) for b in found)


@given(st.integers(1, 3), st.integers(1, 4), st.integers(0, 10**6))
@settings(max_examples=40, deadline=None)
def test_tilings_share_their_optimum(n_rows, n_cols, seed):
    rng = random.Random(seed)
    xs, ys = [0, *sorted(rng.sample(range(10, 400), n_cols))], [0, *sorted(rng.sample(range(10, 400), n_rows))]
    parents = {(r, c): frozenset(rng.sample(range(4), rng.randrange(3))) for r in range(n_rows) for c in range(n_cols)}
    cost = lambda a: 0.01 * a + 50
    best = tiling.best_tiling(xs, ys, parents, cost)[0]
    assert best == pytest.approx(tiling.best_tiling_brute(xs, ys, parents, cost)[0])
    assert tiling.greedy_tiling(xs, ys, parents, cost)[0] >= best - 1e-9


def test_valid_merges_leave_no_strip_half_merged():
    assert () in tiling.valid_merges(3, [True, False, True])
    assert (1,) not in tiling.valid_merges(3, [True, False, True])
    assert (1, 2) in tiling.valid_merges(3, [True, False, True])


def test_split_for_network_only_where_large():
    assert tiling.split_for_network(800, 600, 4, 1.4e-5, 3.0, 4.5) == [(800, 600)]
    assert sum(w * h for w, h in tiling.split_for_network(3840, 2160, 4, 1.4e-5, 3.0, 4.5)) == 3840 * 2160


def test_spaced_search():
    frames = [(10, [1.0]), (12, [1.0]), (20, [0.0, 1.0]), (30, [0.0])]
    assert limits.spaced_search(frames, 1.0, 5, 3) == [(10, 1, 1), (20, 2, 3)]
    assert limits.batched_search(frames, 1.0, 5, 0, 2)[-1][0] == 20
    assert {t for t, *_ in limits.batched_search(frames, 1.0, 5, 3, 1)} == {10, 20}


def test_suppression_and_clipping():
    assert tracks.suppress(np.array([[0, 0, 10, 10], [1, 1, 10, 10], [20, 20, 30, 30.0]]), np.array([0.9, 0.8, 0.7]), 0.45) == [0, 2]
    square = [(0.0, 0.0), (4.0, 0.0), (4.0, 4.0), (0.0, 4.0)]
    assert tracks.shoelace(tracks.clip_polygon(square, (2.0, 2.0, 8.0, 8.0))) == pytest.approx(4)
    assert tracks.clip_polygon(square, (5.0, 5.0, 8.0, 8.0)) == []
    five = [(0.0, 0.0), (4.0, 0.0), (4.0, 4.0), (2.0, 1.0), (0.0, 4.0)]  # not convex
    assert tracks.shoelace(tracks.clip_polygon(five, (0.0, 0.0, 4.0, 4.0))) == pytest.approx(tracks.shoelace(five))


def plain_stop(y, p, eps, conf, top):
    """First place at which the bounds meet and the estimate there, by one loop over rows in order of the sample."""
    n, tau, var = len(y), p.mean(), p.var()
    k, lower, upper = 2, -math.inf, math.inf
    coefficient = None
    for t in range(2, n):
        while t > int(1.5**k) or coefficient is None:
            if t > int(1.5**k):
                k += 1
            if t <= int(1.5**k):
                n0 = min(max(int(1.5 ** (k - 1)) + 1, 100), n)
                cov = ((y[:n0] * p[:n0]).sum() - y[:n0].sum() * p[:n0].sum() / n0) / (n0 - 1)
                coefficient = -cov / var
                alpha = int(1.5**k) / int(1.5 ** (k - 1))
                x = -alpha * math.log(conf * (0.1 / 1.1) / (math.log(k) / math.log(1.1)) ** 1.1) / 3
                break
        z = y[: t + 1] + coefficient * (p[: t + 1] - tau)
        s, s2 = z.sum(), (z * z).sum()
        v = (s2 - s * s / t) / t
        if v >= 0:
            reach = math.sqrt(v) * math.sqrt((n - t) / (n - 1)) * math.sqrt(2 * x / t) + 3 * top * x / t
            lower, upper = max(lower, abs(s / t) - reach), min(upper, abs(s / t) + reach)
        if lower + eps >= upper - eps:
            return t, math.copysign(1, s) * 0.5 * ((1 + eps) * lower + (1 - eps) * upper) * n
    return None


def test_bounded_sum_by_one_loop(spark):
    """The distributed stopping rule ends where a loop does, and what it estimates is within the bound."""
    rng = np.random.default_rng(1)
    p = rng.beta(0.5, 2, 6000)
    y = (rng.random(6000) < p).astype(float)
    df = spark.createDataFrame([(i, float(a), float(b)) for i, (a, b) in enumerate(zip(p, y, strict=True))], "id long, proxy double, truth double")
    for seed, eps in ((1, 0.15), (2, 0.1)):
        order = [r["id"] for r in df.orderBy(d.hash_order(F.col("id"), seed), "id").select("id").collect()]
        want = plain_stop(y[order], p[order], eps, 0.05, max(1.0, np.rint(p).max()))
        got = sampling.approximate_sum(df, "id", "proxy", "truth", eps, seed=seed, first=500).first()
        assert not got["exact"] and (got["n_samples"], round(got["estimate"], 3)) == (want[0], round(want[1], 3))
        assert abs(got["estimate"] - y.sum()) <= eps * len(y)
    exact = sampling.approximate_sum(df, "id", "proxy", "truth", 1e-9, first=1000).first()
    assert exact["exact"] and exact["estimate"] == y.sum() and exact["n_samples"] == 6000


def test_bounded_sum_sends_few_rows_to_the_driver(spark, monkeypatch):
    """However many rows there are: a row for each growth step and single answers."""
    from pyspark.sql.classic.dataframe import DataFrame as Frame

    sent = []
    plain = Frame.collect
    monkeypatch.setattr(Frame, "collect", lambda self: (lambda rows: sent.append(len(rows)) or rows)(plain(self)))
    monkeypatch.setattr(Frame, "toPandas", lambda self: pytest.fail("a table on the driver"))
    for n in (3000, 30_000):
        df = spark.range(n).select("id", (F.col("id") % 7 / 10).alias("proxy"), (F.col("id") % 3).cast("double").alias("truth"))
        sampling.approximate_sum(df, "id", "proxy", "truth", 1e-9, first=1000)
    assert max(sent) <= len(sampling.EDGES)


@pytest.fixture(scope="module")
def rare(spark):
    rng = np.random.default_rng(3)
    p = rng.beta(0.3, 1, 3000)
    rows = [(i, float(p[i]), int(rng.random() < p[i])) for i in range(3000)]
    return spark.createDataFrame(rows, "id long, proxy_score double, label int").cache()


SOUND = {
    "recall_sqrt": selection.Target(recall=0.8, budget=600), "recall_prop": selection.Target(recall=0.8, budget=600), "recall_uniform": selection.Target(recall=0.8, budget=600),
    "precision_uniform": selection.Target(precision=0.6, budget=600), "precision_one_stage": selection.Target(precision=0.6, budget=600), "precision_two_stage": selection.Target(precision=0.6, budget=600),
}


@pytest.mark.parametrize("name", sorted(SOUND))
def test_selectors_reach_their_targets(rare, name):
    """The chance of failure is 5 %: of eight runs at most two miss."""
    got = selection.run_trials(rare, name, SOUND[name], 8).collect()
    assert sum(r["covered"] for r in got) >= 6 and max(r["size"] for r in got) > 0


@pytest.mark.parametrize("stride", [25, 100])
def test_importance_masses_are_scaled_exactly(rare, stride):
    """The mean of scaled masses down to a rank is one, for every rank: over many draws, as probabilities say."""
    rows = selection._sample(rare, 4000, "sqrt", 5)
    mass = np.array([r["mass"] for r in rows])
    for s in range(stride, len(rows), 40 * stride):
        mean = (rows[s]["rank"] + 1) / rows[s]["n"] / rows[s]["upto"]
        assert mass[: s + 1].mean() / mean == pytest.approx(1, abs=0.25 if s < 400 else 0.1)


def test_ranks_of_a_rare_proxy_are_spread(spark):
    """Nearly all scores of Beta(0.01, 2) are next to 0, many are equal: no task gets much more than another."""
    df = connectors.beta_source(spark, 60_000, 0.01, 2.0).withColumn("proxy_score", F.round("proxy_score", 3))
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")  # or a table this small is one partition
    sorted_ = sampling.in_order(df, [F.desc("proxy_score"), F.asc("id")], "test")
    spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    sizes = sorted(r["n"] for r in sorted_.groupBy("__part").agg(F.count("*").alias("n")).collect())
    assert len(sizes) > 1 and sizes[-1] < 2 * sizes[len(sizes) // 2]
    rows = sampling.ranked(df, "proxy_score", "id", {"upto": F.col("label")}).collect()
    rows.sort(key=lambda r: (-r["proxy_score"], r["id"]))
    assert [r["rank"] for r in rows] == list(range(60_000))
    assert [r["upto"] for r in rows] == list(np.cumsum([r["label"] for r in rows]))


def test_label_cache_calls_once(spark):
    keys = spark.createDataFrame([(i,) for i in (1, 1, 2, 3, 2, None, None)], "tile_id long")
    asked = []

    def label(df):
        asked.extend(r["tile_id"] for r in df.collect())
        return df.withColumn("label", F.coalesce(F.col("tile_id"), F.lit(-1)) * 2)

    cache = LabelCache(["tile_id"], label)
    assert sorted(r["label"] for r in cache.get(keys).collect()) == [-2, 2, 4, 6] and cache.calls == 4 and len(asked) == 4
    assert cache.get(keys.union(spark.createDataFrame([(9,)], "tile_id long"))).count() == 5 and cache.calls == 5 and asked[4:] == [9]


def test_workload_and_csv(spark, tmp_path):
    (tmp_path / "w.txt").write_text("10\n20\n#\n5\n20\n")
    got = [tuple(r) for r in connectors.read_workload(spark, str(tmp_path / "w.txt")).orderBy("ord").select("workload_id", "t").collect()]
    assert got == [(0, 30), (0, 60), (1, 15), (1, 60)]
    (tmp_path / "d.csv").write_text("frame,object_name,confidence,xmin,ymin,xmax,ymax,ind\n1,car,0.9,0,0,1,1,7\n2,bus,0.8,0,0,1,1,8\n")
    assert connectors.read_detections(spark, str(tmp_path / "d.csv"), ["car"]).count() == 1


def test_catalog_round_trip(spark, tmp_path):
    tiles = spark.createDataFrame([(0, 30, 0, 0, "(0, 0, 8, 8)"), (0, 30, 0, 1, None), (30, 60, 0, 0, None)], "seg_start long, seg_end long, row_no int, col_no int, rect string")
    connectors.write_catalog(tiles, str(tmp_path / "cat"))
    back = connectors.read_catalog(spark, str(tmp_path / "cat")).collect()
    assert [(r["seg_start"], r["col_no"], r["rect"]) for r in back] == [(0, 0, "(0, 0, 8, 8)")]
    with pytest.raises(Exception, match="already exists|PATH_ALREADY_EXISTS"):
        connectors.write_catalog(tiles, str(tmp_path / "cat"))


def test_tiles_are_written_by_segment(spark, tmp_path):
    tiles = spark.createDataFrame([(0, 1, True), (30, 31, True), (30, 32, False)], "seg_start long, t long, has_roi boolean")
    connectors.write_tiles(tiles, str(tmp_path / "tiles"))
    assert spark.read.parquet(str(tmp_path / "tiles")).where("seg_start = 30").count() == 1


def test_hooks_decode_and_blank(spark, tmp_path):
    (tmp_path / "a.bin").write_bytes(b"xxyy")
    frames = connectors.video_frames(spark, str(tmp_path / "a.bin"), lambda b: [b[:2], b[2:]])
    assert [bytes(r["payload"]) for r in frames.orderBy("t").collect()] == [b"xx", b"yy"]


def test_stream_of_segments_equals_batch(spark, tmp_path):
    rows = [(t, "a" if t < 50 else "b") for t in range(90)]
    src = str(tmp_path / "src")
    spark.createDataFrame(rows, "t long, layout string").withColumn("camera", F.lit("c1")).coalesce(1).write.parquet(src)
    stream = spark.readStream.schema("t long, layout string, camera string").parquet(src)
    ingest.run_batches(stream, lambda df: df.groupBy((F.floor(F.col("t") / 30) * 30).alias("seg")).count(), str(tmp_path / "out"), str(tmp_path / "cp"))
    assert sorted((r["seg"], r["count"]) for r in spark.read.parquet(str(tmp_path / "out")).collect()) == [(0, 30), (30, 30), (60, 30)]
    q = ingest.layout_runs(stream, "camera", "t", "layout").writeStream.format("memory").queryName("runs").option("checkpointLocation", str(tmp_path / "cp2")).trigger(availableNow=True).start()
    q.awaitTermination(60)
    assert [(r["first"], r["last"], r["layout"]) for r in spark.sql("SELECT * FROM runs").collect()] == [(0, 49, "a")]


def test_hash_order_is_that_of_sql(spark):
    import hashlib

    assert value(spark, d.hash_order(F.lit(42))) == int(hashlib.md5(b"7:42").hexdigest()[:8], 16)
