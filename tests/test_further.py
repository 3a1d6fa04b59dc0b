"""Regions of frames, streams, stored tables, experiments and the shared folder."""

import os
import random
from types import SimpleNamespace

import numpy as np
import pytest
from pyspark.sql import functions as F

from scantling.operators import index, limits, regions, selection, tracks
from scantling.plans.semantic import read
from scantling.sources import connectors, shared
from scantling.streaming import ingest


def flooded(mask):
    """Boxes of connected parts, corners included, by flood fill."""
    seen, out = np.zeros(mask.shape, bool), []
    for r, c in zip(*np.nonzero(mask), strict=True):
        if seen[r, c]:
            continue
        stack, part = [(r, c)], []
        seen[r, c] = True
        while stack:
            y, x = stack.pop()
            part.append((y, x))
            for v in range(max(0, y - 1), min(mask.shape[0], y + 2)):
                for u in range(max(0, x - 1), min(mask.shape[1], x + 2)):
                    if mask[v, u] and not seen[v, u]:
                        seen[v, u] = True
                        stack.append((v, u))
        ys, xs = zip(*part, strict=True)
        out.append((min(xs), min(ys), max(xs) + 1, max(ys) + 1))
    return out


def test_parts_by_flood_fill():
    for seed in range(60):
        mask = np.random.default_rng(seed).random((9, 13)) < 0.05 + seed % 10 / 20
        assert regions.boxes(mask) == flooded(mask)
        wide = np.pad(mask, 1)
        assert (regions.dilate(mask) == np.array([[wide[r : r + 3, c : c + 3].any() for c in range(13)] for r in range(9)])).all()


def moving_square(n=60, size=24):
    """A bright square of 4 that moves over a dim, noisy background."""
    rng = np.random.default_rng(1)
    out = []
    for t in range(n):
        frame = 40 + rng.integers(-3, 4, (size, size))
        if t >= 10:
            x = (t - 10) * 2 % (size - 4)
            frame[10:14, x : x + 4] = 200
        out.append(frame.astype(float))
    return out


@pytest.mark.parametrize("model", sorted(regions.MODELS))
def test_models_see_what_moves(spark, model):
    frames = moving_square()
    rows = [(cam, t, f.ravel().tolist()) for cam in ("a", "b") for t, f in enumerate(frames)]
    df = spark.createDataFrame(rows, "cam string, t long, px array<double>")
    got = regions.fetch_regions(df, "cam", "t", "px", 24, model, 30.0, 0.5).collect()
    assert not [r for r in got if r["t"] < 10]
    seen = 0
    for t in range(12, 60):
        x = (t - 10) * 2 % 20
        seen += any(r["camera"] == "a" and r["t"] == t and r["x1"] <= 2 * x and r["x2"] >= 2 * (x + 4) and r["y1"] == 18 and r["y2"] == 30 for r in got)
    assert seen >= 40 and len([r for r in got if r["camera"] == "a"]) == len([r for r in got if r["camera"] == "b"])


@pytest.mark.parametrize("model", ["frame_before", "first_frame"])
def test_spans_change_nothing(spark, model):
    """Models of bounded memory give the same regions however a camera's frames are cut."""
    rows = [(1, t, f.ravel().tolist()) for t, f in enumerate(moving_square())]
    df = spark.createDataFrame(rows, "cam int, t long, px array<double>")
    make = regions.MODELS[model](30.0)
    want = sorted((t, *b) for t, f in enumerate(moving_square()) for b in regions.boxes(regions.dilate(make.apply(f))))
    for span, warm in ((7, 1), (1000, 50)):
        got = regions.fetch_regions(df, "cam", "t", "px", 24, model, 30.0, span=span, warm=warm).collect()
        assert sorted((r["t"], r["x1"], r["y1"], r["x2"], r["y2"]) for r in got) == want


def test_masks_and_crops():
    frame = np.ones((40, 60))
    got = regions.masked(frame, [[(0, 0), (30, 0), (0, 20)]], (0, 0, 60, 30))
    assert got.shape == (30, 60) and got[0, 0] == 0 and got[0, 28] == 0 and got[0, 29] == 1 and got[19, 5] == 1 and got[25, 40] == 1
    assert abs((got == 0).sum() - 300) < 30
    empty = np.zeros((40, 60))
    empty[25, 33] = 1
    assert regions.trimmed(empty) == (30, 20, 40, 30) and regions.trimmed(np.zeros((9, 9))) == (0, 0, 9, 9)


def streamed(spark, tmp_path, batches, schema, apply):
    """What a stream gives that gets these batches one by one."""
    src = str(tmp_path / "src")
    os.makedirs(src)
    for k, rows in enumerate(batches):
        spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(src)
        for name in os.listdir(src):
            if name.startswith("part"):
                os.utime(f"{src}/{name}", (1000 + k, 1000 + k)) if os.stat(f"{src}/{name}").st_mtime > 10**6 else None
    out = apply(ingest.bounded(spark, schema, src, 1))
    q = out.writeStream.format("parquet").option("path", str(tmp_path / "out")).option("checkpointLocation", str(tmp_path / "cp")).trigger(availableNow=True).start()
    q.awaitTermination(120)
    return spark.read.schema(out.schema).parquet(str(tmp_path / "out")).collect()


def test_frames_are_put_in_order(spark, tmp_path):
    rng = random.Random(1)
    frames = [("c", t, f"p{t}") for t in range(40)]
    late = sorted(frames, key=lambda r: r[1] + rng.randrange(12))
    batches = [late[:15], late[15:30] + late[:3], late[30:]]
    got = streamed(spark, tmp_path, batches, "g string, f long, p string", lambda s: ingest.reorder(s, "g", "f", "p"))
    assert sorted((r["t"], r["payload"]) for r in got) == [(t, f"p{t}") for t in range(40)]


def test_lost_frames_are_given_up(spark, tmp_path):
    batches = [[("c", t, "x") for t in range(2, 9)], [("c", 0, "late"), ("c", 9, "x")]]
    got = streamed(spark, tmp_path, batches, "g string, f long, p string", lambda s: ingest.reorder(s, "g", "f", "p", most_held=5))
    assert sorted(r["t"] for r in got) == list(range(2, 10))


def test_the_last_layout_is_flushed(spark, tmp_path):
    batches = [[("c", t, "a" if t < 5 else "b") for t in range(8)], [("c", 8, "b"), ("c", 9, "a"), ("c", ingest.END_OF_STREAM, None)]]
    got = streamed(spark, tmp_path, batches, "cam string, t long, lay string", lambda s: ingest.layout_runs(s, "cam", "t", "lay"))
    assert sorted((r["first"], r["last"], r["layout"]) for r in got) == [(0, 4, "a"), (5, 8, "b"), (9, 9, "a")]


def test_suppression_looks_at_the_most_confident(spark):
    rows = [(1, "car", i, 1 - i / 100, 20.0 * i, 0.0, 20.0 * i + 10, 10.0) for i in range(30)]
    det = spark.createDataFrame(rows, "frame long, object_name string, row_id long, confidence double, xmin double, ymin double, xmax double, ymax double")
    assert sorted(r["row_id"] for r in tracks.non_max_suppression(det, ["frame"], "row_id", most_in=7).collect()) == list(range(7))


def test_batched_tracks(spark):
    tiles = spark.createDataFrame([(1, 10, 1.0), (1, 11, 0.0), (2, 20, 0.5), (3, 30, 0.5)], "t long, tile_id long, proxy double")
    asked = spark.createDataFrame([(0, 1, 1), (0, 2, 1), (0, 3, 2), (0, 4, 9), (1, 5, 3)], "workload_id int, ord long, t long")
    got = limits.track_query_batched(asked, tiles, tiles.where("tile_id = 20"), 2)
    assert sorted(map(tuple, got.collect())) == [(0, 3, 2, 1, 1), (1, 1, 1, 1, 1)]


def test_an_index_is_stored_once(spark, sf, tmp_path):
    tables = index.build_index(read(spark, sf, "tile").limit(80), index.IndexConfig(buckets=6, k=2))
    index.write_index(tables, str(tmp_path / "i"))
    back = index.read_index(spark, str(tmp_path / "i"))
    assert back["reps"].count() == 6 and back["topk"].count() == 160
    with pytest.raises(Exception, match="already exists|PATH_ALREADY_EXISTS"):
        index.write_index(tables, str(tmp_path / "i"))


def test_experiments_and_sources(spark, tmp_path):
    assert len(selection.EXPERIMENTS) >= 26
    got = selection.run_experiment(spark, "common_precision_naive_1000", 2, 3000).collect()
    assert [r["trial"] for r in got] == [0, 1]
    (tmp_path / "s.csv").write_text("i,p,y\n1,5,0\n2,20,1\n")
    sources = selection.Sources({"own": selection.SourceSpec("s.csv", "i", "p", "y", 10.0)})
    assert sorted(map(tuple, sources.open(spark, str(tmp_path), "own").collect())) == [(1, 0.5, 0.0), (2, 1.0, 1.0)]


def test_tensor_rows_of_another_length_are_refused(spark):
    df = spark.createDataFrame([(1, bytearray(np.arange(3, dtype="<f4").tobytes()))], "id int, x binary")
    assert connectors.read_tensor(df, "x", 3).first()["x"] == [0, 1, 2]
    with pytest.raises(Exception, match="tensor row"):
        connectors.read_tensor(df, "x", 4).collect()


def test_a_cluster_needs_a_shared_folder():
    context = SimpleNamespace(master="spark://host:7077", getConf=lambda: {})
    with pytest.raises(RuntimeError, match="checkpoint"):
        shared.shared_dir(SimpleNamespace(sparkContext=context, conf=SimpleNamespace(get=lambda k, d: d)))


def test_scratch_deletes_what_is_not_kept(spark):
    at = lambda df: df.inputFiles()[0].removeprefix("file://").rsplit("/", 1)[0]
    with shared.scratch(spark):
        with shared.scratch(spark) as made:
            gone, kept = shared.materialize(spark.range(3), "gone"), made.keep(shared.materialize(spark.range(4), "kept"))
            paths = at(gone), at(kept)
        assert not os.path.exists(paths[0]) and kept.count() == 4
    assert not os.path.exists(paths[1])
