"""Queries for catalogs and other stored inputs, regions of frames, batched tracks, costs, experiments and streams."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from scantling.functions import geometry as g
from scantling.operators import limits, regions, selection
from scantling.plans import selector_sql as sqls
from scantling.plans.base import Registry
from scantling.plans.semantic import SCORE, scored
from scantling.plans.semantic import tiles as tiles_of
from scantling.sources import connectors as c
from scantling.sources import views
from scantling.sources.shared import new_path
from scantling.streaming import ingest

QUERIES = Registry()
read, w = views.read, views.with_views


def add(name: str, sql: str | None = None, *need: str):
    return QUERIES.add(name, f"{w(*need)}{sql}" if sql and need else sql)


# catalogs: written in the shared folder and read back
CELLS = ", cat AS (SELECT seg_start, seg_end, row_no, col_no, bool_or(has_roi) AS has_roi FROM v_grid GROUP BY ALL)"
VIDEO = {"width": 1920, "height": 1080, "gop": 30, "total_frames": 6000, "total_tiles": 36_000, "tiles_with_roi": 9000}


def stored_catalog(s: SparkSession, p: str) -> str:
    cells = read(s, p, "grid").groupBy("seg_start", "seg_end", "row_no", "col_no").agg(F.bool_or("has_roi").alias("has_roi"))
    path = new_path(s, "catalog")
    c.write_catalog(cells.withColumn("rect", F.when(F.col("has_roi"), F.format_string("(%d, %d, 64, 64)", F.col("col_no") * 64, F.col("row_no") * 64))), path, VIDEO)
    return path


add("src14_catalog", f"{CELLS} SELECT seg_start, seg_end, CAST(max(row_no) OVER s + 1 AS INT) AS rows, CAST(max(col_no) OVER s + 1 AS INT) AS cols, row_no, col_no, CASE WHEN has_roi THEN '(' || col_no*64 || ', ' || row_no*64 || ', 64, 64)' END AS rect FROM cat WINDOW s AS (PARTITION BY seg_start) QUALIFY has_roi", "grid")(
    lambda s, p: c.read_catalog(s, stored_catalog(s, p)))
QUERIES.add("meta02_video", "SELECT 1920 AS width, 1080 AS height, 30 AS gop")(lambda s, p: c.read_video(s, stored_catalog(s, p)).select("width", "height", "gop"))
add("meta10_discovered_grid", f"{CELLS} SELECT greatest(seg_start, 100) AS seg_start, least(seg_end, 5000) AS seg_end, CAST(max(row_no)+1 AS BIGINT) AS rows, CAST(max(col_no)+1 AS BIGINT) AS cols, count(*) AS tiles FROM cat WHERE seg_end > 100 AND seg_start < 5000 GROUP BY ALL", "grid")(
    lambda s, p: c.discover_grid(read(s, p, "grid").select(F.concat(F.lit("/video/"), F.concat_ws("_", "seg_start", "seg_end"), F.lit("/"), F.concat_ws("_", "row_no", "col_no"), F.lit(".mp4")).alias("file")), 100, 5000))


def stored_workload(s: SparkSession, p: str) -> str:
    """A text for each workload: its frames in order, and a line that ends it."""
    rows = F.transform(F.sort_array(F.collect_list(F.struct("ord", "t"))), lambda x: x["t"].cast("string"))
    path = new_path(s, "workload")
    read(s, p, "workload").groupBy("workload_id").agg(F.concat(F.array_join(rows, "\n"), F.lit("\n#")).alias("value")).repartition(5, "workload_id").select("value").write.text(path)
    return path


add("src31_workload", " SELECT floor(t*3) AS t, count(*) AS n FROM v_workload GROUP BY 1".replace("floor(t*3)", "t*3"), "workload")(
    lambda s, p: c.read_workload(s, stored_workload(s, p)).groupBy("t").agg(F.count("*").alias("n")))


def stored_detections(s: SparkSession, p: str) -> str:
    path = new_path(s, "detections")
    det = read(s, p, "det").withColumn("ind", F.col("line").cast("long")).select("frame", "object_name", "confidence", "xmin", "ymin", "xmax", "ymax", "ind")
    c.write_detections(det, path, F.col("confidence") >= 0.5)
    return path


add("snk08_filtered_csv", " SELECT frame, object_name, confidence, xmin, ymin, xmax, ymax, CAST(line AS BIGINT) AS ind FROM v_det WHERE confidence >= CAST(0.5 AS DOUBLE)", "det")(lambda s, p: c.read_detections(s, stored_detections(s, p)))
add("src18_detection_folder", " SELECT object_name, count(*) AS n FROM v_det WHERE confidence >= CAST(0.5 AS DOUBLE) AND object_name IN ('A','N') GROUP BY object_name", "det")(
    lambda s, p: c.read_detections(s, stored_detections(s, p), ["A", "N"]).groupBy("object_name").agg(F.count("*").alias("n")))


def raw_tensor(s, p):
    pack = F.udf(lambda v: __import__("struct").pack(f"<{len(v)}f", *v), "binary")
    return c.read_tensor(read(s, p, "tile").select("tile_id", pack("embedding").alias("x")), "x", 64)


add("src29_tensor", " SELECT tile_id, round(CAST(embedding[1] AS DOUBLE), 5) AS first, round(CAST(embedding[64] AS DOUBLE), 5) AS last FROM v_tile", "tile")(
    lambda s, p: raw_tensor(s, p).select("tile_id", F.round(F.element_at("x", 1).cast("double"), 5).alias("first"), F.round(F.element_at("x", 64).cast("double"), 5).alias("last")))
add("src32_file_names", "SELECT p_partkey, 'day' || (p_partkey % 3) || '/day' || (p_partkey % 3) || '-' || p_partkey || '.csv' AS csv, 'day' || (p_partkey % 3) || '/' || p_partkey || '.mp4' AS video FROM part")(
    lambda s, p: read(s, p, "part").select("p_partkey", *[c.file_name_column(F.concat(F.lit("day"), (F.col("p_partkey") % 3).cast("string")), F.col("p_partkey"), kind).alias(name) for kind, name in (("csv", "csv"), ("mp4", "video"))]))

# how a decoder gets from frame to frame; tiles within larger ones
add("src13_seek_or_skip", " SELECT workload_id, t, before IS NULL OR t // 30 <> before // 30 AS seeks, CASE WHEN before IS NULL OR t // 30 <> before // 30 THEN t % 30 ELSE t - before - 1 END AS skipped FROM (SELECT workload_id, t, lag(t) OVER (PARTITION BY workload_id ORDER BY t) AS before FROM (SELECT DISTINCT workload_id, t FROM v_workload))", "workload")(
    lambda s, p: c.seek_or_skip(read(s, p, "workload").select("workload_id", "t").distinct(), "workload_id", "t", 30))
FINE = ", fine AS (SELECT DISTINCT seg_start, row_no, col_no, col_no*64 AS x1, row_no*64 AS y1, col_no*64+64 AS x2, row_no*64+64 AS y2 FROM v_grid), coarse AS (SELECT DISTINCT seg_start, CAST(col_no // 2 AS INT) AS coarse, col_no // 2 * 128 AS x1, 0 AS y1, col_no // 2 * 128 + 128 AS x2, 128 AS y2 FROM v_grid)"


def in_coarse(s, p):
    grid = read(s, p, "grid").select("seg_start", "row_no", "col_no").distinct()
    box = lambda x1, y1, x2, y2: F.struct(*[v.cast("double").alias(n) for v, n in ((x1, "x1"), (y1, "y1"), (x2, "x2"), (y2, "y2"))])
    fine = grid.select("seg_start", "row_no", "col_no", box(F.col("col_no") * 64, F.col("row_no") * 64, F.col("col_no") * 64 + 64, F.col("row_no") * 64 + 64).alias("a"))
    k = F.floor(F.col("col_no") / 2)
    wide = grid.select("seg_start", k.cast("int").alias("coarse"), box(k * 128, F.lit(0), k * 128 + 128, F.lit(128)).alias("b")).distinct()
    return fine.join(wide, "seg_start").where(g.includes(F.col("b"), F.col("a"))).select("seg_start", "row_no", "col_no", "coarse")


add("j10_tile_in_coarse", f"{FINE} SELECT f.seg_start, row_no, col_no, coarse FROM fine f JOIN coarse k ON f.seg_start = k.seg_start AND f.x1 >= k.x1 AND f.y1 >= k.y1 AND f.x2 <= k.x2 AND f.y2 <= k.y2", "grid")(in_coarse)

# batched tracks and what they cost
BATCH = 16
TQ2 = f"""{SCORE}, op AS (SELECT t, tile_id, tile_id % 10 = 0 AS known FROM pred JOIN v_tile USING (tile_id) WHERE score > 0),
ct AS (SELECT workload_id, count(*) AS tiles, count(DISTINCT tile_id) FILTER (WHERE NOT known) AS calls FROM v_workload JOIN op USING (t) GROUP BY workload_id)"""
add("tq2_track_query_batched", f"{TQ2} SELECT workload_id, tiles, CAST(ceil(tiles / {BATCH}) AS BIGINT) AS batches, calls, (tiles - 1) % {BATCH} + 1 AS in_last FROM ct", "tile", "workload")(
    lambda s, p: limits.track_query_batched(read(s, p, "workload"), scored(s, p), tiles_of(s, p).where("tile_id % 10 = 0"), BATCH))
add("a33_query_cost", f"{TQ2} SELECT workload_id, tiles, calls, round(tiles * 12.5::DOUBLE / 1000, 6) AS decode_s, round(calls * 33.0::DOUBLE / 1000, 6) AS nn_s, round(tiles * 12.5::DOUBLE / 1000 + calls * 33.0::DOUBLE / 1000, 6) AS total_s FROM ct", "tile", "workload")(
    lambda s, p: limits.query_cost(limits.track_query_batched(read(s, p, "workload"), scored(s, p), tiles_of(s, p).where("tile_id % 10 = 0"), BATCH).select("workload_id", "tiles", "calls"), 12.5, 33.0))

# regions of frames: each tile's vector is a small picture of its camera
PIXELS = "list_transform(embedding, lambda x: floor(CAST(x AS DOUBLE) * 100))"


def pictures(s, p) -> DataFrame:
    return read(s, p, "tile").select((F.col("tile_id") % 4).cast("int").alias("camera"), "t", F.transform("embedding", lambda x: F.floor(x.cast("double") * 100).cast("double")).alias("pixels"))


for model in regions.MODELS:
    add(f"t01_regions_{model}")(lambda s, p, model=model: regions.fetch_regions(pictures(s, p), "camera", "t", "pixels", 8, model, 30.0, 0.25, span=100))
add("g38_masked_frames", f" SELECT tile_id, CAST(list_sum(list_transform(range(1, 65), lambda i: CASE WHEN (i-1) % 8 >= 2 AND (i-1) % 8 < 6 AND NOT ((i-1) // 8 < 3 AND (i-1) % 8 < 4) THEN px[i] ELSE 0 END)) AS DOUBLE) AS total, 32 AS n FROM (SELECT tile_id, {PIXELS} AS px FROM v_tile)", "tile")(
    lambda s, p: regions.mask_frames(read(s, p, "tile").select("tile_id", F.transform("embedding", lambda x: F.floor(x.cast("double") * 100).cast("double")).alias("px")), "px", 8, [[(0.0, 0.0), (4.0, 0.0), (4.0, 3.0), (0.0, 3.0)]], (2, 0, 6, 8))
    .select("tile_id", F.aggregate("px", F.lit(0.0), lambda a, b: a + b).alias("total"), F.size("px").alias("n")))
add("g39_tile_crop", " SELECT roi_id, greatest(x1, 200) - x1 AS cx1, greatest(y1, 100) - y1 AS cy1, least(x2, 1200) - x1 AS cx2, least(y2, 700) - y1 AS cy2 FROM v_roi WHERE greatest(x1, 200) < least(x2, 1200) AND greatest(y1, 100) < least(y2, 700)", "roi")(
    lambda s, p: read(s, p, "roi").select("roi_id", *[v.alias(n) for v, n in zip(regions.tile_crop(tuple(F.col(x) for x in ("x1", "y1", "x2", "y2")), tuple(F.lit(v) for v in (200.0, 100.0, 1200.0, 700.0))), ("cx1", "cy1", "cx2", "cy2"), strict=True)]).where("cx1 IS NOT NULL"))
add("g40_class_remap", " SELECT CASE object_name WHEN 'R' THEN 'A' ELSE object_name END AS name, count(*) AS n FROM v_det GROUP BY 1", "det")(
    lambda s, p: read(s, p, "det").groupBy(regions.remap_classes(F.col("object_name"), {"R": "A"}).alias("name")).agg(F.count("*").alias("n")))

# experiments
for kind, target in (("recall", selection.Target(recall=0.85, budget=500)), ("precision", selection.Target(precision=0.75, budget=500))):
    run = selection.run_recall if kind == "recall" else selection.run_precision
    goal = target.recall if kind == "recall" else target.precision
    add(f"as13_run_{kind}", f" SELECT * FROM ({sqls.quality(sqls.chosen('recall_sqrt' if kind == 'recall' else 'precision_two_stage', target))})", "proxy")(
        lambda s, p, run=run, goal=goal: selection.quality_of(read(s, p, "proxy"), run(read(s, p, "proxy"), 500, goal)))
add("as12_experiment")(lambda s, p: selection.run_experiment(s, "common_recall_sqrt_1000", trials=2, rows=5000))
SOURCES = selection.Sources({"events": selection.SourceSpec("events.parquet", "event_id", "value", "value", 200.0, 100.0)})
add("src22_named_source", "SELECT event_id AS id, least(value/200, 1) AS proxy_score, CAST(value > 100 AS INT)::DOUBLE AS label FROM events")(lambda s, p: SOURCES.open(s, p, "events"))


# streams, run to the end of what is there
def events_of(s: SparkSession, p: str) -> DataFrame:
    schema = read(s, p, "events").schema
    return s.readStream.schema(schema).option("pathGlobFilter", "events.parquet").parquet(p)


def to_end(out: DataFrame) -> DataFrame:
    s = out.sparkSession
    path, done = new_path(s, "stream"), new_path(s, "stream-checkpoint")
    out.writeStream.format("parquet").option("path", path).option("checkpointLocation", done).outputMode("append").trigger(availableNow=True).start().awaitTermination()
    return s.read.schema(out.schema).parquet(path)


add("st2_layout_runs", "SELECT camera, first, last, layout FROM (SELECT camera, min(id) AS first, max(id) AS last, any_value(layout) AS layout, max(max(id)) OVER (PARTITION BY camera) AS final FROM (SELECT *, sum(new) OVER (PARTITION BY camera ORDER BY id) AS part FROM (SELECT *, CASE WHEN lag(layout) OVER (PARTITION BY camera ORDER BY id) = layout THEN 0 ELSE 1 END AS new FROM (SELECT CAST(event_id % 4 AS VARCHAR) AS camera, event_id AS id, event_type AS layout FROM events))) GROUP BY camera, part) WHERE last < final")(
    lambda s, p: to_end(ingest.layout_runs(events_of(s, p).select((F.col("event_id") % 4).alias("camera"), F.col("event_id").alias("id"), "event_type"), "camera", "id", "event_type")))
add("st4_reordered", "SELECT CAST(event_id % 4 AS VARCHAR) AS grp, event_id // 4 AS t, event_type AS payload FROM events")(
    lambda s, p: to_end(ingest.reorder(events_of(s, p).select((F.col("event_id") % 4).alias("g"), F.floor(F.col("event_id") / 4).alias("f"), "event_type"), "g", "f", "event_type")))
MOVING = """WITH RECURSIVE o AS MATERIALIZED (SELECT CAST(event_id % 4 AS VARCHAR) AS camera, event_id AS t, value, row_number() OVER (PARTITION BY event_id % 4 ORDER BY event_id) AS i FROM events),
go AS (SELECT camera, i, value AS mean, CAST(NULL AS DOUBLE) AS background FROM o WHERE i = 1 UNION ALL SELECT o.camera, o.i, go.mean + 0.1::DOUBLE * (o.value - go.mean), go.mean FROM go JOIN o ON o.camera = go.camera AND o.i = go.i + 1)
SELECT camera, t, value, round(background, 6) AS background FROM go JOIN o USING (camera, i) WHERE abs(value - background) > 150"""
add("st3_moving", MOVING)(
    lambda s, p: to_end(ingest.moving(events_of(s, p).select((F.col("event_id") % 4).alias("g"), F.col("event_id").alias("f"), "value"), "g", "f", "value", 150.0)).withColumn("background", F.round("background", 6)))
