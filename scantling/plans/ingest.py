"""Queries for scans, lookups, decode planning and sinks."""

from __future__ import annotations

from pyspark.sql import functions as F

from scantling.functions import geometry
from scantling.plans.base import Registry
from scantling.sources import connectors as c
from scantling.sources import views
from scantling.streaming import ingest

QUERIES = Registry()
read, w = views.read, views.with_views


def add(name: str, sql: str | None = None, *need: str):
    return QUERIES.add(name, f"{w(*need)}{sql}" if sql and need else sql)


CAT = ", cat AS (SELECT seg_start, seg_end, row_no, col_no, bool_or(has_roi) AS has_roi, min(cluster) AS cluster FROM v_grid GROUP BY ALL)"


def catalog(s, p):
    return read(s, p, "grid").groupBy("seg_start", "seg_end", "row_no", "col_no").agg(F.bool_or("has_roi").alias("has_roi"), F.min("cluster").alias("cluster"))


tile = lambda s, p: read(s, p, "tile").select("t", "tile_id", "truth")
add("src03_seek", " SELECT t, tile_id, truth FROM v_tile WHERE t >= 50", "tile")(lambda s, p: tile(s, p).where("t >= 50"))
add("src04_skip_payload", " SELECT t, count(*) AS n FROM v_tile WHERE t % 2 = 0 GROUP BY t", "tile")(lambda s, p: tile(s, p).where("t % 2 = 0").groupBy("t").agg(F.count("*").alias("n")))
add("src05_ranged_read", " SELECT t, tile_id, truth FROM v_tile WHERE t >= 20 AND t < 60 AND t NOT IN (SELECT t FROM v_workload WHERE workload_id = 2)", "tile", "workload")(
    lambda s, p: c.read_frames(tile(s, p), 20, 60, skip=read(s, p, "workload").where("workload_id = 2")))
SEG = ", sg AS (SELECT DISTINCT seg_start, seg_end FROM v_grid), hit AS (SELECT seg_start, t FROM v_workload JOIN sg ON t >= seg_start AND t < seg_end WHERE workload_id = 1)"
add("src06_decode_plan", f"{SEG} SELECT seg_start, min(t) AS start, max(t)-min(t)+1 AS length, max(t)-min(t)+1-count(DISTINCT t) AS n_skip FROM hit GROUP BY seg_start", "workload", "grid")(
    lambda s, p: c.decode_plan(read(s, p, "workload").where("workload_id = 1"), read(s, p, "grid").select("seg_start", "seg_end").distinct()).select("seg_start", "start", "length", F.size("skip").cast("long").alias("n_skip")))
FILES = "SELECT 'cam/' || p_partkey || '.mp4' AS file, CAST(p_size * 10 AS BIGINT) AS n_frames FROM part"
files = lambda s, p: read(s, p, "part").select(F.concat(F.lit("cam/"), F.col("p_partkey").cast("string"), F.lit(".mp4")).alias("file"), (F.col("p_size") * 10).cast("long").alias("n_frames"))
add("src07_file_offsets", f"SELECT file, n_frames, coalesce(sum(n_frames) OVER (ORDER BY CAST(regexp_extract(file, '([0-9]+)[.]', 1) AS BIGINT), file ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS \"offset\" FROM ({FILES})")(
    lambda s, p: c.file_offsets(files(s, p)))
add("src08_stale_files", f"SELECT file, 'new' AS what FROM ({FILES}) WHERE n_frames % 3 = 0 UNION ALL SELECT file, 'gone' FROM ({FILES}) WHERE n_frames % 7 = 0 AND NOT n_frames % 3 = 0")(
    lambda s, p: c.stale_files(files(s, p).where("n_frames % 3 <> 0").withColumnRenamed("n_frames", "size"), files(s, p).where("n_frames % 3 = 0 OR n_frames % 7 <> 0").withColumnRenamed("n_frames", "size")))
add("src09_current_segment", " SELECT t, tile_id, CAST(floor(t/30) AS BIGINT)*30 AS seg_start FROM v_tile", "tile")(lambda s, p: tile(s, p).select("t", "tile_id", (F.floor(F.col("t") / 30) * 30).alias("seg_start")))
add("src10_full_scan", f"{CAT} SELECT seg_start, row_no, col_no, unnest(range(seg_start, seg_end)) AS t FROM cat WHERE has_roi", "grid")(
    lambda s, p: c.scan_tiles(catalog(s, p)).select("seg_start", "row_no", "col_no", "t"))
add("src10_first_frames", f"{CAT} SELECT row_no, col_no, seg_start AS t FROM cat WHERE has_roi AND cluster IN (0, 1)", "grid")(lambda s, p: c.scan_tiles(catalog(s, p), True, F.col("cluster").isin(0, 1)).select("row_no", "col_no", "t"))
KEYS = " SELECT id AS t, CAST(id % 2 AS INT) AS row_no FROM v_proxy"
add("src11_point_lookup", f"{CAT}, ky AS ({KEYS}) SELECT ky.t, cat.row_no, col_no FROM ky JOIN cat ON ky.t >= seg_start AND ky.t < seg_end AND ky.row_no = cat.row_no", "grid", "proxy")(
    lambda s, p: c.select_tiles(catalog(s, p), read(s, p, "proxy").select(F.col("id").alias("t"), (F.col("id") % 2).cast("int").alias("row_no"))).select("t", "row_no", "col_no"))
add("src12_tiles_in_frame", f"{CAT} SELECT row_no, col_no, has_roi FROM cat WHERE 1234 >= seg_start AND 1234 < seg_end", "grid")(
    lambda s, p: c.select_tiles(catalog(s, p), s.createDataFrame([(1234,)], "t long")).select("row_no", "col_no", "has_roi"))
add("src15_tile_labels", " SELECT frame, line, string_agg(object_name, ',' ORDER BY object_name) AS names FROM v_det WHERE object_name IN ('A','N') GROUP BY frame, line", "det")(
    lambda s, p: read(s, p, "det").where(F.col("object_name").isin("A", "N")).groupBy("frame", "line").agg(F.array_join(F.sort_array(F.collect_list("object_name")), ",").alias("names")))
add("src16_frame_rows", " SELECT frame, count(*) AS n, max(confidence) AS best FROM v_det WHERE object_name = 'R' GROUP BY frame", "det")(lambda s, p: read(s, p, "det").where("object_name = 'R'").groupBy("frame").agg(F.count("*").alias("n"), F.max("confidence").alias("best")))
add("src17_named_detections", " SELECT frame, line, CASE object_name WHEN 'A' THEN 'car' ELSE 'bus' END AS name, confidence FROM v_det WHERE object_name IN ('A','N') AND confidence > CAST(0.4 AS DOUBLE)", "det")(
    lambda s, p: c.name_detections(read(s, p, "det").withColumn("cname", F.when(F.col("object_name") == "A", 0).when(F.col("object_name") == "N", 1).otherwise(2)), {0: "car", 1: "bus", 2: "person"}, ["car", "bus"]).where("confidence > CAST(0.4 AS DOUBLE)").select("frame", "line", F.col("object_name").alias("name"), "confidence"))
add("src30_normalised_tensor", " SELECT tile_id, round((CAST(embedding[1] AS DOUBLE)/255-CAST(0.5 AS DOUBLE))/CAST(0.25 AS DOUBLE),6) AS first, round((CAST(embedding[8] AS DOUBLE)/255-CAST(0.5 AS DOUBLE))/CAST(0.25 AS DOUBLE),6) AS last FROM v_tile", "tile")(
    lambda s, p: read(s, p, "tile").select("tile_id", geometry.normalise(F.slice("embedding", 1, 8), 0.5, 0.25).alias("v")).select("tile_id", F.round(F.element_at("v", 1), 6).alias("first"), F.round(F.element_at("v", -1), 6).alias("last")))
add("src21_presence_source", " SELECT tile_id AS id, round(1/(1+exp(CAST(embedding[1] AS DOUBLE)-CAST(embedding[2] AS DOUBLE))),6) AS proxy_score, CASE WHEN EXISTS (SELECT 1 FROM v_det WHERE frame = tile_id) THEN CAST(1 AS DOUBLE) ELSE 0 END AS label FROM v_tile", "tile", "det")(
    lambda s, p: c.presence_source(read(s, p, "det"), read(s, p, "tile").select(F.col("tile_id").alias("id"), F.transform(F.slice("embedding", 1, 2), lambda x: x.cast("double")).alias("logits"))).withColumn("proxy_score", F.round("proxy_score", 6)))
add("src23_beta_source")(lambda s, p: c.beta_source(s, 10_000, 0.01, 2.0, noise=0.01))
add("snk05_catalog_cells", f"{CAT} SELECT seg_start || '_' || seg_end AS key, max(row_no)+1 AS rows, max(col_no)+1 AS cols, any_value(seg_end-seg_start) AS duration, count(*) FILTER (WHERE has_roi) AS n_roi FROM cat GROUP BY ALL", "grid")(
    lambda s, p: c.catalog_document(catalog(s, p).withColumn("rect", F.when(F.col("has_roi"), F.concat_ws(", ", "row_no", "col_no")))).select(F.explode("layouts").alias("key", "v")).select("key", "v.rows", "v.cols", "v.duration", F.size("v.roi").cast("long").alias("n_roi")))
add("snk07_assemble_frames", " SELECT t, string_agg(CAST(tile_id AS VARCHAR), ',' ORDER BY row_no, col_no) AS parts FROM v_tile GROUP BY t", "tile")(
    lambda s, p: c.assemble_frames(read(s, p, "tile").withColumn("payload", F.col("tile_id").cast("string"))).select("t", F.array_join("parts", ",").alias("parts")))
add("snk11_blank_frames", " SELECT tile_id, CASE WHEN tile_id % 5 = 0 THEN 4 ELSE length(CAST(tile_id AS VARCHAR)) END AS n FROM v_tile", "tile")(
    lambda s, p: c.with_blank(read(s, p, "tile").select("tile_id", F.when(F.col("tile_id") % 5 != 0, F.col("tile_id").cast("string").cast("binary")).alias("payload")), "payload", F.lit(4)).select("tile_id", F.length("payload").cast("long").alias("n")))
add("snk12_first_failures", " SELECT CAST(floor(id/30) AS BIGINT)*30 AS seg_start, min(id) AS first_bad FROM v_proxy WHERE proxy_score > CAST(0.9 AS DOUBLE) GROUP BY 1", "proxy")(
    lambda s, p: c.first_failures(read(s, p, "proxy").select(F.col("id").alias("t"), "proxy_score", (F.floor(F.col("id") / 30) * 30).alias("seg_start")), F.col("proxy_score") > 0.9))
add("st1_segment_windows", " SELECT CAST(floor(t/30) AS BIGINT)*30 AS seg_start, count(*) AS n, min(t) AS first, max(t) AS last FROM v_roi GROUP BY 1", "roi")(
    lambda s, p: ingest.segment_windows(ingest.with_time(read(s, p, "roi"), "t"), "t", "seconds", 30).select("seg_start", "n", "first", "last"))
