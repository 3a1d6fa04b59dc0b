"""Queries for joins, aggregations, windows, samples and set operations over detections and labels."""

from __future__ import annotations

from pyspark.sql import functions as F
from pyspark.sql.window import Window

from scantling.functions import geometry as g
from scantling.functions import predicates
from scantling.operators import detections as d
from scantling.operators.sampling import bounds, one_sided, ranked
from scantling.plans.base import Registry
from scantling.plans.scalars import BANS, SCORE, VALID
from scantling.sources import views

QUERIES = Registry()


def box():
    return g.rect("xmin", "ymin", "xmax", "ymax")


def valid():
    return g.fixed(*VALID)


def bans():
    return [g.fixed(*b) for b in BANS]


HASH = "CAST('0x'||substr(md5(concat('7:',{})),1,8) AS BIGINT)"
read, w = views.read, views.with_views


def add(name: str, sql: str | None, *need: str):
    return QUERIES.add(name, f"{w(*need)} {sql}" if sql and need else sql)


@add("a01_count_objects", f"SELECT frame, count(*) FILTER (WHERE {SCORE}) AS n FROM v_det GROUP BY frame", "det")
def _(s, p):
    return d.count_objects(read(s, p, "det"), ["frame"], predicates.object_counts(F.col("object_name"), box(), valid(), bans(), ["A", "R"]))


@add("a08_exact_sum", "SELECT sum(truth) AS total, count(*) AS n FROM v_tile", "tile")
def _(s, p):
    return read(s, p, "tile").agg(F.sum("truth").alias("total"), F.count("*").alias("n"))


SPINE = "spine AS (SELECT unnest(range(0, (SELECT max(frame) + 1 FROM v_det))) AS frame), counts AS (SELECT s.frame, count(v.frame) AS n FROM spine s LEFT JOIN v_det v ON s.frame = v.frame GROUP BY s.frame)"


def dense(s, p):
    det = read(s, p, "det")
    last = det.agg(F.max("frame")).first()[0]
    return d.dense_counts(det, "frame", 0, -1 if last is None else last)


@add("a11_dense_counts", None)
def _(s, p):
    return dense(s, p)


QUERIES["a11_dense_counts"] = (QUERIES["a11_dense_counts"][0], f"{w('det')}, {SPINE} SELECT frame, n FROM counts")
QUERIES.add("j16_dense_zero_fill", f"{w('det')}, {SPINE} SELECT frame, n FROM counts WHERE n = 0")(lambda s, p: dense(s, p).where("n = 0"))
QUERIES.add("a12_presence", f"{w('det')}, {SPINE} SELECT frame, least(n, 1) AS present FROM counts")(lambda s, p: d.presence(dense(s, p)))
QUERIES.add("a13_clipped_count", f"{w('det')}, {SPINE} SELECT frame, least(n, 3) AS n FROM counts")(lambda s, p: d.clipped(dense(s, p), 3))
CELLS = ", ".join("count(*) FILTER (WHERE object_name = '{0}') AS n_{0}".format(c) for c in "ANR")
CLIPPED = ", ".join("least(count(*) FILTER (WHERE object_name = '{0}'), {1}) AS n_{0}".format(c, "{0}") for c in "ANR")
add("a14_class_presence", f"SELECT frame, {CLIPPED.format(1)} FROM v_det GROUP BY frame", "det")(lambda s, p: d.class_matrix(read(s, p, "det"), "frame", "object_name", ["R", "A", "N"], 1))
add("a15_class_counts", f"SELECT frame, {CLIPPED.format(2)} FROM v_det GROUP BY frame", "det")(lambda s, p: d.class_matrix(read(s, p, "det"), "frame", "object_name", ["R", "A", "N"], 2))
add("p10_multi_count", f"SELECT * FROM (SELECT frame, {CELLS} FROM v_det GROUP BY frame) WHERE n_A >= 1 AND n_N >= 2 AND n_R >= 1", "det")(
    lambda s, p: d.multi_count(read(s, p, "det"), "frame", "object_name", {"A": 1, "N": 2, "R": 1}))
add("p11_all_classes", "SELECT frame FROM v_det WHERE object_name IN ('A','N','R') GROUP BY frame HAVING count(DISTINCT object_name) = 3", "det")(
    lambda s, p: d.all_classes_present(read(s, p, "det"), "frame", "object_name", ["A", "N", "R"]))

CONF = "count(*) FILTER (WHERE {} AND {}) + 1"
BM = f"""c AS (SELECT {CONF.format('p', 't')} AS tp, {CONF.format('NOT p', 'NOT t')} AS tn, {CONF.format('p', 'NOT t')} AS fp, {CONF.format('NOT p', 't')} AS fn
  FROM (SELECT proxy_score > CAST(0.5 AS DOUBLE) AS p, label = 1 AS t FROM v_proxy))
SELECT tp, tn, fp, fn, round(tp/(tp+fn),6) AS recall, round(tn/(tn+fp),6) AS specificity, round(tp/(tp+fp),6) AS "precision", round(tn/(tn+fn),6) AS npv, round(fp/(fp+tn),6) AS fpr,
 round(fp/(tp+fp),6) AS fdr, round(fn/(tp+fn),6) AS fnr, round((tp+tn)/(tp+tn+fp+fn),6) AS accuracy, round(tp*2/(tp*2+fp+fn),6) AS f1, round((tp+fn)/(tp+tn+fp+fn),6) AS base_rate,
 round((tp+fp)/(tp+tn+fp+fn),6) AS positive_rate FROM c"""
QUERIES.add("a16_binary_metrics", f"{w('proxy')}, {BM}")(lambda s, p: d.binary_metrics(read(s, p, "proxy"), F.col("proxy_score") > 0.5, F.col("label") == 1))
PAIRED = "SELECT frame, n, n_A + n_R AS pred FROM (SELECT frame, count(*) AS n, count(*) FILTER (WHERE object_name='A') AS n_A, count(*) FILTER (WHERE object_name='R') AS n_R FROM v_det GROUP BY frame)"


def paired(s, p):
    return read(s, p, "det").groupBy("frame").agg(F.count("*").alias("n"), F.count_if(F.col("object_name").isin("A", "R")).alias("pred"))


add("a17_count_metrics", f"SELECT round(avg(CAST(pred = n AS INT)),6) AS accuracy, CAST(sum(abs(pred-n)) AS BIGINT) AS absolute_error, CAST(sum(pred-n) AS BIGINT) AS signed_error, CAST(sum(n) AS BIGINT) AS n_instances, count(*) AS n_frames FROM ({PAIRED})", "det")(
    lambda s, p: d.count_metrics(paired(s, p), "pred", "n"))
add("a17_confusion", f"SELECT pred, n AS truth, count(*) AS n FROM ({PAIRED}) GROUP BY ALL", "det")(lambda s, p: d.confusion(paired(s, p).withColumnRenamed("n", "truth"), "pred", "truth"))
TRACKED = "SELECT *, (CAST(xmin AS BIGINT) * 31 + CAST(ymin AS BIGINT)) AS ind FROM v_track"


def tracked(s, p):
    return read(s, p, "track").withColumn("ind", F.col("xmin").cast("long") * 31 + F.col("ymin").cast("long"))


add("a18_track_coverage", f"SELECT count(*) AS n_tracks, round(avg(CAST(seen AS INT)),6) AS coverage FROM (SELECT ind, bool_or(confidence > CAST(0.97 AS DOUBLE) AND line = 3) AS seen FROM ({TRACKED}) GROUP BY ind)", "track")(
    lambda s, p: d.track_coverage(tracked(s, p), "ind", (F.col("confidence") > 0.97) & (F.col("line") == 3)))
add("a19_largest_frequent", "SELECT max(n) AS max_count FROM (SELECT n, count(*) AS k, sum(count(*)) OVER () AS total FROM (SELECT frame, count(*) AS n FROM v_det GROUP BY frame) GROUP BY n) WHERE k > total * CAST(0.01 AS DOUBLE)", "det")(
    lambda s, p: d.largest_frequent(paired(s, p).select("n"), "n"))
add("a21_tail_length", f"SELECT length - 1 AS tail_length FROM (SELECT length, row_number() OVER (ORDER BY length DESC) - 1 AS rn, count(*) OVER () AS c FROM (SELECT ind, count(*) AS length FROM ({TRACKED}) GROUP BY ind) WHERE length > 3) WHERE rn = CAST(floor(c * CAST(0.99 AS DOUBLE)) AS BIGINT)", "track")(
    lambda s, p: d.tail_length(tracked(s, p), "ind"))
add("a22_bootstrap_mean", f"SELECT round(quantile_cont(m, 0.05),6) AS low, round(quantile_cont(m, 0.95),6) AS high FROM (SELECT trial, sum(truth*bit_count(h%4))/sum(bit_count(h%4)) AS m FROM (SELECT trial, truth, {HASH.format(chr(34) + 'k' + chr(34))} AS h FROM (SELECT truth, trial, trial||'/'||tile_id AS k FROM v_tile, (SELECT unnest(range(0,50)) AS trial))) GROUP BY trial)", "tile")(
    lambda s, p: d.bootstrap_mean(read(s, p, "tile"), "tile_id", "truth", 50, 0.05, 0.95))
add("a27_latency_grid", "SELECT h, w, round(avg(ms),6) AS ms, count(*) AS n FROM v_calib GROUP BY h, w", "calib")(lambda s, p: read(s, p, "calib").groupBy("h", "w").agg(F.round(F.avg("ms"), 6).alias("ms"), F.count("*").alias("n")))
add("a32_distinct", "SELECT DISTINCT object_name, line FROM v_det", "det")(lambda s, p: read(s, p, "det").select("object_name", "line").distinct())

# joins
SEGS = "seg AS (SELECT DISTINCT CAST(floor(frame / 50) * 50 AS BIGINT) AS s FROM v_det)"
QUERIES.add("j04_frame_segment", f"{w('det')}, {SEGS} SELECT s AS seg_start, count(*) AS n FROM v_det JOIN seg ON frame >= s AND frame < s + 50 GROUP BY s")(
    lambda s, p: read(s, p, "det").withColumn("seg_start", F.floor(F.col("frame") / 50) * 50).groupBy("seg_start").agg(F.count("*").alias("n")))
LINK = """SELECT a.frame AS frame_a, a.line AS line_a, b.frame AS frame_b, b.line AS line_b FROM v_track a JOIN v_track b ON a.object_name = b.object_name AND b.frame > a.frame AND b.frame <= a.frame + 3
 WHERE greatest(0, least(a.xmax,b.xmax)-greatest(a.xmin,b.xmin)) * greatest(0, least(a.ymax,b.ymax)-greatest(a.ymin,b.ymin)) >
  CAST(0.7 AS DOUBLE) * ((a.xmax-a.xmin)*(a.ymax-a.ymin)+(b.xmax-b.xmin)*(b.ymax-b.ymin)-greatest(0, least(a.xmax,b.xmax)-greatest(a.xmin,b.xmin)) * greatest(0, least(a.ymax,b.ymax)-greatest(a.ymin,b.ymin)))"""


def linked_pairs(s, p):
    from scantling.operators.tracks import link_frames

    return link_frames(read(s, p, "track"), ["frame", "line"]).select(F.col("a.frame").alias("frame_a"), F.col("a.line").alias("line_a"), F.col("b.frame").alias("frame_b"), F.col("b.line").alias("line_b"))


add("j06_link_frames", LINK, "track")(linked_pairs)
add("p21_linkage", f"SELECT count(*) AS n FROM ({LINK})", "track")(lambda s, p: linked_pairs(s, p).agg(F.count("*").alias("n")))
SKIP = "skip AS (SELECT * FROM (VALUES (0, 0, 300, 300), (1000, 500, 1500, 900)) AS t(a1, b1, a2, b2))"
QUERIES.add("j07_anti_skip", f"{w('roi')}, {SKIP} SELECT roi_id FROM v_roi WHERE NOT EXISTS (SELECT 1 FROM skip WHERE least(x2,a2)>greatest(x1,a1) AND least(y2,b2)>greatest(y1,b1))")(
    lambda s, p: read(s, p, "roi").where(~g.any_of([g.overlap(g.rect("x1", "y1", "x2", "y2"), b).isNotNull() for b in bans()])).select("roi_id"))
QUERIES.add("j08_cells_with_roi", f"{w('roi')} SELECT DISTINCT seg, CAST(floor((y1+y2)/2/200) AS BIGINT) AS row_no, CAST(floor((x1+x2)/2/300) AS BIGINT) AS col_no FROM v_roi")(
    lambda s, p: read(s, p, "roi").select("seg", F.floor((F.col("y1") + F.col("y2")) / 2 / 200).alias("row_no"), F.floor((F.col("x1") + F.col("x2")) / 2 / 300).alias("col_no")).distinct())
QUERIES.add("j14_class_names", f"{w('det')}, names AS (SELECT * FROM (VALUES (0,'car'),(1,'bus'),(2,'person')) AS t(id, name)) SELECT frame, line, name FROM v_det JOIN names ON id = CASE object_name WHEN 'A' THEN 0 WHEN 'N' THEN 1 ELSE 2 END")(
    lambda s, p: read(s, p, "det").select("frame", "line", F.create_map(*[F.lit(x) for k, v in (("A", "car"), ("N", "bus"), ("R", "person")) for x in (k, v)])[F.col("object_name")].alias("name")))
add("j05_workload_tiles", "SELECT workload_id, t, tile_id, count(*) AS n FROM v_workload JOIN v_tile USING (t) GROUP BY ALL", "workload", "tile")(
    lambda s, p: read(s, p, "workload").join(read(s, p, "tile").select("t", "tile_id"), "t").groupBy("workload_id", "t", "tile_id").agg(F.count("*").alias("n")))
add("j11_proxy_truth", "SELECT a.id, a.proxy_score, b.truth FROM v_proxy a JOIN v_tile b ON a.id = b.tile_id", "proxy", "tile")(
    lambda s, p: read(s, p, "proxy").join(read(s, p, "tile"), F.col("id") == F.col("tile_id")).select("id", "proxy_score", "truth"))
add("j13_cache_miss", "SELECT tile_id FROM v_tile WHERE NOT EXISTS (SELECT 1 FROM v_workload w WHERE w.t = v_tile.t AND w.workload_id = 0)", "tile", "workload")(
    lambda s, p: read(s, p, "tile").join(read(s, p, "workload").where("workload_id = 0"), "t", "left_anti").select("tile_id"))
add("j13_cache_hit", "SELECT tile_id FROM v_tile WHERE EXISTS (SELECT 1 FROM v_workload w WHERE w.t = v_tile.t AND w.workload_id = 0)", "tile", "workload")(
    lambda s, p: read(s, p, "tile").join(read(s, p, "workload").where("workload_id = 0"), "t", "left_semi").select("tile_id"))

# pairs of regions and labels
PAIR = "FROM v_roi a JOIN v_roi b ON a.t = b.t AND a.roi_id < b.roi_id"
CD = "sqrt(pow((a.x1+a.x2)/2-(b.x1+b.x2)/2,2)+pow((a.y1+a.y2)/2-(b.y1+b.y2)/2,2))"
DG = "sqrt(pow({0}.x2-{0}.x1,2)+pow({0}.y2-{0}.y1,2))"


def roi_pairs(s, p, condition):
    """Regions of one frame: a frame has few, so the equi-join's groups are small."""
    r = read(s, p, "roi").select("t", "roi_id", g.rect("x1", "y1", "x2", "y2").alias("r"))
    a, b = r.alias("a"), r.alias("b")
    joined = a.join(b, (F.col("a.t") == F.col("b.t")) & (F.col("a.roi_id") < F.col("b.roi_id")))
    return joined.where(condition(F.col("a.r"), F.col("b.r"))).select(F.col("a.roi_id").alias("a_id"), F.col("b.roi_id").alias("b_id"))


add("p15_close_absolute", f"SELECT a.roi_id AS a_id, b.roi_id AS b_id {PAIR} WHERE {CD} <= 400", "roi")(lambda s, p: roi_pairs(s, p, lambda a, b: predicates.close_absolute(a, b, 400)))
add("p16_close_relative", f"SELECT a.roi_id AS a_id, b.roi_id AS b_id {PAIR} WHERE {CD} <= 3 * least({DG.format('a')}, {DG.format('b')})", "roi")(lambda s, p: roi_pairs(s, p, lambda a, b: predicates.close_relative(a, b, 3)))
EDGE = "least(" + ",".join(f"abs(a.{i}-b.{j})" for q in "xy" for i in (q + "1", q + "2") for j in (q + "1", q + "2")) + ")"
add("p17_close_edges", f"SELECT a.roi_id AS a_id, b.roi_id AS b_id {PAIR} WHERE {EDGE} <= 10", "roi")(lambda s, p: roi_pairs(s, p, lambda a, b: predicates.close_edges(a, b, 10)))
IOU = "greatest(0,least(a.xmax,b.xmax)-greatest(a.xmin,b.xmin))*greatest(0,least(a.ymax,b.ymax)-greatest(a.ymin,b.ymin))"


def box_iou(s, p):
    t = read(s, p, "track").select("frame", "line", box().alias("r"))
    a, b = t.alias("a"), t.alias("b")
    return a.join(b, (F.col("a.frame") == F.col("b.frame")) & (F.col("a.line") < F.col("b.line"))).select(
        F.col("a.frame").alias("frame"), F.col("a.line").alias("line_a"), F.col("b.line").alias("line_b"), F.round(g.iou(F.col("a.r"), F.col("b.r")), 6).alias("iou"))


add("g18_box_iou", f"SELECT a.frame, a.line AS line_a, b.line AS line_b, round({IOU}/((a.xmax-a.xmin)*(a.ymax-a.ymin)+(b.xmax-b.xmin)*(b.ymax-b.ymin)-{IOU}),6) AS iou FROM v_track a JOIN v_track b ON a.frame=b.frame AND a.line<b.line", "track")(box_iou)


def frame_labels(s, p):
    point = F.struct(((F.col("xmin") + F.col("xmax")) / 2).alias("x"), ((F.col("ymin") + F.col("ymax")) / 2).alias("y"))
    each = read(s, p, "det").groupBy("frame").agg(F.collect_list("object_name").alias("names"), F.collect_list(point).alias("points"))
    nxt = each.select((F.col("frame") - 1).alias("frame"), F.col("names").alias("names2"), F.col("points").alias("points2"))
    return each.join(nxt, "frame")


PER = "SELECT frame, count(*) AS n, string_agg(object_name, '' ORDER BY object_name) AS names, string_agg(DISTINCT CASE object_name WHEN 'R' THEN 'A' ELSE object_name END, '' ORDER BY CASE object_name WHEN 'R' THEN 'A' ELSE object_name END) AS sets FROM v_det GROUP BY frame"
add("p18_close_counts", f"SELECT a.frame, a.names = b.names AS close FROM ({PER}) a JOIN ({PER}) b ON b.frame = a.frame + 1", "det")(
    lambda s, p: frame_labels(s, p).select("frame", (F.array_sort("names") == F.array_sort("names2")).alias("close")))
add("p20_close_sets", f"SELECT a.frame, a.sets = b.sets AS close FROM ({PER}) a JOIN ({PER}) b ON b.frame = a.frame + 1", "det")(
    lambda s, p: frame_labels(s, p).select("frame", predicates.same_classes(F.col("names"), F.col("names2"), {"R": "A"}).alias("close")))
add("p19_close_positions", """SELECT n1.frame, n1.n = n2.n AND coalesce(x.far, 0) = 0 AS close FROM (SELECT frame, count(*) AS n FROM v_det GROUP BY frame) n1 JOIN (SELECT frame, count(*) AS n FROM v_det GROUP BY frame) n2 ON n2.frame = n1.frame + 1
 LEFT JOIN (SELECT frame, count(*) AS far FROM (SELECT a.frame, a.line, min(sqrt(pow((a.xmin+a.xmax)/2-(b.xmin+b.xmax)/2,2)+pow((a.ymin+a.ymax)/2-(b.ymin+b.ymax)/2,2))) AS m FROM v_det a JOIN v_det b ON b.frame = a.frame + 1 GROUP BY a.frame, a.line, a.xmin, a.ymin, a.xmax, a.ymax) WHERE m >= 600 GROUP BY frame) x ON x.frame = n1.frame""", "det")(
    lambda s, p: frame_labels(s, p).select("frame", predicates.close_positions(F.col("points"), F.col("points2"), 600.0).alias("close")))

# windows, limits, samples, sets
add("w01_rank", "SELECT id, row_number() OVER (ORDER BY proxy_score DESC, id) AS rank FROM v_proxy", "proxy")(
    lambda s, p: ranked(read(s, p, "proxy"), "proxy_score", "id").select("id", (F.col("rank") + 1).alias("rank")))
add("w02_rank_in_frame", "SELECT t, tile_id, CAST(row_number() OVER (PARTITION BY t ORDER BY truth DESC, tile_id) AS INT) AS rank FROM v_tile", "tile")(
    lambda s, p: read(s, p, "tile").select("t", "tile_id", F.row_number().over(Window.partitionBy("t").orderBy(F.desc("truth"), "tile_id")).alias("rank")))
add("w06_dilate", "SELECT id, EXISTS (SELECT 1 FROM v_proxy b WHERE b.proxy_score > CAST(0.9 AS DOUBLE) AND b.id BETWEEN a.id - 10 AND a.id + 10) AS near FROM v_proxy a", "proxy")(
    lambda s, p: d.dilate(read(s, p, "proxy").select("id", (F.col("proxy_score") > 0.9).alias("flag")), "id", "flag"))
CUTS = "SELECT round(proxy_score,4) AS cut, CAST(sum(label) AS BIGINT) AS p, CAST(sum(1-label) AS BIGINT) AS q FROM v_proxy GROUP BY 1"
add("w07_threshold_fnr", f"SELECT max(cut) AS threshold FROM (SELECT cut, sum(p) OVER (ORDER BY cut) - p AS below, sum(p) OVER () AS total FROM ({CUTS})) WHERE below <= total * CAST(0.05 AS DOUBLE)", "proxy")(
    lambda s, p: d.threshold_for_fnr(read(s, p, "proxy"), "proxy_score", F.col("label") == 1, 0.05))
add("w07_thresholds_two_sided", f"SELECT max(cut) FILTER (WHERE missed <= ps * CAST(0.05 AS DOUBLE)) AS low, min(cut) FILTER (WHERE wrong <= qs * CAST(0.05 AS DOUBLE)) AS high FROM (SELECT cut, sum(p) OVER (ORDER BY cut) - p AS missed, sum(p) OVER () AS ps, sum(q) OVER () - sum(q) OVER (ORDER BY cut) + q AS wrong, sum(q) OVER () AS qs FROM ({CUTS}))", "proxy")(
    lambda s, p: d.thresholds_two_sided(read(s, p, "proxy"), "proxy_score", F.col("label") == 1, 0.05, 0.05))
add("w09_runs", "SELECT label, min(id) AS first, max(id) AS last, count(*) AS n FROM (SELECT id, label, id - row_number() OVER (PARTITION BY label ORDER BY id) AS island FROM v_proxy) GROUP BY label, island", "proxy")(
    lambda s, p: d.runs(read(s, p, "proxy"), "id", ["label"]))
add("w10_changes", "SELECT g, part, min(id) AS first, max(id) AS last, any_value(label) AS label, count(*) AS n FROM (SELECT *, CAST(sum(new) OVER (PARTITION BY g ORDER BY id) AS BIGINT) AS part FROM (SELECT id, label, id // 1000 AS g, CASE WHEN lag(label) OVER (PARTITION BY id // 1000 ORDER BY id) = label THEN 0 ELSE 1 END AS new FROM v_proxy)) GROUP BY g, part", "proxy")(
    lambda s, p: d.changes(read(s, p, "proxy").withColumn("g", F.floor(F.col("id") / 1000)), "id", "label", ["g"]))
add("w12_repeat_frames", "SELECT tile_id, truth, tile_id * 3 + unnest([0, 1, 2]) AS out_frame FROM v_tile", "tile")(lambda s, p: d.repeat_frames(read(s, p, "tile").select("tile_id", "truth"), "tile_id", 3))
add("snk09_interleave", "SELECT tile_id, tile_id * 2 + unnest([0, 1]) AS out_frame FROM v_tile", "tile")(lambda s, p: d.repeat_frames(read(s, p, "tile").select("tile_id"), "tile_id", 2))
add("l06_every_nth", "SELECT id, proxy_score FROM v_proxy WHERE id % 4 = 0", "proxy")(lambda s, p: d.every_nth(read(s, p, "proxy").select("id", "proxy_score"), "id", 4))
add("sm01_uniform_sample", f"SELECT id FROM v_proxy ORDER BY {HASH.format('id')}, id LIMIT 300", "proxy")(lambda s, p: d.first_by_hash(read(s, p, "proxy"), "id", 300).select("id"))
add("sm04_permutation", f"SELECT id, row_number() OVER (ORDER BY {HASH.format('id')}, id) AS place FROM v_proxy", "proxy")(lambda s, p: d.permutation(read(s, p, "proxy"), "id"))
add("sm05_split_share", f"SELECT id, CASE WHEN {HASH.format('id')} < {int(0.8 * 2**32)} THEN 'train' ELSE 'val' END AS part FROM v_proxy", "proxy")(lambda s, p: d.share_split(read(s, p, "proxy"), "id", 0.8))
add("sm05_split_balanced", f"SELECT id, label, CASE WHEN row_number() OVER (PARTITION BY label ORDER BY {HASH.format('id')}, id) <= 100 THEN 'train' ELSE 'val' END AS part FROM v_proxy", "proxy")(
    lambda s, p: d.quota_split(read(s, p, "proxy"), "id", "label", 100))
add("sm06_class_weights", "SELECT label, count(*) AS n_c, round(sum(count(*)) OVER () / (count(*) OVER () * count(*)), 6) AS weight FROM v_proxy GROUP BY label", "proxy")(lambda s, p: d.class_weights(read(s, p, "proxy"), "label"))
add("sm07_random_reps", f"SELECT tile_id FROM v_tile ORDER BY {HASH.format('tile_id')}, tile_id LIMIT 12", "tile")(lambda s, p: d.first_by_hash(read(s, p, "tile"), "tile_id", 12).select("tile_id"))
TOP, POS = "SELECT id FROM v_proxy WHERE proxy_score > CAST(0.8 AS DOUBLE)", "SELECT id FROM v_proxy WHERE label = 1 AND id % 7 = 0"
top_ = lambda s, p: read(s, p, "proxy").where("proxy_score > CAST(0.8 AS DOUBLE)").select("id")
pos_ = lambda s, p: read(s, p, "proxy").where("label = 1 AND id % 7 = 0").select("id")
add("set1_union", f"{TOP} UNION {POS}", "proxy")(lambda s, p: top_(s, p).union(pos_(s, p)).distinct())
add("set2_difference", f"{TOP} EXCEPT {POS}", "proxy")(lambda s, p: top_(s, p).subtract(pos_(s, p)))
add("set3_label_union", "SELECT frame, string_agg(DISTINCT object_name, ',' ORDER BY object_name) AS names FROM v_det GROUP BY frame", "det")(
    lambda s, p: read(s, p, "det").groupBy("frame").agg(F.array_join(F.array_sort(F.collect_set("object_name")), ",").alias("names")))
BOUND = "round(avg(x) + {0} * stddev_pop(x) * sqrt(2*ln(1/(2*0.05))) / sqrt(count(x)), 6)"
add("a23_sampling_bound", f"SELECT count(*) AS n, {BOUND.format("1")} AS upper, {BOUND.format("-1")} AS lower FROM (SELECT label AS x FROM v_proxy)", "proxy")(
    lambda s, p: bounds(read(s, p, "proxy"), F.col("label"), 0.05))
add("a24_one_sided", "SELECT round(m + 1.6448536269514722 * sqrt(m*(1-m)/n), 6) AS bernoulli_upper, round(m - 1.6448536269514722 * s / sqrt(n), 6) AS std_lower FROM (SELECT avg(label) AS m, stddev_samp(label) AS s, count(*) AS n FROM v_proxy)", "proxy")(
    lambda s, p: one_sided(read(s, p, "proxy"), F.col("label")))


# label filters, exclusions around accepted frames
def _inter(r: tuple) -> str:
    w_, h_ = f"(least(xmax,{r[2]})-greatest(xmin,{r[0]}))", f"(least(ymax,{r[3]})-greatest(ymin,{r[1]}))"
    return f"(CASE WHEN {w_}>0 AND {h_}>0 THEN {w_}*{h_} ELSE 0 END)"


AREA = "((xmax-xmin)*(ymax-ymin))"
add("p09_label_filter", f"SELECT frame, line, confidence FROM v_det WHERE confidence > CAST(0.3 AS DOUBLE) AND object_name IN ('A','R') AND {_inter(VALID)}>0 AND {_inter(VALID)}/{AREA}>=CAST(0.25 AS DOUBLE) AND " + " AND ".join(f"NOT {_inter(b)}/{AREA}>CAST(0.6 AS DOUBLE)" for b in BANS), "det")(
    lambda s, p: read(s, p, "det").where(predicates.confident(F.col("confidence"), F.col("object_name"), ["A", "R"], 0.3) & predicates.in_region(box(), valid(), bans())).select("frame", "line", "confidence"))
add("j12_blacklist", "SELECT id FROM v_proxy a WHERE NOT EXISTS (SELECT 1 FROM v_proxy b WHERE b.label = 1 AND b.id % 5 = 0 AND a.id BETWEEN b.id - 7 AND b.id + 7)", "proxy")(
    lambda s, p: d.dilate(read(s, p, "proxy").select("id", ((F.col("label") == 1) & (F.col("id") % 5 == 0)).alias("flag")), "id", "flag", 7).where("NOT near").select("id"))
add("w08_running_estimates", f"SELECT CAST(place AS INT) AS place, round(mean, 6) AS mean, round(least_upper, 6) AS least_upper FROM (SELECT place, mean, min(mean + 3.0::DOUBLE/sqrt(place)) OVER (ORDER BY place) AS least_upper FROM (SELECT row_number() OVER x AS place, avg(label) OVER x AS mean FROM v_proxy WINDOW x AS (ORDER BY {HASH.format('id')}, id))) WHERE place <= 500", "proxy")(
    lambda s, p: running_estimates(s, p))


def running_estimates(s, p, rows: int = 500):
    """Running mean and the least upper bound so far over the first rows of a sample: a bounded window."""
    w_ = Window.orderBy(d.hash_order(F.col("id")), "id")
    first = d.first_by_hash(read(s, p, "proxy"), "id", rows).select(F.row_number().over(w_).alias("place"), F.avg("label").over(w_.rowsBetween(Window.unboundedPreceding, 0)).alias("mean"))
    upper = F.min(F.col("mean") + F.lit(3.0) / F.sqrt("place")).over(Window.orderBy("place"))
    return first.select("place", F.round("mean", 6).alias("mean"), F.round(upper, 6).alias("least_upper"))
