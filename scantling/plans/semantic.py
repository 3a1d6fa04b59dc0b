"""Queries for the index, bounded sums, selection, limits, tracks, tiling, the catalog and calibration."""

from __future__ import annotations

from pyspark.sql import functions as F
from pyspark.sql.window import Window

from scantling.functions import costs
from scantling.functions import geometry as g
from scantling.operators import detections as d
from scantling.operators import index, limits, sampling, selection, tiling, tracks
from scantling.plans.base import Registry
from scantling.plans import selector_sql as sqls
from scantling.plans.relational import HASH
from scantling.sources import connectors, views

QUERIES = Registry()
read, w = views.read, views.with_views


def add(name: str, sql: str | None = None, *need: str):
    return QUERIES.add(name, f"{w(*need)}{sql}" if sql and need else sql)


# index -------------------------------------------------------------------------------------------------------------------------
L2 = "sqrt(list_sum(list_transform(range(1,65), lambda i: pow(CAST(a.embedding[i] AS DOUBLE)-CAST(b.embedding[i] AS DOUBLE),2))))"
TOPK = f""", dist AS (SELECT a.tile_id, b.tile_id AS rep_id, {L2} AS dist FROM v_tile a, v_tile b WHERE b.tile_id % 10 = 0),
topk AS (SELECT tile_id, rep_id, dist, CAST(row_number() OVER (PARTITION BY tile_id ORDER BY dist, rep_id) AS INT) AS rank FROM dist QUALIFY rank <= 5)"""
SCORE = f"""{TOPK}, pred AS (SELECT k.tile_id, (sum(dist)*sum(truth)-sum(truth*dist))/((count(*)-1)*sum(dist)) AS score FROM topk k JOIN v_tile r ON k.rep_id = r.tile_id GROUP BY k.tile_id)"""


def tiles(s, p):
    return read(s, p, "tile")


def topk(s, p):
    t = tiles(s, p)
    return index.nearest(t, t.where("tile_id % 10 = 0"), 5)


def scored(s, p):
    """Tiles with the propagated score as proxy."""
    pred = index.propagate(topk(s, p), tiles(s, p).select("tile_id", F.col("truth").alias("score")))
    return tiles(s, p).join(pred, "tile_id").select("tile_id", "t", "row_no", "col_no", "truth", F.col("score").alias("proxy"))


add("w03_nearest_reps", f"{TOPK} SELECT tile_id, rank, rep_id, round(dist,6) AS dist FROM topk", "tile")(lambda s, p: topk(s, p).select("tile_id", "rank", "rep_id", F.round("dist", 6).alias("dist")))
add("j01_distances", f"{TOPK} SELECT rank, count(*) AS n, round(avg(dist),5) AS dist FROM topk GROUP BY rank", "tile")(lambda s, p: topk(s, p).groupBy("rank").agg(F.count("*").alias("n"), F.round(F.avg("dist"), 5).alias("dist")))
add("j02_rep_scores", f"{TOPK} SELECT k.tile_id, k.rank, r.truth AS rep_score FROM topk k JOIN v_tile r ON k.rep_id = r.tile_id", "tile")(
    lambda s, p: topk(s, p).join(tiles(s, p).select(F.col("tile_id").alias("rep_id"), F.col("truth").alias("rep_score")), "rep_id").select("tile_id", "rank", "rep_score"))
add("j03_tile_frames", f"{TOPK} SELECT t, count(*) AS n, round(min(dist),6) AS nearest FROM topk JOIN v_tile USING (tile_id) GROUP BY t", "tile")(
    lambda s, p: topk(s, p).join(tiles(s, p).select("tile_id", "t"), "tile_id").groupBy("t").agg(F.count("*").alias("n"), F.round(F.min("dist"), 6).alias("nearest")))
add("a04_propagated_score", f"{SCORE} SELECT tile_id, round(score,6) AS score FROM pred", "tile")(lambda s, p: scored(s, p).select("tile_id", F.round("proxy", 6).alias("score")))
add("a02_frame_scores", f"{SCORE} SELECT t, round(sum(score),6) AS score FROM pred JOIN v_tile USING (tile_id) GROUP BY t", "tile")(lambda s, p: scored(s, p).groupBy("t").agg(F.round(F.sum("proxy"), 6).alias("score")))
add("a03_best_in_frame", f"{SCORE} SELECT t, tile_id, round(score,6) AS score FROM (SELECT *, row_number() OVER (PARTITION BY t ORDER BY score DESC, tile_id) AS rn FROM pred JOIN v_tile USING (tile_id) WHERE score > -1) WHERE rn = 1", "tile")(
    lambda s, p: index.best_in_frame(scored(s, p), "t", F.col("proxy")).select("t", "tile_id", F.round("score", 6).alias("score")))
add("i02_crack", f""", dist AS (SELECT a.tile_id, b.tile_id AS rep_id, {L2} AS dist FROM v_tile a, v_tile b WHERE b.tile_id % 10 = 0 OR b.tile_id % 7 = 3),
topk AS (SELECT tile_id, rep_id, dist, CAST(row_number() OVER (PARTITION BY tile_id ORDER BY dist, rep_id) AS INT) AS rank FROM dist QUALIFY rank <= 3) SELECT tile_id, rank, rep_id, round(dist,6) AS dist FROM topk""", "tile")(
    lambda s, p: index.crack(tiles(s, p), tiles(s, p).where("tile_id % 10 = 0 OR tile_id % 7 = 3"), 3).select("tile_id", "rank", "rep_id", F.round("dist", 6).alias("dist")))
FPF_N = 8
STEPS = [f"r0 AS (SELECT tile_id AS rep_id, embedding FROM v_tile ORDER BY {HASH.format('tile_id')}, tile_id LIMIT 1)", f"s0 AS (SELECT 0 AS place, tile_id AS rep_id FROM v_tile ORDER BY {HASH.format('tile_id')}, tile_id LIMIT 1)",
         f"q1 AS (SELECT tile_id AS rep_id, embedding FROM (SELECT tile_id, embedding, row_number() OVER (ORDER BY {HASH.format('tile_id')}, tile_id) AS rn FROM v_tile) WHERE rn = 2)",
         f"m1 AS (SELECT a.tile_id, a.embedding, least({L2}, {L2.replace('b.embedding', 'c.embedding')}) AS m FROM v_tile a, r0 b, q1 c)"]
for k in range(2, FPF_N):
    STEPS.append(f"r{k} AS (SELECT tile_id AS rep_id, embedding FROM m{k - 1} ORDER BY m DESC, tile_id LIMIT 1)")
    STEPS.append(f"m{k} AS (SELECT a.tile_id, a.embedding, least(a.m, {L2}) AS m FROM m{k - 1} a, r{k} b)")
FPF = ", " + ", ".join(STEPS) + " SELECT place, rep_id FROM s0 UNION ALL SELECT 1, rep_id FROM q1 " + " ".join(f"UNION ALL SELECT {k}, rep_id FROM r{k}" for k in range(2, FPF_N))
add("i01_farthest_first", FPF, "tile")(lambda s, p: index.farthest_first(tiles(s, p), FPF_N))
add("i03_mining", FPF, "tile")(lambda s, p: index.farthest_first(tiles(s, p), FPF_N, candidates=2))
INDEX_STEPS = [f"q AS MATERIALIZED (SELECT tile_id, embedding, row_number() OVER (ORDER BY {HASH.format('tile_id')}, tile_id) AS rn FROM v_tile)", f"m3 AS MATERIALIZED (SELECT a.tile_id, any_value(a.embedding) AS embedding, min({L2}) AS m FROM v_tile a, (SELECT * FROM q WHERE rn <= 4) b GROUP BY a.tile_id)"]
for k in range(4, 16):
    INDEX_STEPS.append(f"r{k} AS MATERIALIZED (SELECT tile_id, embedding FROM m{k - 1} ORDER BY m DESC, tile_id LIMIT 1)")
    INDEX_STEPS.append(f"m{k} AS MATERIALIZED (SELECT a.tile_id, a.embedding, least(a.m, {L2}) AS m FROM m{k - 1} a, r{k} b)")
INDEX_STEPS.append("rp AS MATERIALIZED (SELECT tile_id, embedding FROM q WHERE rn <= 4" + "".join(f" UNION ALL SELECT * FROM r{k}" for k in range(4, 16)) + ")")
INDEX = ", " + ", ".join(INDEX_STEPS) + f" SELECT tile_id, CAST(row_number() OVER (PARTITION BY tile_id ORDER BY dist, rep_id) AS INT) AS rank, rep_id, round(dist,6) AS dist FROM (SELECT a.tile_id, b.tile_id AS rep_id, {L2} AS dist FROM v_tile a, rp b) QUALIFY rank <= 3"
CONFIG = index.IndexConfig(buckets=16, k=3, seed=7)
add("i06_index_tables", INDEX, "tile")(lambda s, p: index.build_index(tiles(s, p), CONFIG)["topk"].select("tile_id", "rank", "rep_id", F.round("dist", 6).alias("dist")))


def stored(s, p):
    """The nearest representatives as a written index gives them back."""
    from scantling.sources.shared import new_path

    path = new_path(s, "index")
    index.write_index(index.build_index(tiles(s, p), CONFIG), path)
    return index.read_index(s, path)["topk"].select("tile_id", "rank", "rep_id", F.round("dist", 6).alias("dist"))


add("snk06_stored_index", INDEX, "tile")(stored)
add("i07_label_misses", " SELECT tile_id FROM v_tile WHERE tile_id % 10 = 0 AND NOT tile_id % 4 = 0", "tile")(lambda s, p: index.label_misses(tiles(s, p).where("tile_id % 10 = 0"), tiles(s, p).where("tile_id % 4 = 0")).select("tile_id"))
add("i04_triplet_loss", " SELECT a.tile_id, round(greatest(list_sum(list_transform(range(1,65), lambda i: pow(CAST(a.embedding[i] AS DOUBLE)-CAST(b.embedding[i] AS DOUBLE),2)-pow(CAST(a.embedding[i] AS DOUBLE)-CAST(c.embedding[i] AS DOUBLE),2)))+CAST(0.5 AS DOUBLE),0),4) AS loss FROM v_tile a JOIN v_tile b ON b.tile_id = a.tile_id + 1 JOIN v_tile c ON c.tile_id = a.tile_id + 2", "tile")(
    lambda s, p: (lambda t: t.join(t.select((F.col("tile_id") - 1).alias("tile_id"), F.col("embedding").alias("b")), "tile_id").join(t.select((F.col("tile_id") - 2).alias("tile_id"), F.col("embedding").alias("c")), "tile_id"))(tiles(s, p)).select(
        "tile_id", F.round(index.triplet_loss(F.col("embedding"), F.col("b"), F.col("c"), 0.5), 4).alias("loss")))
TRIPLETS = f""", s AS (SELECT tile_id AS id, truth AS b, t AS f FROM v_tile), nu AS (SELECT *, row_number() OVER (PARTITION BY b ORDER BY f, {HASH.format('id')}, id) - 1 AS place FROM s),
sz AS (SELECT b, count(*) AS size, row_number() OVER (ORDER BY b) - 1 AS bi, count(*) OVER () AS nb FROM s GROUP BY b),
an AS (SELECT s.*, size, bi, nb, (SELECT count(*) FROM s x WHERE x.b = s.b AND x.f < s.f - 30) AS low, (SELECT count(*) FROM s x WHERE x.b = s.b AND x.f <= s.f + 30) AS high FROM s JOIN sz USING (b)),
dr AS (SELECT *, CASE WHEN low + size - high > 0 THEN {HASH.format("'same/'||id")} % (low + size - high) END AS k, CASE WHEN nb > 1 THEN {HASH.format("'bucket/'||id")} % (nb - 1) END AS j FROM an),
pl AS (SELECT dr.id, dr.b, CASE WHEN k < low THEN k ELSE k - low + high END AS place, o.b AS ob, {HASH.format("'other/'||dr.id")} % o.size AS oplace FROM dr LEFT JOIN sz o ON o.bi = CASE WHEN j >= dr.bi THEN j + 1 ELSE j END)
SELECT pl.id AS anchor, p.id AS positive, n.id AS negative FROM pl LEFT JOIN nu p ON p.b = pl.b AND p.place = pl.place LEFT JOIN nu n ON n.b = pl.ob AND n.place = pl.oplace"""
add("sm08_triplets", TRIPLETS, "tile")(lambda s, p: index.triplets(tiles(s, p), "truth", "t"))

# bounded sums ----------------------------------------------------------------------------------------------------------------
EBS = f""", o AS (SELECT CAST(label AS DOUBLE) AS y, {{p}} AS p, row_number() OVER (ORDER BY {HASH.format('id')}, id) - 1 AS i FROM v_proxy),
g AS (SELECT count(*) AS n, avg(p) AS tau, var_pop(p) AS v, greatest(1, max(round_even(p, 0))) AS r FROM o),
c AS (SELECT i, sum(y) OVER x AS sy, sum(p) OVER x AS sp, sum(y*p) OVER x AS syp, sum(y*y) OVER x AS syy, sum(p*p) OVER x AS spp FROM o WINDOW x AS (ORDER BY i)),
e AS (SELECT k, CAST(floor(pow(1.5::DOUBLE,k)) AS BIGINT) AS hi, CAST(floor(pow(1.5::DOUBLE,k-1)) AS BIGINT) AS lo FROM (SELECT unnest(range(1,60)) AS k)),
b AS (SELECT e.k, e.lo, e.hi, e.hi*1.0::DOUBLE/e.lo AS alpha, CASE WHEN g.v > 0 THEN -((c.syp - c.sy*c.sp/least(greatest(e.lo+1,100),g.n))/(least(greatest(e.lo+1,100),g.n)-1))/g.v ELSE 0 END AS cv
  FROM e, g JOIN c ON true WHERE c.i = least(greatest(e.lo+1,100),g.n)-1 AND e.k >= 2),
t AS (SELECT c.i AS t, c.i+1 AS m, b.k, b.alpha, b.cv, c.*, g.n, g.tau, g.r FROM c JOIN b ON c.i <= b.hi AND (c.i > b.lo OR b.k = 2 AND c.i = 2) CROSS JOIN g WHERE c.i >= 2),
s AS (SELECT *, sy+cv*(sp-m*tau) AS s1, syy+2*cv*(syp-tau*sy)+cv*cv*(spp-2*tau*sp+m*tau*tau) AS s2, -alpha*ln(0.05*(0.1/1.1)/pow(ln(k)/ln(1.1),1.1))/3 AS x FROM t),
u AS (SELECT *, (s2-s1*s1/t)/t AS var FROM s),
h AS (SELECT *, abs(s1/t) AS mean, sqrt(CASE WHEN var>=0 THEN var END)*sqrt((n-t)*1.0::DOUBLE/(n-1))*sqrt(2*x/t)+3*r*x/t AS ct FROM u),
l AS (SELECT *, max(mean-ct) OVER (ORDER BY t) AS lb, min(mean+ct) OVER (ORDER BY t) AS ub FROM h)
SELECT round(sign(s1)*0.5*((1+{{e}})*lb+(1-{{e}})*ub)*n,6) AS estimate, t AS n_samples, false AS exact FROM l WHERE lb+{{e}} >= ub-{{e}} ORDER BY t LIMIT 1"""
add("a05_approximate_sum", EBS.format(p="proxy_score", e="CAST(0.1 AS DOUBLE)"), "proxy")(lambda s, p: sampling.approximate_sum(read(s, p, "proxy"), "id", "proxy_score", "label", 0.1, first=4000))
add("a06_plain_sum", EBS.format(p="CAST(0 AS DOUBLE)", e="CAST(0.12 AS DOUBLE)"), "proxy")(lambda s, p: sampling.approximate_sum(read(s, p, "proxy"), "id", "proxy_score", "label", 0.12, first=4000, use_proxy=False))
add("a05_tight_bound", EBS.format(p="proxy_score", e="CAST(0.000001 AS DOUBLE)"), "proxy")(lambda s, p: sampling.approximate_sum(read(s, p, "proxy"), "id", "proxy_score", "label", 1e-6, first=100))
add("a05_exact_fallback", " SELECT CAST(sum(truth) AS DOUBLE) AS estimate, count(*) AS n_samples, true AS exact FROM v_tile", "tile")(
    lambda s, p: sampling.approximate_sum(tiles(s, p).select("tile_id", F.lit(0.0).alias("proxy"), "truth"), "tile_id", "proxy", "truth", 0.01, first=100))


_M = [[f"sum({a}*{b})" for b in ("1.0::DOUBLE", "p", "p*p")] for a in ("1.0::DOUBLE", "p", "p*p")]
_V = [f"sum({a}*y)" for a in ("1.0::DOUBLE", "p", "p*p")]


def _determinant(m):
    return " + ".join(f"({m[0][i]})*(({m[1][(i + 1) % 3]})*({m[2][(i + 2) % 3]})-({m[1][(i + 2) % 3]})*({m[2][(i + 1) % 3]}))" for i in range(3))


def _solved(k):
    return f"({_determinant([[_V[r] if c == k else _M[r][c] for c in range(3)] for r in range(3)])})/({_determinant(_M)})"


@add("a07_control_variates", ", o AS (SELECT proxy_score AS p, CAST(label AS DOUBLE) AS y FROM v_proxy) " + " UNION ALL ".join(f"SELECT {k} AS term, round({_solved(k)}, 6) AS coefficient FROM o" for k in range(3)), "proxy")
def _(s, p):
    df = read(s, p, "proxy").withColumn("p2", F.col("proxy_score") * F.col("proxy_score"))
    return s.createDataFrame([(k, round(v, 6)) for k, v in enumerate(sampling.control_coefficients(df, ["proxy_score", "p2"], "label"))], "term int, coefficient double")


# selection -------------------------------------------------------------------------------------------------------------------
add("src25_ordered_ids", " SELECT id, row_number() OVER (ORDER BY proxy_score DESC, id) - 1 AS rank FROM v_proxy", "proxy")(lambda s, p: sampling.ranked(read(s, p, "proxy"), "proxy_score", "id").select("id", "rank"))
add("w04_prefix_sums", " SELECT id, row_number() OVER x - 1 AS rank, CAST(sum(label) OVER x AS DOUBLE) AS positives FROM v_proxy WINDOW x AS (ORDER BY proxy_score DESC, id)", "proxy")(
    lambda s, p: sampling.ranked(read(s, p, "proxy"), "proxy_score", "id", {"positives": F.col("label")}).select("id", "rank", "positives"))
add("w05_prefix_mean", " SELECT rank, round(sy/(rank+1),6) AS mean, round(sqrt(greatest(sy/(rank+1)-pow(sy/(rank+1),2),0)),6) AS std FROM (SELECT row_number() OVER x - 1 AS rank, sum(label) OVER x AS sy FROM v_proxy WINDOW x AS (ORDER BY proxy_score DESC, id)) WHERE (rank+1) % 100 = 0", "proxy")(
    lambda s, p: sampling.ranked(read(s, p, "proxy"), "proxy_score", "id", {"sy": F.col("label")}).where((F.col("rank") + 1) % 100 == 0).select(
        "rank", F.round(F.col("sy") / (F.col("rank") + 1), 6).alias("mean"), F.round(F.sqrt(F.greatest(F.col("sy") / (F.col("rank") + 1) - F.pow(F.col("sy") / (F.col("rank") + 1), 2), F.lit(0.0))), 6).alias("std")))
DRAW = f""", pr AS (SELECT id, label, proxy_score, 0.9::DOUBLE*sqrt(proxy_score)/(sum(sqrt(proxy_score)) OVER ())+0.1::DOUBLE/(count(*) OVER ()) AS prob, count(*) OVER () AS n FROM v_proxy),
cu AS (SELECT *, sum(prob) OVER (ORDER BY proxy_score DESC, id) AS upto FROM pr), dr AS (SELECT draw, {HASH.format("'draw'||draw")}/4294967296.0::DOUBLE AS u FROM (SELECT unnest(range(0,500)) AS draw))
SELECT draw, id, label, round(1/n/prob,6) AS mass FROM dr JOIN cu ON u < upto AND u >= upto - prob"""
add("sm02_importance_sample", DRAW, "proxy")(lambda s, p: sampling.importance_sample(read(s, p, "proxy"), "proxy_score", "id", 500).select("draw", "id", "label", F.round("mass", 6).alias("mass")))
REUSE = f"""{DRAW.replace('range(0,500)', 'range(0,1000)').rsplit('SELECT draw, id', 1)[0]}, hit AS (SELECT draw, id FROM dr JOIN cu ON u < upto AND u >= upto - prob)
SELECT draw, id FROM hit WHERE draw <= (SELECT max(first) FROM (SELECT min(draw) AS first FROM hit GROUP BY id ORDER BY first LIMIT 100))"""
add("sm03_reuse_sample", REUSE, "proxy")(lambda s, p: sampling.reuse_sample(read(s, p, "proxy"), "proxy_score", "id", 100).select("draw", "id"))
add("src26_label_lookup", " SELECT id, CAST(label AS DOUBLE) AS label FROM v_proxy WHERE id % 97 = 5", "proxy")(lambda s, p: read(s, p, "proxy").join(read(s, p, "proxy").where("id % 97 = 5").select("id"), "id", "left_semi").select("id", F.col("label").cast("double").alias("label")))
add("src27_sorted_proxy", " SELECT id, proxy_score FROM v_proxy ORDER BY proxy_score DESC, id LIMIT 500", "proxy")(lambda s, p: read(s, p, "proxy").orderBy(F.desc("proxy_score"), "id").limit(500).select("id", "proxy_score"))
add("src28_positive_filter", " SELECT id FROM v_proxy JOIN (SELECT unnest([1,2,2,3,5,8,8,13,21,34,55,89]) AS id) USING (id) WHERE label = 1", "proxy")(
    lambda s, p: s.createDataFrame([(i,) for i in (1, 2, 2, 3, 5, 8, 8, 13, 21, 34, 55, 89)], "id long").join(read(s, p, "proxy").where("label = 1"), "id", "left_semi"))
add("src24_drop_positives", f" SELECT row_number() OVER (ORDER BY id) - 1 AS new_id, id FROM v_proxy WHERE NOT (label = 1 AND {HASH.format('id')} < {2**31})", "proxy")(
    lambda s, p: tracks.dense_numbers(read(s, p, "proxy").where(~((F.col("label") == 1) & (d.hash_order(F.col("id")) < 2**31))).select("id"), "id").select(F.col("ind").alias("new_id"), "id"))
add("src20_proxy_source", " SELECT id, proxy_score, CAST(label AS DOUBLE) AS label FROM v_proxy", "proxy")(lambda s, p: read(s, p, "proxy").select("id", "proxy_score", F.col("label").cast("double").alias("label")))
TARGET = selection.Target(precision=0.8, recall=0.9, delta=0.05, budget=1000)
SELECTOR_NAMES = {
    "recall_sqrt": "as02_recall_sqrt", "recall_prop": "as02_recall_prop", "recall_uniform": "as02_recall_uniform", "recall_naive": "as03_recall_naive",
    "precision_uniform": "as04_precision_uniform", "precision_one_stage": "as05_precision_one_stage", "precision_two_stage": "as06_precision_two_stage", "precision_naive": "as07_precision_naive",
}
for selector, name in SELECTOR_NAMES.items():
    add(name, f" SELECT * FROM ({sqls.quality(sqls.chosen(selector, TARGET))})", "proxy")(lambda s, p, selector=selector: selection.quality_of(read(s, p, "proxy"), selection.SELECTORS[selector](read(s, p, "proxy"), TARGET, 7)))
add("as08_joint_selector", f" SELECT * FROM ({sqls.quality(f'SELECT id FROM ({sqls.chosen("recall_sqrt", TARGET)}) JOIN v_proxy USING (id) WHERE label > 0')})", "proxy")(
    lambda s, p: selection.quality_of(read(s, p, "proxy"), selection.select_both(read(s, p, "proxy"), TARGET)[0]))
add("a09_selection_quality", " SELECT round(count(*) FILTER (WHERE s AND label=1)*1.0::DOUBLE/count(*) FILTER (WHERE s),6) AS \"precision\", round(count(*) FILTER (WHERE s AND label=1)*1.0::DOUBLE/sum(label),6) AS recall, count(*) FILTER (WHERE s) AS size, CAST(sum(label) AS BIGINT) AS n_true FROM (SELECT label, proxy_score > CAST(0.7 AS DOUBLE) AS s FROM v_proxy)", "proxy")(
    lambda s, p: selection.quality_of(read(s, p, "proxy"), read(s, p, "proxy").where("proxy_score > CAST(0.7 AS DOUBLE)").select("id")))
SMALL = selection.Target(budget=300)
add("a10_trial_summary", f" SELECT count(*) AS n_trials, round(avg(\"precision\"),6) AS \"precision\", round(avg(recall),6) AS recall, round(stddev_samp(recall)/sqrt(count(*)),6) AS recall_sem, round(avg(CAST(covered AS INT)),6) AS coverage FROM ({sqls.trials('recall_sqrt', SMALL, 3)})", "proxy")(
    lambda s, p: selection.summarise(selection.run_trials(read(s, p, "proxy"), "recall_sqrt", SMALL, 3)))
add("as11_trials", f" {sqls.trials('precision_naive', SMALL, 3)}", "proxy")(lambda s, p: selection.run_trials(read(s, p, "proxy"), "precision_naive", SMALL, 3))


def frame_proxy(s, p):
    best = index.best_in_frame(scored(s, p), "t", F.col("proxy"))
    return best.join(tiles(s, p).select("tile_id", "truth"), "tile_id").select(F.col("t").alias("id"), (F.col("score") / 9).alias("proxy_score"), F.when(F.col("truth") > 5, 1).otherwise(0).alias("label"))


FRAMES, BY_FRAME = selection.Target(precision=0.95, budget=200), selection.Target(recall=0.9, budget=100)
FRAME_PROXY = f"""{SCORE}, v_frame AS (SELECT t AS id, score/9 AS proxy_score, CASE WHEN truth > 5 THEN 1 ELSE 0 END AS label FROM (SELECT *, row_number() OVER (PARTITION BY t ORDER BY score DESC, tile_id) AS rn FROM pred JOIN v_tile USING (tile_id) WHERE score > -1) WHERE rn = 1)"""
add("as09_frame_precision", f"{FRAME_PROXY} SELECT * FROM ({sqls.quality(sqls.chosen('precision_two_stage', FRAMES, view='v_frame', stride=25), 'v_frame')})", "tile")(
    lambda s, p: selection.quality_of(frame_proxy(s, p), selection.select_precision(frame_proxy(s, p), FRAMES, stride=25)))
add("as10_frame_recall", f"{FRAME_PROXY} SELECT * FROM ({sqls.quality(sqls.chosen('recall_sqrt', BY_FRAME, view='v_frame'), 'v_frame')})", "tile")(
    lambda s, p: selection.quality_of(frame_proxy(s, p), selection.select_recall(frame_proxy(s, p), BY_FRAME)))

# limits and tracks -----------------------------------------------------------------------------------------------------------
add("l01_limit_sequential", f"""{SCORE}, f AS (SELECT t, sum(score) AS fs FROM pred JOIN v_tile USING (tile_id) WHERE score > 0 GROUP BY t),
run AS (SELECT j.t, fs, row_number() OVER (PARTITION BY j.t ORDER BY score DESC, tile_id) AS rn, sum(truth) OVER (PARTITION BY j.t ORDER BY score DESC, tile_id) AS upto FROM (SELECT * FROM pred JOIN v_tile USING (tile_id)) j JOIN f ON f.t = j.t WHERE score > 0),
fr AS (SELECT t, any_value(fs) AS fs, min(rn) FILTER (WHERE upto >= 12) AS need, max(rn) AS have FROM run GROUP BY t),
se AS (SELECT *, sum(coalesce(need, have)) OVER (ORDER BY fs DESC, t) AS calls FROM fr)
SELECT t, CAST(row_number() OVER (ORDER BY fs DESC, t) AS INT) AS n_found, CAST(calls AS BIGINT) AS n_calls FROM se WHERE need IS NOT NULL ORDER BY fs DESC, t LIMIT 10""", "tile")(
    lambda s, p: limits.limit_query(scored(s, p), 12, 10, 0))
add("l02_limit_batched")(lambda s, p: limits.batched_query(scored(s, p), 12, 10, 3, 8))
add("l03_limit_whole_frames")(lambda s, p: limits.batched_query(scored(s, p), 12, 10, 0, 32))
SPACED = f"""{SCORE}, f AS (SELECT t, sum(score) AS fs FROM pred JOIN v_tile USING (tile_id) WHERE score > 0 GROUP BY t),
run AS (SELECT j.t, fs, row_number() OVER (PARTITION BY j.t ORDER BY score DESC, tile_id) AS rn, sum(truth) OVER (PARTITION BY j.t ORDER BY score DESC, tile_id) AS upto FROM (SELECT * FROM pred JOIN v_tile USING (tile_id)) j JOIN f ON f.t = j.t WHERE score > 0),
fr AS MATERIALIZED (SELECT t, need, have, row_number() OVER (ORDER BY fs DESC, t) AS i FROM (SELECT t, any_value(fs) AS fs, min(rn) FILTER (WHERE upto >= 12) AS need, max(rn) AS have FROM run GROUP BY t)),
go AS (SELECT 0::BIGINT AS i, 0::BIGINT AS calls, []::BIGINT[] AS kept, NULL::BIGINT AS got UNION ALL
 SELECT fr.i, CASE WHEN ok THEN calls + coalesce(need, have) ELSE calls END, CASE WHEN ok AND need IS NOT NULL THEN list_append(kept, fr.t) ELSE kept END, CASE WHEN ok AND need IS NOT NULL THEN fr.t END
 FROM (SELECT go.*, fr.i AS fi, len(list_filter(kept, lambda k: abs(k - fr.t) <= 5)) = 0 AS ok FROM go JOIN fr ON fr.i = go.i + 1) go JOIN fr ON fr.i = go.fi WHERE len(kept) < 10)
SELECT got AS t, CAST(len(kept) AS INT) AS n_found, CAST(calls AS BIGINT) AS n_calls FROM go WHERE got IS NOT NULL"""
QUERIES.add("l01_limit_spaced", w("tile").replace("WITH", "WITH RECURSIVE", 1) + SPACED)(lambda s, p: limits.limit_query(scored(s, p), 12, 10, 5))
add("l04_frame_limit", " SELECT t, CAST(row_number() OVER (ORDER BY rank) AS INT) AS n_found, rank AS n_calls FROM (SELECT id AS t, label, row_number() OVER (ORDER BY proxy_score DESC, id) AS rank FROM v_proxy) WHERE label = 1 ORDER BY rank LIMIT 20", "proxy")(
    lambda s, p: limits.frame_limit(read(s, p, "proxy").select(F.col("id").alias("t"), "proxy_score", (F.col("label") == 1).alias("ok")), [("proxy_score", True), ("t", False)], "ok", 20, 0))
add("l05_baseline_order", " SELECT id AS t, CAST(row_number() OVER (ORDER BY id) AS INT) AS n_found, id + 1 AS n_calls FROM v_proxy WHERE label = 1 ORDER BY id LIMIT 20", "proxy")(
    lambda s, p: limits.frame_limit(read(s, p, "proxy").select(F.col("id").alias("t"), (F.col("label") == 1).alias("ok")), [("t", False)], "ok", 20, 0))
SPACING = """, o AS (SELECT id // 500 AS g, id, proxy_score, row_number() OVER (PARTITION BY id // 500 ORDER BY proxy_score DESC, id) AS i FROM v_proxy),
go AS (SELECT g, 0::BIGINT AS i, []::BIGINT[] AS kept FROM o WHERE i = 1 UNION ALL SELECT go.g, o.i, CASE WHEN len(list_filter(go.kept, lambda k: abs(k - o.id) <= 20)) = 0 THEN list_append(go.kept, o.id) ELSE go.kept END FROM go JOIN o ON o.g = go.g AND o.i = go.i + 1),
last AS (SELECT g, arg_max(kept, i) AS kept FROM go GROUP BY g) SELECT g, id, proxy_score FROM (SELECT unnest(kept) AS id FROM last) JOIN o USING (id)"""
QUERIES.add("w11_spacing", w("proxy").replace("WITH", "WITH RECURSIVE", 1) + SPACING)(lambda s, p: limits.spacing(read(s, p, "proxy").withColumn("g", F.floor(F.col("id") / 500)), "g", "id", "proxy_score", 20))
add("tq1_track_query", f"{SCORE} SELECT count(*) AS tiles, count(*) FILTER (WHERE truth <= 0) AS false_positive FROM v_workload JOIN (SELECT t, truth FROM pred JOIN v_tile USING (tile_id) WHERE score > 0 AND tile_id % 10 <> 0) USING (t)", "tile", "workload")(
    lambda s, p: limits.track_query(read(s, p, "workload"), scored(s, p), tiles(s, p).where("tile_id % 10 = 0")))
add("tq3_subframe_query", " SELECT CAST(sum(seg_end-seg_start) AS BIGINT) AS tiles, CAST(sum(64*64*(seg_end-seg_start)) AS BIGINT) AS area FROM v_grid WHERE cluster IN (1, 3)", "grid")(
    lambda s, p: limits.subframe_query(read(s, p, "grid"), F.col("cluster").isin(1, 3), F.lit(64), F.lit(64), F.col("seg_end") - F.col("seg_start")))
QUERIES["p12_info_filter"] = (lambda s, p: read(s, p, "grid").where(F.arrays_overlap(F.array("cluster"), F.array(F.lit(1), F.lit(3)))).select("seg_start", "row_no", "col_no", "cluster"), f"{w('grid')} SELECT seg_start, row_no, col_no, cluster FROM v_grid WHERE cluster IN (1, 3)")

OVERLAP = "greatest(0, least(a.xmax,b.xmax)-greatest(a.xmin,b.xmin)) * greatest(0, least(a.ymax,b.ymax)-greatest(a.ymin,b.ymin))"
GR1 = f""", d AS (SELECT *, (frame*10+line)*1048576 + row_number() OVER (PARTITION BY frame, line ORDER BY object_name, confidence, xmin, ymin, xmax, ymax) - 1 AS id FROM v_track),
ed AS (SELECT a.id AS u, b.id AS v FROM d a JOIN d b ON a.object_name = b.object_name AND b.frame > a.frame AND b.frame <= a.frame + 3 AND {OVERLAP} > CAST(0.7 AS DOUBLE) * ((a.xmax-a.xmin)*(a.ymax-a.ymin)+(b.xmax-b.xmin)*(b.ymax-b.ymin)-{OVERLAP})),
both_ AS (SELECT u, v FROM ed UNION SELECT v, u FROM ed), reach AS (SELECT id, id AS r FROM d UNION SELECT b.v, reach.r FROM reach JOIN both_ b ON b.u = reach.id AND reach.r < b.v),
comp AS (SELECT id, min(r) AS track FROM reach GROUP BY id), best AS (SELECT track, max(confidence) AS c FROM comp JOIN d USING (id) GROUP BY track)
SELECT id AS row_id, CAST(dense_rank() OVER (ORDER BY track) - 1 AS BIGINT) AS ind FROM comp JOIN best USING (track) WHERE c > CAST(0.1 AS DOUBLE)"""


def numbered(s, p, view="track"):
    """Every detection with a number in order of frame and line; those that repeat both go by their other columns."""
    rows = read(s, p, view)
    again = F.row_number().over(Window.partitionBy("frame", "line").orderBy(*[c for c in rows.columns if c not in ("frame", "line")]))
    return rows.withColumn("row_id", (F.col("frame") * 10 + F.col("line")) * 2**20 + again - 1)


QUERIES.add("gr1_build_tracks", w("track").replace("WITH", "WITH RECURSIVE", 1) + GR1)(lambda s, p: tracks.build_tracks(numbered(s, p), "row_id"))
add("gr2_region_tracks", " SELECT frame, line, ind0, CAST(dense_rank() OVER (ORDER BY first) - 1 AS BIGINT) AS ind FROM (SELECT *, min(frame*10+line) OVER (PARTITION BY ind0) AS first FROM (SELECT frame, line, CAST(xmin AS BIGINT)*31+CAST(ymin AS BIGINT) AS ind0 FROM v_track WHERE confidence > CAST(0.5 AS DOUBLE)))", "track")(
    lambda s, p: tracks.filter_tracks(read(s, p, "track").withColumn("ind0", F.col("xmin").cast("long") * 31 + F.col("ymin").cast("long")).withColumn("o", F.col("frame") * 10 + F.col("line")), "ind0", "o", F.col("confidence") > 0.5).select("frame", "line", "ind0", "ind"))
IOU = "greatest(0, least(k.xmax,o.xmax)-greatest(k.xmin,o.xmin)) * greatest(0, least(k.ymax,o.ymax)-greatest(k.ymin,o.ymin))"
NMS = f""", d AS (SELECT *, (frame*10+line)*1048576 + row_number() OVER (PARTITION BY frame, line ORDER BY object_name, confidence, xmin, ymin, xmax, ymax) - 1 AS row_id FROM v_det),
o AS MATERIALIZED (SELECT *, row_number() OVER (PARTITION BY frame, object_name ORDER BY confidence DESC, row_id) AS i FROM d WHERE confidence > CAST(0.25 AS DOUBLE)),
go AS (SELECT frame, object_name, i, [{{'row_id': row_id, 'xmin': xmin, 'ymin': ymin, 'xmax': xmax, 'ymax': ymax}}] AS kept FROM o WHERE i = 1
 UNION ALL SELECT o.frame, o.object_name, o.i, CASE WHEN len(list_filter(go.kept, lambda k: {IOU} / greatest((k.xmax-k.xmin)*(k.ymax-k.ymin) + (o.xmax-o.xmin)*(o.ymax-o.ymin) - {IOU}, 1e-12) > CAST(0.45 AS DOUBLE))) = 0
  THEN list_append(go.kept, {{'row_id': o.row_id, 'xmin': o.xmin, 'ymin': o.ymin, 'xmax': o.xmax, 'ymax': o.ymax}}) ELSE go.kept END FROM go JOIN o ON o.frame = go.frame AND o.object_name = go.object_name AND o.i = go.i + 1),
fin AS (SELECT frame, object_name, arg_max(kept, i) AS kept FROM go GROUP BY ALL)
SELECT frame, object_name, row_id, confidence FROM (SELECT unnest(list_transform(kept, lambda k: k.row_id)) AS row_id FROM fin) JOIN o USING (row_id) QUALIFY row_number() OVER (PARTITION BY frame ORDER BY confidence DESC, row_id) <= 300"""
QUERIES.add("a20_non_max_suppression", w("det").replace("WITH", "WITH RECURSIVE", 1) + NMS)(lambda s, p: tracks.non_max_suppression(numbered(s, p, "det"), ["frame"], "row_id"))
TRI = [(0.0, 0.0), (1500.0, 0.0), (0.0, 900.0)]
UNDER = "(pow(greatest(0, 900-0.6::DOUBLE*xmin-{0}),2) - pow(greatest(0, 900-0.6::DOUBLE*xmax-{0}),2)) / 1.2::DOUBLE"
BOX = "greatest(0, least(xmax,1200)-greatest(xmin,400)) * greatest(0, least(ymax,800)-greatest(ymin,300))"
#: Shares in steps of 1 / 100,000. They are often finite decimals, so steps end where none is and both engines agree on them.
STEP = "floor(({}) * 100000 + 0.4142135::DOUBLE) / 100000"
SHARES = [f"({UNDER.format('ymin')} - {UNDER.format('ymax')}) / ((xmax-xmin)*(ymax-ymin))", f"{BOX} / ((xmax-xmin)*(ymax-ymin))"]
add("g37_polygon_clip", f" SELECT frame, line, xmin, ymin, {STEP.format(SHARES[0])} AS share_0, {STEP.format(SHARES[1])} AS share_1 FROM v_det", "det")(
    lambda s, p: tracks.polygon_shares(read(s, p, "det"), ["frame", "line", "xmin", "ymin"], [TRI, [(400.0, 300.0), (1200.0, 300.0), (1200.0, 800.0), (400.0, 800.0)]])
    .withColumns({n: F.floor(F.col(n) * 100000 + 0.4142135) / 100000 for n in ("share_0", "share_1")}))

# tiling and the catalog -------------------------------------------------------------------------------------------------------
add("t02_merge_regions")(lambda s, p: tiling.merge_regions(read(s, p, "roi"), ["seg", "t"]))
add("t02_merge_regions_near")(lambda s, p: tiling.merge_regions(read(s, p, "roi"), ["seg", "t"], tiling.near_centres(2.0)))
add("t03_layouts")(lambda s, p: tiling.generate_layouts(read(s, p, "roi"), "seg", 2000, 1000))
add("t04_layouts_least_strip")(lambda s, p: tiling.generate_layouts(read(s, p, "roi"), "seg", 2000, 1000, least=64))
add("t05_semantic_clusters")(lambda s, p: similar_tiles(s, p))
add("t07_merged_groups", " , ln AS (SELECT DISTINCT seg_start, col_no, CASE WHEN col_no = 2 THEN 1 ELSE 0 END AS k FROM v_grid), gg AS (SELECT seg_start, col_no, sum(k) OVER (PARTITION BY seg_start ORDER BY col_no) AS g FROM ln) SELECT seg_start, row_no, CAST(g AS BIGINT) AS g, count(DISTINCT col_no) AS cells, count(DISTINCT cluster) AS clusters, round(count(DISTINCT col_no)*4096*CAST(0.001 AS DOUBLE)*count(DISTINCT cluster),6) AS cost FROM v_grid JOIN gg USING (seg_start, col_no) GROUP BY ALL", "grid")(
    lambda s, p: tiling.merged_groups(read(s, p, "grid"), "seg_start", F.col("col_no") == 2, F.col("cells") * 4096 * F.lit(0.001)))
add("t08_greedy_tiling")(lambda s, p: tiling.optimise_segments(read(s, p, "grid"), "seg_start", 1.4443e-05, 3.0, "greedy"))
TILINGS = """, ce AS (SELECT DISTINCT seg_start, row_no, col_no, cluster FROM v_grid), dm AS (SELECT seg_start, max(row_no) + 1 AS nr, max(col_no) + 1 AS nc FROM ce GROUP BY ALL),
rs AS (SELECT * FROM (VALUES ('', [0]), ('1', [0, 1])) AS t(rows_kept, rl)), cs AS (SELECT * FROM (VALUES ('', [0]), ('1', [0, 1]), ('1,2', [0, 1, 2]), ('2', [0, 2])) AS t(cols_kept, cl)),
op AS (SELECT * FROM dm, rs, cs WHERE list_max(rl) < nr AND list_max(cl) < nc),
gr AS (SELECT op.seg_start, rows_kept, cols_kept, list_max(list_filter(rl, lambda x: x <= row_no)) AS r1, list_max(list_filter(cl, lambda x: x <= col_no)) AS c1, any_value(rl) AS rl, any_value(cl) AS cl, any_value(nr) AS nr, any_value(nc) AS nc, count(DISTINCT cluster) AS k FROM op JOIN ce USING (seg_start) GROUP BY ALL),
co AS (SELECT seg_start, rows_kept, cols_kept, round(sum((1.4443e-05::DOUBLE * ((coalesce(list_min(list_filter(cl, lambda x: x > c1)), nc) - c1) * 64 * (coalesce(list_min(list_filter(rl, lambda x: x > r1)), nr) - r1) * 64) + 3.0::DOUBLE) * k), 9) AS cost, any_value(nr) AS nr, any_value(nc) AS nc FROM gr GROUP BY ALL)
SELECT seg_start, round(max(CASE WHEN len(string_split(rows_kept, ',')) - CAST(rows_kept = '' AS INT) = nr - 1 AND len(string_split(cols_kept, ',')) - CAST(cols_kept = '' AS INT) = nc - 1 THEN cost END), 6) AS before, round(min(cost), 6) AS after, arg_min(rows_kept, (cost, rows_kept, cols_kept)) AS rows_kept, arg_min(cols_kept, (cost, rows_kept, cols_kept)) AS cols_kept FROM co GROUP BY seg_start"""
add("t09_best_tiling", TILINGS, "grid")(lambda s, p: tiling.optimise_segments(read(s, p, "grid"), "seg_start", 1.4443e-05, 3.0, "best"))
add("t09_best_tiling_brute", TILINGS, "grid")(lambda s, p: tiling.optimise_segments(read(s, p, "grid"), "seg_start", 1.4443e-05, 3.0, "brute"))
add("t12_merge_all", " SELECT seg_start, min(row_no) AS r1, max(row_no) AS r2, min(col_no) AS c1, max(col_no) AS c2 FROM v_grid WHERE has_roi GROUP BY seg_start", "grid")(
    lambda s, p: read(s, p, "grid").where("has_roi").groupBy("seg_start").agg(F.min("row_no").alias("r1"), F.max("row_no").alias("r2"), F.min("col_no").alias("c1"), F.max("col_no").alias("c2")))
LARGE = costs.NETWORKS["large"]
SPLITS = f"""WITH sz AS (SELECT * FROM (VALUES (1920, 1080), (800, 600), (3840, 2160)) AS t(width, height)), op AS (SELECT width, height, i, j, width * height / (i * j) AS a FROM sz, (SELECT unnest(range(1, 5)) AS i), (SELECT unnest(range(1, 5)) AS j)),
co AS (SELECT *, i * j * CASE WHEN a > ({LARGE['a']!r}::DOUBLE - {LARGE['b']!r}::DOUBLE) / {LARGE['k']!r}::DOUBLE THEN {LARGE['k']!r}::DOUBLE * a + {LARGE['b']!r}::DOUBLE ELSE {LARGE['a']!r}::DOUBLE END AS cost FROM op),
be AS (SELECT width, height, CASE WHEN width * height < 1000000 THEN 1 ELSE CAST(arg_min(i, (cost, i, j)) AS INT) END AS r, CASE WHEN width * height < 1000000 THEN 1 ELSE CAST(arg_min(j, (cost, i, j)) AS INT) END AS c FROM co GROUP BY width, height)
SELECT width, height, CAST(y * c + x AS INT) AS part, CAST(round(width * (x + 1) / c) - round(width * x / c) AS INT) AS w, CAST(round(height * (y + 1) / r) - round(height * y / r) AS INT) AS h FROM (SELECT *, unnest(range(0, r)) AS y FROM be) b, range(0, 4) AS g(x) WHERE x < c"""
QUERIES.add("t13_adaptive_split", SPLITS)(lambda s, p: s.createDataFrame([(w_, h_, i, a, b) for w_, h_ in ((1920, 1080), (800, 600), (3840, 2160)) for i, (a, b) in enumerate(tiling.split_for_network(w_, h_, 4, **{k if k != "a" else "floor": v for k, v in costs.NETWORKS["large"].items()}))], "width int, height int, part int, w int, h int"))
GRIDS = "cat AS (SELECT DISTINCT seg_start, seg_end, row_no, col_no, bool_or(has_roi) OVER (PARTITION BY seg_start, row_no, col_no) AS has_roi FROM v_grid)"


def catalog(s, p):
    return read(s, p, "grid").groupBy("seg_start", "seg_end", "row_no", "col_no").agg(F.bool_or("has_roi").alias("has_roi"))


add("meta01_totals", f", {GRIDS} SELECT CAST(sum(d) AS BIGINT) AS total_frames, CAST(sum(d*n) AS BIGINT) AS total_tiles, CAST(sum(d*r) AS BIGINT) AS tiles_with_roi FROM (SELECT any_value(seg_end-seg_start) AS d, count(*) AS n, count(*) FILTER (WHERE has_roi) AS r FROM cat GROUP BY seg_start)", "grid")(lambda s, p: tiling.catalog_totals(catalog(s, p)))
add("meta03_segments", " SELECT DISTINCT seg_start, seg_end FROM v_grid", "grid")(lambda s, p: catalog(s, p).select("seg_start", "seg_end").distinct())
add("meta04_grid_shapes", " SELECT seg_start, seg_end, max(row_no)+1 AS rows, max(col_no)+1 AS cols, any_value(seg_end-seg_start) AS duration FROM v_grid GROUP BY ALL", "grid")(lambda s, p: tiling.grid_shapes(catalog(s, p)))
add("meta05_roi_positions", f", {GRIDS} SELECT seg_start, row_no, col_no FROM cat WHERE has_roi", "grid")(lambda s, p: catalog(s, p).where("has_roi").select("seg_start", "row_no", "col_no"))
add("meta06_tile_lookup", f", {GRIDS} SELECT row_no, col_no, has_roi FROM cat WHERE seg_start = 300", "grid")(lambda s, p: catalog(s, p).where("seg_start = 300").select("row_no", "col_no", "has_roi"))
add("meta08_segment_of_frame", " SELECT id, CAST(floor(id/30) AS BIGINT)*30 AS seg_start FROM v_proxy", "proxy")(lambda s, p: connectors.segment_of(read(s, p, "proxy").select("id"), "id", 30))
add("meta07_fill_grid", ", k AS (SELECT DISTINCT t, x1, y1, x2, y2 FROM v_roi), cx AS (SELECT DISTINCT t, x FROM (SELECT t, x1 AS x FROM k UNION ALL SELECT t, x2 FROM k)), cy AS (SELECT DISTINCT t, y FROM (SELECT t, y1 AS y FROM k UNION ALL SELECT t, y2 FROM k)), bx AS (SELECT t, row_number() OVER w - 1 AS col_no, x AS x1, lead(x) OVER w AS x2 FROM cx WINDOW w AS (PARTITION BY t ORDER BY x)), by_ AS (SELECT t, row_number() OVER w - 1 AS row_no, y AS y1, lead(y) OVER w AS y2 FROM cy WINDOW w AS (PARTITION BY t ORDER BY y)) SELECT bx.t, CAST(row_no AS INT) AS row_no, CAST(col_no AS INT) AS col_no, bx.x1, by_.y1, bx.x2, by_.y2, k.t IS NOT NULL AS known FROM bx JOIN by_ ON bx.t = by_.t LEFT JOIN k ON k.t = bx.t AND k.x1 = bx.x1 AND k.x2 = bx.x2 AND k.y1 = by_.y1 AND k.y2 = by_.y2 WHERE bx.x2 IS NOT NULL AND by_.y2 IS NOT NULL", "roi")(
    lambda s, p: tiling.fill_grid(read(s, p, "roi"), "t"))
add("meta09_keys", " SELECT DISTINCT row_no || '_' || col_no AS key, seg_start || '_' || seg_end AS seg FROM v_grid", "grid")(lambda s, p: read(s, p, "grid").select(F.concat_ws("_", "row_no", "col_no").alias("key"), F.concat_ws("_", "seg_start", "seg_end").alias("seg")).distinct())
add("a28_subframe_area", " SELECT seg_start, CAST(sum(4096) AS BIGINT) AS area, count(*) AS n FROM v_grid WHERE has_roi GROUP BY seg_start", "grid")(lambda s, p: read(s, p, "grid").where("has_roi").groupBy("seg_start").agg(F.sum(F.lit(4096)).alias("area"), F.count("*").alias("n")))
add("a29_tile_cost", " SELECT seg_start, round(sum(c*CAST(4096*0.001+3 AS DOUBLE)),6) AS cost FROM (SELECT seg_start, row_no, col_no, count(DISTINCT cluster) AS c FROM v_grid GROUP BY ALL) GROUP BY seg_start", "grid")(
    lambda s, p: read(s, p, "grid").groupBy("seg_start", "row_no", "col_no").agg(F.count_distinct("cluster").alias("c")).groupBy("seg_start").agg(F.round(F.sum(F.col("c") * (4096 * 0.001 + 3)), 6).alias("cost")))
add("a31_densest_frame", ", z AS (SELECT CAST(floor((y1+y2)/2/200) AS BIGINT) AS row_no, CAST(floor((x1+x2)/2/300) AS BIGINT) AS col_no, t, sum((x2-x1)*(y2-y1)) AS area FROM v_roi GROUP BY ALL) SELECT row_no, col_no, t, area FROM (SELECT *, row_number() OVER (PARTITION BY row_no, col_no ORDER BY area DESC, t) AS rn FROM z) WHERE rn = 1", "roi")(
    lambda s, p: tiling.densest_frame(read(s, p, "roi"), 300, 200))
add("a30_visible_cost", ", sp AS (SELECT * FROM (VALUES (0, 600), (3000, 3010)) AS t(since, until)), kp AS (SELECT * FROM v_grid WHERE EXISTS (SELECT 1 FROM sp WHERE seg_start < until AND seg_end > since)), gr AS (SELECT seg_start, row_no, CAST(floor(col_no/2) AS BIGINT) AS g, count(DISTINCT col_no) AS cells, count(DISTINCT cluster) AS clusters FROM kp GROUP BY ALL) SELECT seg_start, round(sum((cells*4096*CAST(0.001 AS DOUBLE)+3)*clusters),6) AS cost FROM gr GROUP BY seg_start", "grid")(
    lambda s, p: tiling.visible_cost(read(s, p, "grid"), "seg_start", 2, F.col("cells") * 4096 * F.lit(0.001) + 3, spans=s.createDataFrame([(0, 600), (3000, 3010)], "since long, until long")))
MERGES = """WITH ca AS (SELECT CAST(n AS INT) AS n, CAST(mask AS INT) AS mask FROM (SELECT unnest([2, 3, 4, 5]) AS n), range(0, 32) AS m(mask) WHERE mask < (1 << n)),
go AS (SELECT n, mask, g * 2 AS gone FROM ca, range(0, 16) AS k(g) WHERE g < (1 << (n - 1))),
ok AS (SELECT n, mask, gone, len(list_filter(range(0, n), lambda i: (mask >> CAST(i AS INT)) & 1 = 0 AND NOT ((gone >> CAST(i AS INT)) & 1 = (gone >> CAST(i + 1 AS INT)) & 1 AND NOT ((gone >> CAST(i AS INT)) & 1 = 1 AND (i = 0 OR i = n - 1))))) = 0 AS fine FROM go)
SELECT n, mask, CAST(count(*) FILTER (WHERE fine) AS INT) AS merges FROM ok GROUP BY n, mask"""
QUERIES.add("t10_valid_merges", MERGES)(lambda s, p: s.createDataFrame([(n, mask, len(tiling.valid_merges(n, [bool(mask >> i & 1) for i in range(n)]))) for n in (2, 3, 4, 5) for mask in range(2**n)], "n int, mask int, merges int"))
add("t11_hierarchical_layout", f", {GRIDS}, rw AS (SELECT seg_start, row_no, bool_or(has_roi) AS a FROM cat GROUP BY ALL), cl AS (SELECT seg_start, col_no, bool_or(has_roi) AS a FROM cat GROUP BY ALL), rn AS (SELECT seg_start, row_no, sum(n) OVER (PARTITION BY seg_start ORDER BY row_no) - 1 AS coarse_row FROM (SELECT *, CASE WHEN NOT a AND NOT coalesce(lag(a) OVER (PARTITION BY seg_start ORDER BY row_no), true) THEN 0 ELSE 1 END AS n FROM rw)), cn AS (SELECT seg_start, col_no, sum(n) OVER (PARTITION BY seg_start ORDER BY col_no) - 1 AS coarse_col FROM (SELECT *, CASE WHEN NOT a AND NOT coalesce(lag(a) OVER (PARTITION BY seg_start ORDER BY col_no), true) THEN 0 ELSE 1 END AS n FROM cl)) SELECT cat.seg_start, CAST(coarse_row AS BIGINT) AS coarse_row, CAST(coarse_col AS BIGINT) AS coarse_col, bool_or(has_roi) AS has_roi, coalesce(string_agg(row_no||'_'||col_no, ',' ORDER BY row_no||'_'||col_no) FILTER (WHERE has_roi), '') AS fine FROM cat JOIN rn USING (seg_start, row_no) JOIN cn USING (seg_start, col_no) GROUP BY cat.seg_start, coarse_row, coarse_col", "grid")(
    lambda s, p: tiling.hierarchical_layout(catalog(s, p).drop("seg_end"), "seg_start").withColumn("fine", F.array_join("fine", ",")))
add("t14_roi_pipeline")(lambda s, p: tiling.roi_pipeline(read(s, p, "roi"), "seg", 2000, 1000, F.col("x2") - F.col("x1") >= 20, least=64))
add("t06_semantic_tiling")(lambda s, p: tiling.optimise_segments(clustered_cells(s, p), "seg_start", 1.4443e-05, 3.0, "best"))
add("snk03_coalesced_segments", f", {GRIDS}, sh AS (SELECT seg_start, seg_end, string_agg(DISTINCT row_no||'_'||col_no||'_'||has_roi, ',' ORDER BY row_no||'_'||col_no||'_'||has_roi) AS layout FROM cat GROUP BY ALL), nw AS (SELECT *, CASE WHEN lag(layout) OVER o = layout AND lag(seg_end) OVER o = seg_start THEN 0 ELSE 1 END AS new FROM sh WINDOW o AS (ORDER BY seg_start)), mk AS (SELECT *, sum(new) OVER (ORDER BY seg_start) AS part FROM nw) SELECT min(seg_start) AS seg_start, max(seg_end) AS seg_end, count(*) AS n FROM mk GROUP BY part", "grid")(lambda s, p: tiling.coalesced_segments(catalog(s, p)))
add("snk04_bitrate_by_area", " SELECT DISTINCT row_no, col_no, round(CAST(5000000 AS DOUBLE)*(64*(col_no+1)*64)/CAST(2000*1000 AS DOUBLE),6) AS bitrate FROM v_grid", "grid")(
    lambda s, p: read(s, p, "grid").select("row_no", "col_no", F.round(F.lit(5e6) * (64 * (F.col("col_no") + 1) * 64) / F.lit(2000.0 * 1000), 6).alias("bitrate")).distinct())
COS = "list_sum(list_transform(range(1,65), lambda i: CAST(a.embedding[i] AS DOUBLE)*CAST(b.embedding[i] AS DOUBLE)))/sqrt(list_sum(list_transform(range(1,65), lambda i: pow(CAST(a.embedding[i] AS DOUBLE),2)))*list_sum(list_transform(range(1,65), lambda i: pow(CAST(b.embedding[i] AS DOUBLE),2))))"


def similar_pairs(s, p):
    t = tiles(s, p).withColumn("seg_start", F.floor(F.col("t") / 10) * 10).select("seg_start", "tile_id", "embedding")
    a, b = t.alias("a"), t.alias("b")
    return a.join(b, (F.col("a.seg_start") == F.col("b.seg_start")) & (F.col("a.tile_id") < F.col("b.tile_id"))).where(g.cosine(F.col("a.embedding"), F.col("b.embedding")) > 0.2).select(F.col("a.tile_id").alias("u"), F.col("b.tile_id").alias("v"))


def similar_tiles(s, p):
    from scantling.operators.graph import components

    return components(similar_pairs(s, p)).select(F.col("node").alias("tile_id"), "component")


def clustered_cells(s, p):
    """Cells of segments with the cluster that their tile's embedding falls in (a tile alike no other is its own)."""
    cells = tiles(s, p).select((F.floor(F.col("t") / 10) * 10).alias("seg_start"), "tile_id", "row_no", "col_no")
    return cells.join(similar_tiles(s, p), "tile_id", "left").withColumn("cluster", F.coalesce("component", "tile_id"))


add("j09_similar_tiles", f" SELECT a.tile_id AS u, b.tile_id AS v FROM v_tile a JOIN v_tile b ON a.t // 10 = b.t // 10 AND a.tile_id < b.tile_id WHERE {COS} > CAST(0.2 AS DOUBLE)", "tile")(similar_pairs)
QUERIES["t05_semantic_clusters"] = (QUERIES["t05_semantic_clusters"][0], f"{w('tile').replace('WITH v_tile', 'WITH RECURSIVE v_tile')}, pr AS (SELECT a.tile_id AS u, b.tile_id AS v FROM v_tile a JOIN v_tile b ON a.t // 10 = b.t // 10 AND a.tile_id < b.tile_id WHERE {COS} > CAST(0.2 AS DOUBLE)), bo AS (SELECT u, v FROM pr UNION SELECT v, u FROM pr), rc AS (SELECT u AS id, u AS r FROM bo UNION SELECT bo.v, rc.r FROM rc JOIN bo ON bo.u = rc.id) SELECT id AS tile_id, min(r) AS component FROM rc GROUP BY id")
QUERIES["gr3_components"] = QUERIES["t05_semantic_clusters"]

# calibration ------------------------------------------------------------------------------------------------------------------
AREA = "CAST(h*w AS DOUBLE)"
add("a25_linear_fit", f", f AS (SELECT regr_slope(ms,{AREA}) AS k, regr_intercept(ms,{AREA}) AS b FROM v_calib), g AS (SELECT h, w, ms FROM v_calib, f WHERE abs(k*h*w+b-ms)/ms <= CAST(0.06 AS DOUBLE)) SELECT round(regr_slope(ms,{AREA})*1e6,6) AS k_mega, round(regr_intercept(ms,{AREA}),6) AS b, round(regr_r2(ms,{AREA}),6) AS r2, count(*) AS n FROM g", "calib")(
    lambda s, p: calibrate(read(s, p, "calib"), 0.06))
add("a26_piecewise_fit", f" SELECT round(regr_slope(ms,{AREA}) FILTER (WHERE h*w>=200000)*1e6,6) AS k_mega, round(regr_intercept(ms,{AREA}) FILTER (WHERE h*w>=200000),6) AS b, round(avg(ms) FILTER (WHERE h*w<50000),6) AS a FROM v_calib", "calib")(
    lambda s, p: piecewise(read(s, p, "calib"), 200000))


def calibrate(df, most):
    """Line of cost by area, fitted again without rows whose relative residual is above ``most``."""
    area = (F.col("h") * F.col("w")).cast("double")
    first = df.agg(F.regr_slope(F.col("ms"), area).alias("k"), F.regr_intercept(F.col("ms"), area).alias("b"))
    kept = df.join(F.broadcast(first)).where(F.abs(F.col("k") * area + F.col("b") - F.col("ms")) / F.col("ms") <= most)
    return kept.agg(F.round(F.regr_slope(F.col("ms"), area) * 1e6, 6).alias("k_mega"), F.round(F.regr_intercept(F.col("ms"), area), 6).alias("b"), F.round(F.regr_r2(F.col("ms"), area), 6).alias("r2"), F.count("*").alias("n"))


def piecewise(df, least):
    """Line for areas from ``least`` on, mean for those under a quarter of it."""
    area = (F.col("h") * F.col("w")).cast("double")
    big = lambda c: F.when(area >= least, c)
    return df.agg(F.round(F.regr_slope(big(F.col("ms")), area) * 1e6, 6).alias("k_mega"), F.round(F.regr_intercept(big(F.col("ms")), area), 6).alias("b"), F.round(F.avg(F.when(area < least / 4, F.col("ms"))), 6).alias("a"))
