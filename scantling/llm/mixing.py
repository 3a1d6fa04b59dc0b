"""Mixing sources to target weights by Pareto order sampling.

Each source has a weight; its target is its share by weight of all words. No source may go above ``most`` times its own words;
what that cuts off is shared among the others by weight until none is above. A source's target divided by its words is how
often each of its documents is to be taken: the whole part is certain copies, the rest an inclusion probability ``p``, which
differs between sources. Documents of a source are ranked by the odds of a uniform number divided by the odds of ``p``, and those
that rank first are taken until their words come nearest to what the target asks beyond the certain copies.

No source is sorted whole. Ranks lie in (0, 1); the place to cut is found by adding up words in bins, then in the bins of the
bin that is cut, and only what is left is looked at row by row, so a source that holds a third of all rows is no task's burden.
The uniform number comes from the id: reruns agree, and rows of a source that repeat an id are taken together; rows that
repeat an id in several sources are taken as each source's plan says.

Null source: a source of its own, last in order. Null text: no words; such rows get copies like the others and add no words.
Null id: the number comes from the text instead. No words at all: every target is 0 and nothing is taken. No rows: no rows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from scantling.llm.util import WORD_PATTERN, materialize, scratch

WEIGHTS, MOST, BINS, SMALL = (5, 2, 1), 3, 4096, 20_000


def word_count(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(WORD_PATTERN)), F.lit(0)).cast("long")


def uniform(key: Column, seed: int) -> Column:
    """A number in (0, 1) from 52 bits of the MD5 of a key."""
    digits = F.substring(F.md5(F.concat(F.lit(f"{seed}:"), key)), 1, 13)
    return (F.conv(digits, 16, 10).cast("long") + F.lit(0.5)) / F.lit(float(1 << 52))


def targets(sources: DataFrame, weights: tuple = WEIGHTS, most: int = MOST) -> DataFrame:
    """``source``, ``source_size`` with ``weight`` and ``target``; weights repeat over the sources in order of code points.

    Capped sources are those with the least of cap by weight: a prefix in that order. One row a source goes through one task.
    """
    order = Window.orderBy(F.col("source").asc_nulls_last())
    place = (F.row_number().over(order) - 1) % len(weights)
    ranked = sources.select("source", "source_size", F.element_at(F.array(*[F.lit(float(w)) for w in weights]), place + 1).alias("weight"), (F.col("source_size") * most).alias("cap"))
    by_cap = Window.orderBy(F.col("cap") / F.col("weight"), F.col("source").asc_nulls_last())
    before = F.coalesce(F.sum("cap").over(by_cap.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    level = ranked.select(
        "*", (F.sum("source_size").over(Window.partitionBy()) - before).alias("left"),
        F.sum("weight").over(by_cap.rowsBetween(Window.currentRow, Window.unboundedFollowing)).alias("over"),
    ).withColumn("fits", F.col("left") * F.col("weight") <= F.col("cap") * F.col("over"))
    # the first that fits sets the level for itself and all after it
    first = F.min_by(F.struct("left", "over"), F.when(F.col("fits"), F.col("cap") / F.col("weight"))).over(Window.partitionBy())
    share = F.col("first.left") * F.col("weight") / F.col("first.over")
    return level.withColumn("first", first).select("source", "source_size", "weight", F.when(share < F.col("cap"), share).otherwise(F.col("cap").cast("double")).alias("target"))


def _by_source(left: DataFrame, right: DataFrame, small: bool) -> DataFrame:
    right = right.withColumnRenamed("source", "__source")
    return left.join(F.broadcast(right) if small else right, F.col("source").eqNullSafe(F.col("__source"))).drop("__source")


def _cut_bin(rows: DataFrame, plan: DataFrame, bins: int, small: bool) -> DataFrame:
    """``plan`` with the bin of ``rank`` in which a source's words pass ``wanted``, and the words before it in ``base``."""
    sums = rows.groupBy("source", F.floor(F.col("rank") * bins).alias("bin")).agg(F.sum("size").alias("words"))
    run = Window.partitionBy("source").orderBy("bin")
    sums = _by_source(sums, plan.select("source", "wanted", "base"), small).withColumn("upto", F.col("base") + F.sum("words").over(run))
    cut = sums.where(F.col("upto") >= F.col("wanted")).groupBy("source").agg(F.min_by(F.struct("bin", (F.col("upto") - F.col("words")).alias("base")), "bin").alias("cut"))
    return _by_source(plan.drop("base", "bin"), cut, small).select(*[c for c in plan.columns if c not in ("base", "bin")], F.col("cut.bin").alias("bin"), F.col("cut.base").alias("base"))


def draw_key(id_: Column, text: Column) -> Column:
    """What a row's uniform number comes from: its id, or its text where that is null."""
    return F.coalesce(id_.cast("string"), F.concat(F.lit("null/"), F.md5(F.coalesce(text.cast("string"), F.lit("")).cast("binary"))))


def rank_of(key: Column, p: Column, seed: int) -> Column:
    """Odds of the uniform number by odds of ``p``, brought to (0, 1) by x / (1 + x)."""
    u = uniform(key, seed)
    return F.when(p > 0, u * (1 - p) / (u * (1 - p) + (1 - u) * p)).otherwise(F.lit(1.0))


def plan_mix(sized: DataFrame, weights: tuple = WEIGHTS, most: int = MOST, seed: int = 17, bins: int = BINS) -> tuple[DataFrame, bool]:
    """A row a source: ``source``, ``source_size``, ``target``, ``whole``, ``p`` and where its ranks are cut; and whether that is small.

    ``sized`` has ``key``, ``source`` and ``size``. A row gets ``whole`` copies, and one more if its rank is under ``below`` or up to ``last``.
    """
    sources = materialize(targets(sized.groupBy("source").agg(F.sum("size").alias("source_size")), weights, most), "mix-targets")
    small = sources.count() <= SMALL
    often = F.when(F.col("source_size") > 0, F.col("target") / F.col("source_size")).otherwise(F.lit(0.0))
    plan = sources.withColumn("often", often).withColumn("whole", F.floor("often")).withColumn("p", F.col("often") - F.col("whole"))
    plan = plan.withColumn("wanted", F.col("target") - F.col("whole") * F.col("source_size")).withColumn("base", F.lit(0).cast("long"))
    ranked = _by_source(sized, plan.select("source", "p"), small).withColumn("rank", rank_of(F.col("key"), F.col("p"), seed)).where("p > 0").select("source", "size", "rank")
    open_ = plan.select("source", "wanted", "base").where("wanted > 0")
    coarse = materialize(_cut_bin(ranked, open_, bins, small), "mix-cut")
    in_coarse = _by_source(ranked, coarse.select("source", "bin"), small).where(F.floor(F.col("rank") * bins) == F.col("bin")).drop("bin")
    fine = materialize(_cut_bin(in_coarse, coarse, bins * bins, small), "mix-cut")
    left = _by_source(in_coarse, fine.select("source", "bin", "wanted", "base"), small).where(F.floor(F.col("rank") * bins * bins) == F.col("bin"))
    same = left.groupBy("source", "rank", "wanted", "base").agg(F.sum("size").alias("words"))
    same = same.withColumn("upto", F.col("base") + F.sum("words").over(Window.partitionBy("source").orderBy("rank")))
    near = F.col("upto") - F.col("wanted") <= F.col("wanted") - (F.col("upto") - F.col("words"))
    reached = same.where((F.col("upto") - F.col("words") < F.col("wanted")) & ((F.col("upto") <= F.col("wanted")) | near)).groupBy("source").agg(F.max("rank").alias("last"))
    out = plan.select("source", "source_size", "target", "whole", "p")
    for found in (fine.select(F.col("source").alias("__s"), (F.col("bin") / F.lit(float(bins * bins))).alias("below")), reached.withColumnRenamed("source", "__s")):
        out = out.join(found, F.col("source").eqNullSafe(F.col("__s")), "left").drop("__s")
    return materialize(out, "mix-plan"), small


def copies_of(key: Column, plan: Column, seed: int) -> Column:
    """How often a row is taken, by its source's row of the plan (a struct)."""
    rank = rank_of(key, plan["p"], seed)
    extra = F.coalesce((plan["p"] > 0) & ((rank < plan["below"]) | (rank <= plan["last"])), F.lit(False))
    return (plan["whole"] + extra.cast("long")).cast("long")


def _planned(rows: DataFrame, source: str, plan: DataFrame, small: bool) -> DataFrame:
    """``rows`` with their source's plan as the struct ``__plan``."""
    right = plan.select(F.col("source").alias("__source"), F.struct(*plan.columns).alias("__plan"))
    return rows.join(F.broadcast(right) if small else right, F.col(f"`{source}`").eqNullSafe(F.col("__source"))).drop("__source")


def mix(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", weights: tuple = WEIGHTS, most: int = MOST, seed: int = 17, bins: int = BINS) -> DataFrame:
    """``id``, ``source``, ``size``, ``source_size``, ``target``, ``copies`` and ``taken`` for every row; extra columns are ignored."""
    sized = materialize(_sized(docs, id_col, text_col, source_col), "mix-sizes")
    with scratch(docs.sparkSession) as made:
        plan, small = plan_mix(sized, weights, most, seed, bins)
        made.keep(plan)
    out = _planned(sized, "source", plan, small).withColumn("copies", copies_of(F.col("key"), F.col("__plan"), seed))
    return out.select("id", "source", "size", "__plan.source_size", "__plan.target", "copies", (F.col("size") * F.col("copies")).alias("taken"))


def _sized(docs: DataFrame, id_col: str, text_col: str, source_col: str) -> DataFrame:
    id_, text = F.col(f"`{id_col}`"), F.col(f"`{text_col}`")
    return docs.select(id_.alias("id"), draw_key(id_, text).alias("key"), F.col(f"`{source_col}`").alias("source"), word_count(text).alias("size"))


def take(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", weights: tuple = WEIGHTS, most: int = MOST, seed: int = 17, bins: int = BINS) -> DataFrame:
    """Rows of ``docs``, all columns kept, each as often as the mix takes it: the rows meet the plan of their source, so texts aren't shuffled."""
    with scratch(docs.sparkSession) as made:
        sized = materialize(_sized(docs, id_col, text_col, source_col).select("key", "source", "size"), "mix-sizes")
        plan, small = plan_mix(sized, weights, most, seed, bins)
        made.keep(plan)
    key = draw_key(F.col(f"`{id_col}`"), F.col(f"`{text_col}`"))
    chosen = _planned(docs, source_col, plan, small).withColumn("__copies", copies_of(key, F.col("__plan"), seed)).where(F.col("__copies") > 0)
    return chosen.withColumn("__copy", F.explode(F.sequence(F.lit(1).cast("long"), F.col("__copies")))).select(*[F.col(f"`{c}`") for c in docs.columns])


ORACLE_SQL = rf"""
WITH sized AS (
  SELECT doc_id, coalesce(CAST(doc_id AS VARCHAR), 'null/' || md5(coalesce(text, ''))) AS key, source, CAST(coalesce(len(regexp_extract_all(text, '{WORD_PATTERN}')), 0) AS BIGINT) AS size FROM documents
), sources AS (
  SELECT source, CAST(sum(size) AS BIGINT) AS source_size FROM sized GROUP BY source
), ranked AS (
  SELECT *, source_size * 3 AS cap,
         CASE (row_number() OVER (ORDER BY source ASC NULLS LAST) - 1) % 3 WHEN 0 THEN 5.0::DOUBLE WHEN 1 THEN 2.0::DOUBLE ELSE 1.0::DOUBLE END AS weight
  FROM sources
), level AS (
  SELECT *, (sum(source_size) OVER ()) - coalesce(sum(cap) OVER (ORDER BY cap / weight, source NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS remaining,
         sum(weight) OVER (ORDER BY cap / weight, source NULLS LAST ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS over_weight
  FROM ranked
), first_fit AS (
  SELECT remaining AS r0, over_weight AS w0 FROM level WHERE remaining * weight <= cap * over_weight ORDER BY cap / weight, source NULLS LAST LIMIT 1
), plan AS (
  SELECT source, source_size, least(CAST(r0 AS DOUBLE) * weight / w0, CAST(cap AS DOUBLE)) AS target FROM level, first_fit
), plan2 AS (
  SELECT *, CASE WHEN source_size > 0 THEN target / source_size ELSE 0.0::DOUBLE END AS often FROM plan
), plan3 AS (
  SELECT *, CAST(floor(often) AS BIGINT) AS whole, often - floor(often) AS p, target - floor(often) * source_size AS wanted FROM plan2
), u AS (
  SELECT s.doc_id, s.size, p.*,
         (CAST('0x' || substr(md5('17:' || s.key), 1, 13) AS BIGINT) + 0.5::DOUBLE) / 4503599627370496.0::DOUBLE AS u
  FROM sized s JOIN plan3 p ON s.source IS NOT DISTINCT FROM p.source
), r AS (
  SELECT *, CASE WHEN p > 0 THEN u * (1 - p) / (u * (1 - p) + (1 - u) * p) ELSE 1.0::DOUBLE END AS rank FROM u
), same AS (
  SELECT source, rank, any_value(wanted) AS wanted, sum(size) AS words FROM r WHERE p > 0 GROUP BY source, rank
), run AS (
  SELECT *, sum(words) OVER (PARTITION BY source ORDER BY rank) AS upto FROM same
), cut AS (
  SELECT source, max(rank) AS last FROM run WHERE upto - words < wanted AND (upto <= wanted OR upto - wanted <= wanted - (upto - words)) GROUP BY source
)
SELECT r.doc_id, r.size, r.source_size, r.target,
       CAST(r.whole + CASE WHEN r.p > 0 AND r.rank <= c.last THEN 1 ELSE 0 END AS BIGINT) AS copies,
       CAST(r.size * (r.whole + CASE WHEN r.p > 0 AND r.rank <= c.last THEN 1 ELSE 0 END) AS BIGINT) AS taken
FROM r LEFT JOIN cut c ON r.source IS NOT DISTINCT FROM c.source
"""
