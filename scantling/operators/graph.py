"""Connected components by alternating large-star and small-star rounds, with shuffles on node ids only."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from scantling.sources.shared import drop_materialized, materialize


def _star(edges: DataFrame, large: bool) -> DataFrame:
    """Large star: link every greater neighbour of a node to the least of its neighbourhood; small star: the lesser ones and itself.

    The least neighbour comes from an aggregate with partial sums, so a node with very many neighbours never meets in one task
    as a list; the join back is one that Spark can split.
    """
    if large:
        both = edges.union(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
    else:
        both = edges.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v"))
    least = both.groupBy("u").agg(F.min("v").alias("m")).select(F.col("u").alias("c"), F.least("u", "m").alias("m"))
    joined = both.join(least, F.col("u") == F.col("c"))
    if large:
        out = joined.where(F.col("v") > F.col("u")).select(F.col("v").alias("u"), F.col("m").alias("v"))
    else:
        out = joined.select(F.col("v").alias("u"), F.col("m").alias("v")).union(least.select(F.col("c").alias("u"), F.col("m").alias("v")))
    return out.where("u <> v").distinct()


def components(edges: DataFrame, max_rounds: int = 60) -> DataFrame:
    """``node`` and ``component`` (the least node it reaches) for every node of ``edges`` (long columns ``u`` and ``v``).

    No edges: no rows. Loops and repeated edges do no harm. The rounds needed grow with the logarithm of the longest path; each
    is written to the shared folder, so a lost executor costs no more than the round. Raises if ``max_rounds`` don't suffice.
    """
    edges = materialize(edges.where("u <> v").select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct(), "edges")
    mark = F.struct(F.count("*").alias("n"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)")).alias("h")).alias("mark")
    last = edges.agg(mark).first()["mark"]
    for _ in range(max_rounds):
        if not last["n"]:
            break
        after = materialize(_star(_star(edges, True), False), "edges")
        now = after.agg(mark).first()["mark"]
        drop_materialized(edges)
        edges, done, last = after, now == last, now
        if done:
            break
    else:
        raise RuntimeError(f"components: {max_rounds} rounds did not suffice")
    roots = edges.select(F.col("v").alias("node")).distinct()
    return edges.select(F.col("u").alias("node"), F.col("v").alias("component")).union(roots.select("node", F.col("node").alias("component")))
