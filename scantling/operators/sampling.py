"""Sampling under a bound: prefix sums without a global sort, importance draws, error-bounded sums, confidence bounds."""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from scantling.operators.detections import hash_order


def bounds(df: DataFrame, x: Column, delta: float) -> DataFrame:
    """Mean plus and minus its deviation times sqrt(2 ln(1 / 2 delta)) by sqrt(n)."""
    reach = F.stddev_pop(x) * math.sqrt(2 * math.log(1 / (2 * delta))) / F.sqrt(F.count(x))
    return df.agg(F.count(x).alias("n"), F.round(F.avg(x) + reach, 6).alias("upper"), F.round(F.avg(x) - reach, 6).alias("lower"))


def one_sided(df: DataFrame, x: Column, z: float = 1.6448536269514722) -> DataFrame:
    m, n = F.avg(x), F.count(x)
    return df.agg(F.round(m + z * F.sqrt(m * (1 - m) / n), 6).alias("bernoulli_upper"), F.round(m - z * F.stddev_samp(x) / F.sqrt(n), 6).alias("std_lower"))


def in_order(df: DataFrame, order: list[Column], label: str) -> DataFrame:
    """``df`` sorted over range partitions and written, with ``__part`` and ``__place``: each row's partition and its place there, both rising.

    Partitions are cut by a sample of all of ``order``, so where its last part is unique no value of the others is too frequent for a task.
    """
    from scantling.sources.shared import materialize

    mark = F.monotonically_increasing_id()
    placed = df.repartitionByRange(*order).sortWithinPartitions(*order).withColumn("__mark", mark)
    placed = materialize(placed, label)
    return placed.withColumn("__part", F.shiftright("__mark", 33)).withColumn("__place", F.col("__mark").bitwiseAND((1 << 33) - 1)).drop("__mark")


def running(df: DataFrame, order: list[Column], sums: dict[str, Column] | None = None, rank: str = "rank") -> DataFrame:
    """``df`` with ``rank`` (0 first) in an order whose keys are unique together, and running sums.

    Rows are sorted over range partitions; counts and sums of the partitions, a bounded table, give where each begins.
    """
    sums = sums or {}
    own = in_order(df.select("*", *[c.cast("double").alias(f"__{n}") for n, c in sums.items()]), order, "ranked")
    total = own.groupBy("__part").agg(F.count("*").alias("__n"), *[F.sum(f"__{n}").alias(f"__s_{n}") for n in sums])
    before = Window.orderBy("__part").rowsBetween(Window.unboundedPreceding, -1)
    starts = total.select("__part", F.coalesce(F.sum("__n").over(before), F.lit(0)).alias("__from"), *[F.coalesce(F.sum(f"__s_{n}").over(before), F.lit(0.0)).alias(f"__b_{n}") for n in sums])
    w = Window.partitionBy("__part").orderBy("__place").rowsBetween(Window.unboundedPreceding, 0)
    inner = own.select("*", *[F.sum(f"__{n}").over(w).alias(f"__c_{n}") for n in sums])
    joined = inner.join(F.broadcast(starts), "__part")
    return joined.select(*df.columns, (F.col("__from") + F.col("__place")).alias(rank), *[(F.col(f"__b_{n}") + F.col(f"__c_{n}")).alias(n) for n in sums])


def ranked(df: DataFrame, score: str, tie: str, sums: dict[str, Column] | None = None) -> DataFrame:
    """``rank`` (0 first) by falling score, ties by rising ``tie``, and running sums."""
    return running(df, [F.desc(score), F.asc(tie)], sums)


def importance_weights(df: DataFrame, score: str, mode: str = "sqrt", uniform: float = 0.1) -> DataFrame:
    """``prob``: a mixture of a share by weight (the score, its root, or alike for all) and a uniform share."""
    w = {"sqrt": F.sqrt(F.col(score)), "prop": F.col(score), "uniform": F.lit(1.0)}[mode]
    total = df.agg(F.sum(w).alias("__w"), F.count("*").alias("__n"))
    return df.join(F.broadcast(total)).withColumn("prob", (1 - uniform) * w / F.col("__w") + uniform / F.col("__n")).drop("__w")


def importance_sample(df: DataFrame, score: str, tie: str, budget: int, mode: str = "sqrt", seed: int = 7) -> DataFrame:
    """``budget`` draws with replacement by inverse CDF: rows of ``df`` with ``draw``, ``rank``, ``n``, ``prob``, ``upto`` (the probability down to this rank) and ``mass`` (1 / n / prob).

    Draws meet rows by the bin of their uniform number, so the range join is an equi-join with a residual.
    """
    weighed = importance_weights(df, score, mode).withColumnRenamed("__n", "n")
    run = ranked(weighed, score, tie, {"upto": F.col("prob")})
    u = hash_order(F.concat(F.lit("draw"), F.col("draw").cast("string")), seed) / F.lit(float(1 << 32))
    draws = df.sparkSession.range(budget).withColumnRenamed("id", "draw").withColumn("u", u).withColumn("slot", F.floor(F.col("u") * 1000))
    low = F.floor((F.col("upto") - F.col("prob")) * 1000)
    spread = run.withColumn("slot", F.explode(F.sequence(low, F.floor(F.col("upto") * 1000))))
    hit = spread.join(draws, "slot").where((F.col("u") < F.col("upto")) & (F.col("u") >= F.col("upto") - F.col("prob")))
    return hit.withColumn("mass", 1 / F.col("n") / F.col("prob")).drop("slot", "u")


def reuse_sample(df: DataFrame, score: str, tie: str, wanted: int, mode: str = "sqrt", seed: int = 7, seen: DataFrame | None = None) -> DataFrame:
    """Draws ten times ``wanted`` and keeps those up to the one that brings the ``wanted``-th row not seen before."""
    drawn = importance_sample(df, score, tie, 10 * wanted, mode, seed)
    firsts = drawn.groupBy(tie).agg(F.min("draw").alias("first"))
    if seen is not None:
        firsts = firsts.join(seen.select(tie).distinct(), tie, "left_anti")
    last = firsts.orderBy("first").limit(wanted).agg(F.max("first").alias("last"))
    return drawn.join(F.broadcast(last)).where(F.col("draw") <= F.col("last")).drop("last")


#: The stopping rule looks anew at its control variate when the sample has grown by this.
GROWTH, ORDER = 1.5, 1.1
EDGES = [int(GROWTH**j) for j in range(1, 100) if GROWTH**j < 1 << 52]


def _first_close(rows: DataFrame, limit: int, n: int, tau: float, var: float, eps: float, conf: float, top: float, bins: int = 512) -> tuple[int, float] | None:
    """First place of the sample at which the bounds meet, and the estimate there; None if they don't. ``rows``: ``h``, ``k``, ``y``, ``p``.

    Rows are in order of ``h`` (under ``limit``, evenly spread) and ``k``. Running sums and running bounds come from those of bins of
    ``h`` and windows within each; the driver gets a row for each growth step and the answer.
    """
    from scantling.sources.shared import drop_materialized, materialize

    names = {"sy": F.col("y"), "sp": F.col("p"), "syp": F.col("y") * F.col("p"), "syy": F.col("y") * F.col("y"), "spp": F.col("p") * F.col("p")}
    binned = rows.withColumn("bin", F.floor(F.col("h") * bins / F.lit(limit)))
    before = Window.orderBy("bin").rowsBetween(Window.unboundedPreceding, -1)
    totals = binned.groupBy("bin").agg(F.count("*").alias("n_"), *[F.sum(c).alias(f"{x}_") for x, c in names.items()])
    starts = totals.select("bin", *[F.coalesce(F.sum(f"{x}_").over(before), F.lit(0)).alias(f"{x}_") for x in ("n", *names)])
    w = Window.partitionBy("bin").orderBy("h", "k")
    upto = w.rowsBetween(Window.unboundedPreceding, 0)
    run = binned.select("bin", F.row_number().over(w).alias("rn"), *[F.sum(c).over(upto).alias(x) for x, c in names.items()]).join(F.broadcast(starts), "bin")
    run = materialize(run.select("bin", (F.col("n_") + F.col("rn") - 1).alias("t"), *[(F.col(x) + F.col(f"{x}_")).alias(x) for x in names]), "sample-sums")
    # at the beginning of each step, and at the sample's end, how the proxy and the truth vary together
    row = F.struct("t", *names)
    marks = sorted({1, 99, *(e for e in EDGES if e < 1 << 40)})
    found = run.agg(F.max(row).alias("last"), F.collect_list(F.when(F.col("t").isin(marks), row)).alias("marks")).first()
    if found["last"] is None or found["last"]["t"] < 2:
        drop_materialized(run)
        return None
    size = found["last"]["t"] + 1
    begin = {j: min(max(EDGES[j - 1] + 1, min(100, size)), size) for j in range(1, len(EDGES)) if EDGES[j - 1] < size or j == 1}
    at = {r["t"]: r for r in [*found["marks"], found["last"]]}
    cs, alphas, xs = [], [], []
    for j, b in begin.items():
        r = at[b - 1]
        cs.append(-((r["syp"] - r["sy"] * r["sp"] / b) / (b - 1)) / var if var > 0 else 0.0)
        alphas.append(EDGES[j] / EDGES[j - 1])
        d = conf * (ORDER - 1) / ORDER / (math.log(j + 1) / math.log(1.1)) ** ORDER
        xs.append(-alphas[-1] * math.log(d) / 3)
    edges = np.array([EDGES[j - 1] for j in begin])
    values = np.array([cs, xs], float)

    def bounds_of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            t, sy, sp, syp, syy, spp = (batch.column(i).to_numpy() for i in range(1, 7))
            c, x = values[:, np.maximum(np.searchsorted(edges, t) - 1, 0)]
            m = t + 1
            s = sy + c * (sp - m * tau)
            s2 = syy + 2 * c * (syp - tau * sy) + c * c * (spp - 2 * tau * sp + m * tau * tau)
            spread = (s2 - s * s / t) / t
            reach = np.sqrt(np.maximum(spread, 0)) * np.sqrt((n - t) / max(1, n - 1)) * np.sqrt(2 * x / t) + 3 * top * x / t
            mean, known = np.abs(s / t), spread >= 0
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(np.sign(s)), pa.array(np.where(known, mean - reach, -np.inf)), pa.array(np.where(known, mean + reach, np.inf))], names=["bin", "t", "sign", "lo", "hi"])

    each = run.where("t >= 2").select("bin", "t", *names).mapInArrow(bounds_of, "bin long, t long, sign double, lo double, hi double")
    best = each.groupBy("bin").agg(F.max("lo").alias("lo_"), F.min("hi").alias("hi_"))
    best = best.select("bin", F.max("lo_").over(before).alias("lo_"), F.min("hi_").over(before).alias("hi_"))
    w = Window.partitionBy("bin").orderBy("t").rowsBetween(Window.unboundedPreceding, 0)
    closed = each.select("bin", "t", "sign", F.max("lo").over(w).alias("lo"), F.min("hi").over(w).alias("hi")).join(F.broadcast(best), "bin")
    closed = closed.select("t", "sign", F.greatest("lo", "lo_").alias("lo"), F.least("hi", "hi_").alias("hi")).where(F.col("lo") + eps >= F.col("hi") - eps)
    hit = closed.agg(F.min(F.struct("t", "sign", "lo", "hi")).alias("hit")).first()["hit"]
    drop_materialized(run)
    return None if hit is None else (hit["t"], hit["sign"] * 0.5 * ((1 + eps) * hit["lo"] + (1 - eps) * hit["hi"]) * n)


def approximate_sum(df: DataFrame, key: str, proxy: str, truth: str, eps: float = 0.1, conf: float = 0.05, seed: int = 7, first: int = 1000, use_proxy: bool = True) -> DataFrame:
    """``estimate`` of the sum of ``truth`` to ``eps`` on the mean, with ``n_samples`` read for it and ``exact`` where all had to be.

    Rows are drawn by a seeded hash. The proxy is a control variate. Only rows that the stopping rule reaches need a label, so
    the sample grows fourfold, up to all rows, until the bounds meet; where they never do, the sum is exact.
    """
    spark = df.sparkSession
    p = F.col(proxy) if use_proxy else F.lit(0.0)
    stats = df.agg(F.count("*").alias("n"), F.avg(p).alias("tau"), F.var_pop(p).alias("var"), F.max(F.rint(p)).alias("top")).first()
    n, size = stats["n"], first
    drawn = df.select(hash_order(F.col(key), seed).alias("h"), F.col(key).alias("k"), F.col(truth).cast("double").alias("y"), p.cast("double").alias("p"))
    while n:
        limit = min(1 << 32, (size << 32) // n + 1)
        found = _first_close(drawn.where(F.col("h") < limit), limit, n, stats["tau"], stats["var"] or 0.0, eps, conf, max(1.0, stats["top"] or 0.0))
        if found:
            return spark.createDataFrame([(round(float(found[1]), 6), int(found[0]), False)], "estimate double, n_samples long, exact boolean")
        if limit == 1 << 32:
            break
        size *= 4
    return df.agg(F.coalesce(F.sum(truth), F.lit(0.0)).cast("double").alias("estimate"), F.count("*").alias("n_samples"), F.lit(True).alias("exact"))


def control_coefficients(df: DataFrame, proxies: list[str], truth: str) -> list[float]:
    """Least-squares coefficients of several proxies: normal equations from sums, solved on the driver (k by k)."""
    cols = [F.lit(1.0), *[F.col(c) for c in proxies]]
    k = len(cols)
    sums = df.agg(*[F.sum(cols[i] * cols[j]).alias(f"a_{i}_{j}") for i in range(k) for j in range(k)], *[F.sum(cols[i] * F.col(truth)).alias(f"b_{i}") for i in range(k)]).first()
    a = np.array([[sums[f"a_{i}_{j}"] for j in range(k)] for i in range(k)], float)
    return np.linalg.lstsq(a, np.array([sums[f"b_{i}"] for i in range(k)], float), rcond=None)[0].tolist()
