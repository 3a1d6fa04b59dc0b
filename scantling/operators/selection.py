"""Selection with a guarantee on precision or recall, from a bounded number of labels.

Each selector ranks rows by proxy, draws a sample whose labels it reads, and returns the rows down to a rank that its confidence
bound allows, with the positives of the sample. The sample (the budget) is small by contract and is weighed on the driver;
ranks, draws and the selected set stay distributed.
"""

from __future__ import annotations

import math
from dataclasses import dataclass

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from scantling.operators.detections import hash_order
from scantling.operators.sampling import importance_sample, ranked


@dataclass(frozen=True)
class Target:
    """What is asked: least precision or recall, with which chance of failure, from how many labels."""

    precision: float = 0.95
    recall: float = 0.9
    delta: float = 0.05
    budget: int = 1000


def _bound(x: np.ndarray, delta: float, sign: int) -> float:
    return float(x.mean() + sign * x.std() * math.sqrt(2 * math.log(1 / (2 * delta))) / math.sqrt(len(x))) if len(x) else 0.0


def _down_to(df: DataFrame, rank: int, positives: list[int], order: DataFrame | None = None) -> DataFrame:
    """Ids at ranks up to ``rank`` and the sampled positives."""
    order = ranked(df, "proxy_score", "id") if order is None else order
    return order.where((F.col("rank") <= rank) | F.col("id").isin(positives or [-1])).select("id")


def _sample(df: DataFrame, budget: int, mode: str, seed: int) -> list:
    return importance_sample(df, "proxy_score", "id", budget, mode, seed).select("draw", "id", "rank", "label", "mass", "n", "upto").orderBy("rank", "draw").collect()


def select_recall(df: DataFrame, target: Target, mode: str = "sqrt", seed: int = 7) -> DataFrame:
    """Rows (``id``, ``proxy_score``, ``label``) so that recall is at least the target's; ``mode`` is how draws are weighed."""
    rows = _sample(df, target.budget, mode, seed)
    mass = np.array([r["label"] * r["mass"] for r in rows], float)
    positives = sorted({r["id"] for r in rows if r["label"] > 0})
    if not mass.sum():
        return df.select("id")
    upto = np.cumsum(mass)
    split = int(np.argmax(upto >= target.recall * upto[-1]))
    left, right = np.where(np.arange(len(mass)) <= split, mass, 0), np.where(np.arange(len(mass)) > split, mass, 0)
    upper, lower = _bound(left, target.delta / 2, 1), max(_bound(right, target.delta / 2, -1), 0.0)
    wanted = upper / (upper + lower) if upper + lower > 0 else 1.0
    if wanted >= 1:
        return df.select("id")
    return _down_to(df, rows[int(np.argmax(upto >= wanted * upto[-1]))]["rank"], positives)


def select_recall_naive(df: DataFrame, target: Target, seed: int = 7) -> DataFrame:
    """A uniform sample, cut at the first rank that holds the target's share of its positives; no correction for chance."""
    rows = _uniform(df, target.budget, seed)
    labels = np.array([r["label"] for r in rows], float)
    if not labels.sum():
        return df.select("id")
    upto = np.cumsum(labels)
    at = int(np.argmax(upto >= target.recall * upto[-1]))
    return _down_to(df, rows[at]["rank"], sorted({r["id"] for r in rows if r["label"] > 0}))


def _uniform(df: DataFrame, budget: int, seed: int) -> list:
    order = ranked(df, "proxy_score", "id")
    return order.orderBy(hash_order(F.col("id"), seed), "id").limit(budget).orderBy("rank").collect()


def select_precision_naive(df: DataFrame, target: Target, seed: int = 7) -> DataFrame:
    """A uniform sample, cut at its last rank down to which the share of positives is at least the target's."""
    rows = _uniform(df, target.budget, seed)
    labels = np.cumsum([r["label"] for r in rows])
    good = [i for i in range(len(rows)) if labels[i] / (i + 1) >= target.precision]
    positives = sorted({r["id"] for r in rows if r["label"] > 0})
    return _down_to(df, rows[good[-1]]["rank"] if good else -1, positives)


def select_precision_uniform(df: DataFrame, target: Target, bound: str = "upper", stride: int = 100, seed: int = 7) -> DataFrame:
    """A uniform sample, tried every ``stride`` labels by a confidence bound ('lower' is the sound one, 'upper' the published behaviour)."""
    rows = _uniform(df, target.budget, seed)
    labels = np.array([r["label"] for r in rows], float)
    tries = range(stride, len(rows), stride)
    delta = target.delta / max(1, len(tries))
    good = [i for i in tries if _bound(labels[: i + 1], delta, 1 if bound == "upper" else -1) > target.precision]
    return _down_to(df, rows[good[-1]]["rank"] if good else -1, sorted({r["id"] for r in rows if r["label"] > 0}))


def _precision_cut(rows: list, precision: float, delta: float, stride: int) -> int:
    """Last rank down to which the lower bound of the share of positives is above ``precision``; -1 if none.

    ``rows``: draws in order of rank, each with ``mass`` (1 / n / probability) and ``upto``: what the draws down to its rank weigh
    of all, known exactly from running sums of the probabilities. Draws down to a rank are a sample of the rows down to it, and
    their masses, scaled by these sums, have a mean of one. ``delta`` is split over the ranks that are tried.
    """
    label, mass = np.array([r["label"] for r in rows], float), np.array([r["mass"] for r in rows], float)
    tries = [s for s in range(stride, len(rows), stride) if s + 1 < len(rows)]
    out = -1
    for s in tries:
        at = rows[s]
        # the mean of the masses down to this rank is (rows down to it by n) / (their probability)
        mean = (at["rank"] + 1) / at["n"] / at["upto"]
        if _bound(label[: s + 1] * mass[: s + 1] / mean, delta / len(tries), -1) > precision:
            out = at["rank"]
    return out


def select_precision(df: DataFrame, target: Target, stages: int = 2, stride: int = 100, seed: int = 7) -> DataFrame:
    """Importance draws; with two stages, half of the labels bound how many positives there are, the rest are drawn above that rank.

    The chance of failure is split between the stages and, in the last, over the ranks tried every ``stride`` draws.
    """
    if stages == 1:
        rows = _sample(df, target.budget, "sqrt", seed)
        return _down_to(df, _precision_cut(rows, target.precision, target.delta, stride), sorted({r["id"] for r in rows if r["label"] > 0}))
    first = _sample(df, target.budget // 2, "sqrt", seed)
    n = df.count()
    upper = _bound(np.array([r["label"] * r["mass"] for r in first], float), target.delta / 2, 1)
    cutoff = min(n, max(1, math.ceil(upper * n / target.precision)))
    order = ranked(df, "proxy_score", "id")
    top = order.where(F.col("rank") < cutoff).drop("rank")
    second = _sample(top, target.budget - target.budget // 2, "sqrt", seed + 1)
    positives = sorted({r["id"] for r in [*first, *second] if r["label"] > 0})
    return _down_to(df, _precision_cut(second, target.precision, target.delta / 2, stride), positives, order)


def select_both(df: DataFrame, target: Target, seed: int = 7) -> tuple[DataFrame, DataFrame]:
    """The recall set with every label read and only positives kept; and a row with the labels that took."""
    chosen = select_recall(df, target, "sqrt", seed)
    kept = df.join(chosen, "id", "left_semi").where(F.col("label") > 0).select("id")
    sampled = df.sparkSession.createDataFrame([(r["id"],) for r in _sample(df, target.budget, "sqrt", seed)], "id long").distinct()
    return kept, chosen.join(sampled, "id", "left_anti").agg((F.count("*") + target.budget).alias("n_labels"))


def quality_of(df: DataFrame, chosen: DataFrame) -> DataFrame:
    """``precision``, ``recall``, ``size`` and ``n_true`` of a selection."""
    marked = df.join(chosen.withColumn("in", F.lit(1)), "id", "left")
    hit = F.count_if((F.col("in") == 1) & (F.col("label") > 0))
    return marked.agg(
        F.round(F.try_divide(hit, F.count("in")), 6).alias("precision"), F.round(F.try_divide(hit, F.count_if(F.col("label") > 0)), 6).alias("recall"),
        F.count("in").alias("size"), F.count_if(F.col("label") > 0).alias("n_true"),
    )


SELECTORS = {
    "recall_sqrt": lambda df, t, seed: select_recall(df, t, "sqrt", seed), "recall_prop": lambda df, t, seed: select_recall(df, t, "prop", seed),
    "recall_uniform": lambda df, t, seed: select_recall(df, t, "uniform", seed), "recall_naive": select_recall_naive,
    "precision_naive": select_precision_naive, "precision_uniform": lambda df, t, seed: select_precision_uniform(df, t, "lower", seed=seed),
    "precision_one_stage": lambda df, t, seed: select_precision(df, t, 1, seed=seed), "precision_two_stage": lambda df, t, seed: select_precision(df, t, 2, seed=seed),
}


def run_trials(df: DataFrame, selector: str, target: Target, trials: int) -> DataFrame:
    """``trial``, precision, recall, size and whether the target was met, for so many seeded runs."""
    goal = F.col("precision") >= target.precision if selector.startswith("precision") else F.col("recall") >= target.recall
    out = None
    for seed in range(trials):
        one = quality_of(df, SELECTORS[selector](df, target, seed)).select(F.lit(seed).alias("trial"), "precision", "recall", "size", goal.alias("covered"))
        out = one if out is None else out.union(one)
    return out


def summarise(trials: DataFrame) -> DataFrame:
    return trials.agg(
        F.count("*").alias("n_trials"), F.round(F.avg("precision"), 6).alias("precision"), F.round(F.avg("recall"), 6).alias("recall"),
        F.round(F.stddev_samp("recall") / F.sqrt(F.count("*")), 6).alias("recall_sem"), F.round(F.avg(F.col("covered").cast("double")), 6).alias("coverage"),
    )


#: Named experiments: selector, target, and a synthetic source (alpha, beta) or "proxy" for a given one.
EXPERIMENTS = {
    f"{source}_{selector}_{budget}": (selector, Target(precision=goal, recall=goal, budget=budget), shape)
    for source, shape in (("rare", (0.01, 2.0)), ("common", (0.3, 1.0)))
    for selector in SELECTORS
    for goal, budget in ((0.9, 1000), (0.9, 10_000))
}


def run_recall(df: DataFrame, budget: int, recall: float, delta: float = 0.05) -> DataFrame:
    """The usual choice for a recall target."""
    return select_recall(df, Target(recall=recall, delta=delta, budget=budget))


def run_precision(df: DataFrame, budget: int, precision: float, delta: float = 0.05) -> DataFrame:
    """The usual choice for a precision target."""
    return select_precision(df, Target(precision=precision, delta=delta, budget=budget))


def run_experiment(spark: SparkSession, name: str, trials: int = 100, rows: int = 1_000_000) -> DataFrame:
    """The trials of a named experiment over its synthetic source."""
    from scantling.sources.connectors import beta_source
    from scantling.sources.shared import materialize

    selector, target, (alpha, beta) = EXPERIMENTS[name]
    return run_trials(materialize(beta_source(spark, rows, alpha, beta), "experiment"), selector, target, trials)


@dataclass(frozen=True)
class SourceSpec:
    """Where a proxy source lies and which columns it is made of: scores are divided by ``top`` and end at 1; a label is 1 above ``positive``."""

    path: str
    id: str
    score: str
    label: str
    top: float = 1.0
    positive: float = 0.5


class Sources(dict):
    """Named proxy sources."""

    def open(self, spark: SparkSession, root: str, name: str) -> DataFrame:
        """``id``, ``proxy_score`` and ``label`` of a named source under a folder."""
        spec = self[name]
        df = spark.read.csv(f"{root}/{spec.path}", header=True, inferSchema=True) if spec.path.endswith(".csv") else spark.read.parquet(f"{root}/{spec.path}")
        return df.select(F.col(spec.id).cast("long").alias("id"), F.least(F.col(spec.score) / spec.top, F.lit(1.0)).alias("proxy_score"), (F.col(spec.label) > spec.positive).cast("double").alias("label"))
