"""Operators over detections, frames and labels: counts, dense labels, metrics, thresholds, windows and splits."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window


def hash_order(key: Column, seed: int = 7) -> Column:
    """A seeded whole number below 2**32 from a key: the order of every sample here, equal on reruns and in any engine with MD5."""
    return F.conv(F.substring(F.md5(F.concat(F.lit(f"{seed}:"), key.cast("string"))), 1, 8), 16, 10).cast("long")


def count_objects(det: DataFrame, keys: list[str], hit: Column) -> DataFrame:
    """Detections of each group that fulfil a condition; groups with none count 0."""
    return det.groupBy(*keys).agg(F.count_if(hit).alias("n"))


def dense_counts(det: DataFrame, frame: str, first: int, last: int) -> DataFrame:
    """A row for every frame from ``first`` to ``last``, with its number of detections."""
    counts = det.groupBy(F.col(frame).alias("frame")).agg(F.count("*").alias("n"))
    return det.sparkSession.range(first, last + 1).withColumnRenamed("id", "frame").join(counts, "frame", "left").select("frame", F.coalesce("n", F.lit(0)).alias("n"))


def presence(counts: DataFrame) -> DataFrame:
    return counts.select("frame", F.least("n", F.lit(1)).alias("present"))


def clipped(counts: DataFrame, most: int) -> DataFrame:
    return counts.select("frame", F.least("n", F.lit(most)).alias("n"))


def class_matrix(det: DataFrame, frame: str, name: str, classes: list[str], most: int | None = None) -> DataFrame:
    """A column for each class (sorted): its count in a frame up to ``most``."""
    cell = lambda c: F.least(F.count_if(F.col(name) == c), F.lit(most)) if most else F.count_if(F.col(name) == c)
    return det.groupBy(F.col(frame).alias("frame")).agg(*[cell(c).alias(f"n_{c}") for c in sorted(classes)])


def all_classes_present(det: DataFrame, frame: str, name: str, classes: list[str]) -> DataFrame:
    hits = det.where(F.col(name).isin(classes)).groupBy(F.col(frame).alias("frame")).agg(F.count_distinct(name).alias("k"))
    return hits.where(F.col("k") == len(classes)).select("frame")


def multi_count(det: DataFrame, frame: str, name: str, least: dict[str, int]) -> DataFrame:
    """Frames in which every class reaches its count."""
    out = det.groupBy(F.col(frame).alias("frame")).agg(*[F.count_if(F.col(name) == c).alias(f"n_{c}") for c in least])
    for c, n in least.items():
        out = out.where(F.col(f"n_{c}") >= n)
    return out


def binary_metrics(df: DataFrame, pred: Column, truth: Column) -> DataFrame:
    """Confusion counts, one added to each, and the rates of them."""
    n = lambda p, t: F.count_if((pred == p) & (truth == t)) + 1
    c = df.agg(n(True, True).alias("tp"), n(False, False).alias("tn"), n(True, False).alias("fp"), n(False, True).alias("fn"))
    tp, tn, fp, fn = (F.col(x) for x in ("tp", "tn", "fp", "fn"))
    total = tp + tn + fp + fn
    rates = {
        "recall": tp / (tp + fn), "specificity": tn / (tn + fp), "precision": tp / (tp + fp), "npv": tn / (tn + fn), "fpr": fp / (fp + tn),
        "fdr": fp / (tp + fp), "fnr": fn / (tp + fn), "accuracy": (tp + tn) / total, "f1": tp * 2 / (tp * 2 + fp + fn),
        "base_rate": (tp + fn) / total, "positive_rate": (tp + fp) / total,
    }
    return c.select("tp", "tn", "fp", "fn", *[F.round(v, 6).alias(k) for k, v in rates.items()])


def count_metrics(df: DataFrame, pred: str, truth: str) -> DataFrame:
    p, t = F.col(pred), F.col(truth)
    return df.agg(
        F.round(F.avg((p == t).cast("double")), 6).alias("accuracy"), F.sum(F.abs(p - t)).alias("absolute_error"), F.sum(p - t).alias("signed_error"),
        F.sum(t).alias("n_instances"), F.count("*").alias("n_frames"),
    )


def confusion(df: DataFrame, pred: str, truth: str) -> DataFrame:
    return df.groupBy(pred, truth).agg(F.count("*").alias("n"))


def track_coverage(det: DataFrame, track: str, seen: Column) -> DataFrame:
    """Share of tracks with a detection that fulfils ``seen``."""
    each = det.groupBy(track).agg(F.bool_or(seen).alias("seen"))
    return each.agg(F.count("*").alias("n_tracks"), F.round(F.avg(F.col("seen").cast("double")), 6).alias("coverage"))


def largest_frequent(df: DataFrame, value: str, share: float = 0.01) -> DataFrame:
    """The greatest value whose relative frequency is above ``share``."""
    counts = df.groupBy(F.col(value).alias("__value")).agg(F.count("*").alias("__n"))
    total = df.agg(F.count("*").alias("__total"))
    return counts.join(F.broadcast(total)).where(F.col("__n") > F.col("__total") * share).agg(F.max("__value").alias("max_count"))


def tail_length(tracks: DataFrame, track: str, share: float = 0.99, least: int = 3) -> DataFrame:
    """The length at place floor(share * n) of the tracks longer than ``least``, longest first, less one."""
    lengths = tracks.groupBy(track).agg(F.count("*").alias("length")).where(F.col("length") > least)
    # tracks by length: few rows, however many tracks there are
    by = lengths.groupBy("length").agg(F.count("*").alias("n"))
    w = Window.orderBy(F.desc("length"))
    run = by.select("length", F.sum("n").over(w).alias("upto"), F.sum("n").over(Window.partitionBy()).alias("total"))
    return run.where(F.col("upto") > F.floor(F.col("total") * share)).agg((F.max("length") - 1).alias("tail_length"))


def dilate(df: DataFrame, frame: str, flag: str, reach: int = 10) -> DataFrame:
    """Whether a frame has a flagged one within ``reach`` frames. Flags are spread and joined back, so frames need no global order."""
    reached = df.where(F.col(flag)).select(F.explode(F.sequence(F.col(frame) - reach, F.col(frame) + reach)).alias(frame)).distinct().withColumn("near", F.lit(True))
    return df.join(reached, frame, "left").select(frame, F.coalesce("near", F.lit(False)).alias("near"))


def score_sums(df: DataFrame, score: str, value: Column, digits: int) -> DataFrame:
    """Counts and sums by score cut down to ``digits``: at most 10**digits rows for scores in [0, 1]."""
    return df.groupBy(F.round(score, digits).alias("cut")).agg(F.sum(value).alias("v"), F.count("*").alias("n"))


def threshold_for_fnr(df: DataFrame, score: str, label: Column, most: float, digits: int = 4) -> DataFrame:
    """The greatest cut with no more than this share of the positives below it."""
    by = score_sums(df, score, label.cast("long"), digits)
    w = Window.orderBy("cut")
    run = by.select("cut", (F.sum("v").over(w) - F.col("v")).alias("below"), F.sum("v").over(Window.partitionBy()).alias("total"))
    return run.where(F.col("below") <= F.col("total") * most).agg(F.max("cut").alias("threshold"))


def thresholds_two_sided(df: DataFrame, score: str, label: Column, fnr: float, fpr: float, digits: int = 4) -> DataFrame:
    """The greatest cut for the missed positives and the least for the negatives at or above it."""
    by = df.groupBy(F.round(score, digits).alias("cut")).agg(F.sum(label.cast("long")).alias("p"), F.sum((~label).cast("long")).alias("q"))
    w, all_ = Window.orderBy("cut"), Window.partitionBy()
    run = by.select("cut", (F.sum("p").over(w) - F.col("p")).alias("missed"), F.sum("p").over(all_).alias("ps"), (F.sum("q").over(all_) - F.sum("q").over(w) + F.col("q")).alias("wrong"), F.sum("q").over(all_).alias("qs"))
    return run.agg(F.max(F.when(F.col("missed") <= F.col("ps") * fnr, F.col("cut"))).alias("low"), F.min(F.when(F.col("wrong") <= F.col("qs") * fpr, F.col("cut"))).alias("high"))


def runs(df: DataFrame, key: str, group: list[str]) -> DataFrame:
    """Stretches of consecutive whole numbers in each group."""
    numbered = df.select(*group, key).distinct().withColumn("island", F.col(key) - F.row_number().over(Window.partitionBy(*group).orderBy(key)))
    return numbered.groupBy(*group, "island").agg(F.min(key).alias("first"), F.max(key).alias("last"), F.count("*").alias("n")).drop("island")


def changes(df: DataFrame, order: str, value: str, group: list[str]) -> DataFrame:
    """Stretches of one value in each group, in order."""
    w = Window.partitionBy(*group).orderBy(order)
    new = F.coalesce((F.lag(value).over(w) != F.col(value)).cast("int"), F.lit(1))
    part = df.withColumn("new", new).withColumn("part", F.sum("new").over(w))
    return part.groupBy(*group, "part").agg(F.min(order).alias("first"), F.max(order).alias("last"), F.first(value).alias(value), F.count("*").alias("n"))


def repeat_frames(df: DataFrame, frame: str, times: int) -> DataFrame:
    return df.withColumn("out_frame", F.explode(F.sequence(F.col(frame) * times, (F.col(frame) + 1) * times - 1)))


def every_nth(df: DataFrame, frame: str, n: int) -> DataFrame:
    return df.where(F.col(frame) % n == 0)


def first_by_hash(df: DataFrame, key: str, n: int, seed: int = 7) -> DataFrame:
    """A sample without replacement: the ``n`` rows of least hash (a top-n, so no global sort)."""
    return df.orderBy(hash_order(F.col(key), seed), F.col(key)).limit(n)


def permutation(df: DataFrame, key: str, seed: int = 7) -> DataFrame:
    """``place`` (1 first) of each key in the order of its hash, found by ranges of the hash and so without a global sort."""
    from scantling.operators.sampling import ranked

    spread = df.select(key, (1 - hash_order(F.col(key), seed) / F.lit(float(1 << 32))).alias("__score"))
    return ranked(spread, "__score", key).select(key, (F.col("rank") + 1).alias("place"))


def quota_split(df: DataFrame, key: str, label: str, quota: int, seed: int = 7) -> DataFrame:
    """``quota`` rows of each label by hash for training, the rest for validation. What ranks beyond the quota is cut early."""
    w = Window.partitionBy(label).orderBy(hash_order(F.col(key), seed), F.col(key))
    train = df.select(key, label).withColumn("rn", F.row_number().over(w)).where(F.col("rn") <= quota).select(key, F.lit("train").alias("part"))
    return df.select(key, label).join(train, key, "left").select(key, label, F.coalesce("part", F.lit("val")).alias("part"))


def share_split(df: DataFrame, key: str, share: float, seed: int = 7) -> DataFrame:
    """Rows whose hash lies in the first ``share`` of its range for training: needs no order at all."""
    return df.select(key, F.when(hash_order(F.col(key), seed) < int(share * 2**32), "train").otherwise("val").alias("part"))


def class_weights(df: DataFrame, label: str) -> DataFrame:
    """n / (k * n_c) for each class."""
    by = df.groupBy(label).agg(F.count("*").alias("n_c"))
    all_ = Window.partitionBy()
    return by.select(label, "n_c", F.round(F.sum("n_c").over(all_) / (F.count("*").over(all_) * F.col("n_c")), 6).alias("weight"))


def bootstrap_mean(df: DataFrame, key: str, value: str, trials: int, low: float, high: float, seed: int = 7) -> DataFrame:
    """Percentiles of the mean over hash-weighted resamples: each row counts 0 to 3 times in a trial (binomial of 4 halves, less 1, at 0)."""
    spread = df.select(key, value, F.explode(F.sequence(F.lit(0), F.lit(trials - 1))).alias("trial"))
    h = hash_order(F.concat_ws("/", F.col("trial").cast("string"), F.col(key).cast("string")), seed)
    weighed = spread.withColumn("times", F.bit_count(h % 4))
    means = weighed.groupBy("trial").agg((F.sum(F.col(value) * F.col("times")) / F.sum("times")).alias("mean"))
    return means.agg(*[F.round(F.percentile("mean", F.lit(p)), 6).alias(n) for n, p in (("low", low), ("high", high))])
