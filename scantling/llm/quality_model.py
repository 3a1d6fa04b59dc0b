"""Quality classifier from weak labels.

Heuristic labellers that overlap (two or more for each way a text is bad) fire or don't. Expectation-maximisation over the
counts of all patterns of votes, from all documents, estimates how often texts are bad and how often each labeller fires on bad
and on good ones; a pattern's posterior is its documents' weak label. A linear scorer over hashed features (the words of the
text, and its statistics in steps) is trained on the posteriors of a bounded sample and scores every document. The words of a text are
normalised to a vector of one length, ``WORD_NORM``, whether the text has five words or fifty thousand.

At most 2 ** labellers patterns exist, so their counts fit in the driver however many rows there are. The scorer is fitted on
about ``fit_rows`` rows, chosen by a hash of the id, with their whole texts, and on up to about ``STRATUM`` rows of each pattern
that has fewer among them: a rare kind of bad text has its part at every size of the corpus.

One pair of labellers looks for insults. To a short list of them come, where rows labelled toxic are at hand, the words that such
rows have far more often than others do; they are learned from about ``lexicon_rows`` labelled rows, near copies counted once. Labels
have no other part in the model.

Null or empty text, or one of white space: quality 0, rejected. Repeated rows get equal scores. No rows: nothing is fitted.
"""

from __future__ import annotations

import math
import zlib
from collections import Counter
from dataclasses import dataclass, field

import numpy as np
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from scantling.llm.quality_rules import repeated_words
from scantling.llm.util import drop_materialized, map_columns, materialize

#: Insults that a labeller looks for, lower case.
INSULTS = frozenset(
    w.encode() for w in (
        "asshole", "bastard", "bitch", "clown", "cretin", "disgusting", "dumbass", "filth", "idiot", "idiots", "imbecile", "loser", "losers",
        "moron", "morons", "pathetic", "retard", "scum", "scumbag", "stupid", "subhuman", "trash", "vermin", "worthless",
    )
)
SLOTS_LOG2, FIT_ROWS, LEXICON_ROWS, LEAST_FREQUENCY, STRATUM, EPOCHS, THRESHOLD = 18, 8000, 20_000, 40, 64, 30, 0.5
STRIP = b".,;:!?\"'()[]{}<>|#*$%&"
MARKS = b"!%$#&*"
SYMBOLS = b"#*$%&|<>"
NOT_LETTERS = bytes(b for b in range(128) if not (65 <= b <= 90 or 97 <= b <= 122))
UPPER = bytes(range(65, 91))
LOWER_OR_FAR = bytes([*range(97, 123), *range(128, 256)])

#: Statistic, the value from which a labeller fires, steps for the scorer's features.
STATISTICS = (
    ("symbols", (0.05, 0.15, 0.3, 0.6, 1.5)), ("no_letters", (0.05, 0.15, 0.3, 0.5)), ("marked", (0.05, 0.15, 0.3, 0.6)),
    ("upper", (0.1, 0.3, 0.6, 0.85)), ("repeats", (0.1, 0.25, 0.5, 0.75)), ("top_word", (0.1, 0.15, 0.25, 0.5)),
    ("dense", (0.5, 0.65, 0.75, 0.85)), ("insults", (0.004, 0.007, 0.015, 0.03)),
)
LABELLERS = (
    ("symbols", 0.3), ("no_letters", 0.3), ("marked", 0.3), ("upper", 0.6), ("repeats", 0.5), ("top_word", 0.25), ("dense", 0.75),
    ("insults", 0.004), ("insults", 0.007),
)


def fold(word: bytes) -> bytes:
    """Lower case, of all letters."""
    return word.lower() if word.isascii() else word.decode("utf-8", "replace").lower().encode()


#: Slots of words; behind them each step of a statistic has its own.
WORD_SLOTS = 1 << SLOTS_LOG2
STEPS = tuple((name, s) for name, steps in STATISTICS for s in steps)
#: The words of a text, short or long, are a vector of this length.
WORD_NORM = 10.0


def values_of(slots: np.ndarray) -> np.ndarray:
    """What each of a text's features counts: a word by the root of how many distinct ones there are, a step of a statistic 1."""
    words = slots < WORD_SLOTS
    return np.where(words, WORD_NORM / math.sqrt(max(1, int(words.sum()))), 1.0)


class Reader:
    """Statistics, votes and features of texts in UTF-8."""

    def __init__(self, insults: frozenset = INSULTS):
        self.insults = insults
        self.compress = zstandard.ZstdCompressor(level=1, write_checksum=False, write_content_size=False).compress

    def read(self, text: bytes) -> tuple[dict[str, float], set[bytes]]:
        """Statistics and the distinct words, folded and stripped. No words: nothing."""
        words = text.split()
        n = len(words)
        if not n:
            return {}, set()
        symbols = len(text) - len(text.translate(None, SYMBOLS))
        upper = len(text) - len(text.translate(None, UPPER))
        letters = upper + len(text) - len(text.translate(None, LOWER_OR_FAR))
        counts = Counter(words)
        no_letters = marked = insults = 0
        bare: set[bytes] = set()
        for w, c in counts.items():
            core = w.strip(STRIP)
            if len(w) - len(core) > 1 and len(w) - len(w.rstrip(MARKS)) > 1:
                marked += c
            if not w.translate(None, NOT_LETTERS):
                no_letters += c
            core = fold(core)
            if core in self.insults:
                insults += c
            bare.add(core)
        long = n >= 20
        stats = {
            "symbols": symbols / n, "no_letters": no_letters / n if long else 0.0, "marked": marked / n,
            "upper": upper / letters if letters >= 40 else 0.0,
            "repeats": repeated_words(words) / n if long else 0.0,
            "top_word": max(counts.values()) / n if n >= 50 else 0.0,
            # how much better it compresses than prose of its length does: 0 to 1
            "dense": max(0.0, 1 - len(self.compress(text)) / len(text)) if len(text) >= 256 else 0.0,
            "insults": insults / n,
        }
        return stats, bare

    def features(self, text: bytes) -> tuple[int, np.ndarray]:
        """Votes (bit j: labeller j fires; -1: no words) and the slots of the features: hashed words, in order without repeats, then steps of statistics."""
        stats, bare = self.read(text)
        if not stats:
            return -1, np.zeros(0, np.int32)
        votes = sum((stats[name] >= least) << j for j, (name, least) in enumerate(LABELLERS))
        hashes = np.fromiter(map(zlib.crc32, bare), np.uint32)
        words = np.unique((hashes * np.uint32(2654435761)) >> np.uint32(32 - SLOTS_LOG2)).astype(np.int32)
        marks = [WORD_SLOTS + k for k, (name, s) in enumerate(STEPS) if stats[name] >= s]
        return votes, np.concatenate([words, np.array(marks, np.int32)])


@dataclass
class LabelModel:
    """Share of bad texts, and how often each labeller fires on bad and on good ones."""

    bad: float = 0.15
    on_bad: np.ndarray = field(default_factory=lambda: np.full(len(LABELLERS), 0.35))
    on_good: np.ndarray = field(default_factory=lambda: np.full(len(LABELLERS), 0.01))
    rounds: int = 0

    def posterior(self, patterns: np.ndarray) -> np.ndarray:
        """Probability that texts with these votes are bad; 1 for those without words."""
        fired = (patterns[:, None] >> np.arange(len(LABELLERS)) & 1).astype(bool)
        score = lambda rate: np.where(fired, np.log(rate), np.log1p(-rate)).sum(1)
        odds = math.log(self.bad / (1 - self.bad)) + score(self.on_bad) - score(self.on_good)
        return np.where(patterns < 0, 1.0, 1 / (1 + np.exp(-np.clip(odds, -50, 50))))


def fit_labels(patterns: np.ndarray, counts: np.ndarray, rounds: int = 200, prior: float = 0.02) -> LabelModel:
    """EM over counts of patterns. Labellers are taken to be rare on good texts; that prior weighs ``prior`` of the rows."""
    model = LabelModel()
    own = patterns >= 0
    patterns, counts = patterns[own], counts[own].astype(float)
    total = counts.sum()
    if not total:
        return model
    fired = (patterns[:, None] >> np.arange(len(LABELLERS)) & 1).astype(float)
    weight = max(prior * total, 1.0)
    for model.rounds in range(1, rounds + 1):
        p = model.posterior(patterns) * counts
        q = counts - p
        last = model.on_bad.copy()
        model.bad = float((p.sum() + 0.1 * weight) / (total + weight))
        model.on_bad = np.clip((p @ fired + 0.3 * weight * 0.1) / (p.sum() + weight * 0.1), 0.02, 0.98)
        model.on_good = np.clip((q @ fired + 0.002 * weight) / (q.sum() + weight), 1e-4, 0.2)
        if np.abs(model.on_bad - last).max() < 1e-6:
            break
    return model


def least_count(n: int, least: int = LEAST_FREQUENCY) -> int:
    """How many of ``n`` texts count as enough: a two-hundredth, at most ``least``."""
    return min(least, max(2, n // 200))


def row_weights(patterns: np.ndarray) -> np.ndarray:
    """What each row counts in the fit: 1, or more where a pattern has few rows, so that each pattern has the least count."""
    _, at, n = np.unique(patterns, return_inverse=True, return_counts=True)
    return np.maximum(1.0, least_count(len(patterns)) / n)[at]


def fit_scorer(
    slots: list[np.ndarray], labels: np.ndarray, epochs: int = EPOCHS, least: int = LEAST_FREQUENCY, ridge: float = 1e-3, step: float = 0.5,
    counts: np.ndarray | None = None,
) -> tuple[np.ndarray, float]:
    """Weights by slot and a constant of a logistic scorer, on labels from 0 to 1, by AdaGrad over all rows at once.

    Words in fewer than ``least`` texts keep weight 0: what a few texts have tells nothing of others. The steps of statistics are
    few and always take part. ``counts``: how much each row counts, 1 unless given.
    """
    weights, bias = np.zeros(WORD_SLOTS + len(STEPS), np.float32), 0.0
    n = len(slots)
    if not n:
        return weights, bias
    counts = np.ones(n) if counts is None else counts
    total = counts.sum()
    lengths = np.array([len(s) for s in slots])
    flat = np.concatenate(slots) if lengths.sum() else np.zeros(0, np.int32)
    owner = np.repeat(np.arange(n), lengths)
    worth = np.concatenate([values_of(s) for s in slots])
    frequent = np.bincount(flat, minlength=len(weights)) >= least_count(n, least)
    frequent[WORD_SLOTS:] = True
    used = frequent[flat]
    names, flat = np.unique(flat[used], return_inverse=True)
    owner, worth = owner[used], worth[used]
    mean = (labels @ counts) / total
    w, g2, b, b2 = np.zeros(len(names)), np.full(len(names), 1e-6), math.log((mean + 1e-3) / (1 - mean + 1e-3)), 1e-6
    for _ in range(epochs * 4):
        score = b + np.bincount(owner, w[flat] * worth, n)
        error = (1 / (1 + np.exp(-np.clip(score, -30, 30))) - labels) * counts
        grad = np.bincount(flat, error[owner] * worth, len(names)) / total + ridge * w
        g2 += grad * grad
        w -= step * grad / np.sqrt(g2)
        top = error.sum() / total
        b2 += top * top
        b -= step * top / math.sqrt(b2)
    weights[names] = w
    return weights, float(b)


@dataclass
class Classifier:
    insults: frozenset
    labels: LabelModel
    weights: np.ndarray
    bias: float

    def score(self, votes: list[int], slots: list[bytes]) -> tuple[list[float], list[float]]:
        """Quality (0 to 1) and weak label (probability of bad) of texts by their votes and features."""
        quality = []
        for v, own in zip(votes, slots, strict=True):
            at = np.frombuffer(own, np.int32)
            score = self.bias + float(self.weights[at] @ values_of(at))
            quality.append(0.0 if v < 0 else 1 / (1 + math.exp(min(50.0, max(-50.0, score)))))
        return quality, self.labels.posterior(np.array(votes, np.int64)).tolist()


def draw(key, salt: str):
    """A number in [0, 1) from an id."""
    return F.pmod(F.xxhash64(F.coalesce(key.cast("string"), F.lit("")), F.lit(salt)), F.lit(1 << 30)) / F.lit(float(1 << 30))


def learn_insults(docs: DataFrame, labels: DataFrame, id_col: str, text_col: str, toxic_col: str = "toxic", rows: int = LEXICON_ROWS, least: int = 6, ratio: float = 25.0) -> frozenset:
    """Words in ``least`` or more toxic rows of the sample and ``ratio`` times as frequent there as in its other rows."""
    marks = labels.select(F.col(f"`{id_col}`").alias("id"), F.col(f"`{toxic_col}`").cast("int").alias("toxic")).where("id is not null and toxic is not null")
    marks = marks.where(draw(F.col("id"), "insults") < min(1.0, rows / max(1, marks.count())))
    texts = docs.select(F.col(f"`{id_col}`").alias("id"), F.col(f"`{text_col}`").alias("text")).where("text is not null")
    # the sample is bounded by ``rows``, so it may be sent to where the texts are
    held = texts.join(F.broadcast(marks.groupBy("id").agg(F.max("toxic").alias("toxic"))), "id").select("toxic", "text")
    schema = T.StructType([T.StructField("copy", T.LongType()), T.StructField("words", T.ArrayType(T.BinaryType()))])

    def words(texts: list[bytes]) -> dict[str, list]:
        out: dict[str, list] = {"copy": [], "words": []}
        for text in texts:
            own = text.split()
            out["words"].append(list({fold(w.strip(STRIP)) for w in own}))
            # copies share nearly all runs of five words, and so the least of their hashes
            out["copy"].append(min(map(zlib.crc32, map(b" ".join, zip(*(own[i:] for i in range(5))))), default=zlib.crc32(text)))
        return out

    seen = materialize(map_columns(held, ["toxic"], "text", "string", schema, words).dropDuplicates(["toxic", "copy"]).select("toxic", "words"), "insults")
    sides = {r["toxic"] > 0: r["n"] for r in seen.groupBy("toxic").agg(F.count("*").alias("n")).collect()}
    if not sides.get(True) or not sides.get(False):
        return INSULTS
    each = seen.select("toxic", F.explode("words").alias("word")).groupBy("word").agg(F.sum((F.col("toxic") > 0).cast("long")).alias("on"), F.sum((F.col("toxic") <= 0).cast("long")).alias("off"))
    much = (F.col("on") / sides[True]) >= ratio * (F.col("off") + 0.5) / sides[False]
    found = frozenset(bytes(r["word"]) for r in each.where((F.col("on") >= least) & much & (F.length("word") > 3)).select("word").collect())
    drop_materialized(seen)
    return INSULTS | found


FEATURES = T.StructType([T.StructField("__votes", T.IntegerType()), T.StructField("__slots", T.BinaryType())])


def read_features(docs: DataFrame, keys: list[str], text_col: str, insults: frozenset) -> DataFrame:
    """Columns ``keys``, votes and features of every row, read once and written: the model is fitted on them and scores them."""

    def step(texts: list[bytes]) -> dict[str, list]:
        reader = Reader(insults)
        rows = [reader.features(t) for t in texts]
        return {"__votes": [v for v, _ in rows], "__slots": [s.astype(np.int32).tobytes() for _, s in rows]}

    return materialize(map_columns(docs, keys, text_col, "string", FEATURES, step), "quality")


def fit(read: DataFrame, insults: frozenset = INSULTS, id_col: str = "doc_id", fit_rows: int = FIT_ROWS) -> Classifier:
    """Label model from the votes of all rows of :func:`read_features`, scorer from about ``fit_rows`` of them and those of rare patterns."""
    found = read.groupBy("__votes").agg(F.count("*").alias("n")).collect()
    patterns, counts = np.array([r["__votes"] for r in found], np.int64), np.array([r["n"] for r in found], np.int64)
    model = fit_labels(patterns, counts)
    share = min(1.0, fit_rows / max(1, int(counts.sum())))
    # what share of a pattern's rows is taken: of patterns with few rows more, at most 2 ** labellers times STRATUM rows in all
    wider = [x for r in found if r["__votes"] >= 0 and STRATUM / r["n"] > share for x in (F.lit(r["__votes"]), F.lit(min(1.0, STRATUM / r["n"])))]
    least = F.coalesce(F.create_map(*wider)[F.col("__votes")], F.lit(share)) if wider else F.lit(share)
    sample = read.where("__votes >= 0").where(draw(F.col(f"`{id_col}`"), "quality") < least).select("__votes", "__slots").collect()
    sample.sort(key=lambda r: (r["__votes"], r["__slots"]))
    own = np.array([r["__votes"] for r in sample], np.int64)
    weak = model.posterior(own) if sample else np.zeros(0)
    return Classifier(insults, model, *fit_scorer([np.frombuffer(r["__slots"], np.int32) for r in sample], weak, counts=row_weights(own) if sample else None))


SCORES = T.StructType([T.StructField("quality", T.DoubleType()), T.StructField("weak_bad", T.DoubleType()), T.StructField("kept", T.BooleanType())])


def _scored(docs: DataFrame, keys: list[str], labels: DataFrame | None, id_col: str, text_col: str, fit_rows: int) -> tuple[DataFrame, Classifier]:
    insults = learn_insults(docs, labels, id_col, text_col) if labels is not None else INSULTS
    read = read_features(docs, keys, text_col, insults)
    return read, fit(read, insults, id_col, fit_rows)


def classify(docs: DataFrame, labels: DataFrame | None = None, id_col: str = "doc_id", text_col: str = "text", threshold: float = THRESHOLD, fit_rows: int = FIT_ROWS) -> DataFrame:
    """``id_col``, ``quality``, ``weak_bad`` and ``kept`` for every row; extra columns are ignored."""
    read, model = _scored(docs, [id_col], labels, id_col, text_col, fit_rows)
    shared = docs.sparkSession.sparkContext.broadcast(model)  # of fixed size
    schema = T.StructType([read.schema[id_col], *SCORES.fields])

    def run(batches):
        import pyarrow as pa

        for batch in batches:
            quality, weak = shared.value.score(batch.column(1).to_pylist(), batch.column(2).to_pylist())
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(quality, pa.float64()), pa.array(weak, pa.float64()), pa.array([q >= threshold for q in quality], pa.bool_())], names=schema.fieldNames())

    return read.select(f"`{id_col}`", "__votes", "__slots").mapInArrow(run, schema)


def keep_good(docs: DataFrame, labels: DataFrame | None = None, id_col: str = "doc_id", text_col: str = "text", threshold: float = THRESHOLD, fit_rows: int = FIT_ROWS) -> DataFrame:
    """Rows of ``docs`` that the classifier keeps, with all their columns."""
    read, model = _scored(docs, docs.columns, labels, id_col, text_col, fit_rows)
    shared = docs.sparkSession.sparkContext.broadcast(model)
    n = len(docs.columns)

    def run(batches):
        import pyarrow as pa

        for batch in batches:
            keep = [q >= threshold for q in shared.value.score(batch.column(n).to_pylist(), batch.column(n + 1).to_pylist())[0]]
            yield pa.RecordBatch.from_arrays(batch.columns[:n], names=batch.schema.names[:n]).filter(pa.array(keep, pa.bool_()))

    return read.mapInArrow(run, docs.schema)
