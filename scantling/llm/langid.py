"""Language ID by inference of mixtures.

Each language has a model of hashed byte n-grams (one to three bytes, folded to lower case in ASCII and Latin-1), learned from
labelled rows. A document is a row of segments of equal length; each segment comes from one language, and expectation-maximisation
over the segments' n-gram likelihoods, run until no proportion moves by more than ``TOLERANCE`` (``ROUNDS`` steps at most), estimates the proportions
of languages. A set of languages grows by the one that most raises the likelihood, for as long as the likelihood less a penalty
for each language rises; a set may hold any number of them. The prediction is the language of
the greatest share in that set, and its score that share.

The models are fitted on a bounded sample: at most about ``per_language`` labelled rows of each language, chosen by a hash of the
id, each with its whole text; the counts that set the share drawn come from all rows. Every document is predicted from its
whole text; its score depends on nothing but the text and the model.

Null text or text without letters: ``und``, score 0. No labelled rows at all: ``und`` for all. Rows with a null id are predicted
and never learned from. Repeated rows: a prediction each, all alike. No rows: no rows. Ties go to the lesser language by code points.
"""

from __future__ import annotations

import re
from dataclasses import dataclass

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from scantling.llm.util import map_columns

SLOTS_LOG2, SEGMENT, SLICE, PENALTY, SMOOTH = 16, 64, 1 << 18, 6.0, 0.05
#: Expectation-maximisation ends when no share of a text moves by more than this.
TOLERANCE, ROUNDS = 1e-4, 1000
PER_LANGUAGE = 1500
UNKNOWN = "und"
LETTER = re.compile(rb"[A-Za-z\x80-\xff]")
FOLD = bytes(b + 32 if 65 <= b <= 90 else b for b in range(256))

PREDICTION = T.StructType([
    T.StructField("lang_pred", T.StringType()), T.StructField("score", T.DoubleType()), T.StructField("lang_set", T.StringType()),
])


def has_letter(text: bytes) -> bool:
    """Whether a text in UTF-8 has a letter of any script."""
    found = LETTER.search(text)
    return bool(found) and (found[0] < b"\x80" or re.search(rb"[A-Za-z]", text) is not None or any(c.isalpha() for c in text.decode("utf-8", "replace")))


def grams(data: np.ndarray) -> np.ndarray:
    """Slot of the n-gram that ends at each byte: rows for n of 1, 2 and 3. What would reach before the start is as if space."""
    x = np.concatenate([np.full(2, 32, np.uint8), data]).astype(np.uint32)
    one, two, three = x[2:], x[1:-1] << 8 | x[2:], x[:-2] << 16 | x[1:-1] << 8 | x[2:]
    shift = np.uint32(32 - SLOTS_LOG2)
    rows = [(v + np.uint32(n << 25)) * np.uint32(2654435761) >> shift for n, v in enumerate((one, two, three))]
    return np.stack(rows).astype(np.int32)


@dataclass
class Model:
    """Log-likelihoods: a row for each slot, a column for each language."""

    languages: list[str]
    logs: np.ndarray

    def segments(self, texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """Log-likelihood of each segment under each language, and where each text's segments begin (and the end).

        Texts are taken in slices of about ``SLICE`` bytes together; two bytes before a slice (spaces before a text) are its context.
        """
        out: list[np.ndarray] = []
        held: list[bytes] = []
        begins: list[int] = []
        context: list[int] = []
        size = 0

        def flush() -> None:
            nonlocal size
            slots = grams(np.frombuffer(b"".join(held), np.uint8))
            # n-grams overlap and so count a shared byte three times: their mean is nearer to the truth
            each = (self.logs[slots[0]] + self.logs[slots[1]] + self.logs[slots[2]]) / 3
            each[context] = 0
            out.append(np.add.reduceat(each, begins, axis=0))
            held.clear(), begins.clear(), context.clear()
            size = 0

        for text in texts:
            folded = text.translate(FOLD)
            for a in range(0, len(folded), SLICE):
                piece = (folded[a - 2 : a] if a else b"  ") + folded[a : a + SLICE]
                held.append(piece)
                context += [size, size + 1]
                begins += range(size + 2, size + len(piece), SEGMENT)
                size += len(piece)
                if size >= SLICE:
                    flush()
        if held:
            flush()
        counts = np.array([-(-len(t) // SEGMENT) for t in texts])
        return np.concatenate(out), np.concatenate([[0], np.cumsum(counts)])

    def mixtures(self, logs: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Shares of each language (0: not in the set) for each text; texts have a segment at least."""
        n, k = len(ends) - 1, len(self.languages)
        top = logs.max(1, keepdims=True)
        likelihood = np.exp(np.maximum(logs - top, -60))
        starts, sizes = ends[:-1], np.diff(ends)
        owner = np.repeat(np.arange(n), sizes)
        base = np.add.reduceat(top[:, 0], starts)

        def fit(mask: np.ndarray, rows: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
            """Shares and log-likelihood under these sets of languages, of these texts."""
            own = np.flatnonzero(np.isin(owner, rows)) if len(rows) < n else np.arange(len(owner))
            place = np.searchsorted(rows, owner[own])
            at = np.concatenate([[0], np.cumsum(sizes[rows])[:-1]])
            like = likelihood[own] * mask[place]
            share = mask / mask.sum(1, keepdims=True)
            live = np.arange(len(rows))  # texts whose shares still move, with their segments
            seg, seg_place, seg_at = like, place, at
            for _ in range(ROUNDS):
                weighed = seg * share[live][seg_place]
                total = weighed.sum(1, keepdims=True) + 1e-300
                new = np.add.reduceat(weighed / total, seg_at, axis=0) / sizes[rows[live]][:, None]
                moves = np.abs(new - share[live]).max(1) > TOLERANCE
                share[live] = new
                if moves.all():
                    continue
                live = live[moves]
                if not len(live):
                    break
                stays = moves[seg_place]
                seg, seg_place = seg[stays], np.repeat(np.arange(len(live)), sizes[rows[live]])
                seg_at = np.concatenate([[0], np.cumsum(sizes[rows[live]])[:-1]])
            total = (like * share[place]).sum(1) + 1e-300
            return share, np.add.reduceat(np.log(total), at) + base[rows]

        alone = np.add.reduceat(logs, starts, axis=0)
        first = alone.argmax(1)
        mask = np.zeros((n, k))
        mask[np.arange(n), first] = 1
        best, share = alone.max(1) - PENALTY, mask.copy()
        open_ = np.arange(n)
        while True:
            # no set does better than each segment's own best language, and a larger one costs another penalty
            limit = base[open_] - PENALTY * (mask[open_].sum(1) + 1)
            open_ = open_[limit > best[open_]]
            open_ = open_[mask[open_].sum(1) < k]
            if not len(open_):
                break
            gain, gain_share, gain_mask = np.full(len(open_), -np.inf), share[open_].copy(), mask[open_].copy()
            for j in range(k):
                new = np.flatnonzero(mask[open_, j] == 0)
                if not len(new):
                    continue
                tried = mask[open_[new]].copy()
                tried[:, j] = 1
                s, value = fit(tried, open_[new])
                value -= PENALTY * tried.sum(1)
                better = value > gain[new]
                at = new[better]
                gain[at], gain_share[at], gain_mask[at] = value[better], s[better], tried[better]
            up = gain > best[open_]
            rows = open_[up]
            best[rows], share[rows], mask[rows] = gain[up], gain_share[up], gain_mask[up]
            open_ = rows
        return share, mask

    def predict(self, texts: list[bytes]) -> list[tuple[str, float, str]]:
        out: list[tuple[str, float, str]] = [(UNKNOWN, 0.0, "")] * len(texts)
        rows = [i for i, t in enumerate(texts) if has_letter(t)] if self.languages else []
        if rows:
            share, mask = self.mixtures(*self.segments([texts[i] for i in rows]))
            chosen = share.argmax(1)
            for i, row, c, m in zip(rows, share, chosen, mask, strict=True):
                out[i] = (self.languages[c], float(min(1.0, row[c])), ",".join(x for x, on in zip(self.languages, m, strict=True) if on))
        return out


def held_out(id_col: Column) -> Column:
    """Whether CRC-32 of the id as text has remainder 2 by 4; a null id is not."""
    return F.coalesce(F.crc32(id_col.cast("string").cast("binary")) % 4 == 2, F.lit(False))


def fit(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", per_language: int = PER_LANGUAGE) -> Model:
    """A model from rows that aren't held out and have an id, a text and a language; see the module for the sample and its bound."""
    known = docs.select(F.col(f"`{id_col}`").alias("id"), F.col(f"`{text_col}`").alias("text"), F.col(f"`{lang_col}`").cast("string").alias("lang"))
    known = known.where("id is not null and text is not null and lang is not null").where(~held_out(F.col("id")))
    counts = {r["lang"]: r["n"] for r in known.groupBy("lang").agg(F.count("*").alias("n")).collect()}
    languages = sorted(counts)
    slots = 1 << SLOTS_LOG2
    if not languages:
        return Model([], np.zeros((slots, 0), np.float32))
    place = F.create_map(*[x for lang in languages for x in (F.lit(lang), F.lit(languages.index(lang)))])
    share = F.create_map(*[x for lang, n in counts.items() for x in (F.lit(lang), F.lit(min(1.0, per_language / n)))])
    draw = F.pmod(F.xxhash64(F.col("id").cast("string"), F.lit("langid")), F.lit(1 << 30)) / F.lit(float(1 << 30))
    sample = known.where(draw < share[F.col("lang")]).select(place[F.col("lang")].alias("lang"), F.col("text").cast("binary").alias("head"))
    schema = T.StructType([T.StructField("lang", T.IntegerType()), T.StructField("slot", T.IntegerType()), T.StructField("n", T.LongType())])

    def count(batches):
        import pyarrow as pa

        sums: dict[int, np.ndarray] = {}
        for batch in batches:
            for lang, head in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                if head:
                    own = sums.setdefault(lang, np.zeros(slots, np.int64))
                    own += np.bincount(grams(np.frombuffer(head.translate(FOLD), np.uint8)).ravel(), minlength=slots)
        for lang, own in sums.items():
            at = np.flatnonzero(own)
            yield pa.RecordBatch.from_arrays([pa.array(np.full(len(at), lang), pa.int32()), pa.array(at, pa.int32()), pa.array(own[at], pa.int64())], ["lang", "slot", "n"])

    # at most a row for each slot and language comes to the driver
    found = sample.mapInArrow(count, schema).groupBy("lang", "slot").agg(F.sum("n").alias("n")).toPandas()
    table = np.zeros((slots, len(languages)))
    table[found["slot"].to_numpy(), found["lang"].to_numpy()] = found["n"].to_numpy()
    overall = table.sum(1) + 0.5
    prior = overall / overall.sum()
    total = table.sum(0)
    smooth = np.maximum(SMOOTH * total, 1000)
    logs = np.log((table + smooth * prior[:, None]) / (total + smooth))
    return Model(languages, logs.astype(np.float32))


def predict(docs: DataFrame, model: Model, id_cols: list[str], text_col: str = "text") -> DataFrame:
    """Key columns, ``lang_pred``, ``score`` and ``lang_set`` for every row; other columns aren't looked at."""
    shared = docs.sparkSession.sparkContext.broadcast(model)  # its size is fixed by slots and languages

    def step(texts: list[bytes]) -> dict[str, list]:
        rows = shared.value.predict(texts)
        return dict(zip(PREDICTION.fieldNames(), map(list, zip(*rows, strict=True)), strict=True))

    return map_columns(docs, id_cols, text_col, "string", PREDICTION, step, most=1 << 19)


def identify(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang") -> DataFrame:
    """Fit, then ``id_col``, ``held_out``, ``lang_pred``, ``score`` and ``lang_set`` for every row."""
    model = fit(docs, id_col, text_col, lang_col)
    return predict(docs, model, [id_col], text_col).select(id_col, held_out(F.col(f"`{id_col}`")).alias("held_out"), "lang_pred", "score", "lang_set")


def keep_identified(docs: DataFrame, least_score: float = 0.5, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang") -> DataFrame:
    """Rows of ``docs`` with a language of at least this share, all columns kept; ``und`` and even mixtures go."""
    model = fit(docs, id_col, text_col, lang_col)
    shared = docs.sparkSession.sparkContext.broadcast(model)
    at = docs.columns.index(text_col)

    def run(batches):
        import pyarrow as pa

        from scantling.llm.util import give_back, slices, texts_of

        for batch in batches:
            texts = texts_of(batch.column(at))
            keep = []
            for a, b in slices([len(t) for t in texts], 1 << 19):
                keep += [lang != UNKNOWN and score >= least_score for lang, score, _ in shared.value.predict(texts[a:b])]
            yield batch.filter(pa.array(keep, pa.bool_()))
        batch = texts = None
        give_back()

    return docs.mapInArrow(run, docs.schema)
