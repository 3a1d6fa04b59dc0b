"""Byte-level BPE encoding and decoding from a public tokenizer file.

A short word is held as one contiguous array of part boundaries with, beside each, the rank of the pair that starts there. The
array is scanned for its least rank, the boundary in the middle of that pair is deleted and the two neighbouring ranks are
refreshed, until no pair has a rank. The words of a few MB of text that aren't known yet take these steps together, a row of one
matrix each. Words repeat, so a bounded table keeps what each was encoded to; long words use a heap in place of the scan, as a
scan for each merge grows with the square of the length.

Null text is an empty text: no tokens, and the digests of nothing. Added tokens of the file found in a text become their own
ids, as the file's library does without an option to the contrary. Tokenizers are read, never trained. Null ids and repeated rows: a row
each, alike. No rows: no rows.
"""

from __future__ import annotations

import hashlib
import heapq
import json
import re
import sys
import unicodedata
from functools import lru_cache
from itertools import chain

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import types as T

from scantling.llm.util import map_columns

NO_RANK = 1 << 60
LANE_NONE = 2**31 - 1
#: A pair of ids as one number: ids of up to 31 bits.
PAIR_SHIFT = 32
#: Words that are merged together at most.
LANES = 8192
ONE_BYTE = [bytes([b]) for b in range(256)]
LATIN, LATIN_END = 0x250, "\u0250"
#: Words of more parts than this are merged with a heap.
SCAN_PARTS = 96
#: White space as the pattern's engine has it.
SPACE = "\\t-\\r \\x85\\xa0\\u1680\\u2000-\\u200a\\u2028\\u2029\\u202f\\u205f\\u3000"


def default_path() -> str:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")


@lru_cache(maxsize=1)
def byte_symbols() -> dict[int, str]:
    """The printable sign that stands for each byte in the file: visible Latin-1 bytes stand for themselves."""
    own = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    rest = [b for b in range(256) if b not in set(own)]
    return {b: chr(b) for b in own} | {b: chr(256 + i) for i, b in enumerate(rest)}


@lru_cache(maxsize=2)
def word_pattern(below: int = sys.maxunicode + 1) -> re.Pattern:
    """The split into words: contractions, then runs of letters, numbers or other signs with a space before, then white space.

    For texts of code points under ``below`` alone: the shorter classes are several times faster.
    """

    def runs(kind: str) -> str:
        out, start = [], None
        for c in range(below + 1):
            if c < below and unicodedata.category(chr(c))[0] == kind:
                start = c if start is None else start
            elif start is not None:
                out.append(f"\\U{start:08x}-\\U{c - 1:08x}")
                start = None
        return "".join(out)

    letters, numbers = runs("L"), runs("N")
    return re.compile(
        f"'s|'t|'re|'ve|'m|'ll|'d| ?[{letters}]+| ?[{numbers}]+| ?[^{SPACE}{letters}{numbers}]+|[{SPACE}]+(?![^{SPACE}])|[{SPACE}]+"
    )


class Bpe:
    """Encodes and decodes with the vocabulary and merges of a tokenizer file."""

    def __init__(self, path: str, table_words: int = 200_000):
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        model = spec["model"]
        symbol_byte = {s: b for b, s in byte_symbols().items()}
        raw = lambda token: bytes(symbol_byte[c] for c in token)
        self.vocab: dict[bytes, int] = {raw(t): i for t, i in model["vocab"].items()}
        self.ranks: dict[tuple[bytes, bytes], int] = {}
        for rank, pair in enumerate(model["merges"]):
            left, right = pair.split(" ") if isinstance(pair, str) else pair
            self.ranks[raw(left), raw(right)] = rank
        self.added = {t["content"]: t["id"] for t in spec["added_tokens"]}
        self.bytes_of = {i: t for t, i in self.vocab.items()} | {i: t.encode() for t, i in self.added.items()}
        self.added_split = re.compile("(" + "|".join(map(re.escape, sorted(self.added, key=len, reverse=True))) + ")") if self.added else None
        self.added_probe = next(iter(self.added), None) if len(self.added) == 1 else None
        # the same ranks by a pair of ids in one number, for the words that are merged together
        pairs = sorted((self.vocab[a] << PAIR_SHIFT | self.vocab[b], r, self.vocab[a + b]) for (a, b), r in self.ranks.items())
        self.pair_keys = np.array([k for k, _, _ in pairs], np.int64)
        self.pair_ranks = np.array([r for _, r, _ in pairs] + [LANE_NONE], np.int32)
        self.merged = np.zeros(len(pairs) + 1, np.int32)
        self.merged[[r for _, r, _ in pairs]] = [i for _, _, i in pairs]
        self.byte_ids = np.array([self.vocab[bytes([b])] for b in range(256)], np.int32)
        self.near_space = re.compile("\\s\\s")
        self.table: dict[str, tuple[int, ...]] = {}
        self.table_words = table_words

    def parts(self, word: bytes) -> list[bytes]:
        """The parts that ``word`` is merged to."""
        if len(word) > SCAN_PARTS:
            return self.parts_by_heap(word)
        n, get = len(word), self.ranks.get
        bounds = list(range(n + 1))
        one = ONE_BYTE
        ranks = [get((one[a], one[b]), NO_RANK) for a, b in zip(word, word[1:])]
        while ranks:
            least = min(ranks)
            if least == NO_RANK:
                break
            at = ranks.index(least)
            # parts at and at + 1 become one: their boundary goes, and so does the rank that stood there
            del bounds[at + 1]
            del ranks[at]
            merged = word[bounds[at] : bounds[at + 1]]
            if at < len(ranks):
                ranks[at] = get((merged, word[bounds[at + 1] : bounds[at + 2]]), NO_RANK)
            if at:
                ranks[at - 1] = get((word[bounds[at - 1] : bounds[at]], merged), NO_RANK)
        return [word[a:b] for a, b in zip(bounds, bounds[1:])]

    def parts_by_heap(self, word: bytes) -> list[bytes]:
        """The same parts, in n log n steps."""
        n, get = len(word), self.ranks.get
        ends, nexts, prevs = list(range(1, n + 1)), list(range(1, n + 1)), list(range(-1, n - 1))
        heap = [(r, i, i + 1, i + 2) for i in range(n - 1) if (r := get((word[i : i + 1], word[i + 1 : i + 2]))) is not None]
        heapq.heapify(heap)
        alive = [True] * n
        while heap:
            _, i, j, end = heapq.heappop(heap)
            if not alive[i] or nexts[i] != j or j >= n or not alive[j] or ends[j] != end or ends[i] != j:
                continue
            ends[i], nexts[i], alive[j] = end, nexts[j], False
            if nexts[i] < n:
                prevs[nexts[i]] = i
                k = nexts[i]
                if (r := get((word[i:end], word[k : ends[k]]))) is not None:
                    heapq.heappush(heap, (r, i, k, ends[k]))
            if (p := prevs[i]) >= 0 and (r := get((word[p:i], word[i:end]))) is not None:
                heapq.heappush(heap, (r, p, i, end))
        return [word[i : ends[i]] for i in range(n) if alive[i]]

    def _pair_rank(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        key = left.astype(np.int64) << PAIR_SHIFT | right
        at = np.searchsorted(self.pair_keys, key)
        at[at == len(self.pair_keys)] = 0
        return np.where((self.pair_keys[at] == key) & (left >= 0) & (right >= 0), self.pair_ranks[at], LANE_NONE)

    def merge_together(self, words: list[bytes]) -> list[tuple[int, ...]]:
        """Ids of each word, all of up to SCAN_PARTS bytes: the steps of :meth:`parts` with a row for each word."""
        out: list[tuple[int, ...]] = [()] * len(words)
        order = sorted(range(len(words)), key=lambda i: len(words[i]))
        for start in range(0, len(order), LANES):
            own = np.array(order[start : start + LANES])
            lengths = np.array([len(words[i]) for i in own])
            width = int(lengths.max())
            flat = np.frombuffer(b"".join([words[i] for i in own]), np.uint8)
            inside = np.arange(width) < lengths[:, None]
            ids = np.full((len(own), width + 1), -1, np.int32)
            ids[:, :width][inside] = self.byte_ids[flat]
            ranks = self._pair_rank(ids[:, :-1], ids[:, 1:])
            while len(own):
                at = ranks.argmin(1)
                rows = np.arange(len(own))
                least = ranks[rows, at]
                if not (live := least < LANE_NONE).all():
                    done = ~live
                    counts = (ids[done] >= 0).sum(1)
                    for i, row, n in zip(own[done].tolist(), ids[done].tolist(), counts.tolist(), strict=True):
                        out[i] = tuple(row[:n])
                    own, ids, ranks, at, least = own[live], ids[live], ranks[live], at[live], least[live]
                    if not len(own):
                        break
                    rows = np.arange(len(own))
                before = np.arange(ranks.shape[1] - 1) < at[:, None]
                ids[rows, at] = self.merged[least]
                ids[:, 1:-1] = np.where(before, ids[:, 1:-1], ids[:, 2:])
                ids = ids[:, :-1]
                ranks = np.where(before, ranks[:, :-1], ranks[:, 1:])
                if not ranks.shape[1]:
                    ranks = np.full((len(own), 1), LANE_NONE, np.int32)
                    ids = np.hstack([ids, np.full((len(own), 1), -1, np.int32)])
                    continue
                right = np.minimum(at, ranks.shape[1] - 1)
                ranks[rows, right] = self._pair_rank(ids[rows, right], ids[rows, right + 1])
                left = np.maximum(at - 1, 0)
                ranks[rows, left] = self._pair_rank(ids[rows, left], ids[rows, left + 1])
        return out

    def _keys(self, text: str) -> list[str]:
        """Stretches of a text without added tokens. No word crosses a single space between two signs that aren't space."""
        if self.near_space.search(text) or text[:1].isspace():
            return [k for k in re.split(r"(?<=\S)(?= \S)", text) if k]
        head, *rest = text.split(" ")
        return [head, *map(" ".__add__, rest)]

    def _learn(self, keys: set[str]) -> None:
        """Put stretches and their words into the table."""
        table = self.table
        short = word_pattern(LATIN).findall
        found = {k: short(k) if max(k) < LATIN_END else word_pattern().findall(k) for k in keys}
        new = list({w for ws in found.values() for w in ws if w not in table})
        data = [w.encode("utf-8") for w in new]
        brief = [i for i, d in enumerate(data) if len(d) <= SCAN_PARTS]
        for i, ids in zip(brief, self.merge_together([data[i] for i in brief]), strict=True):
            table[new[i]] = ids
        for i in set(range(len(new))) - set(brief):
            table[new[i]] = tuple([self.vocab[p] for p in self.parts_by_heap(data[i])])
        for k, ws in found.items():
            if len(ws) != 1:
                table[k] = tuple(chain.from_iterable([table[w] for w in ws]))

    def encode_batch(self, texts: list[str], ordinary: bool = False) -> list[list[int]]:
        """Ids of each text; ``ordinary``: added tokens in it are text like any other. Stretches that are new are learned together."""
        parted: list[list[tuple[list[str], int | None]]] = []
        for text in texts:
            if not text or ordinary or self.added_split is None or (self.added_probe is not None and self.added_probe not in text):
                parted.append([(self._keys(text), None)] if text else [])
            else:
                parts = self.added_split.split(text)
                parted.append([([], self.added[p]) if k % 2 else (self._keys(p), None) for k, p in enumerate(parts) if p])
        table = self.table
        wanted = set().union(*[keys for stretch in parted for keys, _ in stretch])
        new = {k for k in wanted if k not in table}
        if new and len(table) + 2 * len(new) > self.table_words:
            table.clear()
            new = wanted
        self._learn(new)
        get, out = table.__getitem__, []
        for stretch in parted:
            ids: list[int] = []
            for keys, own in stretch:
                if own is None:
                    ids += chain.from_iterable(map(get, keys))
                else:
                    ids.append(own)
            out.append(ids)
        for k in [k for k in new if len(k) > 48]:
            table.pop(k, None)
        return out

    def encode(self, text: str) -> list[int]:
        return self.encode_batch([text])[0]

    def decode(self, ids) -> str:
        return b"".join(map(self.bytes_of.__getitem__, ids)).decode("utf-8", "replace")


_OPEN: dict[str, Bpe] = {}


def open_bpe(path: str) -> Bpe:
    """One encoder for each worker and file."""
    if path not in _OPEN:
        _OPEN.clear()
        _OPEN[path] = Bpe(path)
    return _OPEN[path]


DIGESTS = T.StructType([
    T.StructField("n_tokens", T.LongType()), T.StructField("ids_sha256", T.StringType()),
    T.StructField("decoded_sha256", T.StringType()), T.StructField("round_trip", T.BooleanType()),
])
IDS = T.StructType([T.StructField("ids", T.ArrayType(T.IntegerType(), False))])


def encode_documents(docs: DataFrame, id_cols: list[str] | None = None, text_col: str = "text", path: str | None = None, with_ids: bool = True) -> DataFrame:
    """Key columns, ``ids`` if asked for, and digests of ids and decoded text for every row; extra columns are ignored."""
    path = path or default_path()
    schema = T.StructType([*(IDS.fields if with_ids else []), *DIGESTS.fields])

    def step(texts: list[bytes]) -> dict[str, list]:
        bpe = open_bpe(path)
        out: dict[str, list] = {n: [] for n in schema.fieldNames()}
        digits = [str(i) for i in range(len(bpe.bytes_of) + 1)].__getitem__
        for data, ids in zip(texts, bpe.encode_batch([x.decode("utf-8", "replace") for x in texts]), strict=True):
            decoded = bpe.decode(ids).encode("utf-8")
            out["n_tokens"].append(len(ids))
            out["ids_sha256"].append(hashlib.sha256(",".join(map(digits, ids)).encode()).hexdigest())
            out["decoded_sha256"].append(hashlib.sha256(decoded).hexdigest())
            out["round_trip"].append(decoded == data)
            if with_ids:
                out["ids"].append(ids)
        return out

    return map_columns(docs, id_cols or ["doc_id"], text_col, "string", schema, step)


def decode_ids(df: DataFrame, id_cols: list[str], ids_col: str = "ids", path: str | None = None) -> DataFrame:
    """Key columns and ``text``, decoded from a column of ids (null: empty)."""
    path = path or default_path()
    frame = df.select(*[f"`{c}`" for c in id_cols], f"`{ids_col}`")
    out = T.StructType([*(frame.schema[c] for c in id_cols), T.StructField("text", T.StringType())])

    def run(batches):
        import pyarrow as pa
        from pyspark.sql.pandas.types import to_arrow_schema

        arrow = to_arrow_schema(out)
        for batch in batches:
            bpe = open_bpe(path)
            texts = [bpe.decode(x or ()) for x in batch.column(len(id_cols)).to_pylist()]
            held = [batch.column(i).cast(arrow.field(i).type) for i in range(len(id_cols))]
            yield pa.RecordBatch.from_arrays([*held, pa.array(texts, pa.string()).cast(arrow.field(len(id_cols)).type)], schema=arrow)

    return frame.mapInArrow(run, out)
