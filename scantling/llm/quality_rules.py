"""Quality rules with compression bands.

A text is kept if it passes the base rules and if its zstandard ratio (compressed bytes by raw bytes) lies within the band for
its length, both for the whole text and for nearly all of its fixed chunks. Too low a ratio is repetition, too high a ratio is
noise such as keys or encoded binary. Short texts compress worse, since a frame costs some ten bytes and there is little to
refer back to, so the limits depend on the length.

Chunks cover the whole text. What is left behind the last full chunk is a chunk of its own, judged by the band of texts of its
length; where it is shorter than any band it belongs to the chunk before it. A text fails by its chunks if more than ``CHUNK_SHARE`` of its
bytes lie in chunks outside their band.

Null or empty text: no words, so ``base_failed`` and not kept; both ratios are null. Repeated rows are judged one by one.
"""

from __future__ import annotations

from bisect import bisect_right

import numpy as np
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import types as T

from scantling.llm.util import map_columns

SYMBOLS = b"#*$%&|<>"
#: (from this many bytes on, least ratio, greatest ratio) of whole texts; below the first length there is no band.
BANDS = (
    (64, 0.40, 1.20), (128, 0.36, 1.02), (256, 0.32, 0.94), (512, 0.30, 0.86),
    (1024, 0.28, 0.80), (4096, 0.26, 0.76), (16384, 0.22, 0.74),
)
CHUNK_BYTES, CHUNK_BAND, CHUNK_SHARE, LEVEL = 1024, (0.30, 0.84), 0.25, 3

SCHEMA = T.StructType([
    *(T.StructField(n, T.LongType()) for n in ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")),
    T.StructField("base_failed", T.BooleanType()), T.StructField("whole_ratio", T.DoubleType()),
    T.StructField("n_chunks", T.LongType()), T.StructField("n_bad_chunks", T.LongType()),
    T.StructField("verdict", T.StringType()), T.StructField("kept", T.BooleanType()),
])


def repeated_words(words: list[bytes]) -> int:
    """Words that lie in a window of three words found twice or more, the first finding included."""
    n = len(words)
    if n < 4:
        return 0
    number: dict[bytes, int] = {}
    ids = np.fromiter((number.setdefault(w, len(number)) for w in words), np.int64, n)
    if len(number) == n:
        return 0
    v = len(number)
    # (a, b) and then c: each step is below 2**63 as a text has under 2**31 words
    pair = ids[:-2] * v + ids[1:-1]
    _, pair = np.unique(pair, return_inverse=True)
    _, where, counts = np.unique(pair * v + ids[2:], return_inverse=True, return_counts=True)
    twice = counts[where] > 1
    marked = np.zeros(n, bool)
    for k in range(3):
        marked[k : n - 2 + k] |= twice
    return int(marked.sum())


def base_counts(text: bytes) -> tuple[int, int, int, int, int]:
    """n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words of a text in UTF-8."""
    words = text.split()
    joined = b"".join(words)
    chars = len(joined) if joined.isascii() else len(joined.decode("utf-8", "replace"))
    symbols = len(joined) - len(joined.translate(None, SYMBOLS))
    seen: set[bytes] = set()
    lines = dup = 0
    for line in text.split(b"\n"):
        if line and not line.isspace():
            lines += 1
            seen.add(line)
    dup = lines - len(seen)
    return len(words), chars, symbols, dup, repeated_words(words)


class Bands:
    """Judges texts by their zstandard ratios."""

    def __init__(self, bands=BANDS, chunk_bytes=CHUNK_BYTES, chunk_band=CHUNK_BAND, chunk_share=CHUNK_SHARE, level=LEVEL):
        self.starts, self.bands = [b[0] for b in bands], bands
        self.chunk_bytes, self.chunk_band, self.chunk_share = chunk_bytes, chunk_band, chunk_share
        self.compress = zstandard.ZstdCompressor(level=level, write_checksum=False, write_content_size=False).compress

    def ratio(self, data: bytes) -> float:
        return len(self.compress(data)) / len(data)

    def band(self, size: int) -> tuple[float, float]:
        """Limits of a chunk of so many bytes."""
        if size >= self.chunk_bytes:
            return self.chunk_band
        k = bisect_right(self.starts, size)
        return self.bands[k - 1][1:] if k else (0.0, float("inf"))

    def judge(self, text: bytes) -> tuple[float | None, int, int, str]:
        """Whole ratio, chunks, chunks outside their band, verdict. Texts below the first length have no band and pass."""
        if not text:
            return None, 0, 0, "empty"
        whole, verdict = self.ratio(text), "kept"
        if k := bisect_right(self.starts, len(text)):
            _, least, most = self.bands[k - 1]
            verdict = "repetitive" if whole < least else "incompressible" if whole > most else "kept"
        bad = chunks = bad_bytes = 0
        size = self.chunk_bytes
        full, tail = divmod(len(text), size)
        ends = [size * (k + 1) for k in range(full)]
        if tail and (not ends or tail >= self.starts[0]):
            ends.append(len(text))
        elif tail:
            ends[-1] = len(text)
        at = 0
        for end in ends:
            least, most = self.band(end - at)
            chunks += 1
            if not least <= self.ratio(text[at:end]) <= most:
                bad += 1
                bad_bytes += end - at
            at = end
        if verdict == "kept" and bad_bytes > self.chunk_share * len(text):
            verdict = "chunks"
        return whole, chunks, bad, verdict


def apply_rules(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", min_words: int = 50, max_repeat_percent: int = 50, **bands) -> DataFrame:
    """``id_col`` with counts, ratios, verdict and ``kept`` for every row of ``docs``; extra columns are ignored."""
    names = SCHEMA.fieldNames()

    def step(texts: list[bytes]) -> dict[str, list]:
        judge = Bands(**bands)
        rows = []
        for text in texts:
            n, chars, symbols, dup, repeat = base_counts(text)
            failed = n < min_words or 100 * repeat > max_repeat_percent * n
            whole, chunks, bad, verdict = judge.judge(text)
            rows.append((n, chars, symbols, dup, repeat, failed, whole, chunks, bad, verdict, not failed and verdict == "kept"))
        return dict(zip(names, map(list, zip(*rows, strict=True)), strict=True))

    return map_columns(docs, [id_col], text_col, "string", SCHEMA, step)
