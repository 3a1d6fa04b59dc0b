"""SimHash near-duplicates, compared by bit planes.

Fingerprints are 64 bits over three-word shingles. Those within ``radius`` bits link; documents in one component of links are
near-duplicates of each other.

Candidates: the 64 bits are cut into ``2 * radius`` blocks, and any two fingerprints within the radius agree in at least
``radius`` blocks whole, so fingerprints meet under a key for each choice of ``radius`` blocks (for radius 2: six keys of 32
bits). A bucket with more than ``bucket_limit`` distinct fingerprints is parted in the same way by the bits that its key leaves free, of
which again those of two near fingerprints agree in half: 32, then 16, then 8 are free, and a bucket has at most 256 fingerprints, however the data are.

Every pair of a bucket is compared in bit planes, whatever the bucket's size. The buckets of a task stand one behind the other in shared
planes: word w of plane b holds bit b of 64 fingerprints. For each distance d the planes are compared with themselves shifted by
d places, so that each lane holds the pair of a fingerprint and the d-th behind it; lanes whose two lie in different buckets are
masked. Differing bits are added by carry-save adders into vertical counters, and after each few planes words are abandoned whose
lanes are all masked or past the radius.

Only distinct fingerprints take part, so exact copies cost nothing. A bucket gives the edges of a forest over its links, not all pairs.

Null or empty text, or one of white space: no shingles, fingerprint zero, linked like any other. Repeated rows: same fingerprint.
Rows with a null id have a fingerprint and link others, and their component is the least id that is not null (null if there is none).
No rows: no rows.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from itertools import combinations, repeat

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from scantling.llm.util import map_columns, materialize, scratch
from scantling.operators.graph import components

SHINGLE, SEED, RADIUS, BUCKET_LIMIT, STRIDE, LEVELS = 3, 42, 2, 1024, 8, 3
FINGERPRINT = T.StructType([T.StructField("fp", T.LongType())])
PIECE = 1 << 20
SPACE = re.compile(rb"[\x20\x09-\x0d]")


def pieces(text: bytes, size: int = PIECE) -> Iterator[list[bytes]]:
    """The words of a text, some ``size`` bytes of it at a time."""
    at = 0
    while at < len(text):
        m = SPACE.search(text, at + size)
        end = m.start() if m else len(text)
        yield text[at:end].split()  # of bytes: at space and 9 to 13 only
        at = end


def fingerprint(text: bytes, words_in_shingle: int = SHINGLE) -> int:
    """SimHash of a text in UTF-8, unsigned: a bit is set if it is set in over half of the shingles' hashes."""
    counts, n, words = np.zeros(64, np.int64), 0, []
    for piece in pieces(text.lower()):  # of bytes: A-Z only
        words += piece
        if len(words) < words_in_shingle:
            continue
        hashes = np.fromiter(map(xxhash.xxh64_intdigest, map(b" ".join, zip(*(words[i:] for i in range(words_in_shingle)))), repeat(SEED)), np.uint64)
        for a in range(0, len(hashes), 1 << 16):
            counts += np.unpackbits(hashes[a : a + (1 << 16)].astype("<u8").view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(0, dtype=np.int64)
        n += len(hashes)
        words = words[len(words) - words_in_shingle + 1 :]
    if not n:
        return xxhash.xxh64_intdigest(b" ".join(words), SEED) if words else 0
    return int(np.packbits(counts * 2 > n, bitorder="little").view("<u8")[0])


def fingerprints(docs: DataFrame, id_cols: list[str] | None = None, text_col: str = "text") -> DataFrame:
    """Key columns and ``fp`` (the fingerprint's 64 bits as a long) for every row."""

    def step(texts: list[bytes]) -> dict[str, list]:
        return {"fp": np.array([fingerprint(t) for t in texts], np.uint64).view(np.int64)}

    return map_columns(docs, id_cols or ["doc_id"], text_col, "string", FINGERPRINT, step)


def planes_of(fps: np.ndarray) -> np.ndarray:
    """Bit planes: row b, word w holds bit b of fingerprints 64w to 64w + 63. The last word is filled with zero fingerprints."""
    n = -(-len(fps) // 64)
    padded = np.zeros(n * 64, np.uint64)
    padded[: len(fps)] = fps
    bits = np.unpackbits(padded.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
    return np.ascontiguousarray(np.packbits(bits.T.reshape(64, n, 64), axis=2, bitorder="little")).view(np.uint64)[..., 0]


def lanes_of(marks: np.ndarray) -> np.ndarray:
    """A word for each 64 truth values."""
    padded = np.zeros(-(-len(marks) // 64) * 64, bool)
    padded[: len(marks)] = marks
    return np.packbits(padded, bitorder="little").view(np.uint64)


def shifted(planes: np.ndarray, words: np.ndarray, d: int) -> np.ndarray:
    """These words of the planes of the fingerprints ``d`` places further on; zeros behind the last."""
    far, bits = divmod(d, 64)
    n = planes.shape[1]
    at = words + far
    low = np.where(at < n, planes[:, np.minimum(at, n - 1)], np.uint64(0))
    if not bits:
        return low
    high = np.where(at + 1 < n, planes[:, np.minimum(at + 1, n - 1)], np.uint64(0))
    return low >> np.uint64(bits) | high << np.uint64(64 - bits)


def add_up(columns: list[list[np.ndarray]], over: np.ndarray) -> tuple[list[np.ndarray], np.ndarray]:
    """Carry-save addition: ``columns[i]`` are planes worth 2 ** i; one plane of each is left, what is worth more goes to ``over``."""
    out = []
    for i, planes in enumerate(columns):
        while len(planes) > 1:
            a, b = planes.pop(), planes.pop()
            half = a ^ b
            carry = a & b
            if planes:
                c = planes.pop()
                carry |= half & c
                half ^= c
            planes.append(half)
            if i + 1 < len(columns):
                columns[i + 1].append(carry)
            else:
                over = over | carry
        out.append(planes[0] if planes else np.zeros_like(over))
    return out, over


def within(planes: np.ndarray, lanes: np.ndarray, d: int, radius: int, bits: list[int], stride: int = STRIDE) -> tuple[np.ndarray, np.ndarray]:
    """Of the fingerprints in these ``lanes`` those from which the ``d``-th behind differs in ``radius`` of ``bits`` or fewer: words and lanes.

    Only ``bits`` are looked at. Words without such a lane are left out.
    """
    words = np.flatnonzero(lanes)
    live = lanes[words]
    digits = (radius + 1).bit_length()
    counters = [np.zeros(len(words), np.uint64) for _ in range(digits)]
    over = np.zeros(len(words), np.uint64)
    for start in range(0, len(bits), stride):
        if not len(words):
            break
        own = planes[bits[start : start + stride]]
        differ = own[:, words] ^ shifted(own, words, d)
        counters, over = add_up([[counters[0], *differ], *([c] for c in counters[1:])], over)
        # past the radius: counters that have overflowed, and those whose number is above it now
        above, equal = over, ~over
        for i in reversed(range(digits)):
            if radius >> i & 1:
                equal = equal & counters[i]
            else:
                above = above | equal & counters[i]
                equal = equal & ~counters[i]
        over = above
        live = live & ~over
        keep = np.flatnonzero(live)
        if len(keep) < len(words):
            words, live, over, counters = words[keep], live[keep], over[keep], [c[keep] for c in counters]
    return words, live


def forest(fps: np.ndarray, buckets: np.ndarray, radius: int, bits: list[int] | None = None) -> np.ndarray:
    """Edges (places in ``fps``, a row each) that join all that links within the buckets join: fewer than there are fingerprints.

    ``buckets`` rises; fingerprints of one bucket agree in all but ``bits``.
    """
    n = len(fps)
    bits = list(range(64)) if bits is None else bits
    parent = np.arange(n)
    edges: list[tuple[int, int]] = []

    def root(i: int) -> int:
        while parent[i] != i:
            parent[i] = parent[parent[i]]
            i = parent[i]
        return i

    # how many of its bucket stand behind each fingerprint
    starts = np.flatnonzero(np.append(True, buckets[1:] != buckets[:-1])) if n else np.zeros(0, int)
    sizes = np.diff(np.append(starts, n))
    behind = np.repeat(starts + sizes, sizes) - np.arange(n) - 1
    planes = planes_of(fps)
    for d in range(1, int(sizes.max(initial=1))):
        words, hits = within(planes, lanes_of(behind >= d), d, radius, bits)
        if not len(words):
            continue
        k, lane = np.nonzero(np.unpackbits(hits.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little"))
        i = words[k] * 64 + lane
        while (parent[parent] != parent).any():
            parent = parent[parent]
        for a in i[parent[i] != parent[i + d]].tolist():
            x, y = root(a), root(a + d)
            if x != y:
                parent[max(x, y)] = min(x, y)
                edges.append((a, a + d))
    return np.array(edges, np.int64).reshape(-1, 2)


def finer(mask: int, radius: int) -> list[int]:
    """Masks that fix half of the bits that ``mask`` leaves free, too: a mask for each choice of ``radius`` of ``2 * radius`` blocks of these."""
    free, n = free_bits(mask), 2 * radius
    cuts = [len(free) * i // n for i in range(n + 1)]
    return [mask | sum(1 << b for i in chosen for b in free[cuts[i] : cuts[i + 1]]) for chosen in combinations(range(n), radius)]


def free_bits(mask: int) -> list[int]:
    return [b for b in range(64) if not mask >> b & 1]


def signed(x: int) -> int:
    return x - (1 << 64) if x >> 63 else x


EDGES = T.StructType([T.StructField("u", T.LongType()), T.StructField("v", T.LongType())])


def compare_buckets(batches: Iterator[pa.RecordBatch], radius: int, rows: int = 1 << 15) -> Iterator[pa.RecordBatch]:
    """Edges of the buckets of a partition: rows of ``mask``, ``part`` and ``fp``, sorted. Whole buckets of one mask are compared together."""
    held: list[np.ndarray] = []
    n = 0

    def found(table: np.ndarray) -> pa.RecordBatch:
        fps = table[2].view(np.uint64)
        at = forest(fps, np.cumsum(np.append(False, table[1, 1:] != table[1, :-1])), radius, free_bits(int(table[0, 0]) & (1 << 64) - 1))
        return pa.RecordBatch.from_arrays([pa.array(table[2, at[:, 0]], pa.int64()), pa.array(table[2, at[:, 1]], pa.int64())], names=["u", "v"])

    def whole(last: bool) -> Iterator[pa.RecordBatch]:
        """Compares what is held but for the last bucket, which may go on; at the end that too."""
        nonlocal held, n
        table = np.concatenate(held, axis=1)
        cut = table.shape[1]
        if not last:
            cut = int(np.flatnonzero((table[:2] != table[:2, -1:]).any(0))[-1:].max(initial=-1)) + 1
        masks = np.flatnonzero(np.append(True, table[0, 1:cut] != table[0, : cut - 1])) if cut else []
        for a, b in zip(masks, [*masks[1:], cut], strict=False):
            yield found(table[:, a:b])
        held, n = [table[:, cut:]], table.shape[1] - cut

    for batch in batches:
        for a in range(0, batch.num_rows, rows):
            part = batch.slice(a, rows)
            held.append(np.stack([c.to_numpy() for c in part.columns]))
            n += part.num_rows
            if n >= rows:
                yield from whole(False)
    if n:
        yield from whole(True)


def link_edges(distinct: DataFrame, radius: int = RADIUS, bucket_limit: int = BUCKET_LIMIT) -> DataFrame:
    """Edges ``u``, ``v`` (fingerprints) that join what the links among distinct fingerprints ``fp`` join."""
    if radius < 1:
        raise ValueError("radius is 1 or more")
    spark = distinct.sparkSession
    masks, every, out = [0], distinct.select("fp", F.lit(0).cast("long").alias("mask")), None
    for level in range(LEVELS):
        # every mask is fixed by the radius and the step: 6, 36 and 216 of them for radius 2
        steps = spark.createDataFrame([(signed(m), signed(f)) for m in masks for f in finer(m, radius)], "mask long, finer long")
        masks = [f for m in masks for f in finer(m, radius)]
        banded = every.join(F.broadcast(steps), "mask").select(F.col("finer").alias("mask"), F.col("fp").bitwiseAND(F.col("finer")).alias("part"), "fp")
        sizes = materialize(banded.groupBy("mask", "part").agg(F.count("*").alias("n")).where("n > 1"), "simhash-sizes")
        shared = banded.join(sizes, ["mask", "part"])
        last = level == LEVELS - 1
        own = (shared if last else shared.where(F.col("n") <= bucket_limit)).select("mask", "part", "fp")
        edges = own.repartition("mask", "part").sortWithinPartitions("mask", "part", "fp").mapInArrow(lambda batches: compare_buckets(batches, radius), EDGES)
        out = edges if out is None else out.union(edges)
        if last or sizes.where(F.col("n") > bucket_limit).isEmpty():
            break
        every = shared.where(F.col("n") > bucket_limit).select("fp", "mask")
    return out


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", radius: int = RADIUS, bucket_limit: int = BUCKET_LIMIT) -> DataFrame:
    """``id_col``, ``fp`` and ``component_id`` (the least id reachable over links) for every row; extra columns are ignored."""
    with scratch(docs.sparkSession) as made:
        marks = made.keep(materialize(fingerprints(docs, [id_col], text_col).select(F.col(f"`{id_col}`").alias("id"), "fp"), "simhash"))
        heads = materialize(marks.groupBy("fp").agg(F.min("id").alias("head")), "simhash-distinct")
        edges = link_edges(heads.select("fp"), radius, bucket_limit)
        parts = materialize(components(edges), "simhash-parts")
        linked = parts.join(heads, F.col("node") == F.col("fp")).select("component", "fp", "head")
        least = linked.groupBy("component").agg(F.min("head").alias("least"))
        moved = linked.join(least, "component").select("fp", F.col("least").alias("label"))
        # written, so that the join below stands alone and Spark can split a fingerprint that very many documents share
        labels = made.keep(materialize(heads.join(moved, "fp", "left").select("fp", F.coalesce("label", "head").alias("component_id")), "simhash-labels"))
    return marks.join(labels, "fp").select(F.col("id").alias(id_col), "fp", "component_id")


def keep_one(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", **options) -> DataFrame:
    """Rows of ``docs`` whose id heads its component, all columns kept. Rows without an id are kept; rows that repeat an id stay."""
    found = near_duplicates(docs.where(F.col(f"`{id_col}`").isNotNull()), id_col, text_col, **options)
    gone = found.where(F.col("component_id") != F.col(f"`{id_col}`")).select(F.col(f"`{id_col}`").alias("__gone")).distinct()
    return docs.join(gone, F.col(f"`{id_col}`") == F.col("__gone"), "left_anti")
