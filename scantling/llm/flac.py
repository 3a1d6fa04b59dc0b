"""FLAC media columns: payloads stored as 8-bit mono FLAC and read back as PCM blocks with sample offsets.

The decoder reads Rice residuals and the predictors (constant, verbatim, fixed, linear with stored coefficients) of many frames
at once: a frame is a lane, and each step decodes the next residual of every lane. Lanes need the place of each frame, so a
stream carries a seek table with a point for every frame: sample offset, byte offset, samples. Both checksums of each frame
(CRC-8 of the header, CRC-16 of the frame) and the MD5 of the samples are verified; a stream that fails is an error.

Bytes are samples less 128, as FLAC's samples have signs. Equal payloads give equal streams.

Null or empty text: 64 zero bytes. Repeated rows and repeated or null ids: a row each, alike. No rows: no rows. A stream that is cut
off, damaged or without a seek point for each frame raises :class:`Broken`.
"""

from __future__ import annotations

import hashlib
import zlib
from functools import lru_cache

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from scantling.llm.util import map_columns

BLOCK, RATE, PARTS_LOG2 = 1024, 8000, 2
#: Code of a block's size in a frame's header: 1024 has its own, other sizes follow the header in 16 bits.
SIZE_CODE = {1024: 10}


@lru_cache(maxsize=1)
def crc8_table() -> np.ndarray:
    out = np.arange(256, dtype=np.uint16)
    for _ in range(8):
        out = np.where(out & 0x80, out << 1 ^ 0x07, out << 1) & 0xFF
    return out.astype(np.uint8)


@lru_cache(maxsize=1)
def crc16_table() -> np.ndarray:
    out = np.arange(256, dtype=np.uint32) << 8
    for _ in range(8):
        out = np.where(out & 0x8000, out << 1 ^ 0x8005, out << 1) & 0xFFFF
    return out.astype(np.uint16)


_FAR: list[np.ndarray] = []


def crc16_by_distance(most: int) -> np.ndarray:
    """Row d: what each byte adds to a CRC-16 that ends d bytes after it. The CRC is linear, so it is the sum of these."""
    if not _FAR or len(_FAR[0]) < most:
        table = crc16_table()
        rows = np.empty((max(most, 1400), 256), np.uint16)
        rows[0] = table
        for d in range(1, len(rows)):
            last = rows[d - 1]
            rows[d] = last << 8 ^ table[last >> 8]
        _FAR[:] = [rows]
    return _FAR[0]


def crc16_of(data: np.ndarray, starts: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """CRC-16 of each stretch of ``data``; the stretches are one after another or apart, none empty."""
    if not len(starts):
        return np.zeros(0, np.uint16)
    own = np.repeat(starts - np.concatenate([[0], np.cumsum(lengths)[:-1]]), lengths) + np.arange(lengths.sum())
    distance = np.repeat(starts + lengths - 1, lengths) - own
    parts = crc16_by_distance(int(lengths.max()))[distance, data[own]]
    return np.bitwise_xor.reduceat(parts, np.concatenate([[0], np.cumsum(lengths)[:-1]]))


def crc8_of(data: bytes) -> int:
    crc, table = 0, crc8_table()
    for b in data:
        crc = int(table[crc ^ b])
    return crc


@lru_cache(maxsize=65536)
def frame_header(number: int, size: int) -> bytes:
    """Sync code, sizes, mono, 8 bits a sample, frame number as FLAC codes it, CRC-8."""
    code = SIZE_CODE.get(size, 7)
    head = bytes([0xFF, 0xF8, code << 4 | 4, 0 << 4 | 1 << 1])
    if number < 0x80:
        head += bytes([number])
    else:
        tail, first = [], 0x3F
        while number > first:
            tail.append(0x80 | number & 0x3F)
            number >>= 6
            first >>= 1
        lead = (0xFE << (6 - len(tail))) & 0xFF
        head += bytes([lead | number, *reversed(tail)])
    if code == 7:
        head += (size - 1).to_bytes(2, "big")
    return head + bytes([crc8_of(head)])


def fixed_residuals(x: np.ndarray, order: int) -> np.ndarray:
    """Residuals of rows of samples under the fixed predictor of this order; the first ``order`` columns are warm-up samples."""
    r = x
    for k in range(order):
        r = np.concatenate([r[:, : k + 1], np.diff(r[:, k:], axis=1)], axis=1)
    return r


def linear_coefficients(x: np.ndarray, order: int, precision: int = 8) -> tuple[np.ndarray, int]:
    """Whole coefficients and shift of a predictor of one row of samples, by the autocorrelation method."""
    x = x.astype(np.float64)
    auto = np.array([x[: len(x) - k] @ x[k:] for k in range(order + 1)])
    if auto[0] == 0:
        return np.zeros(order, np.int64), 0
    coef, error = np.zeros(order), auto[0]
    for i in range(order):
        k = (auto[i + 1] - coef[:i] @ auto[i:0:-1]) / error
        coef[: i + 1] = np.concatenate([coef[:i] - k * coef[:i][::-1], [k]])
        error *= 1 - k * k
        if error <= 0:
            break
    top = np.abs(coef).max()
    shift = int(np.clip(precision - 1 - np.ceil(np.log2(top)) if top > 0 else 0, 0, 15))
    limit = (1 << (precision - 1)) - 1
    return np.clip(np.rint(coef * (1 << shift)), -limit - 1, limit).astype(np.int64), shift


def linear_residuals(x: np.ndarray, coef: np.ndarray, shift: int) -> np.ndarray:
    """Residuals of one row; the first samples are kept as warm-up."""
    order = len(coef)
    guess = sum(coef[j] * x[order - 1 - j : len(x) - 1 - j].astype(np.int64) for j in range(order))
    return np.concatenate([x[:order], x[order:] - (guess >> shift)])


def _put(bits: np.ndarray, at: np.ndarray, values: np.ndarray, width: int) -> None:
    """Write numbers of ``width`` bits at these places of an array of single bits."""
    for j in range(width):
        bits[at + j] = values >> (width - 1 - j) & 1


def pack_rows(x: np.ndarray, numbers: list[int], max_order: int, linear_order: int) -> list[bytes]:
    """Frames of equally long rows of samples: each by the cheapest of constant, verbatim, fixed and (if asked for) linear."""
    n_rows, size = x.shape
    parts = PARTS_LOG2 if size % (1 << PARTS_LOG2) == 0 and size >> PARTS_LOG2 > max(max_order, linear_order) else 0
    n_parts, step = 1 << parts, size >> parts
    choices: list[tuple[str, int, np.ndarray, list]] = []
    for order in range(max_order + 1):
        choices.append(("fixed", order, fixed_residuals(x, order), []))
    if linear_order and size > 2 * linear_order:
        models = [linear_coefficients(row, linear_order) for row in x]
        choices.append(("linear", linear_order, np.array([linear_residuals(row, *m) for row, m in zip(x, models, strict=True)]), models))
    costs, ks, folded = [], [], []
    for kind, order, r, _ in choices:
        u = np.where(r >= 0, r << 1, ~r << 1 | 1)
        u[:, :order] = 0
        grouped = u.reshape(n_rows, n_parts, step)
        counts = np.full(n_parts, step)
        counts[0] -= order
        bits = np.stack([(grouped >> k).sum(2) + counts * (1 + k) for k in range(0, 10)])
        ks.append(bits.argmin(0))
        costs.append(bits.min(0).sum(1) + 6 + 4 * n_parts + 8 * order + (9 + 8 * order) * (kind == "linear"))
        folded.append(u)
    costs.append(np.full(n_rows, 8 * size))
    costs.append(np.where((x == x[:, :1]).all(1), 8, 1 << 40))
    best = np.argmin(np.stack(costs), 0)
    out: list[bytes] = [b""] * n_rows
    unsigned = (x & 0xFF).astype(np.uint8)
    for c in range(len(choices) + 2):
        rows = np.flatnonzero(best == c)
        if not len(rows):
            continue
        if c == len(choices):  # verbatim
            bodies = [bytes([1 << 1]) + unsigned[i].tobytes() for i in rows]
        elif c == len(choices) + 1:  # constant
            bodies = [bytes([0, int(unsigned[i, 0])]) for i in rows]
        else:
            kind, order, _, models = choices[c]
            u, k = folded[c][rows], ks[c][rows]
            kk = np.repeat(k, step, axis=1)
            q = u >> kk
            cost = q + 1 + kk
            cost[:, :order] = 0
            head = 8 + 8 * order + ((9 + 8 * order) if kind == "linear" else 0) + 6
            lead = np.zeros((len(rows), size), np.int64)  # bits of partition heads before each residual
            lead[:, ::step] = 4
            ends = head + np.cumsum(cost + lead, axis=1)
            total = (ends[:, -1] + 7) // 8 * 8
            base = np.concatenate([[0], np.cumsum(total)[:-1]])
            bits = np.zeros(int(total.sum()), np.uint8)
            mark = (8 + order if kind == "fixed" else 32 + order - 1) << 1
            _put(bits, base, np.full(len(rows), mark), 8)
            at = base + 8
            for j in range(order):
                _put(bits, at, unsigned[rows, j].astype(np.int64), 8)
                at = at + 8
            if kind == "linear":
                shifts = np.array([models[i][1] for i in rows])
                _put(bits, at, np.full(len(rows), 7), 4)  # precision 8
                _put(bits, at + 4, shifts, 5)
                at = at + 9
                for j in range(order):
                    _put(bits, at, np.array([models[i][0][j] for i in rows]) & 0xFF, 8)
                    at = at + 8
            _put(bits, at, np.full(len(rows), parts), 6)  # Rice residuals, partition order
            begins = base[:, None] + ends - cost
            for p in range(n_parts):
                _put(bits, begins[:, p * step] - 4, k[:, p], 4)
            body = slice(order, size)
            stop = (begins + q)[:, body]
            bits[stop] = 1
            low, width = u[:, body], kk[:, body]
            for j in range(int(k.max())):  # from the lowest bit up
                on = width > j
                bits[(stop + width - j)[on]] = (low >> j & 1)[on]
            packed = np.packbits(bits).tobytes()
            bodies = [packed[a // 8 : (a + t) // 8] for a, t in zip(base.tolist(), total.tolist(), strict=True)]
        for i, b in zip(rows.tolist(), bodies, strict=True):
            out[i] = frame_header(numbers[i], size) + b
    return out


def encode_payloads(payloads: list[bytes], block: int = BLOCK, max_order: int = 2, linear_order: int = 0) -> list[bytes]:
    """A FLAC stream of each payload (none empty): marker, stream information, seek table, frames."""
    by_size: dict[int, list[tuple[int, int]]] = {}
    for i, p in enumerate(payloads):
        for j in range(0, len(p), block):
            by_size.setdefault(min(block, len(p) - j), []).append((i, j // block))
    frames: list[list[bytes]] = [[b""] * -(-len(p) // block) for p in payloads]
    for size, places in by_size.items():
        x = np.frombuffer(b"".join([payloads[i][j * block : j * block + size] for i, j in places]), np.uint8).astype(np.int32).reshape(-1, size) - 128
        for (i, j), frame in zip(places, pack_rows(x, [j for _, j in places], max_order, linear_order), strict=True):
            frames[i][j] = frame
    flat = [f for fs in frames for f in fs]
    lengths = np.array([len(f) for f in flat], np.int64)
    data = np.frombuffer(b"".join(flat), np.uint8)
    sums = crc16_of(data, np.concatenate([[0], np.cumsum(lengths)[:-1]]), lengths).astype(">u2").tobytes()
    out, k = [], 0
    for p, fs in zip(payloads, frames, strict=True):
        whole = [f + sums[2 * (k + j) : 2 * (k + j) + 2] for j, f in enumerate(fs)]
        k += len(fs)
        sizes = [len(f) for f in whole]
        points, at = bytearray(), 0
        for j, n in enumerate(sizes):
            points += (j * block).to_bytes(8, "big") + at.to_bytes(8, "big") + min(block, len(p) - j * block).to_bytes(2, "big")
            at += n
        signed = np.frombuffer(p, np.uint8) ^ 0x80
        info = (
            block.to_bytes(2, "big") * 2 + min(sizes).to_bytes(3, "big") + max(sizes).to_bytes(3, "big")
            + (RATE << 44 | 0 << 41 | 7 << 36 | len(p)).to_bytes(8, "big") + hashlib.md5(signed.tobytes()).digest()
        )
        out.append(b"".join([b"fLaC", b"\x00", len(info).to_bytes(3, "big"), info, b"\x83", len(points).to_bytes(3, "big"), bytes(points), *whole]))
    return out


class Broken(ValueError):
    """A stream that isn't what this decoder reads, or whose checksums don't hold."""


def read_layout(stream: bytes) -> tuple[int, bytes, list[tuple[int, int, int]]]:
    """Samples, MD5, and for each frame its first sample, its place in the stream and its samples."""
    if stream[:4] != b"fLaC":
        raise Broken("no FLAC marker")
    at, last, info, points = 4, False, b"", []
    while not last:
        kind, n = stream[at], int.from_bytes(stream[at + 1 : at + 4], "big")
        last, body = bool(kind & 0x80), stream[at + 4 : at + 4 + n]
        if kind & 0x7F == 0:
            info = body
        elif kind & 0x7F == 3:
            points = [(int.from_bytes(body[i : i + 8], "big"), int.from_bytes(body[i + 8 : i + 16], "big"), int.from_bytes(body[i + 16 : i + 18], "big")) for i in range(0, n, 18)]
        at += 4 + n
    if len(info) != 34:
        raise Broken("no stream information")
    fields = int.from_bytes(info[10:18], "big")
    if fields >> 36 & 31 != 7 or fields >> 41 & 7:
        raise Broken("not mono of 8 bits")
    total, expected = fields & (1 << 36) - 1, 0
    for first, _, n in points:
        if first != expected:
            raise Broken("no seek point for each frame")
        expected += n
    if expected != total:
        raise Broken("no seek point for each frame")
    return total, info[18:], [(s, at + o, n) for s, o, n in points]


class Lanes:
    """Bits of many frames, each read at its own place."""

    def __init__(self, data: np.ndarray, starts: np.ndarray):
        padded = np.concatenate([data, np.zeros(8, np.uint8)]).astype(np.uint64)
        word = np.zeros(len(data), np.uint64)
        for j in range(8):
            word = word << np.uint64(8) | padded[j : j + len(data)]
        self.words, self.at = word, starts.astype(np.int64) * 8

    def window(self, rows: np.ndarray) -> np.ndarray:
        """The next 56 bits or more of these lanes, from the top of a word of 64."""
        at = self.at[rows]
        return self.words[np.minimum(at >> 3, len(self.words) - 1)] << (at & 7).astype(np.uint64)

    def take(self, rows: np.ndarray, width: int) -> np.ndarray:
        got = (self.window(rows) >> np.uint64(64 - width)).astype(np.int64)
        self.at[rows] += width
        return got

    def signed(self, rows: np.ndarray, width: int) -> np.ndarray:
        got = self.take(rows, width)
        return np.where(got >> (width - 1) & 1, got - (1 << width), got)

    def rice(self, rows: np.ndarray, k: np.ndarray) -> np.ndarray:
        """A Rice code from each of these lanes, unfolded to its sign."""
        w = self.window(rows)
        # the place of the top bit that is set: exact in a double for 53 bits or fewer
        top = np.frexp((w >> np.uint64(11)).astype(np.float64))[1]
        q = (53 - top).astype(np.int64)
        if (far := (q > 40)).any():  # a long run of zero bits: count on
            for i in np.flatnonzero(far):
                at, n = int(self.at[rows[i]]), 0
                while not int(self.words[at >> 3]) >> (63 - (at & 7)) & 1:
                    at, n = at + 1, n + 1
                q[i] = n
        self.at[rows] += q + 1
        low = (self.window(rows) >> np.uint64(1) >> (63 - k).astype(np.uint64)).astype(np.int64)
        self.at[rows] += k
        u = q << k | low
        return u >> 1 ^ -(u & 1)


def header_length(data: bytes, at: int) -> tuple[int, int, int]:
    """Length of a frame's header, its number and its samples (0: as the stream has); checks the CRC-8."""
    if data[at] != 0xFF or data[at + 1] != 0xF8:
        raise Broken("no sync code")
    code, lead, end = data[at + 2] >> 4, data[at + 4], at + 5
    more = 0 if lead < 0x80 else 8 - (lead ^ 0xFF).bit_length() - 1
    number = lead if not more else lead & ((1 << (6 - more)) - 1)
    for _ in range(more):
        number, end = number << 6 | data[end] & 0x3F, end + 1
    if code == 6:
        size, end = data[end] + 1, end + 1
    elif code == 7:
        size, end = int.from_bytes(data[end : end + 2], "big") + 1, end + 2
    elif code == 1 or not code:
        size = 192 if code else 0
    else:
        size = 576 << (code - 2) if code < 6 else 256 << (code - 8)
    if data[end] != crc8_of(data[at:end]):
        raise Broken("CRC-8 of a frame's header")
    return end + 1 - at, number, size


_HEADS: dict[bytes, tuple[int, int]] = {}


def _frames(data: bytes, starts: list[int], ends: list[int], sizes: list[int]) -> tuple[np.ndarray, np.ndarray]:
    """Samples of the frames that stand at these places, one after another, and where each begins. Both checksums of each are verified."""
    array = np.frombuffer(data, np.uint8)
    start, end, size = (np.array(v, np.int64) for v in (starts, ends, sizes))
    if (end - start < 6).any() or (end > len(data)).any():
        raise Broken("a frame is cut off")
    kept = array[end - 2].astype(np.uint16) << 8 | array[end - 1]
    if (crc16_of(array, start, end - 2 - start) != kept).any():
        raise Broken("CRC-16 of a frame")
    heads = np.empty(len(start), np.int64)
    for i, at in enumerate(starts):
        key = data[at : at + 16]
        if (known := _HEADS.get(key)) is None:
            length, _, own = header_length(data, at)
            if len(_HEADS) > 50_000:
                _HEADS.clear()
            known = _HEADS[key] = length, own
        if known[1] not in (0, sizes[i]):
            raise Broken("a frame's samples differ from its seek point")
        heads[i] = known[0]
    return _subframes(array, start + heads, size)


def decode_streams(streams: list[bytes], verify_md5: bool = True) -> list[list[tuple[int, bytes]]]:
    """PCM blocks of each stream, as (sample offset, samples as unsigned bytes), checksums verified."""
    layouts = [read_layout(s) for s in streams]
    base, starts, ends, sizes, offsets, owners = 0, [], [], [], [], []
    for i, (s, (_, _, points)) in enumerate(zip(streams, layouts, strict=True)):
        begins = [p for _, p, _ in points]
        for (sample, place, n), end in zip(points, [*begins[1:], len(s)], strict=True):
            starts.append(base + place)
            ends.append(base + end)
            sizes.append(n)
            offsets.append(sample)
            owners.append(i)
        base += len(s)
    flat, ats = _frames(b"".join(streams), starts, ends, sizes)
    out: list[list[tuple[int, bytes]]] = [[] for _ in streams]
    for i, o, a, n in zip(owners, offsets, ats.tolist(), sizes, strict=True):
        out[i].append((o, flat[a : a + n].tobytes()))
    for (total, md5, _), blocks in zip(layouts, out, strict=True):
        joined = b"".join([b for _, b in blocks])
        if len(joined) != total or verify_md5 and hashlib.md5((np.frombuffer(joined, np.uint8) ^ 0x80).tobytes()).digest() != md5:
            raise Broken("samples or their MD5")
    return out


def read_samples(stream: bytes, first: int, count: int) -> bytes:
    """Samples ``first`` to ``first + count`` of a stream, less what lies behind its end. Only the frames that hold them are decoded."""
    _, _, points = read_layout(stream)
    ends = [p for _, p, _ in points[1:]] + [len(stream)]
    held = [(s, p, n, e) for (s, p, n), e in zip(points, ends, strict=True) if s < first + count and s + n > first]
    if count <= 0 or not held:
        return b""
    flat, _ = _frames(stream, [p for _, p, _, _ in held], [e for *_, e in held], [n for _, _, n, _ in held])
    skip = max(0, first - held[0][0])
    return flat[skip : first + count - held[0][0]].tobytes()


def _subframes(array: np.ndarray, starts: np.ndarray, sizes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """All samples as unsigned bytes, one frame after another, and where each begins. ``starts``: of the subframes."""
    n, width = len(starts), int(sizes.max(initial=0))
    lanes, every = Lanes(array, starts), np.arange(n)
    mark = lanes.take(every, 8)
    if (mark & 0x81).any():
        raise Broken("padding or wasted bits in a subframe")
    kind = mark >> 1
    constant, verbatim, fixed, linear = kind == 0, kind == 1, (kind >= 8) & (kind <= 12), kind >= 32
    if not (constant | verbatim | fixed | linear).all():
        raise Broken("a subframe of unknown kind")
    order = np.where(fixed, kind - 8, np.where(linear, kind - 31, 0))
    x = np.zeros((width, n), np.int32)  # a row is a step, so that lanes lie together
    inside = np.arange(width)[:, None] < sizes
    if constant.any():
        rows = np.flatnonzero(constant)
        x[:, rows] = lanes.signed(rows, 8)
    if verbatim.any():
        rows = np.flatnonzero(verbatim)
        place = np.minimum((lanes.at[rows] >> 3)[None, :] + np.arange(width)[:, None], len(array) - 1)
        x[:, rows] = array[place].view(np.int8)
    coded = np.flatnonzero(fixed | linear)
    if len(coded):
        for j in range(int(order.max())):
            rows = coded[order[coded] > j]
            x[j, rows] = lanes.signed(rows, 8)
        rows = np.flatnonzero(linear)
        coefs = np.zeros((int(order[rows].max(initial=0)), n), np.int64)
        shift = np.zeros(n, np.int64)
        if len(rows):
            precision = lanes.take(rows, 4) + 1
            shift[rows] = lanes.signed(rows, 5)
            for j in range(len(coefs)):
                for p in np.unique(precision):
                    some = rows[(order[rows] > j) & (precision == p)]
                    coefs[j, some] = lanes.signed(some, int(p))
        _residuals(lanes, coded, order, sizes, x)
        for o in range(1, 5):
            rows = np.flatnonzero(fixed & (order == o))
            if len(rows):
                y = x[:, rows].astype(np.int64)
                for k in range(o - 1, -1, -1):
                    # row k holds the k-th difference of the first samples: sum from there
                    first = y[: k + 1].copy()
                    for _ in range(k):
                        first = np.diff(first, axis=0)
                    y[k:] = np.concatenate([first, y[k + 1 :]]).cumsum(axis=0)
                x[:, rows] = y
        rows = np.flatnonzero(linear)
        if len(rows):
            for t in range(1, width):
                some = rows[(order[rows] <= t) & (sizes[rows] > t)]
                if len(some):
                    guess = np.zeros(len(some), np.int64)
                    for j in range(len(coefs)):
                        if t - 1 - j >= 0:
                            guess += coefs[j, some] * x[t - 1 - j, some]
                    x[t, some] += (guess >> shift[some]).astype(np.int32)
    flat = ((x & 0xFF).astype(np.uint8) ^ 0x80).T[inside.T]
    return flat, np.concatenate([[0], np.cumsum(sizes)[:-1]])


def _residuals(lanes: Lanes, coded: np.ndarray, order: np.ndarray, sizes: np.ndarray, x: np.ndarray) -> None:
    """Read the residuals of these lanes into ``x`` behind their warm-up samples."""
    method = lanes.take(coded, 2)
    if (method > 1).any():
        raise Broken("residuals of unknown kind")
    k_bits = 4 + method
    parts = lanes.take(coded, 4)
    step = sizes[coded] >> parts
    k = np.zeros(len(coded), np.int64)
    raw = np.full(len(coded), -1, np.int64)
    # longest lanes first, so that those still at work are a prefix
    by = np.argsort(-sizes[coded], kind="stable")
    lane, step, k_bits, own_order, own_size = coded[by], step[by], k_bits[by], order[coded][by], sizes[coded][by]
    alive = len(lane)
    for t in range(int(own_size[0])):
        while alive and own_size[alive - 1] <= t:
            alive -= 1
        fresh = np.flatnonzero(t % step[:alive] == 0)
        for wide in (4, 5):
            some = fresh[k_bits[fresh] == wide]
            if len(some):
                got = lanes.take(lane[some], wide)
                escaped = got == (1 << wide) - 1
                k[some], raw[some] = np.where(escaped, 0, got), -1
                if escaped.any():
                    raw[some[escaped]] = lanes.take(lane[some[escaped]], 5)
        todo = np.arange(alive) if t >= 32 else np.flatnonzero(own_order[:alive] <= t)
        if (plain := raw[todo] >= 0).any():
            for width in np.unique(raw[todo[plain]]):
                some = todo[raw[todo] == width]
                x[t, lane[some]] = lanes.signed(lane[some], int(width)) if width else 0
            todo = todo[~plain]
        if len(todo):
            x[t, lane[todo]] = lanes.rice(lane[todo], k[todo])


def payload_of(text: bytes, unit: int = 64) -> bytes:
    """A text and zero bytes up to a positive multiple of ``unit``."""
    return text + bytes(-len(text) % unit if text else unit)


MEDIA = T.StructType([T.StructField("n_bytes", T.LongType()), T.StructField("media", T.BinaryType())])
DIGESTS = T.StructType([
    T.StructField("payload_bytes", T.LongType()), T.StructField("payload_sha256", T.StringType()),
    T.StructField("tail_crc32", T.LongType()), T.StructField("media_bytes", T.LongType()),
    T.StructField("media_sha256", T.StringType()), T.StructField("n_blocks", T.LongType()), T.StructField("feature", T.StringType()),
])
BLOCKS = T.StructType([T.StructField("blocks", T.ArrayType(T.StructType([
    T.StructField("sample_offset", T.LongType(), False), T.StructField("pcm", T.BinaryType(), False)]), False))])


def encode_media(docs: DataFrame, id_cols: list[str] | None = None, text_col: str = "text", linear_order: int = 0) -> DataFrame:
    """Key columns, ``n_bytes`` and ``media`` (a FLAC stream of the padded text) for each row. Null text: as empty, 64 zero bytes."""

    def step(texts: list[bytes]) -> dict[str, list]:
        return {"n_bytes": [len(t) for t in texts], "media": encode_payloads([payload_of(t) for t in texts], linear_order=linear_order)}

    return map_columns(docs, id_cols or ["doc_id"], text_col, "string", MEDIA, step, most=1 << 20)


def feature_of(pcm: bytes, blocks: int) -> str:
    """Peak, mean level, power, zero crossings and blocks of 8-bit samples, as text."""
    x = np.frombuffer(pcm, np.uint8).astype(np.int32) - 128
    crossings = int(((x[1:] < 0) != (x[:-1] < 0)).sum())
    return f"n={len(x)};peak={int(np.abs(x).max())};sum={int(x.sum())};power={int((x * x).sum(dtype=np.int64))};crossings={crossings};blocks={blocks}"


def digest_media(media: DataFrame, id_cols: list[str], media_col: str = "media") -> DataFrame:
    """Key columns and digests of each stream and of what it decodes to. Null streams aren't allowed."""

    def step(streams: list[bytes]) -> dict[str, list]:
        out: dict[str, list] = {n: [] for n in DIGESTS.fieldNames()}
        for stream, blocks in zip(streams, decode_streams(streams), strict=True):
            pcm = b"".join([b for _, b in blocks])
            for name, value in (
                ("payload_bytes", len(pcm)), ("payload_sha256", hashlib.sha256(pcm).hexdigest()), ("tail_crc32", zlib.crc32(pcm[-64:])),
                ("media_bytes", len(stream)), ("media_sha256", hashlib.sha256(stream).hexdigest()), ("n_blocks", len(blocks)),
                ("feature", feature_of(pcm, len(blocks))),
            ):
                out[name].append(value)
        return out

    return map_columns(media, id_cols, media_col, "binary", DIGESTS, step, most=1 << 20)


def seek(media: DataFrame, id_cols: list[str], first: str, count: str, media_col: str = "media") -> DataFrame:
    """Key columns and ``pcm``: of each stream the ``count`` samples from offset ``first`` on (names of columns). Only frames that hold them are decoded."""
    both = media.select(*[F.col(f"`{c}`") for c in id_cols], F.col(f"`{media_col}`").cast("binary").alias("__media"), F.col(f"`{first}`").cast("long").alias("__first"), F.col(f"`{count}`").cast("long").alias("__count"))
    schema = T.StructType([*(both.schema[c] for c in id_cols), T.StructField("pcm", T.BinaryType())])

    def run(batches):
        import pyarrow as pa

        k = len(id_cols)
        for batch in batches:
            for a in range(batch.num_rows):
                stream, at, n = (batch.column(k + j)[a].as_py() for j in range(3))
                yield pa.RecordBatch.from_arrays([*(batch.column(j).slice(a, 1) for j in range(k)), pa.array([read_samples(stream, at, n)], pa.binary())], names=[*id_cols, "pcm"])

    return both.mapInArrow(run, schema)


def pcm_blocks(media: DataFrame, id_cols: list[str], media_col: str = "media") -> DataFrame:
    """A row for each PCM block: key columns, ``sample_offset`` and ``pcm``, for seeking by sample."""

    def step(streams: list[bytes]) -> dict[str, list]:
        return {"blocks": [[{"sample_offset": o, "pcm": b} for o, b in blocks] for blocks in decode_streams(streams)]}

    blocks = map_columns(media, id_cols, media_col, "binary", BLOCKS, step, most=1 << 20)
    return blocks.select(*id_cols, F.explode("blocks").alias("block")).select(*id_cols, "block.sample_offset", "block.pcm")
