"""Rectangles as columns: ``STRUCT<x1, y1, x2, y2: DOUBLE>``. All of it is built-in expressions, so it stays in generated code."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F


def _struct(x1, y1, x2, y2) -> Column:
    return F.struct(*[c.cast("double").alias(n) for c, n in zip((x1, y1, x2, y2), ("x1", "y1", "x2", "y2"), strict=True)])


def col(c) -> Column:
    return F.col(c) if isinstance(c, str) else c if isinstance(c, Column) else F.lit(c)


def rect(x1, y1, x2, y2, scale: float = 1.0) -> Column:
    """From two opposite corners in either order, scaled."""
    x1, y1, x2, y2 = map(col, (x1, y1, x2, y2))
    return _struct(F.least(x1, x2) * scale, F.least(y1, y2) * scale, F.greatest(x1, x2) * scale, F.greatest(y1, y2) * scale)


def from_xywh(x, y, w, h, scale: float = 1.0) -> Column:
    x, y, w, h = map(col, (x, y, w, h))
    return rect(x, y, x + w, y + h, scale)


def fixed(x1: float, y1: float, x2: float, y2: float) -> Column:
    return rect(F.lit(float(x1)), F.lit(float(y1)), F.lit(float(x2)), F.lit(float(y2)))


def width(r: Column) -> Column:
    return r["x2"] - r["x1"]


def height(r: Column) -> Column:
    return r["y2"] - r["y1"]


def area(r: Column) -> Column:
    return width(r) * height(r)


def centre_x(r: Column) -> Column:
    return (r["x1"] + r["x2"]) / 2


def centre_y(r: Column) -> Column:
    return (r["y1"] + r["y2"]) / 2


def distance(ax, ay, bx, by) -> Column:
    return F.sqrt((ax - bx) * (ax - bx) + (ay - by) * (ay - by))


def diagonal(r: Column) -> Column:
    return distance(r["x1"], r["y1"], r["x2"], r["y2"])


def centre_distance(a: Column, b: Column) -> Column:
    return distance(centre_x(a), centre_y(a), centre_x(b), centre_y(b))


def contains(r: Column, x, y) -> Column:
    """Whether a point lies in the closed rectangle."""
    return col(x).between(r["x1"], r["x2"]) & col(y).between(r["y1"], r["y2"])


def includes(a: Column, b: Column) -> Column:
    return contains(a, b["x1"], b["y1"]) & contains(a, b["x2"], b["y2"])


def touches(a: Column, b: Column) -> Column:
    """Whether two rectangles meet; a common edge or corner counts."""
    u = merge(a, b)
    return (width(u) <= width(a) + width(b)) & (height(u) <= height(a) + height(b))


def overlap(a: Column, b: Column) -> Column:
    """Their common rectangle, null unless it has an area."""
    x1, y1 = F.greatest(a["x1"], b["x1"]), F.greatest(a["y1"], b["y1"])
    x2, y2 = F.least(a["x2"], b["x2"]), F.least(a["y2"], b["y2"])
    return F.when((x2 > x1) & (y2 > y1), _struct(x1, y1, x2, y2))


def overlap_area(a: Column, b: Column) -> Column:
    w = F.least(a["x2"], b["x2"]) - F.greatest(a["x1"], b["x1"])
    h = F.least(a["y2"], b["y2"]) - F.greatest(a["y1"], b["y1"])
    return F.when((w > 0) & (h > 0), w * h).otherwise(F.lit(0.0))


def overlap_share(a: Column, b: Column) -> Column:
    """Common area by the area of ``a``; null where ``a`` has none."""
    return F.try_divide(overlap_area(a, b), area(a))


def iou(a: Column, b: Column) -> Column:
    """Common area by joint area; 0 where neither has an area."""
    i = overlap_area(a, b)
    return F.coalesce(F.try_divide(i, area(a) + area(b) - i), F.lit(0.0))


def edge_distance(a: Column, b: Column) -> Column:
    """Least distance of parallel edges, and its direction: 1 vertical, 2 horizontal, 3 both alike."""
    v = F.least(*[F.abs(a[p] - b[q]) for p in ("y1", "y2") for q in ("y1", "y2")])
    h = F.least(*[F.abs(a[p] - b[q]) for p in ("x1", "x2") for q in ("x1", "x2")])
    return F.struct(F.least(v, h).alias("d"), F.when(v < h, 1).when(h < v, 2).otherwise(3).alias("direction"))


def merge(*rects: Column) -> Column:
    if len(rects) == 1:
        return rects[0]
    return _struct(*[f(*[r[n] for r in rects]) for f, n in ((F.least, "x1"), (F.least, "y1"), (F.greatest, "x2"), (F.greatest, "y2"))])


def bounding_box(r: Column) -> Column:
    """Aggregate: the rectangle around all rectangles of a group."""
    return _struct(F.min(r["x1"]), F.min(r["y1"]), F.max(r["x2"]), F.max(r["y2"]))


def surrounding(src: Column, hole: Column) -> Column:
    """The up to eight rectangles with an area around ``hole`` in ``src``, in rows from the top; null unless ``src`` includes it."""
    xs, ys = (src["x1"], hole["x1"], hole["x2"], src["x2"]), (src["y1"], hole["y1"], hole["y2"], src["y2"])
    cells = F.array(*[_struct(xs[i], ys[j], xs[i + 1], ys[j + 1]) for j in range(3) for i in range(3) if (i, j) != (1, 1)])
    return F.when(includes(src, hole), F.filter(cells, lambda r: (r["x2"] > r["x1"]) & (r["y2"] > r["y1"])))


def truncated(r: Column) -> Column:
    return F.struct(*[r[n].cast("int").alias(n) for n in ("x1", "y1", "x2", "y2")])


def to_centre(r: Column) -> Column:
    return F.struct(centre_x(r).alias("cx"), centre_y(r).alias("cy"), width(r).alias("w"), height(r).alias("h"))


def from_centre(cx, cy, w, h) -> Column:
    cx, cy, w, h = map(col, (cx, cy, w, h))
    return _struct(cx - w / 2, cy - h / 2, cx + w / 2, cy + h / 2)


def shift(r: Column, dx, dy) -> Column:
    return _struct(r["x1"] + col(dx), r["y1"] + col(dy), r["x2"] + col(dx), r["y2"] + col(dy))


def affine(r: Column, fx, fy, tx, ty) -> Column:
    return _struct(r["x1"] * fx + tx, r["y1"] * fy + ty, r["x2"] * fx + tx, r["y2"] * fy + ty)


def network_side(n, scale: float) -> Column:
    """A side scaled and cut to a multiple of 64, 64 at least."""
    return F.greatest(F.floor(col(n) * scale / 64) * 64, F.lit(64)).cast("int")


def even_floor(v, base: int = 2) -> Column:
    return (F.floor(col(v) / base) * base).cast("int")


def _around(r: Column, w: Column, h: Column) -> Column:
    x, y = (centre_x(r) - w / 2).cast("int"), (centre_y(r) - h / 2).cast("int")
    return from_xywh(x, y, w.cast("int"), h.cast("int"))


def inflate_linear(r: Column, k: float) -> Column:
    return _around(r, width(r) * k, height(r) * k)


def inflate_exponential(r: Column, base: float, k: float) -> Column:
    grow = lambda x: (F.lit(float(k)) * F.pow(F.lit(float(base)), -x) + 1) * x
    return _around(r, grow(width(r)), grow(height(r)))


def inflate_least(r: Column, least: int) -> Column:
    """Sides below ``least`` grow to it around the centre."""
    x1 = F.when(width(r) < least, (centre_x(r) - least / 2).cast("int").cast("double")).otherwise(r["x1"])
    y1 = F.when(height(r) < least, (centre_y(r) - least / 2).cast("int").cast("double")).otherwise(r["y1"])
    return from_xywh(x1, y1, F.greatest(width(r), F.lit(float(least))), F.greatest(height(r), F.lit(float(least))))


def to_text(r: Column) -> Column:
    """``(x, y, w, h)`` of whole numbers."""
    return F.format_string("(%d, %d, %d, %d)", *[c.cast("long") for c in (r["x1"], r["y1"], width(r), height(r))])


def from_text(text) -> Column:
    n = [F.regexp_extract(col(text), r"\(\s*(-?[\d.]+),\s*(-?[\d.]+),\s*(-?[\d.]+),\s*(-?[\d.]+)\s*\)", k).cast("double") for k in range(1, 5)]
    return F.when(col(text).rlike(r"^\(.*\)$"), from_xywh(*n))


def polygon_area(xs: Column, ys: Column) -> Column:
    """Shoelace area of a polygon given by arrays of its corners."""
    n = F.size(xs)
    terms = F.transform(F.sequence(F.lit(0), n - 1), lambda i: F.get(xs, i) * F.get(ys, ((i + 1) % n).cast("int")) - F.get(xs, ((i + 1) % n).cast("int")) * F.get(ys, i))
    return F.abs(F.aggregate(terms, F.lit(0.0), lambda a, x: a + x)) / 2


def _zip_sum(a: Column, b: Column, f) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: f(x.cast("double"), y.cast("double"))), F.lit(0.0), lambda s, v: s + v)


def l2(a: Column, b: Column) -> Column:
    return F.sqrt(_zip_sum(a, b, lambda x, y: (x - y) * (x - y)))


def cosine(a: Column, b: Column) -> Column:
    norm = lambda v: F.sqrt(_zip_sum(v, v, lambda x, y: x * y))
    return F.try_divide(_zip_sum(a, b, lambda x, y: x * y), norm(a) * norm(b))


def softmax(a: Column) -> Column:
    top = F.array_max(a)
    total = F.aggregate(F.transform(a, lambda x: F.exp(x - top)), F.lit(0.0), lambda s, v: s + v)
    return F.transform(a, lambda x: F.exp(x - top) / total)


def sigmoid(x) -> Column:
    return 1 / (1 + F.exp(-col(x)))


def normalise(a: Column, mean: float, std: float, top: float = 255.0) -> Column:
    return F.transform(a, lambda x: (x.cast("double") / top - mean) / std)


def rescale_frame(t, src_fps: int, dst_fps: int) -> Column:
    return F.floor(col(t) * (dst_fps / src_fps)).cast("long")


def bitrate_number(text) -> Column:
    unit = F.substring(col(text), -1, 1)
    factor = F.when(unit == "k", 1e3).when(unit == "m", 1e6).when(unit == "g", 1e9)
    return F.regexp_extract(col(text), r"^(\d+)[kmg]$", 1).cast("double") * factor


def bitrate_text(number) -> Column:
    """Thousands, marked k; null for a thousand or less."""
    return F.when(col(number) > 1000, F.concat(F.rint(col(number) / 1000).cast("long").cast("string"), F.lit("k")))


def any_of(conditions: list[Column]) -> Column:
    return reduce(lambda a, b: a | b, conditions, F.lit(False))
