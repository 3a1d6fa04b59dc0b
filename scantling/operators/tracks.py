"""Tracks: detections linked across frames, their components, region filters and non-max suppression."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from scantling.functions import geometry as g
from scantling.operators.graph import components


def link_frames(det: DataFrame, keys: list[str], ahead: int = 3, least: float = 0.7) -> DataFrame:
    """Pairs (aliases ``a`` and ``b``) of one class with IoU above ``least``, b one to ``ahead`` frames after a.

    The band of frames is exploded, so the join is on equal class and frame and needs no nested loop.
    """
    side = det.select(*keys, "object_name", g.rect("xmin", "ymin", "xmax", "ymax").alias("r"))
    a = side.withColumn("next", F.explode(F.sequence(F.col("frame") + 1, F.col("frame") + ahead))).alias("a")
    b = side.alias("b")
    joined = a.join(b, (F.col("a.next") == F.col("b.frame")) & (F.col("a.object_name") == F.col("b.object_name")))
    return joined.where(g.iou(F.col("a.r"), F.col("b.r")) > least)


def build_tracks(det: DataFrame, row_id: str, least_confidence: float = 0.1) -> DataFrame:
    """``row_id`` and ``ind`` of every detection in a track whose best confidence is above the bound; dense, in order of first rows."""
    pairs = link_frames(det, [row_id, "frame"])
    edges = pairs.select(F.col(f"a.{row_id}").alias("u"), F.col(f"b.{row_id}").alias("v"))
    found = components(edges)
    each = det.select(row_id, "confidence").join(found, F.col(row_id) == F.col("node"), "left").select(row_id, "confidence", F.coalesce("component", F.col(row_id)).alias("track"))
    good = each.groupBy("track").agg(F.max("confidence").alias("best")).where(F.col("best") > least_confidence).select("track")
    return each.join(good, "track").join(dense_numbers(good, "track"), "track").select(row_id, "ind")


def dense_numbers(df: DataFrame, key: str, ranges: int = 1024) -> DataFrame:
    """0, 1, 2, ... by rising key (a long): counts of ranges give each range's first number, rows are numbered within theirs."""
    span = df.agg(F.min(key).alias("lo"), F.max(key).alias("hi"))
    placed = df.join(F.broadcast(span)).withColumn("part", F.floor((F.col(key) - F.col("lo")) * ranges / (F.col("hi") - F.col("lo") + 1)))
    sizes = placed.groupBy("part").agg(F.count("*").alias("n"))
    starts = sizes.select("part", F.coalesce(F.sum("n").over(Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("start"))
    own = placed.withColumn("rn", F.row_number().over(Window.partitionBy("part").orderBy(key)))
    return own.join(F.broadcast(starts), "part").select(key, (F.col("start") + F.col("rn") - 1).alias("ind"))


def filter_tracks(det: DataFrame, track: str, order: str, keep: Column) -> DataFrame:
    """Rows that fulfil a condition, tracks numbered anew in order of their first kept row."""
    kept = det.where(keep)
    firsts = kept.groupBy(track).agg(F.min(order).alias("first"))
    numbers = dense_numbers(firsts.select("first"), "first")
    return kept.join(firsts.join(numbers, "first").select(track, "ind"), track)


def suppress(boxes: np.ndarray, scores: np.ndarray, most: float) -> list[int]:
    """Places of the boxes that stay, best first: greedy non-max suppression."""
    order = list(np.lexsort((np.arange(len(scores)), -scores)))
    areas = (boxes[:, 2] - boxes[:, 0]) * (boxes[:, 3] - boxes[:, 1])
    kept = []
    while order:
        i, rest = order[0], np.array(order[1:], int)
        kept.append(int(i))
        if not len(rest):
            break
        w = np.clip(np.minimum(boxes[rest, 2], boxes[i, 2]) - np.maximum(boxes[rest, 0], boxes[i, 0]), 0, None)
        h = np.clip(np.minimum(boxes[rest, 3], boxes[i, 3]) - np.maximum(boxes[rest, 1], boxes[i, 1]), 0, None)
        share = w * h / np.maximum(areas[rest] + areas[i] - w * h, 1e-12)
        order = list(rest[share <= most])
    return kept


def non_max_suppression(det: DataFrame, keys: list[str], row_id: str, least: float = 0.25, most_iou: float = 0.45, most: int = 300, agnostic: bool = False, together: int = 256, most_in: int = 30_000) -> DataFrame:
    """Detections that stay of each group of ``keys``: classes don't suppress each other unless ``agnostic``; ``most`` of them at best, out of the ``most_in`` most confident.

    The first key is a frame number. ``together`` neighbouring frames are handed to a task at once, as a group of a few boxes is
    not worth a call.
    """
    part = keys + ([] if agnostic else ["object_name"])
    columns = [*keys, "object_name", row_id, "confidence"]
    place = F.row_number().over(Window.partitionBy(*keys).orderBy(F.desc("confidence"), row_id))
    slim = det.where(F.col("confidence") > least).withColumn("__place", place).where(F.col("__place") <= most_in).select(*columns, "xmin", "ymin", "xmax", "ymax", F.floor(F.col(keys[0]) / together).alias("__part"))

    def several(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values([*part, row_id], ignore_index=True)
        boxes, scores = pdf[["xmin", "ymin", "xmax", "ymax"]].to_numpy(), pdf["confidence"].to_numpy()
        starts = np.flatnonzero((pdf[part] != pdf[part].shift()).any(axis=1).to_numpy())
        kept: list[int] = []
        for a, b in zip(starts, [*starts[1:], len(pdf)], strict=True):
            kept += [a] if b - a == 1 else [a + i for i in suppress(boxes[a:b], scores[a:b], most_iou)]
        return pdf.iloc[kept][columns]

    kept = slim.groupBy("__part").applyInPandas(several, slim.select(*columns).schema)
    rank = F.row_number().over(Window.partitionBy(*keys).orderBy(F.desc("confidence"), row_id))
    return kept.withColumn("rn", rank).where(F.col("rn") <= most).drop("rn")


def clip_polygon(polygon: list[tuple[float, float]], rect: tuple[float, float, float, float]) -> list[tuple[float, float]]:
    """A polygon cut to a rectangle, edge by edge."""
    x1, y1, x2, y2 = rect
    for axis, bound, sign in ((0, x1, 1), (0, x2, -1), (1, y1, 1), (1, y2, -1)):
        out: list[tuple[float, float]] = []
        for k, q in enumerate(polygon):
            p = polygon[k - 1]
            a, b = sign * (p[axis] - bound), sign * (q[axis] - bound)
            if (a < 0) != (b < 0):
                f = a / (a - b)
                out.append((p[0] + f * (q[0] - p[0]), p[1] + f * (q[1] - p[1])))
            if b >= 0:
                out.append(q)
        polygon = out
    return polygon


def shoelace(polygon: list[tuple[float, float]]) -> float:
    return abs(sum(p[0] * q[1] - q[0] * p[1] for p, q in zip(polygon, polygon[1:] + polygon[:1], strict=True))) / 2 if polygon else 0.0


def polygon_shares(det: DataFrame, keys: list[str], polygons: list[list[tuple[float, float]]]) -> DataFrame:
    """``keys`` and, for each polygon, the share of the box that it covers (``share_0``, ...)."""
    names = [f"share_{k}" for k in range(len(polygons))]
    slim = det.select(*dict.fromkeys([*keys, "xmin", "ymin", "xmax", "ymax"]))
    schema = ", ".join([*(f"{f.name} {f.dataType.simpleString()}" for f in slim.select(*keys).schema), *(f"{n} double" for n in names)])

    def run(batches):
        for pdf in batches:
            for n, polygon in zip(names, polygons, strict=True):
                pdf[n] = [shoelace(clip_polygon(polygon, r)) / max((r[2] - r[0]) * (r[3] - r[1]), 1e-12) for r in zip(pdf["xmin"], pdf["ymin"], pdf["xmax"], pdf["ymax"], strict=True)]
            yield pdf[[*keys, *names]]

    return slim.mapInPandas(run, schema)
