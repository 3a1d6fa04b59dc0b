"""Regions of interest from frames: foreground against a background model, dilated, its connected parts as boxes.

Frames are rows of pixels (grey levels, row by row). Four models: the frame before, the first frame, the least and greatest level
of two recent frames, and a bag of past samples for each pixel. A camera's frames are cut into spans; each span is a task's
group and its model is warmed up on the frames before it, so a camera that never ends is never one group.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

REGIONS = "t long, x1 int, y1 int, x2 int, y2 int"


class FrameBefore:
    """Foreground: pixels that differ from the frame before by more than ``threshold``."""

    def __init__(self, threshold: float, seed: int = 7):
        self.threshold, self.last = threshold, None

    def apply(self, frame: np.ndarray) -> np.ndarray:
        out = np.zeros(frame.shape, bool) if self.last is None else np.abs(frame - self.last) > self.threshold
        self.last = frame
        return out


class FirstFrame(FrameBefore):
    """Foreground: pixels that differ from the first frame."""

    def apply(self, frame: np.ndarray) -> np.ndarray:
        if self.last is None:
            self.last = frame
        return np.abs(frame - self.last) > self.threshold


class TwoLevels(FrameBefore):
    """Foreground: pixels far from both of two levels that follow the background. The nearer one moves where a pixel is background;
    what stays foreground for ``patience`` frames becomes the farther one."""

    rate, patience = 0.1, 20

    def apply(self, frame: np.ndarray) -> np.ndarray:
        if self.last is None:
            self.last = np.stack([frame, frame]).astype(float)
            self.since = np.zeros(frame.shape, int)
            return np.zeros(frame.shape, bool)
        far = np.abs(self.last - frame)
        nearer = far.argmin(0)
        out = far.min(0) > self.threshold
        self.since = np.where(out, self.since + 1, 0)
        for k in (0, 1):
            own = ~out & (nearer == k)
            self.last[k][own] += self.rate * (frame - self.last[k])[own]
            stayed = (self.since >= self.patience) & (nearer != k)
            self.last[k][stayed] = frame[stayed]
        return out


class Samples:
    """Foreground: pixels that fewer than ``least`` of ``size`` past samples of them are near to. Background replaces samples at random."""

    size, least, often = 12, 2, 4

    def __init__(self, threshold: float, seed: int = 7):
        self.threshold, self.rng, self.bag = threshold, np.random.default_rng(seed), None

    def apply(self, frame: np.ndarray) -> np.ndarray:
        if self.bag is None:
            self.bag = np.repeat(frame[None].astype(float), self.size, axis=0)
            return np.zeros(frame.shape, bool)
        out = (np.abs(self.bag - frame) <= self.threshold).sum(0) < self.least
        place = self.rng.integers(0, self.size, frame.shape)
        renewed = ~out & (self.rng.integers(0, self.often, frame.shape) == 0)
        r, c = np.nonzero(renewed)
        self.bag[place[r, c], r, c] = frame[r, c]
        return out


MODELS = {"frame_before": FrameBefore, "first_frame": FirstFrame, "two_levels": TwoLevels, "samples": Samples}


def dilate(mask: np.ndarray) -> np.ndarray:
    """Each pixel's neighbours set, too: three by three."""
    wide = np.pad(mask, 1)
    h, w = mask.shape
    return np.logical_or.reduce([wide[r : r + h, c : c + w] for r in range(3) for c in range(3)])


def boxes(mask: np.ndarray) -> list[tuple[int, int, int, int]]:
    """Boxes (half-open) of the connected parts, corners included, in order of their first pixel."""
    label = np.where(mask, np.arange(1, mask.size + 1).reshape(mask.shape), 0)
    big = mask.size + 1
    while True:
        wide = np.pad(np.where(mask, label, big), 1, constant_values=big)
        h, w = mask.shape
        least = np.minimum.reduce([wide[r : r + h, c : c + w] for r in range(3) for c in range(3)])
        now = np.where(mask, least, 0)
        if (now == label).all():
            break
        label = now
    out = []
    for k in np.unique(label[mask]):
        r, c = np.nonzero(label == k)
        out.append((int(c.min()), int(r.min()), int(c.max()) + 1, int(r.max()) + 1))
    return out


def fetch_regions(frames: DataFrame, camera: str, frame: str, pixels: str, width: int, model: str = "frame_before", threshold: float = 20.0, scale: float = 1.0, span: int = 1000, warm: int = 50) -> DataFrame:
    """``camera``, ``t`` and box of each region of every frame; ``scale`` is how much smaller the frames are than what boxes refer to.

    ``frame`` numbers follow each other. A span of ``span`` frames is a group, with the ``warm`` frames before it to warm the model up; for the model of the first
    frame, with the camera's first frame.
    """
    make = MODELS[model]
    slim = frames.select(F.col(camera).alias("camera"), F.col(frame).cast("long").alias("t"), F.col(pixels).alias("pixels"))
    part = F.floor(F.col("t") / span)
    placed = slim.select("*", F.explode(F.array_distinct(F.array(part, F.floor((F.col("t") + warm) / span)))).alias("span"))
    placed = placed.where((F.col("span") == part) | (F.col("t") >= F.col("span") * span - warm))
    if model == "first_frame":
        firsts = slim.groupBy("camera").agg(F.min_by(F.struct("t", "pixels"), "t").alias("first"))
        spans = placed.select("camera", "span").distinct().join(firsts, "camera")
        placed = placed.where(F.col("span") == part).unionByName(spans.where(F.col("first.t") < F.col("span") * span).select("camera", "first.t", "first.pixels", "span"))

    def one(key: tuple, pdf: pd.DataFrame) -> pd.DataFrame:
        state, rows = make(threshold), []
        for t, flat in pdf.sort_values("t")[["t", "pixels"]].itertuples(index=False, name=None):
            mask = state.apply(np.asarray(flat, float).reshape(-1, width))
            if t >= key[1] * span:
                rows += [(key[0], t, *(int(v / scale) for v in b)) for b in boxes(dilate(mask))]
        return pd.DataFrame(rows, columns=["camera", "t", "x1", "y1", "x2", "y2"])

    kind = slim.schema["camera"].dataType.simpleString()
    return placed.groupBy("camera", "span").applyInPandas(one, f"camera {kind}, {REGIONS}")


def masked(frame: np.ndarray, excluded: list[list[tuple[float, float]]], crop: tuple[int, int, int, int] | None = None, fill: float = 0) -> np.ndarray:
    """A frame with the pixels whose centres lie in excluded polygons filled, cropped to a box (x1, y1, x2, y2)."""
    out = frame.copy()
    ys, xs = np.mgrid[0 : frame.shape[0], 0 : frame.shape[1]] + 0.5
    for polygon in excluded:
        inside = np.zeros(frame.shape[:2], bool)
        for (ax, ay), (bx, by) in zip(polygon, polygon[1:] + polygon[:1], strict=True):
            if ay != by:
                inside ^= ((ay > ys) != (by > ys)) & (xs < (bx - ax) * (ys - ay) / (by - ay) + ax)
        out[inside] = fill
    if crop:
        x1, y1, x2, y2 = crop
        out = out[y1:y2, x1:x2]
    return out


def mask_frames(frames: DataFrame, pixels: str, width: int, excluded: list[list[tuple[float, float]]], crop: tuple[int, int, int, int] | None = None) -> DataFrame:
    """``frames`` with the column ``pixels`` masked and cropped by :func:`masked`."""
    at = frames.columns.index(pixels)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            column = pdf.columns[at]
            pdf[column] = [masked(np.asarray(p, float).reshape(-1, width), excluded, crop).ravel().tolist() for p in pdf[column]]
            yield pdf

    schema = frames.withColumn(pixels, F.col(pixels).cast("array<double>")).schema
    return frames.mapInPandas(run, schema)


def trimmed(frame: np.ndarray, step: int = 10) -> tuple[int, int, int, int]:
    """The box (x1, y1, x2, y2) left when empty borders are cut off in steps; the whole frame if it is empty."""
    h, w = frame.shape[:2]
    x1, y1, x2, y2 = 0, 0, w, h
    if not frame.any():
        return x1, y1, x2, y2
    while y1 + step < y2 and not frame[y1 : y1 + step].any():
        y1 += step
    while y2 - step > y1 and not frame[y2 - step : y2].any():
        y2 -= step
    while x1 + step < x2 and not frame[:, x1 : x1 + step].any():
        x1 += step
    while x2 - step > x1 and not frame[:, x2 - step : x2].any():
        x2 -= step
    return x1, y1, x2, y2


def tile_crop(rect: tuple, valid: tuple) -> tuple:
    """Columns of a tile's part in the valid area, relative to the tile (nulls where it has none): ``rect`` and ``valid`` are four columns each."""
    x1, y1 = F.greatest(rect[0], valid[0]), F.greatest(rect[1], valid[1])
    x2, y2 = F.least(rect[2], valid[2]), F.least(rect[3], valid[3])
    there = (x1 < x2) & (y1 < y2)
    return tuple(F.when(there, v) for v in (x1 - rect[0], y1 - rect[1], x2 - rect[0], y2 - rect[1]))


def remap_classes(name, mapping: dict[str, str]):
    """A class name column with some names replaced by others."""
    out = name
    for old, new in mapping.items():
        out = F.when(name == old, F.lit(new)).otherwise(out)
    return out
