"""Cost models of decoding and of networks, by area in pixels (milliseconds)."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Calibration of a GPU decoder, slopes per pixel and constants.
CODEC = {
    "k_init": 2.5389e-06, "b_init": 7.8028, "k_dec": 2.9219e-07, "b_dec": 0.43915, "k_skip": 3.0997e-07, "b_skip": 0.10163,
    "k_rel": 1.9896e-06, "b_rel": 2.5865, "k_seek": 0.0, "b_seek": 0.0,
}
#: Calibration of a large and a small detector, slope, constant and floor.
NETWORKS = {"large": {"k": 1.4443e-05, "b": 3.0152, "a": 4.5324}, "small": {"k": 5.8750e-06, "b": 0.87772, "a": 3.6988}}


def _line(c: dict, name: str, area: Column) -> Column:
    return area * c[f"k_{name}"] + c[f"b_{name}"]


def random_access(area: Column, gop: int = 30, segment: int = 30, c: dict = CODEC) -> Column:
    """Mean cost of reaching one frame of a segment at random."""
    seek = _line(c, "seek", area) * (1 - gop / segment)
    return _line(c, "init", area) + seek + _line(c, "skip", area) * (gop / 2 - 1) + _line(c, "dec", area) + _line(c, "rel", area)


def network(area: Column, c: dict = NETWORKS["large"], scale: float = 1.0) -> Column:
    """Cost of a network on an input: a line above a floor."""
    k = c["k"] * scale * scale
    return F.when(area > (c["a"] - c["b"]) / k, area * k + c["b"]).otherwise(F.lit(c["a"]))


def predicted(area: Column, skipped: Column, c: dict = CODEC) -> Column:
    """Init, skip, decode and release of a read that skips so many frames, and their sum."""
    parts = {"t_init": _line(c, "init", area), "t_skip": _line(c, "skip", area) * skipped, "t_dec": _line(c, "dec", area), "t_rel": _line(c, "rel", area)}
    total = parts["t_init"] + parts["t_skip"] + parts["t_dec"] + parts["t_rel"]
    return F.struct(*[v.alias(k) for k, v in parts.items()], total.alias("t_total"))


def relative_error(predicted: Column, real: Column) -> Column:
    return F.try_divide(predicted - real, real) * 100
