"""Conditions on regions, detections and pairs of them."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from scantling.functions import geometry as g

#: Least confidence by kind of detector.
MIN_CONFIDENCE = {"box": 0.2, "mask": 0.8}


def clear_of(r: Column, skip: list[Column], share: float = 0.3) -> Column:
    """No rectangle of ``skip`` covers more than this share."""
    return ~g.any_of([g.overlap_area(r, s) > share * g.area(r) for s in skip])


def size_between(r: Column, min_w=0, min_h=0, max_w=None, max_h=None) -> Column:
    out = (g.width(r) >= min_w) & (g.height(r) >= min_h)
    if max_w is not None:
        out = out & (g.width(r) <= max_w)
    return out if max_h is None else out & (g.height(r) <= max_h)


def mostly_in(r: Column, valid: Column, share: float = 0.5) -> Column:
    return g.overlap_area(r, valid) > share * g.area(r)


def object_counts(name: Column, r: Column, valid: Column, bans: list[Column], classes: list[str], inside: float = 0.7, banned: float = 0.3) -> Column:
    """Whether a detection counts: its class is asked for, it lies in the valid area and in no banned one; bounds included."""
    covered = lambda b, s: g.overlap(r, b).isNotNull() & (g.overlap_area(r, b) >= s * g.area(r))
    return name.isin(classes) & covered(valid, inside) & ~g.any_of([covered(b, banned) for b in bans])


def confident(confidence: Column, name: Column, classes: list[str], least: float = 0.5) -> Column:
    return (confidence > least) & name.isin(classes)


def in_region(r: Column, crop: Column, excluded: list[Column], share: float = 0.25, most: float = 0.6) -> Column:
    """At least ``share`` in the crop, and no excluded area covers more than ``most``."""
    kept = g.overlap(r, crop).isNotNull() & (g.overlap_share(r, crop) >= share)
    return kept & ~g.any_of([g.overlap_share(r, e) > most for e in excluded])


def in_region_strict(r: Column, confidence: Column, crop: Column, excluded: list[Column], least: float, share: float = 0.25, most: float = 0.6) -> Column:
    """Over ``share`` in the crop, excluded areas together cover no more than ``most``, confidence at least ``least``."""
    covered = F.lit(0.0)
    for e in excluded:
        covered = covered + g.overlap_area(r, e)
    return (confidence >= least) & (g.overlap_share(r, crop) > share) & ~(covered / g.area(r) > most)


def binary(score: Column) -> Column:
    return F.when(score > 0, 1.0).otherwise(0.0)


def close_absolute(a: Column, b: Column, most: float) -> Column:
    return g.centre_distance(a, b) <= most


def close_relative(a: Column, b: Column, k: float) -> Column:
    return g.centre_distance(a, b) <= k * F.least(g.diagonal(a), g.diagonal(b))


def close_edges(a: Column, b: Column, most: float) -> Column:
    return g.edge_distance(a, b)["d"] <= most


def linked(name_a: Column, a: Column, name_b: Column, b: Column, least: float = 0.7) -> Column:
    """Same class and IoU above ``least``."""
    return (name_a == name_b) & (g.iou(a, b) > least)


def same_classes(a: Column, b: Column, alias: dict[str, str] | None = None) -> Column:
    """Whether two arrays of class names have equal sets, some names standing for others."""
    named = lambda x: F.array_sort(F.array_distinct(F.transform(x, lambda n: _alias(n, alias or {}))))
    return named(a) == named(b)


def _alias(n: Column, alias: dict[str, str]) -> Column:
    for k, v in alias.items():
        n = F.when(n == k, v).otherwise(n)
    return n


def close_positions(a: Column, b: Column, most: float = 100.0) -> Column:
    """Arrays of points of one size in which every point of ``a`` has one of ``b`` nearer than ``most``."""
    return (F.size(a) == F.size(b)) & F.forall(a, lambda p: F.exists(b, lambda q: g.distance(p["x"], p["y"], q["x"], q["y"]) < most))
