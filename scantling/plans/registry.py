"""Every query of the engine by name, with its SQL where it has one."""

from __future__ import annotations

import importlib

from pyspark.sql import DataFrame, SparkSession

from scantling.plans.base import Query

MODULES = ("scalars", "relational", "semantic", "ingest", "further")


def _all() -> dict[str, tuple[Query, str | None]]:
    out: dict[str, tuple[Query, str | None]] = {}
    for name in MODULES:
        found = importlib.import_module(f"scantling.plans.{name}").QUERIES
        if twice := out.keys() & found.keys():
            raise ValueError(f"queries of one name: {sorted(twice)}")
        out |= found
    return out


def queries() -> dict[str, Query]:
    return {k: f for k, (f, _) in _all().items()}


def oracle_sql() -> dict[str, str]:
    return {k: s for k, (_, s) in _all().items() if s}


def flagship(spark: SparkSession, sf_dir: str) -> DataFrame:
    return queries()["a05_approximate_sum"](spark, sf_dir)
