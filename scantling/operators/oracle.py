"""Labels from an expensive function, called once for each key and kept."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

Labeller = Callable[[DataFrame], DataFrame]


class LabelCache:
    """A table of labels by key. :meth:`get` calls the labeller for what is missing and counts those rows."""

    def __init__(self, keys: list[str], labeller: Labeller, table: DataFrame | None = None):
        self.keys, self.labeller, self.table, self.calls = keys, labeller, table, 0

    def override(self, table: DataFrame) -> None:
        """Use labels that exist already."""
        self.table = table

    def get(self, wanted: DataFrame) -> DataFrame:
        """Labels of the wanted keys. Each key is asked for once, however often it is wanted; nulls are keys like any other."""
        from scantling.sources.shared import materialize

        keys = wanted.select(*self.keys).distinct()
        missing = keys if self.table is None else self._keyed(keys, "left_anti")
        made = materialize(self.labeller(missing), "labels")
        self.calls += made.select(*self.keys).distinct().count()
        self.table = made if self.table is None else self.table.unionByName(made)
        return self._keyed(self.table, "left_semi", keys)

    def _keyed(self, left: DataFrame, how: str, right: DataFrame | None = None) -> DataFrame:
        right = (self.table if right is None else right).select(*[F.col(k).alias(f"__{k}") for k in self.keys])
        on = [F.col(k).eqNullSafe(F.col(f"__{k}")) for k in self.keys]
        return left.join(right, on, how)
