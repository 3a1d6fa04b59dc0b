"""Helpers shared by the operators of this subpackage."""

from __future__ import annotations

import ctypes
import gc
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from scantling.sources.shared import drop_materialized, materialize, scratch

__all__ = ["WORD_PATTERN", "drop_materialized", "give_back", "map_columns", "materialize", "scratch", "slices", "table", "texts_of"]

#: Bytes that part words: space and the characters 9 to 13. ``bytes.split()`` parts at exactly these.
WORD_PATTERN = r"[^\x20\x09-\x0D]+"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A table of a data folder, through Spark's reader (the folder may be in any store Spark reads)."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def texts_of(column: pa.Array) -> list[bytes]:
    """The UTF-8 bytes of a string column, null as empty, without decoding to ``str``."""
    return [x or b"" for x in column.cast(pa.binary()).to_pylist()]


def give_back() -> None:
    """Return freed memory to the system at the end of a task: workers are kept for later tasks and share an executor's memory."""
    gc.collect()
    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL("libc.so.6").malloc_trim(0)
    except (OSError, AttributeError):
        pass  # another C library


def slices(lengths: list[int], most: int) -> Iterator[tuple[int, int]]:
    """Ranges of rows of about ``most`` bytes together (at least a row each): bounds what one step holds in memory."""
    start = held = 0
    for i, n in enumerate(lengths):
        if held and held + n > most:
            yield start, i
            start, held = i, 0
        held += n + 1
    if start < len(lengths):
        yield start, len(lengths)


def map_columns(
    df: DataFrame, keys: list[str], text: str, kind: str, schema: T.StructType,
    step: Callable[[list[bytes]], dict[str, list]], most: int = 4 << 20,
) -> DataFrame:
    """``keys`` kept and the columns of ``schema`` added to each row by ``step``, which gets texts as bytes, a few MB at a time.

    Rows whose text is null get what an empty text gets. ``kind`` is the Spark type that ``text`` is cast to.
    """
    wanted = [F.col(f"`{k}`") for k in keys] + [F.col(f"`{text}`").cast(kind).alias("__text")]
    frame = df.select(*wanted)
    out = T.StructType([*(frame.schema[k] for k in keys), *schema.fields])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark.sql.pandas.types import to_arrow_schema

        arrow = to_arrow_schema(out)
        for batch in batches:
            texts = texts_of(batch.column(len(keys)))
            for a, b in slices([len(x) for x in texts], most):
                made = step(texts[a:b])
                held = [batch.column(i).slice(a, b - a).cast(arrow.field(i).type) for i in range(len(keys))]
                made_columns = [pa.array(made[f.name], arrow.field(f.name).type) for f in schema.fields]
                yield pa.RecordBatch.from_arrays([*held, *made_columns], schema=arrow)
        batch = texts = made = held = made_columns = None
        give_back()

    return frame.mapInArrow(run, out)
