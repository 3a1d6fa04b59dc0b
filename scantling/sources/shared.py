"""Tables written to the folder that all executors share."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager
from contextvars import ContextVar

from pyspark.sql import DataFrame, SparkSession

_SCRATCH: ContextVar[Scratch | None] = ContextVar("scratch", default=None)


def shared_dir(spark: SparkSession) -> str:
    """spark.checkpoint.dir. Where that is unset, a folder made for this session if it runs in one process; on a cluster that raises."""
    found = spark.sparkContext.getConf().get("spark.checkpoint.dir") or spark.conf.get("spark.checkpoint.dir", None)
    if not found:
        if not spark.sparkContext.master.startswith("local"):
            raise RuntimeError("spark.checkpoint.dir is not set: executors need a folder that they share")
        found = "file://" + tempfile.mkdtemp(prefix="scantling-")
        spark.conf.set("spark.checkpoint.dir", found)
    return found.rstrip("/")


def new_path(spark: SparkSession, label: str) -> str:
    """A folder that isn't there yet, in the shared one; a scratch deletes it."""
    path = f"{shared_dir(spark)}/{label}-{uuid.uuid4().hex}"
    if (made := _SCRATCH.get()) is not None:
        made.paths.append(path)
    return path


def materialize(df: DataFrame, label: str) -> DataFrame:
    """Write ``df`` as Parquet in the shared folder and read it back: cuts lineage, survives lost executors."""
    path = new_path(df.sparkSession, label)
    df.write.option("compression", "zstd").parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def _delete(spark: SparkSession, path: str) -> None:
    jvm, conf = spark.sparkContext._jvm, spark.sparkContext._jsc.hadoopConfiguration()
    at = jvm.org.apache.hadoop.fs.Path(path)
    at.getFileSystem(conf).delete(at, True)


def drop_materialized(df: DataFrame) -> None:
    """Delete the files behind a frame that :func:`materialize` returned."""
    for name in df.inputFiles()[:1]:
        _delete(df.sparkSession, name.rsplit("/", 1)[0])


class Scratch:
    """What was materialized in a stretch of work; :meth:`keep` takes a frame's files out of what is deleted at its end."""

    def __init__(self):
        self.paths: list[str] = []
        self.kept: list[str] = []

    def keep(self, df: DataFrame) -> DataFrame:
        held = {name.rsplit("/", 1)[0].rsplit("/", 1)[1] for name in df.inputFiles()[:1]}
        self.kept += [p for p in self.paths if p.rsplit("/", 1)[1] in held]
        self.paths = [p for p in self.paths if p not in self.kept]
        return df


@contextmanager
def scratch(spark: SparkSession) -> Iterator[Scratch]:
    """Deletes at its end what was materialized within and isn't kept. What is kept belongs to the stretch of work around it, if any."""
    outer, own = _SCRATCH.get(), Scratch()
    _SCRATCH.set(own)
    try:
        yield own
    finally:
        _SCRATCH.set(outer)
        if outer is not None:
            outer.paths += own.kept
        for path in own.paths:
            _delete(spark, path)
