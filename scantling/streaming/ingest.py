"""Structured Streaming forms of the ingest path: count windows by segment, layout runs, background models, reordering."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def segment_windows(stream: DataFrame, frame: str, seconds: str, length: int, fps: int = 30, late: str = "10 seconds") -> DataFrame:
    """Counts of regions in tumbling windows of ``length`` frames; ``seconds`` is the frame's time. The tail is flushed by the watermark."""
    return (
        stream.withWatermark(seconds, late)
        .groupBy(F.window(seconds, f"{length * 1000 // fps} milliseconds"), (F.floor(F.col(frame) / length) * length).alias("seg_start"))
        .agg(F.count("*").alias("n"), F.min(frame).alias("first"), F.max(frame).alias("last"))
    )


def with_time(stream: DataFrame, frame: str, fps: int = 30) -> DataFrame:
    """The time of a frame number at so many frames a second, from the epoch."""
    return stream.withColumn("seconds", F.timestamp_millis((F.col(frame) * 1000 / fps).cast("long")))


def run_batches(stream: DataFrame, apply: Callable[[DataFrame], DataFrame], path: str, checkpoint: str) -> None:
    """Apply a batch operator to what is available, once, and append its rows as Parquet; each micro-batch is idempotent by its number."""

    def write(df: DataFrame, epoch: int) -> None:
        apply(df).write.mode("overwrite").parquet(f"{path}/epoch={epoch}")

    stream.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).trigger(availableNow=True).start().awaitTermination()


END_OF_STREAM = 1 << 62


def reorder(stream: DataFrame, group: str, frame: str, payload: str, first: int = 0, most_held: int = 960) -> DataFrame:
    """``group``, ``frame``, ``payload`` in rising, gapless order of frames within each group, from frames that arrive in any order.

    A frame waits as state until those before it have come. Where more than ``most_held`` wait, the missing ones are taken for lost and
    left out. Frames that come again, or after they were taken for lost, are dropped.
    """
    from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

    def step(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        at, ts, values = state.get if state.exists else (first, [], [])
        held, out = dict(zip(ts, values, strict=True)), []
        for pdf in batches:
            for t, value in pdf[[frame, payload]].itertuples(index=False, name=None):
                if t >= at:
                    held.setdefault(int(t), value)
        while held:
            if at not in held:
                if len(held) <= most_held:
                    break
                at = min(held)
            out.append((key[0], at, held.pop(at)))
            at += 1
        ts = sorted(held)
        state.update((at, ts, [held[t] for t in ts]))
        yield pd.DataFrame(out, columns=["grp", "t", "payload"])

    slim = stream.select(F.col(group).cast("string").alias("grp"), F.col(frame).cast("long").alias(frame), F.col(payload).cast("string").alias(payload))
    return slim.groupBy("grp").applyInPandasWithState(step, "grp string, t long, payload string", "at long, ts array<long>, held array<string>", "append", GroupStateTimeout.NoTimeout)


def bounded(spark, schema: str, path: str, files: int = 1000) -> DataFrame:
    """A stream of Parquet files that takes in ``files`` of them at a time: the bound on what waits."""
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", files).parquet(path)


def layout_runs(stream: DataFrame, camera: str, frame: str, layout: str) -> DataFrame:
    """A row for each run of frames of one layout of a camera, when it ends: ``camera``, ``first``, ``last``, ``layout``.

    The open run is state. A row with frame ``END_OF_STREAM`` ends a camera's last run.
    """
    from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

    def step(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        rows = []
        first, last, held = state.get if state.exists else (None, None, None)
        for t, value in sorted({r for pdf in batches for r in pdf[[frame, layout]].itertuples(index=False, name=None)}, key=lambda r: r[0]):
            if t == END_OF_STREAM:
                if held is not None:
                    rows.append((key[0], first, last, held))
                first = last = held = None
                continue
            if held is None:
                first, held = t, value
            elif value != held:
                rows.append((key[0], first, last, held))
                first, held = t, value
            last = t
        if held is None:
            if state.exists:
                state.remove()
        else:
            state.update((first, last, held))
        yield pd.DataFrame(rows, columns=["camera", "first", "last", "layout"])

    return stream.select(F.col(camera).cast("string").alias("camera"), frame, layout).groupBy("camera").applyInPandasWithState(
        step, "camera string, first long, last long, layout string", "first long, last long, layout string", "append", GroupStateTimeout.NoTimeout)


def moving(stream: DataFrame, camera: str, frame: str, value: str, threshold: float, rate: float = 0.1) -> DataFrame:
    """A background model of each camera (a running mean as state): rows that differ from it by more than ``threshold``."""
    from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

    def step(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        mean = state.get[0] if state.exists else None
        rows = []
        for t, v in sorted(r for pdf in batches for r in pdf[[frame, value]].itertuples(index=False, name=None)):
            if mean is not None and abs(v - mean) > threshold:
                rows.append((key[0], t, v, mean))
            mean = v if mean is None else mean + rate * (v - mean)
        if mean is not None:
            state.update((float(mean),))
        yield pd.DataFrame(rows, columns=["camera", "t", "value", "background"])

    return stream.select(F.col(camera).cast("string").alias("camera"), frame, value).groupBy("camera").applyInPandasWithState(
        step, "camera string, t long, value double, background double", "mean double", "append", GroupStateTimeout.NoTimeout)
