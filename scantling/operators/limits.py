"""Limit queries with spacing, track queries and sub-frame scans: find enough with few calls of a labelling function."""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

RESULT = "t long, n_found int, n_calls long"


#: The most frames that are fetched at a time.
PAGE = 1 << 17


def pages(frames: DataFrame, keys: list[tuple[str, bool]], columns: list[str], first: int) -> Iterator[tuple]:
    """Rows of ``frames`` in order of ``keys`` (name, whether falling; together unique, no nulls), fetched a page at a time.

    Each page is a top-n behind the last row of the one before, so there is no global sort and the driver holds one page. Pages grow
    fourfold up to ``PAGE``.
    """
    size, behind = first, None
    order = [F.desc(k) if falling else F.asc(k) for k, falling in keys]
    names = [k for k, _ in keys]
    while True:
        rows = (frames if behind is None else frames.where(behind)).orderBy(*order).limit(size).select(*names, *columns).collect()
        yield from (tuple(r)[len(names) :] for r in rows)
        if len(rows) < size:
            return
        behind, equal = F.lit(False), F.lit(True)
        for k, falling in keys:
            value = F.lit(rows[-1][k])
            behind = behind | (equal & ((F.col(k) < value) if falling else (F.col(k) > value)))
            equal = equal & (F.col(k) == value)
        size = min(PAGE, 4 * size)


def spaced_search(frames: Iterable[tuple[int, list[float]]], want: float, limit: int, gap: int) -> list[tuple[int, int, int]]:
    """Accepted frames in order, as (frame, how many so far, calls so far).

    ``frames``: in order of search, each with the true scores of its tiles in order of their proxies. Each tile looked at is a call.
    A frame is accepted when its scores reach ``want``; accepted frames suppress those within ``gap``, failing ones don't.
    """
    out, calls, taken = [], 0, set()
    if limit < 1:
        return out
    for t, scores in frames:
        if t in taken:
            continue
        total = 0.0
        for s in scores:
            calls += 1
            total += s
            if total >= want:
                out.append((t, len(out) + 1, calls))
                taken.update(range(t - gap, t + gap + 1))
                break
        if len(out) >= limit:
            break
    return out


def scored_frames(tiles: DataFrame, id_col: str) -> DataFrame:
    """``t``, ``score`` (sum of the proxies above 0) and ``ys`` (true scores by falling proxy) of each frame, written so that pages of it are cheap."""
    from scantling.sources.shared import materialize

    live = tiles.where(F.col("proxy") > 0)
    order = F.sort_array(F.collect_list(F.struct((-F.col("proxy")).alias("p"), F.col(id_col).alias("i"), F.col("truth").alias("y"))))
    return materialize(live.groupBy("t").agg(F.sum("proxy").alias("score"), F.transform(order, lambda x: x["y"]).alias("ys")), "frames")


BEST = [("score", True), ("t", False)]


def limit_query(tiles: DataFrame, want: float, limit: int, gap: int, batch: int = 2000, id_col: str = "tile_id") -> DataFrame:
    """``t``, ``n_found``, ``n_calls`` of the first ``limit`` frames whose true score reaches ``want``, in order of summed proxy.

    Frames are fetched best first, a page at a time, until enough are found or all were seen; only proxies above 0 take part.
    """
    frames = pages(scored_frames(tiles, id_col), BEST, ["t", "ys"], batch)
    return tiles.sparkSession.createDataFrame(spaced_search(frames, want, limit, gap), RESULT)


def batched_search(frames: Iterable[tuple[int, list[float]]], want: float, limit: int, gap: int, batch: int) -> list[tuple[int, int, int]]:
    """The same search with ``batch`` calls at a time: the best tile left of each frame, frames near one at work postponed.

    Ends where no candidate is left, with what was found. Of the frames only those are held that are still open.
    """
    more = iter(frames)
    left: dict[int, list[float]] = {}  # open frames in order of search
    totals: dict[int, float] = {}
    working: set[int] = set()
    done: set[int] = set()
    out, calls = [], 0
    near = lambda t: any(t + o in working for o in range(-gap, gap + 1) if o)
    while len(out) < limit:
        group: list[tuple[int, float]] = []
        gone = []

        def consider(t: int, group=group, gone=gone) -> None:
            if t in done:
                gone.append(t)
            elif gap and near(t):
                return
            elif not left[t]:
                working.discard(t)
                gone.append(t)
            else:
                working.add(t)
                group.append((t, left[t].pop(0)))

        for t in left:
            if len(group) == batch:
                break
            consider(t)
        for t in gone:
            del left[t]
            totals.pop(t, None)
        gone.clear()
        while len(group) < batch and (got := next(more, None)) is not None:
            left[got[0]] = list(got[1])
            consider(got[0])
        for t in gone:
            del left[t]
        if not group:
            break
        for t, s in group:
            calls += 1
            totals[t] = totals.get(t, 0.0) + s
            if totals[t] >= want and t not in done:
                out.append((t, len(out) + 1, calls))
                if len(out) >= limit:
                    break
                done.update(range(t - gap, t + gap + 1))
    return out


def batched_query(tiles: DataFrame, want: float, limit: int, gap: int, calls: int, batch: int = 2000, id_col: str = "tile_id") -> DataFrame:
    """:func:`limit_query` with ``calls`` calls at a time: :func:`batched_search` over the best frames, fetched a page at a time."""
    frames = pages(scored_frames(tiles, id_col), BEST, ["t", "ys"], batch)
    return tiles.sparkSession.createDataFrame(batched_search(frames, want, limit, gap, calls), RESULT)


def frame_limit(frames: DataFrame, order: list[tuple[str, bool]], accepted: str, limit: int, gap: int, batch: int = 5000) -> DataFrame:
    """Frames in a given order (names, and whether falling), one call each, accepted if ``accepted`` holds, with spacing."""
    rows = ((t, [1.0 if ok else 0.0]) for t, ok in pages(frames, order, ["t", accepted], batch))
    return frames.sparkSession.createDataFrame(spaced_search(rows, 1.0, limit, gap), RESULT)


def spacing(df: DataFrame, group: str, key: str, score: str, gap: int) -> DataFrame:
    """In each group: rows by falling score, each kept unless a kept one lies within ``gap``."""
    slim = df.select(group, key, score)

    def one(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values([score, key], ascending=[False, True], ignore_index=True)
        taken: set[int] = set()
        keep = []
        for t in pdf[key]:
            keep.append(t not in taken)
            if keep[-1]:
                taken.update(range(t - gap, t + gap + 1))
        return pdf[keep]

    return slim.groupBy(group).applyInPandas(one, slim.schema)


def track_query(workload: DataFrame, tiles: DataFrame, labelled: DataFrame, id_col: str = "tile_id") -> DataFrame:
    """Tiles with a positive proxy in the frames of a workload that have no label yet, once for each time asked, and how many are empty."""
    open_ = tiles.where(F.col("proxy") > 0).join(labelled.select(id_col).distinct(), id_col, "left_anti")
    return workload.join(open_, "t").agg(F.count("*").alias("tiles"), F.count_if(F.col("truth") <= 0).alias("false_positive"))


def track_query_batched(workload: DataFrame, tiles: DataFrame, labelled: DataFrame, batch: int, id_col: str = "tile_id") -> DataFrame:
    """For each workload: tiles to look at, the batches of ``batch`` tiles they fill, calls of the labeller and tiles in its last batch.

    ``workload``: ``workload_id``, ``ord`` and ``t``; frames that no tile has are skipped, those asked for twice count twice, but a tile is
    called for once and only if it has no label yet (``labelled``). Tiles take part whose proxy is above 0.
    """
    open_ = tiles.where(F.col("proxy") > 0).join(labelled.select(id_col, F.lit(True).alias("__known")).distinct(), id_col, "left")
    asked = workload.join(open_.select("t", id_col, "__known"), "t")
    calls = F.count_distinct(F.when(F.col("__known").isNull(), F.col(id_col)))
    each = asked.groupBy("workload_id").agg(F.count("*").alias("tiles"), calls.alias("calls"))
    return each.select("workload_id", "tiles", F.ceil(F.col("tiles") / batch).alias("batches"), "calls", ((F.col("tiles") - 1) % batch + 1).alias("in_last"))


def query_cost(counts: DataFrame, decode_ms: float, label_ms: float) -> DataFrame:
    """Seconds that a query's tiles take: each decoded, each call of the labeller; ``counts`` has ``tiles`` and ``calls``."""
    decode, nn = F.col("tiles") * decode_ms / 1000, F.col("calls") * label_ms / 1000
    return counts.select("*", F.round(decode, 6).alias("decode_s"), F.round(nn, 6).alias("nn_s"), F.round(decode + nn, 6).alias("total_s"))


def subframe_query(tiles: DataFrame, wanted: Column, width: Column, height: Column, frames: Column) -> DataFrame:
    """Tiles to scan (once a frame) and their pixels, of those whose information names a wanted class."""
    return tiles.where(wanted).agg(F.sum(frames).alias("tiles"), F.sum(width * height * frames).cast("long").alias("area"))
