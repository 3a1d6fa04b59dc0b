"""Layouts: regions merged to a fixed point, cut lines, cell grids, tile merges by cost, and the catalog's arithmetic."""

from __future__ import annotations

import bisect
import math
from collections.abc import Callable
from itertools import combinations

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from scantling.operators.sampling import running

Box = tuple[float, float, float, float]


def meets(a: Box, b: Box) -> bool:
    """Whether two boxes meet; a common edge counts."""
    return a[0] <= b[2] and b[0] <= a[2] and a[1] <= b[3] and b[1] <= a[3]


def near_centres(k: float) -> Callable[[Box, Box], bool]:
    def test(a: Box, b: Box) -> bool:
        d = math.hypot((a[0] + a[2] - b[0] - b[2]) / 2, (a[1] + a[3] - b[1] - b[3]) / 2)
        return d <= k * min(math.hypot(a[2] - a[0], a[3] - a[1]), math.hypot(b[2] - b[0], b[3] - b[1]))

    return test


def combine(boxes: list[Box], together: Callable[[Box, Box], bool]) -> list[Box]:
    """Boxes, largest first, each taking in later ones it is together with and growing, until a pass changes nothing."""
    boxes = list(boxes)
    while True:
        boxes.sort(key=lambda b: (-(b[2] - b[0]) * (b[3] - b[1]), b))
        out, used, changed = [], [False] * len(boxes), False
        for i, a in enumerate(boxes):
            if used[i]:
                continue
            for j in range(i + 1, len(boxes)):
                if not used[j] and together(a, boxes[j]):
                    b = boxes[j]
                    a = (min(a[0], b[0]), min(a[1], b[1]), max(a[2], b[2]), max(a[3], b[3]))
                    used[j] = changed = True
            out.append(a)
        boxes = out
        if not changed:
            return sorted(boxes)


def cut_lines(spans: list[tuple[float, float]], size: int, least: int = 0) -> list[int]:
    """Rising cut lines from 0 to ``size``: strips that hold the spans, at even places; strips under ``least`` join a neighbour."""
    even = lambda v: int(v // 2 * 2)
    merged: list[list[int]] = []
    for a, b in sorted((max(0, even(a)), min(size, even(b + 1))) for a, b in spans):
        if merged and a < merged[-1][1]:
            merged[-1][1] = max(merged[-1][1], b)
        else:
            merged.append([a, b])
    lines = sorted({0, size, *(v for s in merged for v in s)})
    out = [0]
    for v in lines[1:-1]:
        if v - out[-1] >= least and size - v >= least:
            out.append(v)
    return [*out, size]


def layout(boxes: list[Box], width: int, height: int, prune: int = 20, least: int = 0) -> list[tuple[int, int, int, int, int, int, bool]]:
    """Cells (row, column, x1, y1, x2, y2, whether a region's centre lies in it) of a segment's regions."""
    kept = [b for b in combine(boxes, meets) if b[2] - b[0] >= prune and b[3] - b[1] >= prune]
    xs, ys = cut_lines([(b[0], b[2]) for b in kept], width, least), cut_lines([(b[1], b[3]) for b in kept], height, least)
    centres = [((b[0] + b[2]) / 2, (b[1] + b[3]) / 2) for b in kept]
    return [
        (r, c, xs[c], ys[r], xs[c + 1], ys[r + 1], any(xs[c] <= x <= xs[c + 1] and ys[r] <= y <= ys[r + 1] for x, y in centres))
        for r in range(len(ys) - 1) for c in range(len(xs) - 1)
    ]


CELLS = "row_no int, col_no int, x1 int, y1 int, x2 int, y2 int, has_roi boolean"


def merge_regions(roi: DataFrame, keys: list[str], together: Callable[[Box, Box], bool] = meets) -> DataFrame:
    """Regions of each group of ``keys`` merged to the fixed point.

    A group (a frame) has a few regions, so tasks are handed all groups of the first key (a segment) at once.
    """
    slim = roi.select(*keys, "x1", "y1", "x2", "y2")

    def several(pdf: pd.DataFrame) -> pd.DataFrame:
        groups: dict[tuple, list[Box]] = {}
        for row in pdf.itertuples(index=False, name=None):
            groups.setdefault(row[:-4], []).append(row[-4:])
        return pd.DataFrame([(*k, *box) for k, boxes in groups.items() for box in combine(boxes, together)], columns=[*keys, "x1", "y1", "x2", "y2"])

    return slim.groupBy(keys[0]).applyInPandas(several, slim.schema)


def generate_layouts(roi: DataFrame, seg: str, width: int, height: int, prune: int = 20, least: int = 0) -> DataFrame:
    """The cell grid of every segment."""
    slim = roi.select(seg, "x1", "y1", "x2", "y2")

    def one(pdf: pd.DataFrame) -> pd.DataFrame:
        cells = layout(list(pdf[["x1", "y1", "x2", "y2"]].itertuples(index=False, name=None)), width, height, prune, least)
        out = pd.DataFrame(cells, columns=["row_no", "col_no", "x1", "y1", "x2", "y2", "has_roi"])
        out.insert(0, seg, pdf[seg].iloc[0])
        return out

    return slim.groupBy(seg).applyInPandas(one, f"{seg} {slim.schema[seg].dataType.simpleString()}, {CELLS}")


# merges of a grid: lines between rows and columns are kept or removed


def grouping_cost(xs: list[int], ys: list[int], parents: dict[tuple[int, int], frozenset], rows: tuple[int, ...], cols: tuple[int, ...], cost: Callable[[float], float]) -> float:
    """Sum over groups of cells of the cost of their area times how many clusters they hold. ``rows``, ``cols``: kept inner lines."""
    rb, cb = [0, *rows, len(ys) - 1], [0, *cols, len(xs) - 1]
    total = 0.0
    for r1, r2 in zip(rb, rb[1:], strict=False):
        for c1, c2 in zip(cb, cb[1:], strict=False):
            held = frozenset().union(*[parents.get((r, c), frozenset()) for r in range(r1, r2) for c in range(c1, c2)])
            if held:
                total += cost((xs[c2] - xs[c1]) * (ys[r2] - ys[r1])) * len(held)
    return total


def best_tiling_brute(xs, ys, parents, cost) -> tuple[float, tuple[int, ...], tuple[int, ...]]:
    """Every choice of kept lines: for small grids, and to test the others against."""
    every = lambda n: [c for k in range(n) for c in combinations(range(1, n), k)]
    return min((grouping_cost(xs, ys, parents, r, c, cost), r, c) for r in every(len(ys) - 1) for c in every(len(xs) - 1))


def best_tiling(xs, ys, parents, cost) -> tuple[float, tuple[int, ...], tuple[int, ...]]:
    """The optimum: choices along the shorter axis are enumerated, the best cuts along the longer follow from prefixes."""
    n_rows, n_cols = len(ys) - 1, len(xs) - 1
    if n_rows > n_cols:
        flipped = {(c, r): v for (r, c), v in parents.items()}
        total, cols, rows = best_tiling(ys, xs, flipped, cost)
        return total, rows, cols
    best = (math.inf, (), ())
    for k in range(n_rows):
        for rows in combinations(range(1, n_rows), k):
            rb = [0, *rows, n_rows]
            state: list[tuple[float, tuple[int, ...]]] = [(0.0, ())]
            for end in range(1, n_cols + 1):
                options = []
                for start in range(end):
                    price = 0.0
                    for r1, r2 in zip(rb, rb[1:], strict=False):
                        held = frozenset().union(*[parents.get((r, c), frozenset()) for r in range(r1, r2) for c in range(start, end)])
                        if held:
                            price += cost((xs[end] - xs[start]) * (ys[r2] - ys[r1])) * len(held)
                    before, cuts = state[start]
                    options.append((before + price, cuts + ((start,) if start else ())))
                state.append(min(options))
            total, cols = state[-1]
            best = min(best, (total, rows, cols))
    return best


def greedy_tiling(xs, ys, parents, cost) -> tuple[float, tuple[int, ...], tuple[int, ...]]:
    """Lines removed one by one, the one that saves most first, while any saves."""
    rows, cols = tuple(range(1, len(ys) - 1)), tuple(range(1, len(xs) - 1))
    total = grouping_cost(xs, ys, parents, rows, cols, cost)
    while True:
        tries = [(grouping_cost(xs, ys, parents, tuple(x for x in rows if x != r), cols, cost), tuple(x for x in rows if x != r), cols) for r in rows]
        tries += [(grouping_cost(xs, ys, parents, rows, tuple(x for x in cols if x != c), cost), rows, tuple(x for x in cols if x != c)) for c in cols]
        if not tries or min(tries)[0] >= total:
            return total, rows, cols
        total, rows, cols = min(tries)


def valid_merges(n: int, has_roi: list[bool]) -> list[tuple[int, ...]]:
    """Sets of removed inner lines that leave each strip without a region merged on both sides or on neither, and none at the border."""
    inner = range(1, n)
    out = []
    for k in range(len(inner) + 1):
        for gone in combinations(inner, k):
            own = set(gone)
            if all(has_roi[i] or ((i in own) == (i + 1 in own) and not (i in own and i in (0, n - 1))) for i in range(n)):
                out.append(gone)
    return out


def optimise_segments(cells: DataFrame, seg: str, slope: float, base: float, method: str = "best") -> DataFrame:
    """For each segment with a grid of cells of 64 by 64 and cluster ids: cost before and after merging, and the lines kept."""
    solve = {"best": best_tiling, "greedy": greedy_tiling, "brute": best_tiling_brute}[method]
    slim = cells.select(seg, "row_no", "col_no", "cluster").distinct()

    def one(pdf: pd.DataFrame) -> pd.DataFrame:
        ys, xs = list(range(0, 64 * (int(pdf["row_no"].max()) + 2), 64)), list(range(0, 64 * (int(pdf["col_no"].max()) + 2), 64))
        parents = {k: frozenset(v["cluster"]) for k, v in pdf.groupby(["row_no", "col_no"])}
        cost = lambda a: slope * a + base
        before = grouping_cost(xs, ys, parents, tuple(range(1, len(ys) - 1)), tuple(range(1, len(xs) - 1)), cost)
        after, rows, cols = solve(xs, ys, parents, cost)
        return pd.DataFrame([(pdf[seg].iloc[0], round(before, 6), round(after, 6), ",".join(map(str, rows)), ",".join(map(str, cols)))], columns=[seg, "before", "after", "rows_kept", "cols_kept"])

    return slim.groupBy(seg).applyInPandas(one, f"{seg} {slim.schema[seg].dataType.simpleString()}, before double, after double, rows_kept string, cols_kept string")


def split_for_network(width: int, height: int, parts: int, k: float, b: float, floor: float, least: float = 1e6) -> list[tuple[int, int]]:
    """How to cut a tile of ``least`` pixels or more before a network: the grid of at most ``parts`` by ``parts`` of least cost."""
    cost = lambda a: k * a + b if a > (floor - b) / k else floor
    if width * height < least:
        return [(width, height)]
    _, r, c = min((i * j * cost(width * height / (i * j)), i, j) for i in range(1, parts + 1) for j in range(1, parts + 1))
    xs, ys = [round(width * i / c) for i in range(c + 1)], [round(height * i / r) for i in range(r + 1)]
    return [(x2 - x1, y2 - y1) for y1, y2 in zip(ys, ys[1:], strict=False) for x1, x2 in zip(xs, xs[1:], strict=False)]


# the catalog, as tables of segments and tiles


def catalog_totals(tiles: DataFrame) -> DataFrame:
    """Frames, tiles and tiles with regions, each counted once a frame."""
    segs = tiles.groupBy("seg_start", "seg_end").agg(F.count("*").alias("n"), F.count_if("has_roi").alias("r"))
    d = F.col("seg_end") - F.col("seg_start")
    return segs.agg(F.sum(d).alias("total_frames"), F.sum(d * F.col("n")).alias("total_tiles"), F.sum(d * F.col("r")).alias("tiles_with_roi"))


def grid_shapes(tiles: DataFrame) -> DataFrame:
    return tiles.groupBy("seg_start", "seg_end").agg((F.max("row_no") + 1).alias("rows"), (F.max("col_no") + 1).alias("cols"), (F.first("seg_end") - F.first("seg_start")).alias("duration"))


def fill_grid(known: DataFrame, seg: str) -> DataFrame:
    """All cells of the grid that the known cells' edges cut, with whether each is a known one."""
    cuts = known.groupBy(seg).agg(*[F.array_sort(F.array_distinct(F.concat(F.collect_set(a), F.collect_set(b)))).alias(n) for a, b, n in (("x1", "x2", "xs"), ("y1", "y2", "ys"))])
    pairs = lambda c: F.transform(F.sequence(F.lit(1), F.size(c) - 1), lambda i: F.struct(F.element_at(c, i).alias("a"), F.element_at(c, i + 1).alias("b")))
    rows = cuts.where((F.size("xs") > 1) & (F.size("ys") > 1)).select(seg, "xs", F.posexplode(pairs(F.col("ys"))).alias("row_no", "y"))
    cells = rows.select(seg, "row_no", "y", F.posexplode(pairs(F.col("xs"))).alias("col_no", "x"))
    cells = cells.select(seg, "row_no", "col_no", F.col("x.a").alias("x1"), F.col("y.a").alias("y1"), F.col("x.b").alias("x2"), F.col("y.b").alias("y2"))
    own = known.select(seg, "x1", "y1", "x2", "y2").distinct().withColumn("known", F.lit(True))
    return cells.join(own, [seg, "x1", "y1", "x2", "y2"], "left").withColumn("known", F.coalesce("known", F.lit(False)))


def merged_groups(tiles: DataFrame, seg: str, keep_line: Column, cost: Column) -> DataFrame:
    """Cells whose kept column lines are given, merged: area, clusters and their cost for each group."""
    line = tiles.select(seg, "col_no", keep_line.cast("int").alias("k")).distinct()
    grouped = line.withColumn("g", F.sum("k").over(Window.partitionBy(seg).orderBy("col_no"))).select(seg, "col_no", "g")
    each = tiles.join(grouped, [seg, "col_no"]).groupBy(seg, "row_no", "g").agg(F.count_distinct("col_no").alias("cells"), F.count_distinct("cluster").alias("clusters"))
    return each.withColumn("cost", F.round(cost * F.col("clusters"), 6))


def visible_cost(tiles: DataFrame, seg: str, cut: int, cost: Column, first: str = "seg_start", last: str = "seg_end", spans: DataFrame | None = None) -> DataFrame:
    """Cost of each segment's grid merged into groups of ``cut`` columns: area times distinct clusters, of segments that meet a span if given."""
    kept = tiles
    if spans is not None:
        # segments and spans meet by buckets of frames, so that the range join is an equi-join and a filter
        segs = tiles.select(F.col(first).alias("__first"), F.col(last).alias("__last")).distinct()
        size = segs.agg(F.ceil(F.avg(F.col("__last") - F.col("__first")))).first()[0] or 1
        cells = lambda a, b: F.explode(F.sequence(F.floor(F.col(a) / size), F.floor((F.col(b) - 1) / size)))
        met = segs.withColumn("__bucket", cells("__first", "__last")).join(spans.where("since < until").withColumn("__bucket", cells("since", "until")), "__bucket")
        met = met.where((F.col("__first") < F.col("until")) & (F.col("__last") > F.col("since"))).select("__first", "__last").distinct()
        kept = tiles.join(met, (F.col(first) == F.col("__first")) & (F.col(last) == F.col("__last")), "left_semi")
    grouped = kept.groupBy(seg, "row_no", F.floor(F.col("col_no") / cut).alias("g")).agg(F.count_distinct("col_no").alias("cells"), F.size(F.array_distinct(F.collect_set("cluster"))).alias("clusters"))
    return grouped.groupBy(seg).agg(F.round(F.sum(cost * F.col("clusters")), 6).alias("cost"))


def hierarchical_layout(cells: DataFrame, seg: str) -> DataFrame:
    """Rows and columns of a fine grid without any region collapsed into one strip where they are neighbours; a coarse tile keeps its fine cells.

    ``seg``, ``coarse_row``, ``coarse_col``, ``has_roi`` and ``fine``: the positions of the region cells inside.
    """
    out = cells
    for axis, name in (("row_no", "coarse_row"), ("col_no", "coarse_col")):
        line = cells.groupBy(seg, axis).agg(F.bool_or("has_roi").alias("any"))
        w = Window.partitionBy(seg).orderBy(axis)
        new = F.when(~F.col("any") & ~F.coalesce(F.lag("any").over(w), F.lit(True)), 0).otherwise(1)
        numbered = line.withColumn("new", new).withColumn(name, F.sum("new").over(w) - 1).select(seg, axis, name)
        out = out.join(numbered, [seg, axis])
    fine = F.sort_array(F.collect_list(F.when(F.col("has_roi"), F.concat_ws("_", "row_no", "col_no"))))
    return out.groupBy(seg, "coarse_row", "coarse_col").agg(F.bool_or("has_roi").alias("has_roi"), fine.alias("fine"))


def roi_pipeline(roi: DataFrame, seg: str, width: int, height: int, keep: Column | None = None, prune: int = 20, least: int = 0) -> DataFrame:
    """From regions of frames to the tiles of each segment: filter, merge within frames and across them, cut, mark."""
    kept = roi.where(keep) if keep is not None else roi
    return generate_layouts(merge_regions(kept, [seg, "t"]), seg, width, height, prune, least)


def densest_frame(roi: DataFrame, tile_w: int, tile_h: int) -> DataFrame:
    """For each cell the frame whose regions centred there have the greatest area; ties by the earliest."""
    col, row = F.floor((F.col("x1") + F.col("x2")) / 2 / tile_w), F.floor((F.col("y1") + F.col("y2")) / 2 / tile_h)
    area = (F.col("x2") - F.col("x1")) * (F.col("y2") - F.col("y1"))
    sums = roi.groupBy(row.alias("row_no"), col.alias("col_no"), "t").agg(F.sum(area).alias("area"))
    top = F.max_by(F.struct("t", "area"), F.struct("area", -F.col("t"))).alias("top")
    return sums.groupBy("row_no", "col_no").agg(top).select("row_no", "col_no", "top.t", "top.area")


def coalesced_segments(tiles: DataFrame) -> DataFrame:
    """Neighbouring segments with one layout, joined."""
    cell = F.concat_ws("_", "row_no", "col_no", F.col("has_roi").cast("string"))
    shape = tiles.select("seg_start", "seg_end", cell.alias("cell")).groupBy("seg_start", "seg_end").agg(F.md5(F.array_join(F.array_sort(F.collect_set("cell")), ",").cast("binary")).alias("layout"))
    placed = running(shape, [F.asc("seg_start"), F.asc("seg_end")])
    before = placed.select((F.col("rank") + 1).alias("rank"), F.col("layout").alias("__layout"), F.col("seg_end").alias("__end"))
    joined = placed.join(before, "rank", "left")
    new = F.coalesce(((F.col("__layout") != F.col("layout")) | (F.col("__end") != F.col("seg_start"))).cast("int"), F.lit(1))
    part = running(joined.select("rank", "seg_start", "seg_end", new.alias("new")), [F.asc("rank")], {"part": F.col("new")}, "__rank")
    return part.groupBy("part").agg(F.min("seg_start").alias("seg_start"), F.max("seg_end").alias("seg_end"), F.count("*").alias("n")).drop("part")


def locate(frame: int, starts: list[int]) -> int:
    """Place of the half-open segment that holds a frame."""
    return bisect.bisect_right(starts, frame) - 1
