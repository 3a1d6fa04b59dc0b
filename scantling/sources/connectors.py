"""Sources and sinks: detections, proxies, workloads, catalogs, frames and tiles, through Spark's readers and writers."""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window

DETECTIONS = "frame BIGINT, object_name STRING, confidence DOUBLE, xmin DOUBLE, ymin DOUBLE, xmax DOUBLE, ymax DOUBLE, ind BIGINT"
PROXY = "id BIGINT, proxy_score DOUBLE, label DOUBLE"
TILE = "struct<rows:int,cols:int,duration:bigint,roi:map<string,string>>"
CATALOG = f"layouts map<string,{TILE}>, video struct<width:int,height:int,gop:int,total_frames:bigint,total_tiles:bigint,tiles_with_roi:bigint>"


def read_detections(spark: SparkSession, path: str, classes: list[str] | None = None) -> DataFrame:
    """Detections from CSV with a header; a folder or a glob is read in parallel. The schema is given, never inferred."""
    df = spark.read.schema(DETECTIONS).csv(path, header=True)
    return df.where(F.col("object_name").isin(classes)) if classes else df


def read_raw_detections(spark: SparkSession, path: str, names: dict[int, str], wanted: list[str]) -> DataFrame:
    """Columnar detections by class id, named by a small dimension, restricted to wanted names."""
    return name_detections(spark.read.parquet(path), names, wanted)


def name_detections(df: DataFrame, names: dict[int, str], wanted: list[str]) -> DataFrame:
    name = F.create_map(*[F.lit(x) for k, v in names.items() for x in (k, v)])[F.col("cname")]
    return df.withColumn("object_name", name).where(F.col("object_name").isin(wanted))


def read_tile_labels(spark: SparkSession, path: str, schema: str, classes: list[str]) -> DataFrame:
    """Label records of each frame and tile (``row_col``) as one list."""
    df = spark.read.schema(schema).csv(path, header=True).where(F.col("object_name").isin(classes))
    return df.groupBy("frame", "tile").agg(F.sort_array(F.collect_list("object_name")).alias("names"))


def read_proxy(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(PROXY).csv(path, header=True)


def presence_source(det: DataFrame, probabilities: DataFrame, frame: str = "frame") -> DataFrame:
    """Proxy rows of frames that both sides have: whether a detection is present, and the second class's softmax of two logits."""
    seen = det.groupBy(F.col(frame).alias("id")).agg(F.lit(1.0).alias("label"))
    p = probabilities.select(F.col("id"), (1 / (1 + F.exp(F.get("logits", F.lit(0)) - F.get("logits", F.lit(1))))).alias("proxy_score"))
    return p.join(seen, "id", "left").select("id", "proxy_score", F.coalesce("label", F.lit(0.0)).alias("label"))


def beta_source(spark: SparkSession, n: int, alpha: float, beta: float, seed: int = 3212142, noise: float = 0.0, block: int = 50_000) -> DataFrame:
    """A synthetic proxy: Beta draws as scores, labels by them, noise on scores clipped to [0, 1]. Each block of ids has its own seed, so partitions don't matter."""

    def draw(batches):
        for pdf in batches:
            for b in pdf["id"]:
                rng = np.random.default_rng([seed, int(b)])
                size = min(block, n - int(b) * block)
                p = rng.beta(alpha, beta, size)
                label = (rng.random(size) < p).astype(float)
                if noise:
                    p = np.clip(p + rng.normal(0, noise, size), 0, 1)
                yield pd.DataFrame({"id": np.arange(size) + int(b) * block, "proxy_score": p, "label": label})

    return spark.range(-(-n // block)).mapInPandas(draw, PROXY)


def read_workload(spark: SparkSession, path: str, src_fps: int = 10, dst_fps: int = 30) -> DataFrame:
    """``file``, ``workload_id``, ``ord``, ``t`` of texts of frame numbers in which lines of ``#`` part workloads; each file is an order of lines of its own."""
    lines = spark.read.text(path, wholetext=True).select(F.input_file_name().alias("file"), F.posexplode(F.split("value", "\n")).alias("ord", "line"))
    marked = lines.withColumn("mark", F.trim("line").startswith("#").cast("int"))
    numbered = marked.withColumn("workload_id", F.sum("mark").over(Window.partitionBy("file").orderBy("ord")))
    kept = numbered.where((F.col("mark") == 0) & F.trim("line").rlike(r"^\d+$"))
    return kept.select("file", F.col("workload_id").cast("int").alias("workload_id"), F.col("ord").cast("long").alias("ord"), F.floor(F.trim("line").cast("long") * (dst_fps / src_fps)).cast("long").alias("t"))


def read_catalog(spark: SparkSession, path: str) -> DataFrame:
    """Tiles of a JSON catalog: segment, grid, position and rectangle."""
    layouts = spark.read.schema(CATALOG).json(path, multiLine=True).select(F.explode("layouts").alias("key", "v"))
    ends = F.split("key", "_")
    tiles = layouts.select(ends[0].cast("long").alias("seg_start"), ends[1].cast("long").alias("seg_end"), "v.rows", "v.cols", F.explode("v.roi").alias("cell", "rect"))
    return tiles.select("seg_start", "seg_end", "rows", "cols", F.split("cell", "_")[0].cast("int").alias("row_no"), F.split("cell", "_")[1].cast("int").alias("col_no"), "rect")


def read_video(spark: SparkSession, path: str) -> DataFrame:
    """A row with the resolution, the frames between seek points and the totals that a catalog holds of its video."""
    return spark.read.schema(CATALOG).json(path, multiLine=True).select("video.*")


def discover_grid(files: DataFrame, first: int | None = None, last: int | None = None) -> DataFrame:
    """Segments and their grids from names of tile files, ``.../<start>_<end>/<row>_<col>.<ext>`` (column ``file``), clipped to a range of frames."""
    part = lambda k: F.regexp_extract("file", r"(\d+)_(\d+)/(\d+)_(\d+)\.\w+$", k).cast("long")
    found = files.select(part(1).alias("s"), part(2).alias("e"), part(3).alias("r"), part(4).alias("c")).where("s is not null")
    since = F.col("s") if first is None else F.greatest("s", F.lit(first))
    until = F.col("e") if last is None else F.least("e", F.lit(last))
    each = found.groupBy(since.alias("seg_start"), until.alias("seg_end")).agg((F.max("r") + 1).alias("rows"), (F.max("c") + 1).alias("cols"), F.count_distinct("r", "c").alias("tiles"))
    return each.where("seg_start < seg_end")


def file_name_column(day: Column, number: Column, kind: str = "csv") -> Column:
    """Names by which the inputs of a day are stored: the detections of a file, or its video."""
    file = number.cast("string") if kind == "mp4" else F.concat_ws("-", day, number.cast("string"))
    return F.concat(day, F.lit("/"), file, F.lit(f".{kind}"))


def seek_or_skip(wanted: DataFrame, group: str, frame: str, gop: int) -> DataFrame:
    """How a decoder of each group gets to its wanted frames, in order: whether it seeks, and how many frames it then runs through unseen.

    A frame behind the last one between the same seek points is reached by running on; any other by a seek to the point before it.
    """
    last = F.lag(frame).over(Window.partitionBy(group).orderBy(frame))
    seeks = F.coalesce(F.floor(last / gop) != F.floor(F.col(frame) / gop), F.lit(True))
    return wanted.select(group, frame, seeks.alias("seeks"), F.when(seeks, F.col(frame) % gop).otherwise(F.col(frame) - last - 1).alias("skipped"))


def read_tensor(df: DataFrame, column: str, width: int) -> DataFrame:
    """Rows of a tensor held as bytes of 32-bit floats, little-endian, as an array of ``width`` numbers; other lengths raise."""

    def run(batches):
        for pdf in batches:
            made = [np.frombuffer(b, "<f4") for b in pdf[column]]
            if any(len(x) != width for x in made):
                raise ValueError(f"a tensor row of other than {width} numbers")
            pdf[column] = [x.tolist() for x in made]
            yield pdf

    schema = T.StructType([T.StructField(f.name, T.ArrayType(T.FloatType())) if f.name == column else f for f in df.schema])
    return df.mapInPandas(run, schema)


def write_detections(det: DataFrame, path: str, keep: Column) -> None:
    """Detections that fulfil a condition, as CSV with a header; refuses to overwrite."""
    det.where(keep).write.mode("error").csv(path, header=True)


def catalog_document(tiles: DataFrame, video: dict[str, int] | None = None) -> DataFrame:
    """One row: the catalog as nested maps, from rows of tiles with ``rect`` text (null: no region), and what is known of the video."""
    key = lambda a, b: F.concat_ws("_", a, b)
    roi = F.map_from_entries(F.collect_list(F.when(F.col("rect").isNotNull(), F.struct(key("row_no", "col_no").alias("k"), F.col("rect").alias("v")))))
    segs = tiles.groupBy("seg_start", "seg_end").agg((F.max("row_no") + 1).alias("rows"), (F.max("col_no") + 1).alias("cols"), roi.alias("roi"))
    entry = F.struct("rows", "cols", (F.col("seg_end") - F.col("seg_start")).alias("duration"), "roi")
    out = segs.agg(F.map_from_entries(F.collect_list(F.struct(key("seg_start", "seg_end").alias("k"), entry.alias("v")))).alias("layouts"))
    return out.withColumn("video", F.struct(*[F.lit(v).alias(k) for k, v in video.items()])) if video else out


def write_catalog(tiles: DataFrame, path: str, video: dict[str, int] | None = None) -> None:
    """The catalog as JSON; refuses to overwrite."""
    catalog_document(tiles, video).write.mode("error").json(path)


def write_tiles(tiles: DataFrame, path: str) -> None:
    """Tiles with a region only, in one folder for each segment, sorted by frame so that row groups can be skipped."""
    tiles.where("has_roi").repartition("seg_start").sortWithinPartitions("seg_start", "t").write.mode("error").partitionBy("seg_start").parquet(path)


def read_frames(df: DataFrame, first: int, last: int, limit: int | None = None, skip: DataFrame | None = None, frame: str = "t") -> DataFrame:
    """Frames of a half-open range, less those to skip, ``limit`` of them: range and columns reach the scan."""
    out = df.where((F.col(frame) >= first) & (F.col(frame) < last))
    out = out.join(skip.select(frame), frame, "left_anti") if skip is not None else out
    return out.orderBy(frame).limit(limit) if limit is not None else out


def _bucket(segments: DataFrame) -> int:
    """The mean length of segments: cut into buckets of it they are at most twice as many rows and one each."""
    size = segments.select("seg_start", "seg_end").distinct().agg(F.count("*").alias("n"), F.sum(F.col("seg_end") - F.col("seg_start")).alias("frames")).first()
    return max(1, (size["frames"] or 0) // max(1, size["n"]))


def in_segments(frames: DataFrame, segments: DataFrame, frame: str = "t", how: str = "inner", on: list[str] | None = None) -> DataFrame:
    """``frames`` joined to the segments (``seg_start``, ``seg_end``, half-open, of any lengths) that hold them, and equal in ``on``.

    Segments are spread over buckets of frames, so that the range join is an equi-join and a filter.
    """
    size = _bucket(segments)
    spread = segments.withColumn("__bucket", F.explode(F.sequence(F.floor(F.col("seg_start") / size), F.floor((F.col("seg_end") - 1) / size)))).alias("s")
    placed = frames.withColumn("__bucket", F.floor(F.col(frame) / size)).alias("f")
    same = [F.col(f"f.{c}") == F.col(f"s.{c}") for c in ["__bucket", *(on or [])]]
    inside = (F.col(f"f.{frame}") >= F.col("s.seg_start")) & (F.col(f"f.{frame}") < F.col("s.seg_end"))
    keep = [F.col(f"f.{c}") for c in frames.columns] + [F.col(f"s.{c}") for c in segments.columns if c not in frames.columns]
    return placed.join(spread, [*same, inside], how).select(*keep)


def segment_of(frames: DataFrame, frame: str, segments: DataFrame | int) -> DataFrame:
    """``seg_start`` of each frame: by a table of segments of any lengths (null where none holds it), or by arithmetic if all have one length."""
    if isinstance(segments, int):
        return frames.withColumn("seg_start", F.floor(F.col(frame) / segments) * segments)
    return in_segments(frames, segments.select("seg_start", "seg_end").distinct(), frame, "left").drop("seg_end")


def decode_plan(wanted: DataFrame, segments: DataFrame) -> DataFrame:
    """For each segment with wanted frames (``t``): first frame, frames to run through, and those to skip among them."""
    hit = in_segments(wanted.select("t"), segments.select("seg_start", "seg_end").distinct())
    each = hit.groupBy("seg_start").agg(F.min("t").alias("start"), (F.max("t") - F.min("t") + 1).alias("length"), F.sort_array(F.collect_set("t")).alias("ts"))
    return each.select("seg_start", "start", "length", F.array_except(F.sequence("start", F.col("start") + F.col("length") - 1), "ts").alias("skip"))


def file_offsets(files: DataFrame) -> DataFrame:
    """Global number of each file's first frame, files in numeric order of their names (``file``, ``n_frames``)."""
    from scantling.operators.sampling import running

    number = F.regexp_extract("file", r"(\d+)(?:\.\w+)?$", 1).cast("long")
    found = running(files.select("file", "n_frames", number.alias("__number")), [F.asc("__number"), F.asc("file")], {"upto": F.col("n_frames")})
    return found.select("file", "n_frames", (F.col("upto").cast("long") - F.col("n_frames")).alias("offset"))


def stale_files(manifest: DataFrame, present: DataFrame) -> DataFrame:
    """Files to count anew (``new``) and manifest rows to drop (``gone``)."""
    new = present.join(manifest, ["file", "size"], "left_anti").select("file", F.lit("new").alias("what"))
    return new.union(manifest.join(present, ["file", "size"], "left_anti").select("file", F.lit("gone").alias("what")))


def scan_tiles(tiles: DataFrame, first_only: bool = False, info: Column | None = None) -> DataFrame:
    """A row for each frame of each tile with a region; only segments' first frames if asked for; tiles by their information."""
    kept = tiles.where("has_roi") if info is None else tiles.where("has_roi").where(info)
    out = kept.withColumn("t", F.explode(F.sequence(F.col("seg_start"), F.col("seg_end") - 1)))
    return out.where(F.col("t") == F.col("seg_start")) if first_only else out


def select_tiles(tiles: DataFrame, keys: DataFrame) -> DataFrame:
    """Tiles at given frames (``t``) and, where the keys have them, positions. Segments may differ in length."""
    return in_segments(keys, tiles, on=[c for c in ("row_no", "col_no") if c in keys.columns])


def assemble_frames(tiles: DataFrame, payload: str = "payload") -> DataFrame:
    """Tiles of a frame in order of row and column, as one array: what a full frame is put together from."""
    return tiles.groupBy("t").agg(F.transform(F.sort_array(F.collect_list(F.struct("row_no", "col_no", payload))), lambda x: x[payload]).alias("parts"))


def first_failures(frames: DataFrame, bad: Column) -> DataFrame:
    """The first frame that fails of each segment that has one."""
    return frames.groupBy("seg_start").agg(F.min(F.when(bad, F.col("t"))).alias("first_bad")).where(F.col("first_bad").isNotNull())


def with_blank(frames: DataFrame, payload: str, size: Column) -> DataFrame:
    """Missing payloads replaced by zero bytes of their size."""
    return frames.withColumn(payload, F.coalesce(F.col(payload), F.unhex(F.repeat(F.lit("00"), size.cast("int")))))


Hook = Callable[[pd.DataFrame], pd.DataFrame]


def apply_hook(df: DataFrame, hook: Hook, schema: str | T.StructType) -> DataFrame:
    """A decoder, detector or embedder: a function of pandas frames, run on Arrow batches. The engine ships none that need a device."""

    def run(batches):
        for pdf in batches:
            yield hook(pdf)

    return df.mapInPandas(run, schema)


def video_frames(spark: SparkSession, path: str, decode: Callable[[bytes], list[bytes]]) -> DataFrame:
    """``file``, ``t``, ``payload`` of every frame of video files, by a decoder that is given."""
    files = spark.read.format("binaryFile").load(path).select(F.col("path").alias("file"), "content")

    def run(batches):
        for pdf in batches:
            for name, content in zip(pdf["file"], pdf["content"], strict=True):
                frames = decode(content)
                yield pd.DataFrame({"file": [name] * len(frames), "t": range(len(frames)), "payload": frames})

    return files.mapInPandas(run, "file string, t long, payload binary")
