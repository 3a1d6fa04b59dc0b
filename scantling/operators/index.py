"""The semantic index: representatives of tile embeddings, nearest representatives, propagated scores."""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window

from scantling.operators.detections import hash_order

#: The greatest matrix of representatives that is sent to every task at a time.
BLOCK_BYTES = 64 << 20
#: How many of the farthest tiles the driver looks at between two passes over all.
CANDIDATES = 2048


def _matrix(batch: pa.RecordBatch, at: int) -> np.ndarray:
    column = batch.column(at)
    flat = column.flatten().to_numpy(zero_copy_only=False).astype(np.float64)
    return flat.reshape(batch.num_rows, -1)


def _nearest_in(tiles: DataFrame, reps: DataFrame, k: int, id_col: str, vector: str) -> DataFrame:
    """``id_col``, ``rep_id`` and ``dist`` of the ``k`` nearest of a block of representatives that fits into memory."""
    rows = sorted(reps.select(id_col, vector).collect())
    shared = tiles.sparkSession.sparkContext.broadcast((np.array([r[0] for r in rows], np.int64), np.array([r[1] for r in rows], np.float64)))
    schema = T.StructType([tiles.schema[id_col], T.StructField("rep_id", T.LongType()), T.StructField("dist", T.DoubleType()), T.StructField("rank", T.IntegerType())])

    def run(batches):
        ids, reps_ = shared.value
        for batch in batches:
            for a in range(0, batch.num_rows, 512):
                part = batch.slice(a, 512)
                x = _matrix(part, 1)
                # differences, not products of norms: near ties keep their order
                d = np.sqrt(((x[:, None, :] - reps_[None, :, :]) ** 2).sum(2)) if len(ids) * x.shape[1] * 512 <= 1 << 24 else np.stack([np.sqrt(((reps_ - v) ** 2).sum(1)) for v in x])
                best = np.argsort(d, axis=1, kind="stable")[:, :k]
                n, m = best.shape
                yield pa.RecordBatch.from_arrays(
                    [part.column(0).take(pa.array(np.repeat(np.arange(n), m))), pa.array(ids[best].ravel(), pa.int64()), pa.array(np.take_along_axis(d, best, 1).ravel(), pa.float64()), pa.array(np.tile(np.arange(1, m + 1), n), pa.int32())],
                    names=[id_col, "rep_id", "dist", "rank"],
                )

    return tiles.select(id_col, vector).mapInArrow(run, schema)


def nearest(tiles: DataFrame, reps: DataFrame, k: int, id_col: str = "tile_id", vector: str = "embedding", block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """``id_col``, ``rank`` (1 is nearest), ``rep_id``, ``dist`` of the ``k`` nearest representatives of every tile; ties by lesser id.

    Representatives go to every task as a matrix of at most ``block_bytes``, and distances are matrix products in blocks. Where there are
    more, block follows block: each is compared with all tiles, merged with the best so far and written, so that neither the
    driver nor a task ever holds a second one.
    """
    size = reps.agg(F.count("*").alias("n"), F.max(F.size(vector)).alias("width")).first()
    blocks = -(-size["n"] * 8 * max(1, size["width"] or 1) // block_bytes)
    order = [id_col, "rank", "rep_id", "dist"]
    if blocks <= 1:
        return _nearest_in(tiles, reps, k, id_col, vector).select(*order)
    from scantling.sources.shared import drop_materialized, materialize

    w = Window.partitionBy(id_col).orderBy("dist", "rep_id")
    best = None
    for b in range(blocks):
        own = _nearest_in(tiles, reps.where(F.pmod(F.xxhash64(id_col), F.lit(blocks)) == b), k, id_col, vector)
        every = own if best is None else own.unionByName(best)
        now = materialize(every.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k), "nearest")
        if best is not None:
            drop_materialized(best)
        best = now
    return best.select(*order)


def propagate(topk: DataFrame, scores: DataFrame, id_col: str = "tile_id") -> DataFrame:
    """``id_col`` and ``score``: mean of the representatives' scores weighed by how near they are, (S - d) / sum(S - d).

    All distances 0: the plain mean. One representative: its score.
    """
    joined = topk.join(scores.select(F.col(id_col).alias("rep_id"), F.col("score").alias("rep_score")), "rep_id")
    sums = joined.groupBy(id_col).agg(F.sum("dist").alias("s"), F.count("*").alias("k"), F.sum("rep_score").alias("y"), F.sum(F.col("rep_score") * F.col("dist")).alias("yd"))
    weighed = (F.col("s") * F.col("y") - F.col("yd")) / ((F.col("k") - 1) * F.col("s"))
    return sums.select(id_col, F.when((F.col("s") == 0) | (F.col("k") == 1), F.col("y") / F.col("k")).otherwise(weighed).alias("score"))


def farthest_first(tiles: DataFrame, buckets: int, random_share: float = 0.25, seed: int = 7, id_col: str = "tile_id", vector: str = "embedding", candidates: int = CANDIDATES) -> DataFrame:
    """``place`` and ``rep_id`` of ``buckets`` representatives: some by hash, then the tile farthest from all chosen, ties by lesser id.

    A table holds each tile's least distance to those chosen. A pass over it takes in the newest of them only, and brings the
    ``candidates`` farthest tiles to the driver, which goes on choosing among them for as long as the farthest is farther than any tile left
    behind could be, as distances only shrink. So most passes choose many, and the choice is that of one at a time.
    """
    from scantling.sources.shared import drop_materialized, materialize

    spark = tiles.sparkSession
    schema = "place int, rep_id long"
    buckets = min(buckets, tiles.count())
    first = max(1, int(random_share * buckets)) if buckets else 0
    started = tiles.select(id_col, vector, hash_order(F.col(id_col), seed).alias("h")).orderBy("h", id_col).limit(first).collect()
    reps, fresh = [r[0] for r in started], [r[1] for r in started]
    table = tiles.select(F.col(id_col).cast("long").alias("id"), F.col(vector).alias("v"), F.lit(float("inf")).alias("least"))
    written = None
    while len(reps) < buckets:
        shared = spark.sparkContext.broadcast(np.array(fresh, np.float64))

        def closer(batches, shared=shared):
            for batch in batches:
                x, least = _matrix(batch, 1), batch.column(2).to_numpy()
                for c in shared.value:
                    least = np.minimum(least, np.sqrt(((x - c) ** 2).sum(1)))
                yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(least)], names=["id", "v", "least"])

        table = materialize(table.mapInArrow(closer, table.schema), "farthest")
        if written is not None:
            drop_materialized(written)
        written = table
        rows = table.orderBy(F.desc("least"), "id").limit(candidates).collect()
        ids, x, least = np.array([r["id"] for r in rows]), np.array([r["v"] for r in rows], np.float64), np.array([r["least"] for r in rows])
        # no tile that stayed behind is farther than this
        rest = least[-1] if len(rows) == candidates else -1.0
        fresh = []
        while len(reps) < buckets:
            far = int(np.lexsort((ids, -least))[0])
            if fresh and least[far] <= rest:
                break
            reps.append(int(ids[far]))
            fresh.append(x[far])
            least = np.minimum(least, np.sqrt(((x - x[far]) ** 2).sum(1)))
    if written is not None:
        drop_materialized(written)
    return spark.createDataFrame(list(enumerate(reps)), schema)


@dataclass(frozen=True)
class IndexConfig:
    """How an index is built: representatives, nearest ones kept for each tile, tiles to train an embedder on, seed, random share."""

    buckets: int = 7000
    k: int = 5
    training: int = 3000
    seed: int = 1
    random_share: float = 0.25


def build_index(tiles: DataFrame, config: IndexConfig = IndexConfig(), id_col: str = "tile_id") -> dict[str, DataFrame]:
    """Tables of an index: ``reps`` (place, rep_id) and ``topk`` (tile, rank, rep_id, dist)."""
    reps = farthest_first(tiles, config.buckets, config.random_share, config.seed, id_col)
    own = tiles.join(reps.select(F.col("rep_id").alias(id_col)), id_col, "left_semi")
    return {"reps": reps, "topk": nearest(tiles, own, config.k, id_col)}


def write_index(tables: dict[str, DataFrame], path: str) -> None:
    """Each table of an index in a folder of its own; refuses to overwrite."""
    for name, df in tables.items():
        df.write.mode("error").parquet(f"{path}/{name}")


def read_index(spark: SparkSession, path: str, names: tuple[str, ...] = ("reps", "topk")) -> dict[str, DataFrame]:
    """The tables of a written index: a query starts from them, not from the embeddings."""
    return {name: spark.read.parquet(f"{path}/{name}") for name in names}


def crack(tiles: DataFrame, labelled: DataFrame, k: int, id_col: str = "tile_id") -> DataFrame:
    """Nearest representatives where every labelled tile is one."""
    return nearest(tiles, tiles.join(labelled.select(id_col).distinct(), id_col, "left_semi"), k, id_col)


def label_misses(reps: DataFrame, cache: DataFrame, id_col: str = "tile_id") -> DataFrame:
    """Representatives that the cache of labels lacks: what a labelling function has to be called for."""
    return reps.join(cache.select(id_col).distinct(), id_col, "left_anti")


def best_in_frame(tiles: DataFrame, frame: str, score: Column, id_col: str = "tile_id", above: float = -1.0) -> DataFrame:
    """The tile of the highest score in each frame, ties by lesser id; none where no score is above the bound."""
    top = F.max_by(F.struct(F.col(id_col), score.alias("score")), F.struct(score, -F.col(id_col)))
    return tiles.where(score > above).groupBy(frame).agg(top.alias("top")).select(frame, f"top.{id_col}", "top.score")


def triplet_loss(anchor: Column, positive: Column, negative: Column, margin: float) -> Column:
    d = lambda a, b: F.aggregate(F.zip_with(a, b, lambda x, y: F.pow(x.cast("double") - y.cast("double"), F.lit(2.0))), F.lit(0.0), lambda s, v: s + v)
    return F.greatest(d(anchor, positive) - d(anchor, negative) + margin, F.lit(0.0))


def triplets(tiles: DataFrame, bucket: str, frame: str, apart: int = 30, seed: int = 7, id_col: str = "tile_id", ranges: int = 256) -> DataFrame:
    """For each tile (anchor): a tile of its bucket more than ``apart`` frames away, and one of a random other bucket, each drawn evenly by hash.

    The tiles of a bucket are numbered by frame, so those too near to an anchor are one run of numbers and the draw is among all
    others: null only where there is none. Numbers come from counts of ranges of frames, so no bucket is gathered or sorted whole.
    """
    slim = tiles.select(F.col(id_col).alias("id"), F.col(bucket).alias("b"), F.col(frame).alias("f")).where("b is not null")
    span = slim.agg(F.min("f").alias("since"), F.max("f").alias("until"))
    # how many tiles each bucket has up to a frame: at the frames of its tiles and at the ends of what is too near to them
    ends = slim.select("b", F.explode(F.array(F.col("f") - apart - 1, F.col("f") + apart)).alias("f")).distinct()
    at = slim.select("b", "f", F.lit(1).alias("n")).union(ends.select("b", "f", F.lit(0).alias("n"))).groupBy("b", "f").agg(F.sum("n").alias("n"))
    at = at.join(F.broadcast(span)).withColumn("part", F.floor((F.col("f") - F.col("since")) * ranges / (F.col("until") - F.col("since") + 1)))
    before = F.coalesce(F.sum("n").over(Window.partitionBy("b").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    starts = at.groupBy("b", "part").agg(F.sum("n").alias("n")).select("b", "part", before.alias("start"))
    upto = F.col("start") + F.sum("n").over(Window.partitionBy("b", "part").orderBy("f").rowsBetween(Window.unboundedPreceding, 0))
    at = at.join(starts, ["b", "part"]).select("b", "f", "n", upto.alias("upto"))
    order = Window.partitionBy("b", "f").orderBy(hash_order(F.col("id"), seed), "id")
    numbered = slim.withColumn("rn", F.row_number().over(order)).join(at, ["b", "f"]).select("b", "id", (F.col("upto") - F.col("n") + F.col("rn") - 1).alias("place"))

    edge = lambda shift, name: at.select("b", (F.col("f") - shift).alias("f"), F.col("upto").alias(name))
    # buckets are classes of labels: a bounded table
    sizes = slim.groupBy("b").agg(F.count("*").alias("size"))
    every = sizes.agg(F.sort_array(F.collect_list(F.struct("b", "size"))).alias("every"))
    near = slim.join(edge(-apart - 1, "low"), ["b", "f"]).join(edge(apart, "high"), ["b", "f"]).join(F.broadcast(sizes), "b").join(F.broadcast(every))
    draw = lambda salt, n: F.pmod(hash_order(F.concat(F.lit(salt), F.col("id").cast("string")), seed), n)
    free = F.col("low") + F.col("size") - F.col("high")
    drawn = near.withColumn("others", F.filter("every", lambda x: x["b"] != F.col("b"))).withColumn("k", F.when(free > 0, draw("same/", free)))
    drawn = drawn.withColumn("place", F.when(F.col("k") < F.col("low"), F.col("k")).otherwise(F.col("k") - F.col("low") + F.col("high")))
    drawn = drawn.withColumn("other", F.when(F.size("others") > 0, F.get("others", draw("bucket/", F.size("others")).cast("int"))))
    drawn = drawn.select("id", "b", "place", F.col("other.b").alias("other"), draw("other/", F.col("other.size")).alias("other_place"))
    same = numbered.select("b", "place", F.col("id").alias("positive"))
    far = numbered.select(F.col("b").alias("other"), F.col("place").alias("other_place"), F.col("id").alias("negative"))
    return drawn.join(same, ["b", "place"], "left").join(far, ["other", "other_place"], "left").select(F.col("id").alias("anchor"), "positive", "negative")
