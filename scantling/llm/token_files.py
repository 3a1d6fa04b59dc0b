"""Token counts of the documents in flat token files, by a separator scan.

A flat file is nothing but token identifiers of fixed width, each document ended by the end-of-document identifier; there is no
index. Files are held as blocks of bytes. Each block is searched for separators in one vectorised comparison, on its own and in
any order; a document that crosses blocks is stitched by a prefix scan: over the blocks of a file, in order, run the number of
separators and the tokens since the last one, which gives the number of a block's first document and the tokens of it that earlier
blocks hold. Tokens behind a file's last separator are a document without an end, reported as such.

The scan runs over one row a block, of a few numbers, not over tokens; each file is scanned by itself. A document without tokens
counts 0. An empty file or block gives nothing. Identifiers above 65,534 need a width of 4.

Ids may be of any type. Null ids and ids of several rows: a row for each of these rows. Null text: 0 tokens. No rows: no rows.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window

from scantling.llm.bpe import default_path, open_bpe
from scantling.llm.util import materialize, slices, texts_of

END, WIDTH, BLOCK = 50256, 2, 1 << 20
BLOCKS = T.StructType([
    T.StructField("file", T.StringType()), T.StructField("block", T.LongType()), T.StructField("data", T.BinaryType()),
])


def write_flat(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", path: str | None = None, end: int = END, width: int = WIDTH, block_bytes: int = BLOCK) -> DataFrame:
    """Blocks of flat token files, one file for each task: ``file``, ``block``, ``data``, and ``ids``.

    ``ids`` are the documents that end in a block, in order: the scan doesn't see them; they are there to name its rows after it.
    Null text: no tokens. An end-of-document string within a text is written as ordinary text would be, so that it ends nothing.
    """
    path = path or default_path()
    frame = docs.select(F.col(f"`{id_col}`").alias("id"), F.col(f"`{text_col}`").alias("text"))
    schema = T.StructType([*BLOCKS.fields, T.StructField("ids", T.ArrayType(frame.schema["id"].dataType))])
    kind = np.dtype(f"<u{width}")

    def run(batches):
        from pyspark import TaskContext
        from pyspark.sql.pandas.types import to_arrow_schema

        arrow, name, no = to_arrow_schema(schema), f"part-{TaskContext.get().partitionId():08d}", 0
        buffer, ids = bytearray(), []

        def take(n: int) -> pa.RecordBatch:
            nonlocal no
            data = bytes(buffer[:n])
            del buffer[:n]
            ended = int((np.frombuffer(data, kind) == end).sum())
            own, ids[:] = ids[:ended], ids[ended:]
            no += 1
            return pa.RecordBatch.from_arrays([pa.array([name], arrow.field(0).type), pa.array([no - 1], pa.int64()), pa.array([data], arrow.field(2).type), pa.array([own], arrow.field(3).type)], schema=arrow)

        for batch in batches:
            bpe = open_bpe(path)
            texts, keys = texts_of(batch.column(1)), batch.column(0).to_pylist()
            for a, b in slices([len(t) for t in texts], 4 << 20):
                for key, tokens in zip(keys[a:b], bpe.encode_batch([t.decode("utf-8", "replace") for t in texts[a:b]], ordinary=True), strict=True):
                    tokens.append(end)
                    buffer += np.array(tokens, kind).tobytes()
                    ids.append(key)
                while len(buffer) >= block_bytes:
                    yield take(block_bytes)
        if buffer:
            yield take(len(buffer))

    return frame.mapInArrow(run, schema)


def read_flat(spark: SparkSession, path: str, width: int = WIDTH, block_bytes: int = BLOCK) -> DataFrame:
    """Blocks of the raw flat files of a folder (a URI that pyarrow opens), read by ranges of bytes: ``file``, ``block``, ``data``.

    A file of any size is cut every ``block_bytes``, wherever that falls; a token belongs to the range in which it begins. Files are listed
    by the driver, a row each; each range is read by the task that searches it. Bytes behind a file's last whole token raise.
    """
    from pyarrow import fs

    store, root = fs.FileSystem.from_uri(path)
    found = [f for f in store.get_file_info(fs.FileSelector(root, recursive=True)) if f.is_file]
    for f in found:
        if f.size % width:
            raise ValueError(f"{f.path}: {f.size} bytes are not a whole number of tokens")
    files = spark.createDataFrame([(f.path, f.size) for f in found], "file string, size long").where("size > 0")
    ranges = files.select("file", "size", F.explode(F.sequence(F.lit(0).cast("long"), F.floor((F.col("size") - 1) / block_bytes))).alias("block"))

    def run(batches):
        own, _ = fs.FileSystem.from_uri(path)
        whole = lambda at: -(-at // width) * width
        for batch in batches:
            for row in batch.to_pylist():
                since, until = whole(row["block"] * block_bytes), min(row["size"], whole((row["block"] + 1) * block_bytes))
                with own.open_input_file(row["file"]) as f:
                    data = f.read_at(max(0, until - since), since)
                yield pa.RecordBatch.from_arrays([pa.array([row["file"]]), pa.array([row["block"]], pa.int64()), pa.array([data], pa.binary())], names=["file", "block", "data"])

    return ranges.repartition("file", "block").mapInArrow(run, BLOCKS)


def separators(data: bytes, end: int = END, width: int = WIDTH) -> tuple[int, np.ndarray]:
    """Tokens in a block, and the places of its separators."""
    if len(data) % width:
        raise ValueError(f"a block of {len(data)} bytes: not a whole number of tokens")
    tokens = np.frombuffer(data, np.dtype(f"<u{width}"))
    return len(tokens), np.flatnonzero(tokens == end)


def scan_blocks(blocks: DataFrame, end: int = END, width: int = WIDTH) -> DataFrame:
    """``file``, ``doc_no``, ``n_tokens``, ``start`` (token offset in its file), ``ended`` for every document, and ``block`` in which it ends with its place ``nth`` there."""
    schema = T.StructType([
        T.StructField("file", T.StringType()), T.StructField("block", T.LongType()), T.StructField("n", T.LongType()),
        T.StructField("first", T.LongType()), T.StructField("last", T.LongType()), T.StructField("inner", T.ArrayType(T.LongType())),
        T.StructField("places", T.ArrayType(T.LongType())),
    ])

    def run(batches):
        from pyspark.sql.pandas.types import to_arrow_schema

        arrow = to_arrow_schema(schema)
        for batch in batches:
            for i in range(batch.num_rows):
                n, at = separators(batch.column(2)[i].as_py() or b"", end, width)
                if n:
                    first, last = (int(at[0]), n - 1 - int(at[-1])) if len(at) else (None, n)
                    row = [batch.column(0)[i].as_py(), batch.column(1)[i].as_py(), n, first, last, (np.diff(at) - 1).tolist(), at.tolist()]
                    yield pa.RecordBatch.from_arrays([pa.array([x], f.type) for x, f in zip(row, arrow, strict=True)], schema=arrow)

    found = materialize(blocks.select("file", "block", "data").mapInArrow(run, schema), "separators")
    order = Window.partitionBy("file").orderBy("block")
    before, upto = order.rowsBetween(Window.unboundedPreceding, -1), order.rowsBetween(Window.unboundedPreceding, 0)
    ends = F.when(F.col("first").isNotNull(), F.size("inner") + 1).otherwise(0)
    # the scan runs over a few numbers a block; its separators are joined back to it
    numbers = found.select("file", "block", "n", "first", "last", ends.alias("ends")).withColumn("begin", F.coalesce(F.sum("n").over(before), F.lit(0)))
    # where the open document begins: behind the last separator of the blocks so far
    scanned = numbers.withColumn("open_at", F.when(F.col("ends") > 0, F.col("begin") + F.col("n") - F.col("last")))
    scanned = scanned.select(
        "file", "block", "n", "first", "last", "ends", "begin",
        F.coalesce(F.sum("ends").over(before), F.lit(0)).alias("docs"), F.coalesce(F.max("open_at").over(before), F.lit(0)).alias("since"),
        (F.row_number().over(Window.partitionBy("file").orderBy(F.desc("block"))) == 1).alias("tail"), F.coalesce(F.max("open_at").over(upto), F.lit(0)).alias("rest"),
    )
    placed = scanned.where("ends > 0").join(found.select("file", "block", "inner", "places"), ["file", "block"])
    sizes = F.concat(F.array(F.col("begin") + F.col("first") - F.col("since")), F.col("inner"))
    begins = F.concat(F.array("since"), F.transform("places", lambda p: F.col("begin") + p + 1))
    each = placed.select("file", "block", "docs", F.posexplode(F.arrays_zip(sizes.alias("n_tokens"), begins.alias("start"))).alias("nth", "doc"), "ends")
    whole = each.where(F.col("nth") < F.col("ends")).select("file", (F.col("docs") + F.col("nth")).alias("doc_no"), "doc.n_tokens", "doc.start", F.lit(True).alias("ended"), "block", "nth")
    left = scanned.where("tail").where(F.col("begin") + F.col("n") > F.col("rest"))
    cut = left.select("file", (F.col("docs") + F.col("ends")).alias("doc_no"), (F.col("begin") + F.col("n") - F.col("rest")).alias("n_tokens"), F.col("rest").alias("start"), F.lit(False).alias("ended"), "block", F.lit(None).cast("int").alias("nth"))
    return whole.union(cut)


def count_tokens(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", path: str | None = None, block_bytes: int = BLOCK) -> DataFrame:
    """``id_col``, ``n_tokens``, ``file``, ``doc_no`` and ``start`` for every row: texts are encoded to flat files, which are then scanned.

    Counts come from the scan alone. Rows that repeat an id have a row each.
    """
    blocks = materialize(write_flat(docs, id_col, text_col, path, block_bytes=block_bytes), "tokens")
    names = blocks.select("file", "block", F.posexplode("ids").alias("nth", "id"))
    found = scan_blocks(blocks)
    return found.join(names, ["file", "block", "nth"]).select(F.col("id").alias(id_col), "n_tokens", "file", "doc_no", "start")
