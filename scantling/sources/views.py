"""Named inputs over the test tables: each a projection of one table, in Spark and as SQL text."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()
#: Name: source table and columns. {U:key} is a uniform whole number below 2**32 from the MD5 of a key.
VIEWS: dict[str, tuple[str, dict[str, str]]] = {
    "det": ("lineitem", {
        "frame": "l_orderkey", "object_name": "l_returnflag", "confidence": "CAST((l_partkey*31+l_suppkey*17)%100 AS DOUBLE)/100",
        "xmin": "CAST(l_partkey%1500 AS DOUBLE)", "ymin": "CAST((l_suppkey*7)%900 AS DOUBLE)",
        "xmax": "CAST(l_partkey%1500 AS DOUBLE)+20+4*l_quantity", "ymax": "CAST((l_suppkey*7)%900 AS DOUBLE)+20*l_linenumber",
        "line": "CAST(l_linenumber AS INT)"}),
    "track": ("lineitem", {
        "frame": "l_orderkey", "object_name": "l_returnflag", "confidence": "CAST((l_partkey*31+l_suppkey*17)%100 AS DOUBLE)/100",
        "xmin": "CAST((l_suppkey%20)*160 AS DOUBLE)", "ymin": "CAST((l_suppkey%5)*150 AS DOUBLE)",
        "xmax": "CAST((l_suppkey%20)*160+100+l_linenumber AS DOUBLE)", "ymax": "CAST((l_suppkey%5)*150+100 AS DOUBLE)",
        "line": "CAST(l_linenumber AS INT)"}),
    "tile": ("embeddings", {
        "tile_id": "vec_id", "t": "CAST(floor(vec_id/4) AS BIGINT)", "row_no": "CAST(floor((vec_id%4)/2) AS INT)",
        "col_no": "CAST(vec_id%2 AS INT)", "truth": "CAST(label AS DOUBLE)", "embedding": "embedding"}),
    "proxy": ("events", {
        "id": "event_id", "label": "CAST(value>100 AS INT)",
        "proxy_score": "round(CAST(0.7 AS DOUBLE)*least(value/200,CAST(1 AS DOUBLE))+CAST(0.3 AS DOUBLE)*({U:event_id}/CAST(4294967296 AS DOUBLE)),9)"}),
    "roi": ("events", {
        "t": "CAST(floor(event_id/3) AS BIGINT)", "seg": "CAST(floor(event_id/90) AS BIGINT)", "roi_id": "event_id",
        "x1": "CAST((user_id*37)%1500 AS DOUBLE)", "y1": "CAST(CAST(floor(value*10) AS BIGINT)%800 AS DOUBLE)",
        "x2": "CAST((user_id*37)%1500+10+(event_id*13)%190 AS DOUBLE)",
        "y2": "CAST(CAST(floor(value*10) AS BIGINT)%800+10+(event_id*29)%140 AS DOUBLE)"}),
    "workload": ("orders", {"workload_id": "CAST(o_custkey%5 AS INT)", "ord": "o_orderkey", "t": "o_orderkey%2500"}),
    "calib": ("lineitem", {
        "h": "130+64*l_linenumber", "w": "130+64*(l_partkey%28)",
        "ms": "round(CAST(7.8 AS DOUBLE)+CAST(2.5e-6 AS DOUBLE)*(130+64*l_linenumber)*(130+64*(l_partkey%28))+{U:l_orderkey}/CAST(4294967296 AS DOUBLE),9)"}),
    # a segment of 30 frames with a grid of 2 x 3 cells; some cells hold regions of interest
    "grid": ("orders", {
        "seg_start": "(o_orderkey%200)*30", "seg_end": "(o_orderkey%200)*30+30", "row_no": "CAST(floor((o_orderkey/200)%2) AS INT)",
        "col_no": "CAST(o_custkey%3 AS INT)", "has_roi": "o_orderstatus<>'F'", "cluster": "o_custkey%7"}),
}


def _fill(text: str, spark: bool) -> str:
    import re

    one = lambda m: f"CAST(conv(substr(md5(concat('7:',{m[1]})),1,8),16,10) AS BIGINT)" if spark else f"CAST('0x'||substr(md5(concat('7:',{m[1]})),1,8) AS BIGINT)"
    return re.sub(r"\{U:(\w+)\}", one, text)


def read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A table by its name, or a view over one."""
    if name in TABLES:
        return spark.read.parquet(f"{sf_dir}/{name}.parquet")
    source, columns = VIEWS[name]
    return read(spark, sf_dir, source).selectExpr(*[f"{_fill(e, True)} AS {c}" for c, e in columns.items()])


def sql(name: str) -> str:
    """The view as a subquery for DuckDB."""
    source, columns = VIEWS[name]
    return f"(SELECT {', '.join(f'{_fill(e, False)} AS {c}' for c, e in columns.items())} FROM {source})"


def with_views(*names: str) -> str:
    """The beginning of a WITH clause that defines these views under the names v_<name>."""
    return "WITH " + ", ".join(f"v_{n} AS {sql(n)}" for n in names)
