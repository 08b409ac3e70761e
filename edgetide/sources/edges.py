"""Edge and query tables: readers with checked schemas, and the edge views of the supplied Parquet tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

EDGE = T.StructType([T.StructField(c, T.LongType()) for c in ("src", "dst", "time")])


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def epoch(column, unit: str):
    """Whole units since 1970 of a timestamp without time zone, whatever the session's zone."""
    return F.expr(f"timestampdiff({unit}, TIMESTAMP_NTZ'1970-01-01 00:00:00', {column})")


def edges_new(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Customers and parts: pairs hardly repeat."""
    return _orders(spark, sf_dir, "l_partkey")


def edges_mid(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Customers and suppliers: a fifth of the pairs repeat."""
    return _orders(spark, sf_dir, "l_suppkey")


def edges_cold(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Customers and suppliers by year: with each year all destinations are new."""
    items = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_suppkey")
    orders = table(spark, sf_dir, "orders").select("o_orderkey", "o_custkey", "o_orderdate")
    rows = items.join(orders, F.col("l_orderkey") == F.col("o_orderkey"))
    dst = F.col("l_suppkey").cast("long") * 10_000 + F.year("o_orderdate")
    return rows.select(F.col("o_custkey").cast("long").alias("src"), dst.alias("dst"), epoch("o_orderdate", "SECOND").alias("time"))


def _orders(spark: SparkSession, sf_dir: str, dst: str) -> DataFrame:
    items = table(spark, sf_dir, "lineitem").select("l_orderkey", dst)
    orders = table(spark, sf_dir, "orders").select("o_orderkey", "o_custkey", "o_orderdate")
    rows = items.join(orders, F.col("l_orderkey") == F.col("o_orderkey"))
    return rows.select(F.col("o_custkey").cast("long").alias("src"), F.col(dst).cast("long").alias("dst"), epoch("o_orderdate", "SECOND").alias("time"))


def edges_rep(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Users and the numbers in their events' properties: a quarter of the pairs repeat."""
    rows = table(spark, sf_dir, "events").select("user_id", "ts", "props")
    return rows.select(F.col("user_id").cast("long").alias("src"), F.get_json_object("props", "$.k").cast("long").alias("dst"), epoch("ts", "MICROSECOND").alias("time"))


EVENT_TYPES = ["click", "error", "purchase", "signup", "view"]


def edges_type(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Users and the kinds of their events: five destinations."""
    rows = table(spark, sf_dir, "events").select("user_id", "ts", "event_type")
    code = F.array_position(F.array(*map(F.lit, EVENT_TYPES)), F.col("event_type"))
    return rows.select(F.col("user_id").cast("long").alias("src"), code.cast("long").alias("dst"), epoch("ts", "MICROSECOND").alias("time"))


def _header(spark: SparkSession, path: str) -> list[str]:
    first = spark.read.text(path).head()
    if first is None:
        raise ValueError(f"{path} has no header")
    return [x.strip() for x in first[0].split(",")]


def read_edges(spark: SparkSession, path: str) -> DataFrame:
    """CSV with src, dst, time and perhaps split in any order: src, dst, time, split ('' where there is none)."""
    header = _header(spark, path)
    if missing := {"src", "dst", "time"} - {*header}:
        raise ValueError(f"{path} has no column {', '.join(sorted(missing))}")
    schema = T.StructType([T.StructField(c, T.LongType() if c in ("src", "dst", "time") else T.StringType()) for c in header])
    rows = spark.read.schema(schema).option("mode", "FAILFAST").csv(path, header=True)
    split = F.coalesce(F.col("split"), F.lit("")) if "split" in header else F.lit("")
    return rows.select("src", "dst", "time", split.alias("split"))


def read_queries(spark: SparkSession, path: str, n_candidates: int = 100) -> DataFrame:
    """CSV of src, time, c1..cN: qid (order of the file), src, time, candidates. Header and every row must have N + 2 columns."""
    header = _header(spark, path)
    if len(header) != n_candidates + 2 or header[:2] != ["src", "time"]:
        raise ValueError(f"{path} must have src, time and {n_candidates} candidates, not {len(header)} columns")
    schema = T.StructType([T.StructField(c, T.LongType()) for c in header])
    rows = spark.read.schema(schema).option("mode", "FAILFAST").option("enforceSchema", False).csv(path, header=True)
    checked = rows.withColumn("qid", F.monotonically_increasing_id())
    return checked.select("qid", "src", "time", F.array(*header[2:]).alias("candidates"))


def dataset_dirs(spark: SparkSession, root: str, needed: tuple[str, ...] = ("train.csv", "test.csv")) -> dict[str, str]:
    """Folders under root that hold the needed files, by name; through Hadoop's file system, so in any store."""
    jvm, conf = spark.sparkContext._jvm, spark.sparkContext._jsc.hadoopConfiguration()
    path = jvm.org.apache.hadoop.fs.Path
    top = path(root)
    fs = top.getFileSystem(conf)
    if not fs.exists(top):
        raise FileNotFoundError(root)
    found = {s.getPath().getName(): s.getPath().toString() for s in fs.listStatus(top) if s.isDirectory()}
    out = {name: at for name, at in sorted(found.items()) if all(fs.exists(path(at, x)) for x in needed)}
    if not out:
        raise FileNotFoundError(f"no data sets under {root}")
    return out


def exploded(queries: DataFrame) -> DataFrame:
    """One row for each query and candidate: qid, src, time, pos, dst."""
    return queries.select("qid", "src", "time", F.posexplode("candidates").alias("pos", "dst"))


def candidate_vocabulary(queries: DataFrame) -> DataFrame:
    return queries.select(F.explode("candidates").alias("dst")).distinct()
