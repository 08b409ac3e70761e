"""State and models kept between runs: tables as Parquet, everything else as one JSON text beside them, in any store that Spark reaches."""

from __future__ import annotations

import json
import tempfile
import uuid
from collections.abc import Callable

import numpy as np
from pyspark.sql import DataFrame, SparkSession


def folder(spark: SparkSession, name: str) -> str:
    """A new path in the shared folder of spark.checkpoint.dir, or in a temporary one of this machine on a local master."""
    top = spark.conf.get("spark.checkpoint.dir", None)
    if not top:
        if not spark.sparkContext.master.startswith("local["):
            raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
        top = spark.sparkContext.getCheckpointDir()
        if not top:
            spark.sparkContext.setCheckpointDir(tempfile.mkdtemp(prefix="edgetide-"))
            top = spark.sparkContext.getCheckpointDir()
    return f"{top.rstrip('/')}/{name}-{uuid.uuid4().hex}"


def exists(spark: SparkSession, path: str) -> bool:
    at = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(at)


def save_state(spark: SparkSession, path: str, tables: dict[str, DataFrame], about: dict) -> None:
    """Tables first, then the text that names them: a state without it isn't whole."""
    for name, df in tables.items():
        df.write.mode("overwrite").parquet(f"{path}/{name}")
    text = json.dumps({"tables": sorted(tables), "about": about}, sort_keys=True)
    spark.createDataFrame([(text,)], "value string").coalesce(1).write.mode("overwrite").text(f"{path}/about")


def load_state(spark: SparkSession, path: str) -> tuple[dict[str, DataFrame], dict]:
    if not exists(spark, f"{path}/about/_SUCCESS"):
        raise FileNotFoundError(f"no whole state under {path}")
    held = json.loads("\n".join(r.value for r in spark.read.text(f"{path}/about").collect()))
    return {name: spark.read.parquet(f"{path}/{name}") for name in held["tables"]}, held["about"]


def save_weights(spark: SparkSession, path: str, weights: dict[str, np.ndarray], about: dict) -> None:
    """Arrays of a model, each a row: name, shape, values."""
    rows = [(name, list(x.shape), np.asarray(x, float).ravel().tolist()) for name, x in weights.items()]
    save_state(spark, path, {"weights": spark.createDataFrame(rows, "name string, shape array<int>, cells array<double>")}, about)


def load_weights(spark: SparkSession, path: str) -> tuple[dict[str, np.ndarray], dict]:
    tables, about = load_state(spark, path)
    return {r.name: np.array(r.cells).reshape(r.shape) for r in tables["weights"].collect()}, about


def read_shards(spark: SparkSession, path: str, order: str = "qid") -> DataFrame:
    """Parts that several runs wrote under one folder, as one table in the order of a column (never of the files)."""
    return spark.read.option("recursiveFileLookup", True).parquet(path).orderBy(order)


def cached(spark: SparkSession, path: str, make: Callable[[], DataFrame], rebuild: bool = False) -> DataFrame:
    """The table under a path; made and written there first if there is none that is whole, or if it is to be rebuilt."""
    if rebuild or not exists(spark, f"{path}/_SUCCESS"):
        make().write.mode("overwrite").parquet(path)
    return spark.read.parquet(path)
