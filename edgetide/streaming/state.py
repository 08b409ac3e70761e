"""Streams of edges: incremental state, block-wise scoring, chunked prediction.

State of a key is kept by max, not by overwriting, so the order within a batch doesn't matter; duplicates within the watermark are dropped."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout


def dst_counts(edges: DataFrame) -> DataFrame:
    """dst, n, last: running state of each destination, for update or complete mode."""
    return edges.groupBy("dst").agg(F.count("*").alias("n"), F.max("time").alias("last"))


def last_k_state(edges: DataFrame, k: int) -> DataFrame:
    """src, n, hist after each batch that has edges of the source: its last k destinations by (time, dst). The state holds k edges a source."""

    def step(key: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        n, times, dsts = state.get if state.exists else (0, [], [])
        ring = list(zip(times, dsts))
        for f in frames:
            n += len(f)
            ring += list(zip(f["time"].tolist(), f["dst"].tolist()))
            ring = sorted(ring)[-k:]
        state.update((n, [t for t, _ in ring], [d for _, d in ring]))
        yield pd.DataFrame({"src": [key[0]], "n": [n], "hist": [",".join(str(d) for _, d in ring)]})

    return edges.groupBy("src").applyInPandasWithState(step, "src long, n long, hist string", "n long, times array<long>, dsts array<long>", "update", GroupStateTimeout.NoTimeout)


def block_loop(folder: str, score: Callable[[DataFrame, DataFrame], DataFrame]) -> Callable[[DataFrame, int], None]:
    """A foreachBatch function: score a batch against the counts of all earlier ones, then add it. Under the folder each batch has its scores
    and the counts up to and with it, keyed by its number, so a batch reads one table of counts however many came before, and one that
    runs twice overwrites itself."""

    def step(batch: DataFrame, number: int) -> None:
        spark = batch.sparkSession
        rows = batch.persist()
        before = spark.read.parquet(f"{folder}/counts/{number - 1}") if number else spark.createDataFrame([], "dst long, n long")
        score(rows, before).write.mode("overwrite").parquet(f"{folder}/scores/{number}")
        after = before.unionByName(rows.groupBy("dst").agg(F.count("*").alias("n"))).groupBy("dst").agg(F.sum("n").alias("n"))
        after.write.mode("overwrite").parquet(f"{folder}/counts/{number}")
        rows.unpersist()

    return step


def popularity_before(batch: DataFrame, before: DataFrame) -> DataFrame:
    """The batch with log1p of each destination's count in earlier batches."""
    return batch.join(before, "dst", "left").select("src", "dst", "time", F.log1p(F.coalesce("n", F.lit(0)).cast("double")).alias("score"))


def predictions(queries: DataFrame, dst_table: DataFrame) -> DataFrame:
    """A stream of queries (qid, src, time, candidates) against a static table (dst, score): qid, pos, dst, score."""
    rows = queries.select("qid", "src", "time", F.posexplode("candidates").alias("pos", "dst"))
    return rows.join(dst_table, "dst", "left").select("qid", "pos", "dst", F.coalesce("score", F.lit(0.0)).alias("score"))


def file_stream(spark: SparkSession, path: str, schema: str, files_per_batch: int = 1) -> DataFrame:
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_batch).parquet(path)
