"""Operators within a query's candidates: ranks, z-scores, scales, softmax and choices. `key` names the query's columns."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

KEY = ("qid",)


def own_key(df: DataFrame) -> tuple[str, ...]:
    """A query's key: with its source, where rows have it, so that rows dealt by source stay where they are."""
    return ("src", "qid") if "src" in df.columns else KEY


def _of(key=KEY):
    return Window.partitionBy(*key)


def recip_rank(value: Column, key=KEY, tie: str = "pos") -> Column:
    """1 / rank by descending value; rounded to 9 decimals first, ties by `tie`."""
    return 1.0 / F.row_number().over(_of(key).orderBy(F.round(value, 9).desc(), tie))


def zscore(value: Column, key=KEY, flat: float = 1e-6) -> Column:
    """By the population deviation; where that is under `flat`, divided by 1."""
    std = F.stddev_pop(value).over(_of(key))
    return (value - F.avg(value).over(_of(key))) / F.when(std < flat, F.lit(1.0)).otherwise(std)


def zscore_or_zero(value: Column, key=KEY, flat: float = 1e-6) -> Column:
    std = F.stddev_pop(value).over(_of(key))
    return F.when(std < flat, F.lit(0.0)).otherwise((value - F.avg(value).over(_of(key))) / std)


def minmax(value: Column, key=KEY, flat: float = 1e-6) -> Column:
    low, high = F.min(value).over(_of(key)), F.max(value).over(_of(key))
    return F.when(high - low < flat, F.lit(0.0)).otherwise((value - low) / (high - low))


def softmax(df: DataFrame, value: str, out: str = "prob", temperature: float = 1.0, key=KEY) -> DataFrame:
    """Softmax with the largest value taken off first. Queries whose sum isn't finite get equal shares."""
    scaled = F.col(value) / max(float(temperature), 1e-6)
    rows = df.withColumn("_e", F.exp(scaled - F.max(scaled).over(_of(key))))
    total = F.sum("_e").over(_of(key))
    rows = rows.withColumn(out, F.when((total > 0) & ~F.isnan(total), F.col("_e") / total).otherwise(1.0 / F.count("*").over(_of(key))))
    return rows.drop("_e")


def argmax(df: DataFrame, value: str, key=KEY, tie: str = "pos") -> DataFrame:
    """The candidate of the largest value; the first on ties."""
    first = F.row_number().over(_of(key).orderBy(F.round(value, 9).desc(), tie))
    return df.withColumn("_r", first).filter("_r = 1").drop("_r")


def top_k(df: DataFrame, value: str, k: int, key=KEY, tie: str = "dst") -> DataFrame:
    rank = F.row_number().over(_of(key).orderBy(F.round(value, 9).desc(), tie))
    return df.withColumn("rank", rank).filter(F.col("rank") <= k)
