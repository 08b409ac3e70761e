"""Sinks of probabilities, scores, reports and metrics, and checks of what was written."""

from __future__ import annotations

import json
import os
import zipfile

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def rows_of(long: DataFrame, value: str = "prob") -> DataFrame:
    """qid and the array of a query's values by pos."""
    packed = long.groupBy("qid").agg(F.array_sort(F.collect_list(F.struct("pos", F.col(value).alias("v")))).alias("p"))
    return packed.select("qid", F.transform("p", lambda x: x["v"]).alias("row"))


def repaired(row: Column) -> Column:
    """Values clipped to 0..1 and divided by their sum, uniform if that is 0 or not finite, rounded to 8 decimals, the rest added to
    the first of the largest."""
    finite = F.transform(row, lambda x: F.when(F.isnan(x) | x.isNull(), 0.0).otherwise(F.greatest(F.least(x, F.lit(1.0)), F.lit(0.0))))
    total = F.aggregate(finite, F.lit(0.0), lambda a, x: a + x)
    even = F.transform(finite, lambda x: F.lit(1.0) / F.size(finite))
    scaled = F.when(total > 0, F.transform(finite, lambda x: x / total)).otherwise(even)
    cut = F.transform(scaled, lambda x: F.round(x, 8))
    rest = F.lit(1.0) - F.aggregate(cut, F.lit(0.0), lambda a, x: a + x)
    first = F.array_position(cut, F.array_max(cut))
    return F.transform(cut, lambda x, k: F.when(k + 1 == first, F.round(x + rest, 8)).otherwise(x))


def formatted(row: Column, decimals: int = 8) -> Column:
    return F.array_join(F.transform(row, lambda x: F.format_string(f"%.{decimals}f", x)), ",")


def write_probabilities(long: DataFrame, path: str, repair: bool = True, one_file: bool = True) -> None:
    """A line of 8-decimal values for each query, without header, in qid order."""
    rows = rows_of(long).orderBy("qid")
    lines = rows.select(formatted(repaired(F.col("row")) if repair else F.col("row")).alias("value"))
    (lines.coalesce(1) if one_file else lines).write.mode("overwrite").text(path)


def write_scores(long: DataFrame, path: str, value: str = "score") -> None:
    """Raw scores, unrepaired."""
    rows_of(long, value).orderBy("qid").select(F.array_join(F.transform("row", lambda x: x.cast("string")), ",").alias("value")).coalesce(1).write.mode("overwrite").text(path)


def write_zeros(queries: DataFrame, path: str, width: int = 100) -> None:
    """The all-zero probe: as many lines as queries."""
    queries.select(formatted(F.array_repeat(F.lit(0.0), width)).alias("value")).coalesce(1).write.mode("overwrite").text(path)


def line_report(lines: DataFrame, width: int = 100, tolerance: float = 1e-5) -> DataFrame:
    """One row: rows, bad rows (width, sign, sum), the first bad row as text, least and largest sum and value."""
    row = F.transform(F.split("value", ","), lambda x: x.try_cast("double"))
    parsed = lines.select("value", F.monotonically_increasing_id().alias("at"), row.alias("row"))
    total = F.aggregate("row", F.lit(0.0), lambda a, x: a + x)
    ok = (F.size("row") == width) & ~F.exists("row", lambda x: x.isNull() | F.isnan(x) | (x < 0)) & (F.abs(total - 1) <= tolerance)
    checked = parsed.select("at", F.substring("value", 1, 200).alias("value"), F.coalesce(ok, F.lit(False)).alias("ok"), total.alias("total"), F.array_min("row").alias("low"), F.array_max("row").alias("high"))
    return checked.agg(F.count("*").alias("rows"), F.count_if(~F.col("ok")).alias("bad"), F.min_by(F.when(~F.col("ok"), F.col("value")), F.when(~F.col("ok"), F.col("at"))).alias("first_bad"), F.min("total").alias("sum_min"), F.max("total").alias("sum_max"), F.min("low").alias("value_min"), F.max("high").alias("value_max"))


def validate(spark: SparkSession, path: str, expected_rows: int, width: int = 100, tolerance: float = 1e-5) -> dict:
    out = line_report(spark.read.text(path), width, tolerance).head().asDict()
    return out | {"valid": out["rows"] == expected_rows and out["bad"] == 0}


def write_json(report: dict, path: str) -> None:
    os.makedirs(os.path.dirname(path) or ".", exist_ok=True)
    with open(path, "w", encoding="utf-8") as f:
        json.dump(report, f, indent=2, ensure_ascii=False, sort_keys=True)


def write_metrics(metrics: DataFrame, path: str) -> None:
    """eval_set, mode, bucket, mrr, events as CSV with header."""
    metrics.coalesce(1).write.mode("overwrite").csv(path, header=True)


def zip_members(members: dict[str, str], path: str) -> None:
    """Text folders that Spark wrote, each as one member."""
    with zipfile.ZipFile(path, "w", zipfile.ZIP_DEFLATED) as out:
        for name, folder in members.items():
            parts = sorted(x for x in os.listdir(folder) if x.startswith("part-"))
            with out.open(name, "w") as member:
                for part in parts:
                    with open(os.path.join(folder, part), "rb") as f:
                        member.write(f.read())


def read_zip(spark: SparkSession, path: str, member: str) -> DataFrame:
    """Rows of scores of a member: qid, row."""
    def lines(batches):
        import io

        import pyarrow as pa

        for batch in batches:
            for content in batch.column(0).to_pylist():
                with zipfile.ZipFile(io.BytesIO(content)) as z:
                    found = z.read(member).decode().splitlines()
                for at in range(0, len(found), 10_000):
                    some = found[at : at + 10_000]
                    yield pa.record_batch([pa.array(range(at, at + len(some)), pa.int64()), pa.array(some, pa.string())], ["qid", "value"])

    rows = spark.read.format("binaryFile").load(path).select("content").mapInArrow(lines, "qid long, value string")
    return rows.select(F.col("qid").cast("long"), F.transform(F.split("value", ","), lambda x: x.cast("double")).alias("row"))
