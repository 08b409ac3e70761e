"""What the operators share: sessions, written tables, words and hashes.

Ids (doc_id, page_id) are whole numbers: operators cast them to long, and a value that can't be cast stops the job with Spark's own error
rather than being lost."""

from __future__ import annotations

import atexit
import ctypes
import os
import tempfile
import uuid
import zipfile
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

_SHIPPED: set[str] = set()
_WRITTEN: list[tuple[SparkSession, str]] = []

# Bytes of the words of the contamination and near-duplicate operators: digits, a-z and all above 0x7F stay, A-Z become a-z.
_WORD_BYTES = bytes(
    b if 0x30 <= b <= 0x39 or 0x61 <= b <= 0x7A or b >= 0x80 else b + 32 if 0x41 <= b <= 0x5A else 0x20 for b in range(256)
)


#: Arrow batches are bounded by bytes, so that a kernel holds little whatever the rows are; a longer row is a batch of its own. The same
#: for all operators: plans read the settings when they run, maybe after another operator was called.
BATCH = {"spark.sql.execution.arrow.maxRecordsPerBatch": "500", "spark.sql.execution.arrow.maxBytesPerBatch": str(1 << 20)}


def prepare(spark: SparkSession) -> None:
    """Small Arrow batches, and this package on executors that don't share the driver's path."""
    for key, value in BATCH.items():
        spark.conf.set(key, value)
    context = spark.sparkContext
    if context.master.startswith("local") or context.applicationId in _SHIPPED:
        return
    _SHIPPED.add(context.applicationId)
    root = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
    path = os.path.join(tempfile.mkdtemp(), f"{os.path.basename(root)}.zip")
    with zipfile.ZipFile(path, "w") as out:
        for folder, _, names in os.walk(root):
            for name in names:
                if name.endswith(".py"):
                    full = os.path.join(folder, name)
                    out.write(full, os.path.relpath(full, os.path.dirname(root)))
    context.addPyFile(path)


def shared_dir(spark: SparkSession) -> str:
    """The folder in spark.checkpoint.dir; a temporary one of our own where it is unset, as in tests."""
    if not (folder := spark.conf.get("spark.checkpoint.dir", None)):
        if not spark.sparkContext.master.startswith("local["):
            raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
        folder = spark.sparkContext.getCheckpointDir()
        if not folder:
            folder = tempfile.mkdtemp(prefix="edgetide-")
            spark.sparkContext.setCheckpointDir(folder)
            folder = spark.sparkContext.getCheckpointDir()
    return folder.rstrip("/")


def new_path(spark: SparkSession, name: str) -> str:
    path = f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"
    _WRITTEN.append((spark, path))
    return path


def tasks_for(df: DataFrame, task_bytes: int = 16 << 20) -> int:
    """So many tasks that none has to read much more than `task_bytes`, and four for each core at least. Tables of many small partitions
    are coalesced to that, so that they aren't written as as many small files."""
    size = int(df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes())
    # a table of unknown size counts as a very large one
    return max(4 * df.sparkSession.sparkContext.defaultParallelism, min(-(-size // task_bytes), 1 << 20))


#: For rows of megabytes: sizes are checked at each row, and a reader holds some megabytes at once.
LARGE_ROWS = {"parquet.block.size": str(16 << 20), "parquet.page.size.row.check.min": "1", "parquet.block.size.row.check.min": "1"}


def written(df: DataFrame, name: str, tasks: int | None = None, large_rows: bool = False) -> DataFrame:
    """Cut the lineage: the rows as a Parquet table in the shared folder, made by at most so many tasks."""
    spark = df.sparkSession
    path = new_path(spark, name)
    (df.coalesce(tasks) if tasks else df).write.options(**(LARGE_ROWS if large_rows else {})).parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def dropped(spark: SparkSession, path: str) -> None:
    at = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(at, True)


class Scratch:
    """Written tables that are deleted at the end of a with block, when what was made of them has been written, too."""

    def __init__(self, spark: SparkSession, tasks: int):
        self.spark, self.tasks, self.paths = spark, tasks, []

    def __enter__(self) -> "Scratch":
        return self

    def __exit__(self, *_) -> None:
        for path in self.paths:
            dropped(self.spark, path)

    def written(self, df: DataFrame, name: str) -> DataFrame:
        path = new_path(self.spark, name)
        self.paths.append(path)
        df.coalesce(self.tasks).write.parquet(path)
        return self.spark.read.schema(df.schema).parquet(path)


def with_row_key(df: DataFrame, name: str) -> tuple[DataFrame, str]:
    """df as a written table with a number of its own for each row, and that column's name: verdicts on rows whose doc_id is null
    or repeated can be told apart."""
    key = "row_key"
    while key.lower() in (c.lower() for c in df.columns):
        key += "_"
    return written(df.coalesce(tasks_for(df)).withColumn(key, F.monotonically_increasing_id()), name), key


def cleanup() -> None:
    """Delete the written tables."""
    while _WRITTEN:
        spark, path = _WRITTEN.pop()
        try:
            dropped(spark, path)
        except Exception:  # noqa: BLE001  the session has ended: the folder is the cluster's to clear
            return


atexit.register(cleanup)


def load(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


def released(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The batches; after the last, memory that the worker has freed goes back to the system (workers outlive their tasks)."""
    yield from batches
    try:
        ctypes.CDLL(None).malloc_trim(0)
    except (OSError, AttributeError):  # a C library without it
        pass


def words_of(text: bytes | None) -> list[bytes]:
    """Runs of digits, letters and bytes of other alphabets, A-Z lower-cased; null has none."""
    return text.translate(_WORD_BYTES).split() if text else []


def as_bytes(column: pa.Array) -> list[bytes | None]:
    """UTF-8 of a string column, without decoding."""
    if pa.types.is_string(column.type):
        column = column.view(pa.binary())
    elif pa.types.is_large_string(column.type):
        column = column.view(pa.large_binary())
    return column.to_pylist()


class WordHashes(dict):
    LIMIT = 100_000

    """64-bit hashes of words, kept while a batch of texts is read."""

    def __missing__(self, word: bytes) -> int:
        if len(self) > self.LIMIT:
            self.clear()
        value = self[word] = xxhash.xxh3_64_intdigest(word)
        return value


def mix64(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit integers that spreads their bits."""
    with np.errstate(over="ignore"):
        x = (x ^ (x >> np.uint64(33))) * np.uint64(0xFF51AFD7ED558CCD)
        x = (x ^ (x >> np.uint64(29))) * np.uint64(0xC4CEB9FE1A85EC53)
        return x ^ (x >> np.uint64(32))


def rolling(hashes: np.ndarray, width: int) -> np.ndarray:
    """A 64-bit hash of each run of `width` values; a shorter, not empty input is one run."""
    if not len(hashes):
        return hashes
    width = min(width, len(hashes))
    n = len(hashes) - width + 1
    out = np.zeros(n, np.uint64)
    with np.errstate(over="ignore"):
        for k in range(width):
            out = out * np.uint64(0x9E3779B97F4A7C15) + hashes[k : k + n]
    return mix64(out)


def with_unique_names(df: DataFrame, *needed: str) -> DataFrame:
    """The needed columns only, null of type string where one is missing: extra columns can't clash with ours."""
    return df.select(*[F.col(f"`{c}`") if c in df.columns else F.lit(None).cast("string").alias(c) for c in needed])
