"""Token-ID files: independent zstandard frames, a trailing seek table and a checksum for each frame.

A file is an ordinary seekable zstandard file. Frame 0 is its index (place of the file, then id, null mark and number
of tokens of each document); each later frame holds the ids of one document (of several whole ones, up to `frame_bytes`, where
a writer asks for larger frames). The seek table at the end, in a skippable frame, has each frame's compressed and raw size and
the low 32 bits of the XXH64 of its raw bytes, so that a reader seeks to the frames of the documents it wants and decompresses no others.

Files are written by Spark's own text writer, which reaches any store that Spark reaches: a row is a file without
its last four bytes, and the line separator is those four bytes, the magic number that ends every seek table.

Nulls: a null text is empty (end id only); a null doc_id sorts first and stays null. Equal doc_ids keep their rows,
ordered by a hash of their texts. Very long texts are one frame. An empty table gives an empty store. Columns other than doc_id and text are ignored.
"""

from __future__ import annotations

import struct
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from . import tokens
from .common import new_path, prepare, released, with_unique_names, written

# Fixed values of the seekable zstandard format.
SKIPPABLE_MAGIC, SEEK_MAGIC, CHECKSUM_FLAG = 0x184D2A5E, 0x8F92EAB1, 0x80
INDEX_HEAD = struct.Struct("<4sIIIB")  # mark, partition, file within it, documents, bytes an id
MARK = b"TIDS"


def file_bytes(part: int, chunk: int, doc_ids: list[int | None], ids: list[bytes], frame_bytes: int = 0) -> bytes:
    """A whole file; ids are little-endian unsigned 32-bit integers of each document."""
    arrays = [np.frombuffer(x, "<u4") for x in ids]
    narrow = all(x.max(initial=0) < 1 << 16 for x in arrays)
    raw = [x.astype("<u2" if narrow else "<u4").tobytes() for x in arrays]
    index = INDEX_HEAD.pack(MARK, part, chunk, len(ids), 2 if narrow else 4)
    index += np.array([x or 0 for x in doc_ids], "<i8").tobytes() + bytes(x is None for x in doc_ids)
    index += np.array([len(x) for x in arrays], "<u8").tobytes()
    frames, held, size = [index], [], 0
    for x in raw:
        held.append(x)
        size += len(x)
        if size >= frame_bytes:
            frames.append(b"".join(held))
            held, size = [], 0
    frames += [b"".join(held)] if held else []
    packer = zstandard.ZstdCompressor(level=1, write_checksum=True, write_content_size=True)
    packed = [packer.compress(x) for x in frames]
    table = b"".join(struct.pack("<III", len(c), len(x), xxhash.xxh64_intdigest(x) & 0xFFFFFFFF) for c, x in zip(packed, frames, strict=True))
    table += struct.pack("<IBI", len(frames), CHECKSUM_FLAG, SEEK_MAGIC)
    return b"".join(packed) + struct.pack("<II", SKIPPABLE_MAGIC, len(table)) + table


class Store:
    """Reader of one file; `read(begin, end)` returns its bytes from begin to end."""

    def __init__(self, read, size: int):
        self.read, self.unpacker = read, zstandard.ZstdDecompressor()
        frames, flag, magic = struct.unpack("<IBI", read(size - 9, size))
        if magic != SEEK_MAGIC or flag != CHECKSUM_FLAG:
            raise ValueError("the file doesn't end with a seek table")
        begin = size - 9 - 12 * frames
        if struct.unpack("<II", read(begin - 8, begin)) != (SKIPPABLE_MAGIC, 12 * frames + 9):
            raise ValueError("the seek table is damaged")
        self.table = np.frombuffer(read(begin, size - 9), "<u4").reshape(-1, 3)
        self.at = np.concatenate([[0], np.cumsum(self.table[:, 0], dtype=np.int64)])
        index = self.frame(0)
        mark, self.part, self.chunk, n, width = INDEX_HEAD.unpack_from(index)
        if mark != MARK:
            raise ValueError("no index frame")
        at = INDEX_HEAD.size
        numbers = np.frombuffer(index, "<i8", n, at)
        nulls = index[at + 8 * n : at + 9 * n]
        self.doc_ids = [None if null else int(x) for x, null in zip(numbers, nulls, strict=True)]
        self.lengths = np.frombuffer(index, "<u8", n, at + 9 * n).astype(np.int64)
        self.dtype = f"<u{width}"
        self.bounds = np.concatenate([[0], np.cumsum(self.lengths * width)])
        self.raw = np.concatenate([[0], np.cumsum(self.table[1:, 1], dtype=np.int64)])

    def frame(self, k: int) -> bytes:
        """One frame, its checksum verified."""
        raw = self.unpacker.decompress(self.read(int(self.at[k]), int(self.at[k + 1])))
        if xxhash.xxh64_intdigest(raw) & 0xFFFFFFFF != self.table[k, 2]:
            raise ValueError(f"frame {k} doesn't have its checksum")
        return raw

    def document(self, k: int) -> np.ndarray:
        """Ids of the k-th document, from its own frame alone."""
        begin = int(self.bounds[k])
        j = int(np.searchsorted(self.raw, begin, "right")) - 1
        if begin == self.bounds[k + 1]:
            return np.array([], "<u4")
        return np.frombuffer(self.frame(j + 1)[begin - self.raw[j] : self.bounds[k + 1] - self.raw[j]], self.dtype).astype("<u4")

    def documents(self) -> Iterator[np.ndarray]:
        """Ids of every document in order, each frame decompressed once."""
        k = 0
        for j in range(1, len(self.table)):
            raw, base = self.frame(j), self.raw[j - 1]
            while k < len(self.lengths) and self.bounds[k + 1] <= self.raw[j]:
                yield np.frombuffer(raw[self.bounds[k] - base : self.bounds[k + 1] - base], self.dtype).astype("<u4")
                k += 1


def write(docs: DataFrame, path: str, tokenizer: str, end_id: int = tokens.END_ID, file_tokens: int = 1 << 21) -> None:
    """Write the ids of all documents to files of about `file_tokens`, in ascending doc_id order."""
    spark = docs.sparkSession
    prepare(spark)

    def files(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, chunk = TaskContext.get().partitionId(), 0
        held_ids: list[int | None] = []
        held: list[bytes] = []
        size = 0

        def done() -> pa.RecordBatch:
            return pa.record_batch([pa.array([file_bytes(part, chunk, held_ids, held)[:-4]], pa.binary())], ["value"])

        for batch in released(batches):
            for doc_id, ids in zip(batch.column(0).to_pylist(), tokens.encoded(batch.column(1), tokenizer, end_id), strict=True):
                held_ids.append(doc_id)
                held.append(ids)
                size += len(ids) // 4
                if size >= file_tokens:
                    yield done()
                    held_ids, held, size, chunk = [], [], 0, chunk + 1
        if held:
            yield done()

    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    rows = with_unique_names(docs, "doc_id", "text").select(F.col("doc_id").cast("long"), F.col("text").cast("string"))
    tie = F.xxhash64("text")
    ordered = rows.repartitionByRange(parts, F.col("doc_id").asc_nulls_first(), tie).sortWithinPartitions(F.col("doc_id").asc_nulls_first(), tie)
    out = ordered.mapInArrow(files, "value binary").select(F.col("value").cast("string"))
    out.write.option("maxRecordsPerFile", 1).option("encoding", "ISO-8859-1").option("lineSep", struct.pack("<I", SEEK_MAGIC).decode("latin-1")).text(path)


def _files(spark: SparkSession, path: str) -> DataFrame:
    prepare(spark)
    return spark.read.format("binaryFile").option("pathGlobFilter", "part-*").load(path).select("content")


def read(spark: SparkSession, path: str, with_ids: bool = True) -> DataFrame:
    """Every document of the files: part, chunk, place, doc_id, n_tokens, ids_crc32[, ids]. All checksums are verified."""
    return _opened(_files(spark, path), None, with_ids)


def lookup(spark: SparkSession, path: str, doc_ids: list[int | None], with_ids: bool = True) -> DataFrame:
    """As read(), for the wanted documents alone (a list that the caller holds, so bounded): of each file the index and their frames are
    decompressed, nothing else. An id with several rows has them all, one without any has none."""
    return _opened(_files(spark, path), frozenset(doc_ids), with_ids)


def _opened(files: DataFrame, wanted: frozenset[int | None] | None, with_ids: bool) -> DataFrame:
    schema = "part long, chunk long, place long, doc_id long, n_tokens long, ids_crc32 long" + ", ids array<long>" * with_ids

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in released(batches):
            for content in batch.column(0).to_pylist():
                store = Store(lambda a, b, c=content: c[a:b], len(content))
                at = range(len(store.doc_ids)) if wanted is None else [k for k, x in enumerate(store.doc_ids) if x in wanted]
                ids = list(store.documents() if wanted is None else map(store.document, at))
                n = len(ids)
                columns = [[store.part] * n, [store.chunk] * n, at, [store.doc_ids[k] for k in at], [len(x) for x in ids], [zlib.crc32(x.tobytes()) for x in ids]]
                arrays = [pa.array(x, pa.int64()) for x in columns] + ([pa.array([x.astype(np.int64) for x in ids], pa.list_(pa.int64()))] if with_ids else [])
                yield pa.record_batch(arrays, [x.split(" ")[0] for x in schema.split(", ")])

    return files.mapInArrow(rows, schema)


def with_starts(rows: DataFrame) -> DataFrame:
    """Add start: the number of ids of all documents before. Sums of the writer's partitions are added up, then those of the files within
    each, then documents within each file: the window that isn't partitioned runs over a row for each partition."""
    def below(table: DataFrame, by: list[str], order: str, n: str, name: str) -> DataFrame:
        upto = Window.partitionBy(*by).orderBy(order).rowsBetween(Window.unboundedPreceding, Window.currentRow)
        return table.withColumn(name, F.sum(n).over(upto) - F.col(n))

    files = rows.groupBy("part", "chunk").agg(F.sum("n_tokens").alias("n"))
    parts = below(files.groupBy("part").agg(F.sum("n").alias("n")), [], "part", "n", "base").select("part", "base")
    files = below(files, ["part"], "chunk", "n", "first").join(parts, "part").select("part", "chunk", (F.col("first") + F.col("base")).alias("base"))
    within = below(rows, ["part", "chunk"], "place", "n_tokens", "within").join(files, ["part", "chunk"])
    return within.withColumn("start", F.col("base") + F.col("within")).drop("within", "base")


def round_trip(docs: DataFrame, tokenizer: str) -> DataFrame:
    """Write a store in the shared folder and read it back: doc_id, start, n_tokens, ids_crc32."""
    spark = docs.sparkSession
    path = new_path(spark, "token-store")
    write(docs, path, tokenizer)
    rows = written(read(spark, path, with_ids=False), "token-rows")
    return with_starts(rows).select("doc_id", "start", "n_tokens", "ids_crc32")
