"""Vector best-fit packing of documents into training sequences.

A sequence has three capacities: tokens, documents and attention cost (the sum of squared piece lengths). A piece's
demands follow from its length alone, so pieces of one length are interchangeable, and so are sequences with the same
residuals. The plan is therefore made on the histogram of lengths: lengths in descending order, each placed in runs of
equal sequences chosen by the least weighted norm of the residuals left, or by the largest weighted dot product of
demand and residual, among those that hold it under every constraint. The plan's size depends on the capacity, not on
the corpus; pieces find their places by their rank among pieces of equal length, which is counted in parallel.

Nulls: a null text is empty and becomes a piece of the end id only; a null doc_id is kept. Equal rows are pieces of their
own. Very long texts are cut into pieces whole. An empty table gives no pieces. Columns other than doc_id and text are ignored.
"""

from __future__ import annotations

import heapq
import zlib
from collections import defaultdict
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from . import tokens
from .common import prepare, released, tasks_for, with_unique_names, written


@dataclass(frozen=True)
class Capacity:
    tokens: int = 1024
    documents: int = 1024
    cost: int = 1024 * 1024
    #: Weights of tokens, documents and cost in the score.
    weights: tuple[float, float, float] = (1.0, 0.01, 0.01)
    rule: str = "residual_norm"  # or dot_product

    def __post_init__(self):
        if self.rule not in ("residual_norm", "dot_product"):
            raise ValueError(f"no such rule: {self.rule}")
        if min(self.tokens, self.documents, self.cost) < 1:
            raise ValueError("capacities must be positive")

    def longest(self) -> int:
        """Tokens of the longest piece that an empty sequence holds."""
        return min(self.tokens, int(self.cost**0.5))

    def score(self, left: tuple[int, int, int], length: int) -> float:
        """Smaller is better."""
        full, need = (self.tokens, self.documents, self.cost), (length, 1, length * length)
        if self.rule == "residual_norm":
            return sum(w * ((x - y) / f) ** 2 for w, x, y, f in zip(self.weights, left, need, full, strict=True))
        return -sum(w * (x / f) * (y / f) for w, x, y, f in zip(self.weights, left, need, full, strict=True))


def plan(histogram: dict[int, int], capacity: Capacity) -> list[tuple[int, int, int, int, int]]:
    """Placements (length, first rank, pieces, first sequence, offset): the piece with rank first + k goes to sequence first + k."""
    out: list[tuple[int, int, int, int, int]] = []
    runs: dict[tuple[int, int, int], list[tuple[int, int]]] = defaultdict(list)
    opened = 0

    def fits(left: tuple[int, int, int], s: int) -> bool:
        return left[0] >= s and left[1] >= 1 and left[2] >= s * s

    for s in sorted(histogram, reverse=True):
        todo, rank = histogram[s], 0
        heap = [(capacity.score(x, s), x) for x in runs if fits(x, s)]
        heapq.heapify(heap)
        while todo and heap:
            _, left = heapq.heappop(heap)
            after = (left[0] - s, left[1] - 1, left[2] - s * s)
            fresh = after not in runs
            for first, n in (held := runs.pop(left)):
                k = min(n, todo)
                if k:
                    out.append((s, rank, k, first, capacity.tokens - left[0]))
                    runs[after].append((first, k))
                    rank, todo = rank + k, todo - k
                if k < n:
                    runs[left].append((first + k, n - k))
            if fresh and held and fits(after, s):
                heapq.heappush(heap, (capacity.score(after, s), after))
        if todo:
            each = min(capacity.tokens // s, capacity.documents, capacity.cost // (s * s))
            for n, per in ((todo // each, each), (1, todo % each)):
                if n and per:
                    out += [(s, rank + j * n, n, opened, j * s) for j in range(per)]
                    runs[capacity.tokens - per * s, capacity.documents - per, capacity.cost - per * s * s].append((opened, n))
                    rank, opened = rank + per * n, opened + n
    return out


def cut(n: int, longest: int) -> list[tuple[int, int]]:
    """(start, length) of the pieces of n tokens: all of the longest length but the first, which may be shorter."""
    first = (n - 1) % longest + 1 if n else 0
    return [(0, first), *((x, longest) for x in range(first, n, longest))] if n else []


def pieces(docs: DataFrame, tokenizer: str, capacity: Capacity, end_id: int = tokens.END_ID, with_ids: bool = False) -> DataFrame:
    """doc_id, piece, start, length, ids_crc32[, ids] of every piece of every document."""
    prepare(docs.sparkSession)
    longest = capacity.longest()
    schema = "doc_id long, piece int, start long, length long, ids_crc32 long" + ", ids binary" * with_ids

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in released(batches):
            out = []
            for doc_id, ids in zip(batch.column(0).to_pylist(), tokens.encoded(batch.column(1), tokenizer, end_id), strict=True):
                for k, (at, n) in enumerate(cut(len(ids) // 4, longest)):
                    own = ids[4 * at : 4 * (at + n)]
                    out.append((doc_id, k, at, n, zlib.crc32(own), own)[: 5 + with_ids])
            kinds = [pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64(), pa.binary()]
            yield pa.record_batch([pa.array([x[j] for x in out], kinds[j]) for j in range(5 + with_ids)], [x.split(" ")[0] for x in schema.split(", ")])

    source = with_unique_names(docs, "doc_id", "text").select(F.col("doc_id").cast("long"), F.col("text").cast("string"))
    return source.mapInArrow(rows, schema)


def place(table: DataFrame, capacity: Capacity, bucket_rows: int = 50_000) -> DataFrame:
    """Add sequence_id and offset to a written table of pieces with a number of each in `row`. At most one row of histogram for each
    length comes to the driver. Pieces of one length are ranked in buckets, dealt by a hash of the row's number, so that even equal rows
    spread."""
    histogram = {r[0]: r[1] for r in table.groupBy("length").count().collect()}
    placed = np.array(plan(histogram, capacity), np.int64).reshape(-1, 5)
    order = np.lexsort((placed[:, 1], placed[:, 0]))
    lengths, ranks, _, sequences, offsets = placed[order].T
    keys = (lengths << 44) + ranks
    most = max(histogram.values(), default=1)
    buckets = max(-(-most // bucket_rows), min(64, -(-most // 256)))
    rows = table.withColumn("bucket", F.pmod(F.xxhash64("row"), F.lit(buckets)))
    own = Window.partitionBy("length", "bucket").orderBy("row")
    counts = rows.groupBy("length", "bucket").agg(F.count("*").alias("n"))
    upto = Window.partitionBy("length").orderBy("bucket").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    bases = counts.select("length", "bucket", (F.sum("n").over(upto) - F.col("n")).alias("base"))
    ranked = rows.withColumn("own", F.row_number().over(own)).join(bases, ["length", "bucket"])
    names = ["doc_id", "piece", "start", "length", "ids_crc32"]
    ranked = ranked.select(*names, (F.col("base") + F.col("own") - 1).alias("rank"))

    def find(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in released(batches):
            n, rank = batch.column(3).to_numpy(zero_copy_only=False), batch.column(5).to_numpy(zero_copy_only=False)
            at = np.searchsorted(keys, (n.astype(np.int64) << 44) + rank, "right") - 1
            yield pa.record_batch([*batch.columns[:5], pa.array(sequences[at] + rank - ranks[at]), pa.array(offsets[at])], [*names, "sequence_id", "offset"])

    return ranked.mapInArrow(find, "doc_id long, piece int, start long, length long, ids_crc32 long, sequence_id long, offset long")


def pack(docs: DataFrame, tokenizer: str, capacity: Capacity = Capacity()) -> DataFrame:
    """Every piece with its sequence and its place there."""
    return place(written(pieces(docs, tokenizer, capacity).coalesce(tasks_for(docs)).withColumn("row", F.monotonically_increasing_id()), "pieces"), capacity)
