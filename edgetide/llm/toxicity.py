"""Toxicity scores: FTRL-proximal logistic regression over hashed word n-grams and skip-grams.

Features of a text are the presence of its words, of their stems (first four and first five bytes), of pairs of
neighbouring words and of pairs with one or two words between, all hashed to 2**bits places. Every place has its own
learning rate, and the L1 term leaves most weights at exactly zero, so that the broadcast model is only the others.

The model is fitted in one task on a bounded sample of labelled rows: `Settings.max_rows` of them at most, the least
by a hash of doc_id where there are more, with one text each (where an id has several, the least by its hash). All documents are
scored, whole, very long ones too. Inputs of a score are words alone.

Nulls: a null text, like an empty one, has the bias for its only feature; rows with a null doc_id, and null labels, teach
nothing and are never held out. Labels that come twice count as toxic if either is. Equal rows get equal scores. Without
labels of both kinds every score is the share of toxic labels (0 without any). Extra columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import as_bytes, prepare, released, with_unique_names, words_of


@dataclass(frozen=True)
class Settings:
    bits: int = 20
    alpha: float = 1.0
    beta: float = 1.0
    l1: float = 6.0
    l2: float = 0.1
    epochs: int = 3
    max_rows: int = 20_000


class Vocabulary(dict):
    """Word -> row of `hashes`: of the word and its two stems."""

    LIMIT = 150_000

    def __init__(self):
        super().__init__()
        self.rows: list[tuple[int, int, int]] = []

    def __missing__(self, word: bytes) -> int:
        value = self[word] = len(self.rows)
        self.rows.append((xxhash.xxh3_64_intdigest(word), xxhash.xxh3_64_intdigest(word[:4], 4), xxhash.xxh3_64_intdigest(word[:5], 5)))
        return value

    def hashes(self, words: list[bytes]) -> np.ndarray:
        if len(self) > self.LIMIT:
            self.clear()
            self.rows.clear()
        at = np.fromiter(map(self.__getitem__, words), np.int64, len(words))
        # only rows in use are turned to an array
        used, at = np.unique(at, return_inverse=True)
        return np.array([self.rows[k] for k in used.tolist()], np.uint64).reshape(-1, 3)[at]


def places(hashes: np.ndarray, bits: int, ends: np.ndarray | None = None) -> list[tuple[np.ndarray, np.ndarray]]:
    """For each kind of feature its places, and the word each begins at. With ends (of texts laid end to end), no pair crosses one."""
    shift, out = np.uint64(64 - bits), []
    words = np.arange(len(hashes))
    for k in range(3):
        out.append((hashes[:, k] * np.uint64(0x9E3779B97F4A7C15) >> shift, words))
    text = np.zeros(len(hashes), np.int64) if ends is None else np.repeat(np.arange(len(ends)), np.diff(ends, prepend=0))
    for gap in (1, 2, 3):
        mixed = hashes[:-gap, 0] * np.uint64(0xC2B2AE3D27D4EB4F) + hashes[gap:, 0] + np.uint64(gap)
        same = text[:-gap] == text[gap:]
        mixed = (mixed ^ (mixed >> np.uint64(29))) * np.uint64(0x9E3779B97F4A7C15)
        out.append(((mixed >> shift)[same], words[:-gap][same]))
    return out


def features(text: bytes | None, vocabulary: Vocabulary, bits: int) -> np.ndarray:
    """The sorted set of places; the bias is place 2**bits."""
    words = words_of(text)
    found = [x for x, _ in places(vocabulary.hashes(words), bits)] if words else []
    return np.append(np.unique(np.concatenate(found)).astype(np.int64) if found else np.empty(0, np.int64), 1 << bits)


def fit(rows: list[tuple[int, np.ndarray]], settings: Settings) -> tuple[np.ndarray, np.ndarray]:
    """Places and weights that aren't zero, by FTRL-proximal over (label, features)."""
    size = (1 << settings.bits) + 1
    z, n = np.zeros(size), np.zeros(size)
    bias = size - 1

    def weights(at: np.ndarray) -> np.ndarray:
        own = z[at]
        penalty = np.where(at == bias, 0.0, settings.l1)
        w = -(own - np.sign(own) * penalty) / ((settings.beta + np.sqrt(n[at])) / settings.alpha + settings.l2)
        return np.where(np.abs(own) <= penalty, 0.0, w)

    if {y for y, _ in rows} != {0, 1}:
        share = float(np.mean([y for y, _ in rows])) if rows else 0.0
        return np.array([bias]), np.array([np.log(max(share, 1e-12) / max(1 - share, 1e-12))])
    for _ in range(settings.epochs):
        for label, at in rows:
            w = weights(at)
            gradient = 1 / (1 + np.exp(-np.clip(w.sum(), -35, 35))) - label
            squares = n[at]
            sigma = (np.sqrt(squares + gradient * gradient) - np.sqrt(squares)) / settings.alpha
            z[at] += gradient - sigma * w
            n[at] = squares + gradient * gradient
    w = weights(np.arange(size))
    at = np.flatnonzero(w)
    return at, w[at]


def held_out(doc_id: Column) -> Column:
    return F.coalesce(F.crc32(doc_id.cast("string")) % 5 == 0, F.lit(False))


def train(docs: DataFrame, labels: DataFrame, settings: Settings = Settings()) -> tuple[np.ndarray, np.ndarray]:
    """The model of the labelled rows that aren't held out. Its size is bounded by 2**bits."""
    spark = docs.sparkSession
    prepare(spark)
    known = with_unique_names(labels, "doc_id", "toxic").select(F.col("doc_id").cast("long").alias("doc_id"), F.col("toxic").cast("int").alias("toxic"))
    known = known.filter(F.col("doc_id").isNotNull() & F.col("toxic").isNotNull() & ~held_out(F.col("doc_id"))).groupBy("doc_id").agg(F.max("toxic").alias("toxic"))
    # at most max_rows rows, the least by hash: small enough to broadcast
    sample = known.orderBy(F.xxhash64("doc_id"), "doc_id").limit(settings.max_rows)
    texts = with_unique_names(docs, "doc_id", "text").select(F.col("doc_id").cast("long"), F.col("text").cast("string"))
    # one text of each id, so that ids bound the rows
    rows = texts.join(F.broadcast(sample), "doc_id").groupBy("doc_id").agg(F.max("toxic").alias("toxic"), F.min_by("text", F.struct(F.xxhash64("text"), "text")).alias("text"))
    rows = rows.repartition(1).sortWithinPartitions(F.xxhash64("doc_id"), "doc_id")

    def learn(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        vocabulary, taught = Vocabulary(), []
        for batch in released(batches):
            for label, text in zip(batch.column(1).to_pylist(), as_bytes(batch.column(2)), strict=True):
                taught.append((int(label > 0), features(text, vocabulary, settings.bits).astype(np.int32)))
        at, w = fit(taught, settings)
        yield pa.record_batch([pa.array([at.astype("<i8").tobytes()]), pa.array([w.astype("<f8").tobytes()])], ["at", "w"])

    model = rows.mapInArrow(learn, "at binary, w binary").head()
    if model is None:
        return fit([], settings)
    return np.frombuffer(model.at, "<i8").copy(), np.frombuffer(model.w, "<f8").copy()


def score(docs: DataFrame, model: tuple[np.ndarray, np.ndarray], settings: Settings = Settings()) -> DataFrame:
    """doc_id, held_out, score, predicted of every document."""
    prepare(docs.sparkSession)
    at, w = model
    sent = docs.sparkSession.sparkContext.broadcast((at, w.astype(np.float32)))

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = np.zeros((1 << settings.bits) + 1, np.float32)
        table[sent.value[0]] = sent.value[1]
        vocabulary = Vocabulary()
        for batch in released(batches):
            split = [words_of(x) for x in as_bytes(batch.column(1))]
            ends = np.cumsum([len(x) for x in split])
            total = np.full(len(split), table[-1], np.float64)
            hashes = vocabulary.hashes([w for x in split for w in x])
            found = [np.empty(0, np.int64)]
            for place, begin in places(hashes, settings.bits, ends) if len(hashes) else []:
                some = np.flatnonzero(table[place])
                found.append((np.searchsorted(ends, begin[some], "right") << (settings.bits + 1)) + place[some].astype(np.int64))
            # a place counts once for each text, whatever features it is of
            once = np.unique(np.concatenate(found))
            np.add.at(total, once >> (settings.bits + 1), table[once & ((1 << (settings.bits + 1)) - 1)])
            yield pa.record_batch([batch.column(0), batch.column(2), pa.array(1 / (1 + np.exp(-np.clip(total, -500, 500))))], ["doc_id", "held_out", "score"])

    source = with_unique_names(docs, "doc_id", "text").select(F.col("doc_id").cast("long"), F.col("text").cast("string"), held_out(F.col("doc_id").cast("long")).alias("held_out"))
    out = source.mapInArrow(rows, "doc_id long, held_out boolean, score double")
    return out.withColumn("predicted", (F.col("score") >= 0.5).cast("int"))


def judged(docs: DataFrame, labels: DataFrame, settings: Settings = Settings()) -> DataFrame:
    return score(docs, train(docs, labels, settings), settings)
