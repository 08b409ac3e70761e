"""Benchmark decontamination by a distributed positional inverted index.

The index is split by documents: a block holds the postings of some whole documents, for each term its positions in
the block, documents apart by a gap. So building needs no shuffle, a frequent term has a bounded list in each block,
and lost blocks are built again from their own documents. A test window is looked up from its rarest term: the positions
in that term's list, adjusted by the offset in the window, are kept while each next rarer term has a position at its
own offset (exact phrase) or within `slop` words of it (proximity). The index is written once, and any number of benchmarks can be
searched in it; one of more than `part_bytes` is searched in parts of that size, whose hits are merged, so that no task holds more.

Words are runs of digits, letters and characters above 0x7F; A-Z count as a-z. A window has 13 consecutive words of an
item; an item of fewer words, but not none, is one window. A document word in any occurrence of a window is hit, and a
document is contaminated if some word and at least a twentieth of its words are.

Nulls: null texts have no words; a null item_id reads "null"; null doc_ids are kept. Equal rows are judged each by itself. With
an empty benchmark nothing is hit. Very long texts are indexed whole, in a block of their own if need be. Extra columns are ignored, or
kept by `clean`.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from dataclasses import dataclass
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import as_bytes, prepare, released, tasks_for, with_row_key, with_unique_names, words_of, written

GAP = 64  # positions between two documents of a block; slop must be smaller
#: terms: joined by spaces, which no word has; counts: of postings of each; postings: each term's positions in order, as gaps. Numbers are
#: 32-bit, all their lowest bytes first, then the next: small ones, which most are, compress well.
INDEX = "block long, doc_ids array<long>, n_words array<long>, terms binary, counts binary, postings binary"


def _packed(numbers: np.ndarray) -> bytes:
    return np.ascontiguousarray(numbers.astype("<u4").view(np.uint8).reshape(-1, 4).T).tobytes()


def _unpacked(content: bytes) -> np.ndarray:
    planes = np.frombuffer(content, np.uint8).reshape(4, -1)
    return np.ascontiguousarray(planes.T).view("<u4").ravel().astype(np.int64)


def _gaps(positions: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """Of each term the first position, then the distances from one to the next."""
    out = np.diff(positions, prepend=0)
    starts = (np.cumsum(counts) - counts)[counts > 0]
    out[starts] = positions[starts]
    return out


def _positions(gaps: np.ndarray, counts: np.ndarray) -> np.ndarray:
    upto = np.cumsum(gaps)
    starts = np.cumsum(counts) - counts
    return upto - np.repeat(np.append(0, upto)[starts], counts)


class _Terms(dict):
    def __missing__(self, word: bytes) -> int:
        value = self[word] = len(self)
        return value


@dataclass
class Block:
    """Postings of some whole documents: of each term its positions, documents apart by a gap."""

    n_words: np.ndarray
    terms: list[bytes]
    counts: np.ndarray
    postings: np.ndarray

    @classmethod
    def of(cls, texts: list[list[bytes]]) -> "Block":
        lengths = np.array([len(x) for x in texts], np.int64)
        terms = _Terms()
        term = np.array([t for x in texts for t in map(terms.__getitem__, x)], np.int64)
        starts = np.cumsum(lengths + GAP) - lengths - GAP
        position = np.arange(len(term)) + np.repeat(starts - (np.cumsum(lengths) - lengths), lengths)
        return cls(lengths, list(terms), np.bincount(term, minlength=len(terms)), position[np.argsort(term, kind="stable")])

    def hits(self, phrases: "Phrases", slop: int) -> tuple[list[list[tuple[int, int]]], list[set[str]]]:
        """Of each document the words in occurrences, as (begin, end), and the items."""
        hits: list[list[tuple[int, int]]] = [[] for _ in self.n_words]
        found: list[set[str]] = [set() for _ in self.n_words]
        if phrases.words and len(self.postings):
            which, first = find({t: j for j, t in enumerate(self.terms)}, np.cumsum(self.counts), self.postings, phrases.words, slop)
            starts = np.cumsum(self.n_words + GAP) - self.n_words - GAP
            # empty documents at the same place lie before; those in between have no words
            of = (np.searchsorted(starts, first, "right") - 1).tolist()
            for w, at, d in zip(which.tolist(), first.tolist(), of, strict=True):
                begin = at - int(starts[d])
                hits[d].append((begin, min(begin + len(phrases.words[w]), int(self.n_words[d]))))
                found[d].update(phrases.items[w])
        return [_union(x) for x in hits], found


def _union(spans: list[tuple[int, int]]) -> list[tuple[int, int]]:
    out: list[tuple[int, int]] = []
    for begin, end in sorted(spans):
        if out and begin <= out[-1][1]:
            out[-1] = (out[-1][0], max(out[-1][1], end))
        else:
            out.append((begin, end))
    return out


class Phrases:
    """The distinct windows of some items, each with the ids of its items."""

    def __init__(self, items: list[tuple[object, str | None]], width: int):
        of_window = windows(items, width)
        self.words, self.items = list(of_window), [sorted(x) for x in of_window.values()]


def contaminated(n_hit, n_words):
    """The rule of the contract, of columns or numbers."""
    return (n_hit > 0) & (20 * n_hit >= n_words)


def build_index(docs: DataFrame, block_words: int = 1 << 18) -> DataFrame:
    """Blocks of whole documents with their postings, of about `block_words` words each."""
    prepare(docs.sparkSession)

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        number = TaskContext.get().partitionId() << 32
        ids: list = []
        texts: list[list[bytes]] = []
        size = 0

        def done() -> pa.RecordBatch:
            block = Block.of(texts)
            columns = [pa.array([number]), *(pa.array([x], pa.list_(pa.int64())) for x in (ids, block.n_words))]
            columns += [pa.array([x], pa.binary()) for x in (b" ".join(block.terms), _packed(block.counts), _packed(_gaps(block.postings, block.counts)))]
            return pa.record_batch(columns, ["block", "doc_ids", "n_words", "terms", "counts", "postings"])

        for batch in released(batches):
            for doc_id, text in zip(batch.column(0).to_pylist(), as_bytes(batch.column(1)), strict=True):
                ids.append(doc_id)
                texts.append(words_of(text))
                size += len(texts[-1]) + GAP
                if size >= block_words:
                    yield done()
                    ids, texts, size, number = [], [], 0, number + 1
        if ids:
            yield done()

    source = with_unique_names(docs, "doc_id", "text").select(F.col("doc_id").cast("long"), F.col("text").cast("string"))
    return source.mapInArrow(rows, INDEX)


def windows(items: list[tuple[object, str | None]], width: int = 13) -> dict[tuple[bytes, ...], set[str]]:
    """Each distinct window with the ids of its items."""
    out: dict[tuple[bytes, ...], set[str]] = {}
    for item_id, text in items:
        words = words_of((text or "").encode())
        for k in range(max(1, len(words) - width + 1) if words else 0):
            out.setdefault(tuple(words[k : k + width]), set()).add("null" if item_id is None else str(item_id))
    return out


def find(terms: dict[bytes, int], ends: np.ndarray, postings: np.ndarray, phrases: list[tuple[bytes, ...]], slop: int = 0) -> tuple[np.ndarray, np.ndarray]:
    """Occurrences in a block: numbers of the phrases, and their first words' positions."""
    width = max(map(len, phrases), default=0)
    table = np.full((len(phrases), width), -1, np.int64)
    lengths = np.array([len(p) for p in phrases], np.int64)
    for k, p in enumerate(phrases):
        table[k, : len(p)] = [terms.get(t, -2) for t in p]
    there = np.flatnonzero((table != -2).all(1))
    if not len(there):
        return there, there
    table = table[there]
    counts, starts = np.diff(ends, prepend=0), np.concatenate([[0], ends[:-1]])
    frequency = np.where(table < 0, np.iinfo(np.int64).max, counts[np.maximum(table, 0)])
    order = np.argsort(frequency, axis=1, kind="stable")  # rarest first; padding last
    step = int(postings.max()) + 2 * GAP + width + 2
    keys = np.repeat(np.arange(len(counts)), counts) * step + postings
    rare = order[:, 0]
    term = table[np.arange(len(table)), rare]
    n = counts[term]
    row = np.repeat(np.arange(len(table)), n)
    at = postings[np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n) + np.repeat(starts[term], n)].astype(np.int64)
    first = at - rare[row]
    for k in range(1, width):
        column = order[row, k]
        term = table[row, column]
        wanted = term * step + first + column
        place = np.searchsorted(keys, wanted - slop)
        found = keys[np.minimum(place, len(keys) - 1)]
        # a found key of another term lies more than a gap away, as positions are under step - 2 * GAP
        keep = (term < 0) | ((first + column >= 0) & (place < len(keys)) & (found <= wanted + slop) & (found // step == term))
        row, first = row[keep], first[keep]
    good = first >= 0
    return there[row[good]], first[good]


HITS = "block long, place long, doc_id long, n_words long, hits array<struct<start: long, length: long>>, item_ids array<string>"
_HIT = pa.list_(pa.struct([("start", pa.int64()), ("length", pa.int64())]))


def _hit_rows(block, place, ids, n_words, hits: list[list[tuple[int, int]]], found: list[set[str]]) -> pa.RecordBatch:
    """A row of HITS for each document."""
    spans = [[{"start": x, "length": y - x} for x, y in each] for each in hits]
    columns = [pa.array(block, pa.int64()), pa.array(place, pa.int64()), pa.array(ids, pa.int64()), pa.array(n_words, pa.int64()), pa.array(spans, _HIT), pa.array([sorted(x) for x in found], pa.list_(pa.string()))]
    return pa.record_batch(columns, ["block", "place", "doc_id", "n_words", "hits", "item_ids"])


def _search(index: DataFrame, items: list[tuple[object, str | None]], width: int, slop: int) -> DataFrame:
    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        phrases = Phrases(items, width)
        for batch in released(batches):
            for number, ids, n_words, terms, counts, postings in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                counts = _unpacked(counts)
                block = Block(np.array(n_words, np.int64), terms.split(), counts, _positions(_unpacked(postings), counts))
                yield _hit_rows([number] * len(ids), range(len(ids)), ids, n_words, *block.hits(phrases, slop))

    prepare(index.sparkSession)
    return index.mapInArrow(rows, HITS)


def merged(parts: list[DataFrame]) -> DataFrame:
    """The hits of several searches of one index as one: of every document's spans the union, and all its items."""
    if len(parts) == 1:
        return parts[0]
    every = reduce(DataFrame.unionByName, parts)
    # a row of each part for every document: groups have as many rows as there are parts
    held = every.groupBy("block", "place", "doc_id", "n_words").agg(F.flatten(F.collect_list("hits")).alias("hits"), F.array_distinct(F.flatten(F.collect_list("item_ids"))).alias("item_ids"))

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in released(batches):
            hits = [_union([(h["start"], h["start"] + h["length"]) for h in x]) for x in batch.column(4).to_pylist()]
            yield _hit_rows(*(batch.column(j).to_pylist() for j in range(4)), hits, [set(x) for x in batch.column(5).to_pylist()])

    return held.mapInArrow(rows, HITS)


def _items(benchmark: DataFrame) -> DataFrame:
    return with_unique_names(benchmark, "item_id", "text").select("item_id", F.col("text").cast("string"))


def _size(items: DataFrame) -> int:
    return items.agg(F.sum(F.octet_length("text"))).head()[0] or 0


def search(index: DataFrame, benchmark: DataFrame | list[tuple[object, str | None]], width: int = 13, slop: int = 0, part_bytes: int = 4 << 20) -> DataFrame:
    """Every document of a written index with its hits: block, place, doc_id, n_words, hits array<struct<start, length>> (words, merged),
    item_ids (sorted strings). benchmark: a table of item_id and text, or a list of such pairs."""
    if not 0 <= slop < GAP // 2:
        raise ValueError(f"slop must be less than {GAP // 2}")
    if isinstance(benchmark, list):
        return _search(index, benchmark, width, slop)
    items = _items(benchmark)
    size = _size(items)
    if size <= part_bytes:
        return _search(index, [tuple(r) for r in items.collect()], width, slop)
    # parts by a hash of the rows, of about half the bytes; each comes to the driver when its search is planned
    n = -(-2 * size // part_bytes)
    part = F.pmod(F.xxhash64("item_id", "text"), F.lit(n))
    return merged([_search(index, [tuple(r) for r in items.filter(part == k).collect()], width, slop) for k in range(n)])


def judged(docs: DataFrame, benchmark: DataFrame, width: int = 13) -> DataFrame:
    """doc_id, n_words, n_hit, n_items, items_sha256, contaminated of every document."""
    return verdicts(search(written(build_index(docs), "postings", tasks_for(docs), large_rows=True), benchmark, width))


def verdicts(found: DataFrame) -> DataFrame:
    """The contract's columns from the rows of a search."""
    hit = F.aggregate("hits", F.lit(0).cast("long"), lambda a, x: a + x["length"])
    rows = found.select("doc_id", "n_words", hit.alias("n_hit"), F.size("item_ids").cast("long").alias("n_items"), F.sha2(F.array_join("item_ids", ","), 256).alias("items_sha256"))
    return rows.withColumn("contaminated", contaminated(F.col("n_hit"), F.col("n_words")))


def clean(docs: DataFrame, benchmark: DataFrame, width: int = 13, part_bytes: int = 4 << 20) -> DataFrame:
    """The rows of docs that aren't contaminated, with all their columns, each by its own verdict, whatever its doc_id. The index of a
    block is searched where it is made, so nothing moves; a benchmark of more than `part_bytes` is searched in a written index, whose
    verdicts come back by a number written with the rows."""
    items = _items(benchmark)
    if _size(items) > part_bytes:
        rows, key = with_row_key(docs, "rows")
        found = judged(rows.select(F.col(key).alias("doc_id"), "text"), benchmark, width)
        bad = written(found.filter("contaminated").select(F.col("doc_id").alias(key)), "contaminated")
        return rows.join(bad, key, "left_anti").select(*docs.columns)
    held, at = [tuple(r) for r in items.collect()], docs.columns.index("text")
    prepare(docs.sparkSession)

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        phrases = Phrases(held, width)
        for batch in released(batches):
            block = Block.of([words_of(x) for x in as_bytes(batch.column(at).cast(pa.string()))])
            n_hit = np.array([sum(end - begin for begin, end in x) for x in block.hits(phrases, 0)[0]], np.int64)
            yield batch.filter(pa.array(~contaminated(n_hit, block.n_words)))

    return docs.mapInArrow(rows, docs.schema)


def brute_force(text: str | None, items: list[tuple[object, str | None]], width: int = 13) -> tuple[int, int, int, str, bool]:
    """What judged() returns for one text, by trying every window everywhere."""
    words, hit, found = words_of((text or "").encode()), set(), set()
    for phrase, owners in windows(items, width).items():
        for k in range(len(words) - len(phrase) + 1):
            if tuple(words[k : k + len(phrase)]) == phrase:
                hit.update(range(k, k + len(phrase)))
                found |= owners
    digest = hashlib.sha256(",".join(sorted(found)).encode()).hexdigest()
    return len(words), len(hit), len(found), digest, contaminated(len(hit), len(words))
