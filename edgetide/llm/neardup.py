"""Near duplicates: a Jaccard join of word five-grams through a MinHash LSH forest, verified exactly.

A text's five-grams form a set (a text of one to four words is one gram). Texts with equal sets are a class, found by a
128-bit digest, and only classes are joined. A class has a path of `depth` minima in each of `trees` prefix tries; a path is two
numbers of four minima each, so that paths sort as the tries do and a prefix is a mask.

Pairs are matched by their longest common prefix, from full paths on: first those that share a whole path in some tree. They are
verified with the exact sets, and the similarities found say how many links that depth misses: a link of similarity s is
found with probability 1 - (1 - s**depth) ** trees. Then the prefix is shortened to the longest at which the links to be expected
are found with the target recall, only pairs that the longer one didn't match are verified, and so on until the depth reached
has that recall. Links are counted once for each class and band of similarity, so that a large group of much alike texts doesn't
outvote the rest, and one more link at the threshold itself is always assumed. The prefix is never shorter than the one that finds
a pair at the threshold with the target recall, whatever was found.

Members of a trie node meet sorted by path. A pair counts in the first tree whose node it shares; nodes all of whose members share
an earlier one, or the longer prefix, are left out; a large node is dealt out as pairs of blocks of bounded size. Nothing is capped,
and pairs are counted where they are found, so a node of thousands of near copies makes a row for each member and block pair, not for
each pair. (Each member of a node of b blocks is in b of its block pairs: all its pairs are compared, so that copying can't be less
unless blocks are larger.)

Result, one row for each document: doc_id, class_id (the least doc_id of those reached over links or equal sets), n_links
(other documents at or over the threshold, copies included). Nulls: a null text or one without words has no links and
is its own class (class_id is its doc_id); null doc_ids are kept and are no class_id while another member has one. Equal
rows are copies of each other. Very long texts are read whole. An empty table gives no rows. Extra columns are ignored.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from dataclasses import dataclass
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import Scratch, WordHashes, as_bytes, mix64, prepare, released, rolling, tasks_for, with_row_key, with_unique_names, words_of, written


HALF, BITS = 4, 16  # minima in a number, and bits of each
BANDS = 52


@dataclass(frozen=True)
class Forest:
    threshold: float = 0.8
    words: int = 5
    trees: int = 16
    depth: int = 8
    recall: float = 0.9995
    #: Grams of the members of a block; a task holds two blocks.
    block_grams: int = 400_000
    block_members: int = 1_000

    def __post_init__(self):
        if not 1 <= self.depth <= 2 * HALF:
            raise ValueError(f"depth must be from 1 to {2 * HALF}")

    def found(self, similarity: float, depth: int) -> float:
        """The probability that a pair shares a prefix of that depth in some tree."""
        return 1 - (1 - similarity**depth) ** self.trees

    def shortest(self) -> int:
        """The longest prefix that finds a pair at the threshold with the target recall."""
        return next((d for d in range(self.depth, 1, -1) if self.found(self.threshold, d) >= self.recall), 1)

    def next_depth(self, bands: list[int], depth: int) -> int:
        """The longest prefix, not over `depth`, at which the links to be expected are found with the target recall; bands: those found
        at `depth`, by similarity."""
        low = [self.threshold + (1 - self.threshold) * k / BANDS for k in range(BANDS)]
        expected = [n / self.found(s, depth) for n, s in zip(bands, low, strict=True)]
        expected[0] += 1
        for d in range(depth, self.shortest(), -1):
            # a shorter prefix is taken with half the loss to spare: one step then mostly is enough
            loss = (1 - self.recall) / (1 if d == depth else 2)
            if sum(n * self.found(s, d) for n, s in zip(expected, low, strict=True)) >= (1 - loss) * sum(expected):
                return d
        return self.shortest()


def masks(depth: int) -> tuple[int, int]:
    """Of a prefix, the bits in a path's two numbers, as signed."""
    def mask(n: int) -> int:
        bits = ((1 << 64) - 1) ^ ((1 << (64 - BITS * n)) - 1)
        return bits - (1 << 64) if bits >> 63 else bits

    return mask(min(depth, HALF)), mask(max(depth - HALF, 0))


def grams(text: bytes | None, words: int, hashes: WordHashes) -> np.ndarray:
    """The sorted set of hashed grams."""
    split = words_of(text)
    return np.unique(rolling(np.fromiter(map(hashes.__getitem__, split), np.uint64, len(split)), words))


def seeds(n: int) -> tuple[np.ndarray, np.ndarray]:
    x = mix64(np.arange(1, 2 * n + 1, dtype=np.uint64))
    return (x[:n] >> np.uint64(32)).astype(np.uint32) | np.uint32(1), (x[n:] >> np.uint64(32)).astype(np.uint32)


def paths(sets: list[np.ndarray], forest: Forest) -> np.ndarray:
    """A row for each set; of each tree's path the first number, then of each the second."""
    out = np.zeros((2 * forest.trees, len(sets)), np.uint64)
    full = [k for k, x in enumerate(sets) if len(x)]
    if not full:
        return out.T
    every = np.concatenate([sets[k] for k in full])
    every = (every ^ (every >> np.uint64(32))).astype(np.uint32)
    starts = np.cumsum([0, *(len(sets[k]) for k in full[:-1])])
    with np.errstate(over="ignore"):
        for j, (a, b) in enumerate(zip(*seeds(forest.trees * forest.depth), strict=True)):
            tree, level = divmod(j, forest.depth)
            least = np.minimum.reduceat((every ^ b) * a, starts)
            # minima of large sets are small numbers: their bits are spread before some are taken
            part = (least * np.uint32(0x9E3779B1)) >> np.uint32(32 - BITS)
            out[tree + (level >= HALF) * forest.trees, full] |= part.astype(np.uint64) << np.uint64(64 - BITS * (level % HALF + 1))
    return out.T


def digest(grams_: np.ndarray) -> tuple[int, int]:
    return tuple(np.frombuffer(hashlib.blake2b(grams_.tobytes(), digest_size=16).digest(), "<i8").tolist())


def signed_rows(docs: DataFrame, forest: Forest) -> DataFrame:
    """doc_id, d1, d2 (the digest; null without words), n (grams), k0.. (numbers of the paths) of every document."""
    names = ["doc_id", "d1", "d2", "n", *(f"k{t}" for t in range(2 * forest.trees))]

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hashes = WordHashes()
        for batch in released(batches):
            sets = [grams(x, forest.words, hashes) for x in as_bytes(batch.column(1))]
            marks = [digest(x) if len(x) else (None, None) for x in sets]
            keys = np.ascontiguousarray(paths(sets, forest).T).view(np.int64)
            yield pa.record_batch([batch.column(0), *(pa.array([m[j] for m in marks], pa.int64()) for j in (0, 1)), pa.array([len(x) for x in sets], pa.int64()), *map(pa.array, keys)], names)

    source = with_unique_names(docs, "doc_id", "text").select(F.col("doc_id").cast("long"), F.col("text").cast("string"))
    return source.mapInArrow(rows, ", ".join(f"{x} long" for x in names))


def shares(keys: np.ndarray, i: int, depth: int) -> np.ndarray:
    """For each member and tree: whether it shares a prefix of that depth with member i."""
    trees = keys.shape[1] // 2
    high, low = (np.int64(x) for x in masks(depth))
    other = keys ^ keys[i]
    return ((other[:, :trees] & high) == 0) & ((other[:, trees:] & low) == 0)


def linked(left: np.ndarray, sets: list[np.ndarray], keys: np.ndarray, weights: np.ndarray, tree: int, depth: int, longer: int | None, threshold: float, inside: bool) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Verify the pairs of one block pair. left: True for its first block; inside: the pairs of that block itself; longer: a prefix whose
    pairs are known already. Returns each member's links, weighted by the other's copies, their bands of similarity as bits, and its
    least partner's root (an index)."""
    n, lengths = len(sets), np.array([len(x) for x in sets])
    links, bands, parent = np.zeros(n, np.int64), np.zeros(n, np.int64), np.arange(n)
    every = np.concatenate(sets)
    owner = np.repeat(np.arange(n), lengths)
    order = np.argsort(every, kind="stable")
    runs = np.flatnonzero(np.r_[True, every[order][1:] != every[order][:-1]])
    sizes = np.diff(np.r_[runs, len(every)])
    gram = np.empty(len(every), np.int64)
    gram[order] = np.repeat(np.arange(len(runs)), sizes)
    posted = owner[order]
    begin = np.cumsum(lengths) - lengths

    def root(x: int) -> int:
        while parent[x] != x:
            parent[x] = parent[parent[x]]
            x = parent[x]
        return x

    for i in np.flatnonzero(left):
        own = gram[begin[i] : begin[i] + lengths[i]]
        k = sizes[own]
        at = np.arange(k.sum()) - np.repeat(np.cumsum(k) - k, k) + np.repeat(runs[own], k)
        common = np.bincount(posted[at], minlength=n)
        union = lengths + lengths[i] - common
        good = common >= threshold * union - 1e-9
        good &= (np.arange(n) > i) if inside else ~left
        if tree:
            good &= ~shares(keys, i, depth)[:, :tree].any(1)
        if longer:
            good &= ~shares(keys, i, longer).any(1)
        found = np.flatnonzero(good)
        if len(found):
            links[i] += weights[found].sum()
            links[found] += weights[i]
            band = np.clip(((common[found] / union[found] - threshold) / (1 - threshold) * BANDS + 1e-9).astype(np.int64), 0, BANDS - 1) if threshold < 1 else np.zeros(len(found), np.int64)
            bits = np.left_shift(np.int64(1), band)
            bands[found] |= bits
            bands[i] |= np.bitwise_or.reduce(bits)
            for j in found:
                a, b = root(i), root(j)
                if a != b:
                    parent[max(a, b)] = min(a, b)
    return links, bands, np.array([root(k) for k in range(n)])


FOUND = "d1 long, d2 long, links long, bands long, r1 long, r2 long"


def _verified(members: DataFrame, forest: Forest, depth: int, longer: int | None) -> DataFrame:
    """members: rows of nodes, with sets, dealt out by block pair and sorted. Returns FOUND (r1, r2: another class reached)."""
    names = [x.split(" ")[0] for x in FOUND.split(", ")]

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        # tree, both numbers of the node, first block, second block, d1, d2, left, weight, path, grams
        held: list[tuple] = []
        out: list[tuple] = []

        def close() -> None:
            if len(held) > 1:
                left = np.array([r[7] for r in held], bool)
                inside = held[0][3] == held[0][4]
                # of two blocks one may be empty: the pairs inside the other are counted in its own
                if inside or left.any() and not left.all():
                    sets = [np.frombuffer(r[10], "<u8") for r in held]
                    keys, weights = np.array([r[9] for r in held], np.int64), np.array([r[8] for r in held], np.int64)
                    links, bands, roots = linked(left, sets, keys, weights, held[0][0], depth, longer, forest.threshold, inside)
                    out.extend((*held[k][5:7], int(links[k]), int(bands[k]), *held[int(roots[k])][5:7]) for k in np.flatnonzero(links))
            held.clear()

        def batch_of(x: list[tuple]) -> pa.RecordBatch:
            return pa.record_batch([pa.array([r[j] for r in x], pa.int64()) for j in range(len(names))], names)

        for batch in released(batches):
            for row in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if held and held[-1][:5] != row[:5]:
                    close()
                held.append(row)
            if len(out) > 20_000:
                yield batch_of(out)
                out = []
        close()
        yield batch_of(out)

    return members.mapInArrow(rows, FOUND)


def components(edges: DataFrame, scratch: Scratch) -> DataFrame:
    """edges (a, b): node, root (the least node reached). Least labels pass over edges and jump to their own labels' labels until
    none changes; every round is a checkpoint."""
    both = edges.select("a", "b").union(edges.select(F.col("b").alias("a"), F.col("a").alias("b"))).filter("a <> b").distinct()
    both = scratch.written(both, "edges")
    labels = scratch.written(both.groupBy("a").agg(F.min("b").alias("m")).select(F.col("a").alias("node"), F.least("a", "m").alias("root")), "labels")
    while True:
        near = both.join(labels.select(F.col("node").alias("b"), "root"), "b").groupBy("a").agg(F.min("root").alias("near")).withColumnRenamed("a", "node")
        jump = labels.select(F.col("node").alias("root"), F.col("root").alias("jump"))
        step = labels.join(near, "node").join(jump, "root", "left")
        new = scratch.written(step.select("node", F.least("root", "near", "jump").alias("root"), F.col("root").alias("old")), "labels")
        changed = new.filter("root <> old").limit(1).count()
        labels = new.select("node", "root")
        if not changed:
            return labels


def _trie(classes: DataFrame, forest: Forest, scratch: Scratch) -> DataFrame:
    """tree, x, y (both numbers of the path), d1, d2 of classes in nodes of the shortest prefix that have others: deeper nodes have
    members among these only."""
    every = F.array(*[F.struct(F.lit(t).alias("tree"), F.col(f"k{t}").alias("x"), F.col(f"k{t + forest.trees}").alias("y")) for t in range(forest.trees)])
    rows = _at(classes.select("d1", "d2", F.explode(every).alias("p")).select("p.*", "d1", "d2"), forest.shortest())
    return scratch.written(_with_others(rows, scratch).drop("a", "b"), "trie")


def _at(trie: DataFrame, depth: int) -> DataFrame:
    """Add a, b: the numbers of the node of that depth."""
    high, low = masks(depth)
    return trie.withColumn("a", F.col("x").bitwiseAND(F.lit(high))).withColumn("b", F.col("y").bitwiseAND(F.lit(low)))


def _with_others(rows: DataFrame, scratch: Scratch) -> DataFrame:
    # written, so that a node of very many members can be split in the join
    nodes = scratch.written(rows.groupBy("tree", "a", "b").agg(F.count("*").alias("size")).filter("size > 1").drop("size"), "nodes")
    return rows.join(nodes, ["tree", "a", "b"])


def _round(classes: DataFrame, placed: DataFrame, sets: DataFrame, forest: Forest, depth: int, longer: int | None, scratch: Scratch) -> DataFrame:
    """FOUND of the pairs that share a prefix of `depth` and none of `longer`."""
    trees, parts = forest.trees, max(int(classes.sparkSession.conf.get("spark.sql.shuffle.partitions")), 1)
    keys = [f"k{t}" for t in range(2 * trees)]
    placed = scratch.written(placed.select("tree", "a", "b", "d1", "d2").join(classes.select("d1", "d2", "copies", "n", *keys), ["d1", "d2"]), "members")

    # a node all of whose members share an earlier node, or the longer prefix, has no pair to count
    def same(tree: int, d: int) -> Column:
        return reduce(Column.__and__, [F.bit_and(c.bitwiseAND(F.lit(m))) == F.bit_or(c.bitwiseAND(F.lit(m))) for c, m in zip((F.col(f"k{tree}"), F.col(f"k{tree + trees}")), masks(d), strict=True)])

    covered = reduce(Column.__or__, [(F.lit(t) < F.col("tree")) & same(t, depth) for t in range(trees)] + [same(t, longer) for t in range(trees) if longer])
    blocks = F.greatest(F.ceil(F.sum("n") / forest.block_grams), F.ceil(F.count("*") / forest.block_members)).cast("int")
    useful = scratch.written(placed.groupBy("tree", "a", "b").agg(covered.alias("covered"), blocks.alias("blocks")).filter("not covered").drop("covered"), "useful")
    members = placed.join(useful, ["tree", "a", "b"])
    block = F.pmod(F.xxhash64("d1", "d2"), F.col("blocks")).cast("int")
    pair = F.transform(F.sequence(F.lit(0), F.col("blocks") - 1), lambda j: F.struct(F.least(F.col("block"), j).alias("i"), F.greatest(F.col("block"), j).alias("j")))
    dealt = members.withColumn("block", block).withColumn("pair", F.explode(pair)).join(sets, ["d1", "d2"])
    dealt = dealt.select("tree", "a", "b", F.col("pair.i").alias("i"), F.col("pair.j").alias("j"), "d1", "d2", (F.col("block") == F.col("pair.i")).cast("int").alias("left"), F.col("copies").alias("weight"), F.array(*keys).alias("path"), "grams")
    dealt = dealt.repartition(parts, "tree", "a", "b", "i", "j").sortWithinPartitions("tree", "a", "b", "i", "j", "path", "d1", "d2")
    return scratch.written(_verified(dealt, forest, depth, longer), "links")


def _sets_of(docs: DataFrame, wanted: DataFrame, forest: Forest) -> DataFrame:
    """d1, d2, grams of the wanted classes: one text of each is read again."""
    texts = with_unique_names(docs, "doc_id", "text").select(F.col("doc_id").cast("long"), F.col("text").cast("string"))
    # always by shuffle: the list of texts to read again grows with the corpus
    again = texts.join(wanted.select("rep").distinct().hint("merge"), F.col("doc_id").eqNullSafe(F.col("rep")), "left_semi")

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hashes = WordHashes()
        for batch in released(batches):
            sets = [grams(x, forest.words, hashes) for x in as_bytes(batch.column(1))]
            marks = [digest(x) for x in sets]
            yield pa.record_batch([pa.array([m[0] for m in marks], pa.int64()), pa.array([m[1] for m in marks], pa.int64()), pa.array([x.tobytes() for x in sets], pa.binary())], ["d1", "d2", "grams"])

    # rows with one doc_id and equal texts would come twice
    return again.mapInArrow(rows, "d1 long, d2 long, grams binary").dropDuplicates(["d1", "d2"])


def links_of(docs: DataFrame, classes: DataFrame, forest: Forest, scratch: Scratch) -> tuple[DataFrame, int]:
    """FOUND of all links between classes, and the depth at which the prefixes had the target recall."""
    trie = _trie(classes, forest, scratch)
    wanted = trie.select("d1", "d2").distinct().join(classes.select("d1", "d2", "rep"), ["d1", "d2"])
    sets = scratch.written(_sets_of(docs, wanted, forest), "sets")
    depth, longer, found = forest.depth, None, None
    while True:
        placed = _at(trie, depth)
        placed = placed if depth == forest.shortest() else _with_others(placed, scratch)
        new = _round(classes, placed, sets, forest, depth, longer, scratch)
        found = new if found is None else found.unionByName(new)
        if depth == forest.shortest():
            return found, depth
        bands = found.groupBy("d1", "d2").agg(F.bit_or("bands").alias("bands")).agg(*[F.coalesce(F.sum(F.getbit("bands", F.lit(k)).cast("long")), F.lit(0)).alias(f"b{k}") for k in range(BANDS)]).head()
        depth, longer = forest.next_depth(list(bands), depth), depth
        if depth == longer:
            return found, depth


def joined(docs: DataFrame, forest: Forest = Forest()) -> DataFrame:
    """doc_id, class_id, n_links of every document."""
    spark = docs.sparkSession
    prepare(spark)
    keys = [f"k{t}" for t in range(2 * forest.trees)]
    tasks = tasks_for(docs)
    rows = written(signed_rows(docs, forest), "signed", tasks)
    with Scratch(spark, tasks) as scratch:
        own = rows.filter("d1 is not null").groupBy("d1", "d2").agg(F.min("doc_id").alias("rep"), F.count("*").alias("copies"), F.max("n").alias("n"), *(F.max(k).alias(k) for k in keys))
        classes = scratch.written(own, "classes")
        found, _ = links_of(docs, classes, forest, scratch)
        name = lambda a, b: F.concat(F.hex(a), F.lit("-"), F.hex(b))
        roots = components(found.select(name("d1", "d2").alias("a"), name("r1", "r2").alias("b")), scratch)
        links = found.groupBy("d1", "d2").agg(F.sum("links").alias("links"))
        table = classes.select("d1", "d2", "rep", "copies").join(links, ["d1", "d2"], "left")
        table = table.withColumn("node", name("d1", "d2")).join(roots, "node", "left").withColumn("root", F.coalesce("root", "node"))
        table = scratch.written(table.select("d1", "d2", "rep", "root", (F.coalesce("links", F.lit(0)) + F.col("copies") - 1).alias("n_links")), "rooted")
        least = scratch.written(table.groupBy("root").agg(F.min("rep").alias("class_id")), "least")
        table = written(table.join(least, "root").select("d1", "d2", "class_id", "n_links"), "classes", tasks)
    hit = rows.select("doc_id", "d1", "d2").join(table, ["d1", "d2"], "left")
    return hit.select("doc_id", F.when(F.col("d1").isNull(), F.col("doc_id")).otherwise(F.col("class_id")).alias("class_id"), F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"))


def deduplicated(docs: DataFrame, forest: Forest = Forest()) -> DataFrame:
    """One row of each class stays, that of the least doc_id (nulls last). Every row has its own verdict, by a key written with the
    rows: those with a null or repeated doc_id are judged by their texts like others. Rows without words are no copies and stay, but
    of equal ones with one doc_id (not null) one."""
    rows, key = with_row_key(docs, "rows")
    found = joined(rows.select(F.col(key).alias("doc_id"), "text"), forest).select(F.col("doc_id").alias(key), "class_id")
    first = F.min(F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", F.col(key).alias("row"))).alias("first")
    best = written(found.join(rows.select(key, "doc_id").hint("merge"), key).groupBy("class_id").agg(first).select(F.col("first.row").alias(key)), "best", tasks_for(rows))
    # only keys are compared: the texts move once, and those without words for their groups
    bare = rows.filter("doc_id is not null").filter(~F.coalesce("text", F.lit("")).rlike(r"[0-9A-Za-z]|[^\x00-\x7F]")).select(key, "doc_id", "text")
    once = bare.groupBy("doc_id", "text").agg(F.min(key).alias(key)).select(key)
    again = bare.select(key).join(once, key, "left_anti")
    kept = written(best.join(again, key, "left_anti"), "kept", tasks_for(rows))
    # always by shuffle: the list of rows to keep grows with the corpus
    return rows.join(kept.hint("merge"), key, "left_semi").select(*docs.columns)
