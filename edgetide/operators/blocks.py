"""Transitions and two-hop scores by blocks of destinations. A source's sequence, as one array, goes to the blocks that it touches; pairs of
events, and candidates with what came before them, are made inside a block and never shuffled. The results are those of `window_pairs`,
`normalised` and `two_hop`."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import sequences as seqs

#: Two-hop scores take so many blocks at least, and one for so many shuffle partitions; so many pairs are looked up at once.
WIDE, PER, AT_ONCE = 12, 8, 1_000_000


def bounds(edges: DataFrame, blocks: int) -> list[int]:
    """Where blocks of destinations begin, of about as many edges each, by a sample of 40 edges a block."""
    sample = edges.filter("dst is not null").select("dst").orderBy(F.rand(7)).limit(40 * blocks).agg(F.array_sort(F.collect_list("dst"))).head()[0]
    return sorted({sample[len(sample) * i // blocks] for i in range(1, blocks)}) if sample else []


def block_of(x: Column, starts: list[int]) -> Column:
    """The number of a destination's block, by halving; 0 for null."""
    if not starts:
        return F.lit(0)
    table = F.array(*[F.lit(b).cast("long") for b in starts])
    steps = F.array(*[F.lit(1 << k) for k in reversed(range(len(starts).bit_length()))])
    return F.aggregate(steps, F.lit(0), lambda at, step: F.when(F.coalesce(F.get(table, at + step - 1) <= x, F.lit(False)), at + step).otherwise(at))


def touched(values: Column, starts: list[int]) -> Column:
    return F.explode(F.array_distinct(F.transform(values, lambda x: block_of(x, starts))))


def source_sequences(edges: DataFrame) -> DataFrame:
    """src and hist: all its destinations, the newest last."""
    return edges.groupBy("src").agg(F.array_sort(F.collect_list(F.struct("time", "dst"))).alias("l")).select("src", F.transform("l", lambda x: x["dst"]).alias("hist"))


def block_transitions(sequences: DataFrame, counts: DataFrame, starts: list[int], width: int, k: int) -> DataFrame:
    """b, prev, next, w: `normalised` of `window_pairs` weighted by "root", in the block of prev. counts: dst, n."""
    sent = sequences.select("hist", touched(F.col("hist"), starts).alias("b")).repartitionById(len(starts) + 1, "b")
    rows = sent.select("b", "hist", F.posexplode("hist").alias("i", "prev"))
    if starts:
        ends = F.array(F.lit(None).cast("long"), *[F.lit(x).cast("long") for x in starts], F.lit(None).cast("long"))
        low, high = F.get(ends, F.col("b")), F.get(ends, F.col("b") + 1)
        rows = rows.filter((low.isNull() | (F.col("prev") >= low)) & (high.isNull() | (F.col("prev") < high)))
    pairs = rows.select("b", "prev", F.posexplode(F.slice("hist", F.col("i") + 2, F.lit(width))).alias("at", "next")).filter("prev <> next")
    pairs = pairs.groupBy("b", "prev", "next").agg(F.sum(1.0 / F.sqrt((F.col("at") + 1).cast("double"))).alias("w"))
    return seqs.normalised(pairs, F.broadcast(counts), k, ("b", "prev"))


def block_hops(sequences: DataFrame, candidates: DataFrame, trans: DataFrame, starts: list[int], k: int) -> DataFrame:
    """src, h_dst, h_hop: of each source the candidates that a transition leads to from its last k destinations, and their `two_hop` score with
    power 0.5. Blocks are joined to wider ones, to which a source sends its candidates."""
    blocks = len(starts) + 1
    wide = min(blocks, max(WIDE, blocks // PER))
    of = lambda b: F.floor(b * wide / blocks).cast("int")
    t = trans.groupBy("b", "prev").agg(F.array_sort(F.collect_list(F.struct("next", "w"))).alias("l"))
    none = F.lit(None)
    t = t.select(of(F.col("b")).alias("c"), F.lit(0).alias("kind"), F.col("prev").alias("id"), F.transform("l", lambda x: x["next"]).alias("x"), F.transform("l", lambda x: x["w"]).alias("w"), none.cast("array<bigint>").alias("y"))
    own = candidates.groupBy("src").agg(F.collect_set("dst").alias("x"))
    last = sequences.select("src", F.slice(F.reverse("hist"), 1, k).alias("y"))
    s = own.join(last.hint("shuffle_hash"), "src")
    s = s.select("src", "x", "y", F.explode(F.array_distinct(F.transform("y", lambda x: of(block_of(x, starts))))).alias("c"))
    s = s.select("c", F.lit(1).alias("kind"), F.col("src").alias("id"), "x", none.cast("array<double>").alias("w"), "y")
    both = t.unionByName(s).repartitionById(wide, "c").sortWithinPartitions("c", "kind")
    found = both.mapInArrow(looked_up, "src long, d array<bigint>, h array<double>")
    # a candidate may be met in several blocks
    each = seqs.dealt(found).select("src", F.explode(F.arrays_zip("d", "h")).alias("e")).groupBy("src", F.col("e.d").alias("d")).agg(F.sum("e.h").alias("h"))
    held = each.groupBy("src").agg(F.collect_list(F.struct("d", "h")).alias("l"))
    return held.select("src", F.transform("l", lambda x: x["d"]).alias("h_dst"), F.transform("l", lambda x: x["h"]).alias("h_hop"))


def _lists(column) -> tuple[np.ndarray, np.ndarray]:
    """Lengths and values of an array column without null lists; null values are the least number."""
    sizes = np.diff(column.offsets.to_numpy())
    values = column.flatten()
    return sizes, values.fill_null(np.iinfo("int64").min).to_numpy(zero_copy_only=False) if values.null_count else values.to_numpy(zero_copy_only=False)


def _found(table: np.ndarray, values: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Places in a sorted table, and whether they hold the values."""
    if not len(table):
        return np.zeros(len(values), "int64"), np.zeros(len(values), bool)
    at = np.minimum(np.searchsorted(table, values), len(table) - 1)
    return at, table[at] == values


def _starts(sizes: np.ndarray) -> np.ndarray:
    return np.concatenate(([0], np.cumsum(sizes)))


def looked_up(batches) -> Iterator:
    """Rows of a block: first the transitions of each destination, then sources with candidates (x) and last destinations (y, the newest first)."""
    import pyarrow as pa

    block, parts, table = None, [], None
    for batch in batches:
        c, kind = (batch.column(i).to_numpy() for i in (0, 1))
        edges = np.flatnonzero(np.diff(c) | np.diff(kind)) + 1
        for low, high in zip([0, *edges.tolist()], [*edges.tolist(), len(c)], strict=True):
            if low == high:
                continue
            if c[low] != block:
                block, parts, table = c[low], [], None
            rows = batch.slice(low, high - low)
            ids = rows.column(2).to_numpy()
            if kind[low] == 0:
                sizes, x = _lists(rows.column(3))
                parts.append((np.repeat(ids, sizes), x, rows.column(4).flatten().to_numpy()))
                continue
            if table is None:
                if not parts:
                    continue
                prev, x, w = (np.concatenate([p[i] for p in parts]) for i in range(3))
                prevs, nexts = np.unique(prev), np.unique(x)
                keys = np.searchsorted(prevs, prev) * len(nexts) + np.searchsorted(nexts, x)
                order = np.argsort(keys)
                table, parts = (prevs, nexts, keys[order], w[order]), []
            yield from _hops(pa, table, ids, _lists(rows.column(3)), _lists(rows.column(5)))


def _hops(pa, table, ids, candidates, last) -> Iterator:
    prevs, nexts, keys, w = table
    source = np.repeat(np.arange(len(ids)), candidates[0])
    at, known = _found(nexts, candidates[1])
    cs, ci, cd = source[known], at[known], candidates[1][known]
    source = np.repeat(np.arange(len(ids)), last[0])
    rank = np.arange(len(source)) - _starts(last[0])[source] + 1
    at, known = _found(prevs, last[1])
    ps, pi, pw = source[known], at[known], 1.0 / np.sqrt(rank[known])
    n_p = np.bincount(ps, minlength=len(ids))
    p_at, total = _starts(n_p), _starts(n_p[cs])
    low = 0
    while low < len(cs):
        high = max(int(np.searchsorted(total, total[low] + AT_ONCE, "right")) - 1, low + 1)
        n = n_p[cs[low:high]]
        of = np.repeat(np.arange(high - low), n)
        p = p_at[cs[low:high]][of] + np.arange(len(of)) - _starts(n)[of]
        at, hit = _found(keys, pi[p] * len(nexts) + ci[low:high][of])
        hop = np.bincount(of[hit], w[at[hit]] * pw[p[hit]], minlength=high - low)
        some = np.flatnonzero(np.bincount(of[hit], minlength=high - low))
        if len(some):
            src, first = np.unique(cs[low:high][some], return_index=True)
            offsets = pa.array([*first.tolist(), len(some)], pa.int32())
            lists = [pa.ListArray.from_arrays(offsets, pa.array(v[some])) for v in (cd[low:high], hop)]
            yield pa.RecordBatch.from_arrays([pa.array(ids[src]), *lists], names=["src", "d", "h"])
        low = high
