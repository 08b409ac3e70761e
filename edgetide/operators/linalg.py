"""Vectors of sources and destinations: weighted pair matrix, truncated decomposition, profiles, audiences, cosines."""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions import scalars as S
from . import sequences as seqs
from .order import with_prefix

#: So many destinations go to every task; more are joined by shuffle.
HELD = 1_500_000


def weighted_pairs(edges: DataFrame, weight: float = 2.8) -> DataFrame:
    """src, dst, w: log1p of the sum over a pair's edges of 1 + weight * position in time."""
    low, high = edges.agg(F.min("time"), F.max("time")).head()
    t = (F.col("time") - low) / F.lit(max(float((high or 0) - (low or 0)), 1.0))
    return edges.groupBy("src", "dst").agg(F.log1p(F.sum(1.0 + weight * t)).alias("w"))


def mean_vector(rows: DataFrame, key: str) -> DataFrame:
    """key, vec: the mean of its vectors, by position, so that partial sums are combined before the shuffle."""
    long = rows.select(key, F.posexplode("vec").alias("i", "x")).groupBy(key, "i").agg(F.avg("x").alias("x"))
    packed = long.groupBy(key).agg(F.array_sort(F.collect_list(F.struct("i", "x"))).alias("v"))
    return packed.select(key, F.transform("v", lambda x: x["x"]).alias("vec"))


def source_profile(edges: DataFrame, dst_vec: DataFrame, recent: int = 160) -> DataFrame:
    """src, vec: the sum of its last destinations' vectors over sqrt(rank), at unit length."""
    h = seqs.last_k(edges, recent).select("src", "dst", "rank").join(dst_vec.select("dst", "vec"), "dst")
    long = h.select("src", "rank", F.posexplode("vec").alias("i", "x")).groupBy("src", "i").agg(F.sum(F.col("x") / F.sqrt("rank")).alias("x"))
    packed = long.groupBy("src").agg(F.array_sort(F.collect_list(F.struct("i", "x"))).alias("v"))
    return packed.select("src", S.unit(F.transform("v", lambda x: x["x"])).alias("vec"))


def audience(edges: DataFrame, src_vec: DataFrame, k: int = 64) -> DataFrame:
    """dst, av, log_n: the unit mean vector of its last k sources that have one, and log1p of their number."""
    rows = seqs.last_k(edges, k, "dst", "src").join(src_vec.select("src", "vec"), "src")
    n = rows.groupBy("dst").agg(F.log1p(F.count("*").cast("double")).alias("log_n"))
    return mean_vector(rows.select("dst", "vec"), "dst").select("dst", S.unit(F.col("vec")).alias("av")).join(n, "dst")


def cosine_top_k(queries: DataFrame, items: DataFrame, k: int, block_rows: int = 4096) -> DataFrame:
    """qid, dst, cos, rank: the k nearest items of each query (id, vec), exactly. Queries and items are dealt in blocks of about `block_rows`;
    each pair of blocks keeps its k best for each query, and only those are merged."""
    nq, ni = max(-(-queries.count() // block_rows), 1), max(-(-items.count() // block_rows), 1)
    q = queries.select("qid", S.unit(F.col("vec")).alias("v")).withColumn("b", F.pmod(F.xxhash64("qid"), F.lit(nq)).cast("int")).withColumn("c", F.explode(F.sequence(F.lit(0), F.lit(ni - 1))))
    i = items.select("dst", S.unit(F.col("vec")).alias("v")).withColumn("c", F.pmod(F.xxhash64("dst"), F.lit(ni)).cast("int")).withColumn("b", F.explode(F.sequence(F.lit(0), F.lit(nq - 1))))

    def best(left, right):
        import pandas as pd

        if not len(left) or not len(right):
            return pd.DataFrame({"qid": pd.Series(dtype="int64"), "dst": pd.Series(dtype="int64"), "cos": pd.Series(dtype="float64")})
        vectors, ids, parts = np.stack(right.v), right.dst.to_numpy(), []
        for at in range(0, len(left), 512):  # so many rows of cosines at once
            cos = np.round(np.stack(left.v[at : at + 512]) @ vectors.T, 9)
            for qid, row in zip(left.qid.to_numpy()[at : at + 512], cos, strict=True):
                # all that reach the k-th value, then by id
                some = np.flatnonzero(row >= np.partition(row, len(row) - k)[len(row) - k]) if k < len(row) else np.arange(len(row))
                order = some[np.lexsort((ids[some], -row[some]))[:k]]
                parts.append((np.full(len(order), qid), ids[order], row[order]))
        return pd.DataFrame({name: np.concatenate([x[j] for x in parts]) for j, name in enumerate(("qid", "dst", "cos"))})

    near = q.groupBy("b", "c").cogroup(i.groupBy("b", "c")).applyInPandas(best, "qid long, dst long, cos double")
    rank = F.row_number().over(Window.partitionBy("qid").orderBy(F.desc("cos"), "dst"))
    return near.withColumn("rank", rank).filter(F.col("rank") <= k)


def truncated_svd(pairs: DataFrame, dim: int, rounds: int = 7, extra: int = 8, seed: int = 42) -> tuple[DataFrame, DataFrame]:
    """(src, vec) and (dst, vec): U * S and V of the dim largest singular values, rows at unit length, by randomised subspace rounds.

    The sparse matrix never leaves the cluster: a round multiplies it and its transpose by a narrow block in one pass over its rows. The block itself (destinations times dim + extra) is on the driver and goes to every task, so its size is checked."""
    import pandas as pd

    spark = pairs.sparkSession
    src = with_prefix(pairs.select("src").distinct(), ("src",), F.lit(1), "i").withColumn("i", F.col("i") - 1).cache()
    dst = with_prefix(pairs.select("dst").distinct(), ("dst",), F.lit(1), "j").withColumn("j", F.col("j") - 1).cache()
    m, n = src.count(), dst.count()
    dim = min(dim, min(m, n) - 1)
    if dim < 1:
        return src.select("src", F.array(F.lit(0.0)).alias("vec")), dst.select("dst", F.array(F.lit(0.0)).alias("vec"))
    width = min(dim + extra, min(m, n))
    if max(m, n) * width > 200_000_000:
        raise ValueError("the blocks would not fit on the driver; decompose a smaller vocabulary or fewer dimensions")
    small = F.broadcast if n <= HELD else lambda x: x
    entries = pairs.join(small(dst), "dst").groupBy("src").agg(F.collect_list(F.struct("j", "w")).alias("l"))
    # a source's entries are one row: its product is whole in one task, and only sums over destinations come to the driver
    entries = entries.select("src", F.transform("l", lambda x: x["j"]).alias("j"), F.transform("l", lambda x: x["w"]).alias("w")).persist()
    tasks = entries.coalesce(min(spark.sparkContext.defaultParallelism, 16))

    def products(batch, block):
        """Of a batch's sources the lengths, destinations and weights of their entries, and their rows of A times the block."""
        sizes = np.diff(batch.column("j").offsets.to_numpy())
        j, w = (batch.column(c).flatten().to_numpy(zero_copy_only=False) for c in ("j", "w"))
        return sizes, j, w, np.add.reduceat(block[j] * w[:, None], np.concatenate(([0], np.cumsum(sizes)[:-1])))

    def times(block: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """A'A times the block, and the products of the columns of A times the block with each other."""
        sent = spark.sparkContext.broadcast(block)

        def partial(batches):
            import pyarrow as pa

            out, gram = np.zeros(block_shape), np.zeros((block_shape[1], block_shape[1]))
            for batch in batches:
                if not batch.num_rows:
                    continue
                sizes, j, w, y = products(batch, sent.value)
                gram += y.T @ y
                each = np.repeat(np.arange(len(sizes)), sizes)
                for c in range(block_shape[1]):
                    out[:, c] += np.bincount(j, w * y[each, c], block_shape[0])
            yield pa.RecordBatch.from_pydict({"z": [out.tobytes()], "g": [gram.tobytes()]})

        block_shape = block.shape
        total, gram = np.zeros(block.shape), np.zeros((block.shape[1], block.shape[1]))
        for row in tasks.mapInArrow(partial, "z binary, g binary").toLocalIterator():
            total += np.frombuffer(row.z).reshape(total.shape)
            gram += np.frombuffer(row.g).reshape(gram.shape)
        sent.destroy()
        return total, gram

    def inverse_root(gram: np.ndarray) -> np.ndarray:
        """What turns columns with these products into orthonormal ones; directions that they lack become 0."""
        value, vector = np.linalg.eigh(gram)
        keep = value > 1e-13 * max(value[-1], 1e-300)
        return vector * np.where(keep, 1.0 / np.sqrt(np.where(keep, value, 1.0)), 0.0)

    x = np.random.default_rng(seed).standard_normal((n, width))
    for _ in range(rounds):
        x = np.linalg.qr(times(x)[0])[0]
    z, gram = times(x)
    root = inverse_root(gram)
    u, s, vt = np.linalg.svd((z @ root).T, full_matrices=False)  # width x n
    turn, right = x @ (root @ u[:, :dim]) * s[:dim], vt[:dim].T
    norm = lambda x: x / np.maximum(np.linalg.norm(x, axis=1, keepdims=True), 1e-12)
    held = spark.sparkContext.broadcast(turn)

    def left(batches):
        import pyarrow as pa

        for batch in batches:
            if batch.num_rows:
                yield pa.RecordBatch.from_pydict({"src": batch.column("src"), "vec": norm(products(batch, held.value)[3]).tolist()}, schema=pa.schema([("src", pa.int64()), ("vec", pa.list_(pa.float64()))]))

    frame = lambda x, key: spark.createDataFrame(pd.DataFrame({key: range(len(x)), "vec": norm(x).tolist()}), f"{key} long, vec array<double>")
    return entries.mapInArrow(left, "src long, vec array<double>"), dst.join(frame(right, "j"), "j").select("dst", "vec")
