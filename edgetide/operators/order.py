"""Total order, row numbers, prefix sums and exact percentiles without a single-partition window."""

from __future__ import annotations

import math
from bisect import bisect_left
from itertools import accumulate

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

EDGE_ORDER = ("time", "src", "dst")


def range_of(df: DataFrame, order: tuple[str, ...], ranges: int) -> Column:
    """The number, below `ranges`, of a row's range in the order, by halving over bounds that a sample of 40 rows a range gives. It
    follows from the row's own values, so every pass over the rows deals them alike, whatever columns it reads."""
    key = F.struct(*order)
    sample = df.select(key.alias("k")).orderBy(F.rand(7)).limit(40 * ranges).agg(F.array_sort(F.collect_set("k"))).head()[0]
    bounds = [sample[len(sample) * i // ranges] for i in range(1, ranges)] if len(sample) >= ranges else sample[1:]
    if not bounds:
        return F.lit(0)
    kinds = dict(df.select(*order).dtypes)
    table = F.array(*[F.struct(*[F.lit(x).cast(kinds[c]).alias(c) for c, x in zip(order, b)]) for b in bounds])
    steps = F.array(*[F.lit(1 << k) for k in reversed(range(len(bounds).bit_length()))])
    return F.aggregate(steps, F.lit(0), lambda at, step: F.when(F.coalesce(F.get(table, at + step - 1) <= key, F.lit(False)), at + step).otherwise(at))


def with_prefix(df: DataFrame, order: tuple[str, ...], value: Column, name: str, ranges: int | None = None) -> DataFrame:
    """Add the running sum of `value` over the total order, this row included. df must give the same rows whenever it runs.

    Ranges of the order are summed apart, after one exchange, and each adds the total of the ranges before it, a constant: only a row for
    each range comes to the driver, and no window runs over all rows."""
    ranges = ranges or min(max(int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")), 1), 1000)
    rows = df.withColumn("_v", value.cast("long")).withColumn("_p", range_of(df, order, ranges))
    totals = dict(map(tuple, rows.groupBy("_p").agg(F.sum("_v")).collect()))
    before = [0, *accumulate(totals.get(k) or 0 for k in range(max(totals, default=0)))]
    within = Window.partitionBy("_p").orderBy(*order).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    base = F.get(F.array(*[F.lit(x).cast("long") for x in before]), F.col("_p"))
    return rows.withColumn(name, F.sum("_v").over(within) + base).drop("_p", "_v")


def with_seq(edges: DataFrame, order: tuple[str, ...] = EDGE_ORDER, name: str = "seq") -> DataFrame:
    """Number rows from 1 in the total order."""
    return with_prefix(edges, order, F.lit(1), name)


def exact_percentiles(df: DataFrame, column: str, shares: list[float], few: int = 50_000, weight: str | None = None) -> list[float]:
    """Linear-interpolated percentiles, exact. Values are counted; up to `few` distinct ones are added up on the driver, more in ranges on
    the cluster, from which only the values at the wanted ranks come back. weight: a column of how often each row counts."""
    counts = df.groupBy(F.col(column).alias("x")).agg((F.sum(weight) if weight else F.count("*")).alias("n")).filter("x is not null").persist()
    held = counts.limit(few + 1).collect()
    total = sum(r.n for r in held) if len(held) <= few else counts.agg(F.sum("n")).head()[0]
    if not total:
        counts.unpersist()
        return [float("nan")] * len(shares)
    at = _at_ranks(counts, held, few, sorted({k for s in shares for k in _ranks(s, total)}))
    counts.unpersist()
    return [_between(at, s, total) for s in shares]


def _ranks(share: float, total: int) -> tuple[int, int]:
    """The ranks, from 1, between which a percentile lies."""
    return math.floor(share * (total - 1)) + 1, math.ceil(share * (total - 1)) + 1


def _at_ranks(counts: DataFrame, held: list, few: int, wanted: list[int]) -> dict[int, float]:
    """The values (x, n) at the wanted ranks; held: all of them, or more than `few`."""
    if len(held) <= few:
        held.sort(key=lambda r: r.x)
        ends = list(accumulate(r.n for r in held))
        return {k: float(held[bisect_left(ends, k)].x) for k in wanted}
    upto = with_prefix(counts, ("x",), F.col("n"), "upto")
    hit = F.exists(F.array(*map(F.lit, wanted)), lambda k: (k <= F.col("upto")) & (k > F.col("upto") - F.col("n")))
    found = upto.filter(hit).select("x", "n", "upto").collect()
    return {k: float(r.x) for r in found for k in wanted if r.upto - r.n < k <= r.upto}


def _between(at: dict[int, float], share: float, total: int) -> float:
    place, (low, high) = share * (total - 1), (at[k] for k in _ranks(share, total))
    return low + (high - low) * (place - math.floor(place))


def percentile_held(df: DataFrame, column: str, share: float, few: int = 50_000, margin: float = 0.03) -> float:
    """exact_percentiles of one share, of rows that are held: a sample only says between which values to look. Values below are counted where
    they lie, so that few rows are shuffled; if the percentile isn't there, all are."""
    rows = df.select(F.col(column).alias("x")).filter("x is not null")
    sample = rows.orderBy(F.rand(7)).limit(4000).agg(F.array_sort(F.collect_list("x"))).head()[0]
    if not sample:
        return float("nan")
    low, high = (sample[k] if 0 <= k < len(sample) else None for k in (math.floor(len(sample) * (share - margin)), math.ceil(len(sample) * (share + margin))))
    under = F.lit(False) if low is None else F.col("x") < F.lit(low)
    over = F.lit(False) if high is None else F.col("x") > F.lit(high)
    total, below, above = rows.agg(F.count("*"), F.count_if(under), F.count_if(over)).head()
    first, last = _ranks(share, total)
    near, before = (rows.filter(~under & ~over), below) if below < first and last <= total - above else (rows, 0)
    counts = near.groupBy("x").agg(F.count("*").alias("n")).persist()
    at = _at_ranks(counts, counts.limit(few + 1).collect(), few, sorted({first - before, last - before}))
    counts.unpersist()
    return _between({k + before: x for k, x in at.items()}, share, total)


def split_ratio(edges: DataFrame, share: float = 0.8) -> tuple[DataFrame, DataFrame]:
    """The first share of the rows by time, then the rest; both have one row at least if there are two."""
    rows = edges if "seq" in edges.columns else with_seq(edges)
    n = rows.count()
    cut = min(max(int(n * share), 1), max(n - 1, 1))
    return rows.filter(F.col("seq") <= cut), rows.filter(F.col("seq") > cut)


def split_dealt(rows: DataFrame, share: float = 0.8) -> tuple[DataFrame, DataFrame]:
    """The parts of split_ratio of rows (src, dst, time) that are held, dealt by source: the first part where its rows lie, without numbers, and
    the rest with seq. Only rows from a sampled place shortly before the cut on are ordered; those before it are counted."""
    key, n = F.struct(*EDGE_ORDER), rows.count()
    cut = min(max(int(n * share), 1), max(n - 1, 1))
    kinds = dict(rows.dtypes)
    whole = lambda r: F.struct(*[F.lit(r[c]).cast(kinds[c]).alias(c) for c in EDGE_ORDER])
    sample = rows.select(key.alias("k")).orderBy(F.rand(7)).limit(4000).agg(F.array_sort(F.collect_list("k"))).head()[0]
    late, before = rows, 0
    if (place := int(len(sample) * (share - 0.03))) > 0:
        low = whole(sample[place])
        found = rows.filter(key < low).count()
        if found < cut:
            late, before = rows.filter(key >= low), found
    late = with_seq(late).withColumn("seq", F.col("seq") + before).persist()
    last = late.filter(F.col("seq") == cut).head()
    if last is None:
        return rows, late
    at = whole(last)
    same, own = late.filter(key == at).agg(F.count("*"), F.count_if(F.col("seq") <= cut)).head()
    first = rows.filter(key <= at)
    if own < same:  # the cut falls among equal rows
        first = first.withColumn("_n", F.row_number().over(Window.partitionBy(*EDGE_ORDER).orderBy("src"))).filter((key < at) | (F.col("_n") <= own)).drop("_n")
    return first, late.filter(F.col("seq") > cut)


def split_official(edges: DataFrame, share: float = 0.85) -> tuple[DataFrame, DataFrame]:
    """By the split column, where both sides have rows; else the rows after the first share by time validate (the sequence models take 0.8)."""
    train, valid = edges.filter("split = '0'"), edges.filter("split is null or split <> '0'")
    if train.isEmpty() or valid.isEmpty():
        return split_ratio(edges, share)
    return train, valid


def sample_evenly(rows: DataFrame, n: int, m: int, seq: str = "seq") -> DataFrame:
    """m of n rows at even distances: row floor(j * (n - 1) / (m - 1)), from 0. A row is kept if some j falls on it."""
    if m >= n:
        return rows
    if m == 1:
        return rows.filter(F.col(seq) == 1)
    i = f"({seq} - 1)"
    j = f"(({i} * {m - 1} + {n - 2}) div {n - 1})"
    return rows.filter(F.expr(f"{j} < {m} AND ({j} * {n - 1}) div {m - 1} = {i}"))


def sample_hashed(rows: DataFrame, m: int, seed: int, key: str = "seq") -> DataFrame:
    """A seeded random sample of m rows, the same on every run."""
    return rows.orderBy(F.xxhash64(F.lit(seed), F.col(key)), key).limit(m)
