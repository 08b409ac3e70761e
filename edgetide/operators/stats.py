"""Keyed statistics of a history, and the scalars that scale them."""

from __future__ import annotations

from dataclasses import dataclass
from functools import cached_property

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .order import exact_percentiles


@dataclass(frozen=True)
class Scales:
    """One row of a history: range of time, percentile cuts and largest counts."""

    rows: int
    low: int
    high: int
    p60: float
    p80: float
    p82: float
    max_dst: int
    max_src: int
    max_pair: int
    max_recent80: int
    max_recent82: int
    dsts: int = 0

    @property
    def span(self) -> float:
        return max(float(self.high - self.low), 1.0)


def spans(history: DataFrame) -> tuple:
    """Rows, least and greatest time, and the percentile cuts."""
    return (*history.agg(F.count("*"), F.min("time"), F.max("time")).head(), *exact_percentiles(history, "time", [0.60, 0.80, 0.82]))


def scales(history: DataFrame, spanned: tuple | None = None, counted: DataFrame | None = None) -> Scales:
    """spanned and counted: spans and dst_stats of the history, where they are at hand."""
    n, low, high, p60, p80, p82 = spanned or spans(history)
    if counted is None:
        counted = history.groupBy("dst").agg(F.count("*").alias("n"), F.count_if(F.col("time") >= p80).alias("recent80"), F.count_if(F.col("time") >= p82).alias("recent82"))
    most = counted.agg(F.max("n"), F.max("recent80"), F.max("recent82"), F.count("*")).head()
    src = history.groupBy("src").count().agg(F.max("count")).head()[0]
    pair = history.groupBy("src", "dst").count().agg(F.max("count")).head()[0]
    return Scales(n, low or 0, high or 0, p60, p80, p82, most[0] or 1, src or 1, pair or 1, most[1] or 1, most[2] or 1, most[3])


def log_scale(n: int) -> float:
    import math

    return max(math.log1p(float(n)), 1.0)


@dataclass(frozen=True)
class History:
    """Frozen state of edges (src, dst, time[, seq]). dealt: the edges are held, dealt by source; what is asked of sources or pairs then needs
    no shuffle, and the statistics of destinations are made once and held."""

    edges: DataFrame
    dealt: bool = False

    @cached_property
    def spans(self) -> tuple:
        return spans(self.edges)

    @cached_property
    def scales(self) -> Scales:
        return scales(self.edges, self.spans, self.dst_stats() if self.dealt else None)

    @cached_property
    def starts(self) -> tuple[float, float, float]:
        """Where the last fifth, tenth and twentieth of the time span begin."""
        low, high = (x or 0 for x in self.spans[1:3])
        span = max(high - low, 1)
        return high - span // 5, high - span // 10, high - span // 20

    def dst_stats(self) -> DataFrame:
        """Counts of each destination, all and by period, its sources and last time."""
        return self.held_dsts if self.dealt else self._dst_stats()

    @cached_property
    def held_dsts(self) -> DataFrame:
        return self._dst_stats().persist()

    def _dst_stats(self) -> DataFrame:
        (p60, p80, p82), (r20, r10, r05), t = self.spans[3:], self.starts, F.col("time")
        periods = {
            "recent80": t >= p80, "older80": (t >= p60) & (t < p80), "recent82": t >= p82, "mid82": (t >= p60) & (t < p82), "older82": t < p60,
            "recent20": t >= r20, "recent10": t >= r10, "recent05": t >= r05,
        }
        if self.dealt:  # edges go to their destination with a mark at the newest of each pair: narrower rows than sums by pair
            newest = F.row_number().over(Window.partitionBy("src", "dst").orderBy(F.desc("time"))) == 1
            rows = packed_times(self.edges.select("dst", "time", newest.alias("newest")), *(x or 0 for x in self.spans[1:3]))
            return rows.groupBy("dst").agg(F.count("*").alias("n"), *[F.count_if(c).alias(k) for k, c in periods.items()], F.count_if("newest").alias("sources"), F.count_if(F.col("newest") & periods["recent80"]).alias("recent_sources"), F.max("time").alias("last"))
        # pairs first: sources are then counted without distinct, and a popular destination's edges are summed before they meet
        pairs = self.edges.groupBy("src", "dst").agg(F.count("*").alias("n"), *[F.count_if(c).alias(k) for k, c in periods.items()], F.max("time").alias("last"))
        return pairs.groupBy("dst").agg(F.sum("n").alias("n"), *[F.sum(k).alias(k) for k in periods], F.count("*").alias("sources"), F.count_if(F.col("recent80") > 0).alias("recent_sources"), F.max("last").alias("last"))

    def pair_stats(self) -> DataFrame:
        r20 = self.starts[0]
        return self.edges.groupBy("src", "dst").agg(F.count("*").alias("n"), F.count_if(F.col("time") >= r20).alias("recent20"), F.max("time").alias("last"))

    def src_stats(self) -> DataFrame:
        """Counts, distinct destinations, share of repeats, mean gap between events."""
        order = Window.partitionBy("src").orderBy("time", "dst")
        before = F.lag("time").over(order)
        rows = self.edges.withColumn("gap", F.when(before.isNotNull(), F.greatest(F.col("time") - before, F.lit(0))))
        pairs = rows.groupBy("src", "dst").agg(F.count("*").alias("n"), F.sum("gap").alias("gaps"), F.count("gap").alias("n_gaps"), F.max("time").alias("last"))
        return pairs.groupBy("src").agg(
            F.sum("n").alias("n"), F.count("*").alias("unique_dst"), (1.0 - F.count("*") / F.sum("n")).alias("repeat_rate"),
            F.coalesce(F.sum("gaps") / F.nullif(F.sum("n_gaps"), F.lit(0)), F.lit(0.0)).alias("avg_gap"), F.max("last").alias("last"),
        )

    def repeats(self) -> DataFrame:
        """One row: edges, pairs, share of repeats, ids on both sides, and whether the two sides hardly share any."""
        pairs = self.edges.groupBy("src", "dst").count()
        counted = pairs.agg(F.sum("count").alias("edges"), F.count("*").alias("pairs"), (F.sum(F.col("count") - 1) / F.sum("count")).alias("repeat_fraction"))
        ids = pairs.select(F.col("src").alias("id"), F.lit(1).alias("s"), F.lit(0).alias("d")).unionAll(pairs.select("dst", F.lit(0), F.lit(1)))
        both = ids.groupBy("id").agg(F.max("s").alias("s"), F.max("d").alias("d")).agg(F.sum("s").alias("n_src"), F.sum("d").alias("n_dst"), F.sum(F.col("s") * F.col("d")).alias("shared"))
        row, other = counted.head(), both.head()
        bipartite = (other.shared or 0) / max(min(other.n_src or 0, other.n_dst or 0), 1) < 0.01
        out = (row.edges, row.pairs, row.repeat_fraction, other.n_src, other.n_dst, other.shared, bipartite)
        return self.edges.sparkSession.createDataFrame([out], "edges long, pairs long, repeat_fraction double, n_src long, n_dst long, shared long, bipartite boolean")


def packed_times(rows: DataFrame, low: int, high: int) -> DataFrame:
    """Rows (dst, time, newest) dealt by destination; time and newest travel as one number where it can hold both, -2 or -1 for no time."""
    n = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    if high - low >= 1 << 61:
        return rows.repartition(n, "dst")
    one = F.coalesce((F.col("time") - F.lit(low)) * 2, F.lit(-2).cast("long")) + F.col("newest").cast("long")
    dealt = rows.select("dst", one.alias("_x")).repartition(n, "dst")
    return dealt.select("dst", F.when(F.col("_x") >= 0, F.shiftright("_x", 1) + F.lit(low)).alias("time"), (F.col("_x").bitwiseAND(F.lit(1).cast("long")) == 1).alias("newest"))


def or_zero(column: str) -> Column:
    return F.coalesce(F.col(column), F.lit(0))


def id_map(edges: DataFrame, column: str, first: int = 1) -> DataFrame:
    """Dense numbers of the sorted distinct ids, from `first`; unknown ids are 0 after a left join and coalesce."""
    from .order import with_prefix

    return with_prefix(edges.select(column).distinct(), (column,), F.lit(1), "id").withColumn("id", F.col("id") + (first - 1))


def candidate_frequency(candidates: DataFrame) -> DataFrame:
    return candidates.groupBy("dst").agg(F.count("*").alias("n"))


def popularity_histogram(counts: DataFrame, column: str = "n") -> DataFrame:
    """Share of each popularity bucket; equal shares if all are empty."""
    from ..functions.scalars import POP_BUCKETS, popularity_bucket

    spark = counts.sparkSession
    names = spark.createDataFrame([(k, name) for k, (name, _, _) in enumerate(POP_BUCKETS)], "place int, bucket string")
    found = counts.select(popularity_bucket(F.col(column)).alias("bucket")).filter("bucket <> '0'").groupBy("bucket").agg(F.count("*").alias("n"))
    rows = names.join(F.broadcast(found), "bucket", "left").select("place", "bucket", or_zero("n").alias("n"))
    total = rows.agg(F.sum("n")).head()[0] or 0
    share = F.col("n") / F.lit(float(total)) if total else F.lit(1.0 / len(POP_BUCKETS))
    return rows.select("bucket", "n", share.alias("share"))


def standardiser(df: DataFrame, columns: list[str]) -> DataFrame:
    """feature, mean, std (1 where it is under 1e-6)."""
    long = df.select(F.explode(F.array(*[F.struct(F.lit(c).alias("feature"), F.col(c).cast("double").alias("x")) for c in columns])).alias("f")).select("f.*")
    out = long.groupBy("feature").agg(F.avg("x").alias("mean"), F.stddev_pop("x").alias("std"))
    return out.withColumn("std", F.when(F.col("std") < 1e-6, F.lit(1.0)).otherwise(F.col("std")))
