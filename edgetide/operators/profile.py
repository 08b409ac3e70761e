"""Profile of how a validation part follows from its history."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.scalars import popularity_bucket
from .order import exact_percentiles, split_ratio
from .sequences import last_value, transitions

SHARES = (0.5, 0.9, 0.99)


def followed(history: DataFrame, valid: DataFrame, tail: float = 0.2) -> DataFrame:
    """name, value: sizes of both parts; shares of validation edges whose destination is known, whose pair is in the history, and whose
    destination once followed their source's last; percentiles and buckets of the destination's count in the history and in its tail (the
    last share of its rows). Edges: src, dst, time, seq."""
    recent = split_ratio(history, 1 - tail)[1]
    counts = lambda rows, name: rows.groupBy("dst").agg(F.count("*").alias(name))
    flag = lambda rows, keys, name: rows.select(*keys).distinct().withColumn(name, F.lit(1))
    last = last_value(history).select("src", F.col("last_dst").alias("prev"))
    follows = transitions(history).select("prev", F.col("next").alias("dst"), F.lit(1).alias("follows"))
    rows = valid.select("src", "dst").join(counts(history, "pop"), "dst", "left").join(counts(recent, "recent"), "dst", "left")
    rows = rows.join(flag(history, ["src", "dst"], "pair"), ["src", "dst"], "left").join(last, "src", "left").join(follows, ["prev", "dst"], "left")
    zero = lambda c: F.coalesce(c, F.lit(0))
    rows = rows.select(zero("pop").alias("pop"), zero("recent").alias("recent"), zero("pair").alias("pair"), zero("follows").alias("follows")).persist()
    n = max(rows.count(), 1)
    one = rows.agg(F.count_if(F.col("pop") > 0).alias("known"), F.sum("pair").alias("pair"), F.sum("follows").alias("follows")).head()
    known, pair, after = (float(x or 0) / n for x in one)
    out = [("history_rows", float(history.count())), ("valid_rows", float(rows.count())), ("history_dsts", float(history.select("dst").distinct().count()))]
    out += [("dst_seen", known), ("cold_dst", 1 - known), ("pair_seen", pair), ("new_pair", 1 - pair), ("follows_last", after)]
    for name in ("pop", "recent"):
        out += [(f"{name} p{int(100 * s)}", v) for s, v in zip(SHARES, exact_percentiles(rows, name, list(SHARES)), strict=True)]
        buckets = rows.groupBy(popularity_bucket(F.col(name)).alias("b")).agg(F.count("*").alias("n")).collect()
        out += [(f"{name} bucket {r.b}", r.n / n) for r in buckets]
    rows.unpersist()
    return history.sparkSession.createDataFrame(out, "name string, value double")
