"""Histories as sequences: last K, transitions, co-occurrence, padded sequences."""

from __future__ import annotations

import math

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F



def _newest(key: str, other: str):
    return Window.partitionBy(key).orderBy(F.desc("time"), F.desc(other))


def by_source(edges: DataFrame) -> DataFrame:
    """Edges dealt by source, so that what is asked of sources shares one shuffle."""
    return dealt(edges.select("src", "time", "dst"))


def dealt(rows: DataFrame) -> DataFrame:
    """Rows dealt by source over a fixed number of partitions: what is dealt alike meets without another shuffle."""
    return rows.repartition(int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions")), "src")


def last_k(edges: DataFrame, k: int, key: str = "src", value: str = "dst") -> DataFrame:
    """The last k edges of each key, rank 1 the newest."""
    return edges.withColumn("rank", F.row_number().over(_newest(key, value))).filter(F.col("rank") <= k).select(key, value, "time", "rank")


def last_k_lists(edges: DataFrame, k: int, key: str = "src", value: str = "dst") -> DataFrame:
    """key and the array of its last k values, the newest last."""
    rows = last_k(edges, k, key, value).groupBy(key).agg(F.array_sort(F.collect_list(F.struct((-F.col("rank")).alias("r"), F.col(value).alias("v")))).alias("h"))
    return rows.select(key, F.transform("h", lambda x: x["v"]).alias("hist"))


def last_value(edges: DataFrame) -> DataFrame:
    """Each source's last destination and its time."""
    return edges.groupBy("src").agg(F.max(F.struct("time", "dst")).alias("m")).select("src", F.col("m.dst").alias("last_dst"), F.col("m.time").alias("last_time"))


def first_match_rank(edges: DataFrame, k: int) -> DataFrame:
    """src, dst, rank of its newest occurrence among the last k."""
    return last_k(edges, k).groupBy("src", "dst").agg(F.min("rank").alias("rank"))


def with_previous(edges: DataFrame) -> DataFrame:
    order = Window.partitionBy("src").orderBy("time", "dst")
    rows = edges.withColumn("prev", F.lag("dst").over(order)).withColumn("prev_time", F.lag("time").over(order))
    return rows.withColumn("gap", F.when(F.col("prev_time").isNotNull(), F.greatest(F.col("time") - F.col("prev_time"), F.lit(0))))


def transitions(edges: DataFrame, keep_same: bool = True) -> DataFrame:
    """prev, next, n of neighbouring edges of a source."""
    rows = with_previous(by_source(edges)).filter("prev is not null")
    rows = rows if keep_same else rows.filter("prev <> dst")
    return rows.groupBy("prev", F.col("dst").alias("next")).agg(F.count("*").alias("n"))


def window_pairs(edges: DataFrame, width: int, weight: str = "inverse", newest: int | None = None) -> DataFrame:
    """prev, next, w: each edge with up to `width` edges of its source before it, weighted by 1/distance ("inverse") or
    1/sqrt(distance) ("root"); equal destinations are skipped. With `newest`, only the last edges of each source."""
    rows = last_k(edges, newest) if newest else edges
    order = Window.partitionBy("src").orderBy("time", "dst")
    rows = rows.select("src", "time", F.col("dst").alias("next"), F.reverse(F.collect_list("dst").over(order.rowsBetween(-width, -1))).alias("before"))
    pairs = rows.select("next", F.posexplode("before").alias("at", "prev")).filter("prev <> next")
    distance = (F.col("at") + 1).cast("double")
    w = 1.0 / (distance if weight == "inverse" else F.sqrt(distance))
    return pairs.groupBy("prev", "next").agg(F.sum(w).alias("w"))


def pruned(pairs: DataFrame, k: int, key: str | list[str] = "prev", other: str = "next", value: str = "w") -> DataFrame:
    """The k heaviest of each key; ties by id."""
    rank = F.row_number().over(Window.partitionBy(key).orderBy(F.round(F.col(value), 9).desc(), other))
    return pairs.withColumn("rank", rank).filter(F.col("rank") <= k).drop("rank")


def normalised(pairs: DataFrame, counts: DataFrame, k: int, by: tuple[str, ...] = ("prev",)) -> DataFrame:
    """log1p(w) / sqrt(log1p(n of prev) * log1p(n of next)), the k largest of each prev. counts: dst, n. by: prev and what follows from it."""
    c = counts.select("dst", F.log1p(F.col("n").cast("double")).alias("l"))
    rows = pairs.join(c.select(F.col("dst").alias("prev"), F.col("l").alias("lp")), "prev").join(c.select(F.col("dst").alias("next"), F.col("l").alias("ln")), "next")
    rows = rows.select(*by, "next", (F.log1p("w") / F.greatest(F.sqrt(F.col("lp") * F.col("ln")), F.lit(1e-6))).alias("w"))
    return pruned(rows, k, [*by])


def coverage(edges: DataFrame, k: int, fill: int | None = None) -> DataFrame:
    """src, share of distinct destinations among its last k, and how full the list is."""
    rows = last_k(edges, k).groupBy("src").agg(F.count("*").alias("n"), F.countDistinct("dst").alias("u"))
    return rows.select("src", (F.col("u") / F.greatest("n", F.lit(1))).alias("coverage"), (F.least("n", F.lit(fill or k)) / F.lit(float(fill or k))).alias("fill"))


def training_sequences(edges: DataFrame, length: int, gap_scale: float) -> DataFrame:
    """seq, src, dst and, for each edge with a history, the last `length` destinations and log gaps before it, padded with zeros."""
    rows = with_previous(edges)
    order = Window.partitionBy("src").orderBy("time", "dst")
    before = order.rowsBetween(-length, -1)
    gap = F.log1p(F.coalesce("gap", F.lit(0)).cast("double")) / gap_scale
    rows = rows.withColumn("g", gap).select("src", "dst", "time", F.collect_list("dst").over(before).alias("ids"), F.collect_list("g").over(before).alias("gaps"))
    room = F.greatest(F.lit(length) - F.size("ids"), F.lit(0))
    return rows.filter(F.size("ids") > 0).select("src", "dst", "time", F.concat(F.array_repeat(F.lit(0).cast("long"), room), "ids").alias("ids"), F.concat(F.array_repeat(F.lit(0.0), room), "gaps").alias("gaps"))




def training_samples(history: DataFrame, supervision: DataFrame, length: int, update: bool = True) -> tuple[DataFrame, DataFrame]:
    """Samples of sequence models from supervision edges, and one row of counts of those skipped. Edges: seq, src, dst, time.

    A sample has seq, src_id, label (number of dst from 0), is_new_pair, time_pos, gap, hist_len (position in the history's time, scaled log
    gap to the source's last event, scaled log length of its list), hist and hist_gap: the last `length` known destinations before it and
    scaled log gaps to them, zeros before. Ids are those of the history, 0 is unknown. With `update`, supervision edges of known
    destinations are seen by later ones. An edge is skipped if its source or destination is unknown, or its list empty; reasons overlap.
    Events are numbered for each source, and a sample joins those of its own numbers: no list grows with a source."""
    from .order import exact_percentiles
    from .stats import id_map

    src_ids = id_map(history, "src").select("src", F.col("id").alias("src_id"))
    dst_ids = id_map(history, "dst").select("dst", F.col("id").alias("dst_id"))
    low, high = history.agg(F.min("time"), F.max("time")).head()
    low, span = (0, 1.0) if low is None else (low, max(float(high - low), 1.0))
    gaps = with_previous(history).filter("gap is not null")
    p90 = exact_percentiles(gaps, "gap", [0.9])[0]
    gap_scale = max(math.log1p(p90) if p90 == p90 else 1.0, 1.0)
    most = history.groupBy("src").count().agg(F.max("count")).head()[0]
    hist_scale = max(math.log1p(float(most or 1)), 1.0)

    columns = ["src", "dst", "time", "seq"]
    events = history.select(*columns, F.lit(0).alias("phase")).unionByName(supervision.select(*columns, F.lit(1).alias("phase")))
    events = events.join(dst_ids, "dst", "left").withColumn("dst_id", F.coalesce("dst_id", F.lit(0)))
    known = F.col("dst_id") > 0
    counted = known if update else known & (F.col("phase") == 0)
    updates = counted | (F.col("phase") == 0)
    order = Window.partitionBy("src").orderBy("phase", "time", "seq").rowsBetween(Window.unboundedPreceding, -1)
    pairs = Window.partitionBy("src", "dst").orderBy("phase", "time", "seq").rowsBetween(Window.unboundedPreceding, -1)
    one = lambda c: F.when(c, 1).otherwise(0)
    rows = events.withColumn("n", F.coalesce(F.sum(one(counted)).over(order), F.lit(0))).withColumn("last", F.last(F.when(updates, F.col("time")), ignorenulls=True).over(order))
    rows = rows.withColumn("seen", F.coalesce(F.sum(one(updates)).over(pairs), F.lit(0)) > 0).withColumn("counted", counted)
    asked = rows.filter("phase = 1").join(src_ids, "src", "left").withColumn("src_id", F.coalesce("src_id", F.lit(0)))
    none, cold_src, cold_dst = F.col("n") == 0, F.col("src_id") == 0, F.col("dst_id") == 0
    skipped = asked.agg(F.count_if(none | cold_src | cold_dst).alias("skipped"), F.count_if(cold_dst).alias("cold_dst"), F.count_if(cold_src).alias("cold_src"), F.count_if(~cold_src & none).alias("no_history"), F.count_if(~(none | cold_src | cold_dst)).alias("samples"))
    used = asked.filter(~(none | cold_src | cold_dst))
    held = rows.filter("counted").select("src", (F.col("n") + 1).alias("i"), F.col("dst_id").alias("h"), F.col("time").alias("t"))
    back = used.select("seq", "src", "time", F.explode(F.sequence(F.greatest(F.col("n") - (length - 1), F.lit(1)), F.col("n"))).alias("i")).join(held, ["src", "i"])
    gap = F.log1p(F.greatest(F.col("time") - F.col("t"), F.lit(0)).cast("double")) / gap_scale
    lists = back.groupBy("seq").agg(F.array_sort(F.collect_list(F.struct("i", "h", gap.alias("g")))).alias("l"))
    room = F.lit(length) - F.size("l")
    out = used.join(lists, "seq").select(
        "seq", "src_id", (F.col("dst_id") - 1).alias("label"), (~F.col("seen")).cast("int").alias("is_new_pair"), ((F.col("time") - low) / F.lit(span)).alias("time_pos"),
        F.coalesce(F.log1p(F.greatest(F.col("time") - F.col("last"), F.lit(0)).cast("double")) / gap_scale, F.lit(0.0)).alias("gap"), (F.log1p(F.least("n", F.lit(length)).cast("double")) / hist_scale).alias("hist_len"),
        F.concat(F.array_repeat(F.lit(0).cast("long"), room), F.transform("l", lambda x: x["h"])).alias("hist"), F.concat(F.array_repeat(F.lit(0.0), room), F.transform("l", lambda x: x["g"])).alias("hist_gap"),
    )
    return out, skipped
