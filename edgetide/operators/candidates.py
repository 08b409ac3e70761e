"""Candidate lists for queries. Random draws are arithmetic in the query's number, so they are the same in every engine.

Queries: qid, src, time, dst (the positive). Lists: qid, src, time, pos, dst, label. Quotas never exceed the vocabulary."""

from __future__ import annotations

import math
from collections.abc import Callable
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.scalars import positive_int
from .order import exact_percentiles
from .sequences import last_k
from .stats import id_map

STEP, STRIDE = 7919, 104729
#: So many rows of a vocabulary go to every task; a larger one is joined by shuffle.
HELD = 2_000_000
#: Vocabularies of up to so many destinations are arrays in the plan, from which a query's whole list is made in its own row.
PACKED = 200_000
#: Vocabularies of up to so many runs without gaps are numbered by arithmetic, and no table of them goes to every task.
RUNS = 64


def positives(queries: DataFrame) -> DataFrame:
    return queries.select("qid", "src", "time", F.lit(0).alias("source"), F.lit(0).cast("long").alias("place"), "dst")


def first_of_each(rows: DataFrame) -> DataFrame:
    """Ordered dedupe: the least (source, place) of each (qid, dst)."""
    return rows.groupBy("qid", "src", "time", "dst").agg(F.min(F.struct("source", "place")).alias("m")).select("qid", "src", "time", "dst", "m.source", "m.place")


def numbered(rows: DataFrame, queries: DataFrame, n: int | None = None) -> DataFrame:
    """pos from 0 in (source, place) order, at most n, with the label of the positive."""
    order = Window.partitionBy("qid").orderBy("source", "place", "dst")
    out = rows.withColumn("pos", (F.row_number().over(order) - 1).cast("int"))
    out = out.filter(F.col("pos") < n) if n else out
    return out.select("qid", "src", "time", "pos", "dst", (F.col("source") == 0).alias("label"))


def modular_draws(queries: DataFrame, vocabulary: DataFrame, n: int, source: int = 9, seed: int = 0) -> DataFrame:
    """n draws for each query from a vocabulary (dst), by number (qid * 7919 + k * 104729 + seed) mod size."""
    ids = id_map(vocabulary, "dst", 0)
    size = ids.count()
    if size == 0:
        return positives(queries).limit(0)
    draws = queries.select("qid", "src", "time", F.explode(F.sequence(F.lit(1), F.lit(max(min(n, size), 1)))).alias("k"))
    draws = draws.withColumn("id", F.pmod(F.col("qid") * STEP + F.col("k") * STRIDE + seed, F.lit(size)))
    return draws.join(ids, "id").select("qid", "src", "time", F.lit(source).alias("source"), F.col("k").cast("long").alias("place"), "dst")


def vocabulary_ids(vocabulary: DataFrame) -> tuple[DataFrame, int]:
    """dst and id from 0, held for all that draw from it and sent to every task where it is small enough, and its size."""
    ids = id_map(vocabulary, "dst", 0).persist()
    size = ids.count()
    return F.broadcast(ids) if size <= HELD else ids, size


def runs(ids: DataFrame) -> list[tuple[int, int, int]] | None:
    """First dst, first id and length of each run of neighbours in a numbered vocabulary; None if they are more than RUNS or a dst is null."""
    found = ids.groupBy(F.try_subtract("dst", "id").alias("d")).agg(F.min("id").alias("id"), F.count("*").alias("n")).limit(RUNS + 1).collect()
    return None if len(found) > RUNS or any(r.d is None for r in found) else sorted((r.id + r.d, r.id, r.n) for r in found)


def by_run(x: Column, found: list[tuple[int, int, int]], at: int, leaf: Callable[[int, int, int], Column]) -> Column:
    """leaf of the last run whose first dst (at 0) or id (at 1) isn't above x, by halving."""
    if len(found) == 1:
        return leaf(*found[0])
    half = len(found) // 2
    return F.when(x < F.lit(found[half][at]), by_run(x, found[:half], at, leaf)).otherwise(by_run(x, found[half:], at, leaf))


def id_of(dst: Column, found: list[tuple[int, int, int]]) -> Column:
    return by_run(dst, found, 0, lambda first, id_, n: F.when(dst.between(first, first + n - 1), dst - F.lit(first) + F.lit(id_)))


def dst_of(id_: Column, found: list[tuple[int, int, int]]) -> Column:
    return by_run(id_, found, 1, lambda first, start, n: id_ - F.lit(start) + F.lit(first))


def drawn_at(id_: Column, size: int, seed: int = 0) -> tuple[Column, int]:
    """The first k from 1 whose draw is this id, null if none is; and how many draws differ before they repeat."""
    common = math.gcd(STRIDE, size)
    period = size // common
    away = F.pmod(id_ - F.col("qid") * STEP - seed, F.lit(size).cast("long"))
    k = F.pmod(((away - away % common) / common).cast("long") * pow(STRIDE // common, -1, period), F.lit(period).cast("long"))
    return F.when(away % common == 0, F.when(k == 0, F.lit(period).cast("long")).otherwise(k)), period


def random_lists(queries: DataFrame, vocabulary: DataFrame, n: int) -> DataFrame:
    """The positive and n - 1 draws; repeated draws are left out. Where a draw meets the positive follows from the positive's number in the
    vocabulary, so places need no window, and lists no shuffle of their rows."""
    ids, size = vocabulary_ids(vocabulary)
    if not size:
        return queries.select("qid", "src", "time", F.lit(0).alias("pos"), "dst", F.lit(True).alias("label"))
    at, period = drawn_at(F.col("_id"), size)
    if found := runs(ids):
        rows = queries.select("qid", "src", "time", "dst", id_of(F.col("dst"), found).alias("_id"))
    else:
        own = ids.select(F.col("dst").alias("_dst"), F.col("id").alias("_id"))
        rows = queries.select("qid", "src", "time", "dst").join(own, F.col("dst").eqNullSafe(F.col("_dst")), "left")
    rows = rows.select("qid", "src", "time", F.col("dst").alias("_dst"), at.alias("_at"))
    rows = rows.withColumn("_k", F.explode(F.sequence(F.lit(0), F.lit(min(max(min(n - 1, size), 1), period))))).filter("_at is null or _k <> _at")
    rows = rows.withColumn("id", F.when(F.col("_k") > 0, F.pmod(F.col("qid") * STEP + F.col("_k") * STRIDE, F.lit(size).cast("long"))))
    rows = rows.withColumn("dst", dst_of(F.col("id"), found)) if found else rows.join(ids, "id", "left")
    pos = F.col("_k") - F.coalesce((F.col("_k") > F.col("_at")).cast("int"), F.lit(0))
    return rows.select("qid", "src", "time", pos.alias("pos"), F.when(F.col("_k") == 0, F.col("_dst")).otherwise(F.col("dst")).alias("dst"), (F.col("_k") == 0).alias("label"))


def all_lists(queries: DataFrame, vocabulary: DataFrame) -> DataFrame:
    """Every destination for every query: the evaluation over the whole vocabulary."""
    if (pool := small_pool(vocabulary)) is not None:
        return places(queries, F.array_distinct(F.concat(F.array("dst"), longs(pool))))
    every = queries.select("qid", "src", "time", F.col("dst").alias("positive")).crossJoin(vocabulary.select("dst").distinct())
    every = every.select("qid", "src", "time", F.when(F.col("dst") == F.col("positive"), 0).otherwise(1).alias("source"), F.col("dst").alias("place"), "dst")
    return numbered(first_of_each(every.unionByName(positives(queries))), queries)


def recent_of_source(queries: DataFrame, history: DataFrame, k: int, source: int = 1) -> DataFrame:
    """The source's last k destinations, the newest first."""
    h = last_k(history, k).select("src", "dst", F.col("rank").cast("long").alias("place"))
    return queries.select("qid", "src", "time").join(h, "src").select("qid", "src", "time", F.lit(source).alias("source"), "place", "dst")


def popular(history: DataFrame, n: int, since: float | None = None, rarest: bool = False) -> DataFrame:
    """dst and place of the n most (or least) frequent destinations."""
    rows = history.filter(F.col("time") >= since) if since is not None else history
    counts = rows.groupBy("dst").agg(F.count("*").alias("n"))
    key = F.asc("n") if rarest else F.desc("n")
    top = counts.orderBy(key, "dst").limit(n)
    # n rows at most
    return top.withColumn("place", F.row_number().over(Window.orderBy(key, "dst")).cast("long")).select("dst", "place")


def shared(queries: DataFrame, dsts: DataFrame, source: int) -> DataFrame:
    """One bounded list (dst, place) for all queries."""
    listed = dsts.agg(F.array_sort(F.collect_list(F.struct("place", "dst"))).alias("l")).head()[0] or []
    held = F.array(*[F.struct(F.lit(r.place).cast("long").alias("place"), F.lit(r.dst).cast("long").alias("dst")) for r in listed]) if listed else F.array().cast("array<struct<place: long, dst: long>>")
    return queries.select("qid", "src", "time", F.explode(held).alias("x")).select("qid", "src", "time", F.lit(source).alias("source"), "x.place", "x.dst")


def limited(rows: DataFrame, upto: dict[int, int]) -> DataFrame:
    """Cumulative quotas: a row of a source stays while its place in the whole list is within the quota of its source."""
    place = F.row_number().over(Window.partitionBy("qid").orderBy("source", "place", "dst"))
    quota = F.lit(1 << 30)
    for source, most in upto.items():
        quota = F.when(F.col("source") == source, most).otherwise(quota)
    return rows.withColumn("_p", place).filter(F.col("_p") <= quota).drop("_p")


def hard_lists(queries: DataFrame, history: DataFrame, n: int, recent: int = 200, hot: int = 64) -> DataFrame:
    """The positive, then the source's recent destinations, then popular ones, then draws, n in all."""
    if (pool := small_pool(history)) is not None:
        rows = queries.select("qid", "src", "time", "dst").join(recent_lists(history, recent), "src", "left")
        return places(rows, joined_lists(n, F.coalesce("recent", longs([])), placed(popular(history, hot)), drawn(pool, 2 * n)))
    rows = positives(queries).unionByName(recent_of_source(queries, history, recent)).unionByName(shared(queries, popular(history, hot), 2))
    rows = rows.unionByName(modular_draws(queries, history.select("dst"), 2 * n))
    return numbered(first_of_each(rows), queries, n)


def small_pool(vocabulary: DataFrame) -> list[int] | None:
    """The sorted distinct destinations of a vocabulary, None if they are more than PACKED or one is null."""
    found = [r[0] for r in vocabulary.select("dst").distinct().limit(PACKED + 1).collect()]
    return None if len(found) > PACKED or None in found else sorted(found)


def longs(values: list[int]) -> Column:
    """A constant array. It is read from one text, since an expression for each value would be slow to plan."""
    return F.split(F.lit(",".join(map(str, values))), ",").cast("array<bigint>") if values else F.array().cast("array<bigint>")


def drawn(pool: list[int], n: int, seed: int = 0) -> Column:
    """What modular_draws gives a query, in order, as an array."""
    if not pool:
        return longs([])
    held, size = longs(pool), F.lit(len(pool)).cast("long")
    return F.transform(F.sequence(F.lit(1), F.lit(max(min(n, len(pool)), 1))), lambda k: F.get(held, F.pmod(F.col("qid") * STEP + k * STRIDE + seed, size).cast("int")))


def recent_lists(history: DataFrame, k: int) -> DataFrame:
    """src and recent: its last k destinations, the newest first."""
    rows = last_k(history, k).groupBy("src").agg(F.array_sort(F.collect_list(F.struct("rank", "dst"))).alias("l"))
    return rows.select("src", F.transform("l", lambda x: x["dst"]).alias("recent"))


def places(rows: DataFrame, listed: Column) -> DataFrame:
    """Lists from arrays of distinct destinations, the positive first: the only step that makes a row for each place."""
    out = rows.select("qid", "src", "time", F.posexplode(listed).alias("pos", "dst"))
    return out.select("qid", "src", "time", "pos", "dst", (F.col("pos") == 0).alias("label"))


def placed(dsts: DataFrame) -> Column:
    """One bounded list (dst, place) as a constant array, in order."""
    return longs([r.dst for r in dsts.orderBy("place").collect()])


def joined_lists(n: int, *arrays: Column) -> Column:
    """The positive and the arrays one after the other, each destination where it is first, at most n."""
    return F.slice(F.array_distinct(F.concat(F.array("dst"), *arrays)), 1, n)


def filled_lists(queries: DataFrame, history: DataFrame, n: int = 100, low_popularity: bool = False) -> DataFrame:
    """A third from the source's history of 80, up to 7 tenths from 2000 popular (or rare) ones, the rest draws. A query's list is made in
    its own row, where the vocabulary allows; else rows of all sources meet in a shuffle."""
    quota, hot = {1: max(n * 34 // 100, 1), 2: max(n * 70 // 100, 1)}, popular(history, min(2000, 4 * n), rarest=low_popularity)
    if (pool := small_pool(history)) is None:
        rows = positives(queries).unionByName(recent_of_source(queries, history, 80)).unionByName(shared(queries, hot, 2))
        kept = limited(first_of_each(rows), quota)
        return numbered(first_of_each(kept.unionByName(modular_draws(queries, history.select("dst"), 2 * n))), queries, n)
    rows = queries.select("qid", "src", "time", "dst").join(recent_lists(history, 80), "src", "left")
    own = F.array_distinct(F.concat(F.array("dst"), F.coalesce("recent", longs([]))))
    rows = rows.withColumn("own", own).withColumn("every", F.array_distinct(F.concat("own", placed(hot))))
    m = F.size("own")
    kept = F.concat(F.slice("every", F.lit(1), F.least(m, F.lit(quota[1]))), F.slice("every", m + 1, F.greatest(F.lit(quota[2]) - m, F.lit(0))))
    return places(rows, F.slice(F.array_distinct(F.concat(kept, drawn(pool, 2 * n))), 1, n))


#: Parts of a list of n: recent, popular, seen in tests, cold, by mode.
MIXES = {"random": (0, 0, 0, 0), "mixed": (1 / 4, 1 / 3, 1 / 5, 1 / 8), "hard": (1 / 3, 1 / 2, 0, 0), "cold": (1 / 8, 1 / 8, 1 / 5, 1 / 3)}


def mixed_lists(queries: DataFrame, history: DataFrame, tests: DataFrame, n: int, mode: str = "mixed") -> DataFrame:
    """Quotas of each kind by mode, the rest draws. tests: dst of the test lists; cold ones are those without history."""
    known = history.select("dst").distinct()
    seen = tests.select("dst").distinct()
    parts = [int(n * x) for x in MIXES[mode]]
    if (pool := small_pool(known)) is not None and (asked := small_pool(seen)) is not None:
        own, hot, warm, cold = parts
        rows, have = queries.select("qid", "src", "time", "dst"), {*pool}
        if own:
            rows = rows.join(recent_lists(history, own), "src", "left")
        arrays = [F.coalesce("recent", longs([]))] * (own > 0) + ([placed(popular(history, hot))] if hot else [])
        arrays += [drawn([x for x in asked if (x in have) == known_], quota, seed) for known_, quota, seed in ((True, warm, 11), (False, cold, 13)) if quota]
        return places(rows, joined_lists(n, *arrays, drawn(pool, 2 * n)))
    rows = positives(queries)
    for source, (quota, make) in enumerate(zip(parts, (
        lambda q, s: recent_of_source(queries, history, q, s), lambda q, s: shared(queries, popular(history, q), s),
        lambda q, s: modular_draws(queries, seen.join(known, "dst", "left_semi"), q, s, 11), lambda q, s: modular_draws(queries, seen.join(known, "dst", "left_anti"), q, s, 13),
    ), strict=True), 1):
        if quota:
            rows = rows.unionByName(make(quota, source))
    return numbered(first_of_each(rows.unionByName(modular_draws(queries, known, 2 * n))), queries, n)


def pairwise_negatives(queries: DataFrame, history: DataFrame, tests: DataFrame, n: int) -> DataFrame:
    """A quarter recent, a quarter popular from an offset by qid, a fifth cold, the rest draws."""
    hot = popular(history, max(4 * n, 1))
    rows = positives(queries).unionByName(recent_of_source(queries, history, max(n // 4, 1)))
    size = max(hot.count(), 1)
    turned = shared(queries, hot, 2).withColumn("place", F.pmod(F.col("place") + F.col("qid"), F.lit(size))).filter(F.col("place") < n // 4)
    cold = tests.select("dst").distinct().join(history.select("dst").distinct(), "dst", "left_anti")
    rows = rows.unionByName(turned).unionByName(modular_draws(queries, cold, max(n // 5, 1), 3, 13))
    return numbered(first_of_each(rows.unionByName(modular_draws(queries, history.select("dst"), 2 * n))), queries, n)


def wide_pool(queries: DataFrame, history: DataFrame, trans: DataFrame, recent_since: float, size: int = 700) -> DataFrame:
    """120 recent, 40 transitions of each of the last 24, 160 recently popular, 160 popular, 120 rare, the rest draws."""
    h = last_k(history, 24).select("src", F.col("dst").alias("prev"), "rank")
    t = trans.withColumn("tr", F.row_number().over(Window.partitionBy("prev").orderBy(F.round("w", 9).desc(), "next"))).filter("tr <= 40")
    hops = queries.select("qid", "src", "time").join(h, "src").join(t, "prev")
    hops = hops.select("qid", "src", "time", F.lit(2).alias("source"), (F.col("rank") * 100 + F.col("tr")).cast("long").alias("place"), F.col("next").alias("dst"))
    low = exact_percentiles(history.groupBy("dst").agg(F.count("*").alias("n")), "n", [0.40])[0]
    rare = history.groupBy("dst").agg(F.count("*").alias("n")).filter(F.col("n") <= low).select("dst")
    rows = positives(queries).unionByName(recent_of_source(queries, history, 120)).unionByName(hops)
    rows = rows.unionByName(shared(queries, popular(history, 160, since=recent_since), 3)).unionByName(shared(queries, popular(history, 160), 4))
    rows = rows.unionByName(modular_draws(queries, rare, 120, 5, 17)).unionByName(modular_draws(queries, history.select("dst"), size))
    return numbered(first_of_each(rows), queries, size)


def hardest(pool: DataFrame, score: str, n: int = 99) -> DataFrame:
    """The positive and the n negatives of the largest score."""
    rank = F.row_number().over(Window.partitionBy("qid", "label").orderBy(F.round(score, 9).desc(), "dst"))
    return pool.withColumn("_r", rank).filter(F.col("label") | (F.col("_r") <= n)).drop("_r")


def injected(edges: DataFrame, templates: DataFrame, known: DataFrame) -> DataFrame:
    """Put each edge (qid, src, dst, time) into a list of the tests: one of its source by turns, else any by number. The positive stays where
    it is found, else it replaces a known candidate chosen by number, or any. templates: qid, src, candidates."""
    own = Window.partitionBy("src").orderBy("qid")
    size = Window.partitionBy("src")
    t = templates.select("src", "candidates", (F.row_number().over(own) - 1).alias("i"), F.count("*").over(size).alias("m"))
    counts = t.groupBy("src").agg(F.max("m").alias("m"))
    e = edges.join(counts, "src", "left").withColumn("turn", F.row_number().over(Window.partitionBy("src").orderBy("qid")) - 1)
    same = e.filter("m is not null").withColumn("i", F.col("turn") % F.col("m")).join(t.select("src", "i", "candidates"), ["src", "i"])
    every = id_map(templates.select("qid"), "qid", 0)
    n = every.count()
    numbered_templates = templates.select(F.col("qid"), "candidates").join(every, "qid").select("id", "candidates")
    other = e.filter("m is null").withColumn("id", F.pmod(F.col("qid") * STEP, F.lit(max(n, 1)))).join(numbered_templates, "id")
    columns = ["qid", "src", "time", "dst", "candidates"]
    rows = same.select(*columns, F.lit(True).alias("same_src")).unionByName(other.select(*columns, F.lit(False).alias("same_src")))
    long = rows.select("qid", "src", "time", F.col("dst").alias("positive"), "same_src", F.posexplode("candidates").alias("pos", "dst"))
    long = long.join(known.select("dst").distinct().withColumn("known", F.lit(True)), "dst", "left").withColumn("known", F.coalesce("known", F.lit(False)))
    of = Window.partitionBy("qid")
    there = F.max((F.col("dst") == F.col("positive")).cast("int")).over(of)
    choice = F.row_number().over(Window.partitionBy("qid").orderBy(F.desc("known"), F.pmod(F.col("qid") * STEP + F.col("pos") * STRIDE, F.lit(1009)), "pos"))
    put = (there == 0) & (choice == 1)
    long = long.withColumn("put", put)
    return long.select("qid", "src", "time", "pos", F.when(F.col("put"), F.col("positive")).otherwise(F.col("dst")).alias("dst"), (F.col("put") | (F.col("dst") == F.col("positive"))).alias("label"), "same_src")


def small_counts(counts: DataFrame) -> list[tuple[int, str]] | None:
    """dst and bucket, by dst, as small_pool."""
    found = [tuple(r) for r in counts.select("dst", "bucket").limit(PACKED + 1).collect()]
    return None if len(found) > PACKED or any(dst is None for dst, _ in found) else sorted(found)


def bucketed_lists(queries: DataFrame, history: DataFrame, trans: DataFrame, n: int, source_quota: int = 0, transition_quota: int = 0) -> DataFrame:
    """Source history up to its quota, transitions of its last destination up to theirs, then draws from the popularity buckets in equal
    parts; destinations of the source are left out of all but its own quota. A query's list is made in its own row, where the vocabulary
    allows: a source's destinations are then no more than PACKED."""
    from ..functions.scalars import popularity_bucket
    from .sequences import by_source, last_value

    counts = history.groupBy("dst").agg(F.count("*").alias("n")).withColumn("bucket", popularity_bucket(F.col("n")))
    if (known := small_counts(counts)) is not None:
        pools: dict[str, list[int]] = {}
        for dst, bucket in known:
            pools.setdefault(bucket, []).append(dst)
        tr = F.row_number().over(Window.partitionBy("prev").orderBy(F.desc("n"), "next"))
        t = trans.withColumn("tr", tr).filter(F.col("tr") <= max(transition_quota, 0)).groupBy("prev").agg(F.array_sort(F.collect_list(F.struct("tr", "next"))).alias("l"))
        sources = by_source(history).groupBy("src").agg(F.collect_set("dst").alias("seen"), F.max(F.struct("time", "dst"))["dst"].alias("prev"))
        sources = sources.join(t.select("prev", F.transform("l", lambda x: x["next"]).alias("hops")), "prev", "left").drop("prev")
        rows = queries.select("qid", "src", "time", "dst").join(sources, "src", "left")
        none, seen = longs([]), F.coalesce("seen", longs([]))
        turned = F.transform(F.filter(seen, lambda x: x != F.col("dst")), lambda x: F.struct(F.pmod(F.col("qid") * STEP + x * STRIDE, F.lit(1009)).alias("k"), x.alias("dst")))
        own = F.transform(F.slice(F.array_sort(turned), 1, source_quota), lambda x: x["dst"]) if source_quota > 0 else none
        # draws of equal k stand together, by id: a struct of place and id sorts them
        draws = [F.transform(drawn(pool, max(2 * n // len(pools), 1), 19 * k), lambda x, i: F.struct(i.alias("k"), x.alias("dst"))) for k, (_, pool) in enumerate(sorted(pools.items()))]
        drawn_all = F.transform(F.array_sort(F.concat(*draws)), lambda x: x["dst"]) if draws else none
        rest = F.array_except(F.concat(F.coalesce("hops", none), drawn_all, drawn([dst for dst, _ in known], 3 * n)), seen)
        return places(rows, F.slice(F.array_distinct(F.concat(F.array("dst"), own, rest)), 1, n))
    seen = history.select("src", "dst").distinct()
    own = seen.join(queries.select("qid", "src", "time", F.col("dst").alias("positive")), "src").filter("dst <> positive")
    order = Window.partitionBy("qid").orderBy(F.pmod(F.col("qid") * STEP + F.col("dst") * STRIDE, F.lit(1009)), "dst")
    own = own.withColumn("r", F.row_number().over(order)).filter(F.col("r") <= source_quota).select("qid", "src", "time", F.lit(1).alias("source"), F.col("r").cast("long").alias("place"), "dst")
    t = trans.withColumn("tr", F.row_number().over(Window.partitionBy("prev").orderBy(F.desc("n"), "next"))).filter(F.col("tr") <= max(transition_quota, 0))
    hops = queries.select("qid", "src", "time").join(last_value(history).select("src", F.col("last_dst").alias("prev")), "src").join(t, "prev")
    hops = hops.select("qid", "src", "time", F.lit(2).alias("source"), F.col("tr").cast("long").alias("place"), F.col("next").alias("dst"))
    rows = hops
    buckets = [r[0] for r in counts.select("bucket").distinct().orderBy("bucket").collect()]
    for k, bucket in enumerate(buckets):
        pool = counts.filter(F.col("bucket") == bucket).select("dst")
        rows = rows.unionByName(modular_draws(queries, pool, max(2 * n // len(buckets), 1), 3, 19 * k))
    rows = rows.join(seen, ["src", "dst"], "left_anti").select("qid", "src", "time", "source", "place", "dst")
    fill = modular_draws(queries, history.select("dst"), 3 * n).join(seen, ["src", "dst"], "left_anti").select("qid", "src", "time", "source", "place", "dst")
    return numbered(first_of_each(positives(queries).unionByName(own).unionByName(rows).unionByName(fill)), queries, n)


def pseudo_labels(probs: DataFrame, m: int, seed: int = 0) -> DataFrame:
    """Teacher labels: of the 3 m queries of least entropy, m by hash, each with its likeliest candidate."""
    from ..functions.scalars import entropy_term
    from .windows import argmax

    entropy = probs.groupBy("qid").agg(F.sum(entropy_term(F.col("prob"))).alias("entropy"))
    sure = entropy.orderBy(F.round("entropy", 9), "qid").limit(3 * m)
    chosen = sure.orderBy(F.pmod(F.col("qid") * STEP + seed, F.lit(10007)), "qid").limit(m)
    return argmax(probs, "prob").join(chosen, "qid").select("qid", "src", "time", "dst", "entropy")


def hard_negative_tables(history: DataFrame, k: int = 50, hot: int = 4096) -> tuple[DataFrame, DataFrame]:
    """Each source's distinct recent destinations, newest first, and the most popular ones."""
    recent = last_k(history, 4 * k).groupBy("src", "dst").agg(F.min("rank").alias("rank"))
    place = F.row_number().over(Window.partitionBy("src").orderBy("rank"))
    return recent.withColumn("place", place).filter(F.col("place") <= k).select("src", "dst", "place"), popular(history, hot)


def blocks(lists: dict[str, DataFrame]) -> DataFrame:
    """Lists of several kinds as one training set, each row with the name of its block; equal lists of two blocks both stay."""
    return reduce(DataFrame.unionByName, [rows.withColumn("block", F.lit(name)) for name, rows in lists.items()])


def large_pool(queries: DataFrame, n: int, sampler: Callable[[DataFrame, int], DataFrame]) -> DataFrame:
    """Lists of at most n from a sampler of queries and a size; what it returns must have the columns of lists, and the positive in each."""
    rows = sampler(queries, positive_int(n, "n"))
    if missing := {"qid", "src", "time", "pos", "dst", "label"} - {*rows.columns}:
        raise ValueError(f"the sampler's lists have no {', '.join(sorted(missing))}")
    return rows
