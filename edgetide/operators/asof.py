"""Point-in-time state: what was known before an event, by union of events and probes and one running window for each key."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.scalars import log_gap


def asof_state(events: DataFrame, probes: DataFrame, key: list[str], order: str = "seq") -> DataFrame:
    """Each probe with n and last (time) of the events of its key strictly before it in the order. Probes sort before events of equal
    order, so an event that is its own probe isn't counted."""
    e = events.select(*key, order, F.lit(1).alias("_e"), F.col("time").alias("_t"), F.lit(None).cast("long").alias("pid"))
    p = probes.select(*key, order, F.lit(0).alias("_e"), F.lit(None).cast("long").alias("_t"), "pid")
    w = Window.partitionBy(*key).orderBy(order, "_e").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    rows = e.unionByName(p).withColumn("n", F.sum("_e").over(w)).withColumn("last", F.max("_t").over(w))
    return rows.filter("pid is not null").select("pid", "n", "last")


def prequential(edges: DataFrame) -> DataFrame:
    """Each edge (seq, src, dst, time) with the counts and last times of its destination, source and pair before it: three windows whose
    frames end one row before, and no join."""
    out = edges.select("seq", "src", "dst", "time")
    for name, key in (("dst", ["dst"]), ("src", ["src"]), ("pair", ["src", "dst"])):
        w = Window.partitionBy(*key).orderBy("seq").rowsBetween(Window.unboundedPreceding, -1)
        out = out.withColumn(f"{name}_n", F.count("*").over(w)).withColumn(f"{name}_last", F.max("time").over(w))
    return out.withColumn("dst_gap", log_gap(F.col("time"), F.col("dst_last"))).withColumn("is_new_pair", F.col("pair_n") == 0)


def new_pairs(edges: DataFrame) -> DataFrame:
    """Only the first edge of each pair, in seq order."""
    w = Window.partitionBy("src", "dst").orderBy("seq")
    return edges.withColumn("_r", F.row_number().over(w)).filter("_r = 1").drop("_r")


def neighbours_before(edges: DataFrame, probes: DataFrame, k: int) -> DataFrame:
    """pid and the last k destinations of its source strictly before its time, the oldest first. One window over events and probes; events of
    the probe's own time aren't seen."""
    e = edges.select("src", "time", "dst", F.lit(1).alias("_e"), F.lit(None).cast("long").alias("pid"))
    p = probes.select("src", "time", F.lit(None).cast("long").alias("dst"), F.lit(0).alias("_e"), "pid")
    # probes come before events of their time; a frame of k rows would count probes too, so events are numbered
    w = Window.partitionBy("src").orderBy("time", "_e", "dst").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    rows = e.unionByName(p).withColumn("n", F.sum("_e").over(w))
    events = rows.filter("_e = 1").select("src", "n", "dst")
    wanted = rows.filter("_e = 0").select("pid", "src", F.col("n").alias("upto"))
    back = wanted.withColumn("n", F.explode(F.sequence(F.greatest(F.col("upto") - (k - 1), F.lit(1)), F.greatest("upto", F.lit(1)))))
    found = back.filter("n <= upto").join(events, ["src", "n"])
    lists = found.groupBy("pid").agg(F.array_sort(F.collect_list(F.struct("n", "dst"))).alias("h"))
    return wanted.select("pid").join(lists, "pid", "left").select("pid", F.coalesce(F.transform("h", lambda x: x["dst"]), F.array().cast("array<bigint>")).alias("hist"))


def rolling_blocks(edges: DataFrame, block: int) -> DataFrame:
    """seq, src, dst, block and the counts of dst and of the pair in strictly earlier blocks: the state with which a block is scored before it
    is added. Blocks are counted first, so a window holds a row for each key and block, not for each edge."""
    b = edges.select("seq", "src", "dst", F.floor((F.col("seq") - 1) / block).alias("block"))
    out = b
    for name, key in (("dst_n", ["dst"]), ("pair_n", ["src", "dst"])):
        before = Window.partitionBy(*key).orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
        counts = b.groupBy(*key, "block").agg(F.count("*").alias("c"))
        out = out.join(counts.select(*key, "block", F.coalesce(F.sum("c").over(before), F.lit(0)).alias(name)), [*key, "block"])
    return out.select("seq", "src", "dst", "block", "dst_n", "pair_n")


#: So many rows of lists that all edges share go to every task; more are joined by shuffle.
HELD = 200_000


def blocks_hot(counts: DataFrame, hot: int) -> DataFrame:
    """block, hot: the most frequent destinations of strictly earlier blocks, by descending count, then id. counts: dst, block, c.

    Counts only grow, so a destination among the first after a block was among the first of those that its own last block counted: a block
    hands on no more than `hot` destinations with their counts so far. Ranges of blocks are summed up first, then each is followed from
    the state before it."""
    import pyarrow as pa

    upto = counts.withColumn("n", F.sum("c").over(Window.partitionBy("dst").orderBy("block").rowsBetween(Window.unboundedPreceding, Window.currentRow)))
    first = F.row_number().over(Window.partitionBy("block").orderBy(F.desc("n"), "dst"))
    led = upto.withColumn("r", first).filter(F.col("r") <= hot).select("block", "n", F.col("dst").cast("long").alias("dst")).persist()
    wide = max((led.agg(F.max("block")).head()[0] or 0) // 200 + 1, 1)
    led = led.withColumn("g", F.floor(F.col("block") / wide).cast("int"))

    def best(state: dict) -> list:
        return sorted(state.items(), key=lambda x: (-x[1], x[0] is not None, x[0] or 0))[:hot]

    most = F.row_number().over(Window.partitionBy("g").orderBy(F.desc("n"), "dst"))
    found = led.groupBy("g", "dst").agg(F.max("n").alias("n")).withColumn("r", most).filter(F.col("r") <= hot).orderBy("g").collect()
    starts, state, at = {}, {}, 0
    for r in found:
        for g in range(at, r.g):
            state = dict(best(state))
            starts[g + 1] = dict(state)
        at = r.g
        state[r.dst] = r.n

    def followed(table: pa.Table) -> pa.Table:
        rows = sorted(table.to_pylist(), key=lambda r: r["block"])
        now, out, k = dict(starts.get(rows[0]["g"], {})), {"block": [], "hot": []}, 0
        while k < len(rows):
            block = rows[k]["block"]
            out["block"].append(block)
            out["hot"].append([dst for dst, _ in best(now)])
            while k < len(rows) and rows[k]["block"] == block:
                now[rows[k]["dst"]] = rows[k]["n"]
                k += 1
            now = dict(best(now))
        return pa.table(out, pa.schema([("block", pa.int64()), ("hot", pa.list_(pa.int64()))]))

    return led.groupBy("g").applyInArrow(followed, "block long, hot array<long>")


def block_pools(edges: DataFrame, block: int, hot: int, recent: int) -> DataFrame:
    """Candidates of each edge from strictly earlier blocks: seq, src, source, place, dst. source 1: its source's last `recent` events, the
    newest first; 2: the `hot` most frequent destinations. Edges are dealt by source once and counted by destination; lists of blocks go to
    every task, so the rows of candidates are never shuffled."""
    b = edges.select("seq", "src", "dst", F.floor((F.col("seq") - 1) / block).cast("long").alias("block"))
    tops = blocks_hot(b.groupBy("dst", "block").agg(F.count("*").alias("c")), hot).persist()
    tops = F.broadcast(tops) if tops.count() * hot <= HELD * 8 else tops
    popular = b.join(tops, "block").select("seq", "src", F.lit(2).alias("source"), F.posexplode("hot").alias("at", "dst"))
    # those before the first edge of the source in the block
    before = F.collect_list(F.struct("dst")).over(Window.partitionBy("src").orderBy("seq").rowsBetween(-recent, -1))
    rows = b.withColumn("before", before).withColumn("before", F.first("before").over(Window.partitionBy("src", "block").orderBy("seq")))
    mine = rows.select("seq", "src", F.lit(1).alias("source"), F.posexplode(F.reverse("before")).alias("at", "x"))
    columns = ["seq", "src", "source", (F.col("at") + 1).alias("place")]
    return mine.select(*columns, "x.dst").unionByName(popular.select(*columns, "dst"))


def fifo_counts(edges: DataFrame, window: int) -> DataFrame:
    """dst, n over the last `window` edges by seq."""
    n = edges.agg(F.max("seq")).head()[0] or 0
    return edges.filter(F.col("seq") > n - window).groupBy("dst").agg(F.count("*").alias("n"))
