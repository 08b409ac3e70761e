"""Inputs that many queries share: a view's edges in order, its history and validation part, queries and candidate lists."""

from __future__ import annotations

from functools import cached_property

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import candidates as C
from ..operators import order
from ..operators.sequences import dealt
from ..operators.stats import History
from ..sources import edges as E

N_CANDIDATES = 10


class View:
    """A view of edges, its 80/20 split by time, and lists of N_CANDIDATES for each edge of the later part. sourced: edges are held dealt by
    source, and only the later part is numbered."""

    def __init__(self, spark: SparkSession, sf_dir: str, name: str = "new", sourced: bool = False):
        self.spark, self.name, self.sourced = spark, name, sourced
        self.edges: DataFrame = getattr(E, f"edges_{name}")(spark, sf_dir)

    @cached_property
    def numbered(self) -> DataFrame:
        # every statistic starts from these rows; equal plans share one cached copy
        return order.with_seq(self.edges).persist()

    @cached_property
    def split(self) -> tuple[DataFrame, DataFrame]:
        if self.sourced:
            return order.split_dealt(dealt(self.edges).persist(), 0.8)
        return order.split_ratio(self.numbered, 0.8)

    @property
    def train(self) -> DataFrame:
        return self.split[0]

    @property
    def valid(self) -> DataFrame:
        return self.split[1]

    @cached_property
    def history(self) -> History:
        return History(self.train, self.sourced)

    @property
    def queries(self) -> DataFrame:
        return self.valid.select(F.col("seq").alias("qid"), "src", "time", "dst")

    @cached_property
    def lists(self) -> DataFrame:
        # queries are dealt by source before they have a row for each candidate
        vocabulary = self.history.dst_stats() if self.sourced else self.train
        return C.random_lists(dealt(self.queries), vocabulary.select("dst"), N_CANDIDATES)


# The same in SQL.

_EDGES = {
    "new": "SELECT CAST(o_custkey AS BIGINT) AS src, CAST(l_partkey AS BIGINT) AS dst, CAST(epoch(o_orderdate) AS BIGINT) AS time FROM lineitem JOIN orders ON l_orderkey = o_orderkey",
    "mid": "SELECT CAST(o_custkey AS BIGINT) AS src, CAST(l_suppkey AS BIGINT) AS dst, CAST(epoch(o_orderdate) AS BIGINT) AS time FROM lineitem JOIN orders ON l_orderkey = o_orderkey",
    "cold": "SELECT CAST(o_custkey AS BIGINT) AS src, CAST(l_suppkey AS BIGINT) * 10000 + year(o_orderdate) AS dst, CAST(epoch(o_orderdate) AS BIGINT) AS time FROM lineitem JOIN orders ON l_orderkey = o_orderkey",
    "rep": "SELECT CAST(user_id AS BIGINT) AS src, CAST(json_extract(props, '$.k') AS BIGINT) AS dst, epoch_us(ts) AS time FROM events",
    "type": "SELECT CAST(user_id AS BIGINT) AS src, CAST(list_position(['click', 'error', 'purchase', 'signup', 'view'], event_type) AS BIGINT) AS dst, epoch_us(ts) AS time FROM events",
}


def edges_sql(view: str) -> str:
    return _EDGES[view]


def base_sql(view: str = "new") -> str:
    """WITH clauses: edges, e (numbered), h (history), v (validation)."""
    return f"""edges AS ({_EDGES[view]}),
        e AS (SELECT *, row_number() OVER (ORDER BY time, src, dst) AS seq FROM edges),
        h AS (SELECT * FROM e WHERE seq <= greatest(1, floor((SELECT count(*) FROM edges) * 0.8))),
        v AS (SELECT * FROM e WHERE seq > greatest(1, floor((SELECT count(*) FROM edges) * 0.8)))"""


def lists_sql(view: str = "new", n: int = N_CANDIDATES) -> str:
    """And q (queries), vocab, c (candidate lists)."""
    return f"""{base_sql(view)},
        q AS (SELECT seq AS qid, src, time, dst FROM v),
        vocab AS (SELECT dst, row_number() OVER (ORDER BY dst) - 1 AS id FROM (SELECT DISTINCT dst FROM h)),
        nv AS (SELECT count(*) AS n FROM vocab),
        raw AS (SELECT qid, src, time, 0 AS source, 0 AS place, dst FROM q
            UNION ALL SELECT q.qid, q.src, q.time, 9, k, vocab.dst FROM q, nv, (SELECT unnest(range(1, {n})) AS k) ks JOIN vocab ON vocab.id = (q.qid * 7919 + k * 104729) % nv.n WHERE k <= greatest(1, least({n - 1}, nv.n))),
        firsts AS (SELECT qid, src, time, dst, min(source * 1000000 + place) AS m FROM raw GROUP BY ALL),
        c AS (SELECT qid, src, time, CAST(row_number() OVER (PARTITION BY qid ORDER BY m, dst) - 1 AS INTEGER) AS pos, dst, m = 0 AS label FROM firsts)"""


def scales_sql() -> str:
    """And sc: one row of scales of the history."""
    return """sc0 AS (SELECT count(*) AS n, min(time) AS low, max(time) AS high, quantile_cont(time, 0.6) AS p60, quantile_cont(time, 0.8) AS p80, quantile_cont(time, 0.82) AS p82 FROM h),
        d AS (SELECT dst, count(*) AS n, count(*) FILTER (time >= p80) AS recent80, count(*) FILTER (time >= p60 AND time < p80) AS older80, count(*) FILTER (time >= p82) AS recent82,
            count(*) FILTER (time >= p60 AND time < p82) AS mid82, count(*) FILTER (time < p60) AS older82, count(*) FILTER (time >= high - greatest(high - low, 1) // 5) AS recent20,
            count(*) FILTER (time >= high - greatest(high - low, 1) // 10) AS recent10, count(*) FILTER (time >= high - greatest(high - low, 1) // 20) AS recent05,
            count(DISTINCT src) AS sources, count(DISTINCT CASE WHEN time >= p80 THEN src END) AS recent_sources, max(time) AS last FROM h, (SELECT low, high, p60, p80, p82 FROM sc0) GROUP BY dst),
        p AS (SELECT src, dst, count(*) AS n, count(*) FILTER (time >= high - greatest(high - low, 1) // 5) AS recent20, max(time) AS last FROM h, (SELECT low, high FROM sc0) GROUP BY src, dst),
        s AS (SELECT src, count(*) AS n FROM h GROUP BY src),
        sc AS (SELECT sc0.*, greatest(CAST(high - low AS DOUBLE), 1) AS span, greatest(ln(1 + (SELECT max(n) FROM d)), 1) AS ld, greatest(ln(1 + (SELECT max(n) FROM s)), 1) AS ls,
            greatest(ln(1 + (SELECT max(n) FROM p)), 1) AS lp, greatest(ln(1 + greatest((SELECT max(recent80) FROM d), 1)), 1) AS lr80, greatest(ln(1 + greatest((SELECT max(recent82) FROM d), 1)), 1) AS lr82 FROM sc0),
        lk AS (SELECT src, dst, time, row_number() OVER (PARTITION BY src ORDER BY time DESC, dst DESC) AS r FROM h)"""
