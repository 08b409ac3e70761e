"""Queries of the engine with their SQL twins. Numbers are rounded to 6 decimals on both sides, since the last bits of logarithms differ."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import scalars as S
from ..operators import asof, evaluate, features, linalg, order, scoring, sequences, stats, windows
from ..operators import candidates as C
from ..sources import sinks
from ..sources.edges import table
from .lists import View, base_sql, edges_sql, lists_sql, scales_sql

Query = Callable[[SparkSession, str], DataFrame]
_QUERIES: dict[str, Query] = {}
_SQL: dict[str, str] = {}


def query(sql: str | None = None, name: str | None = None) -> Callable[[Query], Query]:
    def add(f: Query) -> Query:
        key = name or f.__name__
        _QUERIES[key] = f
        if sql is not None:
            _SQL[key] = sql
        return f

    return add


def queries() -> dict[str, Query]:
    return dict(_QUERIES)


def oracle_sql() -> dict[str, str]:
    return dict(_SQL)


def rounded(df: DataFrame) -> DataFrame:
    return df.select(*[F.round(c, 6).alias(c) if t == "double" else F.col(c) for c, t in df.dtypes])


def r6(*names: str) -> str:
    return ", ".join(f"round({n}, 6) AS {n.split('.')[-1]}" for n in names)


# Views, order and splits

for _view in ("new", "mid", "rep", "type", "cold"):
    query(edges_sql(_view), f"edges_{_view}_view")(lambda spark, d, v=_view: View(spark, d, v).edges)


@query(f"WITH {base_sql('mid')} SELECT src, dst, time, seq FROM e")
def edges_in_order(spark, d):
    return View(spark, d, "mid").numbered


@query(f"WITH {base_sql('new')} SELECT CASE WHEN seq <= floor((SELECT count(*) FROM edges) * 0.8) THEN 'train' ELSE 'valid' END AS part, count(*) AS n, min(time) AS low, max(time) AS high FROM e GROUP BY 1")
def split_ratio(spark, d):
    train, valid = View(spark, d).split
    rows = train.withColumn("part", F.lit("train")).unionByName(valid.withColumn("part", F.lit("valid")))
    return rows.groupBy("part").agg(F.count("*").alias("n"), F.min("time").alias("low"), F.max("time").alias("high"))


@query(f"WITH edges AS ({edges_sql('rep')}), cut AS (SELECT quantile_cont(time, 0.8) AS c FROM edges) SELECT time >= c AS recent, count(*) AS n FROM edges, cut GROUP BY 1")
def split_percentile(spark, d):
    edges = View(spark, d, "rep").edges
    cut = order.exact_percentiles(edges, "time", [0.8])[0]
    return edges.groupBy((F.col("time") >= cut).alias("recent")).agg(F.count("*").alias("n"))


_GRID = [0.0, 0.01, 0.05, 0.1, 0.25, 0.5, 0.6, 0.75, 0.8, 0.82, 0.9, 0.95, 0.99, 1.0]


@query(f"WITH edges AS ({edges_sql('new')}) SELECT q, round(v, 4) AS v FROM (" + " UNION ALL ".join(f"SELECT CAST({q} AS DOUBLE) AS q, quantile_cont(time, {q}) AS v FROM edges" for q in map(float, _GRID)) + ")")
def time_cuts(spark, d):
    values = order.exact_percentiles(View(spark, d).edges, "time", _GRID)
    return spark.createDataFrame(list(zip(_GRID, values)), "q double, v double").withColumn("v", F.round("v", 4))


@query(f"WITH {base_sql('new')}, m AS (SELECT 1000 AS m, count(*) AS n FROM v), x AS (SELECT *, row_number() OVER (ORDER BY time, src, dst) - 1 AS i FROM v) SELECT src, dst, time, i FROM x, m WHERE i IN (SELECT CAST(j * (n - 1) // (m - 1) AS BIGINT) FROM m, range(0, 1000) t(j))")
def even_sample(spark, d):
    valid = order.with_seq(View(spark, d).valid.drop("seq"))
    return order.sample_evenly(valid, valid.count(), 1000).select("src", "dst", "time", (F.col("seq") - 1).alias("i"))


# Keyed statistics

@query(f"WITH {base_sql('new')}, {scales_sql()} SELECT * FROM d")
def dst_stats(spark, d):
    return View(spark, d).history.dst_stats()


@query(f"WITH {base_sql('mid')}, {scales_sql()} SELECT * FROM p")
def pair_stats(spark, d):
    return View(spark, d, "mid").history.pair_stats()


@query(f"""WITH {base_sql('rep')}, g0 AS (SELECT *, time - lag(time) OVER (PARTITION BY src ORDER BY time, dst) AS g FROM h), g AS (SELECT *, CASE WHEN g IS NOT NULL THEN greatest(g, 0) END AS gap FROM g0)
    SELECT src, count(*) AS n, count(DISTINCT dst) AS unique_dst, round(1.0 - count(DISTINCT dst) / count(*), 6) AS repeat_rate, round(coalesce(avg(gap), 0), 3) AS avg_gap, max(time) AS last FROM g GROUP BY src""")
def src_stats(spark, d):
    return rounded(View(spark, d, "rep").history.src_stats()).withColumn("avg_gap", F.round("avg_gap", 3))


def _repeat_sql(view: str) -> str:
    return f"""WITH {base_sql(view)}, p AS (SELECT src, dst, count(*) AS n FROM h GROUP BY ALL), i AS (SELECT count(*) AS k FROM (SELECT DISTINCT src FROM h INTERSECT SELECT DISTINCT dst FROM h))
        SELECT CAST(sum(n) AS BIGINT) AS edges, count(*) AS pairs, round(sum(n - 1) / sum(n), 6) AS repeat_fraction, count(DISTINCT src) AS n_src, count(DISTINCT dst) AS n_dst, CAST(max(k) AS BIGINT) AS shared,
            max(k) / greatest(least(count(DISTINCT src), count(DISTINCT dst)), 1) < 0.01 AS bipartite FROM p, i"""


for _view in ("new", "mid", "rep"):
    query(_repeat_sql(_view), f"repeat_fraction_{_view}")(lambda spark, d, v=_view: rounded(View(spark, d, v).history.repeats()))


@query(f"WITH {base_sql('new')}, {scales_sql()} SELECT {r6('ld', 'ls', 'lp', 'lr80', 'lr82')}, span FROM sc")
def max_log_scales(spark, d):
    s = View(spark, d).history.scales
    ls = stats.log_scale
    return rounded(spark.createDataFrame([(ls(s.max_dst), ls(s.max_src), ls(s.max_pair), ls(s.max_recent80), ls(s.max_recent82), s.span)], "ld double, ls double, lp double, lr80 double, lr82 double, span double"))


@query(f"WITH {base_sql('new')}, m AS (SELECT dst, row_number() OVER (ORDER BY dst) AS id FROM (SELECT DISTINCT dst FROM h)) SELECT v.seq, coalesce(m.id, 0) AS id FROM v LEFT JOIN m USING (dst)")
def id_map(spark, d):
    v = View(spark, d)
    return v.valid.join(stats.id_map(v.train, "dst"), "dst", "left").select("seq", F.coalesce("id", F.lit(0)).cast("long").alias("id"))


@query(f"WITH {lists_sql('new')} SELECT dst, count(*) AS n FROM c GROUP BY dst")
def candidate_frequency(spark, d):
    return stats.candidate_frequency(View(spark, d).lists)


@query(f"WITH {base_sql('new')} SELECT dst, n, rank FROM (SELECT dst, n, row_number() OVER (ORDER BY n DESC, dst) AS rank FROM (SELECT dst, count(*) AS n FROM h GROUP BY dst)) WHERE rank <= 100")
def popular_topn(spark, d):
    counts = View(spark, d).train.groupBy("dst").agg(F.count("*").alias("n")).orderBy(F.desc("n"), "dst").limit(100)
    return counts.withColumn("rank", F.row_number().over(Window.orderBy(F.desc("n"), "dst")).cast("long"))


@query(f"WITH {base_sql('new')}, n AS (SELECT dst, count(*) AS n FROM h GROUP BY dst) SELECT dst, n FROM n WHERE n <= (SELECT quantile_cont(n, 0.35) FROM n)")
def lowpop_dsts(spark, d):
    counts = View(spark, d).train.groupBy("dst").agg(F.count("*").alias("n"))
    return counts.filter(F.col("n") <= order.exact_percentiles(counts, "n", [0.35])[0])


@query(f"WITH {base_sql('mid')}, b AS (SELECT * FROM (VALUES ('1', 1, 1), ('2-5', 2, 5), ('6-10', 6, 10), ('11-20', 11, 20), ('21-50', 21, 50), ('51-100', 51, 100), ('101-500', 101, 500), ('>500', 501, 1000000000000)) t(bucket, lo, hi)), n AS (SELECT dst, count(*) AS n FROM h GROUP BY dst), k AS (SELECT bucket, count(dst) AS n FROM b LEFT JOIN n ON n.n BETWEEN lo AND hi GROUP BY bucket) SELECT bucket, n, round(n / sum(n) OVER (), 6) AS share FROM k")
def pop_bucket_hist(spark, d):
    return rounded(stats.popularity_histogram(View(spark, d, "mid").train.groupBy("dst").agg(F.count("*").alias("n"))))


# Set operations

@query(f"WITH {base_sql('cold')} SELECT dst FROM v EXCEPT SELECT dst FROM h")
def cold_dsts(spark, d):
    v = View(spark, d, "cold")
    return v.valid.select("dst").distinct().join(v.train.select("dst").distinct(), "dst", "left_anti")


@query(f"WITH {base_sql('rep')} SELECT dst FROM v INTERSECT SELECT dst FROM h")
def known_test_dsts(spark, d):
    v = View(spark, d, "rep")
    return v.valid.select("dst").distinct().join(v.train.select("dst").distinct(), "dst", "left_semi")


@query(f"WITH {base_sql('mid')} SELECT src AS id FROM h UNION SELECT dst FROM v")
def vocabulary_union(spark, d):
    v = View(spark, d, "mid")
    return v.train.select(F.col("src").alias("id")).union(v.valid.select("dst")).distinct()


@query(f"WITH {base_sql('mid')} SELECT v.* FROM v WHERE NOT EXISTS (SELECT 1 FROM h WHERE h.src = v.src AND h.dst = v.dst)")
def unseen_pairs(spark, d):
    v = View(spark, d, "mid")
    return v.valid.join(v.train.select("src", "dst").distinct(), ["src", "dst"], "left_anti").select("src", "dst", "time", "seq")


# Sequences

@query(f"WITH {base_sql('rep')}, x AS (SELECT *, row_number() OVER (PARTITION BY src ORDER BY time DESC, dst DESC) AS r FROM h) SELECT src, dst AS last_dst, time AS last_time FROM x WHERE r = 1")
def last_dst(spark, d):
    return sequences.last_value(View(spark, d, "rep").train)


@query(f"WITH {base_sql('new')}, {scales_sql()} SELECT src, array_to_string(list(dst ORDER BY r DESC), ',') AS hist FROM lk WHERE r <= 20 GROUP BY src")
def last_k_history(spark, d):
    return sequences.last_k_lists(View(spark, d).train, 20).select("src", F.array_join(F.transform("hist", lambda x: x.cast("string")), ",").alias("hist"))


@query(f"WITH {base_sql('rep')}, x AS (SELECT *, lag(dst) OVER w AS prev, time - lag(time) OVER w AS gap FROM h WINDOW w AS (PARTITION BY src ORDER BY time, dst)) SELECT src, dst, time, prev, greatest(gap, 0) AS gap FROM x WHERE prev IS NOT NULL")
def previous_edges(spark, d):
    return sequences.with_previous(View(spark, d, "rep").train).filter("prev is not null").select("src", "dst", "time", "prev", "gap")


_LAG = "x AS (SELECT dst, lag(dst) OVER (PARTITION BY src ORDER BY time, dst) AS prev FROM h)"


@query(f"WITH {base_sql('mid')}, {_LAG} SELECT prev, dst AS next, count(*) AS n FROM x WHERE prev IS NOT NULL GROUP BY ALL")
def transition_counts(spark, d):
    return sequences.transitions(View(spark, d, "mid").train)


def _window_sql(view: str, width: int, weight: str, newest: int | None = None) -> str:
    limit = f"WHERE back <= {newest}" if newest else ""
    return f"""WITH {base_sql(view)}, y AS (SELECT *, row_number() OVER (PARTITION BY src ORDER BY time, dst) AS i, row_number() OVER (PARTITION BY src ORDER BY time DESC, dst DESC) AS back FROM h), z AS (SELECT * FROM y {limit}),
        w AS (SELECT a.dst AS prev, b.dst AS next, sum({weight}) AS w FROM z a JOIN z b ON a.src = b.src AND a.i < b.i AND b.i - a.i <= {width} WHERE a.dst <> b.dst GROUP BY ALL)"""


@query(_window_sql("rep", 8, "1.0 / (b.i - a.i)", 300) + " SELECT prev, next, round(w, 6) AS w FROM w")
def cooc_weights(spark, d):
    return rounded(sequences.window_pairs(View(spark, d, "rep").train, 8, "inverse", 300))


@query(_window_sql("mid", 16, "1.0 / sqrt(b.i - a.i)") + " SELECT prev, next, round(w, 6) AS w FROM w")
def window_transition_w16(spark, d):
    return rounded(sequences.window_pairs(View(spark, d, "mid").train, 16, "root"))


_NORM = """, n AS (SELECT dst, ln(1 + count(*)) AS l FROM h GROUP BY dst), f AS (SELECT prev, next, ln(1 + w) / greatest(sqrt(a.l * b.l), 1e-6) AS w FROM w JOIN n a ON a.dst = prev JOIN n b ON b.dst = next),
    f2 AS (SELECT *, row_number() OVER (PARTITION BY prev ORDER BY round(w, 9) DESC, next) AS r FROM f)"""


@query(_window_sql("mid", 16, "1.0 / sqrt(b.i - a.i)") + _NORM + " SELECT prev, next, round(w, 6) AS w FROM f2 WHERE r <= 50")
def norm_transition_topk(spark, d):
    train = View(spark, d, "mid").train
    counts = train.groupBy("dst").agg(F.count("*").alias("n"))
    return rounded(sequences.normalised(sequences.window_pairs(train, 16, "root"), counts, 50))


@query(f"WITH {base_sql('new')}, {scales_sql()} SELECT src, round(count(DISTINCT dst) / count(*), 6) AS coverage, round(least(count(*), 64) / 64.0, 6) AS fill FROM lk WHERE r <= 64 GROUP BY src")
def recent_coverage(spark, d):
    return rounded(sequences.coverage(View(spark, d).train, 64, 64))


@query(f"""WITH {base_sql('rep')}, x AS (SELECT *, list(dst) OVER w AS ids FROM h WINDOW w AS (PARTITION BY src ORDER BY time, dst ROWS BETWEEN 8 PRECEDING AND 1 PRECEDING))
    SELECT src, dst, time, array_to_string(list_concat(list_transform(range(0, 8 - len(ids)), lambda i: 0), ids), ',') AS ids FROM x WHERE len(ids) > 0""")
def history_sequences(spark, d):
    rows = sequences.training_sequences(View(spark, d, "rep").train, 8, 1.0)
    return rows.select("src", "dst", "time", F.array_join(F.transform("ids", lambda x: x.cast("string")), ",").alias("ids"))


# Candidate lists

@query(f"WITH {lists_sql('new')} SELECT qid, src, time, pos, dst, label FROM c")
def candidates_modular(spark, d):
    return View(spark, d).lists


def _draw(n: int, source: int = 9) -> str:
    return f"SELECT q.qid, q.src, q.time, {source} AS source, k AS place, vocab.dst FROM q, nv, (SELECT unnest(range(1, {n + 1})) AS k) ks JOIN vocab ON vocab.id = (q.qid * 7919 + k * 104729) % nv.n WHERE k <= greatest(1, least({n}, nv.n))"


_FIRST = "f AS (SELECT qid, src, time, dst, min(source * 1000000 + place) AS m FROM r GROUP BY ALL)"
_NUMBER = "CAST(row_number() OVER (PARTITION BY qid ORDER BY m, dst) - 1 AS INTEGER)"


@query(f"""WITH {lists_sql('new')}, {scales_sql()}, hot AS (SELECT dst, row_number() OVER (ORDER BY n DESC, dst) AS place FROM (SELECT dst, count(*) AS n FROM h GROUP BY dst)),
    r AS (SELECT qid, src, time, 0 AS source, 0 AS place, dst FROM q UNION ALL SELECT qid, q.src, q.time, 1, r, lk.dst FROM q JOIN lk ON lk.src = q.src AND r <= 5
        UNION ALL SELECT qid, src, time, 2, place, hot.dst FROM q, hot WHERE place <= 8 UNION ALL {_draw(40)}), {_FIRST},
    x AS (SELECT qid, src, time, {_NUMBER} AS pos, dst, m = 0 AS label FROM f) SELECT * FROM x WHERE pos < 20""")
def candidates_hard(spark, d):
    v = View(spark, d)
    return C.hard_lists(v.queries, v.train, 20, recent=5, hot=8)


@query(f"""WITH {lists_sql('mid')}, {scales_sql()}, hot AS (SELECT dst, row_number() OVER (ORDER BY n DESC, dst) AS place FROM (SELECT dst, count(*) AS n FROM h GROUP BY dst)),
    r0 AS (SELECT qid, src, time, 0 AS source, 0 AS place, dst FROM q UNION ALL SELECT qid, q.src, q.time, 1, r, lk.dst FROM q JOIN lk ON lk.src = q.src AND r <= 80
        UNION ALL SELECT qid, src, time, 2, place, hot.dst FROM q, hot WHERE place <= 80),
    f0 AS (SELECT qid, src, time, dst, min(source * 1000000 + place) AS m FROM r0 GROUP BY ALL), k0 AS (SELECT *, row_number() OVER (PARTITION BY qid ORDER BY m, dst) AS i FROM f0),
    r AS (SELECT qid, src, time, m // 1000000 AS source, m % 1000000 AS place, dst FROM k0 WHERE i <= CASE m // 1000000 WHEN 1 THEN 6 WHEN 2 THEN 14 ELSE 1000000 END UNION ALL {_draw(40)}), {_FIRST},
    x AS (SELECT qid, src, time, {_NUMBER} AS pos, dst, m = 0 AS label FROM f) SELECT * FROM x WHERE pos < 20""")
def candidates_filled(spark, d):
    v = View(spark, d, "mid")
    return C.filled_lists(v.queries, v.train, 20)


@query(f"WITH {base_sql('type')}, n AS (SELECT DISTINCT dst FROM h), r AS (SELECT seq AS qid, v.src, v.time, n.dst, v.dst AS y FROM v, n UNION SELECT seq, src, time, dst, dst FROM v) SELECT qid, src, time, CAST(row_number() OVER (PARTITION BY qid ORDER BY dst <> y, dst) - 1 AS INTEGER) AS pos, dst, dst = y AS label FROM r")
def candidates_all(spark, d):
    v = View(spark, d, "type")
    return C.all_lists(v.queries, v.train.select("dst"))


def _drawn(pool: str, n: str, source: int, seed: int = 0) -> str:
    """Draws from a pool (dst, id from 0)."""
    return f"SELECT q.qid, q.src, q.time, {source} AS source, k AS place, p.dst FROM q, (SELECT count(*) AS n FROM {pool}) z, (SELECT unnest(range(1, {int(n) + 1})) AS k) ks JOIN {pool} p ON p.id = (q.qid * 7919 + k * 104729 + {seed}) % z.n WHERE k <= greatest(1, least({n}, z.n))"


def _ids(rows: str) -> str:
    return f"(SELECT dst, row_number() OVER (ORDER BY dst) - 1 AS id FROM ({rows}))"


def _numbered(n: int) -> str:
    return f"{_FIRST}, x AS (SELECT qid, src, time, {_NUMBER} AS pos, dst, m = 0 AS label FROM f) SELECT * FROM x WHERE pos < {n}"


_POSITIVE = "SELECT qid, src, time, 0 AS source, 0 AS place, dst FROM q"
_HOT = "hot AS (SELECT dst, row_number() OVER (ORDER BY n DESC, dst) AS place FROM (SELECT dst, count(*) AS n FROM h GROUP BY dst))"


def _recent(k: int) -> str:
    return f"SELECT qid, q.src, q.time, 1 AS source, r AS place, lk.dst FROM q JOIN lk ON lk.src = q.src AND r <= {k}"


def _mixed_sql(view: str, n: int, mode: str) -> str:
    own, hot, seen, cold = (int(n * x) for x in C.MIXES[mode])
    parts = [_POSITIVE] + [_recent(own)] * (own > 0) + [f"SELECT qid, src, time, 2, place, hot.dst FROM q, hot WHERE place <= {hot}"] * (hot > 0)
    parts += [_drawn("seen", str(seen), 3, 11)] * (seen > 0) + [_drawn("cold", str(cold), 4, 13)] * (cold > 0) + [_drawn("known", str(2 * n), 9)]
    return f"""WITH {lists_sql(view)}, {scales_sql()}, {_HOT}, known AS {_ids('SELECT DISTINCT dst FROM h')}, seen AS {_ids('SELECT dst FROM v INTERSECT SELECT dst FROM h')}, cold AS {_ids('SELECT dst FROM v EXCEPT SELECT dst FROM h')},
        r AS ({' UNION ALL '.join(parts)}), {_numbered(n)}"""


for _mode in C.MIXES:
    query(_mixed_sql("cold", 20, _mode), "candidates_mixed" if _mode == "mixed" else f"candidates_mix_{_mode}")(lambda spark, d, m=_mode: C.mixed_lists((v := View(spark, d, "cold")).queries, v.train, v.valid.select("dst"), 20, m))


@query(f"""WITH {lists_sql('cold')}, {scales_sql()}, {_HOT}, hn AS (SELECT least(count(*), 80) AS n FROM hot), cold AS {_ids('SELECT dst FROM v EXCEPT SELECT dst FROM h')}, known AS {_ids('SELECT DISTINCT dst FROM h')},
    r AS ({_POSITIVE} UNION ALL {_recent(5)} UNION ALL SELECT qid, src, time, 2, (place + qid) % hn.n, hot.dst FROM q, hot, hn WHERE place <= 80 AND (place + qid) % hn.n < 5
        UNION ALL {_drawn('cold', '4', 3, 13)} UNION ALL {_drawn('known', '40', 9)}), {_numbered(20)}""")
def candidates_pairwise(spark, d):
    v = View(spark, d, "cold")
    return C.pairwise_negatives(v.queries, v.train, v.valid.select("dst"), 20)


#: A rule's parts over a joined row: the fast rule.
_FAST = f"CASE WHEN dn IS NULL THEN -8 ELSE 1.10 * ln(1 + coalesce(dn, 0)) / ld + 1.35 * ln(1 + coalesce(recent80, 0)) / lr80 + 0.55 * greatest(least(ln(1 + coalesce(recent80, 0)) - ln(1 + coalesce(older80, 0)), 5), -5) / 5 + 0.65 * CASE WHEN dlast IS NULL THEN 0 ELSE 1 / (1 + greatest(time - dlast, 0) / span) END + 0.12 * coalesce(1.0 / rr, 0) - 0.35 * CAST(pn IS NOT NULL AS DOUBLE) END"


def _pool_sql(view: str, size: int, n: int) -> str:
    """The wide pool, scored by the fast rule, of which the positive and the n hardest negatives stay."""
    base = lists_sql(view)
    return f"""{_window_sql(view, 16, '1.0 / sqrt(b.i - a.i)').replace(base_sql(view), base)}, {scales_sql()}, {_HOT}, late AS (SELECT dst, row_number() OVER (ORDER BY n DESC, dst) AS place FROM (SELECT dst, count(*) AS n FROM h WHERE time >= (SELECT p80 FROM sc0) GROUP BY dst)),
        cnt AS (SELECT dst, count(*) AS n FROM h GROUP BY dst), rare AS {_ids('SELECT dst FROM cnt WHERE n <= (SELECT quantile_cont(n, 0.40) FROM cnt)')}, known AS {_ids('SELECT DISTINCT dst FROM h')},
        tt AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY prev ORDER BY round(w, 9) DESC, next) AS tr FROM w) WHERE tr <= 40),
        r AS ({_POSITIVE} UNION ALL {_recent(120)} UNION ALL SELECT qid, q.src, q.time, 2, lk.r * 100 + tr, tt.next FROM q JOIN lk ON lk.src = q.src AND lk.r <= 24 JOIN tt ON tt.prev = lk.dst
            UNION ALL SELECT qid, src, time, 3, place, late.dst FROM q, late WHERE place <= 160 UNION ALL SELECT qid, src, time, 4, place, hot.dst FROM q, hot WHERE place <= 160
            UNION ALL {_drawn('rare', '120', 5, 17)} UNION ALL {_drawn('known', str(size), 9)}), {_FIRST},
        po AS (SELECT * FROM (SELECT qid, src, time, {_NUMBER} AS pos, dst, m = 0 AS label FROM f) WHERE pos < {size}), rk AS (SELECT src, dst, min(r) AS r FROM lk WHERE r <= 200 GROUP BY ALL),
        j AS (SELECT po.*, d.n AS dn, d.recent80, d.older80, d.last AS dlast, p.n AS pn, rk.r AS rr FROM po LEFT JOIN d USING (dst) LEFT JOIN p ON p.src = po.src AND p.dst = po.dst LEFT JOIN rk ON rk.src = po.src AND rk.dst = po.dst),
        g AS (SELECT qid, src, time, pos, dst, label, row_number() OVER (PARTITION BY qid, label ORDER BY round({_FAST}, 9) DESC, dst) AS place FROM j, (SELECT ld, lr80, span FROM sc))
        SELECT qid, src, time, pos, dst, label FROM g WHERE label OR place <= {n}"""


@query(_pool_sql("rep", 700, 99))
def candidates_wide_pool(spark, d):
    """700 for each query, of which the 99 hardest by the rule stay."""
    v = View(spark, d, "rep")
    pool = C.wide_pool(v.queries, v.train, sequences.window_pairs(v.train, 16, "root"), v.history.scales.p80)
    return C.hardest(scoring.fast_rule(pool, v.history), "score").select("qid", "src", "time", "pos", "dst", "label")


_BUCKET = "CASE " + " ".join(f"WHEN n BETWEEN {low} AND {high} THEN '{name}'" for name, low, high in S.POP_BUCKETS) + " END"


@query(f"""WITH {lists_sql('mid')}, {scales_sql()}, {_LAG.replace('x AS', 'lg AS')}, tn AS (SELECT prev, dst AS next, count(*) AS n FROM lg WHERE prev IS NOT NULL GROUP BY ALL),
    tt AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY prev ORDER BY n DESC, next) AS tr FROM tn) WHERE tr <= 4), seen AS (SELECT DISTINCT src, dst FROM h), known AS {_ids('SELECT DISTINCT dst FROM h')},
    own AS (SELECT * FROM (SELECT q.qid, q.src, q.time, 1 AS source, row_number() OVER (PARTITION BY q.qid ORDER BY (q.qid * 7919 + seen.dst * 104729) % 1009, seen.dst) AS place, seen.dst FROM q JOIN seen ON seen.src = q.src AND seen.dst <> q.dst) WHERE place <= 3),
    cb AS (SELECT dst, {_BUCKET} AS bucket FROM (SELECT dst, count(*) AS n FROM h GROUP BY dst)), bk AS (SELECT bucket, row_number() OVER (ORDER BY bucket) - 1 AS k, count(*) OVER () AS nb FROM (SELECT DISTINCT bucket FROM cb)),
    bi AS (SELECT cb.dst, bk.k AS b, greatest(40 // nb, 1) AS quota, row_number() OVER (PARTITION BY bk.k ORDER BY cb.dst) - 1 AS id, count(*) OVER (PARTITION BY bk.k) AS size FROM cb JOIN bk USING (bucket)),
    dr AS (SELECT q.qid, q.src, q.time, 3 AS source, ks.k AS place, bi.dst FROM q, (SELECT unnest(range(1, 61)) AS k) ks, bi WHERE ks.k <= greatest(1, least(quota, size)) AND bi.id = (q.qid * 7919 + ks.k * 104729 + 19 * b) % size),
    r0 AS (SELECT qid, q.src, q.time, 2 AS source, tr AS place, tt.next AS dst FROM q JOIN lk ON lk.src = q.src AND lk.r = 1 JOIN tt ON tt.prev = lk.dst UNION ALL SELECT * FROM dr UNION ALL {_drawn('known', '60', 9)}),
    r AS ({_POSITIVE} UNION ALL SELECT * FROM own UNION ALL SELECT * FROM r0 WHERE NOT EXISTS (SELECT 1 FROM seen WHERE seen.src = r0.src AND seen.dst = r0.dst)), {_numbered(20)}""")
def candidates_bucketed(spark, d):
    v = View(spark, d, "mid")
    return C.bucketed_lists(v.queries, v.train, sequences.transitions(v.train), 20, 3, 4)


@query(f"""WITH {lists_sql('mid')}, tp AS (SELECT qid, src, list(dst ORDER BY pos) AS cand FROM c WHERE qid % 7 = 0 GROUP BY ALL), t AS (SELECT src, cand, row_number() OVER (PARTITION BY src ORDER BY qid) - 1 AS i, count(*) OVER (PARTITION BY src) AS m FROM tp),
    ts AS (SELECT DISTINCT src, m FROM t), e2 AS (SELECT q.*, ts.m, row_number() OVER (PARTITION BY q.src ORDER BY q.qid) - 1 AS turn FROM q LEFT JOIN ts ON ts.src = q.src),
    ti AS (SELECT cand, row_number() OVER (ORDER BY qid) - 1 AS id, count(*) OVER () AS n FROM tp),
    rw AS (SELECT e2.qid, e2.src, e2.time, e2.dst, t.cand, true AS same_src FROM e2 JOIN t ON t.src = e2.src AND t.i = e2.turn % e2.m UNION ALL SELECT e2.qid, e2.src, e2.time, e2.dst, ti.cand, false FROM e2 JOIN ti ON ti.id = (e2.qid * 7919) % ti.n WHERE e2.m IS NULL),
    lg AS (SELECT qid, src, time, dst AS positive, same_src, unnest(cand) AS dst, generate_subscripts(cand, 1) - 1 AS pos FROM rw), kn AS (SELECT lg.*, EXISTS (SELECT 1 FROM h WHERE h.dst = lg.dst) AS known FROM lg),
    pt AS (SELECT *, max(CAST(dst = positive AS INTEGER)) OVER (PARTITION BY qid) AS there, row_number() OVER (PARTITION BY qid ORDER BY known DESC, (qid * 7919 + pos * 104729) % 1009, pos) AS choice FROM kn)
    SELECT qid, src, time, CAST(pos AS INTEGER) AS pos, CASE WHEN there = 0 AND choice = 1 THEN positive ELSE dst END AS dst, (there = 0 AND choice = 1) OR dst = positive AS label, same_src FROM pt""")
def candidates_injected(spark, d):
    """Edges put into the lists of a seventh of the queries, which stand for the tests': sources without one get another's."""
    v = View(spark, d, "mid")
    templates = v.lists.filter(F.col("qid") % 7 == 0).groupBy("qid", "src").agg(F.array_sort(F.collect_list(F.struct("pos", "dst"))).alias("c")).select("qid", "src", F.transform("c", lambda x: x["dst"]).alias("candidates"))
    return C.injected(v.queries, templates, v.train)


@query(f"WITH {base_sql('new')}, {scales_sql()}, x AS (SELECT src, dst, min(r) AS r FROM lk WHERE r <= 40 GROUP BY ALL), y AS (SELECT src, dst, row_number() OVER (PARTITION BY src ORDER BY r) AS place FROM x) SELECT * FROM y WHERE place <= 10")
def hard_negative_table(spark, d):
    rows = C.hard_negative_tables(View(spark, d).train, 10)[0]
    return rows.withColumn("place", F.col("place").cast("long"))


# Features

def _joined_sql(view: str, recent: int = 200) -> str:
    return f"""{lists_sql(view)}, {scales_sql()}, rk AS (SELECT src, dst, min(r) AS r FROM lk WHERE r <= {recent} GROUP BY ALL),
        j AS (SELECT c.*, d.n AS dn, d.recent80, d.older80, d.recent82, d.mid82, d.older82, d.last AS dlast, d.recent20, d.recent10, d.recent05, d.sources, p.n AS pn, p.recent20 AS precent, p.last AS plast, s.n AS sn, rk.r AS rr
            FROM c LEFT JOIN d USING (dst) LEFT JOIN p ON p.src = c.src AND p.dst = c.dst LEFT JOIN s ON s.src = c.src LEFT JOIN rk ON rk.src = c.src AND rk.dst = c.dst)"""


def _z(x: str) -> str:
    return f"CASE WHEN stddev_pop({x}) OVER w < 1e-6 THEN 0 ELSE ({x} - avg({x}) OVER w) / stddev_pop({x}) OVER w END"


def _rank(x: str) -> str:
    return f"1.0 / row_number() OVER (PARTITION BY qid ORDER BY round({x}, 9) DESC, pos)"


def _lp(x: str) -> str:
    return f"ln(1 + coalesce({x}, 0))"


def _rule18_sql(view: str) -> str:
    return f"""{_joined_sql(view)}, a AS (SELECT qid, src, time, pos, dst, label, {_lp('dn')} / ld AS pop, {_lp('recent80')} / ld AS recent_pop,
        greatest(least({_lp('recent80')} - {_lp('older80')}, 5), -5) / 5 AS trend, CASE WHEN dlast IS NULL THEN 0 ELSE 1 / (1 + greatest(time - dlast, 0) / span) END AS recency, coalesce(1.0 / rr, 0) AS src_recent_score,
        CAST(pn IS NOT NULL AS DOUBLE) AS pair_seen, {_lp('pn')} / lp AS pair_count, {_lp('sn')} / ls AS src_degree, {_lp('least(coalesce(sn, 0), 200)')} / ls AS src_hist_len, {_lp('dn')} / ld AS dst_degree,
        CAST(dn IS NOT NULL AS DOUBLE) AS dst_seen, CAST(sn IS NOT NULL AS DOUBLE) AS src_seen, CASE WHEN dn IS NULL THEN 1 ELSE ln(1 + greatest(time - dlast, 0)) / ln(1 + span) END AS dst_time_gap,
        CAST(dn IS NULL AS DOUBLE) AS dst_unknown FROM j, (SELECT ld, ls, lp, span FROM sc)),
        b AS (SELECT *, 1.10 * pop + 1.35 * recent_pop + 0.55 * trend + 0.65 * recency + 0.12 * src_recent_score - 0.35 * pair_seen - 8 * dst_unknown AS rule_score FROM a),
        f18 AS (SELECT *, {_rank('rule_score')} AS rank_rule, {_rank('pop')} AS rank_pop, {_rank('src_recent_score + recency')} AS rank_recent FROM b)"""


@query(f"WITH {_rule18_sql('new')} SELECT qid, src, time, pos, dst, label, {r6(*features.RULE18)} FROM f18")
def features_rule18(spark, d):
    v = View(spark, d)
    return rounded(features.rule18(v.lists, v.history))


_M = "CASE WHEN max({0}) OVER w - min({0}) OVER w < 1e-6 THEN 0 ELSE ({0} - min({0}) OVER w) / (max({0}) OVER w - min({0}) OVER w) END"


@query(f"""WITH {_rule18_sql('mid')}, x AS (SELECT qid, pos, dst, {', '.join(f'{_z(c)} AS {n}' for n, c in (('z_rule', 'rule_score'), ('z_pop', 'pop'), ('z_recent_pop', 'recent_pop'), ('z_trend', 'trend'), ('z_recency', 'recency'), ('z_src_recent', 'src_recent_score'), ('z_dst_gap', 'dst_time_gap')))},
    {_M.format('rule_score')} AS m_rule, {_M.format('pop')} AS m_pop, {_M.format('recent_pop')} AS m_recent_pop, ln(1 + greatest(dst, 0)) / greatest(ln(1 + greatest(max(dst) OVER w, 1)), 1) AS candidate_log_id, dst % 997 / 996.0 AS candidate_id_bucket,
    avg(dst_unknown) OVER w AS unknown_frac, 1 - avg(dst_unknown) OVER w AS known_frac, max(rule_score) OVER w AS rule_max, max(rule_score) OVER w - min(rule_score) OVER w AS rule_spread, greatest(least((time - low) / span, 1.5), 0) AS time_pos
    FROM f18, (SELECT low, span FROM sc) WINDOW w AS (PARTITION BY qid)) SELECT qid, pos, dst, {r6(*features.LISTWISE)} FROM x""")
def features_listwise_extra(spark, d):
    v = View(spark, d, "mid")
    rows = features.listwise_extras(features.rule18(v.lists, v.history), v.history)
    return rounded(rows.select("qid", "pos", "dst", *features.LISTWISE))


_G21 = [f for f in features.GRAPH21 if f not in ("svd", "profile", "rank_svd", "rank_profile")]


@query(f"""WITH {_joined_sql('mid', 160)}, {_window_sql('mid', 16, '1.0 / sqrt(b.i - a.i)').split('AS (SELECT * FROM e WHERE seq >', 1)[1].split('),', 1)[1]}{_NORM}, t AS (SELECT prev, next, w FROM f2 WHERE r <= 256),
    hop AS (SELECT lk.src, t.next AS dst, sum(t.w / sqrt(lk.r)) AS hop FROM lk JOIN t ON t.prev = lk.dst JOIN (SELECT DISTINCT src, dst FROM c) o ON o.src = lk.src AND o.dst = t.next WHERE lk.r <= 24 GROUP BY ALL),
    tf AS (SELECT dst, count(*) AS tn FROM c GROUP BY dst),
    a AS (SELECT j.qid, j.src, j.time, j.pos, j.dst, j.label, {_lp('dn')} / ld AS pop, {_lp('recent82')} / lr82 AS recent_pop, greatest(least({_lp('recent82')} - ln(1 + coalesce(mid82, 0) + coalesce(older82, 0) * 0.25), 5), -5) / 5 AS trend,
        CASE WHEN dlast IS NULL THEN 0 ELSE 1 / (1 + greatest(j.time - dlast, 0) / span) END AS recency, coalesce(1 / sqrt(rr), 0) AS src_recent_exact, {_lp('pn')} / lp AS pair_log, CAST(dn IS NOT NULL AS DOUBLE) AS dst_known,
        {_lp('tn')} / greatest(ln(1 + (SELECT max(tn) FROM tf)), 1) AS candidate_seen_in_test, coalesce(hop, 0) AS transition
        FROM j LEFT JOIN hop ON hop.src = j.src AND hop.dst = j.dst LEFT JOIN tf ON tf.dst = j.dst, (SELECT ld, lp, lr82, span FROM sc)),
    b AS (SELECT *, least(pop, 0.72) AS degree_cap FROM a), g AS (SELECT *, degree_cap + 1.15 * recent_pop + 0.50 * trend + 0.65 * recency + 0.10 * transition - 0.28 * pair_log - 0.08 * src_recent_exact - 0.80 * (1 - dst_known) AS rule FROM b),
    k AS (SELECT *, {_rank('rule')} AS rank_rule, {_rank('pop')} AS rank_pop, {_rank('recent_pop')} AS rank_recent_pop, {_rank('pair_log')} AS rank_pair, {_rank('recency')} AS rank_recency, {_rank('transition')} AS rank_transition FROM g)
    SELECT qid, pos, dst, label, {r6(*_G21)} FROM k""")
def features_graph21_core(spark, d):
    v = View(spark, d, "mid", sourced=True)
    return rounded(features.graph21(v.lists, v.history).select("qid", "pos", "dst", "label", *_G21))


_CN = """lp2 AS (SELECT src, dst, max(time) AS t FROM h GROUP BY ALL), o2 AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY src ORDER BY t DESC, dst) AS r FROM lp2) WHERE r <= 256),
    i2 AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY dst ORDER BY t DESC, src) AS r FROM lp2) WHERE r <= 256), dg AS (SELECT node, count(*) AS degree FROM (SELECT src AS node FROM o2 UNION ALL SELECT dst FROM i2) GROUP BY node),
    cn AS (SELECT own.src, own.dst, own.time, ln(1 + sum(y)) AS temporal_cn, ln(1 + sum(y / ln(2.0 + degree))) AS temporal_aa, ln(1 + sum(y / (1.0 + degree))) AS temporal_ra
        FROM (SELECT own.src, own.dst, own.time, degree, exp(-0.02 * greatest(own.time - greatest(o2.t, i2.t), 0) / span * 100) AS y FROM (SELECT DISTINCT src, dst, time FROM c) own JOIN o2 ON o2.src = own.src JOIN i2 ON i2.dst = own.dst AND i2.src = o2.dst JOIN dg ON dg.node = o2.dst, (SELECT span FROM sc)) own GROUP BY ALL)"""


@query(f"WITH {lists_sql('rep')}, {scales_sql()}, {_CN} SELECT src, dst, time, {r6('temporal_cn', 'temporal_aa', 'temporal_ra')} FROM cn")
def structure_cn_aa_ra(spark, d):
    v = View(spark, d, "rep")
    return rounded(features.common_neighbours(v.lists, v.history))


def _builder_sql() -> str:
    hop = lambda n, t: f"hop_{n} AS (SELECT lk.src, {t}.next AS dst, sum(ln(1 + {t}.w) * pow(lk.r, -0.7)) AS hop, count(*) AS hits FROM lk JOIN {t} ON {t}.prev = lk.dst JOIN (SELECT DISTINCT src, dst FROM c) o ON o.src = lk.src AND o.dst = {t}.next WHERE lk.r <= 100 GROUP BY ALL)"
    prune = lambda n, x: f"{n} AS (SELECT prev, next, w FROM (SELECT *, row_number() OVER (PARTITION BY prev ORDER BY round(w, 9) DESC, next) AS r FROM {x}) WHERE r <= 300)"
    decay = lambda n, last, beta: f"coalesce(CASE WHEN {n} > 0 THEN ln(1 + {n}) * exp(-{beta} * greatest(j.time - {last}, 0) / span * 100) END, 0)"
    gap = lambda x: f"coalesce(ln(1 + greatest(j.time - {x}, 0)), 0)"
    rec = lambda x: f"CASE WHEN {x} IS NULL THEN 0 ELSE 1 / (1 + greatest(j.time - {x}, 0) / span * 20) END"
    return f"""{_joined_sql('rep', 100)}, {_CN}, y AS (SELECT *, row_number() OVER (PARTITION BY src ORDER BY time, dst) AS i, row_number() OVER (PARTITION BY src ORDER BY time DESC, dst DESC) AS back, lag(dst) OVER (PARTITION BY src ORDER BY time, dst) AS prv FROM h),
        tn AS (SELECT prv AS prev, dst AS next, CAST(count(*) AS DOUBLE) AS w FROM y WHERE prv IS NOT NULL GROUP BY ALL), tr AS (SELECT next AS prev, prev AS next, w FROM tn), z AS (SELECT * FROM y WHERE back <= 300),
        co AS (SELECT a.dst AS prev, b.dst AS next, sum(1.0 / (b.i - a.i)) AS w FROM z a JOIN z b ON a.src = b.src AND a.i < b.i AND b.i - a.i <= 8 WHERE a.dst <> b.dst GROUP BY ALL), cr AS (SELECT next AS prev, prev AS next, w FROM co),
        {prune('t', 'tn')}, {prune('rt', 'tr')}, {prune('cc', 'co')}, {prune('rc', 'cr')}, {hop('t', 't')}, {hop('rt', 'rt')}, {hop('c', 'cc')}, {hop('rc', 'rc')},
        ld AS (SELECT src, dst AS last_dst FROM lk WHERE r = 1), sm AS (SELECT src, dst, count(*) AS mn, sum(pow(r, -0.7)) AS md FROM lk WHERE r <= 100 GROUP BY ALL), u20 AS (SELECT src, count(DISTINCT dst) AS u FROM lk WHERE r <= 20 GROUP BY src),
        ss AS (SELECT src, count(DISTINCT dst) AS uq, 1.0 - count(DISTINCT dst) / count(*) AS rp, coalesce(avg(g), 0) AS gp FROM (SELECT *, CASE WHEN g0 IS NOT NULL THEN greatest(g0, 0) END AS g FROM (SELECT *, time - lag(time) OVER (PARTITION BY src ORDER BY time, dst) AS g0 FROM h)) GROUP BY src),
        f45 AS (SELECT j.qid, j.pos, j.dst, j.label, 1.0 AS bias, CAST(pn IS NOT NULL AS DOUBLE) AS has_pair, CAST(pn IS NULL AS DOUBLE) AS is_new_pair, {_lp('pn')} AS pair_count, {_lp('precent')} AS pair_recent_count, {rec('plast')} AS pair_recency, {gap('plast')} AS pair_time_gap,
            {decay('pn', 'plast', 0.02)} AS edge_decay, {', '.join(f'CAST(coalesce(rr <= {k}, false) AS DOUBLE) AS in_recent_{k}' for k in (5, 10, 20, 50))}, {_lp('mn')} AS recent_count, coalesce(md, 0) AS recent_decay_count, coalesce(1.0 / rr, 0) AS recent_rank_score,
            CAST(coalesce(ld.last_dst = j.dst, false) AS DOUBLE) AS is_last_dst, CAST(dn IS NOT NULL AS DOUBLE) AS dst_seen, {_lp('dn')} AS dst_popularity, {_lp('j.recent20')} AS dst_recent_popularity, {_lp('recent10')} AS dst_recent_popularity_10, {_lp('recent05')} AS dst_recent_popularity_05,
            {decay('dn', 'dlast', 0.01)} AS dst_pop_decay, {_lp('j.recent20')} - ln(1 + coalesce(dn, 0) - coalesce(j.recent20, 0)) AS dst_trend, {_lp('recent10')} - ln(1 + coalesce(dn, 0) - coalesce(recent10, 0)) AS dst_trend_10,
            {_lp('sn')} AS src_activity, {_lp('uq')} AS src_unique_dst, {_lp('u')} AS src_recent_unique_20, coalesce(rp, 0) AS src_repeat_rate, {_lp('gp')} AS src_avg_gap, CAST(dn IS NULL AS DOUBLE) AS is_cold_dst, {rec('dlast')} AS dst_recency, {gap('dlast')} AS dst_time_gap, {_lp('sources')} AS dst_unique_src,
            {_lp('l1.w')} AS last_transition, {_lp('l2.w')} AS last_reverse_transition, {_lp('l3.w')} AS last_cooc, coalesce(ht.hop, 0) AS recent_transition_score, coalesce(hr.hop, 0) AS reverse_recent_transition_score, {_lp('ht.hits')} AS recent_transition_hits,
            coalesce(hc.hop, 0) AS recent_cooc_score, coalesce(hrc.hop, 0) AS reverse_recent_cooc_score, {_lp('hc.hits')} AS recent_cooc_hits, coalesce(temporal_cn, 0) AS temporal_cn, coalesce(temporal_aa, 0) AS temporal_aa, coalesce(temporal_ra, 0) AS temporal_ra
            FROM j LEFT JOIN ld ON ld.src = j.src LEFT JOIN sm ON sm.src = j.src AND sm.dst = j.dst LEFT JOIN u20 ON u20.src = j.src LEFT JOIN ss ON ss.src = j.src LEFT JOIN cn ON cn.src = j.src AND cn.dst = j.dst AND cn.time = j.time
            LEFT JOIN t l1 ON l1.prev = ld.last_dst AND l1.next = j.dst LEFT JOIN rt l2 ON l2.prev = ld.last_dst AND l2.next = j.dst LEFT JOIN cc l3 ON l3.prev = ld.last_dst AND l3.next = j.dst
            LEFT JOIN hop_t ht ON ht.src = j.src AND ht.dst = j.dst LEFT JOIN hop_rt hr ON hr.src = j.src AND hr.dst = j.dst LEFT JOIN hop_c hc ON hc.src = j.src AND hc.dst = j.dst LEFT JOIN hop_rc hrc ON hrc.src = j.src AND hrc.dst = j.dst, (SELECT span FROM sc))"""


def _builder(spark, d) -> DataFrame:
    v = View(spark, d, "rep")
    return features.builder45(v.lists, v.history)


@query(f"WITH {_builder_sql()} SELECT qid, pos, dst, label, {r6(*features.BUILDER45)} FROM f45")
def features_builder45(spark, d):
    return rounded(_builder(spark, d).select("qid", "pos", "dst", "label", *features.BUILDER45))


@query(f"""WITH {base_sql('new')}, {scales_sql()}, o AS (SELECT DISTINCT dst FROM e) SELECT o.dst, {', '.join(f'round({x}, 6) AS {n}' for x, n in ((_lp('n') + ' / ld', 'total_log'), (_lp('recent80') + ' / lr80', 'recent_log'), (f"greatest(least({_lp('recent80')} - {_lp('older80')}, 5), -5) / 5", 'trend'),
    ('1 / (1 + greatest(high - coalesce(last, low), 0) / span)', 'recency'), (_lp('recent_sources') + ' / greatest(ln(1 + (SELECT max(recent_sources) FROM d)), 1)', 'source_log'), ('ln(1 + o.dst) / greatest(ln(1 + (SELECT max(dst) FROM o)), 1)', 'log_id'), ('o.dst % 997 / 996.0', 'id_bucket')))}, 1.0::DOUBLE AS one
    FROM o LEFT JOIN d USING (dst), (SELECT ld, lr80, low, high, span FROM sc)""")
def dst_feature_table(spark, d):
    v = View(spark, d)
    return rounded(features.dst_table(v.history, v.edges.select("dst")))


def _block_sql() -> str:
    z = lambda x: f"({x} - avg({x}) OVER w) / CASE WHEN stddev_pop({x}) OVER w < 1e-6 THEN 1 ELSE stddev_pop({x}) OVER w END"
    return f"""WITH {lists_sql('mid')}, {_LAG}, {scales_sql()}, tr AS (SELECT prev, dst AS next, count(*) AS t FROM x WHERE prev IS NOT NULL GROUP BY ALL), ld AS (SELECT src, dst AS prev FROM lk WHERE r = 1),
        dd AS (SELECT dst, count(*) AS n, count(*) FILTER (seq > (SELECT max(seq) FROM h) - 5000) AS r FROM h GROUP BY dst),
        a AS (SELECT c.qid, c.pos, c.dst, c.label, {_lp('dd.n')} AS pop, {_lp('dd.r')} AS recent, {_lp('tr.t')} AS transition FROM c LEFT JOIN ld ON ld.src = c.src LEFT JOIN dd ON dd.dst = c.dst LEFT JOIN tr ON tr.prev = ld.prev AND tr.next = c.dst),
        b AS (SELECT *, {z('pop')} + {z('recent')} + {z('transition')} AS rule FROM a WINDOW w AS (PARTITION BY qid)) SELECT qid, pos, dst, label, {r6('pop', 'recent', 'transition', 'rule')} FROM b"""


@query(_block_sql())
def features_block_rule(spark, d):
    v = View(spark, d, "mid")
    return rounded(features.block_rule(v.lists, v.train, 5000).select("qid", "pos", "dst", "label", "pop", "recent", "transition", "rule"))


# Scores and fusion

def _linear_sql(weights: dict[str, float]) -> str:
    return " + ".join(f"({w}) * {f}" for f, w in weights.items() if w)


for _name, _weights in (("rule_repeat", scoring.REPEAT_EDGE), ("rule_newlink", scoring.NEW_LINK)):
    query(f"WITH {_builder_sql()} SELECT qid, pos, dst, round({_linear_sql(_weights)}, 6) AS score FROM f45", _name)(
        lambda spark, d, w=_weights: rounded(_builder(spark, d).select("qid", "pos", "dst", scoring.linear(w).alias("score")))
    )


def _base_sql(regime: str) -> str:
    parts = {p: f"({_linear_sql(w)})" for p, w in scoring.PARTS.items()} | {"rule": f"({_linear_sql(scoring.RULES[regime])})"}
    base = " + ".join(f"({w}) * {parts[p]}" for p, w in scoring.BASE[regime].items())
    return f"bi AS (SELECT qid, pos, dst, label, is_cold_dst, {parts['rule']} AS rule, {base} AS base FROM f45)"


@query(f"WITH {_builder_sql()}, {_base_sql('dataset2')} SELECT qid, pos, dst, {r6('rule', 'base')} FROM bi")
def base_intensity(spark, d):
    return rounded(scoring.base_intensity(_builder(spark, d), "dataset2").select("qid", "pos", "dst", "rule", "base"))


def _zg(x: str) -> str:
    return f"({x} - avg({x}) OVER w) / CASE WHEN stddev_pop({x}) OVER w < 1e-6 THEN 1 ELSE stddev_pop({x}) OVER w END"


@query(f"WITH {_builder_sql()}, {_base_sql('dataset1')}, fi AS (SELECT *, 0.55 * {_zg('base')} + 0.15 * {_zg('rule')} - 0.05 * is_cold_dst AS final FROM bi WINDOW w AS (PARTITION BY qid)), ex AS (SELECT *, exp(final - max(final) OVER (PARTITION BY qid)) AS x FROM fi) SELECT qid, pos, dst, round(final, 6) AS final, round(x / sum(x) OVER (PARTITION BY qid), 6) AS prob FROM ex")
def repeat_final(spark, d):
    rows = scoring.repeat_final(scoring.base_intensity(_builder(spark, d), "dataset1"))
    return rounded(rows.select("qid", "pos", "dst", "final", "prob"))


@query(f"WITH {_joined_sql('cold')} SELECT qid, src, time, pos, dst, label, round({_FAST}, 6) AS score FROM j, (SELECT ld, lr80, span FROM sc)")
def fast_rule(spark, d):
    v = View(spark, d, "cold")
    return rounded(scoring.fast_rule(v.lists, v.history))


@query(f"WITH {_joined_sql('mid')} SELECT qid, src, time, pos, dst, label, round(coalesce(3.0 / rr, 0) + CASE WHEN dlast IS NULL THEN 0 ELSE 1 / (1 + greatest(time - dlast, 0) / span) END, 6) AS score FROM j, (SELECT span FROM sc)")
def recency_score(spark, d):
    v = View(spark, d, "mid")
    return rounded(scoring.recency_score(v.lists, v.history))


def _rule18(spark, d, view="new") -> DataFrame:
    v = View(spark, d, view, sourced=True)
    return features.rule18(v.lists, v.history)


@query(f"WITH {_rule18_sql('new')}, x AS (SELECT *, 0.7 * ({_zg('rule_score')}) + 0.3 * ({_zg('recency')}) AS fused FROM f18 WINDOW w AS (PARTITION BY qid)) SELECT qid, pos, dst, round(fused, 6) AS fused FROM x")
def zscore_fusion(spark, d):
    return rounded(scoring.fused(_rule18(spark, d), {"rule_score": 0.7, "recency": 0.3}).select("qid", "pos", "dst", "fused"))


_UNKNOWN = "u AS (SELECT qid, pos, dst, rule_score + 8 * dst_unknown AS raw, CASE WHEN dst % 3 = 0 THEN 1.0 ELSE dst_unknown END AS dst_unknown FROM f18)"
_PRIOR = "pr AS (SELECT *, CASE WHEN dst_unknown > 0.5 THEN 1 ELSE 0.25 END * greatest(least((ln(1 + dst) - avg(ln(1 + dst)) OVER w) / greatest(max(ln(1 + dst)) OVER w - min(ln(1 + dst)) OVER w, 1e-6), 1), -1) AS prior FROM u WINDOW w AS (PARTITION BY qid))"


def _unknowns(spark, d) -> DataFrame:
    """Every third destination counts as unknown, so that each policy has work to do."""
    rows = _rule18(spark, d)
    return rows.select("qid", "pos", "dst", (F.col("rule_score") + 8 * F.col("dst_unknown")).alias("raw"), F.when(F.col("dst") % 3 == 0, 1.0).otherwise(F.col("dst_unknown")).alias("dst_unknown"))


_POLICY = {
    "neutral": "raw", "mild_penalty": "CASE WHEN dst_unknown > 0.5 THEN raw - 5 ELSE raw END", "constant": "CASE WHEN dst_unknown > 0.5 THEN -8.0 ELSE raw END",
    "boost_by_id_prior": "raw + CASE WHEN max(dst_unknown) OVER w > 0.5 THEN 0.25 * prior ELSE 0 END",
    "demote": "CASE WHEN dst_unknown > 0.5 THEN CASE WHEN min(dst_unknown) OVER w > 0.5 THEN 0 ELSE least(-8.0, min(CASE WHEN dst_unknown <= 0.5 THEN raw END) OVER w - 5) END ELSE raw END",
}
for _policy, _expr in _POLICY.items():
    query(f"WITH {_rule18_sql('new')}, {_UNKNOWN}, {_PRIOR} SELECT qid, pos, dst, round({_expr}, 6) AS adjusted FROM pr WINDOW w AS (PARTITION BY qid)", f"unknown_{_policy}")(
        lambda spark, d, p=_policy: rounded(scoring.with_unknown_policy(_unknowns(spark, d), "raw", p).select("qid", "pos", "dst", "adjusted"))
    )


@query(f"WITH {_rule18_sql('new')}, {_UNKNOWN} SELECT qid, pos, dst, round(CASE WHEN min(dst_unknown) OVER w > 0.5 THEN 0 WHEN dst_unknown > 0.5 THEN min(CASE WHEN dst_unknown <= 0.5 THEN raw END) OVER w - 1 ELSE raw END, 6) AS adjusted FROM u WINDOW w AS (PARTITION BY qid)")
def unknown_fallback(spark, d):
    return rounded(scoring.unseen_fallback(_unknowns(spark, d), "raw").select("qid", "pos", "dst", "adjusted"))


@query(f"WITH {_rule18_sql('new')}, {_UNKNOWN}, {_PRIOR} SELECT qid, pos, dst, round(prior, 6) AS prior FROM pr")
def cold_id_prior(spark, d):
    return rounded(_unknowns(spark, d).select("qid", "pos", "dst", scoring.cold_prior().alias("prior")))


_SOFT = "ex AS (SELECT *, exp(rule_score - max(rule_score) OVER (PARTITION BY qid)) AS x FROM f18), pb AS (SELECT qid, src, time, pos, dst, label, x / sum(x) OVER (PARTITION BY qid) AS prob FROM ex)"


def _probs(spark, d, view: str = "new") -> DataFrame:
    return windows.softmax(_rule18(spark, d, view), "rule_score", key=features.OWN).select("qid", "src", "time", "pos", "dst", "label", "prob")


@query(f"WITH {_rule18_sql('new')}, {_SOFT} SELECT qid, src, time, pos, dst, label, round(prob, 6) AS prob FROM pb")
def softmax_probs(spark, d):
    return rounded(_probs(spark, d))


@query(f"WITH {_rule18_sql('new')}, z AS (SELECT qid, pos, dst, label, {_zg('rule_score')} AS a, {_zg('recent_pop')} AS b FROM f18 WINDOW w AS (PARTITION BY qid)), bl AS (SELECT *, (1 - blend) * a + blend * b AS logit FROM z, (SELECT unnest([0.02, 0.05, 0.1, 0.2, 0.35, 1.0])::DOUBLE AS blend)), ex AS (SELECT *, exp(logit - max(logit) OVER (PARTITION BY blend, qid)) AS x FROM bl), pb AS (SELECT *, x / sum(x) OVER (PARTITION BY blend, qid) AS prob FROM ex) SELECT blend, count(*) AS n, round(avg(prob) FILTER (label), 6) AS positive, round(max(prob), 6) AS top FROM pb GROUP BY blend")
def blend_sweep(spark, d):
    rows = scoring.blend_sweep(_rule18(spark, d), "rule_score", "recent_pop", [0.02, 0.05, 0.1, 0.2, 0.35, 1.0])
    return rounded(rows.groupBy("blend").agg(F.count("*").alias("n"), F.avg(F.when(F.col("label"), F.col("prob"))).alias("positive"), F.max("prob").alias("top")))


@query(f"WITH {_rule18_sql('new')}, sd AS (SELECT 0 AS seed, qid, pos, rule_score AS s FROM f18 UNION ALL SELECT 1, qid, pos, pop FROM f18 UNION ALL SELECT 2, qid, pos, recency FROM f18), z AS (SELECT qid, pos, {_zg('s')} AS z FROM sd WINDOW w AS (PARTITION BY seed, qid)) SELECT qid, pos, round(avg(z), 6) AS score FROM z GROUP BY ALL")
def seed_ensemble(spark, d):
    rows = _rule18(spark, d).select("qid", "pos", F.posexplode(F.array("rule_score", "pop", "recency")).alias("seed", "score"))
    return rounded(scoring.seed_ensemble(rows, "score"))


# Evaluation

_RR = """ps AS (SELECT *, max(CASE WHEN label THEN {s} END) OVER (PARTITION BY qid) AS ps FROM f18), rr AS (SELECT qid, count(*) FILTER (round({s}, 9) > round(ps, 9)) AS greater, count(*) FILTER (round({s}, 9) = round(ps, 9)) - 1 AS equal_other FROM ps WHERE ps IS NOT NULL GROUP BY qid)"""


@query(f"WITH {_rule18_sql('new')}, {_RR.format(s='rule_score')} SELECT qid, greater, equal_other, round(1.0 / (1 + greater), 6) AS rr_optimistic, round(1.0 / (1 + greater + 0.5 * equal_other), 6) AS rr_mid FROM rr")
def reciprocal_ranks(spark, d):
    return rounded(evaluate.ranks(_rule18(spark, d), "rule_score").select("qid", "greater", "equal_other", "rr_optimistic", "rr_mid"))


@query(f"WITH {_rule18_sql('mid')}, {_RR.format(s='pop')} SELECT round(avg(1.0 / (1 + greater)), 6) AS mrr, round(avg(1.0 / (1 + greater + 0.5 * equal_other)), 6) AS mrr_mid, round(avg(CAST(greater + 1 <= 5 AS DOUBLE)), 6) AS hit5, count(*) AS queries FROM rr")
def ranking_metrics(spark, d):
    return rounded(evaluate.metrics(_rule18(spark, d, "mid"), "pop", 5))


_FLAGS = """fl AS (SELECT q.qid, EXISTS (SELECT 1 FROM h WHERE h.src = q.src AND h.dst = q.dst) AS rep, EXISTS (SELECT 1 FROM h WHERE h.dst = q.dst) AS dk, EXISTS (SELECT 1 FROM h WHERE h.src = q.src) AS sk FROM q),
    bk AS (SELECT qid, 'overall' AS bucket FROM fl UNION ALL SELECT qid, CASE WHEN rep THEN 'repeated' ELSE 'new_pair' END FROM fl UNION ALL SELECT qid, 'cold_dst' FROM fl WHERE NOT dk UNION ALL SELECT qid, 'cold_src' FROM fl WHERE NOT sk UNION ALL SELECT qid, 'no_history_src' FROM fl WHERE NOT sk)"""


@query(f"WITH {_rule18_sql('mid')}, {_RR.format(s='rule_score')}, {_FLAGS} SELECT bucket, round(avg(coalesce(1.0 / (1 + greater), 0)), 6) AS mrr, count(*) AS events FROM bk LEFT JOIN rr USING (qid) GROUP BY bucket")
def bucket_mrr(spark, d):
    v = View(spark, d, "mid")
    return rounded(evaluate.bucketed(evaluate.ranks(features.rule18(v.lists, v.history), "rule_score"), evaluate.bucket_flags(v.queries, v.train)))


_MODES = ["rule_score", "pop", "recency"]


@query(f"WITH {_rule18_sql('rep')}, {_FLAGS}, ln_ AS (" + " UNION ALL ".join(f"SELECT qid, label, '{m}' AS mode, {m} AS s FROM f18" for m in _MODES) + """), ps AS (SELECT *, max(CASE WHEN label THEN s END) OVER (PARTITION BY mode, qid) AS ps FROM ln_),
    rr AS (SELECT mode, qid, 1.0 / (1 + count(*) FILTER (round(s, 9) > round(ps, 9))) AS rr FROM ps WHERE ps IS NOT NULL GROUP BY ALL) SELECT 'random' AS eval_set, mode, bucket, round(avg(coalesce(rr, 0)), 6) AS mrr, count(*) AS events FROM (SELECT * FROM bk, (SELECT unnest(['rule_score', 'pop', 'recency']) AS mode)) LEFT JOIN rr USING (mode, qid) GROUP BY ALL""")
def eval_by_mode(spark, d):
    v = View(spark, d, "rep")
    return rounded(evaluate.by_mode(features.rule18(v.lists, v.history), _MODES, evaluate.bucket_flags(v.queries, v.train), "random"))


@query(f"WITH {_rule18_sql('new')}, ln_ AS (" + " UNION ALL ".join(f"SELECT qid, label, '{m}' AS feature, {m} AS s FROM f18" for m in features.RULE18) + """), ps AS (SELECT *, max(CASE WHEN label THEN s END) OVER (PARTITION BY feature, qid) AS ps FROM ln_),
    rr AS (SELECT feature, qid, 1.0 / (1 + count(*) FILTER (round(s, 9) > round(ps, 9)) + 0.5 * (count(*) FILTER (round(s, 9) = round(ps, 9)) - 1)) AS rr FROM ps WHERE ps IS NOT NULL GROUP BY ALL) SELECT feature, round(avg(rr), 6) AS mrr FROM rr GROUP BY feature""")
def component_mrr(spark, d):
    return rounded(evaluate.component_mrr(_rule18(spark, d), features.RULE18))


_TOP1 = "(SELECT qid, pos AS {0}, dst FROM (SELECT *, row_number() OVER (PARTITION BY qid ORDER BY round({1}, 9) DESC, pos) AS r FROM f18) WHERE r = 1)"


@query(f"WITH {_rule18_sql('new')} SELECT round(avg(CAST(pa <> pb AS DOUBLE)), 6) AS changed, count(*) AS queries FROM {_TOP1.format('pa', 'rule_score')} a JOIN {_TOP1.format('pb', 'recency')} b USING (qid)")
def top1_change(spark, d):
    return rounded(evaluate.top1_change(_rule18(spark, d), "rule_score", "recency"))


@query(f"WITH {_rule18_sql('mid')}, t AS (SELECT t.dst, coalesce(d.n, 0) AS n FROM {_TOP1.format('pa', 'rule_score')} t LEFT JOIN d ON d.dst = t.dst) SELECT count(DISTINCT dst) AS unique_dst, round(avg(CAST(n > 0 AS DOUBLE)), 6) AS known_frac, round(avg(n), 6) AS count_mean, round(quantile_cont(n, 0.5), 6) AS count_p50, round(quantile_cont(n, 0.95), 6) AS count_p95 FROM t")
def top1_stats(spark, d):
    v = View(spark, d, "mid")
    return rounded(evaluate.top1_stats(features.rule18(v.lists, v.history), v.train, "rule_score"))


@query(f"WITH {_rule18_sql('new')}, r AS (SELECT dst, row_number() OVER (PARTITION BY qid ORDER BY round(recency, 9) DESC, pos) AS r FROM f18) SELECT k, round(avg(CAST(dst NOT IN (SELECT dst FROM h) AS DOUBLE)), 6) AS unseen FROM r, (SELECT unnest([1, 5]) AS k) WHERE r <= k GROUP BY k")
def top_unseen(spark, d):
    v = View(spark, d)
    return rounded(evaluate.top_unseen(features.rule18(v.lists, v.history), v.train, (1, 5), "recency"))


@query(f"WITH {_rule18_sql('new')}, {_SOFT}, x AS (SELECT qid, count(*) AS n, sum(prob) AS s, stddev_pop(prob) AS d FROM pb GROUP BY qid) SELECT count(*) AS rows, count(*) FILTER (n <> 10) AS bad_width, false AS has_nan, false AS has_inf, false AS has_negative, round(max(abs(s - 1)), 6) AS max_row_sum_error, count(*) FILTER (d < 1e-12) AS const_rows, count(*) FILTER (n <> 10) = 0 AS valid FROM x")
def prob_report(spark, d):
    return rounded(evaluate.probability_report(_probs(spark, d), 10))


_ENT = "(SELECT qid, sum(-prob * ln(greatest(prob, 1e-12))) AS entropy, max(prob) AS top FROM pb GROUP BY qid)"


@query(f"WITH {_rule18_sql('new')}, {_SOFT} SELECT round(avg(top), 6) AS top_mean, round(quantile_cont(top, 0.95), 6) AS top_p95, round(avg(entropy), 6) AS entropy_mean FROM {_ENT}")
def score_summary(spark, d):
    return rounded(evaluate.score_summary(_probs(spark, d)))


@query(f"WITH {_rule18_sql('new')}, {_SOFT}, en AS {_ENT}, su AS (SELECT * FROM en ORDER BY round(entropy, 9), qid LIMIT 300), ch AS (SELECT * FROM su ORDER BY (qid * 7919) % 10007, qid LIMIT 100), am AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY qid ORDER BY round(prob, 9) DESC, pos) AS r FROM pb) WHERE r = 1) SELECT qid, src, time, dst, round(entropy, 6) AS entropy FROM am JOIN ch USING (qid)")
def entropy_topk(spark, d):
    return rounded(C.pseudo_labels(_probs(spark, d), 100))


@query(f"WITH {_rule18_sql('new')}, g AS (SELECT round(rule_score, 9) AS x, label FROM f18), r AS (SELECT x, count(*) AS n, count(*) FILTER (label) AS p, sum(count(*)) OVER (ORDER BY x) AS upto FROM g GROUP BY x) SELECT round((sum(p * (upto - (n - 1) / 2.0)) - sum(p) * (sum(p) + 1) / 2) / (sum(p) * (sum(n) - sum(p))), 6) AS auc FROM r")
def roc_auc(spark, d):
    return rounded(spark.createDataFrame([(evaluate.roc_auc(_rule18(spark, d), "rule_score"),)], "auc double"))


# Point in time

def _prior_sql(view: str) -> str:
    part = lambda k: f"OVER (PARTITION BY {k} ORDER BY seq ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)"
    cols = ", ".join(f"count(*) {part(k)} AS {n}_n, max(time) {part(k)} AS {n}_last" for n, k in (("dst", "dst"), ("src", "src"), ("pair", "src, dst")))
    return f"WITH {base_sql(view)}, x AS (SELECT seq, src, dst, time, {cols} FROM e)"


@query(_prior_sql("mid") + " SELECT *, round(coalesce(ln(1 + greatest(time - dst_last, 0)), 0), 6) AS dst_gap, pair_n = 0 AS is_new_pair FROM x")
def asof_prequential(spark, d):
    return rounded(asof.prequential(View(spark, d, "mid").numbered))


@query(f"WITH {base_sql('mid')}, x AS (SELECT *, row_number() OVER (PARTITION BY src, dst ORDER BY seq) AS r FROM e) SELECT src, dst, time, seq FROM x WHERE r = 1")
def asof_new_pairs(spark, d):
    return asof.new_pairs(View(spark, d, "mid").numbered)


@query(f"WITH {base_sql('new')}, x AS (SELECT v.seq AS pid, h.dst, h.time, row_number() OVER (PARTITION BY v.seq ORDER BY h.time DESC, h.dst DESC) AS r FROM v JOIN e h ON h.src = v.src AND h.time < v.time) SELECT v.seq AS pid, coalesce(array_to_string(list(x.dst ORDER BY r DESC) FILTER (x.dst IS NOT NULL), ','), '') AS hist FROM v LEFT JOIN x ON x.pid = v.seq AND r <= 5 GROUP BY v.seq")
def asof_neighbors(spark, d):
    v = View(spark, d)
    rows = asof.neighbours_before(v.numbered, v.valid.withColumn("pid", F.col("seq")), 5)
    return rows.select("pid", F.array_join(F.transform("hist", lambda x: x.cast("string")), ",").alias("hist"))


@query(f"""WITH {base_sql('mid')}, b AS (SELECT *, (seq - 1) // 5000 AS block FROM e), d0 AS (SELECT dst, block, count(*) AS c FROM b GROUP BY ALL), p0 AS (SELECT src, dst, block, count(*) AS c FROM b GROUP BY ALL),
    dc AS (SELECT dst, block, sum(c) OVER (PARTITION BY dst ORDER BY block) - c AS n FROM d0), pc AS (SELECT src, dst, block, sum(c) OVER (PARTITION BY src, dst ORDER BY block) - c AS n FROM p0)
    SELECT b.seq, b.src, b.dst, b.block, CAST(dc.n AS BIGINT) AS dst_n, CAST(pc.n AS BIGINT) AS pair_n FROM b JOIN dc ON dc.dst = b.dst AND dc.block = b.block JOIN pc ON pc.src = b.src AND pc.dst = b.dst AND pc.block = b.block""")
def rolling_block_pool(spark, d):
    return asof.rolling_blocks(View(spark, d, "mid").numbered, 5000)


@query(f"""WITH {base_sql('mid')}, b AS (SELECT seq, src, dst, (seq - 1) // 5000 AS block FROM e), bl AS (SELECT DISTINCT block FROM b),
    lt AS (SELECT bl.block, b.dst, row_number() OVER (PARTITION BY bl.block ORDER BY count(*) DESC, b.dst) AS place FROM bl JOIN b ON b.block < bl.block GROUP BY bl.block, b.dst),
    own AS (SELECT x.src, x.block, b.dst, row_number() OVER (PARTITION BY x.src, x.block ORDER BY b.seq DESC) AS place FROM (SELECT DISTINCT src, block FROM b) x JOIN b ON b.src = x.src AND b.block < x.block)
    SELECT b.seq, b.src, 1 AS source, CAST(own.place AS INTEGER) AS place, own.dst FROM b JOIN own ON own.src = b.src AND own.block = b.block WHERE own.place <= 4
    UNION ALL SELECT b.seq, b.src, 2, CAST(lt.place AS INTEGER), lt.dst FROM b JOIN lt ON lt.block = b.block WHERE lt.place <= 8""")
def rolling_block_candidates(spark, d):
    return asof.block_pools(View(spark, d, "mid").numbered, 5000, hot=8, recent=4)


@query(f"WITH {base_sql('new')} SELECT dst, count(*) AS n FROM e WHERE seq > (SELECT max(seq) FROM e) - 200000 GROUP BY dst")
def fifo_window(spark, d):
    return asof.fifo_counts(View(spark, d).numbered, 200_000)


# Vectors

@query(f"WITH {base_sql('mid')}, t AS (SELECT min(time) AS low, greatest(max(time) - min(time), 1) AS span FROM h) SELECT src, dst, round(ln(1 + sum(1.0 + 2.8 * (time - low) / span)), 6) AS w FROM h, t GROUP BY ALL")
def weighted_pair_matrix(spark, d):
    return rounded(linalg.weighted_pairs(View(spark, d, "mid").train))


_VECS = "dv AS (SELECT vec_id AS dst, embedding AS vec FROM embeddings)"


def _vectors(spark, d, key: str = "dst") -> DataFrame:
    return table(spark, d, "embeddings").select(F.col("vec_id").alias(key), F.transform("embedding", lambda x: x.cast("double")).alias("vec"))


def _digest(key: str) -> list:
    """A vector's length, first and last number."""
    return [key, F.element_at("vec", 1).alias("first"), F.element_at("vec", -1).alias("last"), F.size("vec").alias("dims")]


@query(f"WITH {base_sql('rep')}, {scales_sql()}, {_VECS}, x AS (SELECT lk.src, i, sum(CAST(vec[i] AS DOUBLE) / sqrt(lk.r)) AS x FROM lk JOIN dv ON dv.dst = lk.dst, range(1, 65) t(i) WHERE lk.r <= 160 GROUP BY ALL), y AS (SELECT src, list(x ORDER BY i) AS vec FROM x GROUP BY src), z AS (SELECT src, vec, greatest(sqrt(list_sum(list_transform(vec, lambda a: a * a))), 1e-6) AS l FROM y) SELECT src, round(vec[1] / l, 5) AS first, round(vec[64] / l, 5) AS last, CAST(len(vec) AS INTEGER) AS dims FROM z")
def source_profile(spark, d):
    rows = linalg.source_profile(View(spark, d, "rep").train, _vectors(spark, d), 160).select(*_digest("src"))
    return rows.withColumn("first", F.round("first", 5)).withColumn("last", F.round("last", 5))


@query(f"WITH {base_sql('rep')}, la AS (SELECT dst, src, row_number() OVER (PARTITION BY dst ORDER BY time DESC, src DESC) AS r FROM h), ev AS (SELECT vec_id AS src, embedding AS vec FROM embeddings), m AS (SELECT dst, src FROM la WHERE r <= 64 AND src IN (SELECT src FROM ev)), x AS (SELECT m.dst, i, avg(CAST(vec[i] AS DOUBLE)) AS x FROM m JOIN ev USING (src), range(1, 65) t(i) GROUP BY ALL), y AS (SELECT dst, list(x ORDER BY i) AS vec FROM x GROUP BY dst), z AS (SELECT dst, vec, greatest(sqrt(list_sum(list_transform(vec, lambda a: a * a))), 1e-6) AS l FROM y) SELECT z.dst, round(vec[1] / l, 5) AS first, round(n, 6) AS log_n FROM z JOIN (SELECT dst, ln(1 + count(*)) AS n FROM m GROUP BY dst) k USING (dst)")
def audience_centroid(spark, d):
    rows = linalg.audience(View(spark, d, "rep").train, _vectors(spark, d, "src"), 64)
    return rows.select("dst", F.round(F.element_at("av", 1), 5).alias("first"), F.round("log_n", 6).alias("log_n"))


@query("WITH u AS (SELECT vec_id AS id, list_transform(embedding, lambda x: CAST(x AS DOUBLE)) AS v FROM embeddings), l AS (SELECT id, list_transform(v, lambda x: x / greatest(sqrt(list_sum(list_transform(v, lambda y: y * y))), 1e-6)) AS v FROM u), c AS (SELECT a.id AS qid, b.id AS dst, round(list_dot_product(a.v, b.v), 9) AS cos FROM l a, l b), r AS (SELECT *, row_number() OVER (PARTITION BY qid ORDER BY cos DESC, dst) AS rank FROM c) SELECT qid, dst, round(cos, 5) AS cos, rank FROM r WHERE rank <= 5")
def cosine_topk(spark, d):
    items = _vectors(spark, d)
    rows = linalg.cosine_top_k(items.withColumnRenamed("dst", "qid"), items, 5)
    return rows.select("qid", "dst", F.round("cos", 5).alias("cos"), F.col("rank").cast("long").alias("rank"))


@query()
def svd_scores(spark, d):
    """Cosines of validation pairs after a decomposition of the history; held against numpy's in the tests."""
    v = View(spark, d, "mid")
    src, dst = linalg.truncated_svd(linalg.weighted_pairs(v.train), 16)
    rows = v.lists.join(src.withColumnRenamed("vec", "sv"), "src").join(dst.withColumnRenamed("vec", "dv"), "dst")
    return rows.select("qid", "pos", "dst", F.round(S.dot(F.col("sv"), F.col("dv")), 4).alias("svd"))


@query()
def features_context14(spark, d):
    v = View(spark, d, "mid", sourced=True)
    src, dst = linalg.truncated_svd(linalg.weighted_pairs(v.train), 8)
    base = features.graph21(v.lists, v.history, vectors=(src, dst), wanted=["pop", "recent_pop", "profile"]).select("qid", "src", "time", "pos", "dst", "label", "pop", "recent_pop", "profile")
    return rounded(features.context14(base, v.history, src, dst))


# Reports, sinks and profile

@query(f"WITH {base_sql('mid')}, hs AS (SELECT src, max(seq) AS s FROM h GROUP BY src), x AS (SELECT v.*, EXISTS (SELECT 1 FROM h WHERE h.dst = v.dst) AS k, EXISTS (SELECT 1 FROM h WHERE h.src = v.src AND h.dst = v.dst) AS r FROM v) SELECT (SELECT count(*) FROM h) AS train_rows, count(*) AS valid_rows, round(avg(CAST(k AS DOUBLE)), 6) AS dst_seen_ratio, round(1 - avg(CAST(k AS DOUBLE)), 6) AS cold_dst_ratio, round(avg(CAST(r AS DOUBLE)), 6) AS repeated_ratio, round(1 - avg(CAST(r AS DOUBLE)), 6) AS new_pair_ratio FROM x")
def profile_split(spark, d):
    v = View(spark, d, "mid")
    flag = lambda keys, name: v.train.select(*keys).distinct().withColumn(name, F.lit(True))
    rows = v.valid.join(flag(["dst"], "k"), "dst", "left").join(flag(["src", "dst"], "r"), ["src", "dst"], "left")
    k, r = F.avg(F.col("k").isNotNull().cast("double")), F.avg(F.col("r").isNotNull().cast("double"))
    return rounded(rows.agg(F.lit(v.train.count()).cast("long").alias("train_rows"), F.count("*").alias("valid_rows"), k.alias("dst_seen_ratio"), (1 - k).alias("cold_dst_ratio"), r.alias("repeated_ratio"), (1 - r).alias("new_pair_ratio")))


@query(f"WITH {base_sql('mid')}, {_LAG}, {scales_sql()}, tr AS (SELECT DISTINCT prev, dst AS next FROM x WHERE prev IS NOT NULL), ld AS (SELECT src, dst AS prev FROM lk WHERE r = 1), y AS (SELECT avg(CAST(EXISTS (SELECT 1 FROM tr WHERE tr.prev = ld.prev AND tr.next = v.dst) AS DOUBLE)) AS t FROM v LEFT JOIN ld ON ld.src = v.src) SELECT round(t, 6) AS transition_hit_ratio, CAST(least(12, greatest(0, round_even(99 * t * 0.5, 0))) AS BIGINT) AS transition_neg_quota FROM y")
def profile_quotas(spark, d):
    v = View(spark, d, "mid")
    t = sequences.transitions(v.train).select("prev", F.col("next").alias("dst"), F.lit(True).alias("t"))
    rows = v.valid.join(sequences.last_value(v.train).select("src", F.col("last_dst").alias("prev")), "src", "left").join(t, ["prev", "dst"], "left")
    ratio = rows.agg(F.avg(F.col("t").isNotNull().cast("double")).alias("x"))
    quota = F.least(F.lit(12), F.greatest(F.lit(0), F.bround(99 * F.col("x") * 0.5))).cast("long")
    return ratio.select(F.round("x", 6).alias("transition_hit_ratio"), quota.alias("transition_neg_quota"))


@query(f"WITH {lists_sql('new')}, x AS (SELECT qid, count(*) AS n, count(*) FILTER (dst IN (SELECT dst FROM h)) AS k FROM c GROUP BY qid) SELECT count(*) AS queries, CAST(sum(n) AS BIGINT) AS cells, round(sum(k) / sum(n), 6) AS known_cells, round(avg(CAST(k = n AS DOUBLE)), 6) AS full_rows, min(k) AS least_known FROM x")
def test_coverage(spark, d):
    v = View(spark, d)
    known = v.train.select("dst").distinct().withColumn("k", F.lit(1))
    rows = v.lists.join(known, "dst", "left").groupBy("qid").agg(F.count("*").alias("n"), F.count("k").alias("k"))
    return rounded(rows.agg(F.count("*").alias("queries"), F.sum("n").alias("cells"), (F.sum("k") / F.sum("n")).alias("known_cells"), F.avg((F.col("k") == F.col("n")).cast("double")).alias("full_rows"), F.min("k").alias("least_known")))


@query(f"WITH {_rule18_sql('rep')}, {_SOFT} SELECT qid, CAST(count(*) AS INTEGER) AS width, array_to_string(list(round(prob, 4) ORDER BY pos)[1:3], ',') <> '' AS filled, round(sum(prob), 6) AS total FROM pb GROUP BY qid")
def sink_rows(spark, d):
    probs = windows.softmax(_rule18(spark, d, "rep"), "rule_score")
    rows = sinks.rows_of(probs).select("qid", sinks.repaired(F.col("row")).alias("row"))
    return rows.select("qid", F.size("row").alias("width"), (sinks.formatted(F.col("row")) != "").alias("filled"), F.round(F.aggregate("row", F.lit(0.0), lambda a, x: a + x), 6).alias("total"))


@query(f"WITH {_rule18_sql('rep')}, ln_ AS (" + " UNION ALL ".join(f"SELECT '{m}' AS feature, {m} AS x FROM f18" for m in features.RULE18) + ") SELECT feature, round(avg(x), 6) AS mean, round(CASE WHEN stddev_pop(x) < 1e-6 THEN 1 ELSE stddev_pop(x) END, 6) AS std FROM ln_ GROUP BY feature")
def feature_standardiser(spark, d):
    return rounded(stats.standardiser(_rule18(spark, d, "rep"), features.RULE18))


# Event-time windows, in batch; streaming holds the same

@query("SELECT user_id, date_trunc('hour', ts) AS start, count(*) AS n, round(sum(value), 4) AS value FROM events GROUP BY ALL")
def tumbling_counts(spark, d):
    from ..streaming import windows as W

    return W.tumbling(table(spark, d, "events"), "1 hour").withColumn("value", F.round("value", 4))


@query("WITH k AS (SELECT event_type, ts, unnest([0, 1, 2, 3]) AS k FROM events), w AS (SELECT event_type, time_bucket(INTERVAL 15 MINUTE, ts) - k * INTERVAL 15 MINUTE AS start FROM k) SELECT event_type, start, count(*) AS n FROM w GROUP BY ALL")
def sliding_counts(spark, d):
    from ..streaming import windows as W

    return W.sliding(table(spark, d, "events"), "1 hour", "15 minutes")


@query("WITH a AS (SELECT user_id, ts, CASE WHEN ts - lag(ts) OVER w >= INTERVAL 30 MINUTE OR lag(ts) OVER w IS NULL THEN 1 ELSE 0 END AS first FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts)), b AS (SELECT *, sum(first) OVER (PARTITION BY user_id ORDER BY ts ROWS UNBOUNDED PRECEDING) AS s FROM a) SELECT user_id, min(ts) AS start, max(ts) + INTERVAL 30 MINUTE AS stop, count(*) AS n FROM b GROUP BY user_id, s")
def session_counts(spark, d):
    from ..streaming import windows as W

    return W.sessions(table(spark, d, "events"), "30 minutes")


# Flagship

def flagship(spark: SparkSession, sf_dir: str) -> DataFrame:
    """History, queries, candidates, 18 features, rule score, softmax: each query's best candidate, its probability and the positive's
    reciprocal rank."""
    v = View(spark, sf_dir)
    rows = windows.softmax(features.rule18(v.lists, v.history), "rule_score")
    rr = evaluate.ranks(rows, "rule_score").select("qid", "rr_optimistic")
    return rounded(windows.argmax(rows, "rule_score").join(rr, "qid").select("qid", "src", "time", "dst", "label", "rule_score", "prob", "rr_optimistic"))


query(f"WITH {_rule18_sql('new')}, {_RR.format(s='rule_score')}, {_SOFT}, am AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY qid ORDER BY round(rule_score, 9) DESC, pos) AS r FROM f18) WHERE r = 1) SELECT am.qid, am.src, am.time, am.dst, am.label, round(am.rule_score, 6) AS rule_score, round(pb.prob, 6) AS prob, round(1.0 / (1 + greater), 6) AS rr_optimistic FROM am JOIN pb ON pb.qid = am.qid AND pb.pos = am.pos JOIN rr ON rr.qid = am.qid", "flagship")(flagship)


# Learners: fitted on the earlier half of the validation lists, scored on the later; no SQL

def _halves(spark, d) -> tuple[View, DataFrame, DataFrame]:
    v = View(spark, d, "rep")
    rows = features.listwise_extras(features.rule18(v.lists, v.history), v.history)
    cut = order.exact_percentiles(v.queries, "qid", [0.5])[0]
    return v, rows.filter(F.col("qid") <= cut), rows.filter(F.col("qid") > cut)


def _report(scored: DataFrame, name: str) -> DataFrame:
    return rounded(evaluate.metrics(scored, "model").withColumn("learner", F.lit(name)))


@query()
def gbt_rank(spark, d):
    from ..operators import models

    _, train, test = _halves(spark, d)
    return _report(models.boosted(train, features.RULE18, 10, 3).score(test), "gbt")


@query()
def logistic_rank(spark, d):
    from ..operators import models

    _, train, test = _halves(spark, d)
    return _report(models.logistic(train, features.RULE18 + features.LISTWISE).score(test), "logistic")


@query()
def listwise_mlp(spark, d):
    from ..operators import models

    _, train, test = _halves(spark, d)
    return _report(models.ListwiseMLP(features.RULE18 + features.LISTWISE).fit(train).score(test), "listwise")


from . import evaluation  # noqa: E402, F401  its queries register themselves
