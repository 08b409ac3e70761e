"""Queries of evaluation sets, weight and fusion choice, training samples, and what is written and read back, with their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators import candidates as C
from ..operators import evaluate, features, order, profile, scoring, sequences
from ..sources import edges as E
from ..sources import sinks, state
from . import catalog as K
from .catalog import query, r6, rounded
from .lists import View, base_sql, edges_sql, lists_sql, scales_sql


def oracle(name: str) -> str:
    return K.oracle_sql()[name]


# Validation sets: lists of 100 for each query, and all destinations

SETS = ["all", "random", "hard", "mixed", "cold"]
WIDTH = 100


def set_lists(v: View) -> dict[str, DataFrame]:
    """Lists of every set, of queries dealt by source."""
    seen, known, q = v.valid.select("dst"), v.train.select("dst"), sequences.dealt(v.queries)
    return dict(zip(SETS, (C.all_lists(q, known), C.random_lists(q, known, WIDTH), C.hard_lists(q, v.train, WIDTH), C.mixed_lists(q, v.train, seen, WIDTH, "mixed"), C.mixed_lists(q, v.train, seen, WIDTH, "cold")), strict=True))


def _one_set_sql(k: int, parts: list[str], n: int) -> str:
    rows = " UNION ALL ".join(parts)
    return f"""SELECT qid * {len(SETS)} + {k} AS qid, src, time, pos, dst, label FROM (SELECT qid, src, time, {K._NUMBER} AS pos, dst, m = 0 AS label
        FROM (SELECT qid, src, time, dst, min(source * 1000000 + place) AS m FROM ({rows}) GROUP BY ALL)) WHERE pos < {n}"""


def _sets_sql(view: str) -> str:
    """lists_sql with c holding the lists of all sets."""
    every = "SELECT qid, q.src, q.time, 1 AS source, known.dst AS place, known.dst FROM q, known"
    hot = lambda n: f"SELECT qid, src, time, 2, place, hot.dst FROM q, hot WHERE place <= {n}"
    own = {m: [int(WIDTH * x) for x in C.MIXES[m]] for m in ("mixed", "cold")}
    mixed = lambda m: [K._POSITIVE, K._recent(own[m][0]), hot(own[m][1]), K._drawn("seen", str(own[m][2]), 3, 11), K._drawn("unseen", str(own[m][3]), 4, 13), K._drawn("known", str(2 * WIDTH), 9)]
    sets = [
        _one_set_sql(0, [K._POSITIVE, every], 10**9), _one_set_sql(1, [K._POSITIVE, K._drawn("known", str(WIDTH - 1), 9)], WIDTH), _one_set_sql(2, [K._POSITIVE, K._recent(200), hot(64), K._drawn("known", str(2 * WIDTH), 9)], WIDTH),
        _one_set_sql(3, mixed("mixed"), WIDTH), _one_set_sql(4, mixed("cold"), WIDTH),
    ]
    pools = f"lk0 AS (SELECT src, dst, time, row_number() OVER (PARTITION BY src ORDER BY time DESC, dst DESC) AS r FROM h), {K._HOT}, known AS {K._ids('SELECT DISTINCT dst FROM h')}, seen AS {K._ids('SELECT dst FROM v INTERSECT SELECT dst FROM h')}, unseen AS {K._ids('SELECT dst FROM v EXCEPT SELECT dst FROM h')}"
    return lists_sql(view).replace("c AS (SELECT qid, src, time, CAST", "c0 AS (SELECT qid, src, time, CAST") + f", {pools}, c AS ({' UNION ALL '.join(sets)})".replace("JOIN lk ON lk.src = q.src", "JOIN lk0 AS lk ON lk.src = q.src")


def _set_features_sql(view: str) -> str:
    return K._rule18_sql(view).replace(lists_sql(view), _sets_sql(view), 1)


#: A fixed scorer in the place of a model.
MODEL = {"pop": 0.6, "src_recent_score": 0.9, "pair_count": 0.7, "recency": 0.3}
MODES = ["rule", "model", "fusion", "pop", "recent"]
_MODEL_SQL = " + ".join(f"{w} * {f}" for f, w in MODEL.items())
_SCORED_SQL = f"sx AS (SELECT qid, pos, dst, label, rule_score AS rule, {_MODEL_SQL} AS model, pop, recency AS recent FROM f18)"


def set_scores(spark, d, view: str = "rep") -> tuple[View, dict[str, DataFrame]]:
    """Scores of each set apart: a union would have to be dealt anew."""
    v = View(spark, d, view)

    def scored(lists: DataFrame) -> DataFrame:
        rows = features.rule18(lists, v.history)
        return rows.select("qid", "src", "pos", "dst", "label", F.col("rule_score").alias("rule"), scoring.linear(MODEL).alias("model"), "pop", F.col("recency").alias("recent"))

    return v, {name: scored(lists) for name, lists in set_lists(v).items()}


@query(f"""WITH {_set_features_sql('rep')}, {K._FLAGS}, {_SCORED_SQL}, sy AS (SELECT *, {K._z('rule')} + 0.5 * {K._z('model')} AS fusion FROM sx WINDOW w AS (PARTITION BY qid)),
    ln_ AS ({' UNION ALL '.join(f"SELECT qid, label, '{m}' AS mode, {m} AS s FROM sy" for m in MODES)}), ps AS (SELECT *, max(CASE WHEN label THEN s END) OVER (PARTITION BY mode, qid) AS ps FROM ln_),
    rr AS (SELECT mode, qid, 1.0 / (1 + count(*) FILTER (round(s, 9) > round(ps, 9))) AS rr FROM ps WHERE ps IS NOT NULL GROUP BY ALL),
    es AS (SELECT k, s FROM (SELECT unnest(range(0, {len(SETS)})) AS k, unnest([{', '.join(f"'{x}'" for x in SETS)}]) AS s)), md AS (SELECT unnest([{', '.join(f"'{m}'" for m in MODES)}]) AS mode)
    SELECT es.s AS eval_set, md.mode, bucket, round(avg(coalesce(rr, 0)), 6) AS mrr, count(*) AS events FROM bk, es, md LEFT JOIN rr ON rr.mode = md.mode AND rr.qid = bk.qid * {len(SETS)} + es.k GROUP BY ALL""")
def eval_sets(spark, d):
    """All sets by five modes and buckets."""
    v, sets = set_scores(spark, d)
    flags, out = evaluate.bucket_flags(v.queries, v.train), None
    for name, rows in sets.items():
        part = evaluate.by_mode(scoring.fused(rows, {"rule": 1.0, "model": 0.5}, "fusion", features.OWN), MODES, flags, name)
        out = part if out is None else out.unionByName(part)
    return rounded(out)


WEIGHTS = [0.0, 0.1, 0.25, 0.5, 1.0, 2.0]
_MRR_SQL = f"""sy AS (SELECT qid, label, {K._z('rule')} AS zr, {K._z('model')} AS zm FROM sx WINDOW w AS (PARTITION BY qid)), md AS (SELECT 'rule' AS mode, 1.0 AS a, 0.0 AS b UNION ALL SELECT 'model', 0.0, 1.0 UNION ALL SELECT CAST(x AS VARCHAR), 1.0, x FROM (SELECT unnest([{', '.join(f'{w}::DOUBLE' for w in WEIGHTS)}]) AS x)),
    sc1 AS (SELECT mode, qid, label, round(a * zr + b * zm, 9) AS s FROM sy, md), ps AS (SELECT *, max(CASE WHEN label THEN s END) OVER (PARTITION BY mode, qid) AS ps FROM sc1),
    rr AS (SELECT mode, qid, 1.0 / (1 + count(*) FILTER (s > ps) + 0.5 * (count(*) FILTER (s = ps) - 1)) AS rr FROM ps WHERE ps IS NOT NULL GROUP BY ALL), mt AS (SELECT qid % {len(SETS)} AS k, mode, avg(rr) AS mrr FROM rr GROUP BY ALL)"""


@query(f"""WITH {_set_features_sql('rep')}, {_SCORED_SQL}, {_MRR_SQL}, g AS (SELECT CAST(w.mode AS DOUBLE) AS w, max(w.mrr - r.mrr) FILTER (w.k = 2) AS hard, max(w.mrr - r.mrr) FILTER (w.k = 1) AS rnd, max(w.mrr - r.mrr) FILTER (w.k = 3) AS mixed, max(w.mrr) FILTER (w.k = 4) AS cold
        FROM mt w JOIN mt r ON r.k = w.k AND r.mode = 'rule' WHERE w.mode NOT IN ('rule', 'model') GROUP BY ALL),
    fe AS (SELECT w, hard + 0.5 * rnd AS gain FROM g WHERE rnd >= -0.002 AND (SELECT max(mrr) FILTER (mode = 'model') + 1e-12 >= max(mrr) FILTER (mode = 'rule') FROM mt WHERE k = 2)), li AS (SELECT w, 0.45 * hard + 0.40 * mixed + 0.10 * rnd + 0.05 * cold AS gain FROM g WHERE rnd >= -0.01)
    SELECT 'feature' AS kind, coalesce((SELECT w FROM fe WHERE gain > 0 ORDER BY gain DESC, w LIMIT 1), 0.0) AS weight UNION ALL SELECT 'listwise', coalesce((SELECT w FROM li WHERE gain > 0 ORDER BY gain DESC, w LIMIT 1), 0.0)
    UNION ALL SELECT ['all', 'random', 'hard', 'mixed', 'cold'][k + 1] || ' ' || mode, round(mrr, 6) FROM mt WHERE mode IN ('rule', 'model')""")
def fusion_choice(spark, d):
    """The weights that both rules choose, and the MRR of rule and model on each set."""
    _, sets = set_scores(spark, d)
    found = evaluate.fusion_metrics(sets, "model", "rule", WEIGHTS)
    out = [("feature", evaluate.select_feature_fusion(found, WEIGHTS)), ("listwise", evaluate.select_listwise_fusion(found, WEIGHTS))]
    out += [(f"{name} {mode}", found[name][mode]) for name in SETS for mode in ("rule", "model")]
    return rounded(spark.createDataFrame(out, "kind string, weight double"))


_SEARCHED = ["rule_score", "pop", "recency"]
_TRIED = [-0.35, 0.0, 0.55, 1.25]


def _search_sql(view: str) -> str:
    """One round: a step tries every value for its feature, given the weights so far."""
    z = "zz AS (SELECT CASE WHEN qid % 3 = 0 THEN 'hard' ELSE 'injection' END AS es, qid, label, " + ", ".join(f"{K._z(n)} AS z{k}" for k, n in enumerate(_SEARCHED)) + " FROM f18 WINDOW w AS (PARTITION BY qid))"
    ws = "CASE es WHEN 'hard' THEN 0.35 ELSE 1.0 END"

    def mrr(name: str, score: str, extra: str) -> str:
        return f"""{name}s AS (SELECT v, es, qid, label, round({score}, 9) AS s FROM zz{extra}), {name}p AS (SELECT *, max(CASE WHEN label THEN s END) OVER (PARTITION BY v, qid) AS ps FROM {name}s),
            {name}r AS (SELECT v, es, qid, 1.0 / (1 + count(*) FILTER (s > ps) + 0.5 * (count(*) FILTER (s = ps) - 1)) AS rr FROM {name}p WHERE ps IS NOT NULL GROUP BY ALL),
            {name} AS (SELECT v, sum({ws} * m) / sum({ws}) AS m FROM (SELECT v, es, avg(rr) AS m FROM {name}r GROUP BY ALL) GROUP BY v)"""

    out = [z, mrr("t0", "z0", ", (SELECT 1.0 AS v)"), "st0 AS (SELECT 1.0 AS w0, 0.0 AS w1, 0.0 AS w2, m AS top FROM t0)"]
    grid = f"(SELECT unnest([{', '.join(f'{x}::DOUBLE' for x in _TRIED)}]) AS v)"
    logs = []
    for k, name in enumerate(_SEARCHED, 1):
        x = k - 1
        out.append(mrr(f"t{k}", f"w0 * z0 + w1 * z1 + w2 * z2 + (v - w{x}) * z{x}", f", st{k - 1}, {grid}"))
        out.append(f"b{k} AS (SELECT v, m FROM t{k} ORDER BY round(m, 8) DESC, v LIMIT 1)")
        out.append(f"st{k} AS (SELECT " + ", ".join(f"CASE WHEN m > top + 1e-8 THEN v ELSE w{j} END AS w{j}" if j == x else f"w{j}" for j in range(3)) + f", greatest(top, CASE WHEN m > top + 1e-8 THEN m ELSE top END) AS top FROM st{k - 1}, b{k})")
        logs.append(f"SELECT 1 AS round, '{name}' AS feature, a.w{x} AS \"from\", b.w{x} AS \"to\", round(b.top, 6) AS mrr FROM st{k - 1} a, st{k} b WHERE a.w{x} <> b.w{x}")
    return f"WITH {K._rule18_sql(view)}, {', '.join(out)} " + " UNION ALL ".join(logs)


@query(_search_sql("rep"))
def weight_search_log(spark, d):
    """A round of the search over two sets, a third of the queries in the place of hard lists."""
    rows = K._rule18(spark, d, "rep").cache()
    sets = {"hard": rows.filter("qid % 3 = 0"), "injection": rows.filter("qid % 3 <> 0"), "none": rows}
    _, _, log = evaluate.weight_search(evaluate.validation_sets(sets, evaluate.SET_WEIGHTS["dataset2"]), _SEARCHED, {"rule_score": 1.0}, rounds=1, grid=_TRIED)
    return rounded(spark.createDataFrame([tuple(x.values()) for x in log], "round int, feature string, from double, to double, mrr double"))


@query("SELECT round((0.35 * 0.5 + 1.0 * 0.25 + 0.85 * 0.125 + 0.15 * 1.0) / 2.35, 9) AS mrr")
def weighted_sets_mrr(spark, d):
    w = evaluate.SET_WEIGHTS["dataset2"]
    rows = [(0.5, w["hard"]), (0.25, w["injection"]), (0.125, w["low_pop"]), (1.0, w["teacher"])]
    return evaluate.weighted_mrr(spark.createDataFrame(rows, "mrr double, weight double")).withColumn("mrr", F.round("mrr", 9))


# Graph features with vectors

def _graph21_sql(regime: str) -> str:
    """The query without vectors, over another view, with vectors of both sides and the profile of a source's last 160."""
    w = features.GRAPH_RULE[regime]
    out = oracle("features_graph21_core").replace(edges_sql("mid"), edges_sql("rep"), 1)
    vectors = """ev AS (SELECT vec_id AS id, list_transform(embedding, lambda x: CAST(x AS DOUBLE)) AS vec FROM embeddings), px AS (SELECT lk.src, i, sum(vec[i] / sqrt(lk.r)) AS x FROM lk JOIN ev ON ev.id = lk.dst, range(1, 65) t(i) WHERE lk.r <= 160 GROUP BY ALL),
        py AS (SELECT src, list(x ORDER BY i) AS vec FROM px GROUP BY src), pz AS (SELECT src, list_transform(vec, lambda x: x / greatest(sqrt(list_dot_product(vec, vec)), 1e-6)) AS vec FROM py), tf AS (SELECT dst"""
    out = out.replace("tf AS (SELECT dst", vectors, 1)
    out = out.replace("coalesce(hop, 0) AS transition", "coalesce(hop, 0) AS transition, coalesce(list_dot_product(sv.vec, dv.vec), 0) AS svd, coalesce(list_dot_product(pz.vec, dv.vec), 0) AS profile, CAST(dn IS NULL AS DOUBLE) AS unknown", 1)
    out = out.replace("LEFT JOIN tf ON tf.dst = j.dst,", "LEFT JOIN tf ON tf.dst = j.dst LEFT JOIN ev sv ON sv.id = j.src LEFT JOIN ev dv ON dv.id = j.dst LEFT JOIN pz ON pz.src = j.src,", 1)
    begin, end = out.index("g AS (SELECT *, degree_cap"), out.index("k AS (SELECT *,")
    out = out[:begin] + f"g AS (SELECT *, {' + '.join(f'({x}) * {f}' for f, x in w.items())} AS rule FROM b), " + out[end:]
    out = out.replace(" AS rank_transition FROM g)", f" AS rank_transition, {K._rank('svd')} AS rank_svd, {K._rank('profile')} AS rank_profile FROM g)", 1)
    return out[: out.rindex("SELECT qid, pos, dst, label")] + f"SELECT qid, pos, dst, label, {', '.join(f'round({x}, 5) AS {x}' for x in features.GRAPH21)} FROM k"


def _graph21(spark, d, regime: str) -> DataFrame:
    v = View(spark, d, "rep")
    rows = features.graph21(v.lists, v.history, regime, vectors=(K._vectors(spark, d, "src"), K._vectors(spark, d)))
    return rows.select("qid", "pos", "dst", "label", *[F.round(x, 5).alias(x) for x in features.GRAPH21])


for _regime in features.GRAPH_RULE:
    query(_graph21_sql(_regime), f"features_graph21_{_regime}")(lambda spark, d, r=_regime: _graph21(spark, d, r))


# Training samples of sequence models

def _samples_sql(view: str, length: int) -> str:
    return f"""WITH {base_sql(view)}, si AS (SELECT src, row_number() OVER (ORDER BY src) AS id FROM (SELECT DISTINCT src FROM h)), di AS (SELECT dst, row_number() OVER (ORDER BY dst) AS id FROM (SELECT DISTINCT dst FROM h)),
        gp AS (SELECT greatest(g, 0) AS g FROM (SELECT time - lag(time) OVER (PARTITION BY src ORDER BY time, dst) AS g FROM h) WHERE g IS NOT NULL), k AS (SELECT (SELECT greatest(coalesce(ln(1 + quantile_cont(g, 0.9)), 1), 1) FROM gp) AS gs, (SELECT greatest(ln(1 + max(n)), 1) FROM (SELECT count(*) AS n FROM h GROUP BY src)) AS hs, (SELECT min(time) FROM h) AS low, (SELECT greatest(max(time) - min(time), 1) FROM h) AS span),
        ev AS (SELECT x.*, coalesce(di.id, 0) AS did, coalesce(si.id, 0) AS sid FROM (SELECT src, dst, time, seq, 0 AS phase FROM h UNION ALL SELECT src, dst, time, seq, 1 FROM v) x LEFT JOIN di ON di.dst = x.dst LEFT JOIN si ON si.src = x.src),
        st AS (SELECT *, coalesce(sum(CASE WHEN did > 0 THEN 1 ELSE 0 END) OVER o, 0) AS n, last_value(CASE WHEN did > 0 OR phase = 0 THEN time END IGNORE NULLS) OVER o AS last, coalesce(sum(CASE WHEN did > 0 OR phase = 0 THEN 1 ELSE 0 END) OVER p, 0) > 0 AS seen FROM ev
            WINDOW o AS (PARTITION BY src ORDER BY phase, time, seq ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), p AS (PARTITION BY src, dst ORDER BY phase, time, seq ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
        us AS (SELECT * FROM st WHERE phase = 1 AND did > 0 AND sid > 0 AND n > 0),
        hl AS (SELECT us.seq, list(e.did ORDER BY e.n) AS ids, list(ln(1 + greatest(us.time - e.time, 0)) / gs ORDER BY e.n) AS gaps FROM us JOIN st e ON e.src = us.src AND e.did > 0 AND e.n + 1 <= us.n AND e.n + 1 > us.n - {length}, k GROUP BY us.seq)"""


@query(_samples_sql("cold", 8) + """ SELECT us.seq, sid AS src_id, did - 1 AS label, CAST(NOT seen AS INTEGER) AS is_new_pair, round((time - low) / span, 6) AS time_pos, round(coalesce(ln(1 + greatest(time - last, 0)) / gs, 0), 6) AS gap, round(ln(1 + least(n, 8)) / hs, 6) AS hist_len,
    array_to_string(list_concat(list_transform(range(0, 8 - len(ids)), lambda i: 0), ids), ',') AS hist, round(list_sum(gaps), 5) AS gap_sum, round(gaps[1], 5) AS oldest FROM us JOIN hl USING (seq), k""")
def training_samples(spark, d):
    v = View(spark, d, "cold")
    rows, _ = sequences.training_samples(v.train, v.valid, 8)
    gaps = F.filter("hist_gap", lambda x: x > 0)
    joined = F.array_join(F.transform("hist", lambda x: x.cast("string")), ",")
    numbers = [F.round(c, 6).alias(c) for c in ("time_pos", "gap", "hist_len")]
    first = F.get("hist_gap", F.size("hist") - F.size(F.filter("hist", lambda x: x > 0)))
    return rows.select("seq", "src_id", "label", "is_new_pair", *numbers, joined.alias("hist"), F.round(F.aggregate(gaps, F.lit(0.0), lambda a, x: a + x), 5).alias("gap_sum"), F.round(first, 5).alias("oldest"))


@query(_samples_sql("cold", 8) + " SELECT count(*) FILTER (did = 0 OR sid = 0 OR n = 0) AS skipped, count(*) FILTER (did = 0) AS cold_dst, count(*) FILTER (sid = 0) AS cold_src, count(*) FILTER (sid > 0 AND n = 0) AS no_history, count(*) FILTER (did > 0 AND sid > 0 AND n > 0) AS samples FROM st WHERE phase = 1")
def training_skips(spark, d):
    v = View(spark, d, "cold")
    return sequences.training_samples(v.train, v.valid, 8)[1]


def _bucket_sql(x: str) -> str:
    return f"CASE WHEN {x} = 0 THEN '0' ELSE {K._BUCKET.replace('WHEN n ', f'WHEN {x} ')} END"


_VALUES = ["count(*) FILTER (pop > 0)", "sum(pair)", "sum(follows)"]


@query(f"""WITH {base_sql('cold')}, tl AS (SELECT * FROM (SELECT *, row_number() OVER (ORDER BY time, src, dst) AS i FROM h) WHERE i > floor((SELECT count(*) FROM h) * 0.8)), pc AS (SELECT dst, count(*) AS n FROM h GROUP BY dst), rc AS (SELECT dst, count(*) AS n FROM tl GROUP BY dst),
    lg AS (SELECT src, dst, lag(dst) OVER (PARTITION BY src ORDER BY time, dst) AS prev, row_number() OVER (PARTITION BY src ORDER BY time DESC, dst DESC) AS r FROM h), fo AS (SELECT DISTINCT prev, dst FROM lg WHERE prev IS NOT NULL),
    x AS (SELECT coalesce(pc.n, 0) AS pop, coalesce(rc.n, 0) AS recent, CAST(EXISTS (SELECT 1 FROM h WHERE h.src = v.src AND h.dst = v.dst) AS INTEGER) AS pair, CAST(fo.dst IS NOT NULL AS INTEGER) AS follows FROM v LEFT JOIN pc ON pc.dst = v.dst LEFT JOIN rc ON rc.dst = v.dst LEFT JOIN lg l ON l.src = v.src AND l.r = 1 LEFT JOIN fo ON fo.prev = l.prev AND fo.dst = v.dst),
    y AS (SELECT count(*) AS n, count(*) FILTER (pop > 0) AS k, sum(pair) AS p, sum(follows) AS f FROM x),
    z AS (SELECT 'history_rows' AS name, CAST((SELECT count(*) FROM h) AS DOUBLE) AS value UNION ALL SELECT 'valid_rows', n FROM y UNION ALL SELECT 'history_dsts', (SELECT count(DISTINCT dst) FROM h) UNION ALL SELECT 'dst_seen', k / n FROM y UNION ALL SELECT 'cold_dst', 1 - k / n FROM y
        UNION ALL SELECT 'pair_seen', p / n FROM y UNION ALL SELECT 'new_pair', 1 - p / n FROM y UNION ALL SELECT 'follows_last', f / n FROM y
        {' '.join(f"UNION ALL SELECT '{c} p{int(100 * s)}', quantile_cont({c}, {s}) FROM x" for c in ('pop', 'recent') for s in profile.SHARES)}
        {' '.join(f"UNION ALL SELECT '{c} bucket ' || {_bucket_sql(c)}, count(*) / (SELECT n FROM y) FROM x GROUP BY 1" for c in ('pop', 'recent'))})
    SELECT name, round(value, 6) AS value FROM z""".replace("LEFT JOIN fo ON fo.prev = l.prev", "LEFT JOIN fo ON fo.prev = l.dst"))
def profile_followed(spark, d):
    v = View(spark, d, "cold")
    return rounded(profile.followed(v.train, v.valid))


# Choices and functions

_Z2 = f"{K._z('rule_score')} + 5.5 * {K._z('recency')}"


@query(f"WITH {K._rule18_sql('rep')} SELECT qid, pos, dst, round({_Z2}, 6) AS stable FROM f18 WINDOW w AS (PARTITION BY qid)")
def stable_scores(spark, d):
    """Rule and a model's score (here recency) as they are fused for the stable list."""
    return rounded(scoring.stable_logits(K._rule18(spark, d, "rep"), "rule_score", "recency").select("qid", "pos", "dst", "stable"))


@query(f"""WITH {K._rule18_sql('rep')}, zz AS (SELECT qid, pos, dst, 0.9 * ({K._z('rule_score')}) + 0.1 * ({K._z('recency')}) AS l FROM f18 WINDOW w AS (PARTITION BY qid)), ex AS (SELECT *, exp(l - max(l) OVER (PARTITION BY qid)) AS x FROM zz)
    SELECT qid, pos, dst, round(x / sum(x) OVER (PARTITION BY qid), 6) AS prob FROM ex""")
def blended_probs(spark, d):
    return rounded(scoring.blended(K._rule18(spark, d, "rep"), "rule_score", "recency", 0.1).select("qid", "pos", "dst", "prob"))


@query(f"WITH {K._rule18_sql('mid')} SELECT qid, pos, dst, round(CASE WHEN src_seen > 0 AND src_hist_len > 0 THEN rule_score ELSE 0 END, 6) AS usable FROM f18")
def usable_scores(spark, d):
    """Scores of queries without a history count as 0."""
    rows = K._rule18(spark, d, "mid")
    return rounded(rows.select("qid", "pos", "dst", scoring.usable_or_zero(F.col("rule_score"), F.col("src_seen"), F.col("src_hist_len")).alias("usable")))


def _auto_sql(view: str) -> str:
    return f"SELECT '{view}' AS view, CASE WHEN bipartite OR repeat_fraction < 0.08 THEN 'new_link' ELSE 'repeat_edge' END AS rule FROM ({K._repeat_sql(view)})"


@query(" UNION ALL ".join(_auto_sql(x) for x in ("new", "mid", "rep", "type")) + " UNION ALL SELECT 'given', 'repeat_edge'")
def rule_choice(spark, d):
    names = {id(scoring.REPEAT_EDGE): "repeat_edge", id(scoring.NEW_LINK): "new_link"}
    rows = [(x, names[id(scoring.auto_weights(View(spark, d, x).history))]) for x in ("new", "mid", "rep", "type")]
    rows.append(("given", names[id(scoring.auto_weights(View(spark, d).history, "dataset1"))]))
    return spark.createDataFrame(rows, "view string, rule string")


@query(f"""WITH {base_sql('mid')}, x AS (SELECT seq, src, dst, time, (seq % 101) / 100.0 AS p, (seq % 41) - 20 AS s FROM v)
    SELECT seq, round(ln(greatest(least(p, 1 - 1e-6), 1e-6) / (1 - greatest(least(p, 1 - 1e-6), 1e-6))), 6) AS logit, round(1 / (1 + exp(-s)), 9) AS sigmoid, round((dst % 997) / 996.0, 9) AS bucket, round(-p * ln(greatest(p, 1e-12)), 9) AS entropy, round(1.0 / pow(1 + seq % 7, 0.7), 9) AS discount,
        CASE WHEN seq % 3 = 0 THEN 7.5 WHEN seq % 3 = 1 THEN 0.0 ELSE p END AS finite, '0.' || lpad(CAST(seq % 101 * 1000000 AS VARCHAR), 8, '0') AS text, {_bucket_sql('(seq % 700)')} AS popularity FROM x WHERE seq % 101 < 100""")
def scalar_functions(spark, d):
    from ..functions import scalars as S

    x = View(spark, d, "mid").valid.withColumn("p", F.col("seq") % 101 / 100.0).withColumn("s", F.col("seq") % 41 - 20).filter(F.col("seq") % 101 < 100)
    odd = F.when(F.col("seq") % 3 == 0, "7.5").when(F.col("seq") % 3 == 1, F.when(F.col("seq") % 2 == 0, "Infinity").otherwise("none")).otherwise(F.col("p").cast("string"))
    return x.select(
        "seq", F.round(S.logit(F.col("p")), 6).alias("logit"), F.round(S.sigmoid(F.col("s")), 9).alias("sigmoid"), F.round(S.id_bucket(F.col("dst")), 9).alias("bucket"), F.round(S.entropy_term(F.col("p")), 9).alias("entropy"),
        F.round(S.discount(1 + F.col("seq") % 7, 0.7), 9).alias("discount"), S.finite(odd).alias("finite"), sinks.formatted(F.array(F.col("p"))).alias("text"), S.popularity_bucket(F.col("seq") % 700).alias("popularity"),
    )


# Blocks of lists

@query(f"WITH {_sets_sql('rep')} SELECT CASE qid % {len(SETS)} WHEN 2 THEN 'hard' ELSE 'mixed' END AS block, (qid - qid % {len(SETS)}) // {len(SETS)} AS qid, pos, dst, label FROM c WHERE qid % {len(SETS)} IN (2, 3)")
def training_blocks(spark, d):
    """Hard and mixed lists one after the other."""
    v = View(spark, d, "rep")
    return C.blocks({"hard": C.hard_lists(v.queries, v.train, WIDTH), "mixed": C.mixed_lists(v.queries, v.train, v.valid.select("dst"), WIDTH)}).select("block", "qid", "pos", "dst", "label")


@query(f"WITH {lists_sql('mid')}, known AS {K._ids('SELECT DISTINCT dst FROM h')}, r AS ({K._POSITIVE} UNION ALL {K._drawn('known', '499', 9)}), {K._FIRST} SELECT qid, src, time, {K._NUMBER} AS pos, dst, m = 0 AS label FROM f")
def large_pool(spark, d):
    """Lists of 500 by a sampler that the caller gives; here of random draws, of which the vocabulary allows a hundred."""
    v = View(spark, d, "mid")
    return C.large_pool(v.queries, 500, lambda q, n: C.random_lists(q, v.train.select("dst"), n))


# Written and read back

@query(f"WITH {base_sql('mid')} SELECT src, dst, time, CASE WHEN seq % 5 = 0 THEN '1' ELSE '0' END AS split FROM e")
def csv_edges(spark, d):
    path = state.folder(spark, "edges")
    rows = View(spark, d, "mid").numbered.select("src", "dst", "time", F.when(F.col("seq") % 5 == 0, "1").otherwise("0").alias("split"))
    rows.select("split", "time", "src", "dst").write.csv(path, header=True)
    return E.read_edges(spark, path)


def _split_sql(split: str, share: float) -> str:
    return f"""WITH {base_sql('mid')}, m AS (SELECT *, {split} AS split FROM e), k AS (SELECT count(*) FILTER (split = '0') > 0 AND count(*) FILTER (split <> '0') > 0 AS two_sided, greatest(1, CAST(floor(count(*) * {share}) AS BIGINT)) AS cut FROM m)
        SELECT CASE WHEN two_sided THEN CASE WHEN split = '0' THEN 'train' ELSE 'valid' END ELSE CASE WHEN seq <= cut THEN 'train' ELSE 'valid' END END AS part, count(*) AS n, CAST(sum(src) AS BIGINT) AS srcs, CAST(sum(dst) AS BIGINT) AS dsts, min(time) AS low, max(time) AS high FROM m, k GROUP BY 1"""


def _split(spark, d, split, share: float) -> DataFrame:
    rows = View(spark, d, "mid").numbered.withColumn("split", split).drop("seq")
    train, valid = order.split_official(rows, share)
    columns = ["part", "src", "dst", "time"]
    both = train.withColumn("part", F.lit("train")).select(*columns).unionByName(valid.withColumn("part", F.lit("valid")).select(*columns))
    return both.groupBy("part").agg(F.count("*").alias("n"), F.sum("src").alias("srcs"), F.sum("dst").alias("dsts"), F.min("time").alias("low"), F.max("time").alias("high"))


query(_split_sql("CASE WHEN src % 4 = 0 THEN '1' ELSE '0' END", 0.8), "split_official")(lambda spark, d: _split(spark, d, F.when(F.col("src") % 4 == 0, "1").otherwise("0"), 0.8))
query(_split_sql("'0'", 0.8), "split_official_one_side")(lambda spark, d: _split(spark, d, F.lit("0"), 0.8))


@query(f"WITH {lists_sql('rep')} SELECT src, time, CAST(pos AS INTEGER) AS pos, dst FROM c WHERE qid IN (SELECT qid FROM c GROUP BY qid HAVING count(*) = 10)")
def csv_queries(spark, d):
    path = state.folder(spark, "queries")
    lists = View(spark, d, "rep").lists.groupBy("qid", "src", "time").agg(F.array_sort(F.collect_list(F.struct("pos", "dst"))).alias("l")).filter(F.size("l") == 10)
    lists.select("src", "time", *[F.get("l", F.lit(k))["dst"].alias(f"c{k + 1}") for k in range(10)]).write.csv(path, header=True)
    return E.exploded(E.read_queries(spark, path, 10)).drop("qid")


@query(f"WITH {K._rule18_sql('rep')}, {K._SOFT}, s8 AS (SELECT *, round(prob, 8) AS p8 FROM pb), f8 AS (SELECT *, 1 - sum(p8) OVER (PARTITION BY qid) AS rest, row_number() OVER (PARTITION BY qid ORDER BY p8 DESC, pos) = 1 AS best FROM s8) SELECT qid, pos, CAST(floor(round((CASE WHEN best THEN p8 + rest ELSE p8 END) * 1e8) / 100) AS BIGINT) AS millionths FROM f8")
def probability_file(spark, d):
    """Probabilities as they stand in the written file, line by line."""
    path = state.folder(spark, "probabilities")
    probs = K._probs(spark, d, "rep")
    sinks.write_probabilities(probs, path)
    lines = spark.read.text(path).withColumn("at", F.monotonically_increasing_id())
    ids = order.with_prefix(probs.select("qid").distinct(), ("qid",), F.lit(1), "line")
    rows = order.with_prefix(lines, ("at",), F.lit(1), "line").select("line", F.posexplode(F.split("value", ",")).alias("pos", "prob"))
    return rows.join(ids, "line").select("qid", "pos", F.floor(F.round(F.col("prob").cast("double") * 1e8) / 100).cast("long").alias("millionths"))


@query(f"WITH {base_sql('new')}, {scales_sql()} SELECT dst, n, last, {r6('sc.span')} FROM d, (SELECT span FROM sc) sc")
def state_round_trip(spark, d):
    """Statistics saved with their scales, loaded again."""
    path, history = state.folder(spark, "state"), View(spark, d).history
    state.save_state(spark, path, {"dst": history.dst_stats()}, {"span": history.scales.span})
    tables, about = state.load_state(spark, path)
    return rounded(tables["dst"].select("dst", "n", "last", F.lit(about["span"]).alias("span")))


@query(f"WITH {lists_sql('rep')} SELECT qid, pos, dst FROM c")
def shards_and_cache(spark, d):
    """Lists written in two shards, read as one table, and kept by a cache that a second call doesn't make again."""
    path, lists = state.folder(spark, "shards"), View(spark, d, "rep").lists.select("qid", "pos", "dst")
    for k in range(2):
        state.cached(spark, f"{path}/{k}", lambda k=k: lists.filter(F.col("qid") % 2 == k))
        state.cached(spark, f"{path}/{k}", lambda: lists.limit(0))
    return state.read_shards(spark, path)
