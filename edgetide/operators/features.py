"""Feature tables of candidates (qid, src, time, pos, dst[, label]) against a frozen history."""

from __future__ import annotations

import math

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions import scalars as S
from . import blocks
from . import sequences as seqs
from .order import with_seq
from .stats import History, log_scale, or_zero
from .windows import minmax, recip_rank, zscore_or_zero

RULE18 = ["rule_score", "pop", "recent_pop", "trend", "recency", "src_recent_score", "pair_seen", "pair_count", "src_degree", "src_hist_len", "dst_degree", "dst_seen", "src_seen", "dst_time_gap", "rank_rule", "rank_pop", "rank_recent", "dst_unknown"]


#: A query's own key, and its source, by which lists are dealt: windows over both need no shuffle of their rows.
OWN = ("src", "qid")
#: Sources of up to so many events hold their pairs as an array; longer ones are joined by shuffle. Statistics of so many destinations go to every task.
LISTED, HELD = 5_000, 1_500_000


def source_pairs(history: History, recent: int) -> DataFrame:
    """src, s_n, s_dst and s_pair: how many events, and of each destination the pair's statistics and its place among the recent ones. Edges
    are dealt by source once, as lists are."""
    newest = F.row_number().over(Window.partitionBy("src").orderBy(F.desc("time"), F.desc("dst")))
    rows = (history.edges.select("src", "time", "dst") if history.dealt else seqs.by_source(history.edges)).withColumn("rank", newest)
    pairs = rows.groupBy("src", "dst").agg(F.count("*").alias("p_n"), F.count_if(F.col("time") >= history.starts[0]).alias("p_recent20"), F.max("time").alias("p_last"), F.min(F.when(F.col("rank") <= recent, F.col("rank"))).alias("r_rank"))
    out = pairs.groupBy("src").agg(F.sum("p_n").alias("s_n"), F.collect_list(F.struct(F.coalesce("dst", F.lit(0)).alias("dst"), F.when(F.col("dst").isNotNull(), F.struct("p_n", "p_recent20", "p_last", "r_rank")).alias("p"))).alias("l"))
    known = F.filter("l", lambda x: x["p"].isNotNull())
    return out.withColumn("l", known).select("src", "s_n", F.transform("l", lambda x: x["dst"]).alias("s_dst"), F.transform("l", lambda x: x["p"]).alias("s_pair"))


def _joined(candidates: DataFrame, history: History, recent: int) -> DataFrame:
    """Candidates with the statistics of their destination (d_), pair (p_), source (s_) and place among the source's recent ones.
    Statistics are pre-aggregated. Candidates that are dealt by source meet their source's pairs where they are, and destinations go
    to every task; only with a very long source or very many destinations are they shuffled on a key."""
    d = history.dst_stats()
    d = d.select("dst", *[F.col(c).alias(f"d_{c}") for c in d.columns if c != "dst"])
    d = F.broadcast(d) if history.scales.dsts <= HELD else d
    if history.scales.max_src <= LISTED:
        rows = candidates.join(source_pairs(history, recent).hint("shuffle_hash"), "src", "left")
        rows = rows.withColumn("_p", F.get("s_pair", (F.array_position("s_dst", F.col("dst")) - 1).cast("int"))).select(*candidates.columns, "s_n", "_p.*")
    else:
        p = history.pair_stats().select("src", "dst", F.col("n").alias("p_n"), F.col("recent20").alias("p_recent20"), F.col("last").alias("p_last"))
        s = history.edges.groupBy("src").agg(F.count("*").alias("s_n"))
        r = seqs.first_match_rank(history.edges, recent).withColumnRenamed("rank", "r_rank")
        rows = candidates.join(p, ["src", "dst"], "left").join(r, ["src", "dst"], "left").join(s, "src", "left")
    return rows.join(d, "dst", "left")


def rule18(candidates: DataFrame, history: History) -> DataFrame:
    """The 18 features of the incremental state, frozen at the end of the history."""
    s = history.scales
    rows = _joined(candidates, history, 200)
    known = F.col("d_n").isNotNull()
    lp = lambda c: F.log1p(or_zero(c).cast("double"))
    rows = rows.withColumns({
        "pop": lp("d_n") / log_scale(s.max_dst),
        "recent_pop": lp("d_recent80") / log_scale(s.max_dst),
        "trend": S.clipped_trend(or_zero("d_recent80"), or_zero("d_older80")),
        "recency": S.hyperbolic(F.col("time"), F.col("d_last"), s.span),
        "src_recent_score": F.coalesce(1.0 / F.col("r_rank"), F.lit(0.0)),
        "pair_seen": F.col("p_n").isNotNull().cast("double"),
        "pair_count": lp("p_n") / log_scale(s.max_pair),
        "src_degree": lp("s_n") / log_scale(s.max_src),
        "src_hist_len": F.log1p(F.least(or_zero("s_n"), F.lit(200)).cast("double")) / log_scale(s.max_src),
        "dst_degree": lp("d_n") / log_scale(s.max_dst),
        "dst_seen": known.cast("double"),
        "src_seen": F.col("s_n").isNotNull().cast("double"),
        "dst_time_gap": F.when(known, F.log1p(F.greatest(F.col("time") - F.col("d_last"), F.lit(0)).cast("double")) / F.lit(_log_span(s.span))).otherwise(1.0),
        "dst_unknown": (~known).cast("double"),
    })
    rule = 1.10 * F.col("pop") + 1.35 * F.col("recent_pop") + 0.55 * F.col("trend") + 0.65 * F.col("recency") + 0.12 * F.col("src_recent_score") - 0.35 * F.col("pair_seen") - 8.0 * F.col("dst_unknown")
    rows = rows.withColumn("rule_score", rule)
    rows = rows.withColumns({"rank_rule": recip_rank(F.col("rule_score"), OWN), "rank_pop": recip_rank(F.col("pop"), OWN), "rank_recent": recip_rank(F.col("src_recent_score") + F.col("recency"), OWN)})
    return rows.select(*candidates.columns, *RULE18)


def _log_span(span: float) -> float:
    return math.log1p(span)


LISTWISE = ["z_rule", "z_pop", "z_recent_pop", "z_trend", "z_recency", "z_src_recent", "z_dst_gap", "m_rule", "m_pop", "m_recent_pop", "candidate_log_id", "candidate_id_bucket", "unknown_frac", "known_frac", "rule_max", "rule_spread", "time_pos"]


def listwise_extras(features: DataFrame, history: History) -> DataFrame:
    """17 more features that compare a candidate with the others of its query."""
    s, w = history.scales, Window.partitionBy("qid")
    c = F.col
    z = {f"z_{n}": zscore_or_zero(c(x)) for n, x in (("rule", "rule_score"), ("pop", "pop"), ("recent_pop", "recent_pop"), ("trend", "trend"), ("recency", "recency"), ("src_recent", "src_recent_score"), ("dst_gap", "dst_time_gap"))}
    m = {f"m_{n}": minmax(c(x)) for n, x in (("rule", "rule_score"), ("pop", "pop"), ("recent_pop", "recent_pop"))}
    top = F.greatest(F.max(c("dst")).over(w).cast("double"), F.lit(1.0))
    rest = {
        "candidate_log_id": F.log1p(F.greatest(c("dst"), F.lit(0)).cast("double")) / F.greatest(F.log1p(top), F.lit(1.0)),
        "candidate_id_bucket": S.id_bucket(c("dst")),
        "unknown_frac": F.avg("dst_unknown").over(w), "known_frac": 1.0 - F.avg("dst_unknown").over(w),
        "rule_max": F.max("rule_score").over(w), "rule_spread": F.max("rule_score").over(w) - F.min("rule_score").over(w),
        "time_pos": F.greatest(F.least((c("time") - s.low) / F.lit(s.span), F.lit(1.5)), F.lit(0.0)),
    }
    return features.withColumns({**z, **m, **rest})


GRAPH21 = ["rule", "pop", "recent_pop", "trend", "recency", "src_recent_exact", "pair_log", "dst_known", "degree_cap", "candidate_seen_in_test", "svd", "profile", "transition", "rank_rule", "rank_pop", "rank_recent_pop", "rank_pair", "rank_recency", "rank_svd", "rank_profile", "rank_transition"]

# Rule weights by regime.
GRAPH_RULE = {
    "dataset1": {"pair_log": 1.45, "src_recent_exact": 1.15, "pop": 0.85, "recent_pop": 1.00, "trend": 0.45, "recency": 0.45, "profile": 0.25, "transition": 0.25, "unknown": -0.20},
    "dataset2": {"degree_cap": 1.00, "recent_pop": 1.15, "trend": 0.50, "recency": 0.65, "profile": 0.15, "transition": 0.10, "pair_log": -0.28, "src_recent_exact": -0.08, "unknown": -0.80},
}


def two_hop(candidates: DataFrame, history: DataFrame, trans: DataFrame, k: int, power: float = 0.5, value=None) -> DataFrame:
    """src, dst, hop, hits: sum over the source's last k destinations of the transition's value, discounted by 1/rank**power. A source's
    candidates meet its history first, then both ends of a transition are the key: no popular `prev` is multiplied by its transitions."""
    own = candidates.select("src", F.col("dst").alias("next")).distinct()
    h = seqs.last_k(history, k).select("src", F.col("dst").alias("prev"), "rank")
    v = F.col("w") if value is None else value
    rows = own.join(h, "src").join(trans, ["prev", "next"])
    return rows.groupBy("src", F.col("next").alias("dst")).agg(F.sum(v * S.discount(F.col("rank"), power)).alias("hop"), F.count("*").alias("hits"))


def graph21(candidates: DataFrame, history: History, regime: str = "dataset2", tests: DataFrame | None = None, vectors: tuple[DataFrame, DataFrame] | None = None, recent: int = 160, width: int = 16, topk: int = 256, wanted: list[str] | None = None) -> DataFrame:
    """The 21 graph features, or those wanted: two-hop scores are left out if no wanted one has to do with them. vectors: (src, vec) and (dst, vec) of a decomposition, for svd and profile; without them those are 0. Two-hop
    scores of a history that is dealt are made by blocks of destinations, unless a source is very long or destinations very many."""
    s = history.scales
    rows = _joined(candidates, history, recent)
    if wanted is not None and not {"rule", "transition", "rank_rule", "rank_transition"} & {*wanted}:
        rows = rows.withColumn("hop", F.lit(None).cast("double"))
    elif history.dealt and s.max_src <= LISTED and s.dsts <= HELD:
        counts, n = history.dst_stats().select("dst", "n"), int(candidates.sparkSession.conf.get("spark.sql.shuffle.partitions"))
        starts, own = blocks.bounds(history.edges, n), blocks.source_sequences(history.edges)
        hops = blocks.block_hops(own, candidates, blocks.block_transitions(own, counts, starts, width, topk), starts, 24)
        rows = rows.join(hops.hint("shuffle_hash"), "src", "left").withColumn("hop", F.get("h_hop", (F.array_position("h_dst", F.col("dst")) - 1).cast("int"))).drop("h_hop", "h_dst")
    else:
        counts = history.edges.groupBy("dst").agg(F.count("*").alias("n"))
        trans = seqs.normalised(seqs.window_pairs(history.edges, width, "root"), counts, topk)
        rows = rows.join(two_hop(candidates, history.edges, trans, 24).select("src", "dst", "hop"), ["src", "dst"], "left")
    seen = candidates if tests is None else tests
    freq = seen.groupBy("dst").agg(F.count("*").alias("t_n")).persist()  # a row for each destination
    most, asked = freq.agg(F.max("t_n"), F.count("*")).head()
    most = most or 1
    rows = rows.join(F.broadcast(freq) if asked <= HELD else freq, "dst", "left")
    if vectors is None:
        rows = rows.withColumns({"svd": F.lit(0.0), "profile": F.lit(0.0)})
    else:
        from .linalg import source_profile

        src_vec, dst_vec = vectors[0], F.broadcast(vectors[1]) if s.dsts <= HELD else vectors[1]
        profile = source_profile(history.edges, dst_vec, recent)
        rows = rows.join(src_vec.select("src", F.col("vec").alias("sv")), "src", "left").join(dst_vec.select("dst", F.col("vec").alias("dv")), "dst", "left").join(profile.select("src", F.col("vec").alias("pv")), "src", "left")
        rows = rows.withColumns({"svd": F.coalesce(S.dot(F.col("sv"), F.col("dv")), F.lit(0.0)), "profile": F.coalesce(S.dot(F.col("pv"), F.col("dv")), F.lit(0.0))})
    lp = lambda c: F.log1p(or_zero(c).cast("double"))
    old = or_zero("d_mid82") + or_zero("d_older82") * 0.25
    rows = rows.withColumns({
        "pop": lp("d_n") / log_scale(s.max_dst), "recent_pop": lp("d_recent82") / log_scale(s.max_recent82),
        "trend": F.greatest(F.least(lp("d_recent82") - F.log1p(old), F.lit(5.0)), F.lit(-5.0)) / 5.0,
        "recency": S.hyperbolic(F.col("time"), F.col("d_last"), s.span), "src_recent_exact": F.coalesce(1.0 / F.sqrt("r_rank"), F.lit(0.0)),
        "pair_log": lp("p_n") / log_scale(s.max_pair), "dst_known": F.col("d_n").isNotNull().cast("double"),
        "candidate_seen_in_test": lp("t_n") / log_scale(most), "transition": F.coalesce("hop", F.lit(0.0)),
    }).withColumn("degree_cap", F.least("pop", F.lit(0.72))).withColumn("unknown", 1.0 - F.col("dst_known"))
    rule = sum((w * F.col(f) for f, w in GRAPH_RULE[regime].items()), F.lit(0.0))
    rows = rows.withColumn("rule", rule)
    ranks = {"rank_rule": "rule", "rank_pop": "pop", "rank_recent_pop": "recent_pop", "rank_pair": "pair_log", "rank_recency": "recency", "rank_svd": "svd", "rank_profile": "profile", "rank_transition": "transition"}
    rows = rows.withColumns({name: recip_rank(F.col(x), OWN) for name, x in ranks.items()})
    return rows.select(*candidates.columns, *(GRAPH21 if wanted is None else wanted))


def common_neighbours(candidates: DataFrame, history: History, beta: float = 0.02, topk: int = 256) -> DataFrame:
    """src, dst, time of candidates with temporal_cn, temporal_aa, temporal_ra over the newest `topk` out- and in-neighbours. A candidate is
    multiplied by the neighbours of the end that has fewer, and those are looked up among the other's."""
    s = history.scales
    last = history.edges.groupBy("src", "dst").agg(F.max("time").alias("t"))
    out = last.withColumn("r", F.row_number().over(Window.partitionBy("src").orderBy(F.desc("t"), "dst"))).filter(F.col("r") <= topk)
    into = last.withColumn("r", F.row_number().over(Window.partitionBy("dst").orderBy(F.desc("t"), "src"))).filter(F.col("r") <= topk)
    degree = out.select(F.col("src").alias("node")).unionAll(into.select("dst")).groupBy("node").agg(F.count("*").alias("degree"))
    own = candidates.select("src", "dst", "time").distinct()
    o = out.select("src", F.col("dst").alias("node"), F.col("t").alias("t1"))
    i = into.select("dst", F.col("src").alias("node"), F.col("t").alias("t2"))
    few = own.join(o.groupBy("src").agg(F.count("*").alias("n1")), "src").join(i.groupBy("dst").agg(F.count("*").alias("n2")), "dst")
    by_src = few.filter("n1 <= n2").drop("n1", "n2").join(o, "src").join(i, ["dst", "node"])
    by_dst = few.filter("n1 > n2").drop("n1", "n2").join(i, "dst").join(o, ["src", "node"])
    rows = by_src.unionByName(by_dst).join(degree, "node")
    age = F.greatest(F.col("time") - F.greatest("t1", "t2"), F.lit(0)) / F.lit(s.span)
    rows = rows.withColumn("decay", F.exp(-beta * age * 100.0)).withColumn("k", F.greatest("degree", F.lit(1)).cast("double"))
    return rows.groupBy("src", "dst", "time").agg(
        F.log1p(F.sum("decay")).alias("temporal_cn"), F.log1p(F.sum(F.col("decay") / F.ln(2.0 + F.col("k")))).alias("temporal_aa"), F.log1p(F.sum(F.col("decay") / (1.0 + F.col("k")))).alias("temporal_ra"))


BUILDER45 = ["bias", "has_pair", "is_new_pair", "pair_count", "pair_recent_count", "pair_recency", "pair_time_gap", "edge_decay", "in_recent_5", "in_recent_10", "in_recent_20", "in_recent_50", "recent_count", "recent_decay_count", "recent_rank_score", "is_last_dst", "dst_seen", "dst_popularity", "dst_recent_popularity", "dst_recent_popularity_10", "dst_recent_popularity_05", "dst_pop_decay", "dst_trend", "dst_trend_10", "src_activity", "src_unique_dst", "src_recent_unique_20", "src_repeat_rate", "src_avg_gap", "is_cold_dst", "dst_recency", "dst_time_gap", "dst_unique_src", "last_transition", "last_reverse_transition", "last_cooc", "recent_transition_score", "reverse_recent_transition_score", "recent_transition_hits", "recent_cooc_score", "reverse_recent_cooc_score", "recent_cooc_hits", "temporal_cn", "temporal_aa", "temporal_ra"]


def builder45(candidates: DataFrame, history: History, recent: int = 100, width: int = 8, newest: int = 300, topk: int = 300) -> DataFrame:
    """The 45 features of pairs, recent lists, destinations, sources, sequences and structure, and the alias item_transition."""
    s, e = history.scales, history.edges
    n = seqs.transitions(e).withColumn("w", F.col("n").cast("double")).drop("n")
    cooc = seqs.window_pairs(e, width, "inverse", newest)
    turn = lambda x: x.select(F.col("next").alias("prev"), F.col("prev").alias("next"), "w")
    tables = {"t": seqs.pruned(n, topk), "rt": seqs.pruned(turn(n), topk), "c": seqs.pruned(cooc, topk), "rc": seqs.pruned(turn(cooc), topk)}
    rows = _joined(candidates, history, recent)
    for name, t in tables.items():
        hops = two_hop(candidates, e, t, recent, 0.7, F.log1p("w"))
        rows = rows.join(hops.select("src", "dst", F.col("hop").alias(f"{name}_hop"), F.col("hits").alias(f"{name}_hits")), ["src", "dst"], "left")
    last = seqs.last_value(e).select("src", "last_dst")
    rows = rows.join(last, "src", "left")
    for name in ("t", "rt", "c"):
        rows = rows.join(tables[name].select(F.col("prev").alias("last_dst"), F.col("next").alias("dst"), F.col("w").alias(f"{name}_last")), ["last_dst", "dst"], "left")
    same = seqs.last_k(e, recent).groupBy("src", "dst").agg(F.count("*").alias("m_n"), F.sum(S.discount(F.col("rank"), 0.7)).alias("m_decay"))
    unique20 = seqs.last_k(e, 20).groupBy("src").agg(F.countDistinct("dst").alias("u20"))
    src = history.src_stats().select("src", F.col("unique_dst").alias("s_unique"), F.col("repeat_rate").alias("s_repeat"), F.col("avg_gap").alias("s_gap"))
    rows = rows.join(same, ["src", "dst"], "left").join(unique20, "src", "left").join(src, "src", "left").join(common_neighbours(candidates, history), ["src", "dst", "time"], "left")
    c = F.col
    lp = lambda x: F.log1p(or_zero(x).cast("double"))
    zero = lambda x: F.coalesce(c(x), F.lit(0.0))
    flag = lambda x: F.coalesce(x, F.lit(False)).cast("double")
    out = {
        "bias": F.lit(1.0), "has_pair": flag(c("p_n") > 0), "is_new_pair": 1.0 - flag(c("p_n") > 0), "pair_count": lp("p_n"), "pair_recent_count": lp("p_recent20"),
        "pair_recency": S.hyperbolic(c("time"), c("p_last"), s.span, 20.0), "pair_time_gap": S.log_gap(c("time"), c("p_last")), "edge_decay": S.decayed(or_zero("p_n"), c("time"), c("p_last"), s.span, 0.02),
        **{f"in_recent_{k}": flag(c("r_rank") <= k) for k in (5, 10, 20, 50)},
        "recent_count": lp("m_n"), "recent_decay_count": zero("m_decay"), "recent_rank_score": F.coalesce(1.0 / c("r_rank"), F.lit(0.0)), "is_last_dst": flag(c("last_dst") == c("dst")),
        "dst_seen": flag(c("d_n") > 0), "dst_popularity": lp("d_n"), "dst_recent_popularity": lp("d_recent20"), "dst_recent_popularity_10": lp("d_recent10"), "dst_recent_popularity_05": lp("d_recent05"),
        "dst_pop_decay": S.decayed(or_zero("d_n"), c("time"), c("d_last"), s.span, 0.01), "dst_trend": lp("d_recent20") - F.log1p((or_zero("d_n") - or_zero("d_recent20")).cast("double")),
        "dst_trend_10": lp("d_recent10") - F.log1p((or_zero("d_n") - or_zero("d_recent10")).cast("double")),
        "src_activity": lp("s_n"), "src_unique_dst": lp("s_unique"), "src_recent_unique_20": lp("u20"), "src_repeat_rate": zero("s_repeat"), "src_avg_gap": F.log1p(zero("s_gap")),
        "is_cold_dst": 1.0 - flag(c("d_n") > 0), "dst_recency": S.hyperbolic(c("time"), c("d_last"), s.span, 20.0), "dst_time_gap": S.log_gap(c("time"), c("d_last")), "dst_unique_src": lp("d_sources"),
        "last_transition": F.log1p(zero("t_last")), "last_reverse_transition": F.log1p(zero("rt_last")), "last_cooc": F.log1p(zero("c_last")),
        "recent_transition_score": zero("t_hop"), "reverse_recent_transition_score": zero("rt_hop"), "recent_transition_hits": lp("t_hits"),
        "recent_cooc_score": zero("c_hop"), "reverse_recent_cooc_score": zero("rc_hop"), "recent_cooc_hits": lp("c_hits"),
        "temporal_cn": zero("temporal_cn"), "temporal_aa": zero("temporal_aa"), "temporal_ra": zero("temporal_ra"),
    }
    return rows.select(*candidates.columns, *[v.alias(k) for k, v in out.items()], F.log1p(zero("t_last")).alias("item_transition"))


def dst_table(history: History, vocabulary: DataFrame) -> DataFrame:
    """Eight static features of each destination of a vocabulary; unseen ones have the least time as their last."""
    s = history.scales
    d = history.dst_stats()
    top = vocabulary.agg(F.max("dst")).head()[0] or 1
    sources = d.agg(F.max("recent_sources")).head()[0] or 1
    rows = vocabulary.select("dst").distinct().join(d, "dst", "left")
    lp = lambda c: F.log1p(or_zero(c).cast("double"))
    return rows.select(
        "dst", (lp("n") / log_scale(s.max_dst)).alias("total_log"), (lp("recent80") / log_scale(s.max_recent80)).alias("recent_log"),
        S.clipped_trend(or_zero("recent80"), or_zero("older80")).alias("trend"),
        (1.0 / (1.0 + F.greatest(F.lit(s.high) - F.coalesce("last", F.lit(s.low)), F.lit(0)) / F.lit(s.span))).alias("recency"),
        (lp("recent_sources") / log_scale(sources)).alias("source_log"), F.lit(1.0).alias("one"),
        (F.log1p(F.col("dst").cast("double")) / max(math.log1p(float(top)), 1.0)).alias("log_id"), S.id_bucket(F.col("dst")).alias("id_bucket"),
    )


def block_rule(candidates: DataFrame, history: DataFrame, window: int = 200_000) -> DataFrame:
    """pop, recent, transition and their summed z-scores; recent counts the last `window` edges."""
    from .windows import zscore

    rows = history if "seq" in history.columns else with_seq(history)
    n = rows.agg(F.max("seq")).head()[0] or 0
    d = rows.groupBy("dst").agg(F.count("*").alias("n"), F.count_if(F.col("seq") > n - window).alias("r"))
    t = seqs.transitions(rows)
    own = candidates.join(seqs.last_value(rows).select("src", F.col("last_dst").alias("prev")), "src", "left").join(d, "dst", "left").join(t.select("prev", F.col("next").alias("dst"), F.col("n").alias("t")), ["prev", "dst"], "left")
    lp = lambda c: F.log1p(or_zero(c).cast("double"))
    own = own.select(*candidates.columns, lp("n").alias("pop"), lp("r").alias("recent"), lp("t").alias("transition"))
    return own.withColumn("rule", zscore(F.col("pop")) + zscore(F.col("recent")) + zscore(F.col("transition")))


def context14(base: DataFrame, history: History, src_vec: DataFrame, dst_vec: DataFrame, length: int = 64) -> DataFrame:
    """The 14 context features of rows with pop, recent_pop and profile: cosines with the source's last destinations and the candidate's
    audience. dst_vec and src_vec: id and unit-length vec."""
    from .linalg import audience, mean_vector

    small = F.broadcast if history.scales.dsts <= HELD else lambda x: x
    unit = small(dst_vec.select("dst", S.unit(F.col("vec")).alias("dv")))
    h = seqs.last_k(history.edges, length).join(unit, "dst")
    mean = mean_vector(h.select("src", F.col("dv").alias("vec")), "src").select("src", S.unit(F.col("vec")).alias("hm"))
    newest = h.withColumn("_r", F.row_number().over(Window.partitionBy("src").orderBy("rank"))).filter("_r = 1").select("src", F.col("dv").alias("hl"))
    own = base.select("src", "dst").distinct()
    best = own.join(unit, "dst").join(h.select("src", F.col("dv").alias("hv")), "src").groupBy("src", "dst").agg(F.max(S.dot(F.col("dv"), F.col("hv"))).alias("seq_max"))
    held = history.dealt and history.scales.max_src <= LISTED
    by_dst = seqs.last_k(history.edges, length, "dst", "src")
    by_dst = by_dst.persist() if held else by_dst  # read by audiences and hits
    aud = audience(by_dst, src_vec, length)
    aud = aud.persist() if held else aud
    most = aud.agg(F.max("log_n")).head()[0] or 1.0
    aud = small(aud)
    hit = by_dst.select("dst", "src").distinct().withColumn("hit", F.lit(1.0))
    activity = history.edges.groupBy("src").agg(F.log1p(F.count("*").cast("double")).alias("a"))
    rows = base.join(unit, "dst", "left").join(mean, "src", "left").join(newest, "src", "left")
    if held:  # what a source has of its destinations meets its candidates as arrays, where they were dealt
        best = best.groupBy("src").agg(F.collect_list(F.struct("dst", "seq_max")).alias("l")).select("src", F.transform("l", lambda x: x["dst"]).alias("b_dst"), F.transform("l", lambda x: x["seq_max"]).alias("b_max"))
        hits = by_dst.groupBy("src").agg(F.collect_set("dst").alias("h_dst"))
        rows = rows.join(best.hint("shuffle_hash"), "src", "left").join(hits.hint("shuffle_hash"), "src", "left")
        rows = rows.withColumn("seq_max", F.get("b_max", (F.array_position("b_dst", F.col("dst")) - 1).cast("int"))).withColumn("hit", F.when(F.array_contains("h_dst", F.col("dst")), 1.0))
        rows = rows.drop("b_dst", "b_max", "h_dst")
    else:
        rows = rows.join(best, ["src", "dst"], "left").join(hit, ["src", "dst"], "left")
    rows = rows.join(aud, "dst", "left").join(src_vec.select("src", S.unit(F.col("vec")).alias("sv")), "src", "left")
    rows = rows.join(activity, "src", "left").join(seqs.coverage(history.edges, length, length), "src", "left")
    zero = lambda c: F.coalesce(c, F.lit(0.0))
    rows = rows.withColumns({
        "seq_mean": zero(S.dot(F.col("dv"), F.col("hm"))), "seq_max": zero(F.col("seq_max")), "seq_last": zero(S.dot(F.col("dv"), F.col("hl"))),
        "audience_dot": zero(S.dot(F.col("av"), F.col("sv"))), "audience_count": zero(F.col("log_n") / F.lit(max(float(most), 1.0))), "recent_source_hit": zero(F.col("hit")),
        "source_activity": zero(F.col("a") / log_scale(history.scales.max_src)), "source_recent_coverage": zero(F.col("coverage")), "source_history_fill": zero(F.col("fill")),
    })
    rows = rows.withColumns({"rank_seq_max": recip_rank(F.col("seq_max"), OWN), "rank_audience_dot": recip_rank(F.col("audience_dot"), OWN), **{f"{c}_activity": F.col(c) * F.col("source_activity") for c in ("pop", "recent_pop", "profile")}})
    names = ["seq_mean", "seq_max", "seq_last", "audience_dot", "audience_count", "recent_source_hit", "rank_seq_max", "rank_audience_dot", "source_activity", "source_recent_coverage", "source_history_fill", "pop_activity", "recent_pop_activity", "profile_activity"]
    return rows.select(*base.columns, *names)
