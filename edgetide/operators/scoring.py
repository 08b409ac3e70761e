"""Scores of feature tables: linear rules, intensities, fusion, policies for unknown destinations."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import scalars as S
from .features import _joined
from .stats import History, log_scale, or_zero
from .windows import KEY, softmax, zscore

# Weights of the repeat-edge and the new-link rule.
REPEAT_EDGE = {
    "bias": 0.0, "has_pair": 4.0, "pair_count": 6.5, "pair_recent_count": 2.0, "pair_recency": 5.5, "edge_decay": 2.2, "in_recent_5": 3.0, "in_recent_10": 2.0, "in_recent_20": 1.2, "in_recent_50": 0.7,
    "recent_count": 1.2, "recent_decay_count": 1.5, "recent_rank_score": 2.0, "is_last_dst": 2.5, "dst_seen": 0.2, "dst_popularity": 0.35, "dst_recent_popularity": 0.55, "dst_recent_popularity_10": 0.25,
    "dst_pop_decay": 0.35, "dst_trend": 0.25, "dst_recency": 0.45, "dst_unique_src": 0.15, "src_repeat_rate": 0.8, "is_cold_dst": -2.0, "last_transition": 1.8, "last_cooc": 0.8, "recent_transition_score": 1.1,
    "recent_transition_hits": 0.4, "recent_cooc_score": 0.9, "recent_cooc_hits": 0.35, "reverse_recent_transition_score": 0.3, "reverse_recent_cooc_score": 0.25, "temporal_cn": 0.8, "temporal_aa": 0.5, "temporal_ra": 0.3,
}
NEW_LINK = {
    "bias": 0.0, "has_pair": -2.8, "pair_count": -1.8, "pair_recent_count": -1.2, "pair_recency": -0.5, "edge_decay": -0.4, "in_recent_5": -1.2, "in_recent_10": -0.9, "in_recent_20": -0.6, "in_recent_50": -0.35,
    "recent_count": -0.4, "recent_decay_count": -0.4, "is_last_dst": -1.4, "is_new_pair": 0.8, "dst_seen": 2.4, "is_cold_dst": -5.5, "dst_popularity": 0.9, "dst_unique_src": 0.65, "dst_recent_popularity": 1.4,
    "dst_recent_popularity_10": 1.2, "dst_recent_popularity_05": 0.9, "dst_pop_decay": 0.9, "dst_trend": 0.7, "dst_trend_10": 0.45, "dst_recency": 1.2, "src_activity": 0.05, "src_unique_dst": 0.05,
    "last_transition": 2.2, "last_reverse_transition": 0.15, "last_cooc": 1.6, "recent_transition_score": 2.8, "recent_transition_hits": 0.7, "recent_cooc_score": 2.2, "recent_cooc_hits": 0.65,
    "reverse_recent_transition_score": 0.25, "reverse_recent_cooc_score": 0.25, "temporal_cn": 0.7, "temporal_aa": 0.5, "temporal_ra": 0.3,
}
# Parts of the base intensity, and their weights by regime.
PARTS = {
    "edge": {"edge_decay": 2.0, "pair_count": 1.4, "pair_recent_count": 1.8, "pair_recency": 2.0, "recent_decay_count": 1.0, "in_recent_5": 1.0, "in_recent_20": 0.7},
    "pop": {"dst_popularity": 0.8, "dst_recent_popularity": 1.2, "dst_recent_popularity_10": 1.0, "dst_recent_popularity_05": 0.7, "dst_pop_decay": 0.9, "dst_trend": 0.8, "dst_trend_10": 0.5, "dst_recency": 0.6},
    "seq": {"last_transition": 1.4, "last_cooc": 1.0, "recent_transition_score": 1.4, "recent_cooc_score": 1.0, "recent_transition_hits": 0.6, "recent_cooc_hits": 0.5, "reverse_recent_transition_score": 0.4},
    "struct": {"temporal_cn": 1.0, "temporal_aa": 0.6, "temporal_ra": 0.4},
    "cold": {"is_cold_dst": 1.0},
}
BASE = {
    "dataset1": {"edge": 0.42, "pop": 0.15, "seq": 0.16, "struct": 0.12, "rule": 0.15, "cold": -1.75},
    "dataset2": {"edge": 0.05, "pop": 0.35, "seq": 0.28, "struct": 0.10, "rule": 0.22, "cold": -2.35},
}
RULES = {"dataset1": REPEAT_EDGE, "dataset2": NEW_LINK}


def linear(weights: dict[str, float], columns: list[str] | None = None) -> Column:
    """Sum of weight times feature; terms of weight 0 and features that the table lacks fall away."""
    terms = [w * F.col(f) for f, w in weights.items() if abs(w) >= 1e-12 and (columns is None or f in columns)]
    return sum(terms[1:], terms[0]) if terms else F.lit(0.0)


def auto_weights(history: History, regime: str | None = None) -> dict[str, float]:
    """A known regime's rule; else the new-link rule where the sides share no ids or pairs hardly repeat."""
    if regime in RULES:
        return RULES[regime]
    row = history.repeats().head()
    return NEW_LINK if row.bipartite or row.repeat_fraction < 0.08 else REPEAT_EDGE


def base_intensity(features: DataFrame, regime: str = "dataset1", rule: dict[str, float] | None = None) -> DataFrame:
    """Add part_edge ... part_cold, rule and base of the 45 features."""
    rows = features.withColumns({f"part_{p}": linear(w) for p, w in PARTS.items()} | {"rule": linear(rule or RULES[regime])})
    return rows.withColumn("base", sum((w * F.col("rule" if p == "rule" else f"part_{p}") for p, w in BASE[regime].items()), F.lit(0.0)))


def repeat_final(scored: DataFrame, base_weight: float = 0.55, rule_weight: float = 0.15, cold_penalty: float = 0.05, temperature: float = 1.0) -> DataFrame:
    """final and prob from base, rule and is_cold_dst."""
    rows = scored.withColumn("final", base_weight * zscore(F.col("base")) + rule_weight * zscore(F.col("rule")) - cold_penalty * F.col("is_cold_dst"))
    return softmax(rows, "final", temperature=temperature)


def fast_rule(candidates: DataFrame, history: History) -> DataFrame:
    """Score without features kept: unseen destinations get -8."""
    s = history.scales
    rows = _joined(candidates, history, 200)
    lp = lambda c: F.log1p(or_zero(c).cast("double"))
    score = (1.10 * lp("d_n") / log_scale(s.max_dst) + 1.35 * lp("d_recent80") / log_scale(s.max_recent80) + 0.55 * S.clipped_trend(or_zero("d_recent80"), or_zero("d_older80"))
        + 0.65 * S.hyperbolic(F.col("time"), F.col("d_last"), s.span) + 0.12 * F.coalesce(1.0 / F.col("r_rank"), F.lit(0.0)) - 0.35 * F.col("p_n").isNotNull().cast("double"))
    return rows.select(*candidates.columns, F.when(F.col("d_n").isNull(), F.lit(-8.0)).otherwise(score).alias("score"))


def popularity_score(candidates: DataFrame, history: History) -> DataFrame:
    d = history.edges.groupBy("dst").agg(F.count("*").alias("n"))
    return candidates.join(d, "dst", "left").select(*candidates.columns, F.log1p(or_zero("n").cast("double")).alias("score"))


def recency_score(candidates: DataFrame, history: History) -> DataFrame:
    """3 / rank among the source's last 200, and the recency of the destination."""
    rows = _joined(candidates, history, 200)
    return rows.select(*candidates.columns, (F.coalesce(3.0 / F.col("r_rank"), F.lit(0.0)) + S.hyperbolic(F.col("time"), F.col("d_last"), history.scales.span)).alias("score"))


def fused(df: DataFrame, weights: dict[str, float], out: str = "fused", key=KEY) -> DataFrame:
    """Weighted sum of z-scores within a query."""
    return df.withColumn(out, sum((w * zscore(F.col(c), key) for c, w in weights.items()), F.lit(0.0)))


def cold_prior(key=KEY) -> Column:
    """Centred log id over its range in the query, within -1..1; a quarter of it for known destinations. Needs dst, dst_unknown."""
    w = Window.partitionBy(*key)
    x = F.log1p(F.greatest("dst", F.lit(0)).cast("double"))
    norm = (x - F.avg(x).over(w)) / F.greatest(F.max(x).over(w) - F.min(x).over(w), F.lit(1e-6))
    norm = F.greatest(F.least(norm, F.lit(1.0)), F.lit(-1.0))
    return F.when(F.col("dst_unknown") > 0.5, norm).otherwise(0.25 * norm)


POLICIES = ("neutral", "mild_penalty", "boost_by_id_prior", "constant", "demote")


def with_unknown_policy(df: DataFrame, score: str, policy: str = "demote", fallback: float = -8.0, margin: float = 5.0, cold_weight: float = 0.0, out: str = "adjusted", key=KEY) -> DataFrame:
    """Scores with unknown destinations treated by policy. Queries without unknown ones only get the prior,
    of the given weight; boost gives others a quarter of it at least."""
    S.one_of(policy, POLICIES, "policy")
    w = Window.partitionBy(*key)
    unknown, x = F.col("dst_unknown") > 0.5, F.col(score)
    floor = F.min(F.when(~unknown, x)).over(w)
    if policy == "mild_penalty":
        y = F.when(unknown, x - abs(margin)).otherwise(x)
    elif policy == "constant":
        y = F.when(unknown, F.lit(float(fallback))).otherwise(x)
    elif policy == "demote":
        y = F.when(unknown, F.when(floor.isNull(), F.lit(0.0)).otherwise(F.least(F.lit(float(fallback)), floor - abs(margin)))).otherwise(x)
    else:
        y = x
    rows = df.withColumn("_prior", cold_prior(key)).withColumn("_y", y)
    weight = F.lit(float(cold_weight))
    if policy == "boost_by_id_prior":
        weight = F.when(F.max(F.col("dst_unknown")).over(w) > 0.5, F.lit(max(cold_weight, 0.25))).otherwise(weight)
    y2 = F.col("_y") + F.col("_prior") * weight
    return rows.withColumn(out, y2).drop("_prior", "_y")


def unseen_fallback(df: DataFrame, score: str, margin: float = 1.0, out: str = "adjusted", key=KEY) -> DataFrame:
    """Unknown: the least known score minus a margin; queries without a known destination get zeros."""
    w = Window.partitionBy(*key)
    floor = F.min(F.when(F.col("dst_unknown") <= 0.5, F.col(score))).over(w)
    return df.withColumn(out, F.when(floor.isNull(), 0.0).when(F.col("dst_unknown") > 0.5, floor - margin).otherwise(F.col(score)))


def usable_or_zero(score: Column, src_seen: Column, hist_len: Column) -> Column:
    return F.when((src_seen > 0) & (hist_len > 0), score).otherwise(0.0)


def stable_logits(df: DataFrame, feature: str, mlp: str, out: str = "stable") -> DataFrame:
    return fused(df, {feature: 1.0, mlp: 5.5}, out)


def blended(df: DataFrame, stable: str, context: str, blend: float) -> DataFrame:
    if not 0 <= blend <= 1:
        raise ValueError("blend must be from 0 to 1")
    return softmax(fused(df, {stable: 1 - blend, context: blend}, "logit"), "logit")


def blend_sweep(df: DataFrame, stable: str, context: str, blends: list[float]) -> DataFrame:
    """One table for all blends: blend, then prob within (blend, qid). z-scores are taken once."""
    rows = df.withColumn("_s", zscore(F.col(stable))).withColumn("_c", zscore(F.col(context)))
    rows = rows.withColumn("blend", F.explode(F.array(*[F.lit(float(b)) for b in blends])))
    rows = rows.withColumn("logit", (1 - F.col("blend")) * F.col("_s") + F.col("blend") * F.col("_c")).drop("_s", "_c")
    return softmax(rows, "logit", key=("blend", "qid"))


def seed_ensemble(df: DataFrame, score: str) -> DataFrame:
    """Mean over seeds of z-scored logits: rows (seed, qid, pos, score) to (qid, pos, score)."""
    rows = df.withColumn("_z", zscore(F.col(score), ("seed", "qid")))
    return rows.groupBy("qid", "pos").agg(F.avg("_z").alias(score))
