"""Ranking metrics, buckets and reports over scored lists (qid, pos, dst, label, score)."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions import scalars as S
from .order import exact_percentiles, percentile_held, with_prefix
from .windows import argmax, own_key, top_k, zscore


def ranks(scored: DataFrame, score: str = "score", key=("qid",)) -> DataFrame:
    """For each query with a positive: how many score higher, how many others equally, optimistic and mid-rank reciprocal ranks. The
    positive's score spreads over its query in a window, so no second shuffle is needed."""
    w = Window.partitionBy(*key)
    p = F.max(F.when(F.col("label"), F.col(score))).over(w)
    rows = scored.withColumn("_p", p).filter(F.col("_p").isNotNull())
    x = F.round(F.col(score), 9)
    y = F.round(F.col("_p"), 9)
    out = rows.groupBy(*key).agg(F.count_if(x > y).alias("greater"), (F.count_if(x == y) - 1).alias("equal_other"), F.count("*").alias("n"))
    return out.withColumn("rr_optimistic", 1.0 / (1 + F.col("greater"))).withColumn("rr_mid", 1.0 / (1.0 + F.col("greater") + 0.5 * F.col("equal_other")))


def metrics(scored: DataFrame, score: str = "score", k: int = 10) -> DataFrame:
    r = ranks(scored, score)
    return r.agg(F.avg("rr_optimistic").alias("mrr"), F.avg("rr_mid").alias("mrr_mid"), F.avg((F.col("greater") + 1 <= k).cast("double")).alias(f"hit{k}"), F.count("*").alias("queries"))


BUCKETS = ["overall", "repeated", "new_pair", "cold_dst", "cold_src", "no_history_src"]


def bucket_flags(queries: DataFrame, history: DataFrame) -> DataFrame:
    """qid and the array of buckets of its positive (qid, src, dst)."""
    flag = lambda keys, name: history.select(*keys).distinct().withColumn(name, F.lit(True))
    rows = queries.join(flag(["src", "dst"], "p"), ["src", "dst"], "left").join(flag(["dst"], "d"), "dst", "left").join(flag(["src"], "s"), "src", "left")
    seen = {c: F.coalesce(F.col(c), F.lit(False)) for c in "pds"}
    names = F.array(F.lit("overall"), F.when(seen["p"], "repeated").otherwise("new_pair"), F.when(~seen["d"], "cold_dst"), F.when(~seen["s"], "cold_src"), F.when(~seen["s"], "no_history_src"))
    return rows.select("qid", F.filter(names, lambda x: x.isNotNull()).alias("buckets"))


def bucketed(rr: DataFrame, flags: DataFrame, column: str = "rr_optimistic") -> DataFrame:
    """bucket, mrr, events: queries that couldn't be scored count as 0."""
    rows = flags.join(rr.select("qid", column), "qid", "left").select(F.explode("buckets").alias("bucket"), F.coalesce(column, F.lit(0.0)).alias("rr"))
    return rows.groupBy("bucket").agg(F.avg("rr").alias("mrr"), F.count("*").alias("events"))


def wide_ranks(scored: DataFrame, names: list[str], mid: bool = True) -> DataFrame:
    """qid and a reciprocal rank for each of several scores, of queries with a positive: one shuffle for all, no row is multiplied. A null
    score is no candidate; where the positive's is null, so is its reciprocal rank."""
    key = own_key(scored)
    w = Window.partitionBy(*key)
    x = {n: F.round(F.col(n).cast("double"), 9) for n in names}
    rows = scored.select(*key, "label", *[v.alias(n) for n, v in x.items()])
    rows = rows.select(*key, F.max("label").over(w).alias("_l"), *names, *[F.max(F.when(F.col("label"), F.col(n))).over(w).alias(f"_p{k}") for k, n in enumerate(names)]).filter("_l")
    counts = [c for k, n in enumerate(names) for c in (F.count_if(F.col(n) > F.col(f"_p{k}")).alias(f"_g{k}"), F.count_if(F.col(n) == F.col(f"_p{k}")).alias(f"_e{k}"))]
    out = rows.groupBy(*key).agg(*counts)
    others = 0.5 if mid else 0.0
    return out.select("qid", *[F.when(F.col(f"_e{k}") > 0, 1.0 / (1.0 + F.col(f"_g{k}") + others * (F.col(f"_e{k}") - 1))).alias(n) for k, n in enumerate(names)])


def by_mode(scored: DataFrame, modes: list[str], flags: DataFrame, eval_set: str) -> DataFrame:
    """eval_set, mode, bucket, mrr, events of several scores at once, ranked in one pass; queries that couldn't be scored count as 0."""
    rr = wide_ranks(scored, modes, mid=False)
    rows = flags.join(rr, "qid", "left").select(F.explode("buckets").alias("bucket"), *[F.coalesce(m, F.lit(0.0)).alias(m) for m in modes])
    wide = rows.groupBy("bucket").agg(*[F.avg(m).alias(m) for m in modes], F.count("*").alias("events"))
    long = wide.select("bucket", "events", F.explode(F.array(*[F.struct(F.lit(m).alias("mode"), F.col(m).alias("mrr")) for m in modes])).alias("m"))
    return long.select(F.lit(eval_set).alias("eval_set"), "m.mode", "bucket", "m.mrr", "events")


def component_mrr(features: DataFrame, names: list[str]) -> DataFrame:
    """feature, mrr: each feature alone, mid-rank, in one pass."""
    one = wide_ranks(features, names).agg(*[F.avg(n).alias(n) for n in names])
    return one.select(F.explode(F.array(*[F.struct(F.lit(n).alias("feature"), F.col(n).alias("mrr")) for n in names])).alias("m")).select("m.*")


def weighted_mrr(sets: DataFrame) -> DataFrame:
    """One row: sets (mrr, weight) in one number."""
    return sets.agg((F.sum(F.col("mrr") * F.col("weight")) / F.sum("weight")).alias("mrr"))


# Weights of validation sets.
SET_WEIGHTS = {
    "dataset1": {"hard": 0.70, "injection": 0.85, "teacher": 0.10},
    "dataset2": {"hard": 0.35, "injection": 1.0, "low_pop": 0.85, "teacher": 0.15},
}
GRID = [-2.0, -1.25, -0.75, -0.35, -0.15, 0.0, 0.03, 0.05, 0.08, 0.12, 0.20, 0.35, 0.55, 0.85, 1.25, 1.75, 2.5]


def validation_sets(sets: dict[str, DataFrame], weights: dict[str, float]) -> DataFrame:
    """Feature tables of several validation sets as one, with eval_set and weight; sets without a weight are left out."""
    named = [df.withColumn("eval_set", F.lit(name)).withColumn("weight", F.lit(float(weights[name]))) for name, df in sets.items() if weights.get(name)]
    return reduce(DataFrame.unionByName, named)


def weight_search(features: DataFrame, names: list[str], start: dict[str, float], rounds: int = 4, grid: list[float] = GRID, gain: float = 1e-8) -> tuple[dict[str, float], float, list[dict]]:
    """Coordinate search of feature weights by mid-rank MRR: of eval_set and weight, where features have them, the weighted mean over
    sets. z-scores are kept once, dealt by query; a step counts ranks for every value of the grid in one pass without multiplying rows
    and returns a number for each set and value. Values are tried in the grid's order, and one is taken if it gains more than `gain` over
    the best so far. Ends early when a round brings nothing."""
    marks = [F.col(c) if c in features.columns else F.lit(x).alias(c) for c, x in (("eval_set", "all"), ("weight", 1.0))]
    key = ("eval_set", "qid")
    z = features.select(*marks, "qid", "label", *names).repartition(*key)
    z = z.select("eval_set", "weight", "qid", "label", *[zscore(F.col(n), key).alias(n) for n in names]).persist()
    best, log = {n: float(start.get(n, 0.0)) for n in names}, []

    def tried(name: str, values: list[float]) -> dict[float, float]:
        now = sum((v * F.col(n) for n, v in best.items() if abs(v) >= 1e-12), F.lit(0.0))
        w = Window.partitionBy(*key)
        rows = z.select(*key, "weight", "label", now.alias("_s"), F.col(name).alias("_z"))
        rows = rows.select(*key, "weight", "_s", "_z", F.max(F.when(F.col("label"), F.col("_s"))).over(w).alias("_ps"), F.max(F.when(F.col("label"), F.col("_z"))).over(w).alias("_pz")).filter("_ps is not null")
        score = lambda x, y, v: F.round(F.col(x) + (v - best[name]) * F.col(y), 9)
        counts = [c for k, v in enumerate(values) for c in (F.count_if(score("_s", "_z", v) > score("_ps", "_pz", v)).alias(f"g{k}"), F.count_if(score("_s", "_z", v) == score("_ps", "_pz", v)).alias(f"e{k}"))]
        each = rows.groupBy(*key, "weight").agg(*counts)
        of = each.groupBy("eval_set", "weight").agg(*[F.avg(1.0 / (1.0 + F.col(f"g{k}") + 0.5 * (F.col(f"e{k}") - 1))).alias(f"m{k}") for k in range(len(values))]).collect()
        total = max(sum(r.weight for r in of), 1e-12)
        return {v: sum(r.weight * r[f"m{k}"] for r in of) / total for k, v in enumerate(values)}

    top = tried(names[0], [best[names[0]]])[best[names[0]]]
    for turn in range(rounds):
        improved = False
        for name in names:
            found, old = tried(name, [float(v) for v in grid]), best[name]
            for value in map(float, grid):
                if found[value] > top + gain:
                    best[name], top = value, found[value]
            if best[name] != old:
                improved = True
                log.append({"round": turn + 1, "feature": name, "from": old, "to": best[name], "mrr": top})
        if not improved:
            break
    z.unpersist()
    return best, top, log


def probability_report(probs: DataFrame, width: int, tolerance: float = 1e-5) -> DataFrame:
    """One row: rows, bad widths, NaN, infinite and negative values, largest error of a row's sum, constant rows, valid."""
    p = F.col("prob")
    rows = probs.groupBy("qid").agg(F.count("*").alias("n"), F.sum("prob").alias("s"), F.stddev_pop("prob").alias("d"), F.max(F.isnan(p)).alias("nan"), F.max(F.abs(p) == float("inf")).alias("inf"), F.max(p < -1e-12).alias("neg"))
    out = rows.agg(F.count("*").alias("rows"), F.count_if(F.col("n") != width).alias("bad_width"), F.max("nan").alias("has_nan"), F.max("inf").alias("has_inf"), F.max("neg").alias("has_negative"), F.max(F.abs(F.col("s") - 1)).alias("max_row_sum_error"), F.count_if(F.col("d") < 1e-12).alias("const_rows"))
    return out.withColumn("valid", (F.col("bad_width") == 0) & ~F.col("has_nan") & ~F.col("has_inf") & ~F.col("has_negative") & (F.col("max_row_sum_error") <= tolerance))


def top_unseen(scored: DataFrame, known: DataFrame, ks: tuple[int, ...] = (1, 5), score: str = "score") -> DataFrame:
    """k, share of the k best candidates that have no history."""
    best = top_k(scored, score, max(ks), tie="pos").join(known.select("dst").distinct().withColumn("known", F.lit(True)), "dst", "left")
    long = best.withColumn("k", F.explode(F.array(*map(F.lit, ks)))).filter(F.col("rank") <= F.col("k"))
    return long.groupBy("k").agg(F.avg(F.col("known").isNull().cast("double")).alias("unseen"))


def top1_change(scored: DataFrame, a: str, b: str) -> DataFrame:
    """One row: share of queries whose best candidate differs between two scores."""
    x = argmax(scored, a).select("qid", F.col("pos").alias("pa"))
    y = argmax(scored, b).select("qid", F.col("pos").alias("pb"))
    return x.join(y, "qid").agg(F.avg((F.col("pa") != F.col("pb")).cast("double")).alias("changed"), F.count("*").alias("queries"))


def top1_stats(scored: DataFrame, history: DataFrame, score: str = "score") -> DataFrame:
    """One row: distinct best candidates, their known share, and mean, median and p95 of their counts."""
    counts = history.groupBy("dst").agg(F.count("*").alias("n"))
    # a row for each destination: how often it is best, and its count
    best = argmax(scored, score).groupBy("dst").agg(F.count("*").alias("times")).join(counts, "dst", "left").select("times", F.coalesce("n", F.lit(0)).alias("n"))
    p50, p95 = exact_percentiles(best, "n", [0.5, 0.95], weight="times")
    total = F.sum("times")
    return best.agg(F.count("*").alias("unique_dst"), (F.sum(F.when(F.col("n") > 0, F.col("times")).otherwise(0)) / total).alias("known_frac"), (F.sum(F.col("n") * F.col("times")) / total).alias("count_mean"), F.lit(p50).alias("count_p50"), F.lit(p95).alias("count_p95"))


def score_summary(probs: DataFrame) -> DataFrame:
    """One row: mean and p95 of the top probability, mean entropy."""
    rows = probs.groupBy(*own_key(probs)).agg(F.max("prob").alias("top"), F.sum(S.entropy_term(F.col("prob"))).alias("entropy")).persist()  # a row for each query, read several times
    p95 = percentile_held(rows, "top", 0.95)
    return rows.agg(F.avg("top").alias("top_mean"), F.lit(p95).alias("top_p95"), F.avg("entropy").alias("entropy_mean"))


def roc_auc(scored: DataFrame, score: str = "score") -> float:
    """Area under the curve of flat scores by average ranks: values are counted, then summed in order."""
    groups = scored.groupBy(F.round(score, 9).alias("x")).agg(F.count("*").alias("n"), F.count_if("label").alias("p"))
    rows = with_prefix(groups, ("x",), F.col("n"), "upto")
    pos, total, ranked = rows.agg(F.sum("p"), F.sum("n"), F.sum(F.col("p") * (F.col("upto") - (F.col("n") - 1) / 2.0))).head()
    if not pos or pos == total:
        return float("nan")
    return (ranked - pos * (pos + 1) / 2) / (pos * (total - pos))


def fusion_metrics(sets: dict[str, DataFrame], model: str, rule: str, weights: list[float], mid: bool = True) -> dict[str, dict[str, float]]:
    """Of each set of scored lists the MRR of the rule, of the model, and of z(rule) + weight * z(model) for every weight: set -> mode -> mrr, a
    fused mode's name being its weight."""
    out = {}
    for name, df in sets.items():
        key = own_key(df)
        rows = df.select(*key, "label", zscore(F.col(rule), key).alias("rule"), zscore(F.col(model), key).alias("model"))
        rows = rows.select(*key, "label", "rule", "model", *[(F.col("rule") + float(w) * F.col("model")).alias(f"w{k}") for k, w in enumerate(weights)])
        modes = ["rule", "model", *[f"w{k}" for k in range(len(weights))]]
        row = wide_ranks(rows, modes, mid).agg(*[F.avg(m).alias(m) for m in modes]).head()
        out[name] = {"rule": row.rule or 0.0, "model": row.model or 0.0} | {str(float(w)): row[f"w{k}"] or 0.0 for k, w in enumerate(weights)}
    return out


def select_feature_fusion(metrics: dict[str, dict[str, float]], weights: list[float], hard: str = "hard", other: str = "random") -> float:
    """The model's weight next to a rule of weight 1, by the gain on hard lists and half that on others. 0 if the model alone is below the
    rule on hard lists; weights that cost others more than 0.002 are out."""
    h, o = metrics[hard], metrics[other]
    if h["model"] + 1e-12 < h["rule"]:
        return 0.0
    gains = {float(w): (h[str(float(w))] - h["rule"]) + 0.5 * (o[str(float(w))] - o["rule"]) for w in weights if o[str(float(w))] - o["rule"] >= -0.002}
    return _first_best(gains)


#: What gains count in the choice of the listwise weight; of cold lists the MRR itself.
LISTWISE_GAINS = {"hard": 0.45, "mixed": 0.40, "random": 0.10}
LISTWISE_COLD = 0.05


def select_listwise_fusion(metrics: dict[str, dict[str, float]], weights: list[float]) -> float:
    """The model's weight by weighted gains on hard, mixed and random lists and the MRR on cold ones; weights that cost random lists more
    than 0.01 are out."""
    gain = lambda name, w: metrics[name][str(float(w))] - metrics[name]["rule"]
    gains = {float(w): sum(x * gain(name, w) for name, x in LISTWISE_GAINS.items()) + LISTWISE_COLD * metrics.get("cold", {}).get(str(float(w)), 0.0) for w in weights if gain("random", w) >= -0.01}
    return _first_best(gains)


def _first_best(gains: dict[float, float]) -> float:
    best, top = 0.0, 0.0
    for w, g in gains.items():
        if g > top:
            best, top = w, g
    return best
