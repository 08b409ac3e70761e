"""Command line: profile, evaluate, predict, sweep and check ranking data sets (folders of train.csv and test.csv)."""

from __future__ import annotations

import argparse
import json
import sys

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .functions import scalars as S
from .operators import candidates as C
from .operators import evaluate, features, order, scoring, sequences, windows
from .operators.stats import History
from .sources import edges as E
from .sources import sinks

MODES = ["rule_score", "pop", "recency"]


def _queries(valid: DataFrame) -> DataFrame:
    rows = order.with_seq(valid.select("src", "dst", "time"))
    return rows.select(F.col("seq").alias("qid"), "src", "time", "dst")


def profile(spark: SparkSession, folder: str, width: int) -> dict:
    """Counts, repeats, coverage of the test lists, percentiles of validation popularity."""
    train, valid = order.split_official(E.read_edges(spark, f"{folder}/train.csv"))
    known = train.select("dst").distinct().withColumn("k", F.lit(1))
    pairs = train.select("src", "dst").distinct().withColumn("p", F.lit(1))
    rows = valid.join(known, "dst", "left").join(pairs, ["src", "dst"], "left")
    seen, again, n = rows.agg(F.avg(F.col("k").isNotNull().cast("double")), F.avg(F.col("p").isNotNull().cast("double")), F.count("*")).head()
    tests = E.exploded(E.read_queries(spark, f"{folder}/test.csv", width))
    cells, covered = tests.join(known, "dst", "left").agg(F.count("*"), F.count("k")).head()
    return {
        "train_rows": train.count(), "valid_rows": n, "dst_seen_ratio": seen, "repeated_ratio": again, "test_cells": cells, "test_known_cells": covered,
        "time_percentiles": order.exact_percentiles(train, "time", [0.0, 0.5, 0.9, 0.99, 1.0]), **History(train).repeats().head().asDict(),
    }


def evaluated(spark: SparkSession, folder: str, n: int, most: int) -> DataFrame:
    """eval_set, mode, bucket, mrr, events over random and hard lists of the validation edges."""
    train, valid = order.split_official(E.read_edges(spark, f"{folder}/train.csv"))
    q = _queries(valid)
    total = q.count()
    q = order.sample_evenly(q, total, min(most, total), "qid") if most else q
    history, flags = History(train), evaluate.bucket_flags(q, train)
    out = None
    for name, lists in (("random", C.random_lists(q, train.select("dst"), n)), ("hard", C.hard_lists(q, train, n))):
        rows = evaluate.by_mode(features.rule18(lists, history), MODES, flags, name)
        out = rows if out is None else out.unionByName(rows)
    return out


def scored_tests(spark: SparkSession, folder: str, width: int, regime: str) -> DataFrame:
    history = History(E.read_edges(spark, f"{folder}/train.csv").select("src", "dst", "time"))
    rows = E.exploded(E.read_queries(spark, f"{folder}/test.csv", width))
    if regime == "dataset1":
        return scoring.repeat_final(scoring.base_intensity(features.builder45(rows, history), "dataset1"))
    return scoring.with_unknown_policy(features.rule18(rows, history), "rule_score", "demote", out="final")


def predict(spark: SparkSession, folder: str, out: str, width: int, regime: str) -> dict:
    rows = scored_tests(spark, folder, width, regime)
    probs = rows if "prob" in rows.columns else windows.softmax(rows, "final")
    sinks.write_probabilities(probs, out)
    return sinks.validate(spark, out, E.read_queries(spark, f"{folder}/test.csv", width).count(), width)


def sweep(spark: SparkSession, folder: str, out: str, width: int, blends: list[float]) -> dict:
    """One probability file for each blend of rule and recent popularity."""
    history = History(E.read_edges(spark, f"{folder}/train.csv").select("src", "dst", "time"))
    rows = features.rule18(E.exploded(E.read_queries(spark, f"{folder}/test.csv", width)), history)
    every = scoring.blend_sweep(rows, "rule_score", "recent_pop", blends).persist()
    names = {}
    for b in blends:
        names[S.blend_name(b)] = f"{out}/{S.blend_name(b)}"
        sinks.write_probabilities(every.filter(F.col("blend") == b).select("qid", "pos", "prob"), names[S.blend_name(b)])
    every.unpersist()
    return names


def parser() -> argparse.ArgumentParser:
    top = argparse.ArgumentParser(prog="edgetide", description=__doc__)
    top.add_argument("action", choices=["profile", "evaluate", "predict", "sweep", "zeros", "validate", "graph"])
    top.add_argument("folder", help="folder with train.csv and test.csv (validate: the written probabilities)")
    top.add_argument("--out", default="out")
    top.add_argument("--width", type=lambda x: S.positive_int(int(x), "width"), default=100)
    top.add_argument("--candidates", type=lambda x: S.positive_int(int(x), "candidates"), default=100)
    top.add_argument("--max-events", type=int, default=0, help="even sample of the validation edges; 0: all")
    top.add_argument("--regime", choices=["dataset1", "dataset2"], default="dataset2")
    top.add_argument("--blends", type=S.blends, default=S.blends("0.02,0.05,0.10,0.20,0.35,1.00"))
    top.add_argument("--rows", type=int, default=0)
    return top


def main(argv: list[str] | None = None) -> int:
    a = parser().parse_args(argv)
    spark = SparkSession.builder.appName("edgetide").config("spark.sql.session.timeZone", "UTC").getOrCreate()
    if a.action == "profile":
        report = profile(spark, a.folder, a.width)
        sinks.write_json(report, f"{a.out}/profile.json")
    elif a.action == "evaluate":
        rows = evaluated(spark, a.folder, a.candidates, a.max_events)
        sinks.write_metrics(rows, f"{a.out}/metrics")
        report = {"metrics": f"{a.out}/metrics"}
    elif a.action == "predict":
        report = predict(spark, a.folder, f"{a.out}/probabilities", a.width, a.regime)
    elif a.action == "sweep":
        report = sweep(spark, a.folder, a.out, a.width, a.blends)
    elif a.action == "zeros":
        sinks.write_zeros(E.read_queries(spark, f"{a.folder}/test.csv", a.width), f"{a.out}/zeros", a.width)
        report = {"zeros": f"{a.out}/zeros"}
    elif a.action == "validate":
        report = sinks.validate(spark, a.folder, a.rows, a.width)
    else:
        edges = E.read_edges(spark, f"{a.folder}/train.csv")
        counts = edges.groupBy("dst").agg(F.count("*").alias("n"))
        sequences.normalised(sequences.window_pairs(edges, 16, "root"), counts, 256).write.mode("overwrite").parquet(f"{a.out}/transitions")
        report = {"transitions": f"{a.out}/transitions"}
    print(json.dumps(report, default=str))
    return 0


if __name__ == "__main__":
    sys.exit(main())
