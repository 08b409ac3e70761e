"""Lists and features whose rows are too many to be shuffled: they hold the same rows as plain Python, and plans without shuffles of them."""

from __future__ import annotations

import pytest
from pyspark.sql import functions as F

from edgetide.operators import candidates as C


def above_lists(df) -> str:
    """What the plan does after it has made a row for each place of a list."""
    text = df._jdf.queryExecution().optimizedPlan().toString()
    assert "Generate" in text
    return text.split("Generate", 1)[0]


def queries(spark, rows):
    return spark.createDataFrame(rows, "qid long, src long, time long, dst long")


def drawn(qid: int, vocabulary: list, n: int, seed: int = 0) -> list:
    size = len(vocabulary)
    return [vocabulary[(qid * 7919 + k * 104729 + seed) % size] for k in range(1, max(min(n, size), 1) + 1)] if size else []


def listed(df) -> dict:
    out: dict = {}
    for r in df.orderBy("qid", "pos").collect():
        assert r.pos == len(out.setdefault(r.qid, [])) and r.label == (r.pos == 0)
        out[r.qid].append(r.dst)
    return out


@pytest.mark.parametrize("size", [1, 2, 7, 2 * 104729])
def test_random_lists_by_number(spark, size):
    """large_pool: a positive that is drawn, one that isn't, one outside the vocabulary; draws that repeat."""
    asked = [(q, 1, 5, dst) for q, dst in ((1, 0), (2, 3), (3, 2 * ((3 * 7919 + 104729) % size)), (4, -5), (5, None))]
    lists = C.large_pool(queries(spark, asked), 6, lambda q, n: C.random_lists(q, spark.range(size).select((F.col("id") * 2).alias("dst")), n))
    assert "Window" not in above_lists(lists) and "Aggregate" not in above_lists(lists)
    want = {q: list(dict.fromkeys([dst, *drawn(q, list(range(0, 2 * size, 2)), 5)])) for q, _, _, dst in asked}
    assert listed(lists) == want


def test_random_lists_of_no_vocabulary(spark):
    assert listed(C.random_lists(queries(spark, [(1, 1, 5, 9)]), spark.range(0).select(F.col("id").alias("dst")), 5)) == {1: [9]}


def test_block_pools_follow_the_counts(spark):
    """rolling_block_candidates: ties, destinations that fall behind, several ranges of blocks; one row a destination and block is summed."""
    from edgetide.operators import asof

    rows = [(i + 1, i * i % 5, (i * i * 31 + i // 40) % 23) for i in range(2500)]
    edges = spark.createDataFrame(rows, "seq long, src long, dst long")
    out = asof.block_pools(edges, 6, 3, 4)
    assert "at#" not in "".join(x for x in out._jdf.queryExecution().optimizedPlan().toString().splitlines() if "Join" in x), "counts are joined to later blocks"
    got = sorted((r.seq, r.source, r.place, r.dst) for r in out.collect())
    want = []
    for seq, src, _ in rows:
        early = [x for x in rows if (x[0] - 1) // 6 < (seq - 1) // 6]
        want += [(seq, 1, k, x[2]) for k, x in enumerate([x for x in reversed(early) if x[1] == src][:4], 1)]
        n: dict = {}
        for x in early:
            n[x[2]] = n.get(x[2], 0) + 1
        want += [(seq, 2, k, dst) for k, dst in enumerate(sorted(n, key=lambda d: (-n[d], d))[:3], 1)]
    assert got == sorted(want)


def history(spark):
    rows = [(q % 7, (q * q * 13 + q // 9) % 41, q) for q in range(400)] + [(50, 3, 5), (51, 90, 6)]
    return spark.createDataFrame(rows, "src long, dst long, time long")


ASKED = [(1000 + 3 * q, src, 500, dst) for q, (src, dst) in enumerate([(0, 1), (1, 99), (2, 13), (50, 3), (77, 5), (6, -4), (3, 0), (51, 90)])]


@pytest.mark.parametrize("low", [False, True])
def test_filled_lists_in_their_rows(spark, monkeypatch, low):
    """candidates_filled: the same lists as through shuffled rows, which larger vocabularies still take."""
    asked, h = queries(spark, ASKED), history(spark)
    lists = C.filled_lists(asked, h, 12, low)
    assert not {"Window", "Aggregate", "Join"} & {*above_lists(lists).split()}
    packed = listed(lists)
    monkeypatch.setattr(C, "PACKED", 5)
    assert packed == listed(C.filled_lists(asked, h, 12, low)) and len(packed) == len(ASKED)


def test_bucketed_lists_in_their_rows(spark, monkeypatch):
    """candidates_bucketed: the same for sources with and without a history, and a positive that the history doesn't have."""
    from edgetide.operators.sequences import transitions

    asked, h = queries(spark, ASKED), history(spark)
    lists = C.bucketed_lists(asked, h, transitions(h), 12, 3, 4)
    assert not {"Window", "Aggregate", "Join"} & {*above_lists(lists).split()}
    packed = listed(lists)
    monkeypatch.setattr(C, "PACKED", 5)
    assert packed == listed(C.bucketed_lists(asked, h, transitions(h), 12, 3, 4)) and len(packed) == len(ASKED)


def test_features_meet_lists_where_they_are(spark, monkeypatch):
    """score_summary: rows of candidates are made from queries dealt by source, and not dealt again; the same numbers as by joins."""
    from edgetide.operators import features
    from edgetide.operators.sequences import dealt
    from edgetide.operators.stats import History
    from edgetide.operators.windows import softmax

    h = History(history(spark))
    lists = C.random_lists(dealt(queries(spark, ASKED)), h.edges.select("dst"), 8)

    def probs():
        return softmax(features.rule18(lists, h), "rule_score", key=features.OWN)

    assert "Exchange" not in probs()._jdf.queryExecution().executedPlan().toString().split("Generate", 1)[0]
    rows = sorted(map(tuple, probs().collect()))
    monkeypatch.setattr(features, "LISTED", 0)
    assert rows == sorted(map(tuple, probs().collect())) and any(r.pair_seen for r in probs().collect())


def test_sets_in_their_rows(spark, monkeypatch):
    """eval_sets, fusion_choice: all, hard and mixed lists as through shuffled rows; ranks keep rows where queries were dealt."""
    from edgetide.operators import evaluate
    from edgetide.operators.sequences import dealt

    asked, h = dealt(queries(spark, ASKED)), history(spark)
    tests = asked.select("dst").filter("dst > 0")
    makers = [lambda: C.all_lists(asked, h.select("dst")), lambda: C.hard_lists(asked, h, 12, 5, 4), *[lambda m=m: C.mixed_lists(asked, h, tests, 16, m) for m in C.MIXES]]
    made = [f() for f in makers]
    for lists in made:
        ranked = evaluate.wide_ranks(lists.withColumn("x", F.col("dst") % 5), ["x"])
        assert "Exchange" not in ranked._jdf.queryExecution().executedPlan().toString().split("Generate", 1)[0]
    packed = [listed(x) for x in made]
    monkeypatch.setattr(C, "PACKED", 5)
    assert packed == [listed(f()) for f in makers]


def exchanges(df) -> int:
    return df._jdf.queryExecution().executedPlan().toString().count("Exchange")


def held(spark, rows):
    from edgetide.operators.sequences import dealt

    return dealt(spark.createDataFrame(rows, "src long, dst long, time long")).persist()


@pytest.mark.parametrize("rows", [[(q % 7, q * q % 11, q // 3) for q in range(600)], [(1, 2, 3)] * 10, [(5, None, 3)] * 3 + [(4, 1, 9)] * 30, [(1, 2, 3)], []])
def test_split_of_dealt_rows(spark, rows):
    """score_summary: the same parts and numbers as when all rows are ordered, also where the cut falls among equal rows; the first part isn't shuffled."""
    from edgetide.operators import order

    edges = held(spark, rows)
    parts, want = order.split_dealt(edges), order.split_ratio(edges)
    assert exchanges(parts[0].groupBy("src", "dst").count()) == exchanges(parts[0])
    for got, out in zip(parts, want, strict=True):
        assert sorted(map(str, got.select("src", "dst", "time").collect())) == sorted(map(str, out.select("src", "dst", "time").collect()))
    assert sorted(map(str, parts[1].select("seq", "src", "dst", "time").collect())) == sorted(map(str, want[1].select("seq", "src", "dst", "time").collect()))


def test_statistics_of_dealt_history(spark):
    """score_summary: statistics and scales of held edges are those of any edges; a query's summary is made where its rows are."""
    from edgetide.operators import evaluate
    from edgetide.operators.stats import History

    rows = [(q % 7, (q * q * 13 + q // 9) % 41, q) for q in range(400)] + [(50, 3, 5), (51, 90, 6), (51, 90, 399), (51, 90, 399)]
    edges = held(spark, rows)
    a, b = History(edges, True), History(spark.createDataFrame(rows, "src long, dst long, time long"))
    assert a.scales == b.scales and sorted(map(tuple, a.dst_stats().collect())) == sorted(map(tuple, b.dst_stats().collect()))
    probs = edges.select("src", F.col("dst").alias("qid"), F.lit(0.5).alias("prob"))
    assert exchanges(probs.groupBy("src", "qid").count()) == exchanges(probs)
    summary = evaluate.score_summary(probs).head()
    assert summary.top_mean == 0.5 and summary.top_p95 == 0.5


def test_hops_by_blocks(spark, monkeypatch):
    """features_graph21_core: features of dealt edges by blocks are those by joins, also with one block, several blocks for a source and few lookups
    at once; a pair of events isn't shuffled."""
    from edgetide.operators import blocks, features
    from edgetide.operators.sequences import dealt
    from edgetide.operators.stats import History

    rows = [(q % 7, (q * q * 13 + q // 9) % 41, q // 2) for q in range(500)] + [(50, 3, 5), (51, 90, 6), (51, None, 7), (51, 3, 8)]
    edges = held(spark, rows)
    lists = C.random_lists(dealt(queries(spark, ASKED)), edges.select("dst").filter("dst is not null"), 12)
    key = lambda df: sorted(tuple(round(x, 9) if isinstance(x, float) else -1 if x is None else x for x in r) for r in df.collect())
    want = key(features.graph21(lists, History(edges), width=4, topk=6))
    monkeypatch.setattr(blocks, "AT_ONCE", 7)
    got = features.graph21(lists, History(edges, True), width=4, topk=6)
    assert key(got) == want and any(r.transition > 0 for r in got.collect())
    own = blocks.source_sequences(edges)
    pairs = blocks.block_transitions(own, History(edges, True).dst_stats().select("dst", "n"), [10, 20, 30], 4, 6)
    plan = pairs._jdf.queryExecution().executedPlan().toString()
    # what stands above the pairs, up to the exchange of sequences: only small tables are sent
    above = plan[: plan.rindex("Generate")]
    assert "Exchange hashpartitioning" not in "".join(x for x in above.splitlines() if "BroadcastExchange" not in x).split("InMemoryRelation")[0]


def test_context_features_of_dealt_edges(spark):
    """features_context14: the same from dealt edges as by joins; a decomposition with tasks that have no rows, and of fewer dimensions than asked."""
    from edgetide.operators import features, linalg
    from edgetide.operators.sequences import dealt
    from edgetide.operators.stats import History

    edges = held(spark, [(q % 3, q % 5, q) for q in range(40)])
    src, dst = linalg.truncated_svd(linalg.weighted_pairs(edges), 2)
    assert (src.count(), dst.count()) == (3, 5) and all(abs(sum(x * x for x in r.vec) - 1) < 1e-9 for r in src.collect())
    lists = C.random_lists(dealt(queries(spark, [(100, 0, 50, 1), (101, 2, 60, 4), (102, 9, 60, 0)])), edges.select("dst"), 5)
    rows = []
    for dealt_ in (True, False):
        h = History(edges, dealt_)
        base = features.graph21(lists, h, vectors=(src, dst), wanted=["pop", "recent_pop", "profile"])
        rows.append(sorted(tuple(round(x, 7) if isinstance(x, float) else x for x in r) for r in features.context14(base, h, src, dst).collect()))
    assert rows[0] == rows[1] and len(rows[0]) == lists.count()


@pytest.mark.parametrize("share", [0.0, 0.5, 0.95, 1.0])
@pytest.mark.parametrize("n", [0, 1, 2, 700, 9000])
def test_percentile_of_held_rows(spark, n, share):
    """score_summary: the percentile of held rows is exact, also where the sampled place misses it."""
    from edgetide.operators import order

    rows = spark.createDataFrame([(None if q % 50 == 7 else (q * q * 7919 % 10007) / 7.0,) for q in range(n)], "x double").persist()
    want = order.exact_percentiles(rows, "x", [share])[0]
    for few, margin in ((50_000, 0.03), (20, 0.03), (50_000, 0.0), (50_000, -0.2)):
        got = order.percentile_held(rows, "x", share, few, margin)
        assert got == want or n == 0 and got != got


def test_percentile_of_held_rows_shuffles_few(spark, monkeypatch):
    """score_summary: only values around the percentile are counted by shuffle; rows below it stay where they lie."""
    from edgetide.operators import evaluate, order

    seen, ranks = [], order._at_ranks
    monkeypatch.setattr(order, "_at_ranks", lambda counts, held, few, wanted: seen.append(len(held)) or ranks(counts, held, few, wanted))
    evaluate.score_summary(spark.createDataFrame([(q % 7, q, q / 9000) for q in range(9000)], "src long, qid long, prob double"))
    assert seen and max(seen) < 1800


def test_times_travel_as_one_number(spark):
    """score_summary: an edge goes to its destination as two numbers, its time and whether it is the pair's newest come back; also no time."""
    from edgetide.operators import stats

    rows = [(1, 5, True), (1, -9, False), (2, None, True), (2, None, False), (None, 1 << 40, True), (3, -(1 << 40), False)]
    edges = spark.createDataFrame(rows, "dst long, time long, newest boolean")
    for low, high in ((-(1 << 40), 1 << 40), (-(1 << 62), 1 << 62)):
        got = stats.packed_times(edges, low, high)
        assert sorted(map(str, map(tuple, got.select("dst", "time", "newest").collect()))) == sorted(map(str, rows))
    assert "_x" in stats.packed_times(edges, 0, 9)._jdf.queryExecution().executedPlan().toString()


@pytest.mark.parametrize("vocabulary", [[*range(40)], [*range(5, 25), *range(1000, 1030), 7777], [-(1 << 63), -3, -2, (1 << 63) - 1], [8], [k * k for k in range(90)], [None, 4, 5, 6]])
def test_vocabulary_in_runs(spark, monkeypatch, vocabulary):
    """score_summary: vocabularies of few runs need no table sent to every task; the same lists."""
    asked = spark.createDataFrame([(q, q % 3, q, d) for q, d in enumerate([0, 5, 24, 25, 999, 1029, 7777, -3, 8, 4, None] * 4, 1)], "qid long, src long, time long, dst long")
    words = spark.createDataFrame([(d,) for d in vocabulary], "dst long")
    lists = C.random_lists(asked, words, 10)
    if None not in vocabulary and len(vocabulary) < 60 and vocabulary[0] >= 0:
        assert "Join" not in lists._jdf.queryExecution().executedPlan().toString().split("Generate", 1)[0]
    got = sorted(map(str, lists.collect()))
    monkeypatch.setattr(C, "RUNS", 0)
    assert got == sorted(map(str, C.random_lists(asked, words, 10).collect()))
