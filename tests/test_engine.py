import math
import os

import numpy as np
import pytest
from pyspark.sql import Window
from pyspark.sql import functions as F

from edgetide.functions import scalars as S
from edgetide.operators import asof, evaluate, features, linalg, models, order, scoring, sequences, stats, windows
from edgetide.operators import candidates as C
from edgetide.sources import edges as E
from edgetide.sources import sinks

EDGES = [(1, 10, 0), (2, 10, 10), (1, 11, 20), (3, 12, 30), (1, 10, 40), (2, 12, 50), (2, 11, 60), (3, 10, 70), (1, 13, 80), (2, 13, 100)]


@pytest.fixture(scope="module")
def edges(spark):
    return spark.createDataFrame(EDGES, "src long, dst long, time long").cache()


@pytest.fixture(scope="module")
def history(edges):
    return stats.History(edges)


def lists(spark, rows):
    return spark.createDataFrame([(q, s, t, k, d, k == 0) for q, s, t, c in rows for k, d in enumerate(c)], "qid long, src long, time long, pos int, dst long, label boolean")


@pytest.fixture(scope="module")
def cands(spark):
    return lists(spark, [(0, 1, 110, [10, 11, 12, 99])])


def test_scales_and_percentiles(history):
    s = history.scales
    assert (s.p60, s.p80, s.p82) == pytest.approx((54, 72, 73.8))
    assert stats.log_scale(s.max_dst) == pytest.approx(1.609438, abs=1e-6)
    assert stats.log_scale(s.max_pair) == pytest.approx(1.098612, abs=1e-6)


def test_exact_percentiles_against_numpy(spark):
    rng = np.random.default_rng(3)
    values = rng.integers(0, 50, 997).tolist()
    df = spark.createDataFrame([(int(v),) for v in values] + [(None,)], "x long")
    shares = [0, 0.07, 0.35, 0.5, 0.82, 1]
    for few in (50_000, 7):
        assert order.exact_percentiles(df, "x", shares, few) == pytest.approx(np.percentile(values, [100 * s for s in shares]).tolist())
    assert math.isnan(order.exact_percentiles(df.filter("x < 0"), "x", [0.5])[0])


def test_row_numbers_and_even_sample(spark):
    df = spark.range(101).select((F.col("id") * 37 % 101).alias("time"), F.lit(1).alias("src"), F.lit(2).alias("dst"))
    rows = order.with_seq(df).collect()
    assert sorted(r.seq for r in rows) == list(range(1, 102)) and all(r.seq == r.time + 1 for r in rows)
    ten = spark.range(1, 11).withColumnRenamed("id", "seq")
    assert [r.seq - 1 for r in order.sample_evenly(ten, 10, 4).orderBy("seq").collect()] == [0, 3, 6, 9]
    for n, m in ((7, 1), (7, 3), (100, 33), (5, 9)):
        got = sorted(r.seq - 1 for r in order.sample_evenly(spark.range(1, n + 1).withColumnRenamed("id", "seq"), n, m).collect())
        want = sorted({j * (n - 1) // (m - 1) for j in range(m)}) if 1 < m < n else [0] if m == 1 else list(range(n))
        assert got == want


def test_splits(spark, edges):
    train, valid = order.split_ratio(edges, 0.8)
    assert (train.count(), valid.count()) == (8, 2)
    one = order.split_ratio(edges.limit(2), 0.99)
    assert (one[0].count(), one[1].count()) == (1, 1)
    marked = edges.withColumn("split", F.when(F.col("time") < 50, "0").otherwise("1"))
    assert [x.count() for x in order.split_official(marked)] == [5, 5]
    assert [x.count() for x in order.split_official(edges.withColumn("split", F.lit("")))] == [8, 2]


def test_histories_and_transitions(edges):
    hist = {r.src: r.hist for r in sequences.last_k_lists(edges, 200).collect()}
    assert hist == {1: [10, 11, 10, 13], 2: [10, 12, 11, 13], 3: [12, 10]}
    steps = {(r.prev, r.next): r.n for r in sequences.transitions(edges).collect()}
    assert steps == {k: 1 for k in ((10, 11), (10, 12), (10, 13), (11, 10), (11, 13), (12, 10), (12, 11))}
    w = {(r.prev, r.next): round(r.w, 6) for r in sequences.window_pairs(edges, 16, "root").collect()}
    assert w == {(10, 11): 1.707107, (10, 12): 1.0, (10, 13): 2.154701, (11, 10): 1.0, (11, 13): 1.707107, (12, 10): 1.0, (12, 11): 1.0, (12, 13): 0.707107}


def test_rule18_of_the_worked_example(cands, history):
    rows = windows.softmax(features.rule18(cands, history).withColumn("z", windows.zscore_or_zero(F.col("rule_score"))), "rule_score").orderBy("pos").collect()
    want = {"pop": [1, 0.682606, 0.682606, 0], "trend": [-0.138629, -0.138629, 0, 0], "recency": [0.714286, 0.666667, 0.625, 0], "src_recent_score": [0.5, 1 / 3, 0, 0], "pair_seen": [1, 1, 0, 0], "dst_unknown": [0, 0, 0, 1], "rule_score": [1.19804, 0.797954, 1.157117, -8], "z": [0.614374, 0.512371, 0.603941, -1.730686], "prob": [0.380190, 0.254827, 0.364945, 0.000038]}
    for name, values in want.items():
        assert [r[name] for r in rows] == pytest.approx(values, abs=2e-6), name


def test_ties(spark):
    df = spark.createDataFrame([(1, k, s, k == 1) for k, s in enumerate([3.0, 5.0, 5.0, 1.0])], "qid long, pos int, score double, label boolean")
    r = evaluate.ranks(df).head()
    assert (r.rr_optimistic, r.rr_mid) == pytest.approx((1.0, 2 / 3))
    ranks = [r[0] for r in df.select(windows.recip_rank(F.col("score")).alias("r"), "pos").orderBy("pos").collect()]
    assert sorted(ranks) == pytest.approx([0.25, 1 / 3, 0.5, 1.0]) and ranks[1] == 1.0


def test_constant_scores(spark):
    df = spark.createDataFrame([(1, 0, 2.0), (1, 1, 2.0), (2, 0, 7.0)], "qid long, pos int, score double")
    rows = windows.softmax(df, "score").select("*", windows.zscore(F.col("score")).alias("z"), windows.minmax(F.col("score")).alias("m")).collect()
    assert all(r.z == 0 and r.m == 0 for r in rows) and sorted(r.prob for r in rows) == [0.5, 0.5, 1.0]


def test_lists_clamp_to_the_vocabulary(spark, edges):
    q = spark.createDataFrame([(1, 1, 110, 13), (2, 9, 110, 99)], "qid long, src long, time long, dst long")
    for rows in (C.random_lists(q, edges.select("dst"), 100), C.hard_lists(q, edges, 100), C.filled_lists(q, edges, 100), C.mixed_lists(q, edges, edges.select("dst"), 100, "cold"), C.pairwise_negatives(q, edges, edges.select("dst"), 40), C.bucketed_lists(q, edges, sequences.transitions(edges), 40, 1, 2)):
        got = rows.collect()
        for qid, positive in ((1, 13), (2, 99)):
            own = [r for r in got if r.qid == qid]
            assert len({r.dst for r in own}) == len(own) <= 5
            assert [r.dst for r in own if r.label] == [positive] and sorted(r.pos for r in own) == list(range(len(own)))
    assert C.all_lists(q, edges.select("dst")).groupBy("qid").count().collect() is not None


def test_injection_keeps_one_positive(spark, edges):
    q = spark.createDataFrame([(1, 1, 110, 13), (2, 9, 110, 99), (3, 1, 120, 10)], "qid long, src long, time long, dst long")
    t = spark.createDataFrame([(70, 1, [10, 11, 77]), (71, 5, [12, 13, 78])], "qid long, src long, candidates array<long>")
    got = C.injected(q, t, edges).collect()
    assert len(got) == 9 and {r.qid: r.dst for r in got if r.label} == {1: 13, 2: 99, 3: 10}
    assert {r.qid: r.same_src for r in got} == {1: True, 2: False, 3: True}


def test_as_of_state_never_sees_itself(edges):
    rows = asof.prequential(order.with_seq(edges)).orderBy("seq").collect()
    for k, r in enumerate(rows):
        before = EDGES[:k]
        assert r.dst_n == sum(d == r.dst for _, d, _ in before)
        assert r.pair_n == sum((s, d) == (r.src, r.dst) for s, d, _ in before)
        assert r.src_last == max((t for s, _, t in before if s == r.src), default=None)


def test_neighbours_before(spark, edges):
    probes = spark.createDataFrame([(1, 1, 80), (2, 1, 81), (3, 1, 0), (4, 7, 50)], "pid long, src long, time long")
    got = {r.pid: list(r.hist) for r in asof.neighbours_before(edges, probes, 2).collect()}
    assert got == {1: [11, 10], 2: [10, 13], 3: [], 4: []}


def test_unknown_policies(spark):
    df = spark.createDataFrame([(1, 0, 5, 2.0, 0.0), (1, 1, 9, 3.0, 1.0), (2, 0, 5, 1.0, 1.0)], "qid long, pos int, dst long, s double, dst_unknown double")
    got = lambda p: [r.adjusted for r in scoring.with_unknown_policy(df, "s", p).orderBy("qid", "pos").collect()]
    assert got("neutral") == [2, 3, 1]
    assert got("mild_penalty") == [2, -2, -4]
    assert got("constant") == [2, -8, -8]
    assert got("demote") == [2, -8, 0]
    with pytest.raises(ValueError):
        scoring.with_unknown_policy(df, "s", "nonsense")
    with pytest.raises(ValueError):
        scoring.blended(df, "s", "s", 1.5)


def test_decomposition_against_numpy(spark):
    rng = np.random.default_rng(1)
    dense = np.where(rng.random((30, 20)) < 0.4, rng.random((30, 20)) + 0.5, 0.0)
    rows = [(int(i) + 100, int(j) + 500, float(dense[i, j])) for i, j in zip(*np.nonzero(dense))]
    src, dst = linalg.truncated_svd(spark.createDataFrame(rows, "src long, dst long, w double"), 6)
    u, s, vt = np.linalg.svd(dense, full_matrices=False)
    norm = lambda x: x / np.linalg.norm(x, axis=1, keepdims=True)
    want = norm(u[:, :6] * s[:6]) @ norm(vt[:6].T).T
    a = np.array([r.vec for r in src.orderBy("src").collect()])
    b = np.array([r.vec for r in dst.orderBy("dst").collect()])
    assert np.abs(a @ b.T - want).max() < 1e-3


def test_weight_search_climbs(spark, edges, history):
    q = lists(spark, [(k, 1, 110, [10 + k % 4, 12, 11, 10, 13][: 3 + k % 2]) for k in range(12)])
    rows = features.rule18(q.dropDuplicates(["qid", "dst"]), history)
    best, top, log = evaluate.weight_search(rows, ["pop", "recency"], {"pop": 1.0}, rounds=1, grid=[-1.0, 0.0, 1.0])
    assert top >= evaluate.ranks(rows, "pop").agg(F.avg("rr_mid")).head()[0] - 1e-9 and {*best} == {"pop", "recency"} and isinstance(log, list)


def test_listwise_mlp_learns(spark):
    rng = np.random.default_rng(0)
    rows = [(q, k, k == 3, float(x + 2 * (k == 3)), float(rng.normal())) for q in range(200) for k, x in enumerate(rng.normal(size=6))]
    df = spark.createDataFrame(rows, "qid long, pos int, label boolean, a double, b double")
    scored = models.ListwiseMLP(["a", "b"], hidden=8, epochs=15).fit(df).score(df)
    assert evaluate.metrics(scored, "model").head().mrr > 0.75
    assert evaluate.roc_auc(scored, "model") > 0.85


def test_csv_readers_and_sinks(spark, tmp_path):
    (tmp_path / "d1").mkdir()
    (tmp_path / "d1/train.csv").write_text("src,dst,time,split\n1,10,5,0\n2,11,7,1\n")
    (tmp_path / "d1/test.csv").write_text("src,time,c1,c2,c3\n1,9,10,11,12\n2,9,10,11,13\n")
    (tmp_path / "bad.csv").write_text("src,time\n1,2\n")
    dirs = E.dataset_dirs(spark, str(tmp_path))
    assert list(dirs) == ["d1"]
    assert E.read_edges(spark, f"{tmp_path}/d1/train.csv").filter("split = '0'").count() == 1
    q = E.read_queries(spark, f"{tmp_path}/d1/test.csv", 3)
    assert [r.candidates for r in q.orderBy("qid").collect()] == [[10, 11, 12], [10, 11, 13]]
    assert E.candidate_vocabulary(q).count() == 4
    for call in (lambda: E.read_edges(spark, f"{tmp_path}/bad.csv"), lambda: E.read_queries(spark, f"{tmp_path}/bad.csv", 3)):
        with pytest.raises(ValueError):
            call()
    with pytest.raises(FileNotFoundError):
        E.dataset_dirs(spark, f"{tmp_path}/none")
    long = E.exploded(q).withColumn("prob", F.when(F.col("qid") == 0, 0.4).otherwise(0.0))
    out = f"{tmp_path}/probs"
    sinks.write_probabilities(long, out)
    report = sinks.validate(spark, out, 2, 3)
    assert report["valid"] and report["rows"] == 2
    assert not sinks.validate(spark, out, 3, 3)["valid"]
    sinks.write_zeros(q, f"{tmp_path}/zeros", 3)
    assert sinks.validate(spark, f"{tmp_path}/zeros", 2, 3)["bad"] == 2
    sinks.zip_members({"d1.csv": out}, f"{tmp_path}/r.zip")
    assert [sum(r.row) for r in sinks.read_zip(spark, f"{tmp_path}/r.zip", "d1.csv").collect()] == pytest.approx([1, 1])
    sinks.write_json({"a": 1}, f"{tmp_path}/x/report.json")
    assert os.path.exists(f"{tmp_path}/x/report.json")


def test_scalars(spark):
    row = spark.range(1).select(
        S.finite(F.lit("nan")).alias("a"), S.finite(F.lit("x"), 3.0).alias("b"), S.finite(F.lit("2.5")).alias("c"), S.padded(F.array(F.lit(1).cast("long"), F.lit(2).cast("long")), 4).alias("d"),
        S.popularity_bucket(F.lit(0)).alias("e"), S.popularity_bucket(F.lit(7)).alias("f"), S.popularity_bucket(F.lit(10**13)).alias("g"), S.log_gap(F.lit(1), F.lit(5)).alias("h"), S.sigmoid(S.logit(F.lit(0.3))).alias("i")).head()
    assert tuple(row)[:8] == (0.0, 3.0, 2.5, [0, 0, 1, 2], "0", "6-10", ">500", 0.0) and row.i == pytest.approx(0.3)
    assert S.blends("0.1,1") == [0.1, 1.0] and S.blend_name(0.1) == "0p10"
    for call in (lambda: S.blends("2"), lambda: S.positive_int(0, "n"), lambda: S.non_negative(-1, "x"), lambda: S.one_of("a", ["b"], "x")):
        with pytest.raises(ValueError):
            call()


def test_numbers_of_many_rows_with_wide_columns(spark):
    n = 1_500_000
    wide = F.when(F.col("id") % 7 == 0, F.repeat(F.lit("x"), 40)).otherwise(F.lit(""))
    rows = spark.range(n).select((F.col("id") * 7919 % 1009).alias("src"), (F.col("id") * 104729 % 5003).alias("dst"), F.when(F.col("id") % 3 == 0, 5).otherwise(F.col("id") % 100_003).cast("long").alias("time"), wide.alias("split"))
    got = order.with_seq(rows)
    assert tuple(got.agg(F.count("*"), F.countDistinct("seq"), F.min("seq"), F.max("seq")).head()) == (n, n, 1, n)
    step = got.select("time", "src", "dst", F.lag(F.struct("time", "src", "dst")).over(Window.partitionBy(F.floor(F.col("seq") / 50_000)).orderBy("seq")).alias("before"))
    assert step.filter(F.col("before") > F.struct("time", "src", "dst")).count() == 0
    train, valid = order.split_official(rows.withColumn("split", F.lit("0")))
    assert train.count() + valid.count() == n and train.count() == int(n * 0.85)
    assert set(got.columns) == {*rows.columns, "seq"}


def test_prefix_of_nulls_text_and_nothing(spark):
    rows = spark.createDataFrame([("b", 2), (None, 1), ("a", None), ("b", 3), ("", 5)], "k string, v int")
    got = order.with_prefix(rows, ("k", "v"), F.coalesce("v", F.lit(0)), "upto", ranges=3)
    assert [tuple(r) for r in got.orderBy("k", "v").collect()] == [(None, 1, 1), ("", 5, 6), ("a", None, 6), ("b", 2, 8), ("b", 3, 11)]
    assert order.with_prefix(rows.limit(0), ("k",), F.lit(1), "upto").count() == 0


def test_area_under_the_curve_of_many_rows(spark):
    rows = spark.range(1_500_000).select((F.col("id") * 7919 % 1_000_003 / 1_000_003).alias("score"), (F.hash("id") % 3 == 0).alias("label"), F.repeat(F.lit("y"), 20).alias("wide"))
    frame = rows.select("score", "label").toPandas()
    ranks, pos = frame.score.rank().to_numpy(), frame.label.to_numpy()
    want = (ranks[pos].sum() - pos.sum() * (pos.sum() + 1) / 2) / (pos.sum() * (~pos).sum())
    assert abs(evaluate.roc_auc(rows) - want) < 1e-6


@pytest.mark.parametrize("settings", [{}, {"objective": "pointwise"}, {"layers": 3, "residual": True}, {"layers": 3, "residual": True, "objective": "pointwise"}])
def test_gradients_of_the_mlp_by_differences(settings):
    rng = np.random.default_rng(3)
    net = models.MLP(["a", "b", "c"], hidden=4, **settings)
    w, x, size = net.fresh(rng), rng.normal(size=(12, 3)), np.array([4, 5, 3])
    y = np.zeros(12)
    y[[1, 6, 11]] = 1
    s, inputs, active = net.forward(x, w)
    got = net.gradient(x, net.slope(s, y, size, 3.0), w, inputs, active)
    for name, value in w.items():
        for at in np.ndindex(value.shape):
            both = []
            for step in (1e-6, -1e-6):
                value[at] += step
                both.append(net.loss(net.forward(x, w)[0], y, size, 3.0))
                value[at] -= step
            assert abs((both[0] - both[1]) / 2e-6 - got[name][at]) < 1e-5, (name, at)


@pytest.mark.parametrize("settings", [{"objective": "pointwise"}, {"layers": 3, "residual": True}])
def test_models_learn_are_saved_and_loaded(spark, tmp_path, settings):
    rng = np.random.default_rng(5)
    rows = [(q, bool(k == 0), float(rng.normal() + 2.0 * (k == 0)), float(rng.normal())) for q in range(300) for k in range(6)]
    df = spark.createDataFrame(rows, "qid long, label boolean, a double, b double").cache()
    net = models.MLP(["a", "b"], hidden=8, epochs=150, rate=0.01, **settings).fit(df.filter("qid < 200"))
    net.save(spark, f"{tmp_path}/model")
    scored = models.MLP.load(spark, f"{tmp_path}/model").score(df.filter("qid >= 200"), "score")
    assert evaluate.metrics(scored.withColumn("pos", F.lit(0))).head().mrr > 0.7
    with pytest.raises(FileNotFoundError):
        models.MLP.load(spark, f"{tmp_path}/none")
    with pytest.raises(ValueError):
        models.MLP(["a"], objective="other")
