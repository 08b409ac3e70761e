from pyspark.sql import functions as F

from edgetide.sources.edges import table
from edgetide.streaming import state, windows

SF = "/root/testdata/sf0.001"


def run(stream, name, mode):
    q = stream.writeStream.format("memory").queryName(name).outputMode(mode).trigger(availableNow=True).start()
    q.awaitTermination()
    return q


def split(spark, tmp_path, df, n=3):
    for k in range(n):
        df.filter(F.pmod(F.xxhash64(*df.columns), F.lit(n)) == k).coalesce(1).write.parquet(f"{tmp_path}/in{k}")
    import pathlib
    import shutil

    (tmp_path / "all").mkdir()
    for p in pathlib.Path(tmp_path).glob("in*/part-*.parquet"):
        shutil.copy(p, tmp_path / "all" / f"{p.parent.name}.parquet")
    return f"{tmp_path}/all"


def test_windows_stream_equals_batch(spark, tmp_path):
    events = table(spark, SF, "events").limit(600)
    path = split(spark, tmp_path, events)
    stream = spark.readStream.schema(events.schema).option("maxFilesPerTrigger", 1).parquet(path)
    run(windows.tumbling(stream, "1 hour"), "tumbling_s", "complete")
    batch = windows.tumbling(events, "1 hour")
    key = lambda df: sorted((r.user_id, r.start, r.n) for r in df.collect())
    assert key(spark.table("tumbling_s")) == key(batch)


def test_counts_and_last_k_equal_batch(spark, tmp_path):
    rows = [(k % 3, k % 5, k) for k in range(60)]
    edges = spark.createDataFrame(rows, "src long, dst long, time long")
    path = split(spark, tmp_path, edges)
    make = lambda: state.file_stream(spark, path, "src long, dst long, time long")
    run(state.dst_counts(make()), "counts_s", "complete")
    assert sorted(map(tuple, spark.table("counts_s").collect())) == [(d, 12, 55 + d) for d in range(5)]
    run(state.last_k_state(make(), 4), "lastk_s", "update")
    final = {}
    for r in spark.table("lastk_s").collect():
        final[r.src] = max(final.get(r.src, (0, "")), (r.n, r.hist))
    assert final == {s: (20, ",".join(str(d) for a, d, _ in rows[-12:] if a == s)) for s in range(3)}


def test_block_loop_scores_before_it_adds(spark, tmp_path):
    folder = str(tmp_path / "state")
    step = state.block_loop(folder, state.popularity_before)
    for k, dsts in enumerate([[1, 1, 2], [1, 3], [1, 2]]):
        step(spark.createDataFrame([(0, d, k) for d in dsts], "src long, dst long, time long"), k)
    step(spark.createDataFrame([(0, 1, 2), (0, 2, 2)], "src long, dst long, time long"), 2)
    import math

    got = {k: sorted(round(r.score, 6) for r in spark.read.parquet(f"{folder}/scores/{k}").collect()) for k in range(3)}
    assert got == {0: [0, 0, 0], 1: [0, round(math.log1p(2), 6)], 2: [round(math.log1p(1), 6), round(math.log1p(3), 6)]}


def test_predictions_join_a_static_table(spark, tmp_path):
    q = spark.createDataFrame([(1, 1, 5, [10, 11])], "qid long, src long, time long, candidates array<long>")
    q.coalesce(1).write.parquet(f"{tmp_path}/q")
    stream = state.file_stream(spark, f"{tmp_path}/q", "qid long, src long, time long, candidates array<long>")
    run(state.predictions(stream, spark.createDataFrame([(10, 0.5)], "dst long, score double")), "pred_s", "append")
    assert sorted(map(tuple, spark.table("pred_s").collect())) == [(1, 0, 10, 0.5), (1, 1, 11, 0.0)]
