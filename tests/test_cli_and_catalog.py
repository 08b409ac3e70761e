import importlib.util
import json
import random
import sys

import duckdb
import pytest

from edgetide import cli
from edgetide.plans import catalog

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def folder(tmp_path_factory):
    rng, top = random.Random(1), tmp_path_factory.mktemp("data")
    rows = [(rng.randrange(20), 100 + int(rng.random() ** 2 * 30), t) for t in range(600)]
    (top / "train.csv").write_text("src,dst,time,split\n" + "".join(f"{s},{d},{t},{int(t >= 480)}\n" for s, d, t in rows))
    tests = [[rng.randrange(22), 700 + k, *rng.sample(range(100, 135), 10)] for k in range(15)]
    (top / "test.csv").write_text("src,time," + ",".join(f"c{k}" for k in range(1, 11)) + "\n" + "".join(",".join(map(str, r)) + "\n" for r in tests))
    return top


def run(capsys, *args):
    assert cli.main(list(map(str, args))) == 0
    return json.loads(capsys.readouterr().out.strip().splitlines()[-1])


def test_profile_and_evaluate(spark, folder, tmp_path, capsys):
    report = run(capsys, "profile", folder, "--out", tmp_path, "--width", 10)
    assert (report["train_rows"], report["valid_rows"], report["test_cells"]) == (480, 120, 150)
    run(capsys, "evaluate", folder, "--out", tmp_path, "--candidates", 8, "--max-events", 40)
    rows = spark.read.csv(f"{tmp_path}/metrics", header=True).collect()
    assert {r.eval_set for r in rows} == {"random", "hard"} and {r.mode for r in rows} == set(cli.MODES)
    assert all(0 <= float(r.mrr) <= 1 for r in rows)


def test_predictions_are_valid(spark, folder, tmp_path, capsys):
    for regime in ("dataset1", "dataset2"):
        report = run(capsys, "predict", folder, "--out", tmp_path / regime, "--width", 10, "--regime", regime)
        assert report["valid"] and report["rows"] == 15
    names = run(capsys, "sweep", folder, "--out", tmp_path / "s", "--width", 10, "--blends", "0.1,1")
    assert list(names) == ["0p10", "1p00"]
    with pytest.raises(SystemExit):
        cli.parser().parse_args(["predict", "x", "--width", "0"])


@pytest.mark.parametrize("name", ["edges_in_order", "dst_stats", "features_rule18", "bucket_mrr", "asof_prequential", "flagship"])
def test_queries_equal_their_sql(spark, name):
    con = duckdb.connect()
    for t in ("lineitem", "orders", "events"):
        con.sql(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    df = catalog.queries()[name](spark, SF)
    columns = sorted(df.columns)
    norm = lambda v: round(v, 6) + 0.0 if isinstance(v, float) else v
    got = sorted((tuple(norm(r[c]) for c in columns) for r in df.collect()), key=str)
    out = con.sql(catalog.oracle_sql()[name])
    at = [out.columns.index(c) for c in columns]
    want = sorted((tuple(norm(float(r[i]) if r[i].__class__.__name__ == "Decimal" else r[i]) for i in at) for r in out.fetchall()), key=str)
    assert got == want


def test_entry_registers_everything():
    import __spark_entry__ as entry

    names, sql = entry.queries(), entry.oracle_sql()
    assert set(sql) <= set(names) and len(sql) > 80
    assert ("pipeline" in names) == (importlib.util.find_spec("corpus_pipeline") is not None)
    assert not any("edgetide.llm" in x for x in sys.modules) or any(x.startswith("op1_") for x in names)
