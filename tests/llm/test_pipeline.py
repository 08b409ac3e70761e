"""The five stages on a small corpus against plain versions of their rules."""

import random
import re

import corpus_pipeline
from edgetide.llm import decontamination, tokens

from .test_texts import brute_join

SECRET = "9f86d081884c7d659a2feaa0c55ad015a3bf4f1b"


def corpus():
    rng = random.Random(11)
    words = [a + b for a in ("ka", "lo", "mi", "ne", "po", "ra", "su", "ti") for b in ("ba", "den", "for", "gal", "her", "int", "jot")]
    text = lambda n: " ".join(rng.choice(words) for _ in range(n))
    texts = [text(rng.choice([30, 90, 300])) for _ in range(40)]
    items = [text(25) for _ in range(5)]
    near = [x + " tail" for x in texts[:6]]
    stained = [text(40) + " " + x + " " + text(40) for x in items]
    secret = [f'{text(30)} token = "{SECRET}" {text(30)}' for _ in range(4)]
    junk = ["%%% ### *** &&& " * 80, "short", "", None, text(10) + " same words again and again here now ok" * 20]
    return [*texts, *near, *stained, *secret, *junk, *texts[:3]], items, text(2000)


def test_stages_against_plain_rules(spark, tmp_path):
    texts, items, long_text = corpus()
    texts.append(long_text)
    rows = [(k, t, "en", "s", len(t or "")) for k, t in enumerate(texts)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    docs.write.parquet(f"{tmp_path}/documents.parquet")
    bench = list(enumerate(items))
    spark.createDataFrame(bench, "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    now, seen = docs, {}
    for k, (name, stage) in enumerate(corpus_pipeline.STAGES):
        out = stage(spark, now, str(tmp_path))
        if k + 1 < len(corpus_pipeline.STAGES):
            assert out.dtypes == docs.dtypes, name
            out.write.parquet(f"{tmp_path}/{k}")
            out = spark.read.parquet(f"{tmp_path}/{k}")
            seen[name] = {r.doc_id: r for r in out.collect()}
            now = out
    kept = set(seen["quality rules"])
    n = len(texts)
    assert kept == {k for k, t in enumerate(texts) if t and len(t.split()) >= 20 and not t.startswith("%%%") and "same words again" not in t}
    order = sorted(kept)
    groups = brute_join([texts[k] for k in order])
    first = {order[k] for k, (c, _) in groups.items() if c == k}
    assert set(seen["n-gram Jaccard join"]) == first and len(first) < len(kept)
    clean = {k for k in first if not decontamination.brute_force(texts[k], bench)[-1]}
    assert set(seen["benchmark decontamination"]) == clean and len(clean) == len(first) - len(items)
    after = seen["secret scans"]
    plain = {k: re.sub(r"""token = "[0-9a-f]+""", "[REDACTED]", texts[k]) for k in clean}
    assert {k: r.text for k, r in after.items()} == plain
    pieces = out.collect()
    memory = tokens.pieces(tokens.default_path())
    for k in clean:
        own = sorted((r.piece, r.start, r.length) for r in pieces if r.doc_id == k)
        assert sum(x[2] for x in own) == len(memory.whole(plain[k])) // 4 + 1
    ends = {}
    for r in pieces:
        ends[r.sequence_id] = max(ends.get(r.sequence_id, 0), r.offset + r.length)
    assert max(ends.values()) <= 1024 and n - 1 in {r.doc_id for r in pieces}
    assert sorted((r.doc_id, r.piece) for r in corpus_pipeline.run(spark, str(tmp_path)).collect()) == sorted((r.doc_id, r.piece) for r in pieces)


def test_each_row_has_its_own_verdict(spark, tmp_path):
    texts, items, _ = corpus()
    clean, copies, stained = texts[6:10], texts[:6], texts[46:51]
    spark.createDataFrame(list(enumerate(items)), "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    # null ids, and one id for different texts
    rows = [(None, t) for t in [copies[0], copies[0], stained[0]]] + [(7, t) for t in [copies[1], stained[1], clean[0]]]
    rows += [(3, copies[1]), (8, copies[2]), (9, copies[2] + " tail"), (9, clean[1]), (5, None), (5, None), (None, None), (None, None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    twice = [(None, copies[0]), (7, copies[1]), (9, copies[2] + " tail"), (5, None)]
    unique = corpus_pipeline.near_duplicates(spark, docs, str(tmp_path))
    left = list(rows)
    for x in twice:
        left.remove(x)
    assert unique.columns == docs.columns and sorted(map(tuple, unique.collect()), key=str) == sorted(left, key=str)
    pure = corpus_pipeline.benchmark_decontamination(spark, docs, str(tmp_path))
    want = [x for x in rows if x[1] not in stained]
    assert pure.columns == docs.columns and sorted(map(tuple, pure.collect()), key=str) == sorted(want, key=str)


def test_stages_of_empty_tables(spark, tmp_path):
    schema = "doc_id long, text string, lang string, source string, n_chars long"
    spark.createDataFrame([], schema).write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    assert corpus_pipeline.run(spark, str(tmp_path)).count() == 0
