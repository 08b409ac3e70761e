"""The registered queries on a small folder of tables with nulls, empty and long texts, repeated rows, and columns that clash."""

import base64
import hashlib
import random
from collections import Counter

import numpy as np
import pytest

from edgetide.llm import decontamination, quality, registry, tokens

from .test_scans import plain_verdict
from .test_texts import brute_join

CONTRACTS = {
    "op1_toxicity": "doc_id bigint, held_out boolean, score double, predicted int",
    "op2_warc": "page_id bigint, payload_bytes bigint, payload_digest string, record_type string, refers_to bigint",
    "op3_decontamination": "doc_id bigint, n_words bigint, n_hit bigint, n_items bigint, items_sha256 string, contaminated boolean",
    "op4_best_fit_packing": "doc_id bigint, piece int, start bigint, length bigint, ids_crc32 bigint, sequence_id bigint, offset bigint",
    "op5_secret_scan": "doc_id bigint, n_assign bigint, n_access bigint, n_hex bigint, base_sha256 string, spans string",
    "op6_quality_rules": "doc_id bigint, n_words bigint, word_chars bigint, n_symbols bigint, n_dup_lines bigint, n_repeat_words bigint, base_failed boolean, kept boolean",
    "op7_jaccard_join": "doc_id bigint, class_id bigint, n_links bigint",
    "op8_token_store": "doc_id bigint, start bigint, n_tokens bigint, ids_crc32 bigint",
    "op9_url_rules": "page_id bigint, host string, path string, rule string, verdict string",
    "op10_license_digests": "doc_id bigint, n_words bigint, digest string, license_id string",
}


def tables():
    rng = random.Random(31)
    words = [a + b for a in ("ka", "lo", "mi", "ne", "po", "ra", "su", "ti") for b in ("ba", "den", "for", "gal", "her", "int", "jot")]
    text = lambda n: " ".join(rng.choice(words) + rng.choice(["", "", ",", ".\n"]) for _ in range(n))
    texts = [text(rng.choice([5, 40, 200])) for _ in range(40)]
    items = [(k, text(25)) for k in range(4)] + [(9, "KA lo"), (10, None), (11, "")]
    texts += [texts[3] + " tail", texts[5], texts[5], None, "", "...", text(30) + " " + items[1][1] + " " + text(10), "é日本 " * 30, text(4_000), "x" * 30_000, "a b c d e f g h " * 60, "#$%&|<>* " * 40, "line one two\nline one two\n \n" * 9]
    docs = [(k, t, rng.choice(["en", "fr", None]), "s", None if t is None else len(t), "clash") for k, t in enumerate(texts)]
    labels = [(k, k % 2, k % 3 == 0 and 1 or 0) for k in range(30)]
    pages = [(k, rng.choice(["https://www.example.com/en/a", "http://a.net/es/x?y", "HTTP://EXAMPLE.com/en/", "nothing", None]), rng.choice(["<p>a</p>", None, "", text(3_000), "é" * 50_000])) for k in range(60)] + [(None, None, None), (7, "http://net/fr/", "<p>a</p>")]
    return docs, items, labels, pages


@pytest.fixture(scope="module")
def folder(spark, tmp_path_factory):
    docs, items, labels, pages = tables()
    path = tmp_path_factory.mktemp("tables")
    spark.createDataFrame(docs, "doc_id long, text string, lang string, source string, n_chars long, row string").write.parquet(f"{path}/documents.parquet")
    spark.createDataFrame(items, "item_id long, text string").write.parquet(f"{path}/benchmark.parquet")
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(f"{path}/labels.parquet")
    spark.createDataFrame(pages, "page_id long, url string, html string").write.parquet(f"{path}/pages.parquet")
    return str(path)


@pytest.fixture(scope="module")
def results(spark, folder):
    return {name: (df.dtypes, df.collect()) for name, f in registry.queries().items() for df in [f(spark, folder)]}


def test_columns_and_rows(results):
    docs, _, _, pages = tables()
    assert set(results) == set(CONTRACTS)
    for name, contract in CONTRACTS.items():
        dtypes, rows = results[name]
        assert ", ".join(f"{c} {t}" for c, t in dtypes).startswith(contract), name
        ids = Counter(r[0] for r in rows)
        if name == "op4_best_fit_packing":
            assert set(ids) == {x[0] for x in docs}
        else:
            assert ids == Counter(x[0] for x in (pages if name in ("op2_warc", "op9_url_rules") else docs)), name


def test_pages(results):
    _, _, _, pages = tables()
    body = lambda h: (h or "").encode()
    last = {}
    for k, _, h in pages:
        last[body(h)] = max(last.get(body(h), -1), -1 if k is None else k)
    want = []
    for k, _, h in pages:
        revisit = k is not None and k < last[body(h)]
        want.append((k, len(body(h)), base64.b32encode(hashlib.sha1(body(h)).digest()).decode(), "revisit" if revisit else "response", last[body(h)] if revisit else None))
    assert sorted(map(tuple, results["op2_warc"][1]), key=str) == sorted(want, key=str)
    assert sorted(map(tuple, results["op9_url_rules"][1]), key=str) == sorted(((k, *plain_verdict(u, registry.URL_RULES)) for k, u, _ in pages), key=str)


def test_documents_against_plain_versions(results):
    docs, items, _, _ = tables()
    texts = [x[1] for x in docs]
    assert {r[0]: tuple(r)[1:] for r in results["op3_decontamination"][1]} == {k: decontamination.brute_force(t, items) for k, t in enumerate(texts)}
    assert {r.doc_id: (r.class_id, r.n_links) for r in results["op7_jaccard_join"][1]} == brute_join(texts)
    memory, at = tokens.pieces(tokens.default_path()), 0
    for r in sorted(results["op8_token_store"][1], key=lambda r: r.doc_id):
        n = (len(memory.whole(texts[r.doc_id])) // 4 if texts[r.doc_id] else 0) + 1
        assert (r.start, r.n_tokens) == (at, n)
        at += n


def plain_counts(text):
    """The contract's columns, character by character."""
    text = text or ""
    words = [w for w in __import__("re").split(r"[\x20\x09-\x0D]+", text) if w]
    lines = [x for x in text.split("\n") if x.strip(" \t\n\v\f\r")]
    windows = [tuple(words[k : k + 8]) for k in range(len(words) - 7)]
    count, covered = Counter(windows), set()
    for k, w in enumerate(windows):
        if count[w] > 1:
            covered.update(range(k, k + 8))
    failed = len(words) < 20 or 100 * len(covered) > 30 * len(words)
    return len(words), sum(map(len, words)), sum(c in "#*$%&|<>" for c in text), len(lines) - len(set(lines)), len(covered), failed


def test_quality_against_a_plain_version(spark, results, folder):
    docs, _, _, _ = tables()
    rows = {r.doc_id: r for r in results["op6_quality_rules"][1]}
    for k, x in enumerate(docs):
        assert tuple(rows[k])[1:7] == plain_counts(x[1]), k
    # distances and verdicts from shares that are counted plainly
    limits, table = quality.Limits(), spark.read.parquet(f"{folder}/documents.parquet")
    known = quality.references(table, limits)
    scores = {r.doc_id: r for r in quality.judged(table, limits, known).collect()}

    def distance(p, q):
        p = np.array(p, float) / sum(p) if sum(p) else None
        if p is None:
            return 0.0
        m = [(a + b) / 2 for a, b in zip(p, q)]
        half = lambda x: sum(a * np.log2(a / b) for a, b in zip(x, m) if a > 0)
        return (max(half(p) + half(q), 0) / 2) ** 0.5

    kind = lambda c: 0 if c.islower() and c.isascii() else 1 if c.isupper() and c.isascii() else 2 if c in "0123456789" else 3 if c in ".,;:'\"!?()-" else 4 if c in "#*$%&|<>" else 6 if not c.isascii() else 5
    of_lang = {lang: Counter(kind(c) for x in docs if x[2] == lang for c in x[1] or "" if not c.isspace()) for lang in {x[2] for x in docs}}
    for lang, counts in of_lang.items():
        assert known.own[lang] == pytest.approx(quality.smoothed(np.array([counts[j] for j in range(7)], float), limits.prose_chars))
    for k, (_, text, lang, *_) in enumerate(docs):
        counts = Counter(kind(c) for c in text or "" if not c.isspace())
        near = min(distance([counts[j] for j in range(7)], q) for q in (known.own[lang], *known.classes))
        assert scores[k].class_distance == pytest.approx(near, abs=1e-9), k
        far = sum(counts.values()) >= limits.class_min_chars and near > limits.class_distance
        words = tokens and [w.decode() for w in quality.words_of((text or "").encode())]
        common = [(Counter(words), q, limit, [w.decode() for w in sorted(known.words, key=known.words.get)], c) for q, limit, c in zip(known.shares, known.limits, known.columns)]
        each = []
        for count, q, limit, names, columns in common:
            own = [count[names[c]] for c in columns]
            each.append((distance([*own, len(words) - sum(own)], q), limit))
        over = bool(each) and lang in known.worded and all(x > limit for x, limit in each)
        if each:
            assert scores[k].word_distance == pytest.approx(min(x for x, _ in each), abs=1e-9)
        assert rows[k].kept == (not rows[k].base_failed and not far and not (len(words) >= limits.word_min_words and over)), k
