"""Queries of the operators, with SQL where SQL can express them."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import decontamination, licenses, neardup, packing, quality, secrets, token_store, tokens, toxicity, url_rules, warc
from .common import load


# The rules of op9.
URL_RULES = [("allow", "com/"), ("block", "example.com/en/"), ("allow", "www.example.com/en/"), ("block", "net/es/"), ("block", "net/fr/")]


def op1_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toxicity.judged(load(spark, sf_dir, "documents"), load(spark, sf_dir, "labels"))


def op2_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    return warc.round_trip(load(spark, sf_dir, "pages")).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


def op3_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontamination.judged(load(spark, sf_dir, "documents"), load(spark, sf_dir, "benchmark"))


def op4_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(load(spark, sf_dir, "documents"), tokens.default_path(), packing.Capacity(1024, 1024, 1024 * 1024))


def op5_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return secrets.scanned(load(spark, sf_dir, "documents"))


def op6_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    columns = ["doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept"]
    return quality.judged(load(spark, sf_dir, "documents")).select(*columns)


def op7_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return neardup.joined(load(spark, sf_dir, "documents"))


def op8_token_store(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_store.round_trip(load(spark, sf_dir, "documents"), tokens.default_path())


def op9_url_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return url_rules.judged(load(spark, sf_dir, "pages"), url_rules.rules_frame(spark, URL_RULES))


def op10_license_digests(spark: SparkSession, sf_dir: str) -> DataFrame:
    return licenses.looked_up(load(spark, sf_dir, "documents"), licenses.known_frame(spark))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {name: f for name, f in globals().items() if name.startswith("op") and callable(f)}


def _sql_2() -> str:
    """base32 of a SHA-1 by its forty hex digits, five bits at a time from 40-bit parts."""
    part = "CAST(('0x' || substr(h, {at}, 10)) AS BIGINT)"
    letters = " || ".join(f"substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567', CAST(({part.format(at=10 * k + 1)} >> {35 - 5 * j}) & 31 AS INTEGER) + 1, 1)" for k in range(4) for j in range(8))
    return f"""
        WITH p AS (SELECT page_id, coalesce(html, '') AS body FROM pages),
        q AS (SELECT page_id, CAST(octet_length(encode(body)) AS BIGINT) AS payload_bytes, sha1(body) AS h, max(page_id) OVER (PARTITION BY body) AS last FROM p)
        SELECT page_id, payload_bytes, {letters} AS payload_digest,
            CASE WHEN page_id < last THEN 'revisit' ELSE 'response' END AS record_type, CASE WHEN page_id < last THEN last END AS refers_to
        FROM q"""


SQL_3 = r"""
    WITH lower_case AS (
        SELECT doc_id AS id, 'd' AS kind, translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS t FROM documents
        UNION ALL SELECT item_id, 'i', translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') FROM benchmark),
    words AS (SELECT id, kind, regexp_extract_all(t, '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM lower_case),
    item AS (SELECT id, w, least(13, len(w)) AS k FROM words WHERE kind = 'i' AND len(w) > 0),
    win AS (SELECT id, k, array_to_string(list_slice(w, s, s + k - 1), ' ') AS p FROM (SELECT id, w, k, unnest(range(1, len(w) - k + 2)) AS s FROM item)),
    sizes AS (SELECT DISTINCT k FROM win),
    runs AS (SELECT id, s, k, array_to_string(list_slice(w, s, s + k - 1), ' ') AS p
        FROM (SELECT id, w, k, unnest(range(1, len(w) - k + 2)) AS s FROM words, sizes WHERE kind = 'd' AND len(w) >= k)),
    found AS (SELECT runs.id, runs.s, runs.k, win.id AS item FROM runs JOIN win USING (k, p)),
    hit AS (SELECT id, count(DISTINCT x) AS n FROM (SELECT id, unnest(range(s, s + k)) AS x FROM found) GROUP BY id),
    items AS (SELECT id, count(*) AS n, string_agg(item, ',' ORDER BY item) AS l FROM (SELECT DISTINCT id, CAST(item AS VARCHAR) AS item FROM found) GROUP BY id)
    SELECT d.id AS doc_id, CAST(len(d.w) AS BIGINT) AS n_words, CAST(coalesce(hit.n, 0) AS BIGINT) AS n_hit, CAST(coalesce(items.n, 0) AS BIGINT) AS n_items,
        sha256(coalesce(items.l, '')) AS items_sha256, coalesce(hit.n, 0) > 0 AND 20 * coalesce(hit.n, 0) >= len(d.w) AS contaminated
    FROM words d LEFT JOIN hit ON hit.id = d.id LEFT JOIN items ON items.id = d.id WHERE d.kind = 'd'"""


def _sql_9() -> str:
    fits = lambda x: f"(h = '{x.partition('/')[0]}' OR ends_with(h, '.{x.partition('/')[0]}')) AND starts_with(p, '/{x.partition('/')[2]}')"
    longest = sorted(URL_RULES, key=lambda x: -len(x[1]))
    rule = " ".join(f"WHEN {fits(x)} THEN '{x}'" for _, x in longest)
    verdict = " ".join(f"WHEN {fits(x)} THEN '{action}'" for action, x in longest)
    return rf"""
        WITH r AS (SELECT page_id, CASE WHEN contains(url, '://') THEN substr(url, strpos(url, '://') + 3) ELSE '' END AS rest FROM pages),
        s AS (SELECT page_id, translate(regexp_extract(rest, '^[^/?#]*'), '{licenses.UPPER}', '{licenses.LOWER}') AS h, regexp_extract(rest, '^[^/?#]*([^?#]*)', 1) AS p FROM r)
        SELECT page_id, h AS host, p AS path, CASE {rule} END AS rule, CASE {verdict} ELSE 'allow' END AS verdict FROM s"""


def _sql_10() -> str:
    quoted = lambda x: "'" + x.replace("'", "''") + "'"
    form = f"translate(coalesce(text, ''), '{licenses.UPPER}', '{licenses.LOWER}')"
    for pattern, other in ((licenses.COPYRIGHT_BEFORE, r"\1"), (licenses.COPYRIGHT_LINE, ""), (licenses.RESERVED_LINE, "")):
        form = f"regexp_replace({form}, {quoted(pattern)}, '{other}', 'g')"
    form = f"' ' || trim(regexp_replace({form}, {quoted(licenses.OTHERS)}, '  ', 'g')) || ' '"
    for word, other in licenses.SPELLINGS.items():
        form = f"replace({form}, ' {word} ', ' {other} ')"
    known = ", ".join(f"({quoted(k)}, {quoted(v)})" for k, v in licenses.KNOWN.items())
    return f"""
        WITH known AS (SELECT license_id, {form} AS f FROM (VALUES {known}) AS t(license_id, text)),
        least_id AS (SELECT f, min(license_id) AS license_id FROM known GROUP BY f),
        d AS (SELECT doc_id, {form} AS f FROM documents)
        SELECT doc_id, CAST(CASE WHEN trim(d.f) = '' THEN 0 ELSE len(string_split(trim(d.f), '  ')) END AS BIGINT) AS n_words, sha256(d.f) AS digest, license_id
        FROM d LEFT JOIN least_id USING (f)"""


def oracle_sql() -> dict[str, str]:
    """Learned models, files and near-duplicate joins have none: tests hold them against brute force, round trips and held-out labels."""
    return {"op2_warc": _sql_2(), "op3_decontamination": SQL_3, "op9_url_rules": _sql_9(), "op10_license_digests": _sql_10()}
