"""Secret scans in DataFrame functions: three patterns, and character Markov models of random strings and ordinary identifiers.

The models are first-order chains over letters, digits and `+/_=-`, with a start mark; their transitions are counted
from labelled samples (1: a random string, 0: an identifier) and smoothed. A candidate, a run of at least `min_length` of
those characters, is a secret if the log-likelihood ratio of the two models is at least `min_ratio` in total and
`min_mean` for each transition, and if it overlaps no span of a pattern.

Samples are rows of a table that the caller gives. `samples` makes one of documents: pieces of SHA-256 digests of numbers as
random strings, in hex and base 64, and as identifiers the words of at most `max_documents` documents (the least by
a hash of doc_id), alone and in snake and camel case. The scan itself covers every whole text.

Spans are code points, end exclusive. Nulls: a null text is empty; a null doc_id is kept. Equal rows are scanned each by itself, very long texts whole.
An empty table gives no rows, and models without samples find nothing. Extra columns are ignored, or kept by `redact`.
"""

from __future__ import annotations

import math
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import with_unique_names

# The patterns of the contract.
ASSIGN = r"""((?i:password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
ACCESS = r"AKIA[A-Z0-9]{12,}"  # runs of AKIA[A-Z0-9]+ of 16 characters or more
HEX = r"[0-9a-f]{32,}"  # runs of [0-9a-f]+ of 32 characters or more
KEYWORDS = ["password", "passwd", "secret", "token", "apikey", "api_key"]

ALPHABET = "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/_=-"
KINDS = ["assign", "access", "hex", "markov"]
_SPANS = "array<struct<start: int, kind: int, end: int, value: string>>"
#: Matches are summed in blocks of so many, so that arrays grow within a block and over blocks only.
BLOCK = 64


@dataclass(frozen=True)
class Settings:
    min_length: int = 20
    min_ratio: float = 8.0
    min_mean: float = 0.5
    max_documents: int = 2_000
    random_samples: int = 4_000
    smoothing: float = 0.5


def _before(lengths: Column) -> Column:
    """Of an array of numbers the sum of those before each, by growing an array: for short arrays."""
    start = F.struct(F.lit(0).alias("at"), F.array().cast("array<int>").alias("out"))
    return F.aggregate(lengths, start, lambda a, n: F.struct((a["at"] + n).alias("at"), F.concat(a["out"], F.array(a["at"])).alias("out")), lambda a: a["out"])


def _let(value: Column, body) -> Column:
    """body of a value that is computed once, however often body has it."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def spans(text: Column, pattern: str, kind: int, group: int = 0, least: int = 0) -> Column:
    """Leftmost non-overlapping matches with their texts; those of whose group has fewer than `least` characters are dropped.

    What lies between the matches and the matches themselves, laid end to end, are the text: so their lengths add up to starts. They are
    added up in blocks, then over the blocks, so that a text of very many matches costs no square of their number."""
    found = F.regexp_extract_all(text, F.lit(pattern), F.lit(0))
    held = F.regexp_extract_all(text, F.lit(pattern), F.lit(group)) if group else found
    # the last gap has no match after it
    rows = F.filter(F.arrays_zip(F.split(text, pattern, -1).alias("gap"), found.alias("match"), held.alias("value")), lambda x: x["match"].isNotNull())
    sized = F.transform(rows, lambda x: F.struct((F.length(x["gap"]) + F.length(x["match"])).alias("n"), F.length(x["match"]).alias("own"), x["match"].alias("match"), (F.length(x["value"]) >= least).alias("good")))

    def in_blocks(s: Column) -> Column:
        return F.transform(F.sequence(F.lit(0), F.greatest(F.floor((F.size(s) - 1) / BLOCK).cast("int"), F.lit(0))), lambda k: F.slice(s, k * BLOCK + 1, F.lit(BLOCK)))

    def placed(block: Column, base: Column) -> Column:
        starts = _before(F.transform(block, lambda x: x["n"]))
        one = F.zip_with(block, starts, lambda x, at: F.struct((base + at + x["n"] - x["own"]).alias("start"), F.lit(kind).alias("kind"), (base + at + x["n"]).alias("end"), x["match"].alias("value"), x["good"].alias("good")))
        return F.transform(F.filter(one, lambda x: x["good"]), lambda x: F.struct(x["start"], x["kind"], x["end"], x["value"]))

    total = lambda block: F.aggregate(block, F.lit(0), lambda a, x: a + x["n"])
    return _let(_let(sized, in_blocks), lambda blocks: F.flatten(F.zip_with(blocks, _before(F.transform(blocks, total)), placed))).cast(_SPANS)


def _none() -> Column:
    return F.array().cast(_SPANS)


def _codes(value: Column) -> Column:
    """0 for the start, then each character's place in the alphabet."""
    return F.concat(F.array(F.lit(0)), F.transform(F.split(value, ""), lambda c: F.instr(F.lit(ALPHABET), c)))


def samples(docs: DataFrame, settings: Settings = Settings()) -> DataFrame:
    """Labelled samples: value, random (1 or 0)."""
    spark = docs.sparkSession
    n = F.col("id")
    digest = F.sha2(n.cast("string"), 256)
    length = (20 + F.pmod(n, F.lit(21))).cast("int")
    coded = F.translate(F.base64(F.unhex(digest)), "=", "")
    random = spark.range(settings.random_samples).select(F.when(n % 3 == 0, F.substring(digest, F.lit(1), length)).otherwise(F.substring(coded, F.lit(1), length)).alias("value"), F.lit(1).alias("random"))
    texts = with_unique_names(docs, "doc_id", "text").select("doc_id", F.col("text").cast("string")).filter("text is not null")
    # ids are chosen first, so that only the chosen texts move
    ids = texts.select("doc_id").filter("doc_id is not null").distinct().orderBy(F.xxhash64("doc_id"), "doc_id").limit(settings.max_documents)
    some = texts.join(F.broadcast(ids), "doc_id")
    words = F.regexp_extract_all("text", F.lit(r"(?<![A-Za-z0-9])[A-Za-z]{2,15}(?![A-Za-z0-9])"), F.lit(0))
    three = F.transform(F.sequence(F.lit(1), F.floor(F.size("w") / 3).cast("int")), lambda k: F.slice("w", 3 * k - 2, 3))
    some = some.select(words.alias("w")).filter(F.size("w") >= 3)
    snake = F.transform(three, lambda x: F.lower(F.concat_ws("_", x)))
    camel = F.transform(three, lambda x: F.concat_ws("", F.transform(x, F.initcap)))
    return random.unionByName(some.select(F.explode(F.concat("w", snake, camel)).alias("value"), F.lit(0).alias("random")))


def train(labelled: DataFrame, settings: Settings = Settings()) -> list[float]:
    """Log-likelihood ratio of each transition, by row of the first character and column of the second. At most two rows for each
    transition come to the driver."""
    size = len(ALPHABET) + 1
    codes = labelled.select("random", _codes(F.col("value")).alias("c")).filter("random is not null and c is not null")
    pairs = codes.select("random", F.explode(F.arrays_zip(F.slice("c", 1, F.size("c") - 1).alias("a"), F.slice("c", 2, F.size("c") - 1).alias("b"))).alias("p"))
    rows = pairs.groupBy("random", "p.a", "p.b").count().collect()
    counts = [[[settings.smoothing] * size for _ in range(size)] for _ in range(2)]
    for label, a, b, n in rows:
        counts[1 if label else 0][a][b] += n
    if {bool(r[0]) for r in rows} != {True, False}:
        return [-math.inf] * (size * size)
    total = [[sum(x) for x in m] for m in counts]
    return [math.log(counts[1][a][b] / total[1][a]) - math.log(counts[0][a][b] / total[0][a]) for a in range(size) for b in range(size)]


def ratio(value: Column, model: list[float]) -> Column:
    """Sum of the ratios of a string's transitions."""
    table = F.split(F.lit(",".join(f"{x:.4f}" for x in model)), ",").cast("array<double>")
    codes, size = _codes(value), len(ALPHABET) + 1
    pairs = F.zip_with(F.slice(codes, 1, F.length(value)), F.slice(codes, 2, F.length(value)), lambda a, b: F.get(table, a * size + b))
    return F.aggregate(pairs, F.lit(0.0), lambda a, x: a + x)


def with_spans(docs: DataFrame, model: list[float], settings: Settings = Settings()) -> DataFrame:
    """Add base and found: the spans of the patterns, and all spans, sorted by start, then kind."""
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    low = F.lower(text)
    any_keyword = F.lit(False)
    for word in KEYWORDS:
        any_keyword = any_keyword | F.contains(low, F.lit(word))
    run = "[A-Za-z0-9+/_=-]"
    candidate = f"(?<!{run}){run}{{{settings.min_length},}}"
    rows = docs.withColumn("base", F.array_sort(F.concat(
        F.when(any_keyword, spans(text, ASSIGN, 0, 2, 8)).otherwise(_none()),
        F.when(F.contains(text, F.lit("AKIA")), spans(text, ACCESS, 1)).otherwise(_none()),
        F.when(text.rlike(HEX), spans(text, HEX, 2)).otherwise(_none()),
    )))
    rows = rows.withColumn("runs", F.when(text.rlike(candidate), spans(text, candidate, 3)).otherwise(_none()))
    # keys and hex strings are made of a run's own characters, so a run that overlaps one holds it; only assignments are compared by place
    rows = rows.withColumn("runs", F.filter("runs", lambda r: ~(r["value"].rlike(ACCESS) | r["value"].rlike(HEX))))
    rows = rows.withColumn("taken", F.filter("base", lambda b: b["kind"] == 0))
    rows = rows.withColumn("runs", F.filter("runs", lambda r: ~F.exists("taken", lambda b: (b["start"] < r["end"]) & (r["start"] < b["end"])))).drop("taken")

    def secret(r: Column) -> Column:
        score = ratio(r["value"], model)
        return (score >= settings.min_ratio) & (score >= settings.min_mean * (r["end"] - r["start"]))

    more = F.when(F.size("runs") > 0, F.filter("runs", secret)).otherwise(F.col("runs"))
    return rows.withColumn("found", F.array_sort(F.concat("base", more))).drop("runs")


def joined(column: str) -> Column:
    """kind:start:end, comma-joined."""
    names = F.array(*map(F.lit, KINDS))
    return F.array_join(F.transform(column, lambda x: F.concat_ws(":", F.get(names, x["kind"]), x["start"].cast("string"), x["end"].cast("string"))), ",")


def scanned(docs: DataFrame, labelled: DataFrame | None = None, settings: Settings = Settings()) -> DataFrame:
    """doc_id, n_assign, n_access, n_hex, base_sha256, spans, n_markov of every document."""
    model = train(samples(docs, settings) if labelled is None else labelled, settings)
    source = with_unique_names(docs, "doc_id", "text").select(F.col("doc_id").cast("long"), "text")
    rows = with_spans(source, model, settings).select("doc_id", "base", "found")
    count = lambda kind: F.size(F.filter("found", lambda x: x["kind"] == kind)).cast("long")
    return rows.select("doc_id", count(0).alias("n_assign"), count(1).alias("n_access"), count(2).alias("n_hex"), F.sha2(joined("base"), 256).alias("base_sha256"), joined("found").alias("spans"), count(3).alias("n_markov"))


def redact(docs: DataFrame, labelled: DataFrame | None = None, settings: Settings = Settings(), mark: str = "[REDACTED]") -> DataFrame:
    """Every document with its columns, all spans in its text replaced; n_chars follows where there is one."""
    model = train(samples(docs, settings) if labelled is None else labelled, settings)
    names = docs.columns
    # own names for what is added, so that no column of the table can clash
    rows = docs.select(F.struct(*[F.col(f"`{c}`") for c in names]).alias("row"), F.col("text"))
    rows = with_spans(rows, model, settings)
    start = F.struct(F.lit(0).alias("at"), F.lit("").alias("out"))

    def step(a: Column, x: Column) -> Column:
        fresh = x["start"] >= a["at"]
        gap = F.substring(F.col("text"), a["at"] + 1, x["start"] - a["at"])
        return F.struct(F.greatest(a["at"], x["end"]).alias("at"), F.when(fresh, F.concat(a["out"], gap, F.lit(mark))).otherwise(a["out"]).alias("out"))

    def close(a: Column) -> Column:
        return F.concat(a["out"], F.substring(F.col("text"), a["at"] + 1, F.length("text")))

    clean = F.when(F.size("found") > 0, F.aggregate("found", start, step, close)).otherwise(F.col("text"))
    rows = rows.select("row", clean.alias("clean"), (F.size("found") > 0).alias("changed"))
    kinds = dict(docs.dtypes)
    out = {c: F.col(f"row.`{c}`") for c in names} | {"text": F.col("clean").cast(kinds["text"])}
    if "n_chars" in out:
        out["n_chars"] = F.when(F.col("changed"), F.length("clean").cast(kinds["n_chars"])).otherwise(F.col("row.n_chars"))
    return rows.select(*[v.alias(c) for c, v in out.items()])
