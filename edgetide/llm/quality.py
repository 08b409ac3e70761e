"""Quality rules: base counts of every text, and its divergence from language references.

A reference has a language's shares of character classes and of its most common words, counted over all documents of
that language. A document's two histograms are compared to every reference by the Jensen-Shannon distance (base 2, so
0 to 1) and the nearest reference counts, so that a wrong language mark harms nobody whose language is in the table. Short
texts have too few characters or words for a histogram and pass: the guards are in `Limits`.

Every language has a reference by classes for its own documents, however few they are: its counts are smoothed by those of
plain prose in its own script, so that a rare language isn't measured by others' letters and a few junk texts don't vouch
for themselves. Languages of `reference_words` count for documents of all languages, too.

A text with none of a reference's common words has a distance that their share alone fixes, its ceiling (0.49 where they
are 41 % of all words), so the limit by words is a share of each reference's own ceiling. Documents of a language whose
common words aren't known (too few words, or too small a share) pass by words: those of other languages say nothing.

Documents of a language beyond the `languages` of the most words are compared to plain prose in their own script and to the others'
references by classes, and pass by words.

Words are runs without space and U+0009 to U+000D. Nulls: a null text has no words (and fails the base rule); a null lang
is a language of its own; a null doc_id is kept. Equal rows are judged each by itself, very long texts whole. An empty table has no references and
no rows. Extra columns are ignored, or kept by `with_verdict`.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import WordHashes, as_bytes, prepare, released, rolling, with_unique_names, words_of

SPACE, LOWER, UPPER, DIGIT, POINT, SYMBOL, OTHER, WIDE, INNER = range(9)
CLASSES = 7  # LOWER to WIDE


def _classes() -> np.ndarray:
    out = np.full(256, OTHER, np.uint8)
    for members, kind in ((b" \t\n\v\f\r", SPACE), (bytes(range(97, 123)), LOWER), (bytes(range(65, 91)), UPPER), (b"0123456789", DIGIT), (b".,;:'\"!?()-", POINT), (b"#*$%&|<>", SYMBOL)):
        out[list(members)] = kind
    out[0xC0:], out[0x80:0xC0] = WIDE, INNER
    return out


_CLASS = _classes()
#: Shares of LOWER to WIDE in plain prose of a Latin script; letters of other scripts are WIDE.
_PROSE = np.array([0.93, 0.03, 0.01, 0.03, 0, 0, 0])


@dataclass(frozen=True)
class Limits:
    class_distance: float = 0.35
    class_min_chars: int = 200
    word_distance: float = 0.60
    #: Of a reference's ceiling: the lesser of both limits holds.
    word_ceiling: float = 0.91
    #: Where the common words are less of all words, a short text may have none of them by chance: no reference by words.
    word_share: float = 0.25
    word_min_words: int = 50
    common_words: int = 100
    #: A language with fewer words in all documents is no reference for others, and none by words.
    reference_words: int = 2_000
    #: Characters of plain prose added to each language's own.
    prose_chars: int = 2_500
    #: Languages with references, those of the most words (language marks may be anything): they come to the driver and go to every task.
    languages: int = 1_000


def repeated_words(words: list[bytes], hashes: WordHashes, width: int = 8) -> int:
    """Words inside windows that occur twice or more; equal hashes are only candidates."""
    if len(words) <= width:
        return 0
    value = rolling(np.fromiter(map(hashes.__getitem__, words), np.uint64, len(words)), width)
    order = np.sort(value)
    twice = order[1:][order[1:] == order[:-1]]
    if not len(twice):
        return 0
    candidates = np.flatnonzero(np.isin(value, twice)).tolist()
    windows = [tuple(words[k : k + width]) for k in candidates]
    count = Counter(windows)
    covered = np.zeros(len(words) + 1, np.int64)
    for k, window in zip(candidates, windows, strict=True):
        if count[window] > 1:
            covered[k] += 1
            covered[k + width] -= 1
    return int((np.cumsum(covered) > 0).sum())


def base_counts(text: bytes | None, hashes: WordHashes) -> tuple[int, int, int]:
    """n_words, n_dup_lines, n_repeat_words."""
    if not text:
        return 0, 0, 0
    words = text.split()
    lines = [x for x in text.split(b"\n") if x.strip()]
    return len(words), len(lines) - len({*lines}), repeated_words(words, hashes)


def class_counts(texts: list[bytes | None]) -> np.ndarray:
    """A row for each text, a column for each character class."""
    lengths = np.array([len(x or b"") for x in texts])
    kinds = _CLASS[np.frombuffer(b"".join(x or b"" for x in texts), np.uint8)]
    return np.bincount(np.repeat(np.arange(len(texts)) * 9, lengths) + kinds, minlength=9 * len(texts)).reshape(-1, 9)


def js_distance(p: np.ndarray, q: np.ndarray) -> np.ndarray:
    """Jensen-Shannon distance of each row of counts p to the shares q; a row without counts has distance 0."""
    total = p.sum(1, keepdims=True)
    p = np.divide(p, total, out=np.zeros(p.shape), where=total > 0)
    m = (p + q) / 2
    with np.errstate(divide="ignore", invalid="ignore"):
        left = np.where(p > 0, p * np.log2(p / m), 0).sum(1)
        right = np.where(q > 0, q * np.log2(q / m), 0).sum(1)
    return np.where(total[:, 0] > 0, np.sqrt(np.maximum(left + right, 0) / 2), 0.0)


@dataclass(frozen=True)
class References:
    words: dict[bytes, int]  # common words of all languages: their columns
    classes: list[np.ndarray]  # shares, for each language that counts for all
    own: dict[str | None, np.ndarray]  # shares, for each language
    shares: list[np.ndarray]  # of its own common words, then of all others
    columns: list[np.ndarray]  # its own common words
    limits: list[float]  # of the distance by words
    worded: set[str | None]  # languages whose common words are known


def prose_in(counts: np.ndarray) -> np.ndarray:
    """Shares of plain prose in the script of the counted letters."""
    letters = counts[[LOWER - 1, WIDE - 1]]
    prose = _PROSE.copy()
    if letters.sum():
        prose[[LOWER - 1, WIDE - 1]] = prose[LOWER - 1] * letters / letters.sum()
    return prose


def smoothed(counts: np.ndarray, chars: int) -> np.ndarray:
    """Shares of character classes, with so many characters of plain prose in the script of the counted letters."""
    return (counts + chars * prose_in(counts)) / (counts.sum() + chars)


def ceiling(shares: np.ndarray) -> float:
    """The distance by words of a text that has none of the common ones."""
    return float(js_distance(np.eye(len(shares))[-1:], shares)[0])


def references(docs: DataFrame, limits: Limits = Limits()) -> References:
    """Counted over all documents; `common_words` rows for each language come to the driver."""
    prepare(docs.sparkSession)

    def counts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[object, Counter] = {}
        kinds: dict[object, np.ndarray] = {}

        def out() -> pa.RecordBatch:
            rows = [(lang, w, n) for lang, c in held.items() for w, n in c.items()]
            rows += [(lang, b"\x00%d" % k, int(v[k])) for lang, v in kinds.items() for k in range(9)]
            rows += [(lang, b"\x00w", c.total()) for lang, c in held.items()]
            return pa.record_batch([pa.array([r[j] for r in rows], t) for j, t in enumerate((pa.string(), pa.binary(), pa.int64()))], ["lang", "word", "n"])

        for batch in released(batches):
            texts, langs = as_bytes(batch.column(1)), batch.column(0).to_pylist()
            for lang, row in zip(langs, class_counts(texts), strict=True):
                kinds[lang] = kinds.get(lang, 0) + row
            for lang in {*langs}:
                own = held.setdefault(lang, Counter())
                for text, of in zip(texts, langs, strict=True):
                    if of == lang:
                        own.update(words_of(text))
            if sum(map(len, held.values())) > 100_000:
                yield out()
                held, kinds = {}, {}
        if kinds:
            yield out()

    source = with_unique_names(docs, "lang", "text").select(F.col("lang").cast("string"), F.col("text").cast("string"))
    table = source.mapInArrow(counts, "lang string, word binary, n long").groupBy("lang", "word").agg(F.sum("n").alias("n"))
    kind = F.col("word").startswith(F.lit(b"\x00"))
    # the languages of the most words, at most so many rows
    most = table.filter(F.col("word") == F.lit(b"\x00w")).orderBy(F.desc("n"), "lang").limit(limits.languages).select(F.col("lang").alias("known"))
    table = table.join(F.broadcast(most), F.col("lang").eqNullSafe(F.col("known"))).drop("known")
    # marks first, then the commonest words: each task keeps only so many of a language before the exchange
    rank = F.row_number().over(Window.partitionBy("lang").orderBy(kind.desc(), F.desc("n"), "word"))
    rows = table.select("*", kind.alias("kind")).withColumn("rank", rank).filter(F.col("rank") <= limits.common_words + 10).collect()
    known: dict[bytes, int] = {}
    out = References(known, [], {}, [], [], [], set())
    for lang in sorted({r.lang for r in rows}, key=str):
        own = [r for r in rows if r.lang == lang]
        marks = {bytes(r.word)[1:]: r.n for r in own if r.kind}
        classes = np.array([marks[b"%d" % k] for k in range(9)], float)
        out.own[lang] = smoothed(classes[1 : 1 + CLASSES], limits.prose_chars)
        if marks[b"w"] < limits.reference_words:
            continue
        common = sorted((r for r in own if not r.kind), key=lambda r: r.rank)
        out.classes.append(out.own[lang])
        shares = np.array([r.n for r in common], float) / marks[b"w"]
        if shares.sum() < limits.word_share:
            continue
        out.columns.append(np.array([known.setdefault(bytes(r.word), len(known)) for r in common], np.int64))
        out.shares.append(np.append(shares, max(0.0, 1 - shares.sum())))
        out.worded.add(lang)
        out.limits.append(min(limits.word_distance, limits.word_ceiling * ceiling(out.shares[-1])))
    return out


def distances(texts: list[bytes | None], langs: list[str | None], kinds: np.ndarray, known: References) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """The number of words for the histogram, each text's distance to the nearest reference by classes and by words, and whether
    it is over every reference's limit by words."""
    split = [words_of(x) for x in texts]
    n = np.array([len(x) for x in split], np.int64)
    by_word, over = np.zeros(len(texts)), np.zeros(len(texts), bool)
    own = np.array([known.own[x] if x in known.own else prose_in(kinds[k, 1 : 1 + CLASSES]) for k, x in enumerate(langs)]).reshape(-1, CLASSES)
    by_class = np.min([js_distance(kinds[:, 1 : 1 + CLASSES], q) for q in (own, *known.classes)], axis=0)
    if known.shares:
        width = len(known.words)
        of = known.words.get
        found = np.array([k * (width + 1) + of(w, width) for k, x in enumerate(split) for w in x], np.int64)
        table = np.bincount(found, minlength=len(texts) * (width + 1)).reshape(len(texts), width + 1)
        each = np.array([js_distance(np.column_stack([table[:, c], n - table[:, c].sum(1)]), q) for c, q in zip(known.columns, known.shares, strict=True)])
        by_word = each.min(0)
        over = (each > np.array(known.limits)[:, None]).all(0) & np.array([x in known.worded for x in langs], bool)
    return n, by_class, by_word, over


SCORES = "n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long, class_distance double, word_distance double, base_failed boolean, kept boolean"


def scored(texts: list[bytes | None], langs: list[str | None], known: References, limits: Limits, hashes: WordHashes) -> list[pa.Array]:
    """Columns of SCORES."""
    kinds = class_counts(texts)
    base = np.array([base_counts(x, hashes) for x in texts], np.int64).reshape(-1, 3)
    n, by_class, by_word, over = distances(texts, langs, kinds, known)
    chars = kinds[:, 1 : 1 + CLASSES].sum(1)
    failed = (base[:, 0] < 20) | (100 * base[:, 2] > 30 * base[:, 0])
    far = (chars >= limits.class_min_chars) & (by_class > limits.class_distance) | (n >= limits.word_min_words) & over
    return [pa.array(x) for x in (base[:, 0], chars, kinds[:, SYMBOL], base[:, 1], base[:, 2], by_class, by_word, failed, ~failed & ~far)]


def judged(docs: DataFrame, limits: Limits = Limits(), known: References | None = None) -> DataFrame:
    """doc_id and SCORES of every document."""
    known = known or references(docs, limits)
    prepare(docs.sparkSession)
    schema = "doc_id long, " + SCORES

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hashes = WordHashes()
        for batch in released(batches):
            yield pa.record_batch([batch.column(0), *scored(as_bytes(batch.column(1)), batch.column(2).to_pylist(), known, limits, hashes)], [x.split(" ")[0] for x in schema.split(", ")])

    source = with_unique_names(docs, "doc_id", "text", "lang").select(F.col("doc_id").cast("long"), F.col("text").cast("string"), F.col("lang").cast("string"))
    return source.mapInArrow(rows, schema)


def keep(docs: DataFrame, limits: Limits = Limits()) -> DataFrame:
    """The documents that no rule rejects, with all their columns."""
    known = references(docs, limits)
    prepare(docs.sparkSession)
    at, mark = docs.columns.index("text"), docs.columns.index("lang") if "lang" in docs.columns else None

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hashes = WordHashes()
        for batch in released(batches):
            langs = [None] * len(batch) if mark is None else batch.column(mark).cast(pa.string()).to_pylist()
            yield batch.filter(scored(as_bytes(batch.column(at)), langs, known, limits, hashes)[-1])

    return docs.mapInArrow(rows, docs.schema)
