"""URL verdicts by a sort-merge range join.

A host's labels reversed make a key in which a host and all its subdomains are neighbours: a rule's host is an
interval of keys. URLs and the starts of intervals are sorted by key, and one sweep over a partition keeps a stack
of the nested intervals that hold the current key. Paths are intervals, too: a stack entry holds its host's rules sorted by path,
each with the next shorter path that is its own prefix, so that the longest that fits is found by bisection and a few steps
outwards, however many rules a host has. Of the entries' finds the longest (host and path together, then host, then allow
before block) wins.

Partitions are ranges of keys. Where a host has more rows than a range should, several ranges begin at its key and its
URLs are dealt among them by a hash of the row and its partition (a task that runs again deals alike). A rule goes to each range that its interval meets, so none is broadcast. Range
bounds come from a sample of hosts of bounded size (`SAMPLE` for each range); they steer the work, not the result.

Host: after the first `://` up to `/`, `?`, `#` or the end, A-Z lower-cased. Path: from there up to `?`, `#` or the end. Nulls: a
null URL, or one without `://`, has an empty host and path, which no rule fits; null page_ids are kept. Equal rows are judged
each by itself, however many (they are dealt out like others). Very long URLs are compared whole. Without rules every verdict is the
default. Extra columns are ignored.
"""

from __future__ import annotations

from bisect import bisect_left, bisect_right
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import prepare, with_unique_names

LAST = chr(0x10FFFF)  # sorts after any other character
RULES = "host string, path string, action string"
SAMPLE = 50


def split_url(url):
    """Columns host and path."""
    rest = F.regexp_extract(url, r"(?s)^.*?://(.*)$", 1)
    host = F.translate(F.regexp_extract(rest, r"(?s)^([^/?#]*)", 1), "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    path = F.regexp_extract(rest, r"(?s)^[^/?#]*([^?#]*)", 1)
    return F.coalesce(host, F.lit("")), F.coalesce(path, F.lit(""))


def key_of(host):
    """com.example.www. for www.example.com: each label with a mark after it, which sorts before any other character."""
    return F.when(host == "", F.lit("")).otherwise(F.concat(F.array_join(F.reverse(F.split(host, r"\.")), "\x01"), F.lit("\x01")))


def bounds_of(keys: DataFrame, ranges: int) -> list[str]:
    """First keys of ranges 1, 2, ...; a frequent key may come several times."""
    sample = sorted(r[0] for r in keys.orderBy(F.rand(7)).limit(SAMPLE * ranges).collect())
    return [sample[len(sample) * k // ranges] for k in range(1, ranges)] if sample else []


class Paths:
    """The rules of one host, in the order of their paths."""

    def __init__(self):
        self.paths: list[str] = []
        self.rules: list[tuple[str, str]] = []  # host, action
        self.outer: list[int] = []

    def add(self, path: str, host: str, action: str) -> None:
        """Paths come in ascending order; of equal ones allow stays."""
        if self.paths and self.paths[-1] == path:
            if action == "allow":
                self.rules[-1] = (host, action)
            return
        at = len(self.paths) - 1
        while at >= 0 and not path.startswith(self.paths[at]):
            at = self.outer[at]
        self.outer.append(at)
        self.paths.append(path)
        self.rules.append((host, action))

    def longest(self, path: str) -> int:
        """The place of the longest path that is a prefix of the given one; -1 without any."""
        at = bisect_right(self.paths, path) - 1
        while at >= 0 and not path.startswith(self.paths[at]):
            at = self.outer[at]
        return at


def judged(pages: DataFrame, rules: DataFrame, default: str = "allow", ranges: int | None = None) -> DataFrame:
    """page_id, host, path, rule, verdict of every page."""
    spark = pages.sparkSession
    prepare(spark)
    ranges = ranges or int(spark.conf.get("spark.sql.shuffle.partitions"))
    host, path = split_url(F.col("url"))
    urls = with_unique_names(pages, "page_id", "url").select(F.col("page_id").cast("long"), F.col("url").cast("string")).select("page_id", host.alias("host"), path.alias("path"))
    urls = urls.withColumn("key", key_of(F.col("host")))
    own = with_unique_names(rules, "host", "path", "action").filter("host is not null and host <> ''").select(F.lower("host").alias("host"), F.coalesce("path", F.lit("")).alias("path"), "action").distinct()
    own = own.withColumn("key", key_of(F.col("host")))
    bounds = bounds_of(urls.select("key"), ranges)

    def range_of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for key, salt in zip(batch.column(3).to_pylist(), batch.column(4).to_pylist(), strict=True):
                low, high = bisect_left(bounds, key), bisect_right(bounds, key)
                out.append(low + salt % (high - low + 1))
            yield pa.record_batch([*batch.columns[:4], pa.array(out, pa.int32())], ["page_id", "host", "path", "key", "range"])

    def ranges_of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = [(*row, k) for row in zip(*(c.to_pylist() for c in batch.columns), strict=True) for k in range(bisect_left(bounds, row[3]), bisect_right(bounds, row[3] + LAST) + 1)]
            yield pa.record_batch([pa.array([r[j] for r in rows], pa.int32() if j == 4 else pa.string()) for j in range(5)], ["host", "path", "action", "key", "range"])

    salted = urls.withColumn("salt", F.xxhash64("page_id", "path", F.spark_partition_id()).bitwiseAND(F.lit(0x7FFFFFFF)))
    left = salted.mapInArrow(range_of, "page_id long, host string, path string, key string, range int").withColumn("action", F.lit(None).cast("string"))
    right = own.mapInArrow(ranges_of, "host string, path string, action string, key string, range int").withColumn("page_id", F.lit(None).cast("long"))
    columns = ["range", "key", "kind", "page_id", "host", "path", "action"]
    events = left.withColumn("kind", F.lit(1)).select(*columns).unionByName(right.withColumn("kind", F.lit(0)).select(*columns))
    ordered = events.repartition(ranges, "range").sortWithinPartitions("range", "key", "kind", "path", "page_id")

    def sweep(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        stack: list[tuple[str, Paths]] = []
        last = None
        for batch in batches:
            out = []
            for where, key, kind, page_id, host, path, action in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if where != last:
                    stack, last = [], where
                while stack and not key.startswith(stack[-1][0]):
                    stack.pop()
                if kind == 0:
                    if not stack or stack[-1][0] != key:
                        stack.append((key, Paths()))
                    stack[-1][1].add(path, host, action)
                    continue
                best = None
                for _, held in stack:
                    if (at := held.longest(path)) >= 0:
                        (own_host, own_action), own_path = held.rules[at], held.paths[at]
                        rank = (len(own_host) + len(own_path), len(own_host))
                        if best is None or rank > best[0]:
                            best = (rank, own_host + own_path, own_action)
                out.append((page_id, host, path, best[1] if best else None, best[2] if best else default))
            yield pa.record_batch([pa.array([r[j] for r in out], pa.int64() if j == 0 else pa.string()) for j in range(5)], ["page_id", "host", "path", "rule", "verdict"])

    return ordered.mapInArrow(sweep, "page_id long, host string, path string, rule string, verdict string")


def rules_frame(spark: SparkSession, rules: list[tuple[str, str]]) -> DataFrame:
    """From (action, host/path) pairs."""
    rows = [(x.partition("/")[0], "/" + x.partition("/")[2] if "/" in x else "", action) for action, x in rules]
    return spark.createDataFrame(rows, RULES)
