"""WARC archives: written by Spark's text writer, read back with segments reassembled and chunked framing decoded.

Writing: a page is an HTTP response in a `response` record; a page whose payload another page has too, of a larger
page_id, is a `revisit` record that refers to it and repeats the HTTP header alone. A response's body is sent in chunks
(chunked transfer framing), and a block longer than `segment_bytes` is split into the record and `continuation` records,
each with its segment number and the record's id as origin, the last with the total length. A file is an ordinary archive:
each record is a gzip member of its own (or plain), and a row of the text writer is a file without its last bytes, which are the
writer's line separator: of a gzip file the end of an empty member, of a plain one the two line ends that close a record.

Reading: files are parsed record by record, whole records pass through, segments are grouped by origin, ordered by number
and joined, their number and total length verified; then the HTTP header is parsed, the framing decoded and the payload's
digest compared. `status` is ok, or names what failed; a damaged record is a row of nulls with its status, and reading goes on
at the next one. Nothing is dropped silently.

Record ids are unique. That of a response is made from its page_id and payload, so that revisits can name it; where rows share
both, and of all records that nobody refers to by id, they are random, and revisits name such a response by its URI alone.

Nulls: a null html is an empty payload; a null page_id is written with an empty URI name and comes back null. Equal payloads are
joined by their SHA-1 and length; rows with equal page_ids and payloads have a record each. Very long payloads are segments of bounded
size until one task joins those of one record. An empty table makes no archives. Extra columns are ignored.
"""

from __future__ import annotations

import base64
import hashlib
import re
import zlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import new_path, prepare, with_unique_names, written

END = "\r\n"
RECORD_END = END * 2
URI = "urn:x-page:"
DATE = "2024-01-01T00:00:00Z"
# A gzip member without content; its last eight bytes are the checksum and length of nothing.
EMPTY_MEMBER = bytes.fromhex("1f8b0800000000000003") + b"\x03\x00" + bytes(8)


def base32_sha1(hexes: Column) -> Column:
    """Bare upper-case base32 of a SHA-1 in hex: 40 bits at a time."""
    part = lambda k: F.lpad(F.conv(F.substring(hexes, 10 * k + 1, 10), 16, 32), 8, "0")
    return F.translate(F.concat(*map(part, range(4))), "0123456789ABCDEFGHIJKLMNOPQRSTUV", "ABCDEFGHIJKLMNOPQRSTUVWXYZ234567")


def uuid_of(*parts: Column) -> Column:
    h = F.md5(F.concat_ws("/", *parts))
    return F.concat(F.lit("urn:uuid:"), *[x for k, n in ((1, 8), (9, 4), (13, 4), (17, 4), (21, 12)) for x in ((F.lit("-"),) if k > 1 else ()) + (F.substring(h, k, n),)])


def chunked(body: Column, chunk_bytes: int) -> Column:
    """Binary in chunked transfer framing."""
    n = F.octet_length(body)
    starts = F.when(n > 0, F.sequence(F.lit(0), n - 1, F.lit(chunk_bytes))).otherwise(F.array().cast("array<int>"))

    def frame(at: Column) -> Column:
        part = F.substring(body, at + 1, F.lit(chunk_bytes))
        return F.concat(F.lower(F.hex(F.octet_length(part))).cast("binary"), F.lit(END).cast("binary"), part, F.lit(END).cast("binary"))

    # strings of the same bytes: joining them copies each byte once
    joined = F.array_join(F.transform(starts, lambda at: frame(at).cast("string")), "").cast("binary")
    return F.concat(joined, F.lit("0" + RECORD_END).cast("binary"))


def records(pages: DataFrame, min_revisit_bytes: int = 0, segment_bytes: int = 32_768, chunk_bytes: int = 8_192) -> DataFrame:
    """value: the bytes of every record, without the two line ends that close it."""
    source = with_unique_names(pages, "page_id", "html").select(F.col("page_id").cast("long").alias("page_id"), F.coalesce(F.encode(F.col("html").cast("string"), "utf-8"), F.lit(b"")).alias("body"))
    rows = source.select("page_id", "body", F.octet_length("body").cast("long").alias("n"), F.sha1("body").alias("sha1"))
    # least rows for each payload: partial sums first, so a payload that a third of the pages has is one row from each task
    each = rows.groupBy("sha1", "n", "page_id").agg(F.count("*").alias("rows"))
    last = F.max(F.struct("page_id", "rows"))
    first = each.groupBy("sha1", "n").agg(last.alias("last"), F.sum("rows").alias("copies")).filter(F.col("copies") > 1)
    first = written(first.select("sha1", "n", F.col("last.page_id").alias("response"), (F.col("last.rows") == 1).alias("named")), "payloads")
    rows = rows.join(first, ["sha1", "n"], "left")
    revisit = F.coalesce((F.col("n") >= min_revisit_bytes) & (F.col("page_id") < F.col("response")), F.lit(False))
    id_of = lambda p: uuid_of(F.coalesce(p.cast("string"), F.lit("")), F.col("sha1"), F.col("n").cast("string"))
    rows = rows.withColumn("revisit", revisit).withColumn("digest", base32_sha1(F.col("sha1"))).withColumn("name", F.coalesce(F.col("page_id").cast("string"), F.lit("")))
    http = lambda x: F.concat(F.lit("HTTP/1.1 200 OK" + END + "Content-Type: text/html; charset=utf-8" + END + "X-Payload-Length: "), F.col("n").cast("string"), F.lit(x + RECORD_END)).cast("binary")
    block = F.when(F.col("revisit"), http("")).otherwise(F.concat(http(END + "Transfer-Encoding: chunked"), chunked(F.col("body"), chunk_bytes)))
    # named: a response that revisits refer to by its id; without copies there is nothing to tell apart
    fixed = F.col("named").isNull() | F.col("named") & F.coalesce(F.col("page_id") == F.col("response"), F.lit(False))
    random = F.concat(F.lit("urn:uuid:"), F.uuid())
    rows = rows.withColumn("block", block).withColumn("total", F.octet_length("block")).withColumn("random", random)
    rows = rows.withColumn("own", F.when(fixed, id_of(F.col("page_id"))).otherwise(F.col("random")))
    parts = rows.select("*", F.posexplode(F.sequence(F.lit(0), F.greatest(F.col("total") - 1, F.lit(0)), F.lit(segment_bytes))).alias("k", "at"))
    parts = parts.withColumn("part", F.substring(F.col("block"), F.col("at") + 1, F.lit(segment_bytes)))
    many, last = F.col("total") > segment_bytes, F.col("at") + segment_bytes >= F.col("total")
    line = lambda label, value: F.concat(F.lit(label + ": "), value, F.lit(END))
    wrap = lambda x: F.concat(F.lit("<"), x, F.lit(">"))
    if_ = lambda condition, value: F.when(condition, value).otherwise(F.lit(""))
    first_part = F.col("k") == 0
    head = F.concat(
        F.lit("WARC/1.1" + END),
        line("WARC-Type", F.when(~first_part, F.lit("continuation")).when(F.col("revisit"), F.lit("revisit")).otherwise(F.lit("response"))),
        line("WARC-Record-ID", wrap(F.when(first_part, F.col("own")).otherwise(uuid_of(F.col("own"), F.col("k").cast("string"))))),
        line("WARC-Date", F.lit(DATE)),
        line("WARC-Target-URI", F.concat(F.lit(URI), F.col("name"))),
        if_(first_part, line("WARC-Payload-Digest", F.concat(F.lit("sha1:"), F.col("digest")))),
        if_(F.col("revisit"), F.concat(line("WARC-Profile", F.lit("http://netpreserve.org/warc/1.1/revisit/identical-payload-digest")), if_(F.col("named"), line("WARC-Refers-To", wrap(id_of(F.col("response"))))), line("WARC-Refers-To-Target-URI", F.concat(F.lit(URI), F.coalesce(F.col("response").cast("string"), F.lit("")))))),
        if_(many, line("WARC-Segment-Number", (F.col("k") + 1).cast("string"))),
        if_(~first_part, line("WARC-Segment-Origin-ID", wrap(F.col("own")))),
        if_(many & last, line("WARC-Segment-Total-Length", F.col("total").cast("string"))),
        line("Content-Type", F.lit("application/http; msgtype=response")),
        line("Content-Length", F.octet_length("part").cast("string")),
        F.lit(END),
    )
    return parts.select(F.concat(head.cast("binary"), F.col("part")).alias("value"))


def write(pages: DataFrame, path: str, file_bytes: int = 8 << 20, compression: str = "gzip", level: int = 4, **sizes: int) -> None:
    """Archives of about `file_bytes` at most before compression. compression: gzip (each record a member) or none."""
    if compression not in ("gzip", "none"):
        raise ValueError(f"no such compression: {compression}")
    packed = compression == "gzip"
    end = EMPTY_MEMBER[-8:] if packed else RECORD_END.encode()
    prepare(pages.sparkSession)

    def files(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[bytes] = []
        size = 0

        def done() -> pa.RecordBatch:
            content = b"".join(held) + EMPTY_MEMBER if packed else b"".join(held)
            return pa.record_batch([pa.array([content[: -len(end)]], pa.binary())], ["value"])

        for batch in batches:
            for value in batch.column(0).to_pylist():
                record = value + RECORD_END.encode()
                held.append(zlib.compress(record, level, 31) if packed else record)
                size += len(record)
                if size >= file_bytes:
                    yield done()
                    held, size = [], 0
        if held:
            yield done()

    out = records(pages, **sizes).mapInArrow(files, "value binary").select(F.col("value").cast("string"))
    out.write.options(compression="none", maxRecordsPerFile="1", encoding="ISO-8859-1", lineSep=end.decode("latin-1")).text(path)


def members(content: bytes) -> Iterator[bytes | None]:
    """The content of each gzip member; None for a damaged stretch, after which reading goes on at the next whole one."""
    at, view, lost = 0, memoryview(content), False
    while at < len(content):
        unpacker, out, to = zlib.decompressobj(31), [], at
        try:
            while not unpacker.eof and to < len(content):
                out.append(unpacker.decompress(view[to : to + 65_536]))
                to = min(to + 65_536, len(content))
            if not unpacker.eof:
                raise zlib.error("the member has no end")
            at, lost = to - len(unpacker.unused_data), False
            yield b"".join(out)
        except zlib.error:
            if not lost:
                yield None
            lost = True
            at = content.find(EMPTY_MEMBER[:3], at + 1)
            if at < 0:
                return


def parse(content: bytes) -> Iterator[tuple[dict[str, str], bytes]]:
    """(headers in lower case, block) of each record. Headers of a damaged record are its `status` alone."""
    if content[:2] == EMPTY_MEMBER[:2]:
        for member in members(content):
            if member is None:
                yield {"status": "a damaged gzip member"}, b""
            elif member:
                yield from _records(member)
    else:
        yield from _records(content)


def _records(content: bytes) -> Iterator[tuple[dict[str, str], bytes]]:
    at = 0
    while at < len(content):
        end = content.find(b"\r\n\r\n", at)
        lines = content[at : max(end, at)].decode("utf-8", "replace").split("\r\n")
        headers = {k.strip().lower(): v.strip() for k, _, v in (x.partition(":") for x in lines[1:])}
        length = headers.get("content-length", "")
        begin = end + 4
        stop = begin + int(length) if length.isascii() and length.isdigit() else -1
        if end < 0 or not lines[0].startswith("WARC/"):
            wrong = "no record where one should begin"
        elif stop < 0 or not {"warc-type", "warc-record-id"} <= headers.keys():
            wrong = "a needed header is missing"
        elif content[stop : stop + 4] != b"\r\n\r\n":
            wrong = "a record doesn't end where its length says"
        else:
            yield headers, content[begin:stop]
            at = stop + 4
            continue
        yield {"status": wrong}, b""
        found = content.find(b"\r\n\r\nWARC/", at + 1)
        if found < 0:
            return
        at = found + 4


def dechunk(body: bytes) -> bytes:
    out, at = [], 0
    while True:
        end = body.find(b"\r\n", at)
        if end < 0 or not re.fullmatch(rb"[0-9A-Fa-f]+", size := body[at:end].split(b";")[0].strip()):
            raise ValueError("a chunk has no size")
        n = int(size, 16)
        if n == 0:
            return b"".join(out)
        if body[end + 2 + n : end + 4 + n] != b"\r\n" or len(body) < end + 4 + n:
            raise ValueError("a chunk doesn't end where its length says")
        out.append(body[end + 2 : end + 2 + n])
        at = end + 4 + n


def payload(kind: str | None, block: bytes, stated: str) -> tuple[int, bytes, str]:
    """Payload length, payload (none in revisits) and status of a whole record."""
    head, gap, body = block.partition(b"\r\n\r\n")
    if not gap:
        return 0, b"", "no HTTP header"
    length = re.search(rb"(?im)^X-Payload-Length: *(\d+)", head)
    if kind == "revisit":
        return int(length[1]) if length else 0, b"", "ok" if length else "no payload length"
    try:
        body = dechunk(body) if re.search(rb"(?im)^Transfer-Encoding: *chunked", head) else body
    except ValueError as problem:
        return 0, b"", str(problem)
    ok = stated == "sha1:" + base64.b32encode(hashlib.sha1(body).digest()).decode()
    return len(body), body, "ok" if ok else "another digest than stated"


ROW = "page_id long, payload_bytes long, payload_digest string, record_type string, refers_to long, status string, payload binary"
PART = "origin string, kind string, uri string, digest string, refers string, segment int, total long, block binary"
_KINDS = {"long": pa.int64(), "int": pa.int32(), "string": pa.string(), "binary": pa.binary()}


def _names(schema: str) -> list[str]:
    return [x.split(" ")[0] for x in schema.split(", ")]


def _batch(rows: list[tuple], schema: str) -> pa.RecordBatch:
    kinds = [_KINDS[x.split(" ")[1]] for x in schema.split(", ")]
    return pa.record_batch([pa.array([r[j] for r in rows], t) for j, t in enumerate(kinds)], _names(schema))


def _id(uri: str | None) -> int | None:
    name = (uri or "").removeprefix(URI)
    return int(name) if re.fullmatch(r"-?[0-9]{1,18}", name) else None


def _row(kind: str | None, uri: str, digest: str, refers: str | None, block: bytes, with_payload: bool) -> tuple:
    n, body, status = payload(kind, block, digest)
    return (_id(uri), n, digest.removeprefix("sha1:"), kind, _id(refers) if kind == "revisit" else None, status, body if with_payload else None)


def read(spark: SparkSession, path: str, with_payload: bool = False) -> DataFrame:
    """Every record of the archives, whole: page_id, payload_bytes, payload_digest, record_type, refers_to, status[, payload]. Whole records
    are judged where they are parsed; only segments are written and shuffled."""
    prepare(spark)
    files = spark.read.format("binaryFile").option("pathGlobFilter", "part-*").load(path).select("content")
    n_row, n_part = len(_names(ROW)), len(_names(PART))

    def parts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for content in batch.column(0).to_pylist():
                rows, size = [], 0
                for h, block in parse(content):
                    about = (h.get("warc-type"), h.get("warc-target-uri", ""), h.get("warc-payload-digest", ""), h.get("warc-refers-to-target-uri"))
                    if "status" in h:
                        rows.append((*[None] * 5, h["status"], *[None] * (n_part + 1)))
                    elif (number := h.get("warc-segment-number")) is not None:
                        total = h.get("warc-segment-total-length", "")
                        rows.append((*[None] * n_row, h.get("warc-segment-origin-id", h["warc-record-id"]), *about, int(number) if number.isdigit() else 0, int(total) if total.isdigit() else None, block))
                    else:
                        rows.append((*_row(*about, block, with_payload), *[None] * n_part))
                    size += len(block)
                    if size > 1 << 20:
                        yield _batch(rows, f"{ROW}, {PART}")
                        rows, size = [], 0
                yield _batch(rows, f"{ROW}, {PART}")

    def reassembled(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple] = []

        def close() -> Iterator[pa.RecordBatch]:
            if not held:
                return
            first, numbers, block = held[0], [r[5] for r in held], b"".join(r[7] for r in held)
            row = _row(*first[1:5], block, with_payload)
            if numbers != list(range(1, len(held) + 1)) or held[-1][6] != len(block):
                row = (*row[:5], "segments are missing or differ", row[6])
            yield _batch([row], ROW)
            held.clear()

        for batch in batches:
            for row in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if held and held[-1][0] != row[0]:
                    yield from close()
                held.append(row)
        yield from close()

    table = written(files.mapInArrow(parts, f"{ROW}, {PART}"), "records")
    alone = table.filter("segment is null").select(*_names(ROW))
    segments = table.filter("segment is not null").select(*_names(PART)).repartition(F.col("origin")).sortWithinPartitions("origin", "segment")
    out = alone.unionByName(segments.mapInArrow(reassembled, ROW))
    return out if with_payload else out.drop("payload")


def round_trip(pages: DataFrame) -> DataFrame:
    path = new_path(pages.sparkSession, "warc")
    write(pages, path)
    return read(pages.sparkSession, path)
