"""WARC archives: segmented, chunked records are written, read and put together again.

Writing: a page's HTTP response is framed in chunks and, where longer than a
segment, continued in further records (segment number, origin id and, on the
last, total length).  Equal payloads are written once; later ones are revisit
records that refer to the first.  Each record is a gzip member.  Its last byte
is zero, since members are far below 16 MB, and serves as the line end of
Spark's text sink, by which the archives are committed.

Reading: members are inflated one after the other; continuation records are
grouped by origin id, ordered by segment number and verified against the total
length; chunked framing is decoded and the payload digest verified.

Defined results: a null payload is empty, a very long one takes many segments;
repeated pages (equal id and payload) are repeated in the result; a null id stays
null; other columns are left out, whatever their names; an empty table gives no rows;
a url so long that a record's head takes 16 MB compressed is refused; missing or surplus segments, wrong lengths and
digests raise an error unless ``strict`` is off, which reports them instead.
"""

from __future__ import annotations

import hashlib
import re
import zlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

LEAST_SHARED = 100
SEGMENT = 32 << 10
CHUNK = 8 << 10
DATE = "2024-01-01T00:00:00Z"


def roles(pages: DataFrame, *, key: str, payload: str) -> DataFrame:
    """``key``, ``url`` and payload with digest and, for copies, the key of the first page with that payload.

    Only one row for each digest, found by partial minima, is joined; Spark may
    split the pages' side where one payload has a large share of them.  Payloads
    too short to be shared, of which many are empty, are looked up by their page.
    """
    digest = F.sha2(F.encode(F.col("payload"), "UTF-8"), 256)
    own = pages.select(F.col(key).alias("key"), "url", F.coalesce(F.col(payload), F.lit("")).alias("payload")).withColumn("digest", digest)
    long = own.filter(F.octet_length("payload") >= LEAST_SHARED)
    first = long.groupBy(F.col("digest").alias("at")).agg(F.min("key").alias("first"), F.count("*").alias("n")).filter("n > 1").drop("n")
    alone = F.concat(F.lit("-"), F.xxhash64("key", "url").cast("string"))
    placed = own.withColumn("at", F.when(F.octet_length("payload") >= LEAST_SHARED, F.col("digest")).otherwise(alone))
    return placed.join(first, "at", "left").drop("at").withColumn("first", F.when(F.col("first") < F.col("key"), F.col("first")))


def _head(fields: list[tuple[str, object]]) -> bytes:
    return b"WARC/1.1\r\n" + b"".join(f"{k}: {v}\r\n".encode() for k, v in fields if v is not None) + b"\r\n"


def _member(head: bytes, block: bytes) -> bytes:
    squeeze = zlib.compressobj(6, zlib.DEFLATED, 31)
    out = squeeze.compress(head + block + b"\r\n\r\n") + squeeze.flush()
    if out[-1]:
        raise ValueError("a record of 16 MB or more")
    return out[:-1]


def chunked(payload: bytes, size: int = CHUNK) -> bytes:
    parts = [payload[i : i + size] for i in range(0, len(payload), size)]
    return b"".join(b"%x\r\n%s\r\n" % (len(p), p) for p in parts) + b"0\r\n\r\n"


def dechunked(body: bytes) -> bytes:
    """The payload of a chunked body; extensions and trailers are skipped."""
    out, at = [], 0
    while True:
        stop = body.index(b"\r\n", at)
        n = int(body[at:stop].split(b";")[0], 16)
        at = stop + 2
        if n == 0:
            return b"".join(out)
        if body[at + n : at + n + 2] != b"\r\n":
            raise ValueError("a chunk does not end where it says")
        out.append(body[at : at + n])
        at += n + 2


def record_id(key: object, digest: str) -> str:
    return f"<urn:page:{'' if key is None else key}:{digest[:32]}>"


def records(key: int | None, url: str | None, payload: bytes, digest: str, first: int | None, segment: int = SEGMENT) -> Iterator[bytes]:
    """The members of one page."""
    own = record_id(key, digest)
    clean = re.sub(r"[\r\n]", "", url) if url is not None else None
    http = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\n"
    common = [("WARC-Date", DATE), ("WARC-Target-URI", clean), ("Page-Id", key), ("WARC-Payload-Digest", f"sha256:{digest}"), ("Content-Type", "application/http;msgtype=response")]
    if first is not None:
        block = http + b"Content-Length: %d\r\n\r\n" % len(payload)
        yield _member(_head([("WARC-Type", "revisit"), ("WARC-Record-ID", own), ("WARC-Refers-To", record_id(first, digest)), ("WARC-Profile", "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"), *common, ("Content-Length", len(block))]), block)
        return
    block = http + b"Transfer-Encoding: chunked\r\n\r\n" + chunked(payload)
    count = -(-len(block) // segment)
    for n in range(1, count + 1):
        part = block[(n - 1) * segment : n * segment]
        extra = [("WARC-Segment-Number", n)] if count > 1 else []
        if n == 1:
            kind = [("WARC-Type", "response"), ("WARC-Record-ID", own), *common]
        else:
            kind = [("WARC-Type", "continuation"), ("WARC-Record-ID", f"{own[:-1]}:{n}>"), ("WARC-Segment-Origin-ID", own), ("WARC-Date", DATE), ("WARC-Target-URI", clean)]
            if n == count:
                extra.append(("WARC-Segment-Total-Length", len(block)))
        yield _member(_head([*kind, *extra, ("Content-Length", len(part))]), part)


def write(pages: DataFrame, folder: str, *, key: str = "page_id", payload: str = "html", records_each: int = 2000) -> None:
    """Write all pages as archives below ``folder``, each of at most ``records_each`` records."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        made, size = [], 0
        for batch in batches:
            for row in zip(*(batch.column(c).to_pylist() for c in ("key", "url", "payload", "digest", "first")), strict=True):
                for member in records(row[0], row[1], row[2].encode(), row[3], row[4]):
                    made.append(member)
                    size += len(member)
                if size > 4 << 20:
                    yield pa.RecordBatch.from_arrays([pa.array(made, pa.binary())], names=["member"])
                    made, size = [], 0
        yield pa.RecordBatch.from_arrays([pa.array(made, pa.binary())], names=["member"])

    members = roles(pages, key=key, payload=payload).mapInArrow(run, "member binary")
    members.select(F.col("member").cast("string").alias("value")).write.option("lineSep", "\0").option("maxRecordsPerFile", records_each).text(folder)


def inflate(body: memoryview) -> Iterator[bytes]:
    """The gzip members of an archive."""
    at, n = 0, len(body)
    while at < n:
        unpack, out = zlib.decompressobj(31), []
        while not unpack.eof:
            if at >= n:
                raise ValueError("the archive ends within a record")
            piece = body[at : at + (64 << 10)]
            out.append(unpack.decompress(piece))
            at += len(piece) - len(unpack.unused_data)
        yield b"".join(out)


RECORD = "record_id string, kind string, page_id bigint, origin string, segment int, total bigint, digest string, refers string, block binary"


def _parsed(raw: bytes) -> tuple:
    stop = raw.index(b"\r\n\r\n")
    head = {k.lower(): v.strip() for k, _, v in (x.partition(":") for x in raw[:stop].decode().split("\r\n")[1:])}
    block = raw[stop + 4 : stop + 4 + int(head["content-length"])]
    if raw[stop + 4 + len(block) :] != b"\r\n\r\n":
        raise ValueError("a record does not end where it says")
    number = lambda name: int(head[name]) if name in head else None
    return (head["warc-record-id"], head["warc-type"], number("page-id"), head.get("warc-segment-origin-id"), number("warc-segment-number"), number("warc-segment-total-length"), head.get("warc-payload-digest", "").partition(":")[2] or None, head.get("warc-refers-to"), block)


def _batch(rows: list[tuple], schema: pa.Schema) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], f.type) for i, f in enumerate(schema)], schema=schema)


_RECORDS = pa.schema([("record_id", pa.string()), ("kind", pa.string()), ("page_id", pa.int64()), ("origin", pa.string()), ("segment", pa.int32()), ("total", pa.int64()), ("digest", pa.string()), ("refers", pa.string()), ("block", pa.binary())])


def read_records(spark: SparkSession, folder: str) -> DataFrame:
    """The records of all archives below ``folder``, as they are."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for body in batch.column(0):
                rows, size = [], 0
                for raw in inflate(memoryview(body.as_buffer())):
                    rows.append(_parsed(raw))
                    size += len(raw)
                    if size > 4 << 20:
                        yield _batch(rows, _RECORDS)
                        rows, size = [], 0
                yield _batch(rows, _RECORDS)

    return spark.read.format("binaryFile").load(folder).select("content").mapInArrow(run, RECORD)


def reassemble(found: DataFrame) -> DataFrame:
    """Whole records: those without a segment number as they are, the others put together by origin id.

    A group holds the segments of one record.  ``error`` says what is wrong
    with it; ``copies`` counts records written more than once under one id.
    """
    columns = ["record_id", "kind", "page_id", "digest", "refers"]
    whole = found.filter("segment is null").select(*columns, F.array("block").alias("blocks"), F.lit(1).alias("copies"), F.lit(None).cast("string").alias("error"))
    opener = lambda c: F.max(F.when(F.col("segment") == 1, F.col(c))).alias(c)
    grouped = (
        found.filter("segment is not null")
        .groupBy(F.coalesce("origin", "record_id").alias("record_id"))
        .agg(
            *(opener(c) for c in columns[1:]),
            F.max("total").alias("total"),
            F.count(F.when(F.col("segment") == 1, 1)).cast("int").alias("copies"),
            F.array_sort(F.collect_set(F.struct("segment", "block"))).alias("parts"),
        )
    )
    size = F.aggregate(F.transform("parts", lambda p: F.octet_length(p["block"]).cast("bigint")), F.lit(0).cast("bigint"), lambda a, x: a + x)
    error = (
        F.when(F.transform("parts", lambda p: p["segment"]) != F.sequence(F.lit(1), F.size("parts")), "segments are missing or differ")
        .when(F.col("total").isNull(), "the last segment is missing")
        .when(size != F.col("total"), "the total length differs")
    )
    return whole.unionByName(grouped.select(*columns, F.transform("parts", lambda p: p["block"]).alias("blocks"), "copies", error.alias("error")))


_DECODED = pa.schema([("page_id", pa.int64()), ("record_type", pa.string()), ("payload_bytes", pa.int64()), ("payload_digest", pa.string()), ("refers_to", pa.int64()), ("payload", pa.binary()), ("error", pa.string())])


def _decoded(kind: str, page: int | None, digest: str | None, refers: str | None, blocks: list[bytes], error: str | None) -> tuple:
    to = int(refers.split(":")[2]) if refers else None
    if error:
        return page, kind, None, digest, to, None, error
    block = b"".join(blocks)
    head, _, body = block.partition(b"\r\n\r\n")
    fields = {k.strip().lower(): v.strip() for k, _, v in (x.partition(b":") for x in head.split(b"\r\n")[1:])}
    if kind == "revisit":
        return page, kind, int(fields[b"content-length"]), digest, to, None, None
    try:
        payload = dechunked(body) if fields.get(b"transfer-encoding", b"").lower() == b"chunked" else body
    except ValueError as e:
        return page, kind, None, digest, to, None, str(e)
    own = hashlib.sha256(payload).hexdigest()
    return page, kind, len(payload), own, to, payload, "the payload digest differs" if digest and own != digest else None


def read(spark: SparkSession, folder: str, *, strict: bool = True, payload: bool = False) -> DataFrame:
    """Pages of the archives: page_id, record_type, payload_bytes, payload_digest, refers_to, [payload,] error.

    A revisit has no payload of its own; its length and digest are those its record states.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        schema = _DECODED if payload else _DECODED.remove(5)
        for batch in batches:
            rows, size = [], 0
            for kind, page, digest, refers, blocks, copies, error in zip(*(batch.column(c) for c in ("kind", "page_id", "digest", "refers", "blocks", "copies", "error")), strict=True):
                made = _decoded(kind.as_py(), page.as_py(), digest.as_py(), refers.as_py(), blocks.as_py(), error.as_py())
                if strict and made[6]:
                    raise ValueError(f"page {made[0]}: {made[6]}")
                size += len(made[5] or b"") if payload else 0
                rows += [made if payload else made[:5] + made[6:]] * copies.as_py()
                if size > 4 << 20:
                    yield _batch(rows, schema)
                    rows, size = [], 0
            yield _batch(rows, schema)

    columns = "page_id bigint, record_type string, payload_bytes bigint, payload_digest string, refers_to bigint, " + "payload binary, " * payload + "error string"
    return reassemble(read_records(spark, folder)).mapInArrow(run, columns)
