"""WARC archives: writing responses, revisits and segmented records, and reading them back.

A payload goes into an HTTP response in chunked transfer framing; a block of more than
SEGMENT_BYTES is cut into a first record and continuation records, as the WARC standard has it.
Reading groups continuation records by their origin, orders them by segment number, verifies the
total length and decodes the framing. Archives are written and listed by Spark, so any store that
Spark reads will do; the archive files are gzip-compressed.
"""

from __future__ import annotations

import re
import zlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructType

from keytide.session import scratch_path

SEGMENT_BYTES = 1 << 15
CHUNK_BYTES = 1 << 14
#: Payloads below this are always written as responses.
REVISIT_FROM = 100
#: Records of an archive file; with SEGMENT_BYTES they bound its size.
FILE_RECORDS = 5_000
#: Bytes of records that a reading task hands on at once.
BATCH_BYTES = 1 << 23

RECORD_END = "\r\n\r\n"
_CONTROL = re.compile(r"[\x00-\x20\x7f]")


def with_payloads(pages: DataFrame) -> DataFrame:
    """``(page_id, url, payload, digest)``: NULL html is an empty payload; other columns go."""
    payload = F.coalesce(F.col("html").cast("string"), F.lit("")).cast("binary")
    return pages.select(
        F.col("page_id").cast("long").alias("page_id"),
        F.coalesce(F.col("url").cast("string"), F.lit("")).alias("url"),
        payload.alias("payload"),
        F.sha2(payload, 256).alias("digest"),
    )


def revisits(payloads: DataFrame) -> DataFrame:
    """``(revisit_id, refers_to)``: pages whose payload one with a smaller id has."""
    large = payloads.where(F.octet_length("payload") >= REVISIT_FROM).select("page_id", "digest")
    first = (
        large.groupBy("digest")
        .agg(F.min("page_id").alias("refers_to"), F.count(F.lit(1)).alias("n"))
        .where("n > 1")
        .select(F.col("digest").alias("shared"), "refers_to")
    )
    return (
        large.join(first, F.col("digest") == F.col("shared"))
        .where("page_id <> refers_to")
        .select(F.col("page_id").alias("revisit_id"), F.col("digest").alias("of_digest"), "refers_to")
        .distinct()
    )


def chunked(payload: bytes, size: int = CHUNK_BYTES) -> bytes:
    """Chunked transfer framing."""
    parts = []
    for at in range(0, len(payload), size):
        some = payload[at : at + size]
        parts += [b"%x\r\n" % len(some), some, b"\r\n"]
    return b"".join([*parts, b"0\r\n\r\n"])


def unchunked(body: bytes) -> bytes | None:
    """What chunked framing holds; None where the framing is broken or not ended."""
    parts, at = [], 0
    while True:
        end = body.find(b"\r\n", at)
        try:
            size = int(body[at:end].split(b";")[0], 16) if end >= 0 else -1
        except ValueError:
            return None
        if size < 0:
            return None
        if size == 0:
            return b"".join(parts)
        parts.append(body[end + 2 : end + 2 + size])
        at = end + 2 + size
        if body[at : at + 2] != b"\r\n":
            return None
        at += 2


def _record(headers: list[tuple[str, object]], block: bytes) -> bytes:
    lines = "".join(f"{k}: {v}\r\n" for k, v in headers if v is not None)
    return f"WARC/1.1\r\n{lines}Content-Length: {len(block)}\r\n\r\n".encode() + block


def records_of(
    page_id: int | None, url: str, payload: bytes, digest: str, refers_to: int | None, name: str,
    segment_bytes: int = SEGMENT_BYTES,
) -> Iterator[bytes]:
    """The record or records of a page, without what ends a record."""
    ident = lambda n: f"<urn:x-page:{page_id}:{name}:{n}>"
    uri = _CONTROL.sub(lambda m: f"%{ord(m[0]):02X}", url)
    common = [
        ("WARC-Date", "1970-01-01T00:00:00Z"),
        ("WARC-Target-URI", uri),
        ("Content-Type", "application/http;msgtype=response"),
    ]
    described = [
        ("X-Page-Id", page_id),
        ("WARC-Payload-Digest", f"sha256:{digest}"),
    ]
    http = "HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\n"
    if refers_to is not None:
        block = f"{http}Content-Length: {len(payload)}\r\n\r\n".encode()
        profile = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
        refers = [("WARC-Profile", profile), ("WARC-Refers-To", f"<urn:x-page:{refers_to}>")]
        yield _record([("WARC-Type", "revisit"), ("WARC-Record-ID", ident(1)), *common, *described, *refers], block)
        return
    block = f"{http}Transfer-Encoding: chunked\r\n\r\n".encode() + chunked(payload)
    if len(block) <= segment_bytes:
        yield _record([("WARC-Type", "response"), ("WARC-Record-ID", ident(1)), *common, *described], block)
        return
    for n, at in enumerate(range(0, len(block), segment_bytes), 1):
        last = at + segment_bytes >= len(block)
        yield _record(
            [
                ("WARC-Type", "response" if n == 1 else "continuation"),
                ("WARC-Record-ID", ident(n)),
                *common,
                *(described if n == 1 else []),
                ("WARC-Segment-Number", n),
                ("WARC-Segment-Origin-ID", None if n == 1 else ident(1)),
                ("WARC-Segment-Total-Length", len(block) if last else None),
            ],
            block[at : at + segment_bytes],
        )


def write(pages: DataFrame, path: str, segment_bytes: int = SEGMENT_BYTES) -> None:
    """Archives of all pages below ``path``. Of equal payloads the page with the smallest id is the
    response; rows that repeat that id are responses too, and so are rows without an id."""
    payloads = with_payloads(pages)
    again = revisits(payloads)
    same = (F.col("page_id") == F.col("revisit_id")) & (F.col("digest") == F.col("of_digest"))
    joined = payloads.join(again, same, "left").select("page_id", "url", "payload", "digest", "refers_to")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, n = TaskContext.get().partitionId(), 0
        for batch in batches:
            out = []
            for row in zip(*(batch.column(c) for c in batch.schema.names)):
                n += 1
                out += records_of(*(x.as_py() for x in row), f"{part}-{n}", segment_bytes)
                if sum(map(len, out[-64:])) > BATCH_BYTES or len(out) >= 1024:
                    yield pa.RecordBatch.from_arrays([pa.array(out, pa.binary())], ["record"])
                    out = []
            if out:
                yield pa.RecordBatch.from_arrays([pa.array(out, pa.binary())], ["record"])

    # the text sink writes bytes as they are, each value followed by what ends a record
    records = joined.mapInArrow(run, "record binary").select(F.col("record").cast("string").alias("value"))
    records.write.option("lineSep", RECORD_END).option("compression", "gzip").option(
        "maxRecordsPerFile", FILE_RECORDS
    ).text(path)


def inflated(content: bytes, step: int = 1 << 20) -> Iterator[bytes]:
    """An archive's bytes in parts: gzip members one after the other, or as they are."""
    if content[:2] != b"\x1f\x8b":
        yield from (content[at : at + step] for at in range(0, len(content), step))
        return
    while content:
        member = zlib.decompressobj(31)
        for at in range(0, len(content), step):
            yield member.decompress(content[at : at + step])
            if member.eof:
                break
        yield member.flush()
        content = member.unused_data + content[at + step :] if member.eof else b""


def parse(parts: Iterator[bytes]) -> Iterator[tuple[dict[str, str], bytes]]:
    """Headers (lower-case names) and blocks of the records of an archive. ``Content-Length``
    alone says where a block ends, so blocks may hold anything. An archive that is cut off ends
    with its last whole record."""
    held, ended = bytearray(), False

    def more() -> bool:
        nonlocal ended
        part = next(parts, None)
        ended = part is None
        held.extend(part or b"")
        return not ended

    while True:
        while (end := held.find(b"\r\n\r\n")) < 0:
            if not more():
                return
        lines = held[:end].decode("utf-8", "replace").lstrip("\r\n").split("\r\n")
        headers = {k.strip().lower(): v.strip() for k, _, v in (x.partition(":") for x in lines[1:])}
        size = int(headers.get("content-length", 0))
        stop = end + 4 + size
        while len(held) < stop + 4:
            if not more():
                break
        if len(held) < stop:
            return
        yield headers, bytes(held[end + 4 : stop])
        del held[: min(len(held), stop + 4)]


_RECORDS = (
    "record_id string, origin string, segment int, total long, record_type string, page_id long, "
    "refers_to long, digest string, block binary"
)
_PAGE = re.compile(r"<urn:x-page:(-?\d+)>")


def records(spark: SparkSession, path: str, segmented: bool | None = None) -> DataFrame:
    """All records of the archives below ``path``, or those that are, or are not, segmented.

    ``origin`` is the id of a record's first segment, its own where it is not a continuation.
    """

    struct = StructType.fromDDL(_RECORDS)

    def row(headers: dict[str, str], block: bytes) -> tuple:
        number = lambda name: int(headers[name]) if name in headers else None
        own, refers = headers.get("warc-record-id"), _PAGE.match(headers.get("warc-refers-to", ""))
        page = headers.get("x-page-id", "None")
        return (
            own, headers.get("warc-segment-origin-id", own), number("warc-segment-number"),
            number("warc-segment-total-length"), headers.get("warc-type"),
            None if page == "None" else int(page), int(refers[1]) if refers else None,
            headers.get("warc-payload-digest", "").removeprefix("sha256:"), block,
        )

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        schema = to_arrow_schema(struct)
        rows, size = [], 0
        for batch in batches:
            for content in batch.column("content"):
                for headers, block in parse(inflated(content.as_py())):
                    if segmented is not None and segmented != ("warc-segment-number" in headers):
                        continue
                    rows.append(row(headers, block))
                    size += len(block)
                    if size > BATCH_BYTES:
                        yield _batch(rows, schema)
                        rows, size = [], 0
        if rows:
            yield _batch(rows, schema)

    return spark.read.format("binaryFile").load(path).select("content").mapInArrow(run, struct)


def _batch(rows: list[tuple], schema: pa.Schema) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows), schema)], schema=schema)


def http_payload(block: bytes) -> tuple[bytes | None, int | None]:
    """The payload of an HTTP response and the length that it declares; no payload where the
    framing is broken."""
    head, _, body = block.partition(b"\r\n\r\n")
    fields = {k.strip().lower(): v.strip() for k, _, v in (x.partition(b":") for x in head.split(b"\r\n")[1:])}
    if fields.get(b"transfer-encoding", b"").lower() == b"chunked":
        return unchunked(body), None
    declared = fields.get(b"content-length")
    return body, int(declared) if declared and declared.isdigit() else None


def reassembled(spark: SparkSession, path: str) -> DataFrame:
    """``(page_id, record_type, refers_to, digest, declared, payload)``, a row for each page.

    Segments are grouped by origin, put in order and joined; where one is missing or there twice,
    the total length is not what it should be or the framing is broken, ``payload`` is NULL. A
    revisit has no payload of its own; ``declared`` is the length it states. A group is one page.
    """
    whole = records(spark, path, segmented=False).select(
        "page_id", "record_type", "refers_to", "digest", F.array("block").alias("blocks"),
        F.array(F.lit(1)).alias("segments"), F.octet_length("block").cast("long").alias("total"),
    )
    parts = (
        records(spark, path, segmented=True)
        .groupBy("origin")
        .agg(
            F.max("page_id").alias("page_id"),
            F.max(F.when(F.col("segment") == 1, F.col("record_type"))).alias("record_type"),
            F.max("refers_to").alias("refers_to"),
            F.max("digest").alias("digest"),
            F.sort_array(F.collect_list(F.struct("segment", "block"))).alias("parts"),
            F.max("total").alias("total"),
        )
        .select(
            "page_id", "record_type", "refers_to", "digest", F.col("parts.block").alias("blocks"),
            F.col("parts.segment").alias("segments"), "total",
        )
    )

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            payloads, lengths = [], []
            for blocks, segments, total in zip(*(batch.column(c) for c in ("blocks", "segments", "total"))):
                block = b"".join(blocks.as_py())
                in_order = segments.as_py() == list(range(1, len(segments) + 1))
                payload, length = http_payload(block)
                payloads.append(payload if in_order and len(block) == total.as_py() else None)
                lengths.append(length)
            kept = [batch.column(c) for c in ("page_id", "record_type", "refers_to", "digest")]
            yield pa.RecordBatch.from_arrays(
                [*kept, pa.array(lengths, pa.int64()), pa.array(payloads, pa.binary())],
                names=["page_id", "record_type", "refers_to", "digest", "declared", "payload"],
            )

    schema = "page_id long, record_type string, refers_to long, digest string, declared long, payload binary"
    return whole.union(parts).mapInArrow(run, schema)


def round_trip(pages: DataFrame) -> DataFrame:
    """Write all pages to archives in the shared folder and describe what is read back.

    ``(page_id, payload_bytes, payload_digest, record_type, refers_to)``. Lengths and digests of
    responses are those of the payload that was reassembled, of revisits those they state.
    """
    spark = pages.sparkSession
    path = scratch_path(spark, "warc")
    write(pages, path)
    revisit = F.col("record_type") == "revisit"
    return reassembled(spark, path).select(
        "page_id",
        F.when(revisit, F.col("declared")).otherwise(F.octet_length("payload").cast("long")).alias("payload_bytes"),
        F.when(revisit, F.col("digest")).otherwise(F.sha2("payload", 256)).alias("payload_digest"),
        "record_type",
        "refers_to",
    )
