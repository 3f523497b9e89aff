"""WARC archives: writing pages as segmented, chunked records, and reading them back by segment reassembly.

A page is a ``response`` record with an HTTP head and a body in chunked transfer framing. A record block longer than
``SEGMENT_BYTES`` is cut into segments: the first keeps the record's type, the others are ``continuation`` records that name
the origin record's id and their number; the last one carries the total length. Pages with a payload that another page
has in full become ``revisit`` records with the payload's digest and the other page's record id.

Spark writes the archives: the text writer puts the two line ends after each record that the format asks for. An
archive holds at most ``RECORDS`` records, so its size has a bound, and readers take whole archives from ``binaryFile``.
"""

from __future__ import annotations

import hashlib
import uuid
import zlib

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ledgerscope.llm.shared import arrow_schema, as_bytes

LEAST_BYTES = 100
SEGMENT_BYTES = 64 << 10
CHUNK_BYTES = 8 << 10
RECORDS = 2000
_SPACE = uuid.UUID("6ba7b811-9dad-11d1-80b4-00c04fd430c8")


def record_id(page_id: int | None, digest: str) -> str:
    return f"<urn:uuid:{uuid.uuid5(_SPACE, f'page:{page_id}:{digest}')}>"


def chunked(payload: bytes, size: int = CHUNK_BYTES) -> bytes:
    """A payload in chunked transfer framing."""
    parts = [payload[i:i + size] for i in range(0, len(payload), size)]
    return b"".join(b"%x\r\n%s\r\n" % (len(p), p) for p in parts) + b"0\r\n\r\n"


def unchunked(body: bytes) -> bytes:
    """The payload of a chunked body; raises where the framing is broken or the body ends early."""
    out, at = [], 0
    while True:
        end = body.index(b"\r\n", at)
        size = int(body[at:end].split(b";")[0], 16)
        at = end + 2
        if size == 0:
            return b"".join(out)
        if body[at + size:at + size + 2] != b"\r\n":
            raise ValueError("chunk without an end")
        out.append(body[at:at + size])
        at += size + 2


def _record(kind: str, rid: str, block: bytes, **fields) -> bytes:
    head = [f"WARC-Type: {kind}", f"WARC-Record-ID: {rid}", "WARC-Date: 2024-01-01T00:00:00Z", f"Content-Length: {len(block)}"]
    head += [f"{k.replace('_', '-')}: {v}" for k, v in fields.items() if v is not None]
    return ("WARC/1.1\r\n" + "\r\n".join(head) + "\r\n\r\n").encode() + block


def records(page_id: int | None, url: str | None, html: bytes | None, first: int | None, segment: int = SEGMENT_BYTES) -> list[bytes]:
    """All records of one page; ``first`` is the page that holds the payload in full."""
    payload = html or b""
    digest = hashlib.sha256(payload).hexdigest()
    rid = record_id(page_id, digest)
    # a page without an id has an empty X-Page-ID; a URL can't hold line ends
    shared = {"WARC_Target_URI": (url or "").replace("\r", "%0D").replace("\n", "%0A") or None, "X_Page_ID": "" if page_id is None else page_id,
              "WARC_Payload_Digest": "sha256:" + digest, "Content_Type": "application/http;msgtype=response"}
    if first is not None and first != page_id:
        return [_record("revisit", rid, b"HTTP/1.1 200 OK\r\n\r\n", WARC_Refers_To=record_id(first, digest), **shared,
                        WARC_Profile="http://netpreserve.org/warc/1.1/revisit/identical-payload-digest")]
    block = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nTransfer-Encoding: chunked\r\n\r\n" + chunked(payload)
    if len(block) <= segment:
        return [_record("response", rid, block, **shared)]
    parts = [block[i:i + segment] for i in range(0, len(block), segment)]
    out = [_record("response", rid, parts[0], WARC_Segment_Number=1, **shared)]
    for number, part in enumerate(parts[1:], 2):
        own = f"<urn:uuid:{uuid.uuid5(_SPACE, f'{rid}:{number}')}>"
        out.append(_record("continuation", own, part, WARC_Segment_Origin_ID=rid, WARC_Segment_Number=number, X_Page_ID=shared["X_Page_ID"],
                           WARC_Segment_Total_Length=len(block) if number == len(parts) else None))
    return out


def write(pages: DataFrame, path: str, segment: int = SEGMENT_BYTES, least: int = LEAST_BYTES, per_archive: int = RECORDS) -> None:
    """Write ``pages(page_id, url, html)`` as gzipped WARC files under ``path``.

    Of pages with equal payloads of ``least`` bytes or more, the one with the smallest page_id is written whole, the others
    revisit it (rows that repeat that id are whole too; null ids never revisit nor are revisited). Null counts as empty.
    """
    rows = pages.select(F.col("page_id").cast("long").alias("page_id"), F.col("url").cast("string").alias("url"), "html",
                        F.sha2(F.coalesce("html", F.lit("")).cast("binary"), 256).alias("digest"))
    owners = rows.where((F.octet_length("html") >= least) & F.col("page_id").isNotNull()).groupBy("digest").agg(
        F.min("page_id").alias("first"), F.max("page_id").alias("last")).where("first < last")
    told = rows.join(owners.select("digest", "first"), "digest", "left").select(
        "page_id", "url", "html", F.when(F.col("page_id").isNotNull(), F.col("first")).alias("first"))

    def run(batches):
        for batch in batches:
            columns = zip(batch.column("page_id").to_pylist(), batch.column("url").to_pylist(), as_bytes(batch, "html"), batch.column("first").to_pylist())
            out = [r for page_id, url, html, first in columns for r in records(page_id, url, html, first, segment)]
            for i in range(0, len(out), 256):
                yield pa.RecordBatch.from_pydict({"record": out[i:i + 256]}, schema=arrow_schema("record binary"))

    text = told.mapInArrow(run, "record binary").select(F.col("record").cast("string").alias("value"))
    text.write.option("lineSep", "\r\n\r\n").option("compression", "gzip").option("maxRecordsPerFile", per_archive).text(path)


_FIELDS = ("type string, record_id string, origin string, number int, total long, page_id long, refers_to string, digest string, "
           "block binary")


def parse(data: bytes) -> list[dict]:
    """The records of an archive; raises where one doesn't follow the format."""
    out, at = [], 0
    while at < len(data):
        end = data.index(b"\r\n\r\n", at)
        lines = data[at:end].decode().split("\r\n")
        if not lines[0].startswith("WARC/"):
            raise ValueError("not a WARC record")
        head = {k.lower(): v.strip() for k, v in (line.split(":", 1) for line in lines[1:])}
        start, size = end + 4, int(head["content-length"])
        if data[start + size:start + size + 4] != b"\r\n\r\n":
            raise ValueError("record without an end")
        rid = head["warc-record-id"]
        total, page = head.get("warc-segment-total-length"), head.get("x-page-id")
        out.append({"type": head["warc-type"], "record_id": rid, "origin": head.get("warc-segment-origin-id", rid),
                    "number": int(head.get("warc-segment-number", 0)), "total": int(total) if total else None,
                    "page_id": int(page) if page else None, "refers_to": head.get("warc-refers-to"),
                    "digest": head.get("warc-payload-digest", "").removeprefix("sha256:") or None, "block": data[start:start + size]})
        at = start + size + 4
    return out


def read(spark: SparkSession, path: str) -> DataFrame:
    """All records of the archives under ``path``."""
    files = spark.read.format("binaryFile").option("pathGlobFilter", "*.gz").load(path).select("content")
    schema = arrow_schema(_FIELDS)

    def run(batches):
        for batch in batches:
            for packed in batch.column("content"):
                found = parse(zlib.decompress(packed.as_py(), 31))
                for i in range(0, len(found), 256):
                    yield pa.RecordBatch.from_pylist(found[i:i + 256], schema=schema)

    return files.mapInArrow(run, _FIELDS)


def _whole(blocks: DataFrame) -> DataFrame:
    """Payload facts of complete blocks: head and body parted, chunked framing decoded, digest checked."""
    ddl = "record_id string, page_id long, payload_bytes long, payload_digest string, payload binary"

    def run(batches):
        for batch in batches:
            out = []
            for rid, page, said, block in zip(*(batch.column(c).to_pylist() for c in ("record_id", "page_id", "digest", "block"))):
                head, _, body = block.partition(b"\r\n\r\n")
                payload = unchunked(body) if b"transfer-encoding: chunked" in head.lower() else body
                digest = hashlib.sha256(payload).hexdigest()
                if said and said != digest:
                    raise ValueError(f"payload of {rid} doesn't have its digest")
                out.append({"record_id": rid, "page_id": page, "payload_bytes": len(payload), "payload_digest": digest, "payload": payload})
            yield pa.RecordBatch.from_pylist(out, schema=arrow_schema(ddl))

    return blocks.mapInArrow(run, ddl)


def responses(found: DataFrame) -> DataFrame:
    """Response records of ``found`` with whole payloads: segments are grouped by origin, ordered by number, checked against
    the total length, and decoded. Records that aren't segmented aren't shuffled. A segment that is missing raises. Pages that
    were written twice come back twice."""
    fields = ["record_id", "page_id", "digest", "block"]
    single = found.where((F.col("type") == "response") & (F.col("number") == 0)).select(*fields)
    parts = found.where(F.col("number") > 0).groupBy("origin", "number").agg(
        F.first(F.struct("page_id", "digest", "total", "block")).alias("part"), F.count(F.lit(1)).alias("copies"))
    grouped = parts.groupBy("origin").agg(F.array_sort(F.collect_list(F.struct("number", "part"))).alias("parts"), F.max("copies").alias("copies"))
    grouped = grouped.select("origin", "parts", F.explode(F.array_repeat(F.lit(1), F.col("copies").cast("int"))))
    last = F.element_at("parts", -1)
    joined = grouped.select(
        F.col("origin").alias("record_id"), F.col("parts")[0]["part"]["page_id"].alias("page_id"), F.col("parts")[0]["part"]["digest"].alias("digest"),
        F.expr("aggregate(parts, cast('' as binary), (a, p) -> concat(a, p.part.block))").alias("block"),
        F.size("parts").alias("n"), last["number"].alias("number"), last["part"]["total"].alias("total"))
    sound = (F.col("n") == F.col("number")) & (F.octet_length("block") == F.col("total"))
    joined = joined.withColumn("block", F.when(F.coalesce(sound, F.lit(False)), F.col("block")).otherwise(
        F.raise_error(F.concat(F.lit("segments are missing of "), F.col("record_id"))).cast("binary")))
    return _whole(single.unionAll(joined.select(*fields)))


def pages_read(spark: SparkSession, path: str) -> DataFrame:
    """Per page record: ``page_id, payload_bytes, payload_digest, record_type, refers_to``.

    A revisit takes the payload's length from the response that it refers to, whose digest must be its own.
    """
    found = read(spark, path)
    whole = responses(found).select("record_id", "page_id", "payload_bytes", "payload_digest")
    owners = whole.where(F.col("page_id").isNotNull()).dropDuplicates(["record_id"]).select(
        F.col("record_id").alias("owner"), F.col("page_id").alias("owner_page"), "payload_bytes", "payload_digest")
    again = found.where("type = 'revisit'").select("page_id", "refers_to", "digest")
    matched = again.join(owners, (F.col("refers_to") == F.col("owner")) & (F.col("digest") == F.col("payload_digest")), "left")
    none = F.lit(None).cast("long")
    return whole.select("page_id", "payload_bytes", "payload_digest", F.lit("response").alias("record_type"), none.alias("refers_to")).unionAll(
        matched.select("page_id", "payload_bytes", F.col("digest").alias("payload_digest"), F.lit("revisit"), F.col("owner_page")))
