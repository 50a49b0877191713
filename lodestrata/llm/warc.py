"""WARC archives: segmented, chunked records written by Spark, read back and put together.

A record is at most ``segment`` bytes of block; longer ones go on in
continuation records that name the first one's identifier, a segment number and,
in the last, the total length. The payload has chunked transfer framing. Equal
payloads are stored once; the others are revisit records.
"""

from __future__ import annotations

import hashlib
import json
import re
import zlib
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..scratch import shared_path, stored
from .memory import giving_back

EOL = b"\r\n"
CHUNK = 8192
RECORD = "page_id long, payload_bytes long, payload_digest string, record_type string, refers_to long, url string, payload binary"


def _record(headers: list[tuple[str, object]], block: bytes) -> bytes:
    head = "".join(f"{k}: {v}\r\n" for k, v in [*headers, ("Content-Length", len(block))] if v is not None)
    return b"WARC/1.1\r\n" + head.encode() + EOL + block


def _chunked(payload: bytes) -> bytes:
    parts = [b"%x\r\n%b\r\n" % (len(c), c) for c in (payload[i : i + CHUNK] for i in range(0, len(payload), CHUNK))]
    return b"".join(parts) + b"0\r\n\r\n"


def _dechunked(body: bytes) -> bytes:
    out, at = [], 0
    while True:
        end = body.index(EOL, at)
        size = int(body[at:end].split(b";")[0], 16)
        if not size:
            return b"".join(out)
        chunk = body[end + 2 : end + 2 + size]
        if len(chunk) != size or body[end + 2 + size : end + 4 + size] != EOL:
            raise ValueError("a chunk is cut short")
        out.append(chunk)
        at = end + 4 + size


def _written(page_id, row, url, payload: bytes, digest: str, refers_to, segment: int, date: str) -> Iterator[bytes]:
    """The records of one page."""
    own = f"<urn:page:{page_id}:{row}>"
    common = [("WARC-Date", date), ("WARC-Target-URI", re.sub(r"[\x00-\x20\x7f]", lambda m: f"%{ord(m[0]):02X}", url) or None)]
    http = "HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\n"
    named = [("WARC-Record-ID", own), *common, ("WARC-Payload-Digest", f"sha1:{digest}"), ("Content-Type", "application/http;msgtype=response")]
    if refers_to is not None:
        block = f"{http}Content-Length: {len(payload)}\r\n\r\n".encode()
        profile = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
        yield _record([("WARC-Type", "revisit"), *named, ("WARC-Refers-To", f"<urn:page:{refers_to}>"), ("WARC-Profile", profile)], block)
        return
    block = f"{http}Transfer-Encoding: chunked\r\n\r\n".encode() + _chunked(payload)
    cuts = range(0, len(block), segment)
    yield _record([("WARC-Type", "response"), *named, ("WARC-Segment-Number", 1 if len(cuts) > 1 else None)], block[:segment])
    for n, at in enumerate(cuts[1:], 2):
        last = len(block) if n == len(cuts) else None
        ids = [("WARC-Record-ID", f"<urn:page:{page_id}:{row}:{n}>"), ("WARC-Segment-Origin-ID", own), ("WARC-Segment-Number", n), ("WARC-Segment-Total-Length", last)]
        yield _record([("WARC-Type", "continuation"), *ids, *common], block[at : at + segment])


def write_archives(
    pages: DataFrame, min_bytes: int = 1000, segment: int = 16_384, records_per_file: int = 2000, date: str = "2020-01-01T00:00:00Z"
) -> str:
    """Writes (page_id, url, html) as gzipped WARC files; returns their folder.

    Of equal payloads of at least ``min_bytes`` bytes, the row with the largest
    page_id is the response (nulls only if all are null; one of the rows that repeat it,
    the others revisit it). A null html
    is an empty payload, a null url has no target header. An archive holds at most
    ``records_per_file`` records of ``segment`` bytes and their headers.
    """
    # Written once: a row's number must be the same where marks are made and where they are joined.
    rows = pages.select(
        pages["page_id"].cast("long").alias("page_id"),
        F.coalesce(pages["url"], F.lit("")).alias("url"),
        F.encode(F.coalesce(pages["html"], F.lit("")), "UTF-8").alias("payload"),
        F.monotonically_increasing_id().alias("row"),
    )
    rows = stored(rows.withColumn("digest", F.sha1("payload")), "warc-rows")
    # Marks are made on narrow rows; payloads are dealt once, by the row, so a large group of copies stays spread.
    narrow = rows.where(F.octet_length("payload") >= min_bytes).select("page_id", "row", "digest")
    kept = narrow.groupBy("digest").agg(F.max(F.struct("page_id", "row")).alias("kept"))
    revisits = narrow.join(kept, "digest").where("row <> kept.row").select(F.col("row").alias("revisit"), F.coalesce(F.col("kept.page_id").cast("string"), F.lit("None")).alias("refers_to"))
    marked = rows.join(revisits, F.col("row") == F.col("revisit"), "left").select("page_id", "row", "url", "payload", "digest", "refers_to")

    def records(batches):
        for b in batches:
            out = []
            for page_id, row, url, payload, digest, refers_to in zip(b["page_id"], b["row"], b["url"], b["payload"], b["digest"], b["refers_to"], strict=True):
                page_id = None if pd.isna(page_id) else int(page_id)
                out += _written(page_id, row, url, payload, digest, refers_to, segment, date)
            yield pd.DataFrame({"record": out})

    path = shared_path(pages.sparkSession, "warc")
    written = marked.mapInPandas(giving_back(records), "record binary").select(F.col("record").cast("string"))
    # A record ends with two line ends, which is what the text writer puts after each row.
    written.write.option("lineSep", "\r\n\r\n").option("compression", "gzip").option("maxRecordsPerFile", records_per_file).text(path)
    return path


def _parsed(data: bytes) -> Iterator[tuple[dict[str, str], bytes]]:
    """Headers and block of each record of an archive."""
    at = 0
    while at < len(data):
        end = data.index(b"\r\n\r\n", at)
        version, *lines = data[at:end].decode().split("\r\n")
        if not version.startswith("WARC/"):
            raise ValueError(f"no record at byte {at}")
        headers = {k.strip().lower(): v.strip() for k, _, v in (x.partition(":") for x in lines)}
        start = end + 4
        stop = start + int(headers["content-length"])
        if data[stop : stop + 4] != b"\r\n\r\n":
            raise ValueError(f"the record at byte {at} is cut short")
        yield headers, data[start:stop]
        at = stop + 4


def _gunzipped(data: bytes) -> bytes:
    """All members of a gzip file; other data as it is."""
    if data[:2] != b"\x1f\x8b":
        return data
    out = []
    while data:
        member = zlib.decompressobj(31)
        out.append(member.decompress(data))
        data = member.unused_data
    return b"".join(out)


def _number(record_id: str) -> int | None:
    value = record_id.strip("<>").split(":")[2]
    return None if value == "None" else int(value)


def _decoded(headers: dict[str, str], block: bytes, keep: bool) -> tuple:
    """A row of RECORD from a whole record."""
    head, _, body = block.partition(b"\r\n\r\n")
    fields = {k.strip().lower(): v.strip() for k, _, v in (x.partition(":") for x in head.decode().split("\r\n")[1:])}
    stated = headers["warc-payload-digest"].partition(":")[2]
    page_id, url = _number(headers["warc-record-id"]), headers.get("warc-target-uri")
    if headers["warc-type"] == "revisit":
        return page_id, int(fields["content-length"]), stated, "revisit", _number(headers["warc-refers-to"]), url, None
    payload = _dechunked(body) if fields.get("transfer-encoding") == "chunked" else body
    digest = hashlib.sha1(payload).hexdigest()
    if digest != stated:
        raise ValueError(f"the payload of {headers['warc-record-id']} has another digest")
    return page_id, len(payload), digest, "response", None, url, payload if keep else None


def _rows(rows: list[tuple]) -> pd.DataFrame:
    out = pd.DataFrame(rows, columns=["page_id", "payload_bytes", "payload_digest", "record_type", "refers_to", "url", "payload"])
    return out.astype({"page_id": "Int64", "refers_to": "Int64", "payload_bytes": "Int64"})


def read_archives(spark: SparkSession, path: str, keep_payload: bool = True) -> DataFrame:
    """One row per page of a folder of WARC files, columns as in RECORD.

    Segments may lie in any archive. They are grouped by the first one's
    identifier and ordered by number; a gap, a repeated number or a wrong total
    length raises an error. Whole records never leave the task that read them.
    Archives are read whole, so they must be small (see ``write_archives``).
    """
    part = "origin string, number int, total long, headers string, block binary"

    def parse(batches):
        for content in (c for b in batches for c in b["content"]):  # one archive at a time
            whole, parts = [], []
            for headers, block in _parsed(_gunzipped(content)):
                number = headers.get("warc-segment-number")
                if number is None:
                    whole.append(_decoded(headers, block, keep_payload))
                else:
                    origin = headers.get("warc-segment-origin-id", headers["warc-record-id"])
                    total = headers.get("warc-segment-total-length")
                    parts.append((origin, int(number), total and int(total), json.dumps(headers) if number == "1" else None, block))
            segments = pd.DataFrame(parts, columns=["origin", "number", "total", "headers", "block"])
            yield pd.concat([_rows(whole), segments.astype({"number": "Int32", "total": "Int64"})])

    def reassemble(batches):
        for b in batches:
            out = []
            for origin, segments in zip(b["origin"], b["segments"], strict=True):
                if [s["number"] for s in segments] != list(range(1, len(segments) + 1)):
                    raise ValueError(f"segments of {origin} are missing or repeated")
                block = b"".join(s["block"] for s in segments)
                if segments[-1]["total"] is None or int(segments[-1]["total"]) != len(block):
                    raise ValueError(f"the segments of {origin} have a wrong total length")
                out.append(_decoded(json.loads(segments[0]["headers"]), block, keep_payload))
            yield _rows(out)

    files = spark.read.format("binaryFile").load(path).select("content")
    read = stored(files.mapInPandas(giving_back(parse), f"{RECORD}, {part}"), "warc-read")
    segments = (
        read.where("origin is not null")
        .groupBy("origin")
        .agg(F.array_sort(F.collect_list(F.struct("number", "total", "headers", "block"))).alias("segments"))
        .mapInPandas(reassemble, RECORD)
    )
    return read.where("origin is null").select(*segments.columns).unionByName(segments)


def op9_warc_segments(spark, sf_dir: str) -> DataFrame:
    """What the archives of all pages say of each page."""
    path = write_archives(spark.read.parquet(f"{sf_dir}/pages.parquet"))
    return read_archives(spark, path, keep_payload=False).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


OP9_SQL = """
WITH p AS (
  SELECT page_id, octet_length(encode(coalesce(html, '')))::BIGINT AS payload_bytes, sha1(coalesce(html, '')) AS payload_digest FROM pages),
k AS (SELECT *, max(page_id) OVER (PARTITION BY payload_digest) AS kept,
             payload_bytes < 1000 OR row_number() OVER (PARTITION BY payload_digest ORDER BY page_id DESC NULLS LAST) = 1 AS first FROM p)
SELECT page_id, payload_bytes, payload_digest, CASE WHEN first THEN 'response' ELSE 'revisit' END AS record_type, CASE WHEN NOT first THEN kept END AS refers_to
FROM k
"""
