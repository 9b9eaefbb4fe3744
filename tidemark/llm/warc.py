"""WARC archives: written as text records by Spark, read back by content length, assembled to captures.

Each page gives three records: a request, a metadata record, and a response (or, for a payload that another
record already holds in full, a revisit). Request and metadata point at the response or revisit by
WARC-Concurrent-To. The reader cuts the archives into records; assembly groups them by the identifier that
they share into one nested row per capture.
"""

from __future__ import annotations

import base64
import hashlib
import zlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
END = "\r\n\r\n"
RECORD = "type string, record_id string, concurrent_to string, refers_to string, uri string, date string, digest string, length long, payload string, fields map<string,string>"
PIECE = 1 << 20


def base32_sha1(payload: Column) -> Column:
    """Bare upper-case base32 of SHA-1: eight digits for each forty bits."""
    hexed = F.sha1(payload)
    parts = [F.lpad(F.conv(F.substring(hexed, 1 + 10 * i, 10), 16, 32), 8, "0") for i in range(4)]
    return F.translate(F.concat(*parts), "0123456789ABCDEFGHIJKLMNOPQRSTUV", "ABCDEFGHIJKLMNOPQRSTUVWXYZ234567")


def _record(kind: str, record_id: Column, block: Column, *fields: tuple[str, Column]) -> Column:
    head = [F.lit(f"WARC/1.1\r\nWARC-Type: {kind}\r\nWARC-Record-ID: <"), record_id, F.lit(">\r\n")]
    for name, value in fields:
        head += [F.coalesce(F.concat(F.lit(f"{name}: "), value, F.lit("\r\n")), F.lit(""))]
    return F.concat(*head, F.lit("Content-Length: "), F.octet_length(block).cast("string"), F.lit(END), block)


def with_roles(pages: DataFrame, id_col: str, url_col: str, payload: Column, min_bytes: int) -> DataFrame:
    """pages with payload, digest, bytes, refers_to: the largest id among rows with an equal payload of at
    least min_bytes, null for that row itself, and whether the row is the one that is referred to. Rows that share the largest id are all
    responses, the one of the largest url is referred to; null ids revisit the largest one that isn't null, and are responses where all are null.

    Only the largest id of each digest is gathered, combined before the shuffle, so a payload that a third
    of the pages share is no large group.
    """
    rows = pages.withColumn("__tm_payload", payload).withColumn("__tm_digest", base32_sha1(F.col("__tm_payload").cast("binary"))).withColumn("__tm_bytes", F.octet_length("__tm_payload").cast("long"))
    each = rows.where(F.col("__tm_bytes") >= min_bytes).groupBy("__tm_digest", id_col, url_col).agg(F.count("*").alias("n"))
    largest = each.groupBy("__tm_digest").agg(F.max(F.struct(id_col, url_col, "n")).alias("__tm_best"), F.sum("n").alias("n")).where("n > 1").drop("n")
    joined = rows.join(largest, "__tm_digest", "left")
    first, its_url = F.col("__tm_best").getField(id_col), F.col("__tm_best").getField(url_col)
    referred = F.col(id_col).eqNullSafe(first) & F.col(url_col).eqNullSafe(its_url) & (F.col("__tm_best.n") == 1)
    return joined.withColumns({"__tm_refers": F.when(~F.col(id_col).eqNullSafe(first), first).cast("long"), "__tm_alone": F.col("__tm_best").isNull() | referred})


def write_archive(pages: DataFrame, path: str, id_col: str = "page_id", url_col: str = "url", html_col: str = "html", min_bytes: int = 0, records_per_file: int = 6_000, bytes_per_file: int = 1 << 30) -> None:
    """Writes the records of all pages as gzipped WARC files of at most records_per_file pages, and of fewer where the longest page
    times their number would pass bytes_per_file (each file is one gzip stream, and is read back as one row). A null html is an empty
    payload, a null url an empty address. Control characters in addresses are percent-coded, as a header line can't hold them.

    A record's id is made of the page's id and the payload's digest, and WARC-Refers-To names that of the response. Rows equal in
    id, url and payload are captures of their own: their ids also hold a serial number, so revisits of such a page name an id
    without it.
    """
    longest = pages.agg(F.max(F.octet_length(html_col)).alias("n")).first().n or 0
    records_per_file = max(1, min(records_per_file, bytes_per_file // (longest + 4_096)))
    payload = F.coalesce(F.col(html_col), F.lit(""))
    rows = with_roles(pages.select(id_col, url_col, html_col), id_col, url_col, payload, min_bytes)
    capture = F.concat(F.lit("urn:capture:"), F.coalesce(F.col(id_col).cast("string"), F.lit("null")))
    serial = F.when(F.col("__tm_alone"), F.lit("")).otherwise(F.concat(F.lit(":"), F.monotonically_increasing_id().cast("string")))  # equal ids stay apart
    uri = F.regexp_replace(F.coalesce(F.col(url_col), F.lit("")), r"[\x00-\x20\x7F]", "%20")
    date, digest = F.lit("2024-01-01T00:00:00Z"), F.concat(F.lit("sha1:"), F.col("__tm_digest"))
    is_revisit = F.col("__tm_refers").isNotNull()
    http = F.concat(F.lit("HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: "), F.col("__tm_bytes").cast("string"), F.lit(END))
    rows = rows.withColumn("__tm_cap", F.concat(capture, F.lit(":"), F.col("__tm_digest"), serial))
    main_id = F.concat(F.col("__tm_cap"), F.when(is_revisit, F.lit(":revisit")).otherwise(F.lit(":response")))
    common = [("WARC-Target-URI", uri), ("WARC-Date", date)]
    link = ("WARC-Concurrent-To", F.concat(F.lit("<"), main_id, F.lit(">")))
    response = _record("response", main_id, F.concat(http, F.col("__tm_payload")), *common, ("WARC-Payload-Digest", digest), ("Content-Type", F.lit("application/http; msgtype=response")))
    refers = F.concat(F.lit("<urn:capture:"), F.col("__tm_refers").cast("string"), F.lit(":"), F.col("__tm_digest"), F.lit(":response>"))
    revisit = _record("revisit", main_id, http, *common, ("WARC-Payload-Digest", digest), ("WARC-Refers-To", refers), ("WARC-Profile", F.lit(PROFILE)), ("Content-Type", F.lit("application/http; msgtype=response")))
    get = F.concat(F.lit("GET "), uri, F.lit(" HTTP/1.1"), F.lit(END))
    request = _record("request", F.concat(F.col("__tm_cap"), F.lit(":request")), get, *common, link, ("Content-Type", F.lit("application/http; msgtype=request")))
    meta = _record("metadata", F.concat(F.col("__tm_cap"), F.lit(":metadata")), F.concat(F.lit("payload-bytes: "), F.col("__tm_bytes").cast("string"), F.lit("\r\n")), *common, link, ("Content-Type", F.lit("application/warc-fields")))
    whole = F.concat(request, F.lit(END), F.when(is_revisit, revisit).otherwise(response), F.lit(END), meta)
    rows.select(whole.alias("value")).write.option("lineSep", END).option("compression", "gzip").option("maxRecordsPerFile", records_per_file).text(path)


class _Pieces:
    """Reads a possibly gzipped buffer piece by piece, so that an archive is never unpacked whole."""

    def __init__(self, raw: bytes):
        self.raw, self.at, self.have = memoryview(raw), 0, bytearray()
        self.unzip = zlib.decompressobj(31) if raw[:2] == b"\x1f\x8b" else None

    def more(self) -> bool:
        if self.at >= len(self.raw):
            return False
        piece = self.raw[self.at : self.at + PIECE]
        self.at += len(piece)
        while len(piece):
            if self.unzip is None:
                self.have += piece
                break
            self.have += self.unzip.decompress(piece)
            piece = self.unzip.unused_data
            if piece:
                self.unzip = zlib.decompressobj(31)
        return True

    def until(self, mark: bytes) -> bytes | None:
        start = 0
        while (i := self.have.find(mark, start)) < 0:
            start = max(0, len(self.have) - len(mark))
            if not self.more():
                return None
        out = bytes(self.have[:i])
        del self.have[: i + len(mark)]
        return out

    def take(self, n: int) -> bytes:
        while len(self.have) < n and self.more():
            pass
        out = bytes(self.have[:n])
        del self.have[:n]
        return out


def parse(raw: bytes) -> Iterator[tuple[dict[str, str], bytes]]:
    """(header fields, block) of each record."""
    source = _Pieces(raw)
    while (head := source.until(b"\r\n\r\n")) is not None:
        lines = head.decode("utf-8", "replace").lstrip("\r\n").split("\r\n")
        if not lines[0].startswith("WARC/"):
            continue
        fields = dict(line.split(": ", 1) if ": " in line else (line.rstrip(":"), "") for line in lines[1:])
        yield fields, source.take(int(fields["Content-Length"]))


def read_archive(spark: SparkSession, path: str, payloads: bool = True) -> DataFrame:
    """One row per record (RECORD). Payloads are cut from their HTTP message; digest is computed from the
    payload read, or taken from the record where it holds none (revisits). payloads=False leaves them out
    after their digest is taken. Archives are read as whole files, so keep files small, as the writer does."""

    def bare(x: str | None) -> str | None:
        return x.strip("<>") if x else None

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kind = pa.schema([("type", pa.string()), ("record_id", pa.string()), ("concurrent_to", pa.string()), ("refers_to", pa.string()), ("uri", pa.string()), ("date", pa.string()), ("digest", pa.string()), ("length", pa.int64()), ("payload", pa.string()), ("fields", pa.map_(pa.string(), pa.string()))])
        for b in batches:
            for raw in b.column(0):
                rows, held = [], 0
                for f, block in parse(raw.as_buffer().to_pybytes()):
                    what, digest, length, payload = f.get("WARC-Type"), f.get("WARC-Payload-Digest"), None, None
                    if what in ("response", "revisit"):
                        http, _, body = block.partition(b"\r\n\r\n")
                        length = len(body)
                        if what == "revisit":
                            length = next((int(x.split(b":")[1]) for x in http.split(b"\r\n") if x.lower().startswith(b"content-length:")), None)
                        else:
                            digest, payload = "sha1:" + base64.b32encode(hashlib.sha1(body).digest()).decode(), body.decode("utf-8", "replace") if payloads else None
                    elif what == "metadata":
                        payload = block.decode("utf-8", "replace")
                    rows.append((what, bare(f.get("WARC-Record-ID")), bare(f.get("WARC-Concurrent-To")), bare(f.get("WARC-Refers-To")), f.get("WARC-Target-URI"), f.get("WARC-Date"), digest.removeprefix("sha1:") if digest else None, length, payload, list(f.items()) if payloads else None))
                    held += len(payload or "")
                    if len(rows) >= 2_000 or held > PIECE:
                        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), kind.types)], schema=kind)
                        rows, held = [], 0
                if rows:
                    yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), kind.types)], schema=kind)

    return spark.read.format("binaryFile").load(path).select("content").mapInArrow(run, RECORD)


def assemble(records: DataFrame) -> DataFrame:
    """(capture_id, main, request, metadata): one row per response or revisit, with the records that are
    concurrent to it. Of several requests (or metadata records) of one capture the one with the largest
    record id is shown; records that point at a missing response give a row with a null main."""
    row = F.struct("record_id", "type", "refers_to", "uri", "date", "digest", "length", "payload")
    pick = lambda *kinds: F.max(F.when(F.col("type").isin(*kinds), row))
    return (
        records.where(F.col("type").isin("request", "response", "revisit", "metadata")).groupBy(F.coalesce("concurrent_to", "record_id").alias("capture_id"))
        .agg(pick("response", "revisit").alias("main"), pick("request").alias("request"), pick("metadata").alias("metadata"))
    )
