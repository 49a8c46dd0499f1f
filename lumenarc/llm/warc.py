"""WARC archives: write captures with revisits for equal payloads, read archives back, assemble transactions.

A capture is three records: response (or revisit), request and metadata, the latter two tied to the first by
WARC-Concurrent-To. Writing is one pass of string expressions into Spark's text sink; record lengths are in the headers, so a payload
may hold any text, record separators too. Reading parses whole files, which the writer keeps small, by Content-Length.
"""

from __future__ import annotations

import base64
import gzip
import hashlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from lumenarc.llm._store import broadcast_below, cut, limit_batches

#: Uncompressed bytes that a file holds on average.
FILE_BYTES = 16 << 20
#: Payloads from which a capture has a file of its own.
LONG_BYTES = 4 << 20
#: Rows of payload groups that may be broadcast (about 60 bytes each).
BROADCAST_ROWS = 250_000
_END, _DATE = "\r\n", "2024-01-01T00:00:00Z"


def base32_digest(sha1_hex: Column) -> Column:
    """Upper-case base32 of a SHA-1 in hex: each five bytes are eight letters."""
    parts = [F.lpad(F.conv(F.substring(sha1_hex, 10 * k + 1, 10), 16, 32), 8, "0") for k in range(4)]
    return F.translate(F.concat(*parts), "0123456789ABCDEFGHIJKLMNOPQRSTUV", "ABCDEFGHIJKLMNOPQRSTUVWXYZ234567")


def percent_encoded(url: Column) -> Column:
    """White space and control characters as %XX; null as about:blank."""
    out = url
    for code in (*range(0x21), 0x7F):
        out = F.replace(out, F.lit(chr(code)), F.lit(f"%{code:02X}"))
    return F.coalesce(F.when(url.rlike(r"[\x00-\x20\x7F]"), out).otherwise(url), F.lit("about:blank"))


def _record_id(*parts: Column) -> Column:
    h = F.md5(F.concat_ws("|", *(F.coalesce(p.cast("string"), F.lit("-")) for p in parts)))
    return F.concat(F.lit("<urn:uuid:"), F.regexp_replace(h, r"^(.{8})(.{4})(.{4})(.{4})(.{12})$", "$1-$2-$3-$4-$5"), F.lit(">"))


def _record(headers: list[tuple[str, Column]], block: Column) -> Column:
    """A record without its closing line ends; headers that are null are left out."""
    lines = [F.coalesce(F.concat(F.lit(f"{k}: "), v, F.lit(_END)), F.lit("")) for k, v in headers]
    return F.concat(F.lit("WARC/1.1\r\n"), *lines, F.lit("Content-Length: "), F.octet_length(block).cast("string"), F.lit(_END + _END), block)


def write_captures(pages: DataFrame, path: str, id_col: str = "page_id", url_col: str = "url", html_col: str = "html", min_revisit_bytes: int = 0) -> None:
    """Write gzipped WARC files to ``path``, one capture per page; the payload is the html in UTF-8, null as empty.

    Of pages with equal payloads (SHA-1 and length) of at least ``min_revisit_bytes`` the one with the largest id is a response (a null id is the least; of rows that tie, one),
    the others revisit it. White space and control characters of urls are percent-encoded in headers; the metadata record has id and url as JSON. ``path`` must be new.
    A file is one gzip stream of Spark's text sink, so readers go through it in order; there is no member for each record to seek by.
    """
    html = F.coalesce(F.col(html_col).cast("string"), F.lit(""))
    read = pages.select(F.col(id_col).alias("id"), F.col(url_col).cast("string").alias("url"), html.alias("html"))
    keyed = read.withColumns({"sha": F.sha1(F.encode("html", "UTF-8")), "n": F.octet_length("html").cast("long")})
    whose = F.struct(F.col("id").isNotNull().alias("known"), "id")
    by_id = keyed.groupBy("sha", "n", "id").agg(F.count("*").alias("rows"))
    groups = by_id.groupBy("sha", "n").agg(F.sum("rows").alias("members"), F.max_by("rows", whose).alias("tied"), F.max(whose).alias("last"))
    groups = cut(groups.where((F.col("members") > 1) & (F.col("n") >= min_revisit_bytes)))
    short = F.col("n") <= LONG_BYTES
    total = keyed.agg(F.count("*").alias("rows"), F.sum(F.when(short, F.col("n"))).alias("bytes"), F.count_if(~short).alias("long")).first()
    per_file = max(1, int(FILE_BYTES // max(1, 1500 + (total["bytes"] or 0) / max(1, total["rows"]))))
    joined = keyed.join(broadcast_below(groups, groups.count(), BROADCAST_ROWS), ["sha", "n"], "left")
    leads = F.col("members").isNull() | F.col("id").eqNullSafe(F.col("last.id"))
    joined = joined.withColumns({"leads": leads, "salt": F.monotonically_increasing_id()})
    if groups.where("tied > 1").limit(1).count():
        tied = joined.where("members is not null and leads and tied > 1")
        first = F.row_number().over(Window.partitionBy("sha", "n").orderBy(F.asc_nulls_last("url"), "salt")) == 1
        joined = joined.where("not (members is not null and leads and tied > 1)").unionByName(tied.withColumn("leads", first))
    joined = joined.withColumns({
        "digest": F.concat(F.lit("sha1:"), base32_digest(F.col("sha"))),
        "uri": percent_encoded(F.col("url")),
        "shared": _record_id(F.lit("payload"), F.col("sha"), F.col("n")),
        "own": _record_id(F.lit("capture"), F.col("id"), F.col("url"), F.col("sha"), F.col("salt")),
    })
    record_id = F.when(F.col("members").isNotNull() & F.col("leads"), F.col("shared")).otherwise(F.col("own"))
    joined = joined.withColumn("record", record_id)
    http = F.concat(F.lit("HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: "), F.col("n").cast("string"), F.lit("\r\n\r\n"))
    date, revisits = ("WARC-Date", F.lit(_DATE)), ~F.col("leads")
    main = _record([
        ("WARC-Type", F.when(F.col("leads"), "response").otherwise("revisit")), ("WARC-Record-ID", F.col("record")), date, ("WARC-Target-URI", F.col("uri")),
        ("Content-Type", F.lit("application/http; msgtype=response")), ("WARC-Payload-Digest", F.col("digest")),
        ("WARC-Profile", F.when(revisits, "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest")), ("WARC-Refers-To", F.when(revisits, F.col("shared"))),
    ], F.when(F.col("leads"), F.concat(http, F.col("html"))).otherwise(http))
    request = _record([
        ("WARC-Type", F.lit("request")), ("WARC-Record-ID", _record_id(F.lit("request"), F.col("own"))), date, ("WARC-Target-URI", F.col("uri")),
        ("Content-Type", F.lit("application/http; msgtype=request")), ("WARC-Concurrent-To", F.col("record")),
    ], F.concat(F.lit("GET "), F.col("uri"), F.lit(" HTTP/1.1\r\n\r\n")))
    metadata = _record([
        ("WARC-Type", F.lit("metadata")), ("WARC-Record-ID", _record_id(F.lit("metadata"), F.col("own"))), date, ("WARC-Target-URI", F.col("uri")),
        ("Content-Type", F.lit("application/json")), ("WARC-Concurrent-To", F.col("record")),
    ], F.to_json(F.struct(F.col("id").alias("page_id"), F.col("url"))))
    gap = F.lit(_END + _END)
    value = F.concat(main, gap, request, gap, metadata).alias("value")

    def write(rows: DataFrame, records: int) -> None:
        rows.select(value).write.mode("append").option("lineSep", _END + _END).option("compression", "gzip").option("maxRecordsPerFile", records).text(path)

    if total["long"]:
        write(joined.where(~short), 1)
        joined = joined.where(short)
    write(joined, per_file)


RECORD = "record_id string, type string, concurrent_to string, refers_to string, uri string, digest string, payload_bytes long, payload_digest string, block string, payload binary"


def records(data: bytes) -> Iterator[tuple[dict[str, str], bytes]]:
    """Headers (names in lower case) and block of each record."""
    at = 0
    while at < len(data):
        if data[at : at + 5] != b"WARC/":
            raise ValueError(f"no WARC record at byte {at}")
        stop = data.index(b"\r\n\r\n", at)
        lines = data[at:stop].decode("utf-8").split("\r\n")[1:]
        headers = {k.strip().lower(): v.strip() for k, _, v in (line.partition(":") for line in lines)}
        size = int(headers["content-length"])
        yield headers, data[stop + 4 : stop + 4 + size]
        at = stop + 8 + size


def _reader(with_payload: bool):
    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = [f.split()[0] for f in RECORD.split(", ")]
        for batch in batches:
            for content in batch.column(0):  # files are a few MB, so a batch is what maxBytesPerBatch allows
                raw = content.as_py()
                rows: list[tuple] = []
                held = 0
                for headers, block in records(gzip.decompress(raw) if raw[:2] == b"\x1f\x8b" else raw):
                    kind = headers["warc-type"]
                    payload = block[block.index(b"\r\n\r\n") + 4 :] if kind == "response" else None
                    digest = base64.b32encode(hashlib.sha1(payload).digest()).decode() if payload is not None else None
                    text = None if kind in ("response", "revisit") else block.decode("utf-8")
                    rows.append((headers["warc-record-id"], kind, headers.get("warc-concurrent-to"), headers.get("warc-refers-to"), headers.get("warc-target-uri"),
                                 headers.get("warc-payload-digest"), None if payload is None else len(payload), digest, text, payload if with_payload else None))
                    held += len(block) if with_payload else 300
                    if held > 8 << 20:
                        yield _batch(rows, names)
                        rows, held = [], 0
                if rows:
                    yield _batch(rows, names)

    return read


def _batch(rows: list[tuple], names: list[str]) -> pa.RecordBatch:
    kinds = [pa.string()] * 6 + [pa.int64(), pa.string(), pa.string(), pa.binary()]
    return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows, strict=True), kinds, strict=True)], names)


def read_records(spark: SparkSession, path: str, with_payload: bool = True) -> DataFrame:
    """All records of the WARC files in ``path``, plain or gzipped. Payloads' lengths and digests are computed from the payloads."""
    limit_batches(spark)
    files = spark.read.format("binaryFile").load(path).select("content")
    return files.mapInArrow(_reader(with_payload), RECORD)


def assemble(found: DataFrame) -> DataFrame:
    """One nested row per capture: record_id, uri, request, response and metadata, joined through concurrent-to identifiers.

    A capture without request or metadata has null there; a revisit's response takes payload length and digest from the
    record it refers to. Archives without captures give no rows.
    """
    main = found.where("type in ('response', 'revisit')")
    side = lambda kind: found.where(F.col("type") == kind).select(
        F.col("concurrent_to").alias("record_id"), F.struct("record_id", "block").alias(kind))
    original = found.where("type = 'response'").select(F.col("record_id").alias("refers_to"), F.struct("payload_bytes", "payload_digest").alias("original"))
    joined = main.join(original, "refers_to", "left").join(side("request"), "record_id", "left").join(side("metadata"), "record_id", "left")
    response = F.struct(
        "type", "refers_to", "digest", F.coalesce("payload_bytes", "original.payload_bytes").alias("payload_bytes"),
        F.coalesce("payload_digest", "original.payload_digest").alias("payload_digest"), "payload")
    return joined.select("record_id", "uri", "request", response.alias("response"), "metadata")


def captures_by_page(captures: DataFrame) -> DataFrame:
    """page_id, url, record_type, payload_bytes, payload_digest and refers_to (the response's page_id) of assembled captures.

    page_id is read as a long; a capture without metadata has null page_id and url. Repeated pages have a row each; no captures give no rows.
    """
    told = F.from_json(F.col("metadata.block"), "page_id long, url string")
    page = captures.select("record_id", told.alias("told"), "response.type", "response.refers_to", "response.payload_bytes", "response.payload_digest")
    page = cut(page.select("record_id", F.col("told.page_id").alias("page_id"), F.col("told.url").alias("url"), F.col("type").alias("record_type"), F.col("refers_to").alias("target"), "payload_bytes", "payload_digest"))
    lead = page.where("record_type = 'response'").select(F.col("record_id").alias("target"), F.col("page_id").alias("refers_to"))
    return page.join(lead, "target", "left").select("page_id", "url", "payload_bytes", "payload_digest", "record_type", "refers_to")
