"""WARC archives: writing captures, and assembling them from records.

``write`` makes three records of every page row: a request, a response (or a
revisit, where an earlier page has the same payload) and a metadata record
with the page's id; request and metadata name the response's record id in
``WARC-Concurrent-To``. Records are made by column expressions and written
through Spark's text writer, whose commit keeps a lost task's files out, as
gzip files of up to ``RECORDS`` records.

``read`` takes archives back: a gzip file is read by one task as a stream of
lines, from which records are cut by ``Content-Length``; a payload may hold
anything, also text that looks like a record. ``captures`` assembles the
transactions: requests and metadata are joined to their response through the
concurrent-to identifiers, whatever file they are in, and revisits to the
response they refer to. One nested row per capture comes out.

Equal payloads are found by their SHA-1: rows are reduced to (digest, size,
id, url) and counted before the shuffle, so a payload that a third of the
pages share is a few rows a task; its page text goes to the archive once.

Defined results: a null html is an empty payload; a null url gives records
without a target; a null page id counts as larger than all others, and comes
back as null. Repeated rows are one record each; of equal smallest ids the
response is that of the smallest url, the rest revisit it. Spaces, control
and non-ASCII characters of a url are percent-encoded in ``uri``. An empty
table gives an archive without records. Of several requests or metadata records
of one capture the one with the least record id is taken, and all are counted.
An archive that ends inside a record raises an error. Columns are taken by
name; others are not read."""

from __future__ import annotations

import base64
import hashlib
import re
import uuid
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from lagscope.llm.common import settle
from lagscope.session import checkpoint_dir

#: Records of a file, at most.
RECORDS = 30_000
#: Date of the records, as pages have none.
DATE = "2024-01-01T00:00:00Z"
_PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
_CRLF = "\r\n"
_HEX32, _BASE32 = "0123456789ABCDEFGHIJKLMNOPQRSTUV", "ABCDEFGHIJKLMNOPQRSTUVWXYZ234567"


def base32_sha1(data: Column) -> Column:
    """SHA-1 in upper-case base32: four digits from every five hex digits."""
    digits = [F.lpad(F.conv(F.substring(F.sha1(data), 5 * i + 1, 5), 16, 32), 4, "0") for i in range(8)]
    return F.translate(F.concat(*digits), _HEX32, _BASE32)


def _uuid(*parts: Column) -> Column:
    """A record id that the parts decide."""
    h = F.md5(F.to_json(F.array(*[F.coalesce(p.cast("string"), F.lit("\0")) for p in parts])))
    at = [(1, 8), (9, 4), (13, 4), (17, 4), (21, 12)]
    return F.concat(F.lit("<urn:uuid:"), F.concat_ws("-", *[F.substring(h, a, n) for a, n in at]), F.lit(">"))


def _uri(url: Column) -> Column:
    """The url without characters that a header line cannot hold."""
    odd = F.expr("transform(split(_url, ''), c -> if(c rlike '^[\\\\x21-\\\\x7E]?\\\\z', c, "
                 "regexp_replace(hex(c), '(..)', '%$1')))")
    return F.when(url.rlike(r"^[\x21-\x7E]*\z"), url).otherwise(F.array_join(odd, ""))


def _record(kind: Column, headers: list[tuple[str, Column]], block: Column) -> Column:
    """A whole record but for the two line breaks that end it. Headers whose
    value is null are left out."""
    lines = [F.lit("WARC/1.1"), F.concat(F.lit("WARC-Type: "), kind)]
    lines += [F.concat(F.lit(f"{name}: "), value) for name, value in headers]
    lines += [F.concat(F.lit("Content-Length: "), F.octet_length(block).cast("string"))]
    return F.concat(F.concat_ws(_CRLF, *lines), F.lit(_CRLF * 2), block)


def _pages(pages: DataFrame, page_id: str, url: str, html: str) -> DataFrame:
    payload = F.coalesce(F.col(html).cast("string"), F.lit(""))
    return pages.select(F.col(page_id).cast("bigint").alias("page_id"), F.col(url).cast("string").alias("url"),
                        payload.alias("html"), base32_sha1(payload.cast("binary")).alias("digest"))


def records(pages: DataFrame, page_id: str = "page_id", url: str = "url", html: str = "html") -> DataFrame:
    """``(record)``: the archive's records as text, in no order."""
    rows = _pages(pages, page_id, url, html)
    order = F.struct(F.col("page_id").isNull().alias("none"), "page_id", F.col("url").isNotNull().alias("some"), "url")
    # the payload goes with its first page alone
    first = rows.groupBy("digest").agg(F.min(order).alias("first"), F.min("html").alias("html"))
    again = (rows.groupBy("digest", "page_id", "url").agg(F.count("*").alias("times"))
             .withColumn("n", F.explode(F.sequence(F.lit(1).cast("bigint"), F.col("times"))))
             .select("digest", "page_id", "url", "n"))
    least = rows.groupBy("digest").agg(F.min(order).alias("first"))
    responses = first.select("digest", "first.page_id", "first.url", F.lit(1).cast("bigint").alias("n"), "html",
                             F.lit(None).cast("string").alias("refers_to"), F.lit(None).cast("string").alias("refers_url"))
    revisits = (again.join(least, "digest")
                .where(~(F.col("page_id").eqNullSafe(F.col("first.page_id"))
                         & F.col("url").eqNullSafe(F.col("first.url")) & (F.col("n") == 1)))
                .select("digest", "page_id", "url", "n", F.lit("").alias("html"),
                        _uuid(F.lit("response"), F.col("first.page_id"), F.col("first.url"), F.lit(1), F.col("digest"))
                        .alias("refers_to"), F.col("first.url").alias("refers_url")))
    made = responses.union(revisits)
    key = [F.col("page_id"), F.col("url"), F.col("n"), F.col("digest")]
    response, date = _uuid(F.lit("response"), *key), F.lit(DATE)
    is_response = F.col("refers_to").isNull()
    made = made.select("*", F.col("url").alias("_url")).withColumn("uri", _uri(F.col("url")))
    made = made.withColumn("_url", F.col("refers_url")).withColumn("refers_uri", _uri(F.col("refers_url")))
    host = F.regexp_extract("uri", r"^[A-Za-z][A-Za-z0-9+.-]*://([^/?#]*)", 1)
    path = F.regexp_extract("uri", r"^[A-Za-z][A-Za-z0-9+.-]*://[^/?#]*([^#]*)", 1)
    http = F.concat(F.lit(f"HTTP/1.1 200 OK{_CRLF}Content-Type: text/html; charset=utf-8{_CRLF * 2}"), F.col("html"))
    asked = F.concat(F.lit("GET "), F.when(path.startswith("/"), path).otherwise(F.concat(F.lit("/"), path)),
                     F.lit(f" HTTP/1.1{_CRLF}Host: "), host, F.lit(_CRLF * 2))
    fields = F.concat(F.lit("page-id: "), F.coalesce(F.col("page_id").cast("string"), F.lit("")), F.lit(_CRLF))
    target = ("WARC-Target-URI", F.col("uri"))
    return made.select(F.explode(F.array(
        _record(F.lit("request"), [
            ("WARC-Record-ID", _uuid(F.lit("request"), *key)), ("WARC-Date", date), target,
            ("WARC-Concurrent-To", response), ("Content-Type", F.lit("application/http; msgtype=request"))],
            F.coalesce(asked, F.lit(f"GET / HTTP/1.1{_CRLF * 2}"))),
        _record(F.when(is_response, "response").otherwise("revisit"), [
            ("WARC-Record-ID", response), ("WARC-Date", date), target,
            ("WARC-Payload-Digest", F.concat(F.lit("sha1:"), "digest")),
            ("WARC-Profile", F.when(~is_response, _PROFILE)), ("WARC-Refers-To", F.col("refers_to")),
            ("WARC-Refers-To-Target-URI", F.col("refers_uri")),
            ("WARC-Refers-To-Date", F.when(~is_response, date)),
            ("Content-Type", F.lit("application/http; msgtype=response"))], http),
        _record(F.lit("metadata"), [
            ("WARC-Record-ID", _uuid(F.lit("metadata"), *key)), ("WARC-Date", date), target,
            ("WARC-Concurrent-To", response), ("Content-Type", F.lit("application/warc-fields"))],
            fields))).alias("record"))


def write(pages: DataFrame, path: str, **names: str) -> None:
    """Writes the archive of ``pages`` as gzip files into the folder ``path``."""
    (records(pages, **names).write.option("lineSep", _CRLF * 2).option("maxRecordsPerFile", RECORDS)
     .text(path, compression="gzip"))


_HEADER = re.compile(rb"([^:\s]+):[ \t]*(.*?)[ \t]*\r?\n")
_SPAN = re.compile(rb"content-length:[ \t]*(\d+)", re.I)


class _Records:
    """Cuts a stream of lines into (headers, block)."""

    def __init__(self):
        self.head, self.block, self.left = [], [], -1

    def ended(self) -> bool:
        return self.left < 0 and not any(x.strip() for x in self.head)

    def line(self, data: bytes) -> tuple[dict[str, bytes], bytes] | None:
        if self.left < 0:  # among the headers
            if not self.head and not data.strip():
                return None
            if not self.head and not data.startswith(b"WARC/"):
                raise ValueError(f"no record begins with {data[:40]!r}")
            self.head.append(data)
            if data.strip():
                return None
            found = [m for x in self.head if (m := _SPAN.match(x))]
            if not found:
                raise ValueError("a record without Content-Length")
            self.left = int(found[0][1])
            if self.left:
                return None
        else:
            self.block.append(data[:self.left])
            self.left -= len(data)
            if self.left > 0:
                return None
        headers: dict[str, bytes] = {}
        for x in self.head[1:]:
            if m := _HEADER.match(x):
                headers.setdefault(m[1].decode("ascii", "replace").lower(), m[2])
        out = headers, b"".join(self.block)
        self.head, self.block, self.left = [], [], -1
        return out


_COLUMNS = ("warc_type", "record_id", "date", "uri", "concurrent_to", "refers_to", "declared_digest", "content_type",
            "payload_bytes", "payload_digest", "page_id", "payload")
_HEADERS = ("warc-type", "warc-record-id", "warc-date", "warc-target-uri", "warc-concurrent-to", "warc-refers-to",
            "warc-payload-digest", "content-type")
_SCHEMA = ", ".join(f"{c} {'bigint' if c in ('payload_bytes', 'page_id') else 'binary' if c == 'payload' else 'string'}"
                    for c in _COLUMNS)


def _row(headers: dict[str, bytes], block: bytes, keep: bool) -> tuple:
    texts = [headers[h].decode("utf-8", "replace") if h in headers else None for h in _HEADERS]
    payload, page = block, None
    if (texts[7] or "").startswith("application/http"):
        payload = block.partition(b"\r\n\r\n")[2]
    elif texts[0] == "metadata":
        if m := re.search(rb"^page-id: (-?\d+)\r?$", block, re.M):
            page = int(m[1])
    return (*texts, len(payload), base64.b32encode(hashlib.sha1(payload).digest()).decode(), page,
            payload if keep and texts[0] in ("response", "request") else None)


def read(spark: SparkSession, path: str, payload: bool = True) -> DataFrame:
    """One row per record of the gzip archives in ``path``; without
    ``payload`` the page texts are only measured."""
    lines = (spark.read.schema("value string").option("lineSep", "\n").text(path)
             .select(F.col("_metadata.file_path").alias("file"), F.col("value").cast("binary").alias("line")))
    kinds = [pa.int64() if c in ("payload_bytes", "page_id") else pa.binary() if c == "payload" else pa.string()
             for c in _COLUMNS]
    schema = pa.schema(list(zip(_COLUMNS, kinds)))

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        file, stream = None, _Records()
        for b in batches:
            out = []
            for at, line in zip(b.column("file").to_pylist(), b.column("line")):
                if at != file:
                    if not stream.ended():
                        raise ValueError(f"{file} ends inside a record")
                    file, stream = at, _Records()
                try:
                    if found := stream.line(line.as_py() + b"\n"):
                        out.append(_row(*found, payload))
                except ValueError as e:
                    raise ValueError(f"{file}: {e}") from None
            yield pa.record_batch([pa.array(c, t) for c, t in zip(zip(*out), kinds)] if out
                                  else [pa.array([], t) for t in kinds], schema)
        if not stream.ended():
            raise ValueError(f"{file} ends inside a record")

    return lines.mapInArrow(cut, _SCHEMA)


def captures(archive: DataFrame) -> DataFrame:
    """One row per response or revisit of ``read``: ``(record_id, record_type,
    uri, date, page_id, payload_bytes, payload_digest, refers_to, response,
    request, metadata, n_requests, n_metadata)``. Of a revisit, bytes and
    digest are those of the response that it refers to, if the archive has it
    (else null and as declared), and ``refers_to`` is that one's page id."""
    def of(kind: str, prefix: str, *columns: str) -> DataFrame:
        return (archive.where((F.col("warc_type") == kind) & F.col("concurrent_to").isNotNull())
                .groupBy(F.col("concurrent_to").alias("record_id"))
                .agg(F.min(F.struct(F.col("record_id").alias("record_id"), *columns)).alias(prefix),
                     F.count("*").alias(f"n_{'requests' if prefix == 'request' else prefix}")))

    main = archive.where(F.col("warc_type").isin("response", "revisit")).select(
        "record_id", F.col("warc_type").alias("record_type"), "uri", "date", "payload_bytes", "payload_digest",
        F.regexp_replace("declared_digest", "^sha1:", "").alias("declared"), "refers_to", "payload")
    whole = (main.join(of("request", "request", "uri", "payload"), "record_id", "left")
             .join(of("metadata", "metadata", "page_id"), "record_id", "left"))
    # a response refers to itself, so no null key gathers them
    target = (archive.where(F.col("warc_type") == "response")
              .select("record_id", "payload_bytes", "payload_digest")
              .join(of("metadata", "m", "page_id").select("record_id", F.col("m.page_id").alias("page_id")),
                    "record_id", "left")
              .select(F.col("record_id").alias("key"), F.col("payload_bytes").alias("full_bytes"),
                      F.col("payload_digest").alias("full_digest"), F.col("page_id").alias("refers_page")))
    revisit = F.col("record_type") == "revisit"
    return (whole.withColumn("key", F.coalesce("refers_to", "record_id")).join(target, "key", "left")
            .select("record_id", "record_type", "uri", "date", F.col("metadata.page_id").alias("page_id"),
                    F.when(revisit, F.col("full_bytes")).otherwise(F.col("payload_bytes")).alias("payload_bytes"),
                    F.when(revisit, F.coalesce("full_digest", "declared")).otherwise(F.col("payload_digest"))
                    .alias("payload_digest"),
                    F.when(revisit, F.col("refers_page")).alias("refers_to"),
                    F.struct("payload").alias("response"), "request", "metadata",
                    F.coalesce("n_requests", F.lit(0)).alias("n_requests"),
                    F.coalesce("n_metadata", F.lit(0)).alias("n_metadata")))


def op12(pages: DataFrame) -> DataFrame:
    spark = pages.sparkSession
    path = f"{checkpoint_dir(spark)}/warc-{uuid.uuid4().hex}"
    write(pages, path)
    return captures(settle(read(spark, path, payload=False))).select(
        "page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


ORACLE_SQL = f"""
WITH p AS (
  SELECT page_id, url, coalesce(html, '') AS html, sha1(coalesce(html, '')) AS h,
         row_number() OVER (PARTITION BY sha1(coalesce(html, '')) ORDER BY page_id NULLS LAST, url NULLS FIRST) AS n,
         first_value(page_id) OVER (PARTITION BY sha1(coalesce(html, ''))
                                    ORDER BY page_id NULLS LAST, url NULLS FIRST) AS first
  FROM pages
)
SELECT page_id, strlen(html)::BIGINT AS payload_bytes,
       (SELECT string_agg(substr('{_BASE32}', 1 + ((('0x' || substr(h, 5 * (d // 4) + 1, 5))::BIGINT
                                                    >> (5 * (3 - d % 4))) & 31)::INT, 1), '' ORDER BY d)
        FROM (SELECT unnest(range(32)) AS d)) AS payload_digest,
       CASE WHEN n = 1 THEN 'response' ELSE 'revisit' END AS record_type,
       CASE WHEN n > 1 THEN first END AS refers_to
FROM p
"""
