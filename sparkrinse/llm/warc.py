"""Write pages as WARC archives, read archives back, and join their records into captures.

Writing is all column expressions: each record is one text value, and the writer's line separator is
the end of a record. Reading frames records by their content length, one archive at a time and one
record at a time within it. A capture is a response or revisit with the requests and metadata that
name it, directly or through the request, in their concurrent-to headers.
"""
from __future__ import annotations

import base64
import gzip
import hashlib
import io
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from sparkrinse.staging import stage

CAPTURES_PER_FILE = 20_000
BATCH_BYTES = 4 << 20
DATE = "2024-01-01T00:00:00Z"
REVISIT_PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
RECORD = (
    "archive string, record_type string, record_id string, concurrent_to array<string>, target_uri string, date string, "
    "named_digest string, headers map<string, string>, block binary, payload_bytes bigint, payload_digest string"
)


def base32_sha1(payload: Column) -> Column:
    """Upper-case base32 of the SHA-1: five bytes at a time are eight digits of base 32."""
    digest = F.sha1(payload)
    parts = [F.lpad(F.conv(F.substring(digest, 1 + 10 * k, 10), 16, 32), 8, "0") for k in range(4)]
    return F.translate(F.upper(F.concat(*parts)), "0123456789ABCDEFGHIJKLMNOPQRSTUV", "ABCDEFGHIJKLMNOPQRSTUVWXYZ234567")


def _record(headers: list[tuple[str, Column]], *block: Column, size: Column | None = None) -> Column:
    """One record without its last line end. Headers with a null value are left out; ``size`` is the block's in bytes."""
    lines = [F.concat(F.lit(name + ": "), value, F.lit("\r\n")) for name, value in headers]
    size = F.octet_length(F.concat(*block)) if size is None else size
    length = F.concat(F.lit("Content-Length: "), size.cast("string"), F.lit("\r\n"))
    return F.concat(F.lit("WARC/1.1\r\n"), F.concat_ws("", *lines), length, F.lit("\r\n"), *block, F.lit("\r\n"))


def write_warc(
    pages: DataFrame, path: str, *, id_column: str = "page_id", url_column: str = "url", html_column: str = "html",
    least_bytes: int = 0, date: str = DATE, captures_per_file: int = CAPTURES_PER_FILE,
) -> None:
    """Write a request, a response or revisit, and a metadata record per row, gzipped, under ``path``.

    The payload is the html in UTF-8, empty for null. Of rows with equal payloads of ``least_bytes`` or
    more, the one with the smallest id is the response and the others are revisits; rows without id are
    revisits of a row that has one. Repeated rows of the smallest id are all responses. A null url gives
    records without target; line ends in a url are percent-encoded. Other columns are not read.
    """
    html = F.coalesce(F.col(html_column).cast("string"), F.lit(""))
    url = F.replace(F.replace(F.col(url_column).cast("string"), F.lit("\r"), F.lit("%0D")), F.lit("\n"), F.lit("%0A"))
    rows = pages.select(
        F.col(id_column).cast("bigint").alias("id"), url.alias("url"), html.alias("html"), F.octet_length(html).alias("bytes"), F.sha2(html, 256).alias("same")
    )
    firsts = rows.filter(F.col("bytes") >= least_bytes).groupBy("same").agg(
        F.min("id").alias("first"), F.min_by("url", F.struct(F.col("id").isNull(), "id", "url")).alias("first_url"), F.count("*").alias("n")
    ).filter("n > 1 and first is not null").drop("n")
    repeated = stage(firsts, "warc-repeated")  # its true size decides whether the pages must be shuffled
    marked = rows.join(repeated, "same", "left").withColumn(
        "revisit", F.col("first").isNotNull() & ~F.col("first").eqNullSafe(F.col("id"))
    )

    def name(kind: str) -> Column:
        return F.concat(F.lit("<urn:uuid:"), F.regexp_replace(F.md5(F.concat_ws("/", "number", "id", F.lit(kind))), "^(.{8})(.{4})(.{4})(.{4})", "$1-$2-$3-$4-"), F.lit(">"))

    # Columns of their own, below the explode: inside it every use would compute them again.
    made = {kind: name(kind) for kind in ("response", "request", "metadata")} | {"digest": F.concat(F.lit("sha1:"), base32_sha1(F.col("html")))}
    response, request, metadata, digest = (F.col(c) for c in made)
    target = ("WARC-Target-URI", F.col("url"))
    http = F.concat(
        F.lit("HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: "), F.col("bytes").cast("string"), F.lit("\r\n\r\n")
    )

    def head(kind: str, own: Column) -> list[tuple[str, Column]]:
        return [("WARC-Type", F.lit(kind)), ("WARC-Record-ID", own), ("WARC-Date", F.lit(date)), target]

    host = F.regexp_extract("url", "://([^/?#]*)", 1)
    asked = F.concat(
        F.lit("GET "), F.coalesce(F.nullif(F.regexp_extract("url", "://[^/?#]*([^#]*)", 1), F.lit("")), F.lit("/")),
        F.lit(" HTTP/1.1\r\nHost: "), F.coalesce(host, F.lit("")), F.lit("\r\n\r\n"),
    )
    fields = F.concat_ws(
        "", F.concat(F.lit("page-id: "), F.col("id").cast("string"), F.lit("\r\n")),
        F.concat(F.lit("payload-length: "), F.col("bytes").cast("string"), F.lit("\r\n")),
        F.when(F.col("revisit"), F.concat(F.lit("refers-to-page: "), F.col("first").cast("string"), F.lit("\r\n"))),
    )
    http_type = F.lit("application/http; msgtype=response")
    full = _record(
        [*head("response", response), ("WARC-Payload-Digest", digest), ("Content-Type", http_type)],
        http, F.col("html"), size=F.octet_length(http) + F.col("bytes"),
    )
    again = _record(
        [*head("revisit", response), ("WARC-Payload-Digest", digest), ("WARC-Profile", F.lit(REVISIT_PROFILE)),
         ("WARC-Refers-To-Target-URI", F.col("first_url")), ("WARC-Refers-To-Date", F.lit(date)), ("Content-Type", http_type)], http,
    )
    records = F.array(
        _record([*head("request", request), ("WARC-Concurrent-To", response), ("Content-Type", F.lit("application/http; msgtype=request"))], asked),
        F.when(F.col("revisit"), again).otherwise(full),
        _record([*head("metadata", metadata), ("WARC-Concurrent-To", request), ("Content-Type", F.lit("application/warc-fields"))], fields),
    )
    # The number sets rows with the same id apart; the records of a row are written by one task.
    numbered = marked.withColumn("number", F.monotonically_increasing_id()).withColumns(made)
    (
        numbered.select(F.explode(records).alias("value"))
        .write.option("lineSep", "\r\n").option("compression", "gzip").option("maxRecordsPerFile", 3 * captures_per_file).text(path)
    )


def _records(archive: str, content: bytes) -> Iterator[tuple]:
    stream = io.BytesIO(content)
    if content[:2] == b"\x1f\x8b":
        stream = gzip.GzipFile(fileobj=stream)
    while line := stream.readline():
        if not line.strip():
            continue
        if not line.startswith(b"WARC/"):
            raise ValueError(f"{archive}: no record starts with {line[:40]!r}")
        headers: dict[str, str] = {}
        concurrent = []
        while (line := stream.readline()).strip():
            field, _, value = line.decode("utf-8", "replace").partition(":")
            field, value = field.strip().lower(), value.strip()
            if field == "warc-concurrent-to":
                concurrent.append(value)
            headers[field] = value
        if not headers.get("content-length", "").isdigit():
            raise ValueError(f"{archive}: a record without content length")
        size = int(headers["content-length"])
        block = stream.read(size)
        if len(block) < size:
            raise ValueError(f"{archive}: a record of {size} bytes ends after {len(block)}")
        payload = block
        if headers.get("content-type", "").startswith("application/http"):
            payload = block.partition(b"\r\n\r\n")[2]
        digest = base64.b32encode(hashlib.sha1(payload).digest()).decode()
        yield (
            archive, headers.get("warc-type"), headers.get("warc-record-id"), concurrent, headers.get("warc-target-uri"),
            headers.get("warc-date"), headers.get("warc-payload-digest"), headers, block, len(payload), digest,
        )


def read_warc(spark: SparkSession, path: str) -> DataFrame:
    """One row per record of the archives under ``path``, gzipped or plain; a broken archive raises.

    ``payload_bytes`` and ``payload_digest`` are of the payload found; ``named_digest`` is the header's.
    A task holds one compressed archive at a time.
    """
    names = [part.strip().split(" ")[0] for part in RECORD.replace("map<string, string>", "map").split(",")]
    text = pa.string()
    kinds = [text, text, text, pa.list_(text), text, text, text, pa.map_(text, text), pa.binary(), pa.int64(), text]

    def batch_of(rows: list[tuple]) -> pa.RecordBatch:
        columns = list(zip(*rows)) or [()] * len(names)
        columns[7] = [list(x.items()) for x in columns[7]]
        return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds)], names)

    def parse(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for archive, content in zip(batch.column(0).to_pylist(), batch.column(1)):
                rows, held = [], 0
                for row in _records(archive, content.as_py()):
                    rows.append(row)
                    held += len(row[8])
                    if held > BATCH_BYTES or len(rows) >= 5_000:
                        yield batch_of(rows)
                        rows, held = [], 0
                yield batch_of(rows)

    files = spark.read.format("binaryFile").load(path).filter("length > 0").select("path", "content")
    return files.mapInArrow(parse, RECORD)


def captures(records: DataFrame) -> DataFrame:
    """One row per capture: capture_id, response, requests, metadata (arrays), all of records as structs.

    ``response`` is a response or revisit, null where only others name the capture. A request belongs to
    the capture it is concurrent to; a metadata record likewise, or to its request's. Records that name
    several belong to each. Other record types are left out. Archives are read twice: once for requests and
    metadata, which are stored, and once for the rest.
    """
    own = [F.col(c) for c in ("record_type", "target_uri", "date", "named_digest", "payload_bytes", "payload_digest", "headers", "block")]
    responses = records.filter(F.col("record_type").isin("response", "revisit"))
    named = F.explode(F.when(F.size("concurrent_to") > 0, F.col("concurrent_to")).otherwise(F.array("record_id")))
    others = stage(records.filter(F.col("record_type").isin("request", "metadata")).select("record_id", *own, named.alias("to")), "warc-others")
    through = others.filter("record_type = 'request'").select(F.col("record_id").alias("asked"), F.col("to").alias("further"))
    rooted = others.join(through, F.col("to") == F.col("asked"), "left").withColumn("root", F.coalesce("further", "to"))
    struct = F.struct("record_id", *own)
    gathered = rooted.groupBy("root").agg(
        F.collect_list(F.when(F.col("record_type") == "request", struct)).alias("requests"),
        F.collect_list(F.when(F.col("record_type") == "metadata", struct)).alias("metadata"),
    )
    joined = responses.join(gathered, F.col("record_id") == F.col("root"), "full")
    return joined.select(
        F.coalesce("record_id", "root").alias("capture_id"), F.when(F.col("record_id").isNotNull(), struct).alias("response"), "requests", "metadata"
    )


def metadata_field(name: str) -> Column:
    """A field of a capture's first metadata record, null where it has none."""
    text = F.get(F.col("metadata"), F.lit(0))["block"].cast("string")
    return F.nullif(F.regexp_extract(text, rf"(?m)^{name}: (.*?)\r?$", 1), F.lit(""))


def payload_report(found: DataFrame) -> DataFrame:
    """Digest columns of captures that ``write_warc`` made: what each page's records say of its payload."""
    response = F.col("response")
    revisit = response["record_type"] == "revisit"
    return found.select(
        metadata_field("page-id").cast("bigint").alias("page_id"),
        F.when(revisit, metadata_field("payload-length").cast("bigint")).otherwise(response["payload_bytes"]).alias("payload_bytes"),
        F.when(revisit, F.regexp_replace(response["named_digest"], "^sha1:", "")).otherwise(response["payload_digest"]).alias("payload_digest"),
        response["record_type"].alias("record_type"),
        metadata_field("refers-to-page").cast("bigint").alias("refers_to"),
    )
