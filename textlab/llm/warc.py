"""WARC archives: writing, reading, and resolution of revisits.

Archives are written by Spark's text writer, whose record separator is the one
of WARC (two line ends), so its commit protocol covers lost executors and
repeated tasks. They are read as whole files, of a bounded number of records
each, and parsed by ``Content-Length`` while they are being decompressed.
"""

from __future__ import annotations

import base64
import hashlib
import zlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from textlab.session import scratch_path, written

END = "\r\n"
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
RECORDS_PER_FILE = 1000
#: The digits of base 32 as Spark's conv() writes them, and as RFC 4648 does.
CONV_DIGITS, RFC_DIGITS = "0123456789ABCDEFGHIJKLMNOPQRSTUV", "ABCDEFGHIJKLMNOPQRSTUVWXYZ234567"
RECORD = (
    "record_id string, record_type string, page_id long, url string, payload_digest string, "
    "payload_bytes long, refers_to long, intact boolean"
)


def base32_sha1(payload: Column) -> Column:
    """The SHA-1 digest in base 32: 20 bits at a time, as five hex and four base-32 digits."""
    digest = F.sha1(payload)
    parts = [
        F.lpad(F.conv(F.substring(digest, 5 * i + 1, 5), 16, 32), 4, "0") for i in range(8)
    ]
    return F.translate(F.concat(*parts), CONV_DIGITS, RFC_DIGITS)


def header_value(value: Column) -> Column:
    """A value that fits into one header line: control characters are percent-encoded."""
    for code in (0x0A, 0x0D):
        value = F.replace(value, F.lit(chr(code)), F.lit(f"%{code:02X}"))
    return value


def record_text(date: str) -> Column:
    """The record of a row with ``record_id, record_type, page_id, url, payload``,
    ``payload_digest, payload_bytes, refers_to``. Headers without a value are left out."""
    revisit = F.col("record_type") == "revisit"
    http = F.concat(
        F.lit(f"HTTP/1.1 200 OK{END}Content-Type: text/html; charset=utf-8{END}Content-Length: "),
        F.col("payload_bytes"), F.lit(END + END),
    )
    block = F.concat(http, F.when(revisit, F.lit("")).otherwise(F.col("payload")))

    def line(name: str, value: Column) -> Column:
        return F.concat(F.lit(f"{name}: "), value)

    return F.concat_ws(
        END, F.lit("WARC/1.1"), line("WARC-Type", F.col("record_type")), line("WARC-Record-ID", F.col("record_id")),
        line("WARC-Date", F.lit(date)), line("WARC-Target-URI", header_value(F.col("url"))),
        line("WARC-Payload-Digest", F.concat(F.lit("sha1:"), "payload_digest")),
        line("X-Payload-Length", F.col("payload_bytes").cast("string")),
        line("X-Page-Id", F.col("page_id").cast("string")),
        F.when(revisit, line("WARC-Profile", F.lit(PROFILE))),
        F.when(revisit, line("X-Refers-To-Page-Id", F.col("refers_to").cast("string"))),
        line("Content-Type", F.lit("application/http; msgtype=response")),
        line("Content-Length", F.octet_length(block).cast("string")), F.lit(""), block,
    )


def write_archives(records: DataFrame, path: str, date: str, records_per_file: int = RECORDS_PER_FILE) -> None:
    """Gzip-compressed archives of bounded size under ``path``."""
    (
        records.select(record_text(date).alias("value"))
        .write.option("lineSep", END + END).option("compression", "gzip")
        .option("maxRecordsPerFile", records_per_file).text(path)
    )


def new_records(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html") -> DataFrame:
    """A response record per page. Record ids hold the row's place, so repeated pages differ."""
    payload = F.coalesce(html_col, F.lit(""))
    return pages.select(
        F.concat(F.lit("<urn:row:"), F.monotonically_increasing_id(), F.lit(">")).alias("record_id"),
        F.lit("response").alias("record_type"), F.col(id_col).cast("long").alias("page_id"),
        F.col(url_col).alias("url"), payload.alias("payload"), base32_sha1(payload).alias("payload_digest"),
        F.octet_length(payload).cast("long").alias("payload_bytes"), F.lit(None).cast("long").alias("refers_to"),
    )


def _parsed(content: bytes) -> Iterator[tuple[dict[str, str], memoryview]]:
    """Headers and block of every record of a compressed archive, one at a time."""
    inflate, held = zlib.decompressobj(31), bytearray()
    at, mark = 0, b"\r\n\r\n"

    def more() -> bool:
        nonlocal at, inflate
        if inflate.eof:  # archives may have a compressed member per record
            content_left = inflate.unused_data + content[at:]
            if not content_left:
                return False
            inflate, held_back = zlib.decompressobj(31), content_left
            held.extend(inflate.decompress(held_back))
            at = len(content)
            return True
        if at >= len(content):
            return False
        held.extend(inflate.decompress(content[at:at + (1 << 18)]))
        at += 1 << 18
        return True

    while True:
        while (end := held.find(mark)) < 0:
            if not more():
                return
        lines = held[:end].decode("utf-8").split("\r\n")
        fields = dict(x.split(": ", 1) for x in lines[1:])
        start, size = end + len(mark), int(fields["Content-Length"])
        while len(held) < start + size + len(mark) and more():
            pass
        yield fields, bytes(held[start:start + size])
        del held[:start + size + len(mark)]


def read_archives(spark: SparkSession, path: str, payloads: bool = False) -> DataFrame:
    """One row per record, with ``payload`` if asked for.

    ``intact`` says whether the digest of the payload that was read is the one
    in the header; a revisit holds no payload and so can't be compared.
    """
    names = [x.split()[0] for x in RECORD.split(", ")] + ["payload"] * payloads
    kinds = {"string": pa.string(), "long": pa.int64(), "boolean": pa.bool_()}
    kind = [kinds[x.split()[1]] for x in RECORD.split(", ")] + [pa.string()] * payloads
    schema = pa.schema(list(zip(names, kind, strict=True)))

    def records(batches):
        for batch in batches:
            for content in batch.column(0):
                rows, held = [], 0
                for fields, block in _parsed(content.as_py()):
                    body = block[block.index(b"\r\n\r\n") + 4:]
                    digest = fields["WARC-Payload-Digest"].removeprefix("sha1:")
                    number = {k: int(fields[k]) if k in fields else None for k in ("X-Page-Id", "X-Refers-To-Page-Id")}
                    revisit = fields["WARC-Type"] == "revisit"
                    own = None if revisit else base64.b32encode(hashlib.sha1(body).digest()).decode() == digest
                    rows.append((
                        fields["WARC-Record-ID"], fields["WARC-Type"], number["X-Page-Id"], fields.get("WARC-Target-URI"),
                        digest, int(fields["X-Payload-Length"]), number["X-Refers-To-Page-Id"], own,
                        *([body.decode("utf-8")] if payloads else []),
                    ))
                    held += len(block)
                    if held > 1 << 24:
                        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), kind)], schema=schema)
                        rows, held = [], 0
                if rows:
                    yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), kind)], schema=schema)

    files = spark.read.format("binaryFile").option("pathGlobFilter", "part-*").load(path).select("content")
    return files.mapInArrow(records, RECORD + ", payload string" * payloads)


def resolve_revisits(headers: DataFrame, least_bytes: int = 0) -> DataFrame:
    """``record_id, record_type, refers_to`` for record headers, by payload digest.

    Of the records of one payload, that with the smallest page id (then the
    smallest record id) is the response, the others are revisits of it; payloads
    of less than ``least_bytes`` are all responses.
    """
    key = ["payload_digest", "payload_bytes"]
    large = headers.where(F.col("payload_bytes") >= least_bytes).select("record_id", "page_id", *key)
    # Only headers move, and each task sends one candidate per payload.
    first = F.min(F.struct(F.col("page_id").isNull().alias("no_id"), "page_id", "record_id")).alias("first")
    originals = written(
        large.groupBy(*key).agg(first, F.count(F.lit(1)).alias("n")).where("n > 1").drop("n"), "originals"
    )
    # Originals are unique, so a payload with very many records can be split by adaptive execution.
    return large.join(originals, key).where(F.col("record_id") != F.col("first.record_id")).select(
        "record_id", F.lit("revisit").alias("record_type"), F.col("first.page_id").alias("refers_to")
    )


def archive_pages(pages: DataFrame, path: str, date: str = "2024-01-01T00:00:00Z", least_bytes: int = 0) -> DataFrame:
    """Write pages as archives under ``path``/raw, without repeated payloads under
    ``path``/deduplicated, and return the records read back from the latter.

    Columns ``record_id, record_type, page_id, url, payload_digest, payload_bytes,
    refers_to, intact``, one row per row of ``pages``. Revisits keep digest and
    length of the full payload. A null html is an empty payload, a null url or
    page id leaves its header out and comes back null; a null id is never
    preferred as the original. Repeated pages are records of their own. An empty
    table gives empty archives.
    """
    spark = pages.sparkSession
    write_archives(new_records(pages), f"{path}/raw", date)
    revisits = written(resolve_revisits(read_archives(spark, f"{path}/raw"), least_bytes), "revisits")
    full = read_archives(spark, f"{path}/raw", payloads=True).drop("record_type", "refers_to", "intact")
    fresh = full.join(revisits, "record_id", "left").withColumn(
        "record_type", F.coalesce("record_type", F.lit("response"))
    )
    write_archives(fresh, f"{path}/deduplicated", date)
    return read_archives(spark, f"{path}/deduplicated")


def archived(pages: DataFrame, **options) -> DataFrame:
    """:func:`archive_pages` in a new folder of the session's shared folder."""
    return archive_pages(pages, scratch_path(pages.sparkSession, "warc"), **options)
