"""WARC archives with revisit records: originals found by payload digest, archives written with fresh headers and read back."""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from starloom.session import shared_folder

RECORDS_PER_FILE = 2000  # so that a task reading one archive holds a bounded number of records
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"  # fixed value of the format
BLANK = "\r\n\r\n"


def resolve_revisits(headers: DataFrame, least_bytes: int) -> DataFrame:
    """For headers (page_id, payload_digest, payload_bytes): page_id, payload_digest and refers_to of the records that revisit another.

    Among records with the digest and the size of a payload of at least ``least_bytes``, the one with the largest page_id
    is the original. Rows that repeat the original's page_id are originals too. Sizes and digests are counted per task
    before they are shuffled; the join back has one row per digest on one side, so that a digest which many records
    share is divided by adaptive execution.
    """
    long = headers.where(F.col("payload_bytes") >= least_bytes)
    originals = long.groupBy("payload_digest", "payload_bytes").agg(F.max("page_id").alias("refers_to"), F.count("*").alias("copies")).where("copies > 1")
    joined = long.join(originals, ["payload_digest", "payload_bytes"])
    return joined.where(F.col("page_id") != F.col("refers_to")).select("page_id", "payload_digest", "refers_to").distinct()


def archive_records(pages: DataFrame, least_bytes: int = 1000) -> DataFrame:
    """One WARC record per row as text (headers, blank line, payload), without the blank line that ends a record."""
    payload = F.coalesce(F.col("html"), F.lit(""))
    described = pages.select("page_id", F.coalesce(F.col("url"), F.lit("")).alias("url"), payload.alias("payload")).withColumns(
        {"payload_digest": F.sha1(F.encode("payload", "UTF-8")), "payload_bytes": F.octet_length("payload").cast("long")}
    )
    revisits = resolve_revisits(described.select("page_id", "payload_digest", "payload_bytes"), least_bytes)
    resolved = described.join(revisits, ["page_id", "payload_digest"], "left")
    revisit = F.col("refers_to").isNotNull()
    record_id = F.sha1(F.concat_ws("|", F.coalesce(F.col("page_id").cast("string"), F.lit("null")), "payload_digest"))
    name = lambda c: F.concat(F.lit("<urn:page:"), F.coalesce(c.cast("string"), F.lit("null")), F.lit(">"))
    target = F.regexp_replace("url", r"[\r\n]", "%0A")  # a header ends at a line break
    lines = [
        F.lit("WARC/1.1"),
        F.concat(F.lit("WARC-Type: "), F.when(revisit, "revisit").otherwise("response")),
        F.concat(F.lit("WARC-Record-ID: <urn:sha1:"), record_id, F.lit(">")),
        F.concat(F.lit("WARC-Page-ID: "), name(F.col("page_id"))),
        F.lit("WARC-Date: 1970-01-01T00:00:00Z"),  # the table holds no time of capture
        F.concat(F.lit("WARC-Target-URI: "), target),
        F.concat(F.lit("WARC-Payload-Digest: sha1:"), F.col("payload_digest")),
        F.concat(F.lit("WARC-Payload-Length: "), F.col("payload_bytes").cast("string")),
        F.when(revisit, F.concat(F.lit("WARC-Refers-To: "), name(F.col("refers_to")))),
        F.when(revisit, F.lit(f"WARC-Profile: {PROFILE}")),
        F.lit("Content-Type: application/octet-stream"),
        F.concat(F.lit("Content-Length: "), F.when(revisit, 0).otherwise(F.col("payload_bytes")).cast("string")),
    ]
    return resolved.select(F.concat(F.concat_ws("\r\n", *lines), F.lit(BLANK), F.when(revisit, "").otherwise(F.col("payload"))).alias("value"))


def write_archives(pages: DataFrame, folder: str, least_bytes: int = 1000) -> None:
    """Write the deduplicated records of ``pages`` (page_id, url, html) as gzip-compressed WARC files.

    Spark's text writer commits the files; the blank line after each record is its line separator, so a file is
    exactly the records one after the other, and a lost executor's files are written again.
    """
    writer = archive_records(pages, least_bytes).write.option("lineSep", BLANK).option("compression", "gzip")
    writer.option("maxRecordsPerFile", RECORDS_PER_FILE).text(folder)


def parse_records(content: bytes) -> Iterator[tuple[dict[str, str], bytes]]:
    """Headers (lower-case names) and payload of each record of one unpacked archive, by the announced lengths."""
    at = 0
    while at < len(content):
        end = content.index(b"\r\n\r\n", at)
        first, *lines = content[at:end].decode("utf-8").split("\r\n")
        if not first.startswith("WARC/"):
            raise ValueError(f"no WARC record at byte {at}: {first[:40]!r}")
        headers = {k.lower(): v for k, v in (line.split(": ", 1) for line in lines)}
        start = end + 4
        at = start + int(headers["content-length"])
        yield headers, content[start:at]
        if content[at : at + 4] != b"\r\n\r\n":
            raise ValueError(f"record not closed at byte {at}")
        at += 4


READ_SCHEMA = "page_id long, url string, payload_bytes long, payload_digest string, record_type string, refers_to long, payload binary"


def read_archives(spark: SparkSession, folder: str) -> DataFrame:
    """Records of the archives in ``folder``: page_id, url, payload_bytes, payload_digest, record_type, refers_to, payload (empty for revisits)."""

    def number(name: str | None) -> int | None:
        inner = name[len("<urn:page:") : -1] if name else "null"
        return None if inner == "null" else int(inner)

    def parse(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for packed in batch.column("content"):
                rows = []
                for headers, payload in parse_records(zlib.decompress(packed.as_py(), wbits=31)):
                    rows.append((
                        number(headers["warc-page-id"]), headers["warc-target-uri"], int(headers["warc-payload-length"]),
                        headers["warc-payload-digest"].removeprefix("sha1:"), headers["warc-type"], number(headers.get("warc-refers-to")), payload,
                    ))
                kinds = [pa.int64(), pa.string(), pa.int64(), pa.string(), pa.string(), pa.int64(), pa.binary()]
                names = [part.split()[0] for part in READ_SCHEMA.split(", ")]
                columns = list(zip(*rows)) or [()] * len(kinds)
                yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds)], names)

    files = spark.read.format("binaryFile").option("pathGlobFilter", "*.gz").load(folder).select("content")
    return files.mapInArrow(parse, READ_SCHEMA)


def archive_round_trip(pages: DataFrame, least_bytes: int = 1000) -> DataFrame:
    """Write ``pages`` into deduplicated archives in the shared folder, read them back, and return a row per record.

    A null html is an empty payload, a null url an empty target; a null page_id never becomes an original, and its
    record stays a response. Payloads below ``least_bytes`` are always responses. Repeated rows are repeated records.
    Payload sizes and digests are those of the full payload, also for revisits, whose record has none. An empty table
    gives no record. Digests of stored payloads are computed again from the archive.
    """
    spark = pages.sparkSession
    folder = shared_folder(spark, "warc")
    write_archives(pages, folder, least_bytes)
    back = read_archives(spark, folder)
    stored = F.when(F.col("record_type") == "response", F.sha1("payload")).otherwise(F.col("payload_digest"))
    return back.select("page_id", F.when(F.col("record_type") == "response", F.length("payload")).otherwise(F.col("payload_bytes")).cast("long").alias("payload_bytes"),
                       stored.alias("payload_digest"), "record_type", "refers_to")
