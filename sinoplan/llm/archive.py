"""A content-addressed archive of WARC records: payloads stored once by digest, headers apart, records restored by joins."""

from __future__ import annotations

import zlib

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from sinoplan.llm.common import in_bounded_batches, tidy

#: What stands in every record.
VERSION, PROFILE = "WARC/1.1", "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
HTTP = "HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\n\r\n"
#: Digits of base 32 as Spark writes them, and as WARC digests do (RFC 4648).
DIGITS, BASE32 = "0123456789ABCDEFGHIJKLMNOPQRSTUV", "ABCDEFGHIJKLMNOPQRSTUVWXYZ234567"


def base32_sha1(data: Column) -> Column:
    """SHA-1 in upper-case base 32: 160 bits are four times eight digits."""
    digest = F.sha1(data)
    parts = [F.lpad(F.conv(F.substring(digest, 10 * n + 1, 10), 16, 32), 8, "0") for n in range(4)]
    return F.translate(F.concat(*parts), DIGITS, BASE32)


def _record_id(captured: Column) -> Column:
    return F.concat(F.lit("<urn:page:"), captured, F.lit(">"))


def captures(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", payload_col: str = "html") -> DataFrame:
    """A capture for each page: page_id, url, payload (null: empty) in bytes, and its SHA-256 ``key``."""
    payload = F.coalesce(F.col(f"`{payload_col}`").cast("string").cast("binary"), F.lit("").cast("binary"))
    found = pages.select(F.col(f"`{id_col}`").alias("page_id"), F.col(f"`{url_col}`").cast("string").alias("url"), payload.alias("payload"))
    return found.withColumn("key", F.unhex(F.sha2("payload", 256)))


def write_archive(pages: DataFrame, folder: str, id_col: str = "page_id", url_col: str = "url", payload_col: str = "html", least: int = 0) -> None:
    """Write a record for each page into ``folder``: payloads once, by digest, and headers of all records.

    ``payloads`` (key, bytes): each different payload once, under its SHA-256. That equal digests mean equal bytes is
    verified as they are put together, by length and a second digest, else the job fails. A payload of which very many pages are copies
    is cut down to one in each task before it is shuffled.
    ``records`` (page_id, key, head, http): exact header blocks. Of the records of one payload of at
    least ``least`` bytes, that of the largest page_id is ``response``, the others are ``revisit`` of it, without a payload of
    their own (null ids count as smaller than any; rows that repeat the largest id are all responses, as are all of a payload with null ids only).
    Smaller payloads are all ``response``. A null url gives no WARC-Target-URI. An empty table gives an archive without records.
    """
    rows = captures(pages, id_col, url_col, payload_col)
    spark = pages.sparkSession
    length, second = F.octet_length("payload").cast("long"), F.xxhash64("payload")
    rows.select("page_id", "url", "key", length.alias("n"), base32_sha1(F.col("payload")).alias("digest")).write.parquet(f"{folder}/captures")
    held = rows.groupBy("key").agg(F.first("payload").alias("bytes"), F.min(length).alias("n0"), F.max(length).alias("n1"), F.min(second).alias("h0"), F.max(second).alias("h1"))
    same = (F.col("n0") == F.col("n1")) & (F.col("h0") == F.col("h1"))
    held.select("key", F.when(same, F.col("bytes")).otherwise(F.raise_error(F.concat(F.lit("two payloads of one digest: "), F.hex("key")))).alias("bytes")).write.option("compression", "zstd").parquet(f"{folder}/payloads")
    told = spark.read.parquet(f"{folder}/captures")
    first = told.groupBy("key").agg(F.max("page_id").alias("first"))
    told = told.join(first, "key")
    response = (F.col("n") < least) | F.col("page_id").eqNullSafe(F.col("first"))
    line = lambda name, value: F.concat(F.lit(f"{name}: "), value, F.lit("\r\n"))
    name, of = F.coalesce(F.col("page_id").cast("string"), F.lit("")), F.col("first").cast("string")
    block = F.lit(len(HTTP)).cast("long") + F.when(response, F.col("n")).otherwise(0)
    head = F.concat(
        F.lit(f"{VERSION}\r\n"), line("WARC-Type", F.when(response, "response").otherwise("revisit")), line("WARC-Record-ID", _record_id(name)), line("WARC-Date", F.lit("1970-01-01T00:00:00Z")),
        F.when(F.col("url").isNotNull(), line("WARC-Target-URI", F.regexp_replace("url", "[\\r\\n]", "%20"))).otherwise(""), line("WARC-Payload-Digest", F.concat(F.lit("sha1:"), F.col("digest"))),
        F.when(response, "").otherwise(F.concat(line("WARC-Refers-To", _record_id(of)), line("WARC-Profile", F.lit(PROFILE)))), line("Content-Type", F.lit("application/http; msgtype=response")), line("Content-Length", block.cast("string")), F.lit("\r\n"),
    )
    told.select("page_id", "key", head.alias("head"), F.lit(HTTP).alias("http")).write.option("compression", "zstd").parquet(f"{folder}/records")


def read_archive(spark: SparkSession, folder: str) -> DataFrame:
    """The archive's records with their payloads again: page_id, key, head, http, payload.

    Each payload is verified against its digest once, before the join; a record whose payload is not there fails the job.
    """
    payloads = spark.read.parquet(f"{folder}/payloads")
    true = F.unhex(F.sha2("bytes", 256)) == F.col("key")
    payloads = payloads.select("key", F.when(true, F.col("bytes")).otherwise(F.raise_error(F.concat(F.lit("payload is not what its digest says: "), F.hex("key")))).alias("payload"))
    met = spark.read.parquet(f"{folder}/records").join(payloads, "key", "left")
    return met.withColumn("payload", F.coalesce("payload", F.raise_error(F.concat(F.lit("no payload of digest "), F.hex("key"))).cast("binary")))


def is_revisit() -> Column:
    return F.col("head").contains("\r\nWARC-Type: revisit\r\n")


def record_bytes() -> Column:
    """The record as it stands in a WARC file; records one after another are such a file."""
    body = F.when(is_revisit(), F.lit("").cast("binary")).otherwise(F.col("payload"))
    return F.concat(F.col("head").cast("binary"), F.col("http").cast("binary"), body, F.lit("\r\n\r\n").cast("binary"))


def header(name: str) -> Column:
    """A header's value, null where there is none."""
    found = F.regexp_extract("head", f"\\r\\n{name}: ([^\\r]*)\\r\\n", 1)
    return F.when(F.col("head").contains(f"\r\n{name}: "), found)


def described(records: DataFrame, id_type: str = "long") -> DataFrame:
    """What restored records say of themselves, held against their payloads.

    Result: page_id, payload_bytes, payload_digest (bare), record_type, refers_to (page_id of the response, null for
    responses), record_sha256 (of the record's bytes as in a file). A record whose digest or length is not its payload's fails the job.
    """
    size, digest = F.octet_length("payload").cast("long"), base32_sha1(F.col("payload"))
    said = F.substring(header("WARC-Payload-Digest"), 6, 32)
    told = F.octet_length(F.col("http").cast("binary")) + F.when(is_revisit(), 0).otherwise(size)
    true = (said == digest) & (header("Content-Length").cast("long") == told)
    refers = F.regexp_extract(F.coalesce(header("WARC-Refers-To"), F.lit("")), "<urn:page:(.*)>", 1)
    return records.select(
        "page_id", size.alias("payload_bytes"), F.when(true, digest).otherwise(F.raise_error(F.concat(F.lit("record and payload differ: "), F.col("head")))).alias("payload_digest"), header("WARC-Type").alias("record_type"),
        F.when(is_revisit(), F.nullif(refers, F.lit(""))).cast(id_type).alias("refers_to"), F.sha2(record_bytes(), 256).alias("record_sha256"),
    )


def records_of_files(files: DataFrame) -> DataFrame:
    """Records of WARC files, plain or gzipped by record, as ``spark.read.format("binaryFile")`` gives them: path, nth, head, block (bytes)."""
    schema = T.StructType([T.StructField("path", T.StringType()), T.StructField("nth", T.LongType()), T.StructField("head", T.StringType()), T.StructField("block", T.BinaryType())])

    def run(batches):
        for batch in batches:
            for path, content in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                for nth, (head, block) in enumerate(split_records(_plain(content))):
                    yield pa.RecordBatch.from_arrays([pa.array([path]), pa.array([nth], pa.int64()), pa.array([head.decode("utf-8", "replace")]), pa.array([block], pa.binary())], names=schema.names)

    return in_bounded_batches(files).select("path", "content").mapInArrow(tidy(run), schema)


def _plain(content: bytes) -> bytes:
    """A file's bytes, each gzip member in it unpacked."""
    if content[:2] != b"\x1f\x8b":
        return content
    out = []
    while content:
        member = zlib.decompressobj(31)
        out.append(member.decompress(content))
        content = member.unused_data
    return b"".join(out)


def split_records(data: bytes):
    """(head, block) of each record of a WARC file; the length in the head tells where a record ends."""
    at = 0
    while at < len(data):
        end = data.index(b"\r\n\r\n", at) + 4
        head = data[at:end]
        length = next(int(line.split(b":", 1)[1]) for line in head.split(b"\r\n") if line.lower().startswith(b"content-length:"))
        yield head, data[end : end + length]
        at = end + length + 4
