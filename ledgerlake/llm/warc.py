"""Content-addressed WARC archive.

Two tables make an archive: ``payloads`` holds each distinct payload once, under
the SHA-256 of its bytes, and ``headers`` holds the exact header block of each
record.  Reading verifies every stored payload against its digest and length and
joins the two.  Of records with equal payloads of at least ``REVISIT_BYTES``
the one with the smallest id is a response, the others are revisits of it.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Equal payloads shorter than this are all written as responses.
REVISIT_BYTES = 100

CRLF = "\r\n"


def payload_of(text: Column) -> Column:
    """UTF-8 bytes (null: none)."""
    return F.encode(F.coalesce(text, F.lit("")), "utf-8")


def _urn(record_id: Column) -> Column:
    return F.concat(F.lit("<urn:page:"), F.coalesce(record_id.cast("string"), F.lit("null")), F.lit(">"))


def _clean(value: Column) -> Column:
    """A header value on one line."""
    return F.regexp_replace(F.coalesce(value, F.lit("")), r"[\r\n]+", " ")


def make_records(pages: DataFrame, record_id: str = "page_id", uri: str = "url", body: str = "html") -> DataFrame:
    """One row per record: record_id, digest, payload_bytes, header (the exact header block).

    Only the digests are shuffled, not the payloads.  Rows that share the
    smallest id of their payload are all responses.  Rows without an id are
    responses too, unless the same payload has a row with one.  Other columns of
    ``pages`` are ignored.
    """
    payload = payload_of(F.col(body))
    rows = pages.select(F.col(record_id).alias("record_id"), F.col(uri).alias("_uri"),
                        F.sha2(payload, 256).alias("digest"), F.octet_length(payload).cast("long").alias("payload_bytes"))
    groups = rows.where(F.col("payload_bytes") >= REVISIT_BYTES).groupBy("digest") \
        .agg(F.min("record_id").alias("_first"), F.count(F.lit(1)).alias("_n")).where("_n > 1").drop("_n")
    joined = rows.join(groups, "digest", "left")
    revisit = F.col("_first").isNotNull() & ~F.col("record_id").eqNullSafe(F.col("_first"))
    lines = [
        F.lit("WARC/1.1"),
        F.concat(F.lit("WARC-Type: "), F.when(revisit, "revisit").otherwise("response")),
        F.concat(F.lit("WARC-Record-ID: "), _urn(F.col("record_id"))),
        F.concat(F.lit("WARC-Target-URI: "), _clean(F.col("_uri"))),
        F.concat(F.lit("WARC-Payload-Digest: sha256:"), F.col("digest")),
        F.when(revisit, F.concat(F.lit("WARC-Refers-To: "), _urn(F.col("_first")))),
        F.when(revisit, F.lit("WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest")),
        F.concat(F.lit("Content-Length: "), F.when(revisit, F.lit(0)).otherwise(F.col("payload_bytes")).cast("string")),
    ]
    header = F.concat(F.concat_ws(CRLF, *lines), F.lit(CRLF + CRLF))
    return joined.select("record_id", "digest", "payload_bytes", header.alias("header"))


def make_payloads(pages: DataFrame, body: str = "html") -> DataFrame:
    """Each distinct payload once: digest, payload_bytes, payload.

    Copies are dropped before the shuffle within each task, so a payload that a
    third of all rows share is sent once per task at most.
    """
    payload = payload_of(F.col(body))
    return pages.select(F.sha2(payload, 256).alias("digest"), payload.alias("payload")) \
        .groupBy("digest").agg(F.first("payload").alias("payload")) \
        .select("digest", F.octet_length("payload").cast("long").alias("payload_bytes"), "payload")


def write_archive(pages: DataFrame, path: str, record_id: str = "page_id", uri: str = "url", body: str = "html") -> str:
    """Write both tables below ``path`` (which must not exist yet) and return it."""
    make_records(pages, record_id, uri, body).select("record_id", "digest", "header").write.parquet(f"{path}/headers")
    make_payloads(pages, body).write.parquet(f"{path}/payloads")
    return path


def verified_payloads(spark: SparkSession, path: str) -> DataFrame:
    """The stored payloads, each checked against its digest and length; a damaged one fails the job."""
    stored = spark.read.parquet(f"{path}/payloads")
    sound = (F.sha2("payload", 256) == F.col("digest")) & (F.octet_length("payload") == F.col("payload_bytes"))
    return stored.withColumn("digest", F.when(sound, F.col("digest")).otherwise(
        F.raise_error(F.concat(F.lit("damaged payload "), F.col("digest"))).cast("string")))


def _field(header: Column, name: str) -> Column:
    value = F.regexp_extract(header, f"\r\n{name}: ([^\r]*)\r\n", 1)
    return F.when(value != "", value)


def read_archive(spark: SparkSession, path: str) -> DataFrame:
    """Every record: record_id, header, digest, payload_bytes, payload, record_type, refers_to.

    The fields are those that stand in the header; the payload of a revisit is
    that of the response it refers to.  A header whose payload isn't stored has
    null payload columns.
    """
    headers = spark.read.parquet(f"{path}/headers").select(
        "record_id", "header", F.regexp_extract("header", "WARC-Payload-Digest: sha256:([0-9a-f]{64})", 1).alias("digest"),
        _field(F.col("header"), "WARC-Type").alias("record_type"),
        F.regexp_extract(F.coalesce(_field(F.col("header"), "WARC-Refers-To"), F.lit("")), "<urn:page:(.*)>", 1)
        .alias("refers_to")).withColumn("refers_to", F.when(F.col("refers_to") != "", F.col("refers_to")))
    return headers.join(verified_payloads(spark, path), "digest", "left")


def reconstruct(spark: SparkSession, path: str) -> DataFrame:
    """The exact bytes of every record: record_id, record (header, block and the two line ends after it)."""
    rows = read_archive(spark, path)
    block = F.when(F.col("record_type") == "revisit", F.lit(b"")).otherwise(F.col("payload"))
    end = F.lit((CRLF + CRLF).encode())
    return rows.select("record_id", F.concat(F.col("header").cast("binary"), block, end).alias("record"))


def export_warc(spark: SparkSession, path: str, target: str) -> None:
    """Write the records as gzip-compressed WARC files; each record's closing line ends are the line separator."""
    rows = reconstruct(spark, path)
    body = F.expr(f"substring(record, 1, length(record) - {2 * len(CRLF)})")
    rows.select(body.cast("string").alias("value")) \
        .write.option("lineSep", CRLF + CRLF).option("compression", "gzip").text(target)
