"""Content-addressed WARC archive: payloads once by SHA-256, exact record headers apart.

write_archive() writes two Parquet tables: `payloads` (digest, first_id, payload: the bytes of each
distinct payload once) and `headers` (page_id, digest, header: the exact WARC/1.1 header block of each
record). read_records() joins them back into whole records, checks every payload against its digest
(a mismatch is an error) and returns header, payload and record bytes.

Among pages of one payload of at least min_revisit_bytes bytes, the one with the smallest id becomes
`response` and the others `revisit` it; pages of smaller payloads are all `response`. Only digests and
ids meet in joins of revisits; a payload is joined to its responses alone, so a payload that a third of
all pages share is neither grouped nor copied.

A null html is an empty payload. Null ids count as larger than any id. Rows that repeat the smallest id
are all responses of the same stored payload. A null url leaves the target empty. An empty table writes
empty tables. Extra columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

LAST = 9223372036854775807
CRLF = "\r\n"
DATE = "2024-01-01T00:00:00Z"  #: WARC-Date of all records unless given
HEADERS = "page_id bigint, digest string, header binary"
PAYLOADS = "digest string, first_id bigint, payload binary"


def base32_sha1(payload: Column) -> Column:
    """Upper-case base32 of the SHA-1: five hex digits at a time are four base-32 digits."""
    digits = F.concat(
        *(F.lpad(F.conv(F.substring(F.sha1(payload), 1 + 5 * k, 5), 16, 32), 4, "0") for k in range(8))
    )
    return F.translate(digits, "0123456789ABCDEFGHIJKLMNOPQRSTUV", "ABCDEFGHIJKLMNOPQRSTUVWXYZ234567")


def record_id(page_id: Column) -> Column:
    """A name-based record id of the page."""
    h = F.md5(F.concat(F.lit("page:"), F.coalesce(page_id.cast("string"), F.lit("")).cast("string")).cast("binary"))
    parts = [F.substring(h, a, n) for a, n in ((1, 8), (9, 4), (13, 4), (17, 4), (21, 12))]
    return F.concat(F.lit("<urn:uuid:"), F.concat_ws("-", *parts), F.lit(">"))


def header_block(date: str) -> Column:
    """Header of a record from its columns page_id, url, first_id, sha1, bytes and revisit."""
    revisit = F.col("revisit")
    lines = [
        F.lit("WARC/1.1"),
        F.concat(F.lit("WARC-Type: "), F.when(revisit, "revisit").otherwise("response")),
        F.concat(F.lit("WARC-Record-ID: "), record_id(F.col("page_id"))),
        F.lit(f"WARC-Date: {date}"),
        F.concat(F.lit("WARC-Target-URI: "), F.regexp_replace(F.coalesce("url", F.lit("")), "[\r\n]", "")),
        F.concat(F.lit("WARC-Payload-Digest: sha1:"), F.col("sha1")),
        F.when(revisit, F.lit("WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest")),
        F.when(revisit, F.concat(F.lit("WARC-Refers-To: "), record_id(F.col("first_id")))),
        F.when(revisit, F.concat(F.lit("X-Refers-To-Page: "), F.col("first_id").cast("string"))),
        F.concat(F.lit("X-Page: "), F.coalesce(F.col("page_id").cast("string"), F.lit(""))),
        F.concat(F.lit("X-Payload-Length: "), F.col("bytes").cast("string")),
        F.lit("Content-Type: text/html; charset=utf-8"),
        F.concat(F.lit("Content-Length: "), F.when(revisit, F.lit("0")).otherwise(F.col("bytes").cast("string"))),
    ]
    return F.concat(F.concat_ws(CRLF, *lines), F.lit(CRLF + CRLF)).cast("binary")


def write_archive(
    pages: DataFrame, path: str, min_revisit_bytes: int = 0, date: str = DATE,
    id_col: str = "page_id", url_col: str = "url", html_col: str = "html",
) -> None:
    payload = F.coalesce(F.col(html_col), F.lit("")).cast("binary")
    rows = pages.select(
        F.col(id_col).cast("bigint").alias("page_id"), F.col(url_col).cast("string").alias("url"), payload.alias("payload")
    ).withColumn("digest", F.sha2("payload", 256))
    # partial aggregation keeps one copy of a payload per task
    stored = rows.groupBy("digest").agg(
        F.min(F.coalesce("page_id", F.lit(LAST))).alias("first_id"), F.first("payload").alias("payload")
    )
    stored.write.option("compression", "zstd").parquet(f"{path}/payloads")
    firsts = pages.sparkSession.read.schema(PAYLOADS).parquet(f"{path}/payloads").select("digest", "first_id")
    records = (
        rows.withColumns({"sha1": base32_sha1(F.col("payload")), "bytes": F.octet_length("payload").cast("bigint")})
        .drop("payload")
        .join(firsts, "digest")
        .withColumn(
            "revisit",
            (F.col("bytes") >= min_revisit_bytes) & (F.coalesce("page_id", F.lit(LAST)) != F.col("first_id")),
        )
    )
    records.select("page_id", "digest", header_block(date).alias("header")).write.option("compression", "zstd").parquet(
        f"{path}/headers"
    )


def field(name: str) -> Column:
    """A header field, null where it is absent or empty."""
    return F.nullif(F.regexp_extract(F.col("header").cast("string"), rf"\r\n{name}: ([^\r]*)", 1), F.lit(""))


def read_records(spark: SparkSession, path: str) -> DataFrame:
    """page_id, url, record_type, refers_to, payload_bytes, payload_digest, header, payload, record of every record.

    payload is null in revisits; payload_bytes and payload_digest are those of the full payload: measured on the
    stored bytes in responses (and checked against the header), as the header states them in revisits.
    """
    headers = spark.read.schema(HEADERS).parquet(f"{path}/headers").select(
        "digest",
        "header",
        field("WARC-Type").alias("record_type"),
        field("X-Page").cast("bigint").alias("page_id"),
        field("WARC-Target-URI").alias("url"),
        field("X-Refers-To-Page").cast("bigint").alias("refers_to"),
        field("X-Payload-Length").cast("bigint").alias("stated_bytes"),
        F.regexp_replace(field("WARC-Payload-Digest"), "^sha1:", "").alias("stated_digest"),
    )
    payloads = spark.read.schema(PAYLOADS).parquet(f"{path}/payloads").select("digest", "payload")
    end = F.lit(CRLF + CRLF).cast("binary")
    whole = headers.where("record_type = 'response'").join(payloads, "digest", "left")
    sound = (
        (F.sha2("payload", 256) == F.col("digest"))
        & (base32_sha1(F.col("payload")) == F.col("stated_digest"))
        & (F.octet_length("payload") == F.col("stated_bytes"))
    )
    whole = whole.withColumn("payload", F.when(sound, F.col("payload")).otherwise(F.raise_error(F.lit("payload does not match its digest"))))
    responses = whole.select(
        "page_id", "url", "record_type", "refers_to", F.octet_length("payload").cast("bigint").alias("payload_bytes"),
        base32_sha1(F.col("payload")).alias("payload_digest"), "header", "payload",
        F.concat("header", "payload", end).alias("record"),
    )
    revisits = headers.where("record_type = 'revisit'").select(
        "page_id", "url", "record_type", "refers_to", F.col("stated_bytes").alias("payload_bytes"),
        F.col("stated_digest").alias("payload_digest"), "header", F.lit(None).cast("binary").alias("payload"),
        F.concat("header", end).alias("record"),
    )
    return responses.unionByName(revisits)
