"""Content-addressed WARC archive.

``write_archive`` keeps payload bytes once for each SHA-256 digest and, apart
from them, the exact header bytes of every record; ``read_archive`` joins the
two, verifies every payload against its address and rebuilds each record byte
by byte. Of records with equal payloads of ``least_bytes`` or more, the one
with the largest page_id is the response and the others are revisits of it.

Defined results: a null html is an empty payload; a null page_id counts as the
smallest and reads back as null; line breaks in a url are percent-encoded and a
null url has no WARC-Target-URI line; repeated rows each get a record, and all
rows with the largest page_id of their group are responses. Extra columns are
ignored; an empty table gives an empty archive.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import new_path

LEAST_BYTES = 1000
NO_ID = -(1 << 63)
CRLF = "\r\n"


def _header(date: str):
    """The exact header block of a record, as bytes."""
    url = F.replace(F.replace(F.col("url"), F.lit("\r"), F.lit("%0D")), F.lit("\n"), F.lit("%0A"))
    urn = lambda c: F.concat(F.lit("<urn:page:"), F.coalesce(c.cast("string"), F.lit("")), F.lit(">"))
    revisit = F.col("record_type") == "revisit"
    lines = [
        F.lit("WARC/1.1"),
        F.concat(F.lit("WARC-Type: "), F.col("record_type")),
        F.concat(F.lit("WARC-Record-ID: "), urn(F.col("page_id"))),
        F.concat(F.lit("WARC-Target-URI: "), url),
        F.lit(f"WARC-Date: {date}"),
        F.concat(F.lit("WARC-Payload-Digest: sha1:"), F.col("payload_sha1")),
        F.when(revisit, F.concat(F.lit("WARC-Refers-To: "), urn(F.col("lead")))),
        F.when(revisit, F.lit("WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest")),
        F.lit("Content-Type: text/html; charset=utf-8"),
        F.concat(F.lit("Content-Length: "), F.when(revisit, F.lit(0)).otherwise(F.col("payload_bytes")).cast("string")),
    ]
    return F.encode(F.concat(F.concat_ws(CRLF, *lines), F.lit(CRLF + CRLF)), "UTF-8")


def write_archive(pages: DataFrame, path: str, least_bytes: int = LEAST_BYTES, date: str = "2024-01-01T00:00:00Z") -> None:
    """Writes ``path``/payloads and ``path``/headers; pages has page_id, url and html."""
    payload = F.coalesce(F.encode("html", "UTF-8"), F.lit("").cast("binary"))
    rows = pages.select(F.col("page_id").cast("long").alias("page_id"), "url", payload.alias("payload"))
    rows = rows.withColumn("digest", F.sha2("payload", 256)).withColumn("page_key", F.coalesce("page_id", F.lit(NO_ID)))
    leads = rows.groupBy("digest").agg(F.max("page_key").alias("page_key"))
    # (digest, page_key) names one row, so the payloads of a hot digest stay spread over the tasks
    once = rows.select("digest", "page_key", "payload").join(leads, ["digest", "page_key"], "left_semi").dropDuplicates(["digest", "page_key"])
    once.select("digest", "payload").write.mode("overwrite").parquet(f"{path}/payloads")
    facts = rows.select("digest", "page_id", "page_key", "url", F.length("payload").cast("long").alias("payload_bytes"), F.sha1("payload").alias("payload_sha1"))
    facts = facts.join(leads.withColumnRenamed("page_key", "lead_key"), "digest")
    first = (F.col("payload_bytes") < least_bytes) | (F.col("page_key") == F.col("lead_key"))
    facts = facts.withColumn("record_type", F.when(first, "response").otherwise("revisit")).withColumn("lead", F.when(F.col("lead_key") != NO_ID, F.col("lead_key")))
    facts.select("digest", _header(date).alias("header")).write.mode("overwrite").parquet(f"{path}/headers")


def read_archive(spark: SparkSession, path: str) -> DataFrame:
    """header, payload and record (the exact bytes) of every record, with the parsed header fields.

    Raises an error where a payload doesn't match its digest or is missing.
    """
    headers = spark.read.schema("digest string, header binary").parquet(f"{path}/headers")
    payloads = spark.read.schema("digest string, payload binary").parquet(f"{path}/payloads")
    sound = F.sha2("payload", 256) == F.col("digest")
    payloads = payloads.withColumn("payload", F.when(sound, F.col("payload")).otherwise(F.raise_error(F.concat(F.lit("payload differs from its digest "), F.col("digest"))).cast("binary")))
    text = F.decode("header", "UTF-8")
    field = lambda name, value="[^\\r]*": F.regexp_extract(text, rf"\r\n{name}: ({value})\r\n", 1)
    page = lambda name: F.expr("try_cast(nullif(x, '') as bigint)".replace("x", f"regexp_extract(decode(header, 'UTF-8'), '\\r\\n{name}: <urn:page:([0-9-]*)>\\r\\n', 1)"))
    rows = headers.join(payloads, "digest", "left")
    whole = F.coalesce(F.col("payload"), F.raise_error(F.concat(F.lit("no payload for "), F.col("digest"))).cast("binary"))
    rows = rows.withColumn("payload", whole)
    rows = rows.withColumn("record_type", field("WARC-Type")).withColumn("page_id", page("WARC-Record-ID")).withColumn("refers_to", page("WARC-Refers-To"))
    rows = rows.withColumn("content_length", field("Content-Length", "[0-9]+").cast("long")).withColumn("header_sha1", field("WARC-Payload-Digest", "sha1:[0-9a-f]+"))
    block = F.when(F.col("content_length") > 0, F.col("payload")).otherwise(F.lit("").cast("binary"))
    return rows.withColumn("record", F.concat("header", block, F.lit(CRLF + CRLF).cast("binary")))


def archive_pages(pages: DataFrame) -> DataFrame:
    """Archives ``pages`` in the shared folder and reads them back: one row per record."""
    path = new_path(pages.sparkSession, "warc")
    write_archive(pages, path)
    records = read_archive(pages.sparkSession, path)
    digest = F.sha1("payload")
    same = F.concat(F.lit("sha1:"), digest) == F.col("header_sha1")
    digest = F.when(same, digest).otherwise(F.raise_error(F.lit("payload digest differs from the header's")).cast("string"))
    return records.select("page_id", F.length("payload").cast("long").alias("payload_bytes"), digest.alias("payload_digest"), "record_type", "refers_to")
