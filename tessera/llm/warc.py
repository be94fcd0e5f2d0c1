"""WARC archives with revisit resolution.

Headers (page id, payload size, payload digest) are grouped by digest; every page of a group but
the original becomes a ``revisit`` record that refers to it, and all records are written with fresh
headers. The text sink writes a record a row (its line separator is the blank line that ends a WARC
record), so the archives land in any store that Spark reaches, and the text source splits them again
at record starts. All of it runs in the JVM.

A record starts with ``WARC/1.1`` and a ``WARC-Boundary`` field that holds a random mark of this
archive; the mark, known only after the payloads exist, keeps record starts inside payloads from
being taken for real ones, and Content-Length plus the payload digest are checked on reading.

Defined results: a null html is an empty payload; payloads below ``min_bytes`` are always responses;
rows with the same page_id and payload as the original are all responses; a group whose page ids are
all null consists of responses; a null url becomes ``about:blank``; an empty table gives empty
archives and no rows; other columns of the input are ignored.
"""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.llm.common import scratch, table

#: Payloads from this size on are deduplicated.
MIN_BYTES = 1000
#: A digest's pages are dealt to so many tasks; the originals, one row a repeated digest, are copied to each.
SALTS = 32
#: WARC-Date of the records; the input has no fetch time.
FETCHED = "1970-01-01T00:00:00Z"
CRLF = "\r\n"
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"


def payloads(pages: DataFrame) -> DataFrame:
    """page_id, url, payload, payload_bytes, payload_digest."""
    payload = F.coalesce(F.col("html"), F.lit(""))
    return pages.select(
        F.col("page_id").cast("long").alias("page_id"),
        F.col("url").cast("string").alias("url"),
        payload.alias("payload"),
        F.octet_length(payload).cast("long").alias("payload_bytes"),
        F.sha1(payload.cast("binary")).alias("payload_digest"),
    )


def originals(headers: DataFrame, min_bytes: int = MIN_BYTES) -> DataFrame:
    """payload_digest, original: the largest page id of each digest that occurs more than once."""
    return (
        headers.filter(F.col("payload_bytes") >= min_bytes)
        .groupBy("payload_digest")
        .agg(F.max("page_id").alias("original"), F.count(F.lit(1)).alias("copies"))
        .filter(F.col("copies") > 1)
        .select("payload_digest", "original")
    )


def resolve_revisits(pages: DataFrame, min_bytes: int = MIN_BYTES, salts: int = SALTS) -> DataFrame:
    """The payload rows with record_type and refers_to."""
    rows = payloads(pages)
    firsts = originals(rows, min_bytes).select(
        "payload_digest", "original", F.explode(F.sequence(F.lit(0), F.lit(salts - 1))).alias("salt")
    )
    salted = rows.withColumn("salt", F.pmod(F.xxhash64("page_id", "url"), F.lit(salts)).cast("int"))
    is_revisit = F.col("page_id").isNull() & F.col("original").isNotNull() | (F.col("page_id") != F.col("original"))
    joined = salted.join(firsts.hint("shuffle_hash"), ["payload_digest", "salt"], "left")
    return joined.withColumn("is_revisit", F.coalesce(is_revisit, F.lit(False))).select(
        "page_id",
        "url",
        "payload",
        "payload_bytes",
        "payload_digest",
        F.when(F.col("is_revisit"), "revisit").otherwise("response").alias("record_type"),
        F.when(F.col("is_revisit"), F.col("original")).alias("refers_to"),
    )


def _record_id(page_id: Column) -> Column:
    h = F.md5(F.concat(F.lit("page:"), F.coalesce(page_id.cast("string"), F.lit("null"))).cast("binary"))
    parts = [F.substring(h, at, n) for at, n in ((1, 8), (9, 4), (13, 4), (17, 4), (21, 12))]
    return F.concat(F.lit("<urn:uuid:"), F.concat_ws("-", *parts), F.lit(">"))


def write_archives(resolved: DataFrame, path: str, fetched: str = FETCHED, codec: str = "gzip") -> str:
    """Write the records below ``path``; returns the archive's boundary mark."""
    mark = uuid.uuid4().hex
    revisit = F.col("record_type") == "revisit"
    http = F.concat(
        F.lit(f"HTTP/1.1 200 OK{CRLF}Content-Type: text/html; charset=utf-8{CRLF}Content-Length: "),
        F.col("payload_bytes").cast("string"),
        F.lit(CRLF * 2),
    )
    block = F.when(revisit, http).otherwise(F.concat(http, F.col("payload")))
    fields = [
        ("WARC-Type", F.col("record_type")),
        ("WARC-Record-ID", _record_id(F.col("page_id"))),
        ("WARC-Date", F.lit(fetched)),
        ("WARC-Target-URI", F.coalesce(F.regexp_replace("url", r"\s", "%20"), F.lit("about:blank"))),
        ("WARC-Payload-Digest", F.concat(F.lit("sha1:"), F.col("payload_digest"))),
        ("WARC-Profile", F.when(revisit, F.lit(PROFILE))),
        ("WARC-Refers-To", F.when(revisit, _record_id(F.col("refers_to")))),
        ("X-Page-ID", F.col("page_id").cast("string")),
        ("X-Refers-To-Page-ID", F.col("refers_to").cast("string")),
        ("Content-Type", F.lit("application/http; msgtype=response")),
        ("Content-Length", F.octet_length("block").cast("string")),
    ]
    lines = [F.concat(F.lit(f"{name}: "), value) for name, value in fields]  # null where the field is absent
    head = F.concat_ws(CRLF, F.lit("WARC/1.1"), F.lit(f"WARC-Boundary: {mark}"), *lines)
    rows = resolved.withColumn("block", block).select(F.concat(head, F.lit(CRLF * 2), F.col("block")).alias("value"))
    rows.write.option("lineSep", CRLF * 2).option("compression", codec).text(path)
    return mark


def read_archives(spark: SparkSession, path: str, mark: str) -> DataFrame:
    """page_id, url, record_type, refers_to, payload (null for revisits), payload_bytes, payload_digest.

    Fails on a record whose payload is not what its headers say.
    """
    raw = spark.read.option("lineSep", f"WARC/1.1{CRLF}WARC-Boundary: {mark}{CRLF}").text(path).filter("value <> ''")
    head = F.substring_index("value", CRLF * 2, 1)
    parts = raw.select("value", head.alias("head")).withColumn("fields", F.str_to_map("head", F.lit(CRLF), F.lit(": ")))
    field = lambda name: F.col("fields")[name]
    body = F.col("value").cast("binary")
    block_at = F.octet_length("head") + 5
    http = F.substring_index(F.substring("value", F.char_length("head") + 5, F.lit(256)), CRLF * 2, 1)
    size = F.regexp_extract("http", r"Content-Length: (\d+)", 1).cast("long")
    read = (
        parts.withColumn("http", http)
        .withColumn("payload_bytes", size)
        .withColumn(
            "payload",
            F.when(
                field("WARC-Type") == "response",
                F.substring(body, block_at + F.octet_length("http") + 4, F.col("payload_bytes").cast("int")),
            ),
        )
    )
    stated = F.substring(field("WARC-Payload-Digest"), 6, 40)
    intact = F.col("payload").isNull() | (
        (F.sha1("payload") == stated)
        & (F.octet_length("payload") == F.col("payload_bytes"))
        & (field("Content-Length").cast("long") == F.octet_length("http") + 4 + F.col("payload_bytes"))
    )
    return read.select(
        field("X-Page-ID").cast("long").alias("page_id"),
        field("WARC-Target-URI").alias("url"),
        field("WARC-Type").alias("record_type"),
        field("X-Refers-To-Page-ID").cast("long").alias("refers_to"),
        "payload",
        "payload_bytes",
        F.when(intact, stated).otherwise(F.raise_error(F.concat(F.lit("damaged WARC record: "), "head"))).alias("payload_digest"),
    )


def op4_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = scratch(spark, "warc")
    mark = write_archives(resolve_revisits(table(spark, sf_dir, "pages")), path)
    return read_archives(spark, path, mark).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


QUERIES = {"op4_warc": op4_warc}
ORACLES = {
    "op4_warc": """
        WITH p AS (SELECT page_id, strlen(coalesce(html, ''))::BIGINT AS payload_bytes,
                          sha1(coalesce(html, '')) AS payload_digest FROM pages),
             g AS (SELECT payload_digest, max(page_id) AS original FROM p WHERE payload_bytes >= 1000 GROUP BY 1)
        SELECT p.page_id, p.payload_bytes, p.payload_digest,
               CASE WHEN g.original <> p.page_id THEN 'revisit' ELSE 'response' END AS record_type,
               CASE WHEN g.original <> p.page_id THEN g.original END AS refers_to
        FROM p LEFT JOIN g ON p.payload_digest = g.payload_digest AND p.payload_bytes >= 1000
    """
}
