"""Content-addressed WARC archive: payloads once by digest, exact record headers beside them.

An archive is two Parquet tables in one folder: ``payloads`` has one row per distinct payload,
keyed by its SHA-256, and ``headers`` one row per record with its exact WARC header bytes, its HTTP
header bytes and the key of its payload.  Reading joins the two.  DataFrame functions only.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from gridweave.llm.common import materialize, scratch_path, text_or_empty

#: Fixed: the base32 alphabet of payload digests, and its stand-in digits of ``conv``.
_BASE32, _DIGITS = "ABCDEFGHIJKLMNOPQRSTUVWXYZ234567", "0123456789ABCDEFGHIJKLMNOPQRSTUV"
_PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"


def base32(hex_digest: Column) -> Column:
    """Upper-case base32 of a digest of 5n bytes given in hexadecimal (20 bits to 4 letters)."""
    chunks = [F.lpad(F.conv(F.substring(hex_digest, 1 + 5 * i, 5), 16, 32), 4, "0") for i in range(8)]
    return F.translate(F.concat(*chunks), _DIGITS, _BASE32)


def _urn(*parts: Column) -> Column:
    h = F.md5(F.concat_ws("\n", *parts))
    cut = [F.substring(h, a, n) for a, n in ((1, 8), (9, 4), (13, 4), (17, 4), (21, 12))]
    return F.concat(F.lit("<urn:uuid:"), F.concat_ws("-", *cut), F.lit(">"))


def _header(*lines: Column) -> Column:
    """Header lines with CRLF ends and the closing empty line; null lines are left out."""
    return F.concat(F.concat_ws("\r\n", *lines), F.lit("\r\n\r\n")).cast("binary")


def _line(name: str, value: Column) -> Column:
    return F.concat(F.lit(f"{name}: "), value.cast("string"))


def write_archive(pages: DataFrame, path: str, id_col: str = "page_id", url_col: str = "url", body_col: str = "html",
                  min_revisit_bytes: int = 0, warc_date: str = "1970-01-01T00:00:00Z") -> None:
    """Write one record per row of ``pages`` below ``path``.

    Among records with equal payloads of at least ``min_revisit_bytes`` the one with the largest id
    is the response and the others revisit it (of repeated rows of that id one is the response);
    smaller payloads are all responses.  Null bodies are empty payloads.  Records without an id
    revisit one that has an id, and are responses where none of their payload has.  Two different
    payloads under one SHA-256 would show in their SHA-1 or length and stop the job.
    """
    body = text_or_empty(body_col).cast("binary")
    src = pages.select(F.col(id_col).cast("long").alias("page_id"), F.col(url_col).cast("string").alias("url"),
                       body.alias("payload")).withColumn("key", F.sha2("payload", 256))
    records = materialize(src.select(
        "page_id", "url", "key", F.sha1("payload").alias("sha1"), F.octet_length("payload").cast("long").alias("size"),
        F.monotonically_increasing_id().alias("row")), "warc-records")
    stored = records.groupBy("key").agg(F.max("page_id").alias("first_id"), F.max_by("row", "page_id").alias("first_row"),
                                        F.min("sha1").alias("a"), F.max("sha1").alias("b"),
                                        F.min("size").alias("s"), F.max("size").alias("l"))
    clash = F.raise_error(F.lit("different payloads share a SHA-256 digest"))
    stored = stored.withColumn("first_id", F.when((F.col("a") == F.col("b")) & (F.col("s") == F.col("l")),
                                                  F.col("first_id")).otherwise(clash)).drop("a", "b", "s", "l")
    stored = materialize(stored, "warc-keys")

    # one column names the stored row, so joining and taking one of its repeats share a shuffle
    def pick(id_col):
        return F.concat_ws(":", "key", F.coalesce(F.col(id_col).cast("string"), F.lit("-"))).alias("pick")

    (src.select(pick("page_id"), "key", "payload").join(stored.select(pick("first_id")), "pick", "left_semi")
     .dropDuplicates(["pick"]).select("key", "payload")
     .write.option("compression", "zstd").parquet(f"{path}/payloads"))

    r = records.join(stored, "key")
    revisit = (F.col("size") >= min_revisit_bytes) & F.col("first_row").isNotNull() & (F.col("row") != F.col("first_row"))
    r = r.withColumn("revisit", F.coalesce(revisit, F.lit(False)))
    http = _header(F.lit("HTTP/1.1 200 OK"), F.lit("Content-Type: text/html; charset=utf-8"),
                   _line("Content-Length", F.col("size")))
    r = r.withColumn("http_header", http)
    name, url = F.col("page_id").cast("string"), F.coalesce("url", F.lit(""))
    block = F.octet_length("http_header") + F.when(F.col("revisit"), F.lit(0)).otherwise(F.col("size"))
    r = r.withColumn("warc_header", _header(
        F.lit("WARC/1.1"), F.when(F.col("revisit"), F.lit("WARC-Type: revisit")).otherwise(F.lit("WARC-Type: response")),
        _line("WARC-Record-ID", _urn(F.coalesce(name, F.lit("")), F.col("key"), F.col("row").cast("string"))),
        _line("WARC-Target-URI", F.regexp_replace(url, r"[\r\n]+", " ")), F.lit(f"WARC-Date: {warc_date}"),
        _line("WARC-Payload-Digest", F.concat(F.lit("sha1:"), base32(F.col("sha1")))),
        F.when(F.col("revisit"), F.lit(f"WARC-Profile: {_PROFILE}")),
        F.when(F.col("revisit"), _line("X-Refers-To-Page", F.col("first_id"))),
        F.lit("Content-Type: application/http;msgtype=response"), _line("Content-Length", block)))
    r.select("page_id", "url", "key", "warc_header", "http_header").write.parquet(f"{path}/headers")


def read_archive(spark: SparkSession, path: str) -> DataFrame:
    """Every record again: (page_id, url, payload, payload_bytes, payload_digest, record_type,
    refers_to, record).

    ``payload`` is the full payload of any record; ``record`` the exact record bytes (a revisit has
    no payload in its block).  Type, digest and reference are parsed from the stored header; a
    payload whose SHA-256 or SHA-1 is not the stored one stops the job.
    """
    blobs = spark.read.schema("key string, payload binary").parquet(f"{path}/payloads")
    bad = F.raise_error(F.concat(F.lit("damaged payload "), F.col("key")))
    blobs = blobs.select(F.when(F.sha2("payload", 256) == F.col("key"), F.col("key")).otherwise(bad).alias("key"), "payload",
                         base32(F.sha1("payload")).alias("found"), F.octet_length("payload").cast("long").alias("payload_bytes"))
    heads = spark.read.schema("page_id long, url string, key string, warc_header binary, http_header binary"
                              ).parquet(f"{path}/headers")
    text = F.col("warc_header").cast("string")

    def value(name):
        got = F.regexp_extract(text, rf"\r\n{name}: ([^\r\n]*)", 1)
        return F.when(got != "", got)

    digest = F.substring(value("WARC-Payload-Digest"), 6, 64)
    heads = heads.select("*", digest.alias("payload_digest"), value("WARC-Type").alias("record_type"),
                         value("X-Refers-To-Page").cast("long").alias("refers_to"))
    out = heads.join(blobs, "key", "left")
    agree = F.raise_error(F.concat(F.lit("payload of record does not have its digest "), F.col("payload_digest")))
    out = out.withColumn("payload_digest", F.when(F.col("found") == F.col("payload_digest"), F.col("found")).otherwise(agree))
    body = F.when(F.col("record_type") == "revisit", F.lit(b"")).otherwise(F.col("payload"))
    record = F.concat("warc_header", "http_header", body, F.lit(b"\r\n\r\n"))
    return out.select("page_id", "url", "payload", "payload_bytes", "payload_digest", "record_type", "refers_to",
                      record.alias("record"))


def query(spark, sf_dir):
    """All pages written as a content-addressed archive and read back."""
    path = scratch_path(spark, "warc")
    write_archive(spark.read.parquet(f"{sf_dir}/pages.parquet"), path)
    return read_archive(spark, path).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


SQL = """
WITH p AS (SELECT page_id, coalesce(html, '') AS body FROM pages),
d AS (SELECT page_id, strlen(body) AS payload_bytes, sha1(body) AS h, sha256(body) AS k FROM p),
g AS (SELECT k, max(page_id) AS first_id FROM d GROUP BY k)
SELECT page_id, CAST(payload_bytes AS BIGINT) AS payload_bytes,
       array_to_string([substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567',
                               CAST((CAST('0x' || substr(h, 1 + 5 * (i // 4), 5) AS BIGINT) >> (15 - 5 * (i % 4))) & 31 AS INTEGER) + 1, 1)
                        for i in range(32)], '') AS payload_digest,
       CASE WHEN page_id = first_id THEN 'response' ELSE 'revisit' END AS record_type,
       CASE WHEN page_id <> first_id THEN first_id END AS refers_to
FROM d JOIN g USING (k)
"""
