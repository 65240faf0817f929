"""Text payloads (caesar, base64, md5, rot13, four-step fan-out) and the pi estimate."""

from __future__ import annotations

from pyspark.sql import functions as F

from gridweave.functions.text import base64_text, caesar, md5_text, rot13
from gridweave.session import kept_result, scratch_dir
from gridweave.sources.points import read_points, write_points
from gridweave.operators.points import estimate_pi
from gridweave.operators.text import text_fanout
from gridweave.plans.tables import table

SHIFT = 3


def caesar_documents(spark, sf):
    return table(spark, sf, "documents").select("doc_id", caesar("text", SHIFT).alias("caesar"))


def rot13_documents(spark, sf):
    return table(spark, sf, "documents").select("doc_id", rot13("text").alias("rot13"))


def base64_documents(spark, sf):
    return table(spark, sf, "documents").select("doc_id", base64_text("text").alias("base64"))


def md5_documents(spark, sf):
    return table(spark, sf, "documents").select("doc_id", md5_text("text").alias("md5"))


def text_fanout_conversations(spark, sf):
    return text_fanout(table(spark, sf, "conversations"), "text", ["conv_id", "turn"], SHIFT)


def estimate_pi_lineitem(spark, sf):
    """Points x = 10 * discount, y = 12.5 * tax (both in [0, 1]); one estimate per return flag."""
    pts = table(spark, sf, "lineitem").select(
        "l_returnflag", (F.col("l_discount") * 10).alias("x"), (F.col("l_tax") * 12.5).alias("y"))
    est = estimate_pi(pts, ["l_returnflag"])
    return est.select("l_returnflag", F.round("pi_estimate", 10).alias("pi_estimate"), "n_points",
                      F.col("n_inside").cast("long").alias("n_inside"))


def estimate_pi_first_file(spark, sf):
    """The payload's original behaviour: only the first file (smallest ship year) per flag."""
    pts = table(spark, sf, "lineitem").select(
        "l_returnflag", F.year("l_shipdate").alias("file"),
        (F.col("l_discount") * 10).alias("x"), (F.col("l_tax") * 12.5).alias("y"))
    est = estimate_pi(pts, ["l_returnflag"], first_file_only=True)
    return est.select("l_returnflag", F.round("pi_estimate", 10).alias("pi_estimate"), "n_points")


def read_points_lineitem(spark, sf):
    """Points written as ``x y`` text files (one per partition) to the shared folder, read back
    line by line and estimated over all files."""
    pts = table(spark, sf, "lineitem").select((F.col("l_discount") * 10).alias("x"),
                                              (F.col("l_tax") * 12.5).alias("y"))
    with scratch_dir(spark, "points") as path:
        write_points(pts, path)
        est = estimate_pi(read_points(spark, path))
        return kept_result(est.select(F.round("pi_estimate", 10).alias("pi_estimate"), "n_points",
                                      F.col("n_inside").cast("long").alias("n_inside")))


# DuckDB has no Unicode letter class or lower-case test per character that matches Python's;
# RE2's \p{L} and \p{Ll} (plus the two ordinal indicators) are used, which agree on this data.
_CAESAR_SQL = """
SELECT doc_id,
  array_to_string(list_transform(string_split(text, ''), lambda c:
    CASE WHEN regexp_matches(c, '^\\p{L}$') THEN
      chr(CAST(((unicode(lower(c)) - 97 + 3) % 26 + 26) % 26
               + CASE WHEN regexp_matches(c, '^[\\p{Ll}ªº]$') THEN 97 ELSE 65 END AS INTEGER))
    ELSE c END), '') AS caesar
FROM documents
"""

_ROT13_SQL = """
SELECT doc_id, translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz',
                               'NOPQRSTUVWXYZABCDEFGHIJKLMnopqrstuvwxyzabcdefghijklm') AS rot13
FROM documents
"""

_FANOUT_SQL = """
SELECT conv_id, turn,
  array_to_string(list_transform(string_split(text, ''), lambda c:
    CASE WHEN regexp_matches(c, '^\\p{L}$') THEN
      chr(CAST(((unicode(lower(c)) - 97 + 3) % 26 + 26) % 26
               + CASE WHEN regexp_matches(c, '^[\\p{Ll}ªº]$') THEN 97 ELSE 65 END AS INTEGER))
    ELSE c END), '') AS caesar,
  to_base64(encode(text)) AS base64,
  md5(text) AS md5,
  translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz',
                  'NOPQRSTUVWXYZABCDEFGHIJKLMnopqrstuvwxyzabcdefghijklm') AS rot13
FROM conversations
"""

_PI_SQL = """
SELECT l_returnflag,
  round(4 * avg(CASE WHEN sqrt((l_discount * 10) * (l_discount * 10) + (l_tax * 12.5) * (l_tax * 12.5)) <= 1
                     THEN 1 ELSE 0 END), 10) AS pi_estimate,
  count(*) AS n_points,
  CAST(sum(CASE WHEN sqrt((l_discount * 10) * (l_discount * 10) + (l_tax * 12.5) * (l_tax * 12.5)) <= 1
           THEN 1 ELSE 0 END) AS BIGINT) AS n_inside
FROM lineitem GROUP BY l_returnflag
"""

_PI_FIRST_SQL = """
WITH f AS (SELECT l_returnflag, min(year(l_shipdate)) AS y FROM lineitem GROUP BY l_returnflag)
SELECT l.l_returnflag,
  round(4 * avg(CASE WHEN sqrt((l_discount * 10) * (l_discount * 10) + (l_tax * 12.5) * (l_tax * 12.5)) <= 1
                     THEN 1 ELSE 0 END), 10) AS pi_estimate,
  count(*) AS n_points
FROM lineitem l JOIN f ON l.l_returnflag = f.l_returnflag AND year(l.l_shipdate) = f.y
GROUP BY l.l_returnflag
"""

_PI_ALL_SQL = """
SELECT round(4 * avg(CASE WHEN sqrt((l_discount * 10) * (l_discount * 10) + (l_tax * 12.5) * (l_tax * 12.5)) <= 1
                          THEN 1 ELSE 0 END), 10) AS pi_estimate,
       count(*) AS n_points,
       CAST(sum(CASE WHEN sqrt((l_discount * 10) * (l_discount * 10) + (l_tax * 12.5) * (l_tax * 12.5)) <= 1
                THEN 1 ELSE 0 END) AS BIGINT) AS n_inside
FROM lineitem
"""

QUERIES = {
    "caesar_documents": (caesar_documents, _CAESAR_SQL),
    "rot13_documents": (rot13_documents, _ROT13_SQL),
    "base64_documents": (base64_documents, "SELECT doc_id, to_base64(encode(text)) AS base64 FROM documents"),
    "md5_documents": (md5_documents, "SELECT doc_id, md5(text) AS md5 FROM documents"),
    "text_fanout_conversations": (text_fanout_conversations, _FANOUT_SQL),
    "estimate_pi_lineitem": (estimate_pi_lineitem, _PI_SQL),
    "estimate_pi_first_file": (estimate_pi_first_file, _PI_FIRST_SQL),
    "read_points_lineitem": (read_points_lineitem, _PI_ALL_SQL),
}
