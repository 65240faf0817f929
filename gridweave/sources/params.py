"""Parameter documents: one JSON object per file, any number of files."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def read_parameters(spark: SparkSession, paths, failfast: bool = True) -> DataFrame:
    """Long form ``(source, key, value)`` of the parameter documents.

    ``value`` holds the JSON text of the parameter (strings unquoted; objects and lists as JSON).
    With ``failfast`` one malformed document fails the read, as one bad file rejects the
    submission.
    """
    docs = spark.read.text(paths, wholetext=True).select(
        F.col("_metadata.file_path").alias("source"), "value")
    opts = {"mode": "FAILFAST"} if failfast else {}
    parsed = docs.select("source", F.from_json("value", "map<string,string>", opts).alias("m"))
    return parsed.select("source", F.explode_outer("m").alias("key", "value"))
