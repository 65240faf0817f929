"""Points of the Monte Carlo payload: text lines ``x y``."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def read_points(spark: SparkSession, paths, permissive: bool = False) -> DataFrame:
    """One row ``(file, x, y)`` per text line; each line must hold exactly two numbers.

    A bad line fails the job (as the payload does) unless ``permissive``: then ``x``/``y`` are
    null and ``reject`` holds the line.
    """
    lines = spark.read.text(paths).select(F.col("_metadata.file_path").alias("file"), "value")
    tokens = F.split(F.trim("value"), r"\s+")
    good = (F.size(tokens) == 2) & tokens[0].try_cast("double").isNotNull() \
        & tokens[1].try_cast("double").isNotNull()
    if permissive:
        return lines.select(
            "file",
            F.when(good, tokens[0].cast("double")).alias("x"),
            F.when(good, tokens[1].cast("double")).alias("y"),
            F.when(~good, F.col("value")).alias("reject"))
    checked = F.when(good, tokens).otherwise(
        F.raise_error(F.concat(F.lit("bad point line: "), F.col("value"))).cast("array<string>"))
    return (lines.select("file", checked.alias("t"))
                 .select("file", F.col("t")[0].cast("double").alias("x"),
                         F.col("t")[1].cast("double").alias("y")))


def uniform_points(spark: SparkSession, n: int, seed: int = 0, partitions: int | None = None) -> DataFrame:
    """``n`` points with x and y uniform in [-1, 1); generated on the executors."""
    ids = spark.range(0, n, 1, partitions) if partitions else spark.range(n)
    return ids.select((F.rand(seed) * 2 - 1).alias("x"), (F.rand(seed + 1) * 2 - 1).alias("y"))


def write_points(points: DataFrame, path: str, mode: str = "error") -> None:
    points.select(F.concat_ws(" ", F.col("x").cast("string"), F.col("y").cast("string"))).write.mode(mode).text(path)
