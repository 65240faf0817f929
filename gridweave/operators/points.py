"""Monte Carlo estimate of pi from points in the square [-1, 1]^2."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gridweave.operators._joins import null_safe_join


def inside_unit_circle(x: str = "x", y: str = "y"):
    return F.sqrt(F.col(x) * F.col(x) + F.col(y) * F.col(y)) <= 1


def estimate_pi(points: DataFrame, keys: Sequence[str] = (), x: str = "x", y: str = "y",
                first_file_only: bool = False, file_col: str = "file") -> DataFrame:
    """``4 * inside / total`` per group (null for a group without points).

    All files of a group are used; ``first_file_only`` keeps only the points of the smallest
    file name of each group (the payload's original behaviour).  A partial aggregation: any
    number of points per group.
    """
    keys = list(keys)
    if first_file_only:
        gk = keys or ["_all"]
        pts = points if keys else points.withColumn("_all", F.lit(0))
        first = pts.groupBy(*gk).agg(F.min(file_col).alias("_first"))
        points = (null_safe_join(pts, first, gk).filter(F.col(file_col) == F.col("_first"))
                     .drop("_first", *([] if keys else ["_all"])))
    inside = F.when(inside_unit_circle(x, y), 1).otherwise(0)
    aggs = [(F.lit(4.0) * F.avg(inside)).alias("pi_estimate"),
            F.count(F.lit(1)).alias("n_points"),
            F.sum(inside).alias("n_inside")]
    return points.groupBy(*keys).agg(*aggs) if keys else points.agg(*aggs)
