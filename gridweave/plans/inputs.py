"""Stand-in inputs: rows in the schemas the operators expect, derived from the driver tables.

These functions only shape rows (names, paths, flags); all work a query's name promises runs in
the operators.  Every input grows with the tables it is derived from.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from gridweave.plans.tables import table
from gridweave.sources.catalog import catalog_from_parts

# Fixed values of the stand-ins: query root, file suffix, group sizes.
QUERY_ROOT = "/grid/data"
SUFFIX = ".sim"
FLAGSHIP_GROUP = 5


def lineitem_dir(prefix: str = QUERY_ROOT):
    """``<root>/<returnflag>/<linestatus>/<ship year>``."""
    return F.concat(F.lit(prefix + "/"), F.col("l_returnflag"), F.lit("/"), F.col("l_linestatus"), F.lit("/"),
                    F.year("l_shipdate").cast("string"))


def lineitem_name():
    """``<orderkey>_<linenumber>_<partkey>_<suppkey>.sim`` (unique per line)."""
    return F.concat(F.concat_ws("_", "l_orderkey", "l_linenumber", "l_partkey", "l_suppkey"), F.lit(SUFFIX))


def lineitem_lfn(prefix: str = QUERY_ROOT):
    return F.concat(lineitem_dir(prefix), F.lit("/"), lineitem_name())


def lineitem_catalog(spark: SparkSession, sf_dir: str) -> DataFrame:
    li = table(spark, sf_dir, "lineitem")
    return catalog_from_parts(li, lineitem_dir(), lineitem_name())


def lineitem_tasks(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """Transformation tasks: one per (returnflag, linestatus); one input per ship year."""
    li = table(spark, sf_dir, "lineitem")
    inputs = (li.select(F.col("l_returnflag").alias("campaign"), F.col("l_linestatus").alias("site"),
                        F.year("l_shipdate").alias("input_pos"))
                .distinct()
                .withColumn("task_id", F.concat_ws("-", "campaign", "site"))
                .withColumn("input_name", F.col("input_pos").cast("string")))
    tasks = inputs.select("task_id", "campaign", "site").distinct()
    return tasks, inputs


def events_catalog(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Catalog of event files: ``/events/<event_type>/<event_id>``, with ``event_id`` kept."""
    ev = table(spark, sf_dir, "events")
    return catalog_from_parts(ev, F.concat(F.lit("/events/"), F.col("event_type")),
                              F.col("event_id").cast("string"), keep=["event_id", "event_type"])
