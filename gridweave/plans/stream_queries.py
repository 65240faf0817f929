"""Streaming queries: the driver tables replayed as file streams, a few files per micro-batch.

A table is a folder of part files or one file; both are streamed.  The operators keep their state
across batches (see the tests, which feed several batches).
"""

from __future__ import annotations

from pyspark.sql import functions as F

from gridweave.functions.lfn import lfn_location
from gridweave.operators.jobs import EXECUTABLE_LINE, render_job_text
from gridweave.plans.catalog_queries import _GROUPS_SQL
from gridweave.session import is_directory, kept_result, scratch_dir
from gridweave.streaming.grouping import (
    catalog_stream,
    stream_fixed_groups,
    stream_fixed_groups_batched,
    stream_new_entries,
    stream_zip_groups,
    stream_zip_groups_batched,
)
from gridweave.streaming.jobs import run_jobs_to_table, run_to_table
from gridweave.streaming.seen import stream_new_entries_batched

# Files of a table taken per micro-batch, and the sizes of the groups of one user's events.
FILES_PER_BATCH = 4
USER_GROUP = 3


def _table_stream(spark, sf, name):
    path = f"{sf.rstrip('/')}/{name}.parquet"
    schema = spark.read.parquet(path).schema
    if is_directory(spark, path):
        return catalog_stream(spark, path, schema=schema, max_files_per_trigger=FILES_PER_BATCH)
    return catalog_stream(spark, sf, schema=schema, glob=f"{name}.parquet", max_files_per_trigger=FILES_PER_BATCH)


def stream_fixed_groups_events(spark, sf):
    """Groups of three events per user and event type, state in the state store."""
    ev = _table_stream(spark, sf, "events").select("user_id", "event_type", "event_id")
    g = stream_fixed_groups(ev, ["user_id", "event_type"], order="event_id", size=USER_GROUP)
    out = run_to_table(g, "stream_fixed_groups_events")
    return out.select("user_id", "event_type", "gid", F.array_join("members", ",").alias("members"), "n")


def _batched(spark, name, start):
    """Run a batched query over everything available; ``start(base)`` starts it below ``base``."""
    with scratch_dir(spark, f"streams/{name}") as base:
        q = start(base)
        q.awaitTermination()
        return kept_result(spark.read.parquet(f"{base}/data"))


def stream_fixed_groups_batched_events(spark, sf):
    """Groups of seven events per type, five keys that hold the whole table: cut by Spark jobs per
    micro-batch (hot keys split), state on shared storage."""
    ev = _table_stream(spark, sf, "events").select("event_type", "event_id")
    out = _batched(spark, "batched-groups", lambda base: stream_fixed_groups_batched(
        ev, ["event_type"], "event_id", 7, f"{base}/data", f"{base}/state", f"{base}/_checkpoint"))
    return out.select("event_type", "gid", F.array_join("members", ",").alias("members"), "n")


def _user_events(spark, sf):
    return _table_stream(spark, sf, "events").select("user_id", "event_type", "event_id")


def stream_zip_groups_events(spark, sf):
    """One task per user: job i takes the i-th three clicks and the i-th three views."""
    z = stream_zip_groups(_user_events(spark, sf), ["user_id"], "event_type", ["click", "view"], order="event_id",
                          size=USER_GROUP)
    out = run_to_table(z, "stream_zip_groups_events")
    return out.select("user_id", "gid", F.array_join(F.col("members")[0], ",").alias("click_members"),
                      F.array_join(F.col("members")[1], ",").alias("view_members"))


def _zip_batched(spark, sf):
    users = spark.read.parquet(f"{sf}/events.parquet").select("user_id").distinct()
    inputs = users.select("user_id", F.explode(F.array(
        F.struct(F.lit("click").alias("event_type"), F.lit(0).alias("input_pos")),
        F.struct(F.lit("view").alias("event_type"), F.lit(1).alias("input_pos")))).alias("i")).select("user_id", "i.*")
    ev = _user_events(spark, sf).filter(F.col("event_type").isin("click", "view"))
    return _batched(spark, "batched-zip", lambda base: stream_zip_groups_batched(
        ev, ["user_id"], "event_type", inputs, "event_id", USER_GROUP, f"{base}/data", f"{base}/state", f"{base}/_checkpoint"))


def stream_zip_groups_batched_events(spark, sf):
    """The same jobs zipped by Spark jobs per micro-batch; waiting groups kept per task."""
    return _zip_batched(spark, sf).select(
        "user_id", "gid", F.array_join(F.col("inputs")[0]["members"], ",").alias("click_members"),
        F.array_join(F.col("inputs")[1]["members"], ",").alias("view_members"))


def stream_new_entries_lineitem(spark, sf):
    """Each order once, announced by its lines; a replayed table has no bound on how late a line is, so
    seen keys are kept for the life of the query."""
    li = _table_stream(spark, sf, "lineitem").select(
        F.concat(F.lit("/orders/"), F.col("l_orderkey").cast("string")).alias("lfn"))
    return run_to_table(stream_new_entries(li), "stream_new_entries_lineitem").select("lfn")


def _user_jobs(batch):
    refs = F.flatten(F.transform("inputs", lambda i: F.transform(i["members"], lambda v: lfn_location(
        F.concat(F.lit("/events/"), i["input_name"], F.lit("/"), v)))))
    name = F.concat_ws("_", F.col("user_id").cast("string"), F.col("gid").cast("string"))
    jobs = batch.withColumn("input_refs", refs).withColumn(
        "sandbox_id", F.concat(F.lit("SB:SandboxSE|/S3/sandbox-store/"), name, F.lit(".tar.zst")))
    return jobs.select("user_id", "gid", render_job_text(jobs).alias("jdl"))


def stream_jobs_events(spark, sf):
    """The zipped jobs of every user, streamed from the table the batched zip wrote, turned into
    submission text per micro-batch."""
    zipped = _zip_batched(spark, sf)
    with scratch_dir(spark, "streams/zipped") as path:
        zipped.drop("batch_id").write.parquet(path)
        stream = catalog_stream(spark, path, schema=zipped.drop("batch_id").schema, max_files_per_trigger=FILES_PER_BATCH)
        return run_jobs_to_table(stream, "stream_jobs_events", _user_jobs)


_USER_GROUPS = """
r AS (SELECT user_id, event_type, event_id,
             row_number() OVER (PARTITION BY user_id, event_type ORDER BY event_id) AS rn FROM events),
g AS (SELECT user_id, event_type, CAST((rn - 1) // 3 AS BIGINT) AS gid,
             string_agg(CAST(event_id AS VARCHAR), ',' ORDER BY rn) AS members,
             string_agg('LFN:/events/' || event_type || '/' || event_id, ', ' ORDER BY rn) AS refs,
             count(*) AS n FROM r GROUP BY user_id, event_type, (rn - 1) // 3 HAVING count(*) = 3)"""

_USER_GROUPS_SQL = f"WITH {_USER_GROUPS}\nSELECT user_id, event_type, gid, members, n FROM g"

_PAIRS = "FROM g c JOIN g v ON c.user_id = v.user_id AND c.gid = v.gid AND c.event_type = 'click' AND v.event_type = 'view'"

_USER_ZIP_SQL = f"""WITH {_USER_GROUPS}
SELECT c.user_id, c.gid, c.members AS click_members, v.members AS view_members {_PAIRS}"""

_STREAM_JOBS_SQL = f"""WITH {_USER_GROUPS}
SELECT c.user_id, c.gid,
       '{EXECUTABLE_LINE}' || chr(10) || 'Arguments = job.json;' || chr(10) ||
       'JobName = test;' || chr(10) || 'OutputSandbox = {{std.out, std.err}};' || chr(10) ||
       'Priority = 10;' || chr(10) ||
       'InputSandbox = SB:SandboxSE|/S3/sandbox-store/' || c.user_id || '_' || c.gid || '.tar.zst;' || chr(10) ||
       'InputData = ' || c.refs || ', ' || v.refs || ';' AS jdl
{_PAIRS}"""

def stream_new_entries_batched_lineitem(spark, sf):
    """Every order announced by its lines, once: the seen keys as a filtered table on shared storage."""
    li = _table_stream(spark, sf, "lineitem").select(F.concat(F.lit("/orders/"), F.col("l_orderkey").cast("string")).alias("lfn"))
    return _batched(spark, "new-entries", lambda base: stream_new_entries_batched(
        li, "lfn", f"{base}/data", f"{base}/state", f"{base}/_checkpoint")).select("lfn")


QUERIES = {
    "stream_fixed_groups_events": (stream_fixed_groups_events, _USER_GROUPS_SQL),
    "stream_fixed_groups_batched_events": (stream_fixed_groups_batched_events, _GROUPS_SQL),
    "stream_zip_groups_events": (stream_zip_groups_events, _USER_ZIP_SQL),
    "stream_zip_groups_batched_events": (stream_zip_groups_batched_events, _USER_ZIP_SQL),
    "stream_new_entries_lineitem": (stream_new_entries_lineitem,
                                    "SELECT DISTINCT '/orders/' || l_orderkey AS lfn FROM lineitem"),
    "stream_new_entries_batched_lineitem": (stream_new_entries_batched_lineitem,
                                            "SELECT DISTINCT '/orders/' || l_orderkey AS lfn FROM lineitem"),
    "stream_jobs_events": (stream_jobs_events, _STREAM_JOBS_SQL),
}
