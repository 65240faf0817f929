"""Jobs from a stream of groups: rendered and written once per micro-batch, idempotently."""

from __future__ import annotations

from pyspark.sql import DataFrame

from gridweave.session import kept_result, scratch_dir

# Fixed value: how often a waiting transformation looks for new catalog entries.
POLL_INTERVAL = "5 seconds"


def stream_jobs(groups: DataFrame, out_path: str, checkpoint: str, to_jobs, trigger: dict | None = None):
    """Start a query that turns every micro-batch of groups into job rows and writes them.

    ``to_jobs(batch_df) -> DataFrame`` builds the job rows (e.g. text via ``render_job_text``).
    Each batch is written to ``out_path/batch_id=<id>`` with overwrite, so a batch replayed after
    a failure replaces its own output instead of duplicating it.  The default trigger processes
    what is there and stops; ``trigger={"processingTime": POLL_INTERVAL}`` keeps a transformation
    running and picks new entries up every 5 seconds.
    """
    def write(batch: DataFrame, batch_id: int) -> None:
        jobs = to_jobs(batch)
        jobs.write.mode("overwrite").parquet(f"{out_path.rstrip('/')}/batch_id={batch_id}")

    w = groups.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint)
    w = w.trigger(**(trigger or {"availableNow": True}))
    return w.start()


def run_to_table(stream: DataFrame, name: str, fmt: str = "parquet") -> DataFrame:
    """Run a streaming frame over everything available now; return what it wrote, as a table.

    Output and checkpoint go below the session's checkpoint folder (the shared folder on a
    cluster), never through the driver; they are removed once the result is checkpointed.
    """
    spark = stream.sparkSession
    with scratch_dir(spark, f"streams/{name}") as base:
        q = (stream.writeStream.format(fmt).outputMode("append")
                   .option("checkpointLocation", f"{base}/_checkpoint")
                   .option("path", f"{base}/data")
                   .trigger(availableNow=True).start())
        _finish(q)
        return kept_result(spark.read.schema(stream.schema).format(fmt).load(f"{base}/data"))


def run_jobs_to_table(groups: DataFrame, name: str, to_jobs) -> DataFrame:
    spark = groups.sparkSession
    with scratch_dir(spark, f"streams/{name}") as base:
        _finish(stream_jobs(groups, f"{base}/data", f"{base}/_checkpoint", to_jobs))
        return kept_result(spark.read.parquet(f"{base}/data").drop("batch_id"))


def _finish(query) -> None:
    query.awaitTermination()
    if query.exception():
        raise query.exception()


__all__ = ["POLL_INTERVAL", "stream_jobs", "run_to_table", "run_jobs_to_table"]
