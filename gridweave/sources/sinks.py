"""Sinks: ordered fallback targets and the merged text output of a job."""

from __future__ import annotations

import re
import uuid
from collections.abc import Sequence
from urllib.parse import unquote

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from gridweave.session import checkpoint_dir, delete_path, path_exists


class StoreError(RuntimeError):
    pass


def write_with_fallback(df: DataFrame, targets: Sequence[str], fmt: str = "parquet",
                        mode: str = "errorifexists", **options) -> str | None:
    """Write ``df`` to the first target that accepts it; return that target.

    The rows are computed once, into the session's checkpoint folder; an error of the query itself
    is raised there and never taken for a storage failure.  The stored copy is then written to the
    targets in order; what a failed attempt has left on a target that was not there before is
    removed.  When all fail a ``StoreError`` lists every failure.  With no target at all nothing is
    written and ``None`` is returned (the caller reports "not stored").
    """
    if not targets:
        return None
    spark = df.sparkSession
    staged = f"{checkpoint_dir(spark).rstrip('/')}/staging/{uuid.uuid4().hex}"
    df.write.parquet(staged)
    failures = []
    try:
        for target in targets:
            there = path_exists(spark, target)
            try:
                spark.read.schema(df.schema).parquet(staged).write.format(fmt).mode(mode).options(**options).save(target)
                return target
            except Exception as exc:  # noqa: BLE001 - every failure of a target is reported
                failures.append(f"{target}: {type(exc).__name__}: {str(exc).splitlines()[0] if str(exc) else ''}")
                if there is False:
                    delete_path(spark, target)
    finally:
        delete_path(spark, staged)
    raise StoreError("could not store output; " + " | ".join(failures))


# The merged file name, the header marker and the order of the patterns.
GROUP_FILE = "group.out"
HEADER = "############ "
PATTERNS = ("*.out", "*.txt")


def merge_text_outputs(spark: SparkSession, jobs_root: str) -> DataFrame:
    """Lines of the merged output of every job directory below ``jobs_root``.

    For each job: all ``*.out`` files then all ``*.txt`` files directly in its folder (by name
    within a pattern; hidden files and the merged file itself excluded), each as a header line
    ``############ <file>``, its lines and a line feed: an empty line, unless the file's last line
    has no line feed of its own.  An empty file keeps its header and empty line.  Returns ``(job,
    rank, file, block, line, value)``, ordered by these columns; write it with
    :func:`write_merged`.  The texts are read once; the names come from the reader's own file
    index on the driver, the only one that knows empty files (``binaryFile`` leaves them out).
    """
    root = jobs_root.rstrip("/")
    text = (spark.read.option("recursiveFileLookup", "true").option("pathGlobFilter", "*.{out,txt}").option("lineSep", "\n")
            .text(root))
    base = re.sub(r"^file:(//)?", "", root)
    names = spark.createDataFrame([(unquote(re.sub(r"^file:(//)?", "", f)),) for f in text.inputFiles()], "file string")
    inside = F.split(F.substring("file", F.lit(len(base) + 2), F.lit(2**31 - 1)), "/")
    name = F.element_at(inside, -1)
    files = (names.filter((F.size(inside) == 2) & (name != GROUP_FILE) & ~name.startswith("."))
             .select(inside[0].alias("job"), F.when(name.endswith(".out"), 0).otherwise(1).alias("rank"), "file"))
    lines = text.select(_plain_path(F.col("_metadata.file_path")).alias("file"),
                        F.col("_metadata.file_block_start").alias("block"), F.monotonically_increasing_id().alias("line"),
                        "value", F.col("_metadata.file_size").alias("size"))
    # a file ends with a line feed when its lines, each with one, make up its whole length
    ends = lines.groupBy("file").agg((F.sum(F.octet_length("value").cast("long") + 1) == F.max("size")).alias("ends"))
    whole = files.join(ends, "file", "left")
    key = ["job", "rank", "file"]
    frame = F.array(F.struct(F.lit(-1).cast("long").alias("block"), F.lit(-1).cast("long").alias("line"),
                             F.concat(F.lit(HEADER), F.col("file")).alias("value")),
                    F.when(F.coalesce("ends", F.lit(True)), F.struct(
                        F.lit(2**62).cast("long").alias("block"), F.lit(0).cast("long").alias("line"), F.lit("").alias("value"))))
    marks = whole.select(*key, F.inline(F.array_compact(frame)))
    body = lines.join(files, "file").select(*key, "block", "line", "value")
    return marks.unionByName(body)


def _plain_path(uri):
    """The path of a percent-encoded file URI."""
    return F.url_decode(F.replace(F.regexp_replace(uri, r"^file:(//)?", ""), F.lit("+"), F.lit("%2B")))


def write_merged(merged: DataFrame, out_dir: str, mode: str = "errorifexists") -> None:
    """One folder per job; part files in name order concatenate to the job's merged output.

    Range partitioning on the full order keeps one very large job spread over many tasks.
    """
    order = ["job", "rank", "file", "block", "line"]
    (merged.repartitionByRange(*order).sortWithinPartitions(*order)
           .select("job", "value").write.mode(mode).partitionBy("job").text(out_dir))
