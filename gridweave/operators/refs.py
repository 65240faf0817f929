"""File references inside job inputs: catalog references, local files, staging, sandbox manifests.

Job inputs are kept long: one row per file reference ``(job_id, input_name, pos, location, path)``
with ``is_list`` telling whether the input was a list of files or a single file.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gridweave.functions.lfn import LFN_PREFIX
from gridweave.operators._joins import null_safe_join
from gridweave.operators.catalog import NOT_FOUND, find_files

# Error text of a reference without location and path, and the local-file scheme.
NO_LOCATION = "File location is not defined."
FILE_SCHEME = "file://"


def reference_errors(refs: DataFrame) -> DataFrame:
    """References that have neither ``location`` nor ``path`` (the job is rejected).

    Empty strings count as missing.  A single-file input (``is_list`` false) needs a location.
    """
    no_location, no_path = F.coalesce("location", F.lit("")) == "", F.coalesce("path", F.lit("")) == ""
    bad = no_location & no_path
    if "is_list" in refs.columns:
        bad = bad | (no_location & ~F.coalesce("is_list", F.lit(True)))
    return refs.filter(bad).withColumn("error", F.lit(NO_LOCATION))


def catalog_refs(refs: DataFrame) -> DataFrame:
    """References whose ``location`` starts with ``lfn:`` (one row per reference)."""
    return refs.filter(F.col("location").startswith(LFN_PREFIX))


def catalog_refs_by_input(refs: DataFrame, keys: Sequence[str] = ("job_id", "input_name")) -> DataFrame:
    """Catalog references grouped per job input, in input order; inputs without one keep ``[]``.

    The list of one job input is bounded by the job's group size.
    """
    keys = list(keys)
    is_lfn = F.col("location").startswith(LFN_PREFIX)
    item = F.when(is_lfn, F.struct(F.col("pos"), F.col("location")))
    return (refs.groupBy(*keys)
                .agg(F.array_sort(F.collect_list(item)).alias("_l"))
                .select(*keys, F.transform("_l", lambda x: x["location"]).alias("lfns")))


def local_refs(refs: DataFrame) -> DataFrame:
    """References that name a local path, with every ``file://`` removed (the input sandbox)."""
    return (refs.filter(F.coalesce("path", F.lit("")) != "")
                .withColumn("local_path", F.replace(F.col("path"), F.lit(FILE_SCHEME), F.lit(""))))


def rewrite_inputs(refs: DataFrame, catalog: DataFrame, job_key: str = "job_id") -> tuple[DataFrame, DataFrame]:
    """Stage the catalog references of every job and point them at the local copies.

    Returns ``(rows, jobs)``.  ``rows``: every reference with ``status`` and the reference the job
    gets, ``staged_location`` and ``staged_path``: a found catalog file is its basename as path and
    no location, any other reference is left as it is.  ``jobs``: per job the number of catalog
    references, how many were found, and ``failed`` (any not found fails the job).
    """
    is_lfn = F.coalesce(F.col("location").startswith(LFN_PREFIX), F.lit(False))
    lfn_rows = refs.filter(is_lfn)
    other = refs.filter(~is_lfn)
    looked = find_files(catalog, lfn_rows, lfn_col="location")
    found = F.col("status") != NOT_FOUND
    staged = (looked.withColumn("staged_location", F.when(~found, F.col("location")))
                    .withColumn("staged_path", F.when(found, F.substring_index("location", "/", -1))))
    rows = staged.drop("cat_creation_date", "cat_metadata").unionByName(
        other.withColumn("status", F.lit(None).cast("string"))
             .withColumn("message", F.lit(None).cast("string"))
             .withColumn("staged_location", F.col("location"))
             .withColumn("staged_path", F.col("path")))
    jobs = rows.groupBy(job_key).agg(
        F.count(F.when(F.col("status").isNotNull(), 1)).alias("n_catalog"),
        F.count(F.when(F.col("status") == "Successful", 1)).alias("n_staged"),
        F.coalesce(F.bool_or(F.col("status") == NOT_FOUND), F.lit(False)).alias("failed"))
    return rows, jobs


def sandbox_manifest(files: DataFrame, job_key: str = "job_id", pos: str = "pos",
                     name: str = "name") -> tuple[DataFrame, DataFrame]:
    """Files packed into each job's sandbox, by basename; the list stops at the first empty name.

    Returns ``(manifest, summary)``: manifest rows ``(job, pos, member)`` and per job
    ``(job, n_files, sandbox_id)``.  ``sandbox_id`` names the packed members whatever their order:
    a SHA-256 of their number and of the sums of two 60-bit parts of each member's SHA-256, so it
    needs no collected list and equal members do not cancel.  A job whose list is cut at its first
    entry packs an empty sandbox; a job without any entry has none.
    """
    empty = F.coalesce(F.col(name), F.lit("")) == ""
    cut = files.groupBy(job_key).agg(F.min(F.when(empty, F.col(pos))).alias("_cut"))
    marked = null_safe_join(files, cut, [job_key])
    packed = F.col("_cut").isNull() | (F.col(pos) < F.col("_cut"))
    marked = marked.select(job_key, pos, packed.alias("_packed"), F.substring_index(F.col(name), "/", -1).alias("member"))
    digest = F.sha2(F.when(F.col("_packed"), F.col("member")), 256)
    parts = [F.sum(F.conv(F.substring(digest, at, 15), 16, 10).cast("decimal(20,0)")) for at in (1, 16)]
    total = [F.coalesce(p, F.lit(0)).cast("decimal(38,0)").cast("string") for p in parts]
    n = F.count(F.when(F.col("_packed"), 1))
    summary = marked.groupBy(job_key).agg(
        n.alias("n_files"),
        F.concat(F.lit("sandbox_"), F.sha2(F.concat_ws(":", n.cast("string"), *total), 256)).alias("sandbox_id"))
    return marked.filter("_packed").drop("_packed"), summary


def staged_inputs(rows: DataFrame, job_key: str = "job_id") -> DataFrame:
    """Inputs after staging, one row per job input: ``(job_id, input_name, is_list, files)``.

    ``rows`` is the first result of :func:`rewrite_inputs`.  ``files`` holds ``struct(location,
    path)`` in position order; ``is_list`` tells a list of files from a single one, as the input
    was given.  The lists are a job's own inputs (bounded by its group size), collected per input.
    """
    per_input = rows.groupBy(job_key, "input_name").agg(
        F.bool_or("is_list").alias("is_list"),
        F.array_sort(F.collect_list(F.struct(F.col("pos"), F.col("staged_location").alias("location"),
                                             F.col("staged_path").alias("path")))).alias("_f"))
    return per_input.select(job_key, "input_name", "is_list", F.transform(
        "_f", lambda x: F.struct(x["location"].alias("location"), x["path"].alias("path"))).alias("files"))
