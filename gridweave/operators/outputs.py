"""Output tables: parsing reported outputs, routing them, first successful storage target."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gridweave.functions.lfn import target_name
from gridweave.operators._joins import null_safe_join
from gridweave.operators.catalog import ADDED, add_entries
from gridweave.sources.catalog import canonical_lfn, catalog_from_lfns

# Error texts.
BAD_JSON = "invalid output JSON"
NOT_FILES = "output is not a file or a list of files"
SRC_REQUIRED = "src_path parameter required for filesystem storage of "
NOT_STORED = "not stored"

NO_PATH = "output file without a path"


def parse_outputs(df: DataFrame, keys: Sequence[str], stdout: str = "stdout") -> DataFrame:
    """One row per reported output file ``(keys..., output_name, pos, path, error)``.

    ``stdout`` is a JSON object ``{output: file | [file, ...] | null}`` with ``file`` an object
    holding ``path``.  Empty outputs (null, false, 0, "", [], {}, by their JSON type: the strings
    "0" and "false" are not empty) and empty list items are skipped; an output whose items are all
    empty gives one row with null ``pos``/``path``.  A malformed document, a value that is no file
    and a file without ``path`` give a row with ``error`` set.  One pass: each document is parsed
    once, its outputs and their files are exploded once each.
    """
    keys = list(keys)
    # variants keep the JSON type of every value; an unparsable document is null
    doc = df.select(*keys, F.try_parse_json(F.col(stdout)).alias("_d"))
    doc = doc.select(*keys, F.when(F.schema_of_variant("_d").startswith("OBJECT"), F.col("_d")).alias("_d"))
    fields = F.try_variant_get("_d", "$", "map<string,variant>")
    ent = doc.select(*keys, F.col("_d").isNull().alias("_bad"), F.explode_outer(fields).alias("output_name", "_v"))
    ent = ent.filter(F.col("_bad") | ~_empty(F.col("_v")))
    one = F.when(F.col("_v").isNotNull(), F.array("_v"))
    items = F.coalesce(F.try_variant_get("_v", "$", "array<variant>"), one)
    items = F.filter(items, lambda x: ~_empty(x))
    out = ent.select(*keys, "output_name", "_bad", F.posexplode_outer(items).alias("pos", "_x"))
    path = F.try_variant_get("_x", "$.path", "string")
    is_file = F.schema_of_variant("_x").startswith("OBJECT")
    error = (F.when(F.col("_bad"), F.lit(BAD_JSON)).when(F.col("_x").isNull(), F.lit(None))
              .when(~is_file, F.lit(NOT_FILES)).when(path.isNull(), F.lit(NO_PATH)))
    return out.select(*keys, "output_name", F.when(error.isNull(), F.col("pos")).alias("pos"), path.alias("path"),
                      error.alias("error"))


def _empty(v):
    """Whether a JSON value is empty: null, false, zero, or a string, list or object of nothing."""
    kind = F.schema_of_variant(v)
    zero = F.coalesce(F.try_variant_get(v, "$", "double") == 0, F.lit(False))
    number = kind.rlike("^(TINYINT|SMALLINT|INT|BIGINT|DECIMAL|DOUBLE|FLOAT)")
    return (v.isNull() | F.is_variant_null(v) | (kind == "VOID")
            | ((kind == "BOOLEAN") & ~F.coalesce(F.try_variant_get(v, "$", "boolean"), F.lit(True)))
            | (number & zero) | ((kind == "STRING") & (F.try_variant_get(v, "$", "string") == ""))
            | (F.to_json(v).isin("[]", "{}")))


def route_outputs(outputs: DataFrame, output_paths: DataFrame, output_sandbox: DataFrame,
                  keys: Sequence[str]) -> DataFrame:
    """Where every output file goes: the catalog, the sandbox, both or nowhere.

    ``output_paths`` is ``(keys..., output_name, lfn)``, ``output_sandbox`` ``(keys...,
    output_name)``.  Returns the output rows with ``to_catalog``, ``to_sandbox``, ``target``
    (catalog LFN of the file) and ``error`` (an output whose source path is null or empty is rejected).  An output
    named several times in ``output_paths`` takes the smallest LFN.
    """
    keys = list(keys)
    k = [*keys, "output_name"]
    sides = (output_paths.select(*k, F.col("lfn").alias("_lfn"), F.lit(False).alias("_sb"))
             .unionByName(output_sandbox.select(*k, F.lit(None).cast("string").alias("_lfn"), F.lit(True).alias("_sb"))))
    sides = sides.groupBy(*k).agg(F.min("_lfn").alias("_lfn"), F.bool_or("_sb").alias("_sb"))
    j = outputs.join(sides, k, "left")
    no_src = (F.coalesce("path", F.lit("")) == "") & F.col("error").isNull()
    return (j.withColumn("to_catalog", F.col("_lfn").isNotNull() & ~no_src)
             .withColumn("to_sandbox", F.coalesce(F.col("_sb"), F.lit(False)) & ~no_src)
             .withColumn("target", F.when(F.col("_lfn").isNotNull() & ~no_src, target_name(F.col("_lfn"), F.col("path"))))
             .withColumn("error", F.when(no_src, F.concat(F.lit(SRC_REQUIRED), F.col("output_name")))
                         .otherwise(F.col("error")))
             .drop("_lfn", "_sb"))


def first_successful_target(attempts: DataFrame, keys: Sequence[str], pos: str = "pos",
                            target: str = "se", ok: str = "ok", message: str = "message") -> DataFrame:
    """Of the ordered storage attempts of every file keep the first that worked.

    Returns ``(keys..., stored_se, attempts, status, error)``: ``status`` is ``stored`` or
    ``failed``; a failed file carries the message of its last attempt.  A partial aggregation,
    so one file with very many attempts never needs one task.
    """
    keys = list(keys)
    agg = attempts.groupBy(*keys).agg(
        F.expr(f"min_by(`{target}`, `{pos}`) FILTER (WHERE `{ok}`)").alias("stored_se"),
        F.max_by(F.col(message), F.col(pos)).alias("_last_msg"),
        F.count(F.lit(1)).alias("attempts"))
    stored = F.col("stored_se").isNotNull()
    return agg.select(*keys, "stored_se", "attempts",
                      F.when(stored, F.lit("stored")).otherwise(F.lit("failed")).alias("status"),
                      F.when(~stored, F.col("_last_msg")).alias("error"))


def storage_report(files: DataFrame, attempts: DataFrame, keys: Sequence[str], **kw) -> DataFrame:
    """:func:`first_successful_target` for every file; files without attempts are ``not stored``."""
    keys = list(keys)
    res = first_successful_target(attempts, keys, **kw)
    j = files.select(*keys).join(res, keys, "left")
    return j.withColumn("status", F.coalesce(F.col("status"), F.lit(NOT_STORED)))\
            .withColumn("attempts", F.coalesce(F.col("attempts"), F.lit(0)))


def store_and_register(files: DataFrame, attempts: DataFrame, catalog: DataFrame, keys: Sequence[str],
                       lfn: str = "lfn", seq: str = "seq", **kw) -> tuple[DataFrame, DataFrame]:
    """Store every file on its first working element and enter it in the catalog.

    ``files`` is ``(keys..., lfn, seq)``, ``attempts`` as for :func:`first_successful_target`.
    Returns ``(report, catalog)``: per file both outcomes, of the storage (``stored_se``,
    ``attempts``, ``storage``, ``storage_error``) and of the catalog (``entry``, ``entry_error``),
    and the catalog afterwards.  A file is entered before it is stored, so its entry does not
    depend on the storage; of several files with one name the first by ``seq`` is entered.
    """
    entered = add_entries(catalog, files.withColumn("_key", canonical_lfn(lfn)).withColumnRenamed(lfn, "_as_given")
                          .withColumnRenamed("_key", lfn), key=lfn, seq=seq)
    stored = storage_report(files, attempts, keys, **kw).select(
        *keys, "stored_se", "attempts", F.col("status").alias("storage"), F.col("error").alias("storage_error"))
    entry = entered.select(*keys, F.col("_as_given").alias(lfn), F.col("status").alias("entry"),
                           F.col("message").alias("entry_error"))
    report = null_safe_join(entry, stored, keys)
    added = catalog_from_lfns(entered.filter(F.col("status") == ADDED).select(lfn), lfn)
    return report, catalog.unionByName(added.select(*catalog.columns))
