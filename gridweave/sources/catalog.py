"""The file catalog as a table.

Schema (``CATALOG_SCHEMA``): ``lfn`` is the canonical absolute form ``/a/b/name`` (no ``lfn:``
prefix), ``dir`` its parent and ``name`` its last part.  ``dir`` is stored so that a directory
query is an equality predicate that reaches the parquet scan (and partition pruning when the
catalog is written ``partitionBy`` on it or on coarser columns).
"""

from __future__ import annotations

from py4j.protocol import Py4JJavaError
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.errors import AnalysisException
from pyspark.errors.exceptions.base import PySparkException as SparkException

from gridweave.functions._cols import as_col

CATALOG_SCHEMA = T.StructType([
    T.StructField("lfn", T.StringType(), False),
    T.StructField("dir", T.StringType(), True),
    T.StructField("name", T.StringType(), True),
    T.StructField("creation_epoch", T.DoubleType(), True),
    T.StructField("creation_date", T.TimestampType(), True),
    T.StructField("metadata", T.MapType(T.StringType(), T.StringType()), True),
])

# Single-document import form: {"<lfn>": {"CreationDate": <epoch seconds>}, ...}
_DOCUMENT_SCHEMA = "map<string, struct<CreationDate: double>>"


def canonical_lfn(col: Column | str) -> Column:
    """``/`` + the LFN without ``lfn:``/``LFN:`` prefix and without leading slashes (one regex)."""
    return F.regexp_replace(as_col(col), r"^(?:lfn:)?(?:LFN:)?/*", "/")


def lfn_name(lfn: Column | str) -> Column:
    """Last part of a canonical LFN."""
    return F.substring_index(as_col(lfn), "/", -1)


def lfn_dir(lfn: Column | str) -> Column:
    """Parent directory of a canonical LFN (``/`` for top-level names); no regex."""
    c = as_col(lfn)
    cut = F.length(c) - F.length(lfn_name(c)) - 1
    d = F.substring(c, F.lit(1), cut)
    return F.when(cut <= 1, F.lit("/")).otherwise(d)


def catalog_from_lfns(df: DataFrame, lfn_col: str = "lfn", epoch_col: str | None = None,
                      metadata_col: str | None = None, keep: list[str] | None = None) -> DataFrame:
    """Turn any frame holding LFN strings into catalog rows (extra columns in ``keep`` kept)."""
    lfn = canonical_lfn(lfn_col)
    epoch = F.col(epoch_col).cast("double") if epoch_col else F.lit(None).cast("double")
    meta = (F.col(metadata_col) if metadata_col
            else F.lit(None).cast(T.MapType(T.StringType(), T.StringType())))
    out = (df.select(*(keep or []), lfn.alias("lfn"), epoch.alias("creation_epoch"),
                     meta.alias("metadata"))
             .withColumn("dir", lfn_dir("lfn"))
             .withColumn("name", lfn_name("lfn"))
             .withColumn("creation_date", F.timestamp_micros((F.col("creation_epoch") * 1e6).cast("long"))))
    return out.select(*(keep or []), *[f.name for f in CATALOG_SCHEMA.fields])


def catalog_from_parts(df: DataFrame, dir_col: Column | str, name_col: Column | str,
                       keep: list[str] | None = None) -> DataFrame:
    """Catalog rows from a directory and a file name that are already canonical.

    For producers that know the layout (``/a/b`` directory without trailing slash, plain name):
    no regex per row, and nothing expensive for the optimizer to repeat when it pushes filters
    on ``dir``/``name`` below the projection.
    """
    d, n = as_col(dir_col), as_col(name_col)
    return df.select(*(keep or []), F.concat(d, F.lit("/"), n).alias("lfn"), d.alias("dir"), n.alias("name"),
                     F.lit(None).cast("double").alias("creation_epoch"),
                     F.lit(None).cast("timestamp").alias("creation_date"),
                     F.lit(None).cast(T.MapType(T.StringType(), T.StringType())).alias("metadata"))


def empty_catalog(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame([], CATALOG_SCHEMA)


def read_catalog(spark: SparkSession, path: str, fmt: str = "parquet") -> DataFrame:
    """Read a catalog; a missing or unreadable one is an empty catalog with the fixed schema.

    ``fmt``: ``parquet`` (the stored form), ``json`` (one record per line, catalog schema) or
    ``document`` (the single JSON document ``{lfn: {"CreationDate": epoch}}``, imported with one
    row per file via ``from_json`` + ``explode``: the form of small legacy files).  Malformed JSON
    lines and documents hold no entries.
    """
    try:
        if fmt == "parquet":
            spark.read.parquet(path).schema  # an unreadable footer shows here
            return spark.read.schema(CATALOG_SCHEMA).parquet(path)
        if fmt == "json":
            return spark.read.schema(CATALOG_SCHEMA).json(path).filter(F.col("lfn").isNotNull())
        if fmt == "document":
            doc = spark.read.text(path, wholetext=True)
            entries = doc.select(F.explode(F.from_json("value", _DOCUMENT_SCHEMA)).alias("lfn", "m"))
            return catalog_from_lfns(entries.select("lfn", F.col("m.CreationDate").alias("epoch")),
                                     epoch_col="epoch")
    except (AnalysisException, SparkException, Py4JJavaError) as exc:
        if any(x in str(exc) for x in ("PATH_NOT_FOUND", "Path does not exist", "FOOTER", "UNABLE_TO_INFER_SCHEMA")):
            return empty_catalog(spark)
        raise
    raise ValueError(f"unknown catalog format {fmt!r}")


def list_files(spark: SparkSession, root: str, glob: str | None = None) -> DataFrame:
    """Catalog rows for the files stored below ``root`` (file contents are never read).

    The ``binaryFile`` source lists recursively; only ``path``, ``modificationTime`` and
    ``length`` are selected, so the content column is pruned.  LFNs are the paths relative to
    ``root``.  Directories are not returned (files only).
    """
    reader = spark.read.format("binaryFile").option("recursiveFileLookup", "true")
    if glob:
        reader = reader.option("pathGlobFilter", glob)
    try:
        files = reader.load(root).select("path", "modificationTime", "length")
    except AnalysisException as exc:
        if "PATH_NOT_FOUND" in str(exc) or "Path does not exist" in str(exc):
            return empty_catalog(spark).withColumn("length", F.lit(None).cast("long"))
        raise
    import re

    root_clean = re.sub(r"^file:(//)?", "", root.rstrip("/"))
    rel = F.regexp_replace(F.regexp_replace("path", r"^file:(//)?", ""),
                           "^" + _regex_escape(root_clean) + "/?", "")
    out = files.select(rel.alias("lfn"),
                       (F.unix_micros(F.col("modificationTime")) / 1e6).alias("epoch"), "length")
    return catalog_from_lfns(out, epoch_col="epoch", keep=["length"])


def _regex_escape(s: str) -> str:
    import re
    return re.escape(s)


SNAPSHOT_PREFIX = "snapshot="
COMMITS = "commits"


def write_catalog_snapshot(catalog: DataFrame, root: str, partition_by: list[str] | None = None,
                           snapshot: str | None = None) -> str:
    """Write the catalog as a new snapshot folder below ``root`` and return its path.

    A read-modify-write (insert, upsert) never overwrites the snapshot it read: readers keep
    seeing a complete catalog.  The snapshot becomes visible only when its commit record is
    written under ``root/commits`` after the data write succeeded, so a failed write leaves
    nothing a reader would pick up.  ``partition_by`` (coarse columns such as campaign or site)
    gives partition pruning to directory queries.  Snapshot names sort in time order.
    """
    import time
    import uuid

    spark = catalog.sparkSession
    name = snapshot or f"{time.strftime('%Y%m%dT%H%M%S', time.gmtime())}-{uuid.uuid4().hex[:8]}"
    base = root.rstrip("/")
    path = f"{base}/{SNAPSHOT_PREFIX}{name}"
    writer = catalog.write.mode("errorifexists")
    if partition_by:
        writer = writer.partitionBy(*partition_by)
    writer.parquet(path)
    (spark.createDataFrame([(name, path)], "snapshot string, path string")
          .coalesce(1).write.mode("errorifexists").json(f"{base}/{COMMITS}/{name}"))
    return path


def read_latest_catalog(spark: SparkSession, root: str) -> DataFrame:
    """The newest committed snapshot below ``root`` (empty catalog when there is none).

    Only the small table of commit records is read to find it.
    """
    base = root.rstrip("/")
    try:
        commits = (spark.read.schema("snapshot string, path string")
                        .option("recursiveFileLookup", "true").json(f"{base}/{COMMITS}"))
        latest = commits.agg(F.max_by("path", "snapshot").alias("p")).first()["p"]
    except AnalysisException as exc:
        if "PATH_NOT_FOUND" in str(exc) or "Path does not exist" in str(exc):
            return empty_catalog(spark)
        raise
    if not latest:
        return empty_catalog(spark)
    return spark.read.parquet(latest)
