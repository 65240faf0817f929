"""Helpers shared by the operators of this subpackage."""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from gridweave.session import checkpoint_dir, delete_path, hadoop_path

_written: list[str] = []


def materialize(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` as Parquet into the shared folder of ``spark.checkpoint.dir`` and read it back.

    Cuts lineage like a reliable checkpoint, but columnar and compressed.  The folder is removed
    when the driver's JVM ends, or earlier by ``release_scratch``.
    """
    spark = df.sparkSession
    path = scratch_path(spark, name)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def scratch_path(spark: SparkSession, name: str) -> str:
    """A new folder name in the shared folder, removed at the end of the driver's JVM."""
    folder = f"{checkpoint_dir(spark).rstrip('/')}/llm-{spark.sparkContext.applicationId}"
    p, fs = hadoop_path(spark, folder)
    fs.mkdirs(p)
    fs.deleteOnExit(p)
    path = f"{folder}/{name}-{uuid.uuid4().hex}"
    _written.append(path)
    return path


def release_scratch(spark: SparkSession) -> int:
    """Delete the scratch folders of this Python process (frames read from them become unusable)."""
    n = len(_written)
    while _written:
        delete_path(spark, _written.pop())
    return n


def text_or_empty(col: str | Column = "text") -> Column:
    """The text, null as the empty text."""
    return F.coalesce(F.col(col) if isinstance(col, str) else col, F.lit(""))


def id_crc32(col: str = "doc_id") -> Column:
    """CRC-32 of the id's decimal text (null id: null)."""
    return F.crc32(F.col(col).cast("string").cast("binary"))
