"""Spark session helpers.

The library never creates a session behind the caller's back; ``get_spark`` is a convenience for
scripts, tests and the bench.  ``checkpoint_dir`` reads ``spark.checkpoint.dir`` from the session
(the shared folder a cluster names) and only sets a scratch folder when it is unset, as in tests.
"""

from __future__ import annotations

import os
import tempfile
import uuid
from contextlib import contextmanager

from py4j.protocol import Py4JJavaError
from pyspark.sql import DataFrame, SparkSession

_DEFAULT_CONF = {
    "spark.ui.enabled": "false",
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.execution.arrow.pyspark.enabled": "true",
    # checkpoint files of frames no longer referenced are removed (long-running sessions)
    "spark.cleaner.referenceTracking.cleanCheckpoints": "true",
}


def get_spark(master: str | None = None, shuffle_partitions: int | None = None,
              app_name: str = "gridweave", conf: dict[str, str] | None = None) -> SparkSession:
    """Return (or create) a session with the settings the operators are tuned for."""
    builder = SparkSession.builder.appName(app_name)
    if master:
        builder = builder.master(master)
    settings = dict(_DEFAULT_CONF)
    if shuffle_partitions:
        settings["spark.sql.shuffle.partitions"] = str(shuffle_partitions)
    settings.update(conf or {})
    for key, value in settings.items():
        builder = builder.config(key, value)
    spark = builder.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    return spark


def checkpoint_dir(spark: SparkSession) -> str:
    """The reliable checkpoint folder of this session.

    On a cluster ``spark.checkpoint.dir`` names a shared folder and is used as is (unset on a
    cluster is an error).  Only in local mode with it unset (local runs, tests) a fresh scratch
    folder is created and registered.
    """
    current = spark.sparkContext.getCheckpointDir()
    if current:
        return current
    configured = spark.conf.get("spark.checkpoint.dir", None)
    if not configured:
        master = spark.sparkContext.master or ""
        if not master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder shared by the cluster "
                               "(a machine-local scratch folder is used only in local mode)")
        configured = tempfile.mkdtemp(prefix="gridweave-ckpt-", dir=os.environ.get("TMPDIR", "/tmp"))
    spark.sparkContext.setCheckpointDir(configured)
    return spark.sparkContext.getCheckpointDir() or configured


def hadoop_path(spark: SparkSession, path: str):
    """(path, file system) of a path, as Hadoop objects."""
    jvm_path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return jvm_path, jvm_path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())


def path_exists(spark: SparkSession, path: str) -> bool | None:
    """Whether ``path`` exists in its Hadoop file system (None where that cannot be told)."""
    try:
        p, fs = hadoop_path(spark, path)
        return bool(fs.exists(p))
    except Py4JJavaError:
        return None


def is_directory(spark: SparkSession, path: str) -> bool:
    p, fs = hadoop_path(spark, path)
    return bool(fs.exists(p) and fs.getFileStatus(p).isDirectory())


def delete_path(spark: SparkSession, path: str) -> None:
    """Delete a folder and all in it (nothing happens where there is none)."""
    p, fs = hadoop_path(spark, path)
    fs.delete(p, True)


@contextmanager
def scratch_dir(spark: SparkSession, name: str):
    """A new folder below the checkpoint folder, deleted at the end of the block."""
    path = f"{checkpoint_dir(spark).rstrip('/')}/{name}-{uuid.uuid4().hex[:12]}"
    try:
        yield path
    finally:
        delete_path(spark, path)


def kept_result(df: DataFrame) -> DataFrame:
    """``df`` computed now into a reliable checkpoint, so that the folders it reads can go.

    The session's cleaner removes the checkpoint once the frame is no longer referenced.
    """
    checkpoint_dir(df.sparkSession)
    return df.checkpoint(eager=True)
