"""The changes between committed snapshots of a catalog, as a stream (S8 over snapshots).

:func:`write_catalog_snapshot` leaves one commit record per snapshot.  The stream reads these records;
every new one is compared with the snapshot committed before it, and the changes are written
into a folder of the new snapshot's name.  Adding up the folders gives the newest snapshot.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from gridweave.operators.changes import catalog_changes
from gridweave.sources.catalog import COMMITS

_COMMIT_SCHEMA = "snapshot string, path string"


def stream_catalog_changes(spark: SparkSession, root: str, out: str, checkpoint: str, key: str = "lfn",
                           trigger: dict | None = None) -> StreamingQuery:
    """Start the stream over the snapshots below ``root``; ``out/snapshot=<name>`` holds the rows of :func:`catalog_changes`.

    The first snapshot's entries are all ``added``.  A snapshot's folder is overwritten when its batch is replayed,
    so every change is there once.  Snapshots are compared in the order of their names, which must be the
    order they are committed in (the names that :func:`write_catalog_snapshot` makes are).  A batch holds one short record
    per snapshot.  The default trigger processes what is there and stops; ``{"processingTime": POLL_INTERVAL}`` goes on.
    """
    base, target = root.rstrip("/"), out.rstrip("/")
    commits = spark.readStream.schema(_COMMIT_SCHEMA).option("recursiveFileLookup", "true").json(f"{base}/{COMMITS}")

    def step(batch: DataFrame, batch_id: int) -> None:
        own = batch.sparkSession
        known = own.read.schema(_COMMIT_SCHEMA).option("recursiveFileLookup", "true").json(f"{base}/{COMMITS}")
        for row in batch.orderBy("snapshot").collect():
            new = own.read.parquet(row["path"])
            before = known.where(F.col("snapshot") < row["snapshot"]).orderBy(F.desc("snapshot")).first()
            old = own.read.parquet(before["path"]) if before else new.limit(0)
            catalog_changes(old, new, key).write.mode("overwrite").parquet(f"{target}/snapshot={row['snapshot']}")

    writer = commits.writeStream.foreachBatch(step).option("checkpointLocation", checkpoint)
    return writer.trigger(**(trigger or {"availableNow": True})).start()


def read_changes(spark: SparkSession, out: str) -> DataFrame:
    """All changes written so far, with their ``snapshot``."""
    return spark.read.parquet(out.rstrip("/"))
