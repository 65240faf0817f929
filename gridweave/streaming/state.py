"""State of a foreachBatch query as tables per batch: changed keys, now and then all of them."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from gridweave.operators._joins import null_safe_join
from gridweave.session import delete_path, path_exists

#: Every so many batches the whole state is written; the batches before are then removed.
COMPACT_EVERY = 16


class KeyedState:
    """One counter (with ``more`` fields beside it) and any number of rows per key, versioned by batch id.

    Batch ``i`` writes the keys it touched, with ``_ver = i``; a key's state is what its newest
    version holds.  Batches 0, 16, 32 ... write every key.  Reading the state before a batch needs
    all folders since the last full one: a missing folder raises, only batch 0 starts empty.  A
    replayed batch overwrites its own folders.  Null keys are keys.
    """

    def __init__(self, spark: SparkSession, path: str, keys: Sequence[T.StructField], fields: Sequence[T.StructField],
                 more: Sequence[T.StructField] = ()):
        self.spark, self.path, self.keys = spark, path.rstrip("/"), [f.name for f in keys]
        version, self.counted = T.StructField("_ver", T.LongType()), ["n", *(f.name for f in more)]
        self.schemas = {"counters": T.StructType([*keys, T.StructField("n", T.LongType()), *more, version]),
                        "rows": T.StructType([*keys, *fields, version])}

    def _read(self, table: str, batch_id: int) -> DataFrame:
        schema = self.schemas[table]
        if batch_id == 0:
            return self.spark.createDataFrame([], schema)
        first = (batch_id - 1) // COMPACT_EVERY * COMPACT_EVERY
        folders = [f"{self.path}/{table}/batch_id={i}" for i in range(first, batch_id)]
        for folder in folders:
            if not path_exists(self.spark, f"{folder}/_SUCCESS"):
                raise RuntimeError(f"stream state is missing: {folder}")
        parts = [self.spark.read.schema(schema).parquet(f) for f in folders]
        out = parts[0]
        for p in parts[1:]:
            out = out.unionByName(p)
        return out

    def load(self, batch_id: int) -> tuple[DataFrame, DataFrame]:
        """(counters, rows) of every key before batch ``batch_id``."""
        counters = self._read("counters", batch_id).groupBy(*self.keys).agg(
            *[F.max_by(c, "_ver").alias(c) for c in self.counted], F.max("_ver").alias("_ver"))
        rows = null_safe_join(self._read("rows", batch_id), counters.drop(*self.counted), [*self.keys, "_ver"], "left_semi")
        return counters.drop("_ver"), rows.drop("_ver")

    def store(self, batch_id: int, counters: DataFrame, rows: DataFrame, before: tuple[DataFrame, DataFrame]) -> None:
        """Write the touched keys' ``counters`` and ``rows`` as version ``batch_id``."""
        new = {"counters": counters, "rows": rows}
        if batch_id % COMPACT_EVERY == 0 and batch_id > 0:
            new = {t: old_new[1].unionByName(null_safe_join(old_new[0], counters.select(*self.keys), self.keys, "left_anti"))
                   for t, old_new in zip(new, zip(before, new.values(), strict=True), strict=True)}
        for t, df in new.items():
            (df.withColumn("_ver", F.lit(batch_id).cast("long")).select(*self.schemas[t].fieldNames())
               .write.mode("overwrite").parquet(f"{self.path}/{t}/batch_id={batch_id}"))
        if batch_id % COMPACT_EVERY == 1 and batch_id > 1:  # the full version before this batch is committed
            for t in new:
                for i in range(max(0, batch_id - 1 - COMPACT_EVERY), batch_id - 1):
                    delete_path(self.spark, f"{self.path}/{t}/batch_id={i}")
