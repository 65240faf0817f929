"""New entries of a stream against a table of the keys already seen (T3 without a state store).

The seen keys lie on shared storage, hash-partitioned.  Beside them lies a Bloom filter, a table of
bitmaps per partition.  A micro-batch first asks the filter; only partitions that may hold one of
its keys are read and joined, so a batch of new keys reads hardly any of them.  Every batch adds its own
folders, and every 16 batches the last folders become one; nothing is held in executors between batches,
and no entry is too late.  A replayed batch overwrites its own folders.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from gridweave.session import checkpoint_dir, delete_path, path_exists

#: Hash partitions of the seen keys, bitmaps of 32,768 bits of each partition's filter, bits per key.
PARTS, BITMAPS, HASHES = 64, 256, 3
#: So many batches become one folder.
MERGE_EVERY = 16
_BITS = 32_768


def _part(parts: int) -> Column:
    return F.pmod(F.xxhash64("_key"), F.lit(parts)).cast("int")


def _places(bitmaps: int) -> Column:
    """The key's bits, as structs (bitmap, bit)."""
    at = [F.pmod(F.xxhash64("_key", F.lit(seed)), F.lit(bitmaps * _BITS)) for seed in range(1, HASHES + 1)]
    return F.array(*[F.struct((a / _BITS).cast("int").alias("bitmap"), (a % _BITS).cast("int").alias("bit")) for a in at])


class SeenKeys:
    """Keys (as text, never null) with the batch that brought them, below ``path``."""

    def __init__(self, spark: SparkSession, path: str, parts: int = PARTS, bitmaps: int = BITMAPS):
        self.spark, self.path, self.parts, self.bitmaps = spark, path.rstrip("/"), parts, bitmaps
        self.schemas = {"keys": T.StructType([T.StructField("_key", T.StringType()), T.StructField("part", T.IntegerType())]),
                        "filter": T.StructType([T.StructField("bitmap", T.IntegerType()), T.StructField("bits", T.BinaryType()),
                                                T.StructField("part", T.IntegerType())])}

    def _folders(self, table: str, batch_id: int) -> list[str]:
        """The folders that hold what batches before ``batch_id`` brought."""
        merged = batch_id // MERGE_EVERY * MERGE_EVERY
        own = [f"{self.path}/{table}/merged={m}" for m in range(MERGE_EVERY, merged + 1, MERGE_EVERY)]
        own += [f"{self.path}/{table}/batch_id={i}" for i in range(merged, batch_id)]
        for folder in own:
            if not path_exists(self.spark, f"{folder}/_SUCCESS"):
                raise RuntimeError(f"stream state is missing: {folder}")
        return own

    def _read(self, table: str, batch_id: int, parts: list[int] | None = None) -> DataFrame:
        out = self.spark.createDataFrame([], self.schemas[table])
        for folder in self._folders(table, batch_id):
            own = self.spark.read.schema(self.schemas[table]).parquet(folder)
            out = out.unionByName(own if parts is None else own.where(F.col("part").isin(parts)))
        return out

    def _write(self, table: str, name: str, df: DataFrame) -> None:
        (df.select(*self.schemas[table].fieldNames()).repartition("part").write.mode("overwrite").partitionBy("part")
         .parquet(f"{self.path}/{table}/{name}"))

    def merge(self, batch_id: int) -> None:
        """At the first batch of a round: the round before as one folder; its own folders go a batch later."""
        if batch_id >= MERGE_EVERY and batch_id % MERGE_EVERY == 0:
            for table in self.schemas:
                if not path_exists(self.spark, f"{self.path}/{table}/merged={batch_id}/_SUCCESS"):
                    round_ = [self.spark.read.schema(self.schemas[table]).parquet(f"{self.path}/{table}/batch_id={i}")
                              for i in range(batch_id - MERGE_EVERY, batch_id)]
                    out = round_[0]
                    for df in round_[1:]:
                        out = out.unionByName(df)
                    if table == "filter":
                        out = out.groupBy("part", "bitmap").agg(F.bitmap_or_agg("bits").alias("bits"))
                    self._write(table, f"merged={batch_id}", out)
        if batch_id > MERGE_EVERY and batch_id % MERGE_EVERY == 1:
            for table in self.schemas:
                for i in range(batch_id - 1 - MERGE_EVERY, batch_id - 1):
                    delete_path(self.spark, f"{self.path}/{table}/batch_id={i}")

    def possible(self, keys: DataFrame, batch_id: int) -> DataFrame:
        """The rows (_key, part) whose bits are all set: seen before, or (rarely) not."""
        filters = self._read("filter", batch_id).groupBy("part", "bitmap").agg(F.bitmap_or_agg("bits").alias("bits"))
        asked = keys.select("_key", "part", F.inline(_places(self.bitmaps)))
        byte = F.conv(F.hex(F.substring("bits", F.floor(F.col("bit") / 8).cast("int") + 1, F.lit(1))), 16, 10).cast("int")
        is_set = F.coalesce((byte / F.pow(F.lit(2), F.col("bit") % 8)).cast("int") % 2 == 1, F.lit(False))
        hits = asked.join(filters, ["part", "bitmap"], "left").groupBy("_key", "part").agg(F.bool_and(is_set).alias("hit"))
        return hits.where("hit").select("_key", "part")

    def unseen(self, keys: DataFrame, batch_id: int) -> DataFrame:
        """The rows (_key, part) of ``keys`` that no batch before ``batch_id`` brought."""
        checkpoint_dir(self.spark)
        maybe = self.possible(keys, batch_id).checkpoint(eager=True)
        parts = [r["part"] for r in maybe.select("part").distinct().collect()]  # at most ``parts`` numbers
        if not parts:
            return keys
        known = maybe.join(self._read("keys", batch_id, parts), ["part", "_key"], "left_semi")
        return keys.join(known, ["part", "_key"], "left_anti")

    def add(self, keys: DataFrame, batch_id: int) -> None:
        self._write("keys", f"batch_id={batch_id}", keys)
        bits = keys.select("part", F.inline(_places(self.bitmaps))).groupBy("part", "bitmap").agg(F.bitmap_construct_agg("bit").alias("bits"))
        self._write("filter", f"batch_id={batch_id}", bits)


def new_entries_batch_step(batch: DataFrame, batch_id: int, key: str, out_path: str, state_path: str,
                           parts: int = PARTS, bitmaps: int = BITMAPS) -> None:
    """One micro-batch: the least row of every key not seen before goes to ``out_path/batch_id=...``.

    A null key is a key like any other.  Rows are compared by all their columns, in order.
    """
    seen = SeenKeys(batch.sparkSession, state_path, parts, bitmaps)
    checkpoint_dir(batch.sparkSession)
    seen.merge(batch_id)
    named = F.coalesce(F.concat(F.lit("="), F.col(key).cast("string")), F.lit("-"))
    rows = batch.select(named.alias("_key"), F.struct(*batch.columns).alias("_row")).groupBy("_key").agg(F.min("_row").alias("_row"))
    rows = rows.withColumn("part", _part(parts)).checkpoint(eager=True)
    new = seen.unseen(rows.select("_key", "part"), batch_id)
    fresh = rows.join(new, ["_key", "part"]).checkpoint(eager=True)
    fresh.select("_row.*").write.mode("overwrite").parquet(f"{out_path.rstrip('/')}/batch_id={batch_id}")
    seen.add(fresh.select("_key", "part"), batch_id)


def stream_new_entries_batched(stream: DataFrame, key: str, out_path: str, state_path: str, checkpoint: str,
                               parts: int = PARTS, bitmaps: int = BITMAPS, trigger: dict | None = None):
    """Start a query that writes each entry once, however often and late it is announced.

    The form of :func:`~gridweave.streaming.grouping.stream_new_entries` for keys without bound: same
    entries, but the seen keys are files on shared storage instead of a state store that holds them
    all.  ``parts`` and ``bitmaps`` are fixed for the life of a stream; a fuller filter reads more
    partitions and never changes the result.
    """
    def step(batch, batch_id):
        new_entries_batch_step(batch, batch_id, key, out_path, state_path, parts, bitmaps)

    w = stream.writeStream.foreachBatch(step).option("checkpointLocation", checkpoint)
    return w.trigger(**(trigger or {"availableNow": True})).start()
