"""What changed between two states of a catalog."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gridweave.operators.catalog import no_clash

#: Kinds of change.
NEW, REPLACED, REMOVED = "added", "replaced", "removed"


def catalog_changes(old: DataFrame, new: DataFrame, key: str = "lfn") -> DataFrame:
    """``key``, ``change`` and the digests ``before`` and ``after`` of every entry that is not the same in both.

    ``change`` is ``added``, ``removed`` or ``replaced`` (the key has other content); a digest is null
    where the entry is not there.  Content is all columns but the key, compared by name, so a column that only one
    state has makes entries with a value in it ``replaced``.  Keys are unique in each state; rows without a key
    are no entries.  Only keys and digests of 32 bytes meet in the join.  A key named ``change``,
    ``before`` or ``after`` is refused.
    """
    no_clash(old.select(key), ["change", "before", "after"])

    def digests(state, name):
        content = [F.col(c) for c in sorted(state.columns) if c != key]
        text = F.to_json(F.struct(*content)) if content else F.lit("{}")
        # under another name the key keeps the buckets of a union of layers for the join
        return state.where(F.col(key).isNotNull()).select(F.col(key).alias("_key"), F.unhex(F.sha2(text, 256)).alias(name))

    both = digests(old, "before").join(digests(new, "after"), "_key", "full").withColumnRenamed("_key", key)
    change = (F.when(F.col("before").isNull(), F.lit(NEW)).when(F.col("after").isNull(), F.lit(REMOVED))
              .when(F.col("before") != F.col("after"), F.lit(REPLACED)))
    return both.withColumn("change", change).where(F.col("change").isNotNull()).select(key, "change", "before", "after")
