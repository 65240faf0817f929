"""Fixed-size grouping of catalog entries into job inputs, group limits, zipping, query unions.

``fixed_groups`` numbers the rows of every key by ``order`` and cuts them into consecutive groups
of exactly ``size`` rows; the incomplete tail is dropped.  Two exact ways to number the rows:

* ``window`` - ``row_number()`` over ``partitionBy(keys)``: one task per key.  Right when every
  key is small.
* ``split`` - for keys too large for one task: a global range sort on ``(keys, order)`` spreads a
  hot key over many partitions; after a reliable checkpoint (fixed partition ids and positions)
  each partition's run of a key gets its offset from a prefix sum of the run lengths of the earlier
  partitions.  The run table has at most one row per (partition, key).

``auto`` picks ``window`` when the whole input has at most ``hot_rows`` rows (one count); otherwise
it materialises the input (reliable checkpoint), measures its largest key with one aggregation and
picks ``split`` when that exceeds ``hot_rows``.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from gridweave.operators._joins import broadcast_if_small, null_safe_join
from gridweave.operators.catalog import no_clash
from gridweave.session import checkpoint_dir

# Rows above which one key is numbered with the split method.
HOT_ROWS = 4_000_000


def largest_key(df: DataFrame, keys: Sequence[str]) -> int:
    row = df.groupBy(*keys).count().agg(F.max("count").alias("m")).first()
    return int(row["m"] or 0)


def rank_within(df: DataFrame, keys: Sequence[str], order: str, method: str = "auto",
                hot_rows: int = HOT_ROWS, first: int | None = None) -> DataFrame:
    """Add ``rn`` (1, 2, ...) numbering the rows of every key by ``order`` (unique per key).

    Null is a key like any other, in both methods.  With ``first`` only the first rows of every
    key are kept; in the window method Spark then drops the others before its shuffle.  The columns
    ``rn``, ``_pid``, ``_pos``, ``_first`` and ``_before`` are refused in the input.
    """
    keys = list(keys)
    no_clash(df, ["rn", "_pid", "_pos", "_first", "_before"])
    if method == "auto":
        # no key is larger than the whole input: a count (no column read) settles small inputs
        if df.count() <= hot_rows:
            method = "window"
        else:
            # one pass over the materialised input sizes the keys; both ways then read it back
            checkpoint_dir(df.sparkSession)
            df = df.checkpoint(eager=True)
            method = "split" if largest_key(df, keys) > hot_rows else "window"
    if method == "window":
        ranked = df.withColumn("rn", F.row_number().over(Window.partitionBy(*keys).orderBy(order)))
        if first is not None:
            ranked = ranked.filter(F.col("rn") <= first)
        return ranked.withColumn("rn", F.col("rn").cast("long"))
    if method != "split":
        raise ValueError(f"unknown method {method!r}")
    spark = df.sparkSession
    checkpoint_dir(spark)
    cols = df.columns
    sorted_rows = (df.repartitionByRange(*keys, order).sortWithinPartitions(*keys, order)
                     .withColumn("_pid", F.spark_partition_id())
                     .withColumn("_pos", F.monotonically_increasing_id())
                     .checkpoint(eager=True))
    runs = sorted_rows.groupBy("_pid", *keys).agg(F.count(F.lit(1)).alias("_n"),
                                                 F.min("_pos").alias("_first"))
    before = Window.partitionBy(*keys).orderBy("_pid").rowsBetween(Window.unboundedPreceding, -1)
    runs = runs.withColumn("_before", F.coalesce(F.sum("_n").over(before), F.lit(0)).cast("long"))
    runs = runs.select("_pid", *keys, "_first", "_before").checkpoint(eager=True)
    ranked = null_safe_join(sorted_rows, broadcast_if_small(runs), ["_pid", *keys])
    rn = F.col("_pos") - F.col("_first") + F.col("_before") + 1
    ranked = ranked.select(*cols, rn.alias("rn"))
    return ranked if first is None else ranked.filter(F.col("rn") <= first)


def fixed_groups(df: DataFrame, keys: Sequence[str], order: str, size: int | str,
                 value: str | None = None, method: str = "auto",
                 hot_rows: int = HOT_ROWS, max_groups: int | None = None) -> DataFrame:
    """Consecutive groups of exactly ``size`` rows per key, ordered by ``order``.

    ``size`` is a number or the name of a column with each key's own size (positive, and the same
    in all rows of a key; a key without one gives no group).

    Returns ``keys..., gid, members, n``: ``gid`` counts from 0, ``members`` holds ``value``
    (default ``order``) in order.  Keys with fewer than ``size`` rows give no group; the tail
    after the last full group is dropped.  ``max_groups`` keeps the first groups of every key and
    ranks no more rows than those need.  The input may have columns of any name; keys named
    ``gid``, ``members`` or ``n`` are refused, as the result has such columns itself.
    """
    keys = list(keys)
    no_clash(df.select(*keys), ["gid", "members", "n"])
    value = value or order
    if isinstance(size, str):
        if max_groups is not None:
            raise ValueError("max_groups needs one size for all keys")
        own_size = F.col(size).cast("long")
    elif size <= 0:
        raise ValueError("group size must be positive")
    else:
        own_size = F.lit(size).cast("long")
    # own names from here on, so that no column of the caller's is in the way
    own = [f"_k{i}" for i in range(len(keys))]
    base = df.select(*[F.col(k).alias(o) for k, o in zip(keys, own, strict=True)], F.col(order).alias("_order"),
                     *([F.col(value).alias("_value")] if value != order else []), own_size.alias("_size"))
    if isinstance(size, str):
        base = base.filter(F.when(F.col("_size") > 0, True).otherwise(F.when(
            F.col("_size").isNotNull(), F.raise_error(F.lit("group size must be positive")).cast("boolean"))))
    ranked = rank_within(base, own, "_order", method, hot_rows, None if max_groups is None else max_groups * size)
    ranked = ranked.withColumn("gid", F.floor((F.col("rn") - 1) / F.col("_size")).cast("long"))
    groups = ranked.groupBy(*own, "gid", "_size").agg(
        F.array_sort(F.collect_list(F.struct("rn", F.col("_value" if value != order else "_order").alias("v")))).alias("_m"),
        F.count(F.lit(1)).alias("n"))
    return (groups.filter(F.col("n") == F.col("_size"))
                  .select(*[F.col(o).alias(k) for k, o in zip(keys, own, strict=True)], "gid",
                          F.transform("_m", lambda m: m["v"]).alias("members"), "n"))


def group_limit(groups: DataFrame, n: int) -> DataFrame:
    """The first ``n`` groups of every key (a filter on ``gid``, not a global ``limit``)."""
    return groups.filter(F.col("gid") < n)


def zip_groups(groups: DataFrame, inputs: DataFrame, task_keys: Sequence[str],
               input_col: str = "input_name", pos_col: str = "input_pos") -> DataFrame:
    """Job ``i`` of a task takes the ``i``-th group of every declared input of the task.

    ``inputs`` declares ``(task_keys..., input_name, input_pos)``.  A job exists only when every
    declared input has its ``i``-th group, which cuts the jobs to the shortest input (group ids
    are dense from 0).  Returns ``task_keys..., gid, inputs`` where ``inputs`` is an array of
    ``struct(input_pos, input_name, members)`` in declared order.
    """
    task_keys = list(task_keys)
    declared = inputs.groupBy(*task_keys).agg(F.count(F.lit(1)).alias("_n_inputs"))
    tagged = null_safe_join(groups, inputs.select(*task_keys, input_col, pos_col), [*task_keys, input_col])
    jobs = tagged.groupBy(*task_keys, "gid").agg(
        F.array_sort(F.collect_list(F.struct(F.col(pos_col).alias("input_pos"),
                                             F.col(input_col).alias("input_name"),
                                             F.col("members").alias("members")))).alias("inputs"),
        F.count(F.lit(1)).alias("_have"))
    return (null_safe_join(jobs, declared, task_keys)
                .filter(F.col("_have") == F.col("_n_inputs"))
                .select(*task_keys, "gid", "inputs"))


def union_queries(*frames: DataFrame) -> DataFrame:
    """Results of several queries appended; duplicates kept (UNION ALL)."""
    if not frames:
        raise ValueError("nothing to union")
    out = frames[0]
    for f in frames[1:]:
        out = out.unionByName(f)
    return out
