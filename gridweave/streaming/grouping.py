"""Grouping new catalog entries into fixed-size job inputs as they arrive.

State per key lives in Spark's state store (checkpointed with the query): the entries still
waiting for a full group and the next group id.  A group is emitted once it is full; the
incomplete tail waits for later micro-batches (optionally flushed after a processing-time timeout).
The pending list of a key never holds more than ``size - 1`` entries between batches.
"""

from __future__ import annotations

import time
from collections.abc import Sequence

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming.state import GroupStateTimeout

from gridweave.operators._joins import null_safe_join
from gridweave.session import checkpoint_dir, delete_path, path_exists
from gridweave.sources.catalog import CATALOG_SCHEMA
from gridweave.streaming.jobs import POLL_INTERVAL
from gridweave.streaming.state import KeyedState


def catalog_stream(spark: SparkSession, path: str, schema=CATALOG_SCHEMA, fmt: str = "parquet",
                   max_files_per_trigger: int | None = None, glob: str | None = None) -> DataFrame:
    """New catalog files under ``path`` as a stream (fixed schema, no inference)."""
    reader = spark.readStream.schema(schema).format(fmt)
    if max_files_per_trigger:
        reader = reader.option("maxFilesPerTrigger", max_files_per_trigger)
    if glob:
        reader = reader.option("pathGlobFilter", glob)
    return reader.load(path)


def stream_new_entries(stream: DataFrame, key: str = "lfn", event_time: str | None = None,
                       delay: str | None = None) -> DataFrame:
    """Each entry once, however often it is announced.

    Without an event-time column the seen keys are kept for the life of the query; with one, only
    for ``delay`` after the watermark (``dropDuplicatesWithinWatermark``).
    """
    if event_time and delay:
        return stream.withWatermark(event_time, delay).dropDuplicatesWithinWatermark([key])
    return stream.dropDuplicates([key])


def _fixed_groups_fn(keys: Sequence[str], size: int, flush_on_timeout: int):
    keys = list(keys)

    def emit(key, first_gid, groups):
        n = len(groups)
        return pd.DataFrame({**{k: [v] * n for k, v in zip(keys, key)},
                             "gid": [first_gid + i for i in range(n)],
                             "members": groups, "n": [len(g) for g in groups]})

    def fn(key, pdfs, state):
        if state.hasTimedOut:
            values, next_gid = state.get
            state.update(([], next_gid + (len(values) > 0)))
            if len(values):
                yield emit(key, next_gid, [list(values)])
            return
        values, next_gid = (list(state.get[0]), state.get[1]) if state.exists else ([], 0)
        new = [p[["_o", "_v"]] for p in pdfs]
        if new:
            batch = pd.concat(new, ignore_index=True).sort_values("_o", kind="stable")
            values += batch["_v"].tolist()
        n_full = len(values) // size
        if n_full:
            yield emit(key, next_gid, [values[i * size:(i + 1) * size] for i in range(n_full)])
        state.update((values[n_full * size:], next_gid + n_full))
        if flush_on_timeout:
            state.setTimeoutDuration(flush_on_timeout)

    return fn


def stream_fixed_groups(stream: DataFrame, keys: Sequence[str], order: str, size: int,
                        value: str | None = None, flush_after_ms: int | None = None) -> DataFrame:
    """Full groups of ``size`` entries per key as entries arrive (append mode).

    Inside a micro-batch entries are taken in ``order``; entries waiting from earlier batches come
    first.  Returns ``keys..., gid, members (array<string>), n``.  With ``flush_after_ms`` a key
    that receives nothing for that long emits its incomplete tail as a short group; its ids go on after it.
    """
    keys = list(keys)
    value = value or order
    key_types = {f.name: f.dataType.simpleString() for f in stream.schema.fields}
    rows = stream.select(*keys, F.col(order).alias("_o"), F.col(value).cast("string").alias("_v"))
    out_schema = ", ".join([f"{k} {key_types[k]}" for k in keys] + ["gid long", "members array<string>", "n long"])
    state_schema = "pending array<string>, next_gid long"
    timeout = GroupStateTimeout.ProcessingTimeTimeout if flush_after_ms else GroupStateTimeout.NoTimeout
    return rows.groupBy(*keys).applyInPandasWithState(
        _fixed_groups_fn(keys, size, flush_after_ms or 0), out_schema, state_schema, "append", timeout)


def _zip_fn(keys: Sequence[str], inputs: Sequence[str], size: int):
    keys = list(keys)
    inputs = list(inputs)

    def fn(key, pdfs, state):
        if state.exists:
            pend, queued, next_job = state.get
            pend = [list(x) for x in pend]
            queued = [[list(g) for g in q] for q in queued]
        else:
            pend = [[] for _ in inputs]
            queued = [[] for _ in inputs]
            next_job = 0
        new = [p[["_i", "_o", "_v"]] for p in pdfs]
        if new:
            batch = pd.concat(new, ignore_index=True).sort_values("_o", kind="stable")
            for i, name in enumerate(inputs):
                pend[i] += batch.loc[batch["_i"] == name, "_v"].tolist()
        for i in range(len(inputs)):
            n_full = len(pend[i]) // size
            queued[i] += [pend[i][g * size:(g + 1) * size] for g in range(n_full)]
            pend[i] = pend[i][n_full * size:]
        n_jobs = min(len(q) for q in queued)
        if n_jobs:
            yield pd.DataFrame({**{k: [v] * n_jobs for k, v in zip(keys, key)},
                                "gid": [next_job + j for j in range(n_jobs)],
                                "input_names": [list(inputs)] * n_jobs,
                                "members": [[queued[i][j] for i in range(len(inputs))] for j in range(n_jobs)]})
            queued = [q[n_jobs:] for q in queued]
        state.update((pend, queued, next_job + n_jobs))

    return fn


def stream_zip_groups(stream: DataFrame, keys: Sequence[str], input_col: str, inputs: Sequence[str],
                      order: str, size: int, value: str | None = None) -> DataFrame:
    """Jobs of a task as soon as every declared input has its next full group.

    Returns ``keys..., gid, input_names, members (array<array<string>>)`` with members in the
    order of ``inputs``.  The state holds the full groups of fast inputs until the slowest input
    catches up (its size is the backlog of that input).
    """
    keys = list(keys)
    value = value or order
    key_types = {f.name: f.dataType.simpleString() for f in stream.schema.fields}
    rows = stream.filter(F.col(input_col).isin(list(inputs))).select(
        *keys, F.col(input_col).cast("string").alias("_i"), F.col(order).alias("_o"),
        F.col(value).cast("string").alias("_v"))
    out_schema = ", ".join([f"{k} {key_types[k]}" for k in keys] +
                           ["gid long", "input_names array<string>", "members array<array<string>>"])
    state_schema = "pend array<array<string>>, queued array<array<array<string>>>, next_job long"
    return rows.groupBy(*keys).applyInPandasWithState(
        _zip_fn(keys, inputs, size), out_schema, state_schema, "append", GroupStateTimeout.NoTimeout)


def _batch_time(spark: SparkSession, path: str, batch_id: int, now_ms: int | None) -> int:
    """The time of a batch in milliseconds, written down so that a replay of the batch takes it again."""
    folder = f"{path.rstrip('/')}/clock/batch_id={batch_id}"
    if not path_exists(spark, f"{folder}/_SUCCESS"):
        now = int(time.time() * 1000) if now_ms is None else now_ms
        spark.range(1).select(F.lit(now).cast("long").alias("now")).write.mode("overwrite").parquet(folder)
        delete_path(spark, f"{path.rstrip('/')}/clock/batch_id={batch_id - 2}")
    return spark.read.schema("now long").parquet(folder).first()[0]


def fixed_groups_batch_step(batch: DataFrame, batch_id: int, keys: Sequence[str], order: str, size: int,
                            value: str, out_path: str, state_path: str, method: str = "auto",
                            flush_after_ms: int | None = None, now_ms: int | None = None) -> None:
    """One micro-batch of :func:`stream_fixed_groups_batched` (also callable on its own).

    Rows of this batch plus the tails of its keys are numbered per key by (arrival batch,
    ``order``) with the batch ranking (which splits a hot key over many tasks) and cut into groups
    of ``size``; full groups are written to ``out_path/batch_id=<id>``, the incomplete tail and the
    next group id of the keys of this batch to the :class:`KeyedState` at ``state_path``.  Every
    write overwrites its own batch folder, so a replayed batch gives the same files again; a batch
    whose predecessor's state is missing raises.

    With ``flush_after_ms`` the state also holds when a key last received an entry.  A key with a tail that
    has received nothing for that long, and nothing in this batch, gives its tail as a short group
    and takes the group id after it; later entries of the key start the next group.  The
    time is that of the batch's first run (or ``now_ms``), kept beside the state for replays.
    """
    from gridweave.operators.grouping import rank_within

    spark = batch.sparkSession
    checkpoint_dir(spark)
    keys = list(keys)
    new = batch.select(*keys, F.lit(batch_id).cast("long").alias("_arrival"), F.col(order).alias("_o"),
                       F.col(value).cast("string").alias("_v")).checkpoint(eager=True)
    own = [new.schema[k] for k in keys]
    last = T.StructField("last", T.LongType())
    state = KeyedState(spark, state_path, own, [new.schema[c] for c in ("_arrival", "_o", "_v")],
                       [last] if flush_after_ms else [])
    before = state.load(batch_id)
    touched = new.select(*keys).distinct()
    if flush_after_ms:
        now = _batch_time(spark, state_path, batch_id, now_ms)
        idle = before[0].filter(F.col("last") <= now - flush_after_ms).select(*keys)
        idle = null_safe_join(null_safe_join(idle, before[1], keys, "left_semi"), touched, keys, "left_anti")
        touched = (touched.withColumn("_due", F.lit(False)).unionByName(idle.withColumn("_due", F.lit(True)))
                   .checkpoint(eager=True))
    rows = new.unionByName(null_safe_join(before[1], touched, keys, "left_semi").select(*new.columns))
    ranked = rank_within(rows.withColumn("_ord", F.struct("_arrival", "_o")), keys, "_ord", method)
    ranked = ranked.withColumn("_g", F.floor((F.col("rn") - 1) / F.lit(size)).cast("long"))
    groups = ranked.groupBy(*keys, "_g").agg(
        F.array_sort(F.collect_list(F.struct("rn", "_arrival", "_o", "_v"))).alias("_m"),
        F.count(F.lit(1)).alias("n"))
    if flush_after_ms:
        groups = null_safe_join(groups, touched, keys, "left")
    groups = groups.checkpoint(eager=True)
    whole = (F.col("n") == size) | F.col("_due") if flush_after_ms else F.col("n") == size
    full = groups.filter(whole)
    start = null_safe_join(full, before[0].select(*keys, F.col("n").alias("next_gid")), keys, "left")
    out = start.select(*keys, (F.coalesce(F.col("next_gid"), F.lit(0)) + F.col("_g")).alias("gid"),
                       F.transform("_m", lambda m: m["_v"]).alias("members"), "n")
    out.write.mode("overwrite").parquet(f"{out_path.rstrip('/')}/batch_id={batch_id}")
    made = full.groupBy(*keys).agg(F.count(F.lit(1)).alias("_made"))
    counters = null_safe_join(null_safe_join(touched, made, keys, "left"), before[0], keys, "left")
    counters = counters.select(
        *keys, (F.coalesce("n", F.lit(0)) + F.coalesce("_made", F.lit(0))).alias("n"),
        *([F.when(F.col("_due"), F.col("last")).otherwise(F.lit(now)).alias("last")] if flush_after_ms else []))
    tails = groups.filter(~whole).select(*keys, F.inline("_m")).drop("rn")
    state.store(batch_id, counters.checkpoint(eager=True), tails, before)


def stream_fixed_groups_batched(stream: DataFrame, keys: Sequence[str], order: str, size: int,
                                out_path: str, state_path: str, checkpoint: str, value: str | None = None,
                                method: str = "auto", trigger: dict | None = None,
                                flush_after_ms: int | None = None):
    """Start a query that cuts arriving entries into full groups with Spark jobs per micro-batch.

    The scale alternative to :func:`stream_fixed_groups`: no key is ever handled by one task
    (the batch ranking splits hot keys), state is a pair of tables per batch on shared
    storage (the tail below ``size`` rows per key and the next group id, of the keys that changed),
    and output is exactly once by batch id.  Same groups as :func:`stream_fixed_groups` for the same batches.

    ``flush_after_ms`` also gives the tail of a key that has received nothing for that long.  A tail falls due
    without any entry arriving, so the entries are then read beside Spark's ``rate`` source, whose one row
    a second only starts the next micro-batch; such a query runs until it is stopped, by default
    every :data:`~gridweave.streaming.jobs.POLL_INTERVAL`.
    """
    value = value or order
    wanted = list(dict.fromkeys([*keys, order, value]))
    if flush_after_ms:
        beat = stream.sparkSession.readStream.format("rate").option("rowsPerSecond", 1).load()
        none = [F.lit(None).cast(stream.schema[c].dataType).alias(c) for c in wanted]
        stream = (stream.select(*wanted, F.lit(False).alias("_beat"))
                  .unionByName(beat.select(*none, F.lit(True).alias("_beat"))))
        trigger = trigger or {"processingTime": POLL_INTERVAL}

    def step(batch, batch_id):
        if flush_after_ms:
            batch = batch.filter(~F.col("_beat"))
        fixed_groups_batch_step(batch, batch_id, keys, order, size, value, out_path, state_path, method, flush_after_ms)

    w = stream.writeStream.foreachBatch(step).option("checkpointLocation", checkpoint)
    return w.trigger(**(trigger or {"availableNow": True})).start()


def zip_groups_batch_step(batch: DataFrame, batch_id: int, task_keys: Sequence[str], input_col: str,
                          inputs: DataFrame, order: str, size: int, value: str, out_path: str,
                          state_path: str, method: str = "auto") -> None:
    """One micro-batch of :func:`stream_zip_groups_batched`.

    The batch is cut into groups per (task, input) by :func:`fixed_groups_batch_step` (group ids
    continue across batches); the new groups plus those of the same tasks that still wait are
    zipped with :func:`~gridweave.operators.grouping.zip_groups` - a job exists once every declared
    input has its group of that id - and the groups not used yet are kept, per task, in a
    :class:`KeyedState`; ``state_path/stats`` holds how many groups wait per input of this batch's
    tasks (the backlog a slow input causes).  All writes overwrite their own batch folder.
    """
    from gridweave.operators.grouping import zip_groups

    spark = batch.sparkSession
    task_keys = list(task_keys)
    base = state_path.rstrip("/")
    keys = [*task_keys, input_col]
    fixed_groups_batch_step(batch, batch_id, keys, order, size, value, f"{base}/groups", f"{base}/grouping", method)
    own = [batch.schema[k] for k in task_keys]
    fields = [batch.schema[input_col], T.StructField("gid", T.LongType()),
              T.StructField("members", T.ArrayType(T.StringType()))]
    schema = T.StructType([*own, *fields])
    new = spark.read.schema(schema).parquet(f"{base}/groups/batch_id={batch_id}")
    state = KeyedState(spark, f"{base}/waiting", own, fields)
    before = state.load(batch_id)
    touched = new.select(*task_keys).distinct()
    groups = new.unionByName(null_safe_join(before[1], touched, task_keys, "left_semi").select(*new.columns))
    groups = groups.checkpoint(eager=True)
    jobs = zip_groups(groups, inputs, task_keys, input_col=input_col).checkpoint(eager=True)
    jobs.write.mode("overwrite").parquet(f"{out_path.rstrip('/')}/batch_id={batch_id}")
    left = null_safe_join(groups, jobs.select(*task_keys, "gid"), [*task_keys, "gid"], "left_anti").checkpoint(eager=True)
    waits = null_safe_join(touched, left.groupBy(*task_keys).agg(F.count(F.lit(1)).alias("n")), task_keys, "left")
    state.store(batch_id, waits.select(*task_keys, F.coalesce("n", F.lit(0)).alias("n")), left, before)
    (left.groupBy(*keys).agg(F.count(F.lit(1)).alias("waiting_groups"))
         .write.mode("overwrite").parquet(f"{base}/stats/batch_id={batch_id}"))


def stream_zip_groups_batched(stream: DataFrame, task_keys: Sequence[str], input_col: str,
                              inputs: DataFrame, order: str, size: int, out_path: str, state_path: str,
                              checkpoint: str, value: str | None = None, method: str = "auto",
                              trigger: dict | None = None):
    """Start a query that zips arriving entries into jobs with Spark jobs per micro-batch.

    The scale alternative to :func:`stream_zip_groups`: grouping splits hot keys, zipping is the
    batch operator, and the state (tails, next group ids, groups waiting for a slower input) is
    small tables per batch id on shared storage.  ``inputs`` declares ``(task_keys...,
    input_name, input_pos)`` as for :func:`~gridweave.operators.grouping.zip_groups`.
    """
    value = value or order

    def step(batch, batch_id):
        zip_groups_batch_step(batch, batch_id, task_keys, input_col, inputs, order, size, value,
                              out_path, state_path, method)

    w = stream.writeStream.foreachBatch(step).option("checkpointLocation", checkpoint)
    return w.trigger(**(trigger or {"availableNow": True})).start()
