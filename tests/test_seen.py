"""New entries against a table of seen keys."""

import os

import pytest
from pyspark.sql import functions as F

from conftest import rows
from gridweave.streaming import seen


def _run(spark, base, batches, schema="lfn string, x int", **kw):
    got = []
    for i, own in enumerate(batches):
        seen.new_entries_batch_step(spark.createDataFrame(own, schema), i, "lfn", f"{base}/out", f"{base}/state", **kw)
        got.append(rows(spark.read.parquet(f"{base}/out/batch_id={i}").select(F.coalesce("lfn", F.lit("null")), "x")))
    return got


@pytest.mark.parametrize("bitmaps", [1, 8])
def test_each_key_once_over_batches(spark, tmpdir_path, bitmaps):
    batches = [[("a", 2), ("a", 1), ("b", 5), (None, 3)], [("a", 0), ("c", 1), (None, 1), ("-", 7), ("=a", 8)], [], [("b", 1), ("=a", 1)]]
    got = _run(spark, tmpdir_path, batches, parts=3, bitmaps=bitmaps)
    assert got == [[("a", 1), ("b", 5), ("null", 3)], [("-", 7), ("=a", 8), ("c", 1)], [], []]


def test_merged_rounds_and_replay(spark, tmpdir_path, monkeypatch):
    monkeypatch.setattr(seen, "MERGE_EVERY", 2)
    batches = [[(f"k{j % (3 * i + 4)}", i) for j in range(12)] for i in range(6)]
    got = _run(spark, tmpdir_path, batches, parts=2, bitmaps=1)
    flat = [k for own in got for k, _ in own]
    assert sorted(flat) == sorted({k for own in batches for k, _ in own}) and len(flat) == len(set(flat))
    assert not os.path.exists(f"{tmpdir_path}/state/keys/batch_id=0") and os.path.exists(f"{tmpdir_path}/state/keys/merged=2")
    step = spark.createDataFrame(batches[5], "lfn string, x int")
    seen.new_entries_batch_step(step, 5, "lfn", f"{tmpdir_path}/out", f"{tmpdir_path}/state", 2, 1)
    assert rows(spark.read.parquet(f"{tmpdir_path}/out/batch_id=5")) == got[5]


def test_filter_has_no_false_negatives_and_few_false_positives(spark, tmpdir_path):
    table = seen.SeenKeys(spark, tmpdir_path, parts=4, bitmaps=4)

    def keys(first, n):
        return spark.range(first, first + n).select(F.col("id").cast("string").alias("_key")).withColumn("part", seen._part(4))

    table.add(keys(0, 5000), 0)
    assert table.possible(keys(0, 5000), 1).count() == 5000
    assert table.possible(keys(5000, 5000), 1).count() < 100
    assert table.unseen(keys(4000, 3000), 1).count() == 2000


def test_only_partitions_that_may_hold_a_key_are_read(spark, tmpdir_path, monkeypatch):
    table, read = seen.SeenKeys(spark, tmpdir_path, parts=8, bitmaps=8), []
    own = spark.range(100).select(F.col("id").cast("string").alias("_key")).withColumn("part", seen._part(8))
    table.add(own, 0)
    inner = seen.SeenKeys._read
    monkeypatch.setattr(seen.SeenKeys, "_read", lambda self, t, b, parts=None: read.append((t, parts)) or inner(self, t, b, parts))
    table.unseen(own.where("_key = '7'"), 1).count()
    assert [len(p) for t, p in read if t == "keys"] == [1]


def test_missing_state_raises(spark, tmpdir_path):
    with pytest.raises(RuntimeError, match="missing"):
        seen.new_entries_batch_step(spark.createDataFrame([("a",)], "lfn string"), 3, "lfn", f"{tmpdir_path}/o", f"{tmpdir_path}/s")
