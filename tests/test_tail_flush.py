import os
import time

from gridweave.streaming.grouping import fixed_groups_batch_step, stream_fixed_groups_batched

SCHEMA = "k string, id long"


def _out(spark, base):
    got = spark.read.parquet(f"{base}/out").collect()
    return sorted(((r.batch_id, r.k, r.gid, list(r.members)) for r in got), key=str)


def _step(spark, base, batch_id, rows, now):
    fixed_groups_batch_step(spark.createDataFrame(rows, SCHEMA), batch_id, ["k"], "id", 3, "id", f"{base}/out",
                            f"{base}/state", flush_after_ms=100, now_ms=now)


def test_idle_keys_give_short_groups_and_replays_repeat_them(spark, tmpdir_path):
    base = tmpdir_path
    _step(spark, base, 0, [("a", 1), ("a", 2), ("b", 1), ("b", 2), ("b", 3), (None, 9)], 1000)
    _step(spark, base, 1, [("b", 4)], 1050)   # nothing is due yet
    _step(spark, base, 2, [("c", 1)], 1120)   # a and the null key are due, b is not
    want = [(0, "b", 0, ["1", "2", "3"]), (2, "a", 0, ["1", "2"]), (2, None, 0, ["9"])]
    assert _out(spark, base) == sorted(want, key=str)
    _step(spark, base, 2, [("c", 1)], 9999)   # a replay takes the time of the first run
    assert _out(spark, base) == sorted(want, key=str)
    _step(spark, base, 3, [("a", 3), ("b", 5), ("b", 6)], 1500)  # ids go on; a touched key is not due
    _step(spark, base, 4, [], 1550)           # c was idle at 1500 already: flushed there
    _step(spark, base, 5, [], 1700)
    want += [(3, "b", 1, ["4", "5", "6"]), (3, "c", 0, ["1"]), (5, "a", 1, ["3"])]
    assert _out(spark, base) == sorted(want, key=str)


def test_waiting_query_flushes_without_new_entries_and_ends_in_time(spark, tmpdir_path):
    source = os.path.join(tmpdir_path, "in")
    spark.createDataFrame([("a", i) for i in range(5)], SCHEMA).coalesce(1).write.parquet(source)
    entries = spark.readStream.schema(SCHEMA).parquet(source)
    q = stream_fixed_groups_batched(entries, ["k"], "id", 3, f"{tmpdir_path}/out", f"{tmpdir_path}/state",
                                    f"{tmpdir_path}/ck", trigger={"processingTime": "1 second"}, flush_after_ms=1500)
    limit, members = time.time() + 60, []
    try:
        while time.time() < limit and len(members) < 2 and q.isActive:
            time.sleep(1)
            if os.path.exists(f"{tmpdir_path}/out/batch_id=0/_SUCCESS"):
                members = sorted(r.members for r in spark.read.schema("k string, gid long, members array<string>, n long")
                                 .parquet(f"{tmpdir_path}/out/*").collect())
    finally:
        q.stop()
    assert members == [["0", "1", "2"], ["3", "4"]]
