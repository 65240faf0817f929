import os

from pyspark.sql import functions as F

from conftest import SF_SMALL
from gridweave.streaming.grouping import catalog_stream, stream_fixed_groups, stream_new_entries, stream_zip_groups
from gridweave.streaming.jobs import run_to_table, stream_jobs


def _write_batches(spark, root, n_batches=3):
    ev = spark.read.parquet(f"{SF_SMALL}/events.parquet").select("event_id", "event_type")
    os.makedirs(root, exist_ok=True)
    parts = ev.randomSplit([1.0] * n_batches, seed=3)
    for i, p in enumerate(parts):
        p.coalesce(1).write.parquet(os.path.join(root, f"b{i}"))
    return ev


def _stream(spark, root, schema):
    # one file per micro-batch
    return (spark.readStream.schema(schema).option("maxFilesPerTrigger", 1)
                 .option("recursiveFileLookup", "true").parquet(root))


def test_stream_groups_match_batch_counts(spark, tmpdir_path):
    root = os.path.join(tmpdir_path, "in")
    ev = _write_batches(spark, root)
    g = stream_fixed_groups(_stream(spark, root, ev.schema), ["event_type"], "event_id", 7)
    out = run_to_table(g, "t1")
    counts = {r.event_type: r.c for r in ev.groupBy("event_type").agg(F.count("*").alias("c")).collect()}
    got = {r.event_type: (r.n, r.maxgid, r.members) for r in
           out.groupBy("event_type").agg(F.count("*").alias("n"), F.max("gid").alias("maxgid"),
                                         F.sum(F.size("members")).alias("members")).collect()}
    for k, c in counts.items():
        assert got.get(k, (0, -1, 0))[0] == c // 7
        assert got.get(k, (0, -1, 0))[1] == c // 7 - 1
    flat = out.select(F.explode("members").alias("m"))
    assert flat.count() == flat.distinct().count()


def test_stream_zip_and_jobs(spark, tmpdir_path):
    root = os.path.join(tmpdir_path, "in")
    ev = _write_batches(spark, root)
    s = _stream(spark, root, ev.schema).withColumn("task_id", F.lit("t"))
    z = stream_zip_groups(s, ["task_id"], "event_type", ["click", "view"], "event_id", 5)
    n_click = ev.filter("event_type = 'click'").count() // 5
    n_view = ev.filter("event_type = 'view'").count() // 5
    out = run_to_table(z, "t2")
    assert out.count() == min(n_click, n_view)
    assert sorted(r.gid for r in out.select("gid").collect()) == list(range(min(n_click, n_view)))

    # the job sink writes each batch under its id; replaying a batch overwrites it
    base = os.path.join(tmpdir_path, "jobs")
    z2 = stream_zip_groups(_stream(spark, root, ev.schema).withColumn("task_id", F.lit("t")),
                           ["task_id"], "event_type", ["click", "view"], "event_id", 5)
    q = stream_jobs(z2, os.path.join(base, "out"), os.path.join(base, "ck"),
                    lambda b: b.select("gid", F.size("members").alias("k")))
    q.awaitTermination()
    jobs = spark.read.parquet(os.path.join(base, "out"))
    assert jobs.count() == min(n_click, n_view)
    assert set(jobs.columns) >= {"gid", "k", "batch_id"}


def test_stream_new_entries(spark, tmpdir_path):
    root = os.path.join(tmpdir_path, "dups")
    df = spark.range(20).select((F.col("id") % 7).cast("string").alias("lfn"))
    df.coalesce(1).write.parquet(os.path.join(root, "a"))
    df.coalesce(1).write.parquet(os.path.join(root, "b"))
    s = catalog_stream(spark, root, schema=df.schema, max_files_per_trigger=1)
    s = spark.readStream.schema(df.schema).option("maxFilesPerTrigger", 1).option("recursiveFileLookup", "true").parquet(root)
    out = run_to_table(stream_new_entries(s), "t3")
    assert sorted(r.lfn for r in out.collect()) == [str(i) for i in range(7)]


def test_new_entries_of_old_lines_in_a_late_file(spark, tmpdir_path):
    import datetime

    import pyarrow as pa
    import pyarrow.parquet as pq

    from gridweave.plans.stream_queries import FILES_PER_BATCH, stream_new_entries_lineitem

    folder = os.path.join(tmpdir_path, "lineitem.parquet")
    os.makedirs(folder)
    for i in range(2 * FILES_PER_BATCH + 1):  # the last files hold lines thirty years older
        day = datetime.date(2020 if i < FILES_PER_BATCH else 1990, 1, 1)
        path = os.path.join(folder, f"part-{i:05}.parquet")
        pq.write_table(pa.table({"l_orderkey": [i, 0], "l_shipdate": [day, day]}), path)
        os.utime(path, (1_700_000_000 + i, 1_700_000_000 + i))
    got = sorted(r.lfn for r in stream_new_entries_lineitem(spark, tmpdir_path).collect())
    assert got == [f"/orders/{i}" for i in range(2 * FILES_PER_BATCH + 1)]


def test_batched_stream_groups_equal_stateful(spark, tmpdir_path):
    from gridweave.streaming.grouping import stream_fixed_groups_batched

    root = os.path.join(tmpdir_path, "in")
    ev = _write_batches(spark, root, n_batches=3)
    stateful = run_to_table(stream_fixed_groups(_stream(spark, root, ev.schema), ["event_type"], "event_id", 7), "t4")
    base = os.path.join(tmpdir_path, "batched")
    for method in ["window", "split"]:
        q = stream_fixed_groups_batched(_stream(spark, root, ev.schema), ["event_type"], "event_id", 7,
                                        os.path.join(base, method, "out"), os.path.join(base, method, "state"),
                                        os.path.join(base, method, "ck"), method=method)
        q.awaitTermination()
        batched = spark.read.parquet(os.path.join(base, method, "out")).drop("batch_id")

        def norm(df):
            return sorted((r.event_type, r.gid, tuple(str(x) for x in r.members))
                          for r in df.select("event_type", "gid", "members").collect())

        assert norm(batched) == norm(stateful)


def test_batched_zip_equals_stateful(spark, tmpdir_path):
    from gridweave.streaming.grouping import stream_zip_groups_batched

    root = os.path.join(tmpdir_path, "in")
    ev = _write_batches(spark, root, n_batches=3)

    def src():
        return _stream(spark, root, ev.schema).withColumn("task_id", F.lit("t"))

    stateful = run_to_table(stream_zip_groups(src(), ["task_id"], "event_type", ["click", "view"], "event_id", 5), "t5")
    want = sorted((r.gid, tuple(tuple(m) for m in r.members)) for r in stateful.collect())
    inputs = spark.createDataFrame([("t", "click", 0), ("t", "view", 1)], "task_id string, event_type string, input_pos int")
    base = os.path.join(tmpdir_path, "zb")
    q = stream_zip_groups_batched(src(), ["task_id"], "event_type", inputs, "event_id", 5,
                                  os.path.join(base, "out"), os.path.join(base, "state"), os.path.join(base, "ck"))
    q.awaitTermination()
    out = spark.read.parquet(os.path.join(base, "out"))
    got = sorted((r.gid, tuple(tuple(i.members) for i in r.inputs)) for r in out.collect())
    assert got == want and len(got) > 0
    stats = spark.read.parquet(os.path.join(base, "state", "stats"))
    last = stats.agg(F.max("batch_id")).first()[0]
    waiting = {r.event_type: r.waiting_groups for r in stats.filter(F.col("batch_id") == last).collect()}
    n_click = ev.filter("event_type = 'click'").count() // 5
    n_view = ev.filter("event_type = 'view'").count() // 5
    faster = "click" if n_click > n_view else "view"
    assert waiting.get(faster, 0) == abs(n_click - n_view)
