from pyspark.sql import functions as F

from conftest import SF_SMALL, rows
from gridweave.operators.grouping import fixed_groups, group_limit, rank_within, union_queries, zip_groups


def test_split_equals_window_on_events(spark):
    ev = spark.read.parquet(f"{SF_SMALL}/events.parquet").select("event_type", "event_id")
    a = fixed_groups(ev, ["event_type"], "event_id", 7, method="window")
    b = fixed_groups(ev, ["event_type"], "event_id", 7, method="split")
    ra = rows(a.select("event_type", "gid", F.array_join("members", ","), "n"))
    rb = rows(b.select("event_type", "gid", F.array_join("members", ","), "n"))
    assert ra == rb and len(ra) > 0


def test_split_ranks_one_hot_key_across_partitions(spark):
    li = spark.read.parquet(f"{SF_SMALL}/lineitem.parquet")
    # one key holding every row, the rest tiny
    df = li.select(F.lit("hot").alias("k"), F.concat_ws("_", "l_orderkey", "l_linenumber", "l_partkey",
                                                         "l_suppkey").alias("o")).repartition(6)
    r = rank_within(df, ["k"], "o", method="split")
    got = r.agg(F.min("rn"), F.max("rn"), F.countDistinct("rn"), F.count("*")).first()
    n = df.count()
    assert tuple(got) == (1, n, n, n)
    w = rank_within(df, ["k"], "o", method="window")
    assert rows(r.select("o", "rn")) == rows(w.select("o", "rn"))


def test_auto_picks_split_for_hot_key(spark):
    df = spark.range(50).select(F.lit("k").alias("k"), F.col("id").alias("o"))
    a = fixed_groups(df, ["k"], "o", 10, method="auto", hot_rows=20)
    assert a.count() == 5
    assert list(a.filter("gid = 4").first().members) == [str(i) for i in range(40, 50)] or \
        list(a.filter("gid = 4").first().members) == list(range(40, 50))


def test_group_limit(spark):
    df = spark.range(100).select(F.lit("k").alias("k"), "id")
    g = group_limit(fixed_groups(df, ["k"], "id", 5), 3)
    assert rows(g, "gid") == [(0,), (1,), (2,)]


def test_zip_cuts_to_shortest_input(spark):
    data = [("t", "a", i) for i in range(12)] + [("t", "b", i) for i in range(7)] + [("u", "a", i) for i in range(9)]
    df = spark.createDataFrame(data, "task string, input_name string, o int")
    g = fixed_groups(df, ["task", "input_name"], "o", 3)
    inputs = spark.createDataFrame([("t", "a", 0), ("t", "b", 1), ("u", "a", 0), ("u", "c", 1)],
                                   "task string, input_name string, input_pos int")
    jobs = zip_groups(g, inputs, ["task"])
    got = rows(jobs.select("task", "gid", F.col("inputs")[0]["input_name"], F.col("inputs")[1]["input_name"]))
    # t: a has 4 groups, b has 2 -> 2 jobs; u: input c has no data -> no job
    assert got == [("t", 0, "a", "b"), ("t", 1, "a", "b")]
    second = jobs.filter("gid = 1").first().inputs
    assert list(second[0].members) == [3, 4, 5] and list(second[1].members) == [3, 4, 5]


def test_union_keeps_duplicates(spark):
    a = spark.range(3)
    assert union_queries(a, a, spark.range(2)).count() == 8


def test_flagship_same_jobs_with_split_ranking(spark):
    from gridweave.plans.catalog_queries import transformation_jobs
    a = rows(transformation_jobs(spark, SF_SMALL, method="window"))
    b = rows(transformation_jobs(spark, SF_SMALL, method="split"))
    assert a == b and len(a) > 0
