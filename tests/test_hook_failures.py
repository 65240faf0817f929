import pytest
from pyspark.sql import functions as F

from gridweave.operators.hooks import WorkflowProcessingError, mark_failures, post_command, pre_command


def test_failed_rows_are_named_and_counted_in_one_scan(spark, tmpdir_path):
    scanned = spark.sparkContext.accumulator(0)

    def count_rows(batches):
        for batch in batches:
            scanned.add(batch.num_rows)
            yield batch

    rows = [(1, "12"), (2, "x"), (3, None), (4, ""), (5, "-7")]
    df = spark.createDataFrame(rows, "id int, text string")
    df = df.mapInArrow(count_rows, df.schema)
    parse = pre_command(lambda d: d.withColumn("n", F.col("text").try_cast("int")), "Parse",
                        fails=F.col("text").isNotNull() & F.col("n").isNull())
    rename = pre_command(lambda d: d.withColumn("m", F.col("n") * 2), "Double")
    positive = pre_command(lambda d: d.withColumn("k", F.lit(1)), "Positive", fails=F.col("m") < 0)
    out, seen = mark_failures(df, "pre", [parse, rename, positive])
    out.write.parquet(f"{tmpdir_path}/out")
    assert seen.get == {"rows": 5, "Parse": 2, "Positive": 1}
    assert scanned.value == 5
    got = {r.id: r.failed_command for r in spark.read.parquet(f"{tmpdir_path}/out").collect()}
    assert got == {1: None, 2: "Parse", 3: None, 4: "Parse", 5: "Positive"}


def test_refusals_and_empty_frames(spark):
    df = spark.createDataFrame([(1,)], "id int")
    always = pre_command(lambda d: d, "A", fails=F.lit(True))
    with pytest.raises(WorkflowProcessingError, match="'Cut' loses"):
        mark_failures(df, "pre", [pre_command(lambda d: d.select("id"), "Cut")])
    with pytest.raises(ValueError, match="names of their own"):
        mark_failures(df, "pre", [always, always])
    with pytest.raises(ValueError, match="failed_command"):
        mark_failures(df.selectExpr("*", "1 AS failed_command"), "pre", [always])
    with pytest.raises(TypeError):
        mark_failures(df, "pre", [post_command(lambda d: d, "Post")])
    out, seen = mark_failures(df.limit(0), "pre", [always])
    assert out.collect() == [] and seen.get == {"rows": 0, "A": 0}
