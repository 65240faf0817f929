import json
import os

import pytest
from pyspark.sql import functions as F

from conftest import rows
from gridweave.operators.hooks import (
    Command,
    WorkflowProcessingError,
    post_command,
    pre_command,
    run_hooks,
)
from gridweave.operators.points import estimate_pi
from gridweave.sources.params import read_parameters
from gridweave.sources.points import read_points, uniform_points, write_points
from gridweave.sources.sinks import StoreError, merge_text_outputs, write_merged, write_with_fallback


def _set_a(root):
    """Five files of three points each: 0.i 0.(i+1) / -0.(i+2) 0.(i+3) / 0.(i+4) -0.(i+5)."""
    os.makedirs(root, exist_ok=True)
    paths = []
    for i in range(1, 6):
        p = os.path.join(root, f"result_{i}.sim")
        with open(p, "w") as f:
            f.write(f"0.{i} 0.{i + 1}\n-0.{i + 2} 0.{i + 3}\n0.{i + 4} -0.{i + 5}\n")
        paths.append(p)
    return paths


def test_pi_goldens(spark, tmpdir_path):
    paths = _set_a(os.path.join(tmpdir_path, "a"))
    pts = read_points(spark, paths).withColumn("job", F.lit("j"))
    all_files = estimate_pi(pts, ["job"]).first()
    assert (all_files.n_inside, all_files.n_points) == (12, 15)
    assert abs(all_files.pi_estimate - 3.2) < 1e-12
    first = estimate_pi(pts, ["job"], first_file_only=True).first()
    assert abs(first.pi_estimate - 4.0) < 1e-12
    assert estimate_pi(pts.filter(F.lit(False)), []).first().pi_estimate is None


def test_bad_point_line(spark, tmpdir_path):
    p = os.path.join(tmpdir_path, "bad.sim")
    with open(p, "w") as f:
        f.write("0.1 0.2\n0.3\nx y\n")
    with pytest.raises(Exception):
        read_points(spark, p).collect()
    perm = read_points(spark, p, permissive=True)
    assert rows(perm.filter(F.col("reject").isNotNull()), "reject") == [("0.3",), ("x y",)]


def test_uniform_points_roundtrip(spark, tmpdir_path):
    pts = uniform_points(spark, 2000, seed=7, partitions=4)
    stats = pts.agg(F.min("x"), F.max("x"), F.min("y"), F.max("y"), F.count("*")).first()
    assert -1 <= stats[0] and stats[1] < 1 and -1 <= stats[2] and stats[3] < 1 and stats[4] == 2000
    out = os.path.join(tmpdir_path, "pts")
    write_points(pts, out)
    back = read_points(spark, out)
    assert back.count() == 2000
    est = estimate_pi(back, []).first().pi_estimate
    assert 2.8 < est < 3.5


def test_read_parameters(spark, tmpdir_path):
    msgs = ["Hello World", "Hola mundo", "Bonjour tout le monde"]
    paths = []
    for i, m in enumerate(msgs, 1):
        p = os.path.join(tmpdir_path, f"inputs{i}.json")
        with open(p, "w") as f:
            json.dump({"message": m, "n": i, "files": [{"class": "File", "path": "x"}]}, f)
        paths.append(p)
    df = read_parameters(spark, paths)
    assert sorted(r.value for r in df.filter("key = 'message'").collect()) == sorted(msgs)
    files = df.filter("key = 'files'").first().value
    assert json.loads(files)[0]["class"] == "File"
    bad = os.path.join(tmpdir_path, "bad.json")
    with open(bad, "w") as f:
        f.write("{not json")
    with pytest.raises(Exception):
        read_parameters(spark, paths + [bad]).collect()


def test_write_with_fallback(spark, tmpdir_path):
    df = spark.range(3)
    first = os.path.join(tmpdir_path, "se1")
    df.write.parquet(first)  # exists: errorifexists fails
    second = os.path.join(tmpdir_path, "se2")
    assert write_with_fallback(df, [first, second]) == second
    with pytest.raises(StoreError) as e:
        write_with_fallback(df, [first, second])
    assert "se1" in str(e.value) and "se2" in str(e.value)
    assert write_with_fallback(df, []) is None


def test_merge_text_outputs(spark, tmpdir_path):
    root = os.path.join(tmpdir_path, "jobs")
    for job in ["j1", "j2"]:
        os.makedirs(os.path.join(root, job))
        with open(os.path.join(root, job, "b.txt"), "w") as f:
            f.write("t1\nt2\n")
        with open(os.path.join(root, job, "a.out"), "w") as f:
            f.write("o1\n")
        with open(os.path.join(root, job, "group.out"), "w") as f:
            f.write("old\n")
    merged = merge_text_outputs(spark, root)
    out = os.path.join(tmpdir_path, "merged")
    write_merged(merged, out)
    lines = []
    d = os.path.join(out, "job=j1")
    for name in sorted(os.listdir(d)):
        if name.startswith("part-"):
            with open(os.path.join(d, name)) as f:
                lines += f.read().splitlines()
    a = os.path.join(root, "j1", "a.out")
    b = os.path.join(root, "j1", "b.txt")
    assert lines == [f"############ {a}", "o1", "", f"############ {b}", "t1", "t2", ""]


def test_hooks_order_stage_and_errors(spark):
    df = spark.range(3)
    add = pre_command(lambda d: d.withColumn("x", F.col("id") + 1), "Add")
    dbl = Command("Double", lambda d: d.withColumn("x", F.col("x") * 2))
    out = run_hooks(df, "pre", [add, dbl])
    assert rows(out, "x") == [(2,), (4,), (6,)]
    with pytest.raises(TypeError):
        run_hooks(df, "pre", [post_command(lambda d: d, "Post")])
    boom = pre_command(lambda d: d.select("missing"), "Boom")
    with pytest.raises(WorkflowProcessingError) as e:
        run_hooks(df, "pre", [boom])
    assert "Command 'Boom' failed during the pre-process stage" in str(e.value)


def test_merged_output_of_one_big_job_spans_ordered_part_files(spark, tmpdir_path):
    root = os.path.join(tmpdir_path, "jobs")
    os.makedirs(os.path.join(root, "big"))
    n = 20000
    with open(os.path.join(root, "big", "log.out"), "w") as f:
        f.write("".join(f"line {i:05d}\n" for i in range(n)))
    with open(os.path.join(root, "big", "z.txt"), "w") as f:
        f.write("tail\n")
    out = os.path.join(tmpdir_path, "merged")
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        write_merged(merge_text_outputs(spark, root), out)
    finally:
        spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "true")
    d = os.path.join(out, "job=big")
    parts = sorted(p for p in os.listdir(d) if p.startswith("part-"))
    assert len(parts) > 1  # the one job is spread over several tasks
    lines = []
    for p in parts:
        with open(os.path.join(d, p)) as f:
            lines += f.read().splitlines()
    log = os.path.join(root, "big", "log.out")
    txt = os.path.join(root, "big", "z.txt")
    assert lines == [f"############ {log}"] + [f"line {i:05d}" for i in range(n)] + [""] + \
        [f"############ {txt}", "tail", ""]


def test_read_parameters_permissive_keeps_good_documents(spark, tmpdir_path):
    good = os.path.join(tmpdir_path, "good.json")
    with open(good, "w") as f:
        json.dump({"message": "Hello World"}, f)
    bad = os.path.join(tmpdir_path, "bad.json")
    with open(bad, "w") as f:
        f.write("{not json")
    df = read_parameters(spark, [good, bad], failfast=False)
    got = {(os.path.basename(r.source), r.key, r.value) for r in df.collect()}
    assert ("good.json", "message", "Hello World") in got
    assert ("bad.json", None, None) in got
