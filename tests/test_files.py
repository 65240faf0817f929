"""One exact file per job: bytes as a plain loop writes them; failures leave nothing."""

import glob
import os

import pytest
from pyspark.sql import functions as F

from gridweave.sources.files import write_files, write_group_files
from gridweave.sources.sinks import merge_text_outputs


def tree(root):
    return {os.path.relpath(p, root): open(p, "rb").read() for p in glob.glob(f"{root}/**", recursive=True) if os.path.isfile(p)}


def test_group_files_equal_a_plain_loop(spark, tmpdir_path):
    root = f"{tmpdir_path}/jobs"
    files = {"1": {"b.out": "x\ny\n", "a.out": "no end", "z.txt": "", "a.txt": "é\n\n", "skip.log": "no"},
             "01": {"a.txt": "one\n"}, "a b+c%": {"l.out": "".join(f"line {i}\n" for i in range(5000))},
             "none": {"x.log": "not text"}}
    for job, own in files.items():
        os.makedirs(f"{root}/{job}")
        for name, text in own.items():
            with open(f"{root}/{job}/{name}", "w", encoding="utf-8", newline="") as f:
                f.write(text)
    want = {}
    for job, own in files.items():
        parts = [f"############ {root}/{job}/{n}\n{own[n]}\n" for end in (".out", ".txt") for n in sorted(own) if n.endswith(end)]
        if parts:
            want[f"{job}/group.out"] = "".join(parts).encode()
    write_group_files(merge_text_outputs(spark, root), f"{tmpdir_path}/merged")
    assert tree(f"{tmpdir_path}/merged") == want
    assert sorted(os.listdir(tmpdir_path)) == ["jobs", "merged"]


def test_job_texts_and_order(spark, tmpdir_path):
    rows = spark.createDataFrame([("a/1.jdl", 2, "two"), ("a/1.jdl", 1, "öne\n"), ("b.jdl", 1, None), ("c.jdl", 1, "")],
                                 "file string, at int, value string")
    write_files(rows, f"{tmpdir_path}/t", ("at",))
    assert tree(f"{tmpdir_path}/t") == {"a/1.jdl": "öne\ntwo".encode(), "b.jdl": b"", "c.jdl": b""}
    with pytest.raises(Exception, match="exists already"):
        write_files(rows, f"{tmpdir_path}/t")
    write_files(rows.where("file = 'b.jdl'"), f"{tmpdir_path}/t", overwrite=True)
    assert tree(f"{tmpdir_path}/t") == {"b.jdl": b""}
    write_files(rows.limit(0), f"{tmpdir_path}/none")
    assert os.listdir(f"{tmpdir_path}/none") == []


def test_a_failed_write_leaves_nothing(spark, tmpdir_path):
    rows = spark.range(50).select(F.concat("id", F.lit(".txt")).alias("file"), F.lit("text").alias("value"))
    broken = rows.withColumn("value", F.when(F.col("file") == "7.txt", F.raise_error(F.lit("broken"))).otherwise(F.col("value")))
    with pytest.raises(Exception, match="broken"):
        write_files(broken, f"{tmpdir_path}/t")
    assert os.listdir(tmpdir_path) == []
    for name in ("", "/etc/x", "../x", "a//b", None):
        with pytest.raises(Exception, match="not a file name"):
            write_files(spark.createDataFrame([(name, "v")], "file string, value string"), f"{tmpdir_path}/t")
    assert os.listdir(tmpdir_path) == []
