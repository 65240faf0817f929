"""Rows with null keys, odd documents, empty files and missing state: kept or refused, never lost."""

import os

import pytest
from pyspark.sql import functions as F

from conftest import SF_SMALL, rows
from gridweave.operators._joins import null_safe_join
from gridweave.operators.catalog import add_entries, apply_additions, match_patterns, upsert_metadata
from gridweave.operators.grouping import fixed_groups, zip_groups
from gridweave.operators.outputs import parse_outputs, store_and_register
from gridweave.operators.refs import reference_errors, sandbox_manifest
from gridweave.plans import queries
from gridweave.sources.catalog import catalog_from_lfns, read_catalog
from gridweave.sources.sinks import StoreError, merge_text_outputs, write_merged, write_with_fallback
from gridweave.streaming.grouping import catalog_stream, fixed_groups_batch_step, stream_fixed_groups_batched
from gridweave.streaming.state import COMPACT_EVERY

KEYED = "k string, o int"


@pytest.mark.parametrize("method", ["window", "split", "auto"])
def test_null_key_groups_in_every_method(spark, method):
    df = spark.createDataFrame([(None, i) for i in range(6)] + [("a", i) for i in range(4)], KEYED)
    g = fixed_groups(df, ["k"], "o", 3, method=method, hot_rows=2)
    assert sorted(((r.k, r.gid, tuple(r.members)) for r in g.collect()), key=str) == sorted(
        [(None, 0, (0, 1, 2)), (None, 1, (3, 4, 5)), ("a", 0, (0, 1, 2))], key=str)


def test_group_size_per_key(spark):
    df = spark.createDataFrame([("a", i, 2) for i in range(5)] + [("b", i, 3) for i in range(5)] + [("c", 1, None)],
                               "k string, o int, size int")
    assert rows(fixed_groups(df, ["k"], "o", "size"), "k", "gid", "n") == [("a", 0, 2), ("a", 1, 2), ("b", 0, 3)]
    with pytest.raises(Exception, match="positive"):
        fixed_groups(df.withColumn("size", F.lit(0)), ["k"], "o", "size").collect()


def test_limited_groups_rank_only_what_they_need(spark):
    df = spark.range(1000).select((F.col("id") % 3).alias("k"), "id")
    g = fixed_groups(df, ["k"], "id", 5, max_groups=2)
    assert g.count() == 6
    assert "WindowGroupLimit" in g._jdf.queryExecution().executedPlan().toString()


def test_zip_of_a_task_without_a_name(spark):
    g = fixed_groups(spark.createDataFrame([(None, "x", i) for i in range(4)], "task string, input_name string, o int"),
                     ["task", "input_name"], "o", 2)
    inputs = spark.createDataFrame([(None, "x", 0)], "task string, input_name string, input_pos int")
    assert zip_groups(g, inputs, ["task"]).count() == 2


def test_null_safe_full_join(spark):
    a = spark.createDataFrame([(None, 1), ("x", 2)], "k string, a int")
    b = spark.createDataFrame([(None, 3), ("y", 4)], "k string, b int")
    assert sorted((tuple(r) for r in null_safe_join(a, b, ["k"], "full").collect()), key=str) == sorted(
        [(None, 1, 3), ("x", 2, None), ("y", None, 4)], key=str)


def test_entries_without_a_key_are_refused(spark):
    cat = spark.createDataFrame([("a",)], "lfn string")
    new = spark.createDataFrame([(None, 1), ("a", 2), ("b", 3)], "lfn string, seq int")
    out = add_entries(cat, new)
    assert sorted(((r.lfn, r.status, r.message) for r in out.collect()), key=str) == sorted(
        [(None, "rejected", "File without a name"), ("a", "rejected", "File a already exists"), ("b", "added", None)], key=str)
    assert rows(apply_additions(cat, out)) == [("a",), ("b",)]


def test_hash_aggregates_in_insert(spark):
    cat = spark.createDataFrame([("a", "1")], "lfn string, v string")
    new = spark.createDataFrame([("a", "2", 1), ("b", "3", 2)], "lfn string, v string, seq long")
    assert "SortAggregate" not in add_entries(cat, new)._jdf.queryExecution().executedPlan().toString()
    nameless = new.unionByName(spark.createDataFrame([(None, "4", 3)], new.schema))
    assert rows(upsert_metadata(cat, nameless)) == [("a", "2"), ("b", "3")]


def test_every_reported_file_has_a_row(spark):
    docs = ['{"r": [{"path": "a"}, {"location": "x"}], "zero": "0", "no": "false", "n": 0, "f": false}', '{"l": ["s", null]}', "{bad"]
    out = parse_outputs(spark.createDataFrame(list(enumerate(docs)), "job int, stdout string"), ["job"])
    assert sorted(((r.job, r.output_name, r.path, r.error) for r in out.collect()), key=str) == sorted([
        (0, "r", "a", None), (0, "r", None, "output file without a path"),
        (0, "zero", None, "output is not a file or a list of files"), (0, "no", None, "output is not a file or a list of files"),
        (1, "l", None, "output is not a file or a list of files"), (2, None, None, "invalid output JSON")], key=str)


def test_empty_strings_are_no_reference(spark):
    refs = spark.createDataFrame([("j", "a", "", "", True), ("j", "b", "", "/p", True), ("j", "c", None, "/p", False)],
                                 "job_id string, input_name string, location string, path string, is_list boolean")
    assert rows(reference_errors(refs), "input_name") == [("a",), ("c",)]


def test_sandbox_of_a_job_without_a_name(spark):
    files = spark.createDataFrame([(None, 0, "/a"), (None, 1, "")], "job_id string, pos int, name string")
    manifest, summary = sandbox_manifest(files)
    assert rows(manifest, "member") == [("a",)] and summary.first().n_files == 1


def test_wildcards_skip_hidden_directories_and_slashes(spark):
    cat = catalog_from_lfns(spark.createDataFrame([("/e/a/x",), ("/e/.hid/x",), ("/e/a/b/x",), ("/e/c/.y",)], "lfn string"))
    assert rows(match_patterns(cat, ["/e/*", "e/[!b]", "/e/a[!x]b"]), "query_pos", "lfn") == [(0, "/e/a/x"), (1, "/e/a/x")]
    both = match_patterns(cat, ["/e/a", "/e/a", "/e/?"])
    assert rows(both, "query_pos") == [(0,), (1,), (2,)]
    assert both._jdf.queryExecution().executedPlan().toString().count("Scan ") == 1


def test_merged_text_keeps_empty_files_and_last_lines(spark, tmpdir_path):
    root = os.path.join(tmpdir_path, "jobs")
    os.makedirs(os.path.join(root, "j", "deeper"))
    for name, text in (("a.out", ""), ("b c+d%20.txt", "x\n\ny"), ("c.txt", "\n"), (".h.out", "no\n"), ("group.out", "no\n"),
                       ("deeper/d.out", "no\n")):
        with open(os.path.join(root, "j", name), "w", newline="") as f:
            f.write(text)
    write_merged(merge_text_outputs(spark, root), f"{tmpdir_path}/m")
    folder = f"{tmpdir_path}/m/job=j"
    text = "".join(open(os.path.join(folder, p)).read() for p in sorted(os.listdir(folder)) if p.startswith("part-"))
    want = ""
    for name, body in (("a.out", ""), ("b c+d%20.txt", "x\n\ny"), ("c.txt", "\n")):
        want += f"############ {root}/j/{name}\n{body}\n"
    assert text == want


def test_fallback_tells_query_errors_from_storage_errors(spark, tmpdir_path):
    bad = spark.range(3).select(F.raise_error(F.lit("query is wrong")).alias("x"))
    with pytest.raises(Exception, match="query is wrong") as e:
        write_with_fallback(bad, [f"{tmpdir_path}/a", f"{tmpdir_path}/b"])
    assert not isinstance(e.value, StoreError) and os.listdir(tmpdir_path) == []


def test_unreadable_catalog_is_empty(spark, tmpdir_path):
    os.makedirs(f"{tmpdir_path}/p")
    for name in ("p/x.parquet", "j.json", "d.json"):
        with open(f"{tmpdir_path}/{name}", "w") as f:
            f.write("{no catalog")
    for path, fmt in (("p", "parquet"), ("j.json", "json"), ("d.json", "document")):
        assert read_catalog(spark, f"{tmpdir_path}/{path}", fmt).count() == 0


def test_store_reports_both_outcomes(spark):
    files = spark.createDataFrame([(1, "lfn:/a", 1), (2, "lfn:/a", 2), (3, "lfn:/b", 3)], "id int, lfn string, seq int")
    attempts = spark.createDataFrame([(1, 0, "S", False, "full"), (2, 0, "S", True, None)],
                                     "id int, pos int, se string, ok boolean, message string")
    report, after = store_and_register(files, attempts, catalog_from_lfns(spark.createDataFrame([("/b",)], "lfn string")), ["id"])
    assert rows(report, "id", "storage", "entry") == [(1, "failed", "added"), (2, "stored", "rejected"), (3, "not stored", "rejected")]
    assert rows(after, "lfn") == [("/a",), ("/b",)]


def _step(spark, base, i, data):
    fixed_groups_batch_step(spark.createDataFrame(data, KEYED), i, ["k"], "o", 3, "o", f"{base}/out", f"{base}/state")


def test_streams_carry_null_keys_and_refuse_missing_state(spark, tmpdir_path):
    _step(spark, tmpdir_path, 0, [(None, i) for i in range(4)])
    _step(spark, tmpdir_path, 1, [(None, i) for i in range(4, 6)] + [("a", i) for i in range(3)])
    got = spark.read.parquet(f"{tmpdir_path}/out").select("k", "gid", F.array_join("members", ",")).collect()
    assert sorted(map(tuple, got), key=str) == sorted([(None, 0, "0,1,2"), (None, 1, "3,4,5"), ("a", 0, "0,1,2")], key=str)
    with pytest.raises(RuntimeError, match="state is missing"):
        _step(spark, tmpdir_path, 3, [("a", 9)])


def test_state_is_compacted_and_old_batches_removed(spark, tmpdir_path):
    _step(spark, tmpdir_path, 0, [("idle", 0), ("b", 0)])
    for i in range(1, COMPACT_EVERY + 2):
        _step(spark, tmpdir_path, i, [("b", i)])
    kept = sorted(int(d.rpartition("=")[2]) for d in os.listdir(f"{tmpdir_path}/state/counters"))
    assert kept == [COMPACT_EVERY, COMPACT_EVERY + 1]
    touched = spark.read.parquet(f"{tmpdir_path}/state/counters/batch_id={COMPACT_EVERY + 1}")
    assert rows(touched, "k") == [("b",)]  # a key that got nothing is not written again
    _step(spark, tmpdir_path, COMPACT_EVERY + 2, [("idle", 1), ("idle", 2)])
    out = spark.read.parquet(f"{tmpdir_path}/out").filter("k = 'idle'")
    assert rows(out.select("gid", F.array_join("members", ","))) == [(0, "0,1,2")]


def test_streams_read_folder_tables_in_several_batches(spark, tmpdir_path):
    sf = f"{tmpdir_path}/sf"
    ev = spark.read.parquet(f"{SF_SMALL}/events.parquet")
    top = ev.agg(F.max("event_id")).first()[0] + 1
    for i in range(6):  # one file after the other: the file source takes them by modification time
        part = ev.filter((F.col("event_id") >= top * i // 6) & (F.col("event_id") < top * (i + 1) // 6))
        part.coalesce(1).write.mode("append").parquet(f"{sf}/events.parquet")
    for name in ("stream_fixed_groups_batched_events", "stream_zip_groups_batched_events", "stream_zip_groups_events"):
        q = queries()[name]
        one, many = q(spark, SF_SMALL), q(spark, sf)
        assert rows(one) == rows(many) and one.count() > 0
    stream = catalog_stream(spark, f"{sf}/events.parquet", schema=ev.schema, max_files_per_trigger=2)
    base = f"{tmpdir_path}/b"
    stream_fixed_groups_batched(stream.select("event_type", "event_id"), ["event_type"], "event_id", 7, f"{base}/o", f"{base}/s",
                                f"{base}/c").awaitTermination()
    assert len([d for d in os.listdir(f"{base}/o") if d.startswith("batch_id=")]) == 3


def test_one_sandbox_per_order(spark):
    jdl = queries()["render_job_text_orders"](spark, "/root/testdata/sf0.1")
    box = F.regexp_extract("jdl", r"sha256:(\d+)\.tar", 1)
    n = jdl.agg(F.countDistinct(box), F.count("*")).first()
    assert n[0] == n[1] == 150_000
