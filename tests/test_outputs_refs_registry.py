from pyspark.sql import functions as F

from conftest import rows
from gridweave.operators.outputs import first_successful_target, parse_outputs, route_outputs, storage_report
from gridweave.operators.refs import (
    catalog_refs_by_input,
    local_refs,
    reference_errors,
    rewrite_inputs,
    sandbox_manifest,
)
from gridweave.operators.registry import list_organizations, list_plugins, lookup_with_fallback, register, registry_summary, registry_tables
from gridweave.operators.validate import check, unexpected_keys, wrong_type
from gridweave.sources.catalog import catalog_from_lfns


def test_parse_outputs(spark):
    df = spark.createDataFrame([
        (1, '{"a": {"path": "/x/1.txt"}, "b": null, "c": [], "d": ""}'),
        (2, '{"a": [{"path": "/x/2.txt"}, null, {"path": "/x/3.txt"}]}'),
        (3, '{"a": [null]}'),
        (4, 'not json'),
        (5, '{"a": 5}'),
    ], "job int, stdout string")
    got = rows(parse_outputs(df, ["job"]), "job", "output_name", "pos", "path", "error")
    assert got == sorted([(1, "a", 0, "/x/1.txt", None), (2, "a", 0, "/x/2.txt", None), (2, "a", 1, "/x/3.txt", None),
                          (3, "a", None, None, None), (4, None, None, None, "invalid output JSON"),
                          (5, "a", None, None, "output is not a file or a list of files")], key=str) or \
        sorted(got, key=str) == sorted([(1, "a", 0, "/x/1.txt", None), (2, "a", 0, "/x/2.txt", None),
                                        (2, "a", 1, "/x/3.txt", None), (3, "a", None, None, None),
                                        (4, None, None, None, "invalid output JSON"),
                                        (5, "a", None, None, "output is not a file or a list of files")], key=str)


def test_route_outputs(spark):
    outs = spark.createDataFrame([(1, "output1", 0, "/job/file1", None), (1, "other", 0, "/job/o", None),
                                  (1, "empty", None, None, None)],
                                 "job int, output_name string, pos int, path string, error string")
    paths = spark.createDataFrame([(1, "output1", "lfn:/test/output"), (1, "empty", "lfn:/e")],
                                  "job int, output_name string, lfn string")
    sb = spark.createDataFrame([(1, "output1")], "job int, output_name string")
    got = {r.output_name: r for r in route_outputs(outs, paths, sb, ["job"]).collect()}
    assert got["output1"].to_catalog and got["output1"].to_sandbox and got["output1"].target == "lfn:/test/output/file1"
    assert not got["other"].to_catalog and not got["other"].to_sandbox and got["other"].target is None
    assert got["empty"].error == "src_path parameter required for filesystem storage of empty"


def test_first_successful_target(spark):
    att = spark.createDataFrame([("f", 0, "SE-1", False, "down"), ("f", 1, "SE-2", True, None),
                                 ("f", 2, "SE-3", True, None), ("g", 0, "SE-1", False, "full"),
                                 ("g", 1, "SE-2", False, "gone")], "file string, pos int, se string, ok boolean, message string")
    got = rows(first_successful_target(att, ["file"]), "file", "stored_se", "status", "error")
    assert got == [("f", "SE-2", "stored", None), ("g", None, "failed", "gone")]
    files = spark.createDataFrame([("f",), ("h",)], "file string")
    rep = rows(storage_report(files, att, ["file"]), "file", "status", "attempts")
    assert rep == [("f", "stored", 3), ("h", "not stored", 0)]


REFS = "job string, input_name string, pos int, location string, path string, is_list boolean"


def test_refs(spark):
    refs = spark.createDataFrame([
        ("j", "input-data", 0, "lfn:/pi/100/result_1.sim", None, True),
        ("j", "input-data", 1, None, "file:///tmp/a.sim", True),
        ("j", "other", 0, None, "file://b/file://c", True),
        ("k", "input-data", 0, None, None, False),
    ], REFS).withColumnRenamed("job", "job_id")
    by = rows(catalog_refs_by_input(refs).select("job_id", "input_name", F.array_join("lfns", ",")))
    assert by == [("j", "input-data", "lfn:/pi/100/result_1.sim"), ("j", "other", ""), ("k", "input-data", "")]
    assert rows(local_refs(refs), "local_path") == [("/tmp/a.sim",), ("b/c",)]
    assert rows(reference_errors(refs), "job_id", "error") == [("k", "File location is not defined.")]
    cat = catalog_from_lfns(spark.createDataFrame([("/pi/100/result_1.sim",)], "lfn string"))
    r, jobs = rewrite_inputs(refs, cat)
    assert rows(jobs, "job_id", "n_catalog", "n_staged", "failed") == [("j", 1, 1, False), ("k", 0, 0, False)]
    staged = r.filter(F.col("location").isNotNull()).first().staged_path
    assert staged == "result_1.sim"
    r2, jobs2 = rewrite_inputs(refs, cat.filter(F.lit(False)))
    assert rows(jobs2.filter("job_id = 'j'"), "failed") == [(True,)]


def test_sandbox_manifest(spark):
    files = spark.createDataFrame([("j", 0, "/a/x.txt"), ("j", 1, "/b/y.txt"), ("j", 2, ""), ("j", 3, "/c/z.txt"),
                                   ("k", 0, ""), ("m", 5, "/m.txt")], "job_id string, pos int, name string")
    man, summ = sandbox_manifest(files)
    assert rows(man, "job_id", "member") == [("j", "x.txt"), ("j", "y.txt"), ("m", "m.txt")]
    s = {r.job_id: r for r in summ.collect()}
    assert {k: r.n_files for k, r in s.items()} == {"j": 2, "k": 0, "m": 1}  # a list cut at once packs an empty sandbox
    other = files.withColumn("pos", F.when(F.col("pos") < 2, 1 - F.col("pos")).otherwise(F.col("pos")))
    assert {r.job_id: r.sandbox_id for r in sandbox_manifest(other)[1].collect()} == {k: r.sandbox_id for k, r in s.items()}
    twice = files.unionByName(files.filter("job_id = 'm'").withColumn("pos", F.lit(6)))
    assert {r.job_id: r for r in sandbox_manifest(twice)[1].collect()}["m"].sandbox_id not in (s["m"].sandbox_id, s["k"].sandbox_id)


def _entries(spark):
    return spark.createDataFrame([
        ("TestPlugin", None, "global one", 1), ("TestVOPlugin", "test_exp", "vo one", 2),
        ("TestSecondVOPlugin", "exp2", "second", 3), ("TestPlugin", "exp2", "exp2 copy", 4),
    ], "key string, vo string, description string, seq int")


def test_register_duplicate_and_override(spark):
    out = rows(register(_entries(spark)), "key", "seq", "status")
    assert ("TestPlugin", 4, "rejected") in out and ("TestPlugin", 1, "added") in out
    out2 = rows(register(_entries(spark), override=True), "key", "seq", "status")
    assert ("TestPlugin", 4, "added") in out2 and ("TestPlugin", 1, "rejected") in out2


def test_lookup_vo_first_then_global(spark):
    g, v = registry_tables(_entries(spark), override=True)
    wanted = spark.createDataFrame([("TestPlugin", "exp2"), ("TestPlugin", "test_exp"), ("TestVOPlugin", None),
                                    ("Missing", "exp2")], "key string, vo string")
    got = rows(lookup_with_fallback(wanted, g, v), "key", "vo", "found", "scope")
    assert got == sorted([("Missing", "exp2", None, None), ("TestPlugin", "exp2", "exp2 copy", "vo"),
                          ("TestPlugin", "test_exp", "exp2 copy", "global"), ("TestVOPlugin", None, "vo one", "global")],
                         key=lambda r: tuple("" if x is None else x for x in r))
    assert rows(list_plugins(g, v, "test_exp")) == [("TestVOPlugin",)]
    assert len(rows(list_plugins(g, v, "unknown"))) == 3
    summ = {r.vo: r.n_plugins for r in registry_summary(g, v).collect()}
    assert summ == {"test_exp": 1, "exp2": 2, None: 3}
    assert rows(list_organizations(v)) == [("exp2",), ("test_exp",)]


def test_rejected_registration_is_found_nowhere(spark):
    e = spark.createDataFrame([("k", "A", "first", 1), ("k", "B", "second", 2)], "key string, vo string, description string, seq int")
    g, v = registry_tables(e, override=False)
    wanted = spark.createDataFrame([("k", "A"), ("k", "B")], "key string, vo string")
    assert rows(lookup_with_fallback(wanted, g, v), "vo", "found", "scope") == [("A", "first", "vo"), ("B", "first", "global")]
    # with override a VO keeps its entry when another VO takes the name
    g, v = registry_tables(e, override=True)
    assert rows(lookup_with_fallback(wanted, g, v), "vo", "found", "scope") == [("A", "first", "vo"), ("B", "second", "vo")]
    assert {r.vo: r.n_plugins for r in registry_summary(g, v).collect()} == {"A": 1, "B": 1, None: 1}


def test_vo_entry_with_null_payload_is_a_hit(spark):
    e = spark.createDataFrame([("k", "A", None, 2), ("k", None, "global", 1)], "key string, vo string, description string, seq int")
    g, v = registry_tables(e, override=True)
    wanted = spark.createDataFrame([("k", "A")], "key string, vo string")
    assert rows(lookup_with_fallback(wanted, g, v), "found", "scope") == [(None, "vo")]


def test_validate_rules(spark):
    df = spark.createDataFrame([("5", {"priority": "1"}), ("x", {"bogus": "1", "priority": "2"})],
                               "group_size string, hint map<string,string>")
    extra = unexpected_keys("hint", ["platform", "priority", "sites"])
    out = check(df, [(wrong_type("group_size", "int"), "group_size is not an int"),
                     (F.size(extra) > 0, F.concat(F.lit("unknown keys: "), F.array_join(extra, ",")))])
    got = rows(out.select("group_size", F.array_join("errors", "|"), "valid"))
    assert got == [("5", "", True), ("x", "group_size is not an int|unknown keys: bogus", False)]


def test_staged_inputs_rebuilt_per_job(spark):
    from gridweave.operators.refs import staged_inputs
    refs = spark.createDataFrame([
        ("j", "data", 1, "lfn:/pi/2.sim", None, True), ("j", "data", 0, "lfn:/pi/1.sim", None, True),
        ("j", "cfg", 0, None, "/tmp/c.txt", False),
    ], REFS).withColumnRenamed("job", "job_id")
    cat = catalog_from_lfns(spark.createDataFrame([("/pi/1.sim",), ("/pi/2.sim",)], "lfn string"))
    r, _ = rewrite_inputs(refs, cat)
    m = {x.input_name: (x.is_list, [tuple(f) for f in x.files]) for x in staged_inputs(r).collect()}
    assert m == {"data": (True, [(None, "1.sim"), (None, "2.sim")]), "cfg": (False, [(None, "/tmp/c.txt")])}
    other = spark.createDataFrame([("j", "u", 0, "file:///x/y.txt", None, True)], REFS).withColumnRenamed("job", "job_id")
    assert [tuple(f) for f in staged_inputs(rewrite_inputs(other, cat)[0]).first().files] == [("file:///x/y.txt", None)]


def test_validate_descriptors(spark):
    from gridweave.operators.validate import validate_descriptors
    tasks = spark.createDataFrame([
        ("a", "Workflow", None, {"priority": "10"}, {"input-data": "5"}),
        ("b", "Tool", "Nope", {"bogus": "1"}, {"input-data": "five"}),
        ("c", "CommandLineTool", "QueryBasedPlugin", None, None),
    ], "id string, task_class string, hook_plugin string, scheduling map<string,string>, group_size map<string,string>")
    known = spark.createDataFrame([("QueryBasedPlugin",)], "key string")
    got = {r.id: list(r.errors) for r in validate_descriptors(tasks, known).collect()}
    assert got["a"] == [] and got["c"] == []
    assert got["b"] == ["task is not a CommandLineTool, Workflow or ExpressionTool: Tool",
                        "Unknown execution hooks plugin: Nope", "unknown scheduling keys: bogus",
                        "group_size is not an integer for: input-data"]
    prod = {r.id: list(r.errors) for r in validate_descriptors(tasks, known, kind="production").collect()}
    assert prod["c"] == ["a production must be a Workflow"] and prod["a"] == []
