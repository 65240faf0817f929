from conftest import rows
from gridweave.operators.jobs import (
    EXECUTABLE_LINE,
    all_succeeded,
    expand_jobs,
    explode_steps,
    fold_hints,
    render_job_text,
    resolve_parameters,
    step_defaults,
    succeeded,
    waits_for_data,
)

SB = "SB:SandboxSE|/S3/sandbox-store/sha256:0001.tar.zst"
HEAD = EXECUTABLE_LINE + "\nArguments = job.json;\n"


def test_render_job_text_goldens(spark):
    refs = [f"lfn:/pi/100/result_{i}.sim" for i in range(1, 6)]
    df = spark.createDataFrame([
        (1, None, None, None, SB, None),
        (2, None, 100, "SITE-A.example.org, SITE-B.example.org", SB, None),
        (3, 1, None, None, SB, refs),
    ], "id int, cores int, priority int, sites string, sandbox_id string, input_refs array<string>")
    got = {r.id: r.t for r in df.select("id", render_job_text(df).alias("t")).collect()}
    assert got[1] == HEAD + "JobName = test;\nOutputSandbox = {std.out, std.err};\nPriority = 10;\n" \
        f"InputSandbox = {SB};"
    assert got[2] == HEAD + "JobName = test;\nOutputSandbox = {std.out, std.err};\nPriority = 100;\n" \
        f"Site = SITE-A.example.org, SITE-B.example.org;\nInputSandbox = {SB};"
    assert got[3] == HEAD + "NumberOfProcessors = 1;\nJobName = test;\nOutputSandbox = {std.out, std.err};\n" \
        f"Priority = 10;\nInputSandbox = {SB};\nInputData = " + ", ".join(r.replace("lfn:", "LFN:") for r in refs) + ";"


def test_render_sites_array_and_zero_priority(spark):
    df = spark.createDataFrame([(0, ["a", "b"], "s", ["file:///x"])],
                               "priority int, sites array<string>, sandbox_id string, input_refs array<string>")
    t = df.select(render_job_text(df)).first()[0]
    assert "Priority" not in t and "Site = a, b;" in t and "InputData" not in t


def test_expand_jobs(spark):
    tasks = spark.createDataFrame([("hello",), ("basic",)], "task_id string")
    params = spark.createDataFrame([("hello", 1, "Hello World"), ("hello", 2, "Hola mundo"),
                                    ("hello", 3, "Bonjour tout le monde")], "task_id string, param_seq int, message string")
    got = rows(expand_jobs(tasks, params), "task_id", "param_seq", "job_id")
    assert got == [("basic", None, "basic:-"), ("hello", 1, "hello:1"), ("hello", 2, "hello:2"), ("hello", 3, "hello:3")]


def test_resolve_parameters_precedence(spark):
    d = spark.createDataFrame([("t", "campaign", "default_campaign", 0), ("t", "num-points", "1000", 1)],
                              "task_id string, key string, value string, pos int")
    o = spark.createDataFrame([("t", "campaign", "override_campaign", 0), ("t", "undeclared", "x", 1),
                               ("t", "num-points", "100000", 2)], "task_id string, key string, value string, pos int")
    c = spark.createDataFrame([("t", "campaign", "Run3", 0), ("t", "num_points", "5", 1)],
                              "task_id string, key string, value string, pos int")
    got = dict(rows(resolve_parameters(d, o, c), "key", "value"))
    # configuration beats override beats default; undeclared overrides are ignored;
    # num-points and num_points collide after snake-casing: the later configuration key wins
    assert got == {"campaign": "Run3", "num_points": "5"}
    got2 = dict(rows(resolve_parameters(d, o, None), "key", "value"))
    assert got2 == {"campaign": "override_campaign", "num_points": "100000"}


def test_fold_hints(spark):
    hints = spark.createDataFrame([
        ("t", 0, "hooks", "configuration", "admin_level", "3"),
        ("t", 0, "hooks", "configuration", "log_level", "INFO"),
        ("t", 1, "hooks", "configuration", "admin_level", "5"),
        ("t", 0, "scheduling", "priority", None, "100"),
        ("t", 1, "scheduling", "sites", None, "A, B"),
        ("u", 0, "hooks", "configuration", "a", "1"),
        ("u", 1, "hooks", "configuration", None, "scalar"),
        ("u", 2, "hooks", "output_paths", "o", "lfn:/x"),
        ("v", 0, "hooks", "group_size", "in", "5"),
        ("v", 1, "hooks", "group_size", None, "7"),
        ("v", 2, "hooks", "group_size", "in2", "3"),
    ], "task_id string, pos int, class string, key string, subkey string, value string")
    got = rows(fold_hints(hints), "task_id", "class", "key", "subkey", "value")
    want = [
        ("t", "hooks", "configuration", "admin_level", "5"),
        ("t", "hooks", "configuration", "log_level", "INFO"),
        ("t", "hooks", "hook_plugin", None, "QueryBasedPlugin"),
        ("t", "hooks", "output_se", None, "SE-USER"),
        ("t", "scheduling", "priority", None, "100"),
        ("t", "scheduling", "sites", None, "A, B"),
        ("u", "hooks", "configuration", None, "scalar"),
        ("u", "hooks", "hook_plugin", None, "QueryBasedPlugin"),
        ("u", "hooks", "output_paths", "o", "lfn:/x"),
        ("u", "hooks", "output_se", None, "SE-USER"),
        ("u", "scheduling", "priority", None, "10"),
        ("v", "hooks", "group_size", "in2", "3"),
        ("v", "hooks", "hook_plugin", None, "QueryBasedPlugin"),
        ("v", "hooks", "output_se", None, "SE-USER"),
        ("v", "scheduling", "priority", None, "10"),
    ]
    assert got == sorted(want, key=lambda r: tuple("" if x is None else x for x in r)) or \
        sorted(got, key=str) == sorted(want, key=str)


def test_explode_steps_and_defaults(spark):
    step = "struct<id:string,in:array<struct<id:string,source:string>>,run:struct<class:string,inputs:array<struct<id:string,default:string>>>>"
    wf = spark.createDataFrame([("w", [
        ("#main/simulate", [("#main/simulate/num-points", "#main/num-points")],
         ("CommandLineTool", [("#pisimulate.cwl#num-points", "1000")])),
        ("#main/gather", [("#main/gather/input-data", "#main/simulate/result")],
         ("CommandLineTool", [("#pigather.cwl#input-data", None), ("#pigather.cwl#extra", "e")])),
    ])], f"wf_id string, steps array<{step}>")
    steps = explode_steps(wf)
    assert rows(steps, "step_pos", "step_id", "kind") == [(0, "#main/simulate", "CommandLineTool"),
                                                          (1, "#main/gather", "CommandLineTool")]
    wfi = spark.createDataFrame([("w", "#main/num-points", "100000")], "wf_id string, id string, default string")
    got = rows(step_defaults(steps, wfi), "step_id", "input", "default", "from_workflow")
    assert got == [("#main/gather", "extra", "e", False), ("#main/gather", "input-data", None, False),
                   ("#main/simulate", "num-points", "100000", True)]
    # a workflow input without default overwrites the tool default with null
    wfi2 = spark.createDataFrame([("w", "#main/num-points", None)], "wf_id string, id string, default string")
    got2 = dict((r[0], r[1]) for r in rows(step_defaults(steps, wfi2), "input", "default"))
    assert got2["num-points"] is None


def test_success_checks(spark):
    res = spark.createDataFrame([("a", 0), ("b", 1), ("c", None)], "job string, return_code int")
    ok, bad = succeeded(res)
    assert rows(ok, "job") == [("a",)] and rows(bad, "job") == [("b",), ("c",)]
    r = spark.createDataFrame([("p", True), ("p", False), ("q", True)], "prod string, ok boolean")
    parents = spark.createDataFrame([("p",), ("q",), ("empty",)], "prod string")
    assert rows(all_succeeded(r, ["prod"], parents=parents)) == [("empty", True), ("p", False), ("q", True)]


def test_waits_for_data(spark):
    t = spark.createDataFrame([(1, {"c": "x"}, {"in": 5}), (2, {"c": "x"}, None), (3, {}, {"in": 5})],
                              "id int, configuration map<string,string>, group_size map<string,int>")
    w, s = waits_for_data(t)
    assert rows(w, "id") == [(1,)] and rows(s, "id") == [(2,), (3,)]
