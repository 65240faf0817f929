import json

import pytest

from gridweave.operators.plugin_fields import validate_plugin_fields

RULES = [
    ("P", "campaign", "str", True), ("P", "events", "int", True), ("P", "events", "int", True),
    ("P", "share", "float", False), ("P", "dry", "bool", False), ("P", "note", "str?", False),
    ("P", "sandbox", "list[str]", False), ("P", "paths", "dict[list[str]]", False),
    ("P", "input", "File", False), ("P", "inputs", "list[File]", False),
    ("QueryBasedPlugin", "site", "str", False), ("Empty", None, None, None),
]
RULE_SCHEMA = "plugin string, field string, type string, required boolean"
OK = {"campaign": "c", "events": 3}


def _errors(spark, cases, **options):
    rules = spark.createDataFrame(RULES, RULE_SCHEMA)
    rows = [(i, plugin, d if d is None or isinstance(d, str) else json.dumps(d)) for i, (plugin, d) in enumerate(cases)]
    df = spark.createDataFrame(rows, "id int, hook_plugin string, descriptor string")
    out = {r.id: (list(r.errors), r.valid) for r in validate_plugin_fields(df, rules, **options).collect()}
    assert all(valid == (not errors) for errors, valid in out.values())
    return [out[i][0] for i in range(len(cases))]


def test_types_missing_and_extra_fields(spark):
    file, no_file = {"class": "File", "path": "/a"}, {"class": "File", "path": ""}
    cases = [
        ("P", OK),
        ("P", {"events": 1.5, "zeta": 1, "alpha": 2}),
        ("P", {"campaign": 7, "events": " 12 "}),
        ("P", {"campaign": "c", "events": 3.0, "share": "0.5", "dry": "Yes", "note": None}),
        ("P", {**OK, "share": "half", "dry": 2, "note": 1}),
        ("P", {**OK, "campaign": None}),
        ("P", {**OK, "sandbox": ["a", 1], "paths": {"x": ["a"], "y": "b"}}),
        ("P", {**OK, "sandbox": [], "paths": {}}),
        ("P", {**OK, "input": file, "inputs": [file, {"class": "File", "location": "lfn:/b"}]}),
        ("P", {**OK, "input": no_file, "inputs": [file, no_file]}),
        ("P", {**OK, "input": "/a", "inputs": file}),
        ("P", "[1, 2]"), ("P", "{bad"), ("P", None),
        ("Nope", OK), (None, {"site": "here"}), ("", {"site": 1}), ("Empty", {}), ("Empty", {"a": 1}),
    ]
    assert _errors(spark, cases) == [
        [],
        ["missing field: campaign", "wrong type for events: not int", "unexpected field: alpha", "unexpected field: zeta"],
        ["wrong type for campaign: not str"],
        [],
        ["wrong type for dry: not bool", "wrong type for note: not str?", "wrong type for share: not float"],
        ["wrong type for campaign: not str"],
        ["wrong type for paths: not dict[list[str]]", "wrong type for sandbox: not list[str]"],
        [],
        [],
        ["wrong type for input: not File", "wrong type for inputs: not list[File]"],
        ["wrong type for input: not File", "wrong type for inputs: not list[File]"],
        ["descriptor is not a JSON object"], ["descriptor is not a JSON object"], ["descriptor is not a JSON object"],
        ["Unknown execution hooks plugin: Nope"], [], ["wrong type for site: not str"], [], ["unexpected field: a"],
    ]
    assert _errors(spark, [("P", {**OK, "more": 1})], forbid_extra=False) == [[]]


def test_variant_column_empty_tables_and_refusals(spark):
    rules = spark.createDataFrame(RULES, RULE_SCHEMA)
    df = spark.createDataFrame([("P", '{"campaign": "c"}')], "hook_plugin string, j string")
    out = validate_plugin_fields(df.selectExpr("hook_plugin", "parse_json(j) AS descriptor", "1 AS field"), rules)
    assert [tuple(r.errors) for r in out.collect()] == [("missing field: events",)]
    assert out.columns == ["hook_plugin", "descriptor", "field", "errors", "valid"]
    text = df.withColumnRenamed("j", "descriptor")
    assert validate_plugin_fields(text.limit(0), rules).count() == 0
    assert [list(r.errors) for r in validate_plugin_fields(text, rules.limit(0)).collect()] == [
        ["Unknown execution hooks plugin: P"]]
    with pytest.raises(ValueError, match="errors"):
        validate_plugin_fields(text.selectExpr("*", "1 AS errors"), rules)
    with pytest.raises(ValueError, match="unknown field type"):
        validate_plugin_fields(text, spark.createDataFrame([("P", "a", "uuid", True)], RULE_SCHEMA))
