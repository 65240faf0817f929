"""Empty inputs, null keys and other cases the reference never exercises."""

import pytest

from conftest import rows
from gridweave.operators.catalog import add_entries, find_files, match_query
from gridweave.operators.grouping import fixed_groups, zip_groups
from gridweave.operators.outputs import parse_outputs
from gridweave.operators.points import estimate_pi
from gridweave.sources.catalog import catalog_from_lfns


@pytest.mark.parametrize("method", ["auto", "window", "split"])
def test_fixed_groups_empty(spark, method):
    df = spark.createDataFrame([], "k string, o long")
    assert fixed_groups(df, ["k"], "o", 3, method=method).count() == 0


def test_fixed_groups_null_key_is_a_key(spark):
    df = spark.createDataFrame([(None, i) for i in range(6)] + [("a", 1)], "k string, o long")
    g = fixed_groups(df, ["k"], "o", 3)
    assert rows(g, "k", "gid") == [(None, 0), (None, 1)]


def test_fixed_groups_rejects_bad_size(spark):
    df = spark.createDataFrame([("a", 1)], "k string, o long")
    with pytest.raises(ValueError):
        fixed_groups(df, ["k"], "o", 0)


def test_zip_with_no_groups(spark):
    groups = spark.createDataFrame([], "task string, input_name string, gid long, members array<long>, n long")
    inputs = spark.createDataFrame([("t", "a", 0)], "task string, input_name string, input_pos int")
    assert zip_groups(groups, inputs, ["task"]).count() == 0


def test_match_and_find_on_empty_catalog(spark):
    empty = catalog_from_lfns(spark.createDataFrame([], "lfn string"))
    qs = spark.createDataFrame([("t", "/q")], "task string, query string")
    assert match_query(empty, qs).count() == 0
    w = spark.createDataFrame([("/q/a",)], "lfn string")
    assert rows(find_files(empty, w), "status") == [("Failed",)]


def test_add_entries_into_empty_catalog(spark):
    c = spark.createDataFrame([], "lfn string")
    new = spark.createDataFrame([("/a", 2), ("/a", 1)], "lfn string, seq int")
    assert rows(add_entries(c, new), "seq", "status") == [(1, "added"), (2, "rejected")]


def test_parse_outputs_empty_object_and_null_stdout(spark):
    df = spark.createDataFrame([(1, "{}"), (2, None)], "job int, stdout string")
    got = rows(parse_outputs(df, ["job"]), "job", "error")
    assert got == [(2, "invalid output JSON")]


def test_estimate_pi_boundary_counts_inside(spark):
    pts = spark.createDataFrame([(1.0, 0.0), (0.0, -1.0), (1.0, 1.0), (-1.0, 1.0)], "x double, y double")
    r = estimate_pi(pts).first()
    assert (r.n_inside, r.n_points) == (2, 4) and r.pi_estimate == 2.0
