"""Every registered query against its DuckDB oracle on the smallest tables (the driver runs the
same comparison at sf0.01)."""

import os
import subprocess
import sys

import duckdb
import pytest

import __spark_entry__ as entry
from conftest import SF_SMALL
from gridweave import plans
from gridweave.plans.tables import TABLES
from tools.oracle_check import compare

QUERIES = plans.queries()
SQL = plans.oracle_sql()


@pytest.fixture(scope="module")
def con():
    c = duckdb.connect()
    for t in TABLES:
        c.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{SF_SMALL}/{t}.parquet')")
    return c


def test_every_query_has_an_oracle():
    missing = sorted(set(QUERIES) - set(SQL))
    assert missing == []


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query_matches_oracle(spark, con, name):
    r = compare(spark, name, QUERIES[name], SQL.get(name), SF_SMALL, con)
    assert r.get("ok", True), r


def test_entry_registers_the_plans():
    assert set(QUERIES) <= set(entry.queries()) and set(SQL) <= set(entry.oracle_sql())


def test_entry_without_the_training_data_subpackage():
    code = ("import sys; sys.modules['corpus_pipeline'] = None; sys.modules['gridweave.llm'] = None; import __spark_entry__ as e; "
            "from gridweave import plans; assert set(e.queries()) == set(plans.queries()); e.oracle_sql()")
    root = os.path.dirname(os.path.abspath(entry.__file__))
    subprocess.run([sys.executable, "-c", code], cwd=root, check=True, timeout=120)


def test_entry_smoke(spark):
    df = entry.entry(spark)
    cols = df.columns
    assert cols == ["task_id", "gid", "n_inputs", "n_files", "jdl"]
    assert df.count() >= 0
