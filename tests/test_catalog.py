import json
import os

import pytest
from pyspark.sql import functions as F

from conftest import rows
from gridweave.operators.catalog import (
    add_entries,
    apply_additions,
    find_files,
    glob_to_regex,
    match_patterns,
    match_query,
    upsert_metadata,
)
from gridweave.sources.catalog import catalog_from_lfns, list_files, read_catalog


def catalog(spark, lfns):
    return catalog_from_lfns(spark.createDataFrame([(x,) for x in lfns], "lfn string"))


def test_catalog_columns(spark):
    c = catalog(spark, ["lfn:/pi/100/input-data/a.sim", "pi/100/input-data/b.sim", "/top"])
    got = rows(c, "lfn", "dir", "name")
    assert got == [("/pi/100/input-data/a.sim", "/pi/100/input-data", "a.sim"),
                   ("/pi/100/input-data/b.sim", "/pi/100/input-data", "b.sim"),
                   ("/top", "/", "top")]


def test_read_catalog_missing_is_empty(spark, tmpdir_path):
    df = read_catalog(spark, os.path.join(tmpdir_path, "nope"))
    assert df.count() == 0
    assert "lfn" in df.columns


def test_read_catalog_document_form(spark, tmpdir_path):
    p = os.path.join(tmpdir_path, "metadata.json")
    with open(p, "w") as f:
        json.dump({"lfn:/a/b/x.sim": {"CreationDate": 1700000000.5}, "/a/c/y.sim": {"CreationDate": 1.0}}, f)
    df = read_catalog(spark, p, fmt="document")
    got = rows(df, "lfn", "dir", "creation_epoch")
    assert got == [("/a/b/x.sim", "/a/b", 1700000000.5), ("/a/c/y.sim", "/a/c", 1.0)]
    ts = df.filter(F.col("name") == "y.sim").select(F.unix_micros("creation_date")).first()[0]
    assert ts == 1_000_000


def test_list_files_only_files(spark, tmpdir_path):
    root = os.path.join(tmpdir_path, "filecatalog")
    os.makedirs(os.path.join(root, "pi", "100", "input-data", "sub"))
    for i in range(3):
        with open(os.path.join(root, "pi", "100", "input-data", f"result_{i}.sim"), "w") as f:
            f.write("0.1 0.2\n")
    with open(os.path.join(root, "pi", "100", "input-data", "sub", "deep.sim"), "w") as f:
        f.write("x")
    df = list_files(spark, root)
    got = rows(df, "lfn", "dir")
    assert ("/pi/100/input-data/result_0.sim", "/pi/100/input-data") in got
    assert ("/pi/100/input-data/sub/deep.sim", "/pi/100/input-data/sub") in got
    assert len(got) == 4


def test_match_query_direct_children_hidden_and_duplicates(spark):
    c = catalog(spark, ["/q/a", "/q/b", "/q/.hidden", "/q/sub/c", "/other/d"])
    qs = spark.createDataFrame([("t1", "q"), ("t2", "/q/"), ("t3", "./nothing")], "task string, query string")
    got = rows(match_query(c, qs), "task", "lfn")
    assert got == [("t1", "/q/a"), ("t1", "/q/b"), ("t2", "/q/a"), ("t2", "/q/b")]
    # shuffle-join path gives the same result
    got2 = rows(match_query(c, qs, broadcast_queries=False), "task", "lfn")
    assert got2 == got


def test_match_patterns_list_and_glob(spark):
    c = catalog(spark, ["/q/a", "/q/b", "/r/c", "/s1/d", "/s2/e", "/s2/.f"])
    got = rows(match_patterns(c, ["/q", "q", "/s*"]), "query_pos", "lfn")
    assert got == [(0, "/q/a"), (0, "/q/b"), (1, "/q/a"), (1, "/q/b"), (2, "/s1/d"), (2, "/s2/e")]
    assert glob_to_regex("/a/[!x]?/*") == r"^/a/(?!\.)(?!/)[^x][^/]/(?!\.)[^/]*$"


def test_find_files(spark):
    c = catalog(spark, ["/pi/1.sim"])
    w = spark.createDataFrame([("lfn:/pi/1.sim",), ("LFN:/pi/2.sim",), ("pi/1.sim",)], "lfn string")
    got = rows(find_files(c, w), "lfn", "status", "message")
    assert got == [("LFN:/pi/2.sim", "Failed", "File LFN:/pi/2.sim not found"),
                   ("lfn:/pi/1.sim", "Successful", None), ("pi/1.sim", "Successful", None)]


def test_add_entries_insert_if_absent(spark):
    c = catalog(spark, ["/a"]).select("lfn")
    new = spark.createDataFrame([("/a", 1), ("/b", 2), ("/b", 3), ("/c", 4)], "lfn string, seq int")
    got = rows(add_entries(c, new), "lfn", "seq", "status", "message")
    assert got == [("/a", 1, "rejected", "File /a already exists"), ("/b", 2, "added", None),
                   ("/b", 3, "rejected", "File /b already exists"), ("/c", 4, "added", None)]
    over = rows(add_entries(c, new, override=True), "lfn", "seq", "status")
    assert over == [("/a", 1, "added"), ("/b", 2, "rejected"), ("/b", 3, "added"), ("/c", 4, "added")]
    out = add_entries(c, new.select("lfn", "seq"))
    after = apply_additions(c, out)
    assert rows(after) == [("/a",), ("/b",), ("/c",)]


def test_upsert_replaces_whole_entry(spark):
    c = spark.createDataFrame([("/a", "x", "1"), ("/b", "y", "2")], "lfn string, k string, v string")
    upd = spark.createDataFrame([("/a", None, "9", 2), ("/a", "z", "8", 1), ("/c", "w", "3", 5)],
                                "lfn string, k string, v string, seq int")
    got = rows(upsert_metadata(c, upd))
    assert got == [("/a", None, "9"), ("/b", "y", "2"), ("/c", "w", "3")]


@pytest.mark.parametrize("n,groups", [(5, 1), (4, 0), (12, 2)])
def test_group_goldens(spark, n, groups):
    from gridweave.operators.grouping import fixed_groups
    df = spark.createDataFrame([("k", f"/f/{i:02d}") for i in range(n)], "k string, lfn string")
    g = fixed_groups(df, ["k"], "lfn", 5)
    assert g.count() == groups
    if groups:
        first = g.filter("gid = 0").first()
        assert list(first.members) == [f"/f/{i:02d}" for i in range(5)]


def test_catalog_snapshots(spark, tmpdir_path):
    from gridweave.sources.catalog import read_latest_catalog, write_catalog_snapshot

    root = os.path.join(tmpdir_path, "cat")
    assert read_latest_catalog(spark, root).count() == 0
    c1 = catalog(spark, ["/a/x", "/a/y"])
    write_catalog_snapshot(c1, root, snapshot="0001")
    c2 = upsert_metadata(c1, catalog(spark, ["/a/z"]).withColumn("seq", F.lit(1)))
    p2 = write_catalog_snapshot(c2, root, partition_by=["dir"], snapshot="0002")
    latest = read_latest_catalog(spark, root)
    assert rows(latest, "lfn") == [("/a/x",), ("/a/y",), ("/a/z",)]
    assert p2.endswith("snapshot=0002")
    # an unfinished snapshot (no _SUCCESS) is ignored
    os.makedirs(os.path.join(root, "snapshot=0003"))
    assert read_latest_catalog(spark, root).count() == 3


def test_largest_match_counts_visible_entries_of_queried_dirs(spark):
    from gridweave.operators.catalog import has_hot_match, largest_match
    c = catalog(spark, ["/q/a", "/q/b", "/q/.h", "/r/a", "/big/1", "/big/2", "/big/3"])
    qs = spark.createDataFrame([("q",), ("/q/",), ("/r",)], "query string")
    assert largest_match(c, qs) == 2
    assert has_hot_match(c, qs, 1) and not has_hot_match(c, qs, 2) and not has_hot_match(c, qs, 100)
    assert largest_match(c, spark.createDataFrame([("/nothing",)], "query string")) == 0


def test_read_catalog_json_lines_and_list_glob(spark, tmpdir_path):
    p = os.path.join(tmpdir_path, "cat.json")
    with open(p, "w") as f:
        f.write(json.dumps({"lfn": "/a/b/x.sim", "dir": "/a/b", "name": "x.sim", "creation_epoch": 2.0}) + "\n")
        f.write(json.dumps({"lfn": "/a/c/y.sim", "dir": "/a/c", "name": "y.sim"}) + "\n")
    df = read_catalog(spark, p, fmt="json")
    assert rows(df, "lfn", "creation_epoch") == [("/a/b/x.sim", 2.0), ("/a/c/y.sim", None)]
    root = os.path.join(tmpdir_path, "files")
    os.makedirs(os.path.join(root, "d"))
    for name in ["a.sim", "b.sim", "c.txt"]:
        with open(os.path.join(root, "d", name), "w") as f:
            f.write("x")
    assert rows(list_files(spark, root, glob="*.sim"), "lfn") == [("/d/a.sim",), ("/d/b.sim",)]
    assert list_files(spark, os.path.join(tmpdir_path, "none")).count() == 0


def test_prefilter_gives_same_results(spark):
    c = catalog(spark, ["/a", "/b", "/c"])
    w = spark.createDataFrame([("lfn:/a",), ("/z",), ("/a",)], "lfn string")
    assert rows(find_files(c, w, prefilter=True), "lfn", "status") == rows(find_files(c, w), "lfn", "status")
    new = spark.createDataFrame([("/a", 1), ("/d", 2), ("/d", 3)], "lfn string, seq int")
    assert rows(add_entries(c.select("lfn"), new, prefilter=True), "lfn", "seq", "status") == \
        rows(add_entries(c.select("lfn"), new), "lfn", "seq", "status")


def test_catalog_import_leaves_little_on_disk(spark, tmpdir_path, monkeypatch):
    from gridweave.plans import catalog_queries

    n, written = 4000, {}
    spark.range(n).selectExpr(
        "id AS l_orderkey", "CAST(id % 7 AS INT) AS l_linenumber", "id * 31 % 200 AS l_partkey", "id * 17 % 100 AS l_suppkey",
        "'A' AS l_returnflag", "'F' AS l_linestatus", "date_add(DATE'1994-01-01', CAST(id % 700 AS INT)) AS l_shipdate",
    ).coalesce(1).write.parquet(f"{tmpdir_path}/lineitem.parquet")
    read = catalog_queries.read_catalog

    def measured(spark, path, fmt="parquet"):
        local = path.removeprefix("file:")
        written[fmt] = sum(os.path.getsize(os.path.join(d, f)) for d, _, fs in os.walk(local) for f in fs)
        return read(spark, path, fmt)

    monkeypatch.setattr(catalog_queries, "read_catalog", measured)
    got = rows(catalog_queries.catalog_import_lineitem(spark, tmpdir_path), "form", "dir", "n_files", "n_names", "epochs")
    years = {y: sum((i % 700 >= 365) == (y == 1995) for i in range(n)) for y in (1994, 1995)}
    assert got == sorted((form, f"/grid/data/A/F/{y}", k, k, k / 2) for form in ("lines", "documents") for y, k in years.items())
    assert written["json"] < 40 * n and written["document"] < 30 * n  # bytes per entry
