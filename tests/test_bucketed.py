"""The catalog in buckets: same results as the plain operators, no shuffle of the catalog."""

import re

import pytest
from conftest import rows

from gridweave.operators.bucketed import MERGE_AT, BucketedCatalog, bucket_count
from gridweave.operators.catalog import add_entries, apply_additions, find_files, upsert_metadata
from gridweave.operators.changes import catalog_changes
from gridweave.sources.catalog import catalog_from_lfns, empty_catalog, write_catalog_snapshot
from gridweave.streaming.changes import read_changes, stream_catalog_changes


def frame(spark, items):
    return spark.createDataFrame(items, "lfn string, amount string")


def updates(spark, items):
    return spark.createDataFrame(items, "lfn string, amount string, seq long")


@pytest.fixture()
def plain_joins(spark):
    """Joins as they are of large tables: nothing small enough to be broadcast."""
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    spark.conf.set("spark.sql.adaptive.autoBroadcastJoinThreshold", "-1")
    yield
    spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.unset("spark.sql.adaptive.autoBroadcastJoinThreshold")


def exchanges_above_layers(df):
    """Exchanges of the plan with a layer's scan anywhere below them."""
    plan = df._jdf.queryExecution().executedPlan().toString().splitlines()
    depth = [len(re.match(r"^[\s:+\-|*()\d]*", line).group(0)) for line in plan]
    found = []
    for i, line in enumerate(plan):
        if "Exchange" in line:
            below = []
            for j in range(i + 1, len(plan)):
                if depth[j] <= depth[i]:
                    break
                below.append(plan[j])
            found += [line for b in below if "gridweave_layer" in b]
    return found


def test_changes_equal_the_plain_operators(spark, tmpdir_path):
    base = frame(spark, [(f"/a/{i}", str(i)) for i in range(40)])
    cat = BucketedCatalog.create(spark, f"{tmpdir_path}/c", base, 4)
    up = updates(spark, [("/a/3", "x", 1), ("/a/3", "y", 2), ("/b/1", "z", 1), (None, "no", 1), ("/a/5", None, 1)])
    assert cat.upsert(up) == 1
    want = upsert_metadata(base, up)
    assert rows(cat.read().fillna("-")) == rows(want.fillna("-"))
    new = updates(spark, [("/b/1", "q", 1), ("/b/2", "q", 2), ("/b/2", "r", 1), (None, "s", 1)])
    outcome = cat.insert(new)
    assert rows(outcome.fillna("-")) == rows(add_entries(want, new).fillna("-"))
    want = apply_additions(want, outcome)
    assert rows(cat.read().fillna("-")) == rows(want.fillna("-"))
    cat.remove(frame(spark, [("/b/2", None), ("/a/0", None), ("/nowhere", None), (None, None)]))
    left = [r for r in rows(want.fillna("-")) if r[0] not in ("/b/2", "/a/0")]
    assert rows(cat.read().fillna("-")) == left
    cat.upsert(updates(spark, [("/b/2", "back", 1)]))
    assert ("/b/2", "back") in rows(cat.read())
    assert rows(cat.read(0)) == rows(base)
    cat.close()


def test_layers_are_merged_and_old_versions_expire(spark, tmpdir_path):
    cat = BucketedCatalog.create(spark, f"{tmpdir_path}/c", frame(spark, [("/a", "0")]), 3)
    for i in range(MERGE_AT + 2):
        cat.upsert(updates(spark, [("/a", str(i), 1), (f"/n{i}", "n", 1)]))
    v = cat.version()
    assert len(v["layers"]) <= MERGE_AT
    want = sorted([("/a", str(MERGE_AT + 1))] + [(f"/n{i}", "n") for i in range(MERGE_AT + 2)])
    assert rows(cat.read()) == want
    cat.expire(v["version"])
    assert rows(cat.read()) == want
    with pytest.raises(LookupError):
        cat.read(0)
    cat.close()


def test_another_session_opens_the_folders(spark, tmpdir_path):
    first = BucketedCatalog.create(spark, f"{tmpdir_path}/c", frame(spark, [("/a", "1"), ("/b", None)]), 3)
    first.upsert(updates(spark, [("/a", "2", 1)]))
    first.close()
    again = BucketedCatalog(spark.newSession(), f"{tmpdir_path}/c")
    assert rows(again.read().fillna("-")) == [("/a", "2"), ("/b", "-")]
    again.close()


def test_the_catalog_is_not_shuffled(spark, tmpdir_path, plain_joins):
    base = catalog_from_lfns(frame(spark, [(f"/a/{i}", str(i)) for i in range(200)]))
    cat = BucketedCatalog.create(spark, f"{tmpdir_path}/c", base, 8)
    cat.upsert(catalog_from_lfns(frame(spark, [("/a/3", "x"), ("/b/1", "z")])).selectExpr("*", "1L seq"))
    wanted = spark.createDataFrame([("lfn:/a/3",), ("/b/1",), ("/c",), (None,)], "lfn string")
    found = cat.find(wanted)
    assert rows(found.select("lfn", "status").fillna("-")) == rows(find_files(cat.read(), wanted).select("lfn", "status").fillna("-"))
    assert "Exchange" in found._jdf.queryExecution().executedPlan().toString()  # the wanted names are
    assert exchanges_above_layers(found) == []
    assert exchanges_above_layers(cat.read()) == []
    new = spark.createDataFrame([("/a/3", 1), ("/z", 2)], "lfn string, seq long")
    assert exchanges_above_layers(add_entries(cat.read(), new)) == []
    assert exchanges_above_layers(catalog_changes(cat.read(0), cat.read())) == []
    assert exchanges_above_layers(base.join(cat.read().repartition(5), "lfn")) != []
    cat.close()


def test_refused_catalogs(spark, tmpdir_path):
    for i, (items, message) in enumerate([([("/a", "1"), ("/a", "2")], "more than once"), ([(None, "1")], "without a name")]):
        with pytest.raises(ValueError, match=message):
            BucketedCatalog.create(spark, f"{tmpdir_path}/{i}", frame(spark, items), 2)
        with pytest.raises(Exception):
            BucketedCatalog(spark, f"{tmpdir_path}/{i}").read()
    with pytest.raises(ValueError, match="_gone"):
        BucketedCatalog.create(spark, f"{tmpdir_path}/x", frame(spark, []).selectExpr("*", "true _gone"), 2)
    assert bucket_count(0) == 16 and bucket_count(10**9) == 500


def test_empty_catalog(spark, tmpdir_path):
    cat = BucketedCatalog.create(spark, f"{tmpdir_path}/c", empty_catalog(spark), 2)
    assert cat.read().count() == 0 and cat.changes(0, 0).count() == 0
    cat.remove(frame(spark, []))
    cat.upsert(catalog_from_lfns(frame(spark, [("/a", "1")])).selectExpr("*", "1L seq"))
    assert rows(cat.read(), "lfn") == [("/a",)]
    assert rows(cat.changes(0, 2), "lfn", "change") == [("/a", "added")]
    cat.close()


def test_changes_between_versions_equal_a_full_compare(spark, tmpdir_path):
    base = frame(spark, [(f"/a/{i}", str(i)) for i in range(30)])
    cat = BucketedCatalog.create(spark, f"{tmpdir_path}/c", base, 4)
    cat.upsert(updates(spark, [("/a/1", "x", 1), ("/a/2", "2", 1), ("/n", "n", 1)]))
    cat.remove(frame(spark, [("/a/9", None), ("/n", None)]))
    cat.upsert(updates(spark, [("/m", None, 1)]))
    last = cat.merge()
    for old, new in ((0, 1), (1, 2), (2, 0), (1, 3), (3, last), (0, last)):
        want = rows(catalog_changes(cat.read(old), cat.read(new)), "lfn", "change")
        assert rows(cat.changes(old, new), "lfn", "change") == want
    files = [f for f in cat.read().inputFiles()]
    assert len(files) <= 4 and all("layer_" in f for f in files)  # one file per bucket, though nothing was shuffled
    assert rows(cat.changes(0, last), "lfn", "change") == [("/a/1", "replaced"), ("/a/9", "removed"), ("/m", "added")]
    cat.close()


def test_catalog_changes_of_nulls_and_other_columns(spark):
    old = spark.createDataFrame([("/a", None, 1), ("/b", "x", 1), (None, "k", 1), ("/c", "y", None)], "lfn string, v string, w int")
    new = spark.createDataFrame([(1, "/a", None), (1, "/b", "z"), (1, None, "m"), (None, "/c", "y"), (None, "/d", None)],
                                "w int, lfn string, v string")
    assert rows(catalog_changes(old, new), "lfn", "change") == [("/b", "replaced"), ("/d", "added")]
    assert rows(catalog_changes(new.select("lfn"), old.select("lfn")), "lfn", "change") == [("/d", "removed")]
    with pytest.raises(ValueError, match="before"):
        catalog_changes(*[frame(spark, []).withColumnRenamed("lfn", "before")] * 2, key="before")


def test_snapshot_stream_equals_a_full_compare(spark, tmpdir_path):
    root, out, cp = f"{tmpdir_path}/cat", f"{tmpdir_path}/out", f"{tmpdir_path}/cp"
    states = [frame(spark, s) for s in ([("/a", "1"), ("/b", "1")], [("/a", "2"), ("/b", "1"), ("/c", None)], [("/c", None)])]

    def run():
        q = stream_catalog_changes(spark, root, out, cp)
        q.awaitTermination()
        assert q.exception() is None

    for i, s in enumerate(states):
        write_catalog_snapshot(s, root, snapshot=f"s{i}")
        if i != 1:
            run()
    run()  # nothing new
    got = rows(read_changes(spark, out), "snapshot", "lfn", "change")
    want = [("s0", "/a", "added"), ("s0", "/b", "added")]
    for i in (1, 2):
        want += [(f"s{i}", *r) for r in rows(catalog_changes(states[i - 1], states[i]), "lfn", "change")]
    assert got == sorted(want)
