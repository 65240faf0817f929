"""Directory queries with wildcards from a table, and refused column names."""

import random
import re

import pytest
from pyspark.sql import functions as F

from conftest import rows
from gridweave.operators.catalog import add_entries, find_files, glob_to_regex, match_query
from gridweave.operators.grouping import fixed_groups, rank_within
from gridweave.operators.outputs import route_outputs
from gridweave.operators.patterns import candidates, match_pattern_table, pattern_regex
from gridweave.sources.catalog import catalog_from_lfns

PATTERNS = ["/a/*", "/a/b", "/*/b", "/a/[bc]", "/a/[!b]", "/a/[!]x]", "/a/[]x]", "/a/[!]", "/a/[", "/a/b?", "/?/??", "/a/.h*", "/a/*h", "/a/[.]h",
            "/a/[a-c]*", "/a/[c-a]", "/a/[^b]", "/a/[[]", "/a/[a&&b]", "/a/[\\]", "/a/b+", "/a/(b)", "/a/é*", "/a/[/]", "lfn:/a/b/", "/", "/*", "a/b", "/a/b$"]


def _catalog(spark, lfns):
    return catalog_from_lfns(spark.createDataFrame([(x,) for x in lfns], "lfn string"))


def _dirs():
    rng = random.Random(1)
    own = ["b", "c", "d", "]", "x", "[", "[!]", "^", "&", "\\", "b+", "(b)", "é1", ".hid", "h", "bb", "b$", "-", "!"]
    return ["/" + "/".join([first, *extra, "file"]) for first in ("a", "z", "é") for extra in ([], *[[o] for o in own], [rng.choice(own)] * 2)]


def test_expression_is_the_function_of_one_pattern(spark):
    tested = [p for p in PATTERNS if "[c-a]" not in p]
    df = spark.createDataFrame([(p,) for p in tested], "p string").select("p", pattern_regex("p").alias("r"))
    names = [d.rsplit("/", 1)[0] for d in _dirs()]
    for p, r in df.collect():
        assert [d for d in names if re.match(r, d)] == [d for d in names if re.match(glob_to_regex(p), d)], p


def test_table_of_patterns_equals_one_at_a_time(spark):
    lfns = [*_dirs(), "/a/b/.hidden", "/top"]
    cat = _catalog(spark, lfns)
    asked = [(i, p) for i, p in enumerate([*PATTERNS, "/a/b", None])]
    got = rows(match_pattern_table(cat, spark.createDataFrame(asked, "q int, pattern string")), "q", "lfn")
    want = []
    for i, p in asked:
        if p is None or p == "/a/[c-a]":  # matches nothing
            continue
        key = re.sub(r"(.)/+$", r"\1", re.sub(r"^(?:lfn:)?(?:LFN:)?/*", "/", p, count=1))
        for lfn in lfns:
            d, name = lfn.rsplit("/", 1)
            if not name.startswith(".") and re.match(glob_to_regex(key), d or "/"):
                want.append((i, lfn))
    assert got == sorted(want) and len(want) > 60


def test_plan_has_no_nested_loop_and_thousands_of_patterns(spark):
    cat = _catalog(spark, [f"/d/{i % 50}/{i}/f" for i in range(3000)])
    asked = spark.range(5000).select("id", F.concat(F.lit("/d/*/"), F.col("id").cast("string")).alias("pattern"))
    out = match_pattern_table(cat, asked)
    plan = out._jdf.queryExecution().executedPlan().toString()
    assert "NestedLoop" not in plan and "Cartesian" not in plan
    assert rows(out, "id") == [(i,) for i in range(3000)]


def test_empty_tables(spark):
    none = spark.createDataFrame([], "pattern string")
    assert match_pattern_table(_catalog(spark, ["/a/b"]), none).collect() == []
    assert match_pattern_table(_catalog(spark, []), spark.createDataFrame([("/*",)], "pattern string")).collect() == []


def test_names_of_the_result_are_refused(spark):
    cat = _catalog(spark, ["/a/b"])
    for frame, op in (("name string, query string", lambda f: match_query(cat, f)),
                      ("Dir string, pattern string", lambda f: match_pattern_table(cat, f)),
                      ("lfn string, status string", lambda f: find_files(cat, f)),
                      ("lfn string, cat_metadata string", lambda f: find_files(cat, f)),
                      ("lfn string, seq long, message string", lambda f: add_entries(cat, f)),
                      ("rn long, k long, o long", lambda f: rank_within(f, ["k"], "o")),
                      ("n long, o long", lambda f: fixed_groups(f, ["n"], "o", 2))):
        with pytest.raises(ValueError, match="rename them"):
            op(spark.createDataFrame([], frame))


@pytest.mark.parametrize("method", ["window", "split"])
def test_groups_with_any_column_names(spark, method):
    df = spark.createDataFrame([(i % 2, i, i, i, -i, i) for i in range(10)], "_k0 int, gid int, rn int, n int, _size int, _pos int")
    got = rows(fixed_groups(df, ["_k0"], "rn", 2, value="gid", method=method).select("_k0", "gid", F.array_join("members", ","), "n"))
    assert got == [(0, 0, "0,4", 2), (0, 1, "8", 2)] or got == [(0, 0, "0,2", 2), (0, 1, "4,6", 2), (1, 0, "1,3", 2), (1, 1, "5,7", 2)]
    got = rows(fixed_groups(df.where("_k0 = 0"), ["_pos"], "_size", 1, method=method).select("_pos", "gid", F.col("members")[0]))
    assert got == [(i, 0, -i) for i in range(0, 10, 2)]


def test_missing_name_is_reported(spark):
    got = rows(find_files(_catalog(spark, ["/a/b"]), spark.createDataFrame([(None,), ("/a/b",), ("/x",)], "lfn string"))
               .select(F.coalesce("lfn", F.lit("-")), "status", F.coalesce("message", F.lit("-"))))
    assert got == [("-", "Failed", "File without a name"), ("/a/b", "Successful", "-"), ("/x", "Failed", "File /x not found")]


def test_empty_source_path_is_rejected(spark):
    outs = spark.createDataFrame([(1, "o", 0, "", None), (1, "o", 1, "/x/y", None), (1, "p", 0, None, "bad")],
                                 "job int, output_name string, pos int, path string, error string")
    paths = spark.createDataFrame([(1, "o", "/s")], "job int, output_name string, lfn string")
    sandbox = spark.createDataFrame([(1, "o")], "job int, output_name string")
    got = {(r.output_name, r.pos): r for r in route_outputs(outs, paths, sandbox, ["job"]).collect()}
    empty = got["o", 0]
    assert (empty.to_catalog, empty.to_sandbox, empty.target) == (False, False, None) and empty.error.endswith(" of o")
    assert got["o", 1].target == "/s/y" and got["p", 0].error == "bad"


def test_texts_around_wildcards_are_join_keys(spark):
    dirs = spark.range(400).select(F.concat(F.lit("/e/view/u"), F.col("id").cast("string"), F.lit(".d")).alias("dir"))
    ids = spark.range(400).select(F.col("id").cast("string").alias("id"))
    asked = ids.select(F.inline(F.array(*[F.struct(F.concat(F.lit(a), "id", F.lit(b)).alias("pattern")) for a, b in
                                          (("/e/view/u", "?.d"), ("/e/vi*/u", "*"), ("/e/view/*", ".d"), ("/e/[v]iew/?", ".d"))])))
    met = candidates(dirs, asked).cache()
    assert met.count() < 400 * 4 * 4  # of 400 patterns of each kind against 400 directories
    ids = [str(i) for i in range(400)]
    want = 400 + sum((len(y) == len(x) + 1 and y.startswith(x)) + y.startswith(x) + f"u{y}".endswith(x) for x in ids for y in ids)
    assert met.where(F.expr("_dir rlike _regex")).count() == want
    met.unpersist()


def test_texts_around_wildcards_at_line_ends_and_edges(spark):
    names = ["ab", "ab\n", "a\r\n", "ab\u2028", "aba", "a", "b", "[ab", "x]b", "a]", "é", "éb", "𝒳b", "a𝒳", "ab\n\n", ".ab"]
    tails = ["a*", "*b", "a*b", "ab*ba", "?b", "a?", "[[]ab", "[ab", "[x]]b", "[a]]", "a]*", "*]b", "é*", "*é", "𝒳?", "?𝒳", "*b\n", "a*\n",
             "a?\n", "*a*", "[!a]b", "[!]]b", "*[b]", "[a]*", ".*b", "**", "a**b", "?[!x]*b"]
    dirs = spark.createDataFrame([(f"/d/{n}{end}",) for n in names for end in ("", "/in")], "dir string")
    asked = spark.createDataFrame([(f"/d/{p}{end}",) for p in tails for end in ("", "/in", "/i*")], "pattern string")
    tested = asked.join(dirs.select(F.col("dir").alias("_dir")), F.expr("true")).withColumn("r", pattern_regex("pattern"))
    want = rows(tested.where(F.col("pattern").rlike(r"[*?\[]") & F.expr("_dir rlike r")), "pattern", "_dir")
    got = rows(candidates(dirs, asked).where(F.expr("_dir rlike _regex")), "pattern", "_dir")
    assert got == want and len(want) > 150
