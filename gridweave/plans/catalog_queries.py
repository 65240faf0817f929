"""Catalog and grouping queries, and the flagship transformation plan."""

from __future__ import annotations

from pyspark.sql import functions as F

from gridweave.functions.lfn import LFN_PREFIX_UPPER, input_query
from gridweave.operators.bucketed import BucketedCatalog, bucket_count
from gridweave.operators.catalog import (
    add_entries,
    has_hot_match,
    find_files,
    match_patterns,
    match_query,
    upsert_metadata,
)
from gridweave.operators.grouping import HOT_ROWS, fixed_groups, group_limit, union_queries, zip_groups
from gridweave.operators.patterns import match_pattern_table
from gridweave.operators.jobs import EXECUTABLE_LINE, render_job_text
from gridweave.plans.inputs import (
    FLAGSHIP_GROUP,
    QUERY_ROOT,
    events_catalog,
    lineitem_catalog,
    lineitem_dir,
    lineitem_lfn,
    lineitem_name,
    lineitem_tasks,
)
from gridweave.plans.tables import table
from gridweave.session import kept_result, scratch_dir
from gridweave.sources.catalog import catalog_from_parts, read_catalog, read_latest_catalog, write_catalog_snapshot
from gridweave.streaming.changes import read_changes, stream_catalog_changes

EVENT_GROUP = 7
ZIP_GROUP = 5
LIMIT_GROUPS = 10
# Entries of one legacy catalog document, on average.
DOCUMENT_ENTRIES = 20_000


def transformation_jobs(spark, sf, group_size: int = FLAGSHIP_GROUP, method: str = "auto"):
    """Catalog -> query path per task input -> files below it -> groups of ``group_size`` ->
    i-th group of every input zipped into job i -> submission text."""
    # catalog names are canonical, so a file's reference is made once, in the scan
    catalog = lineitem_catalog(spark, sf).withColumn("ref", F.concat(F.lit(LFN_PREFIX_UPPER), "lfn"))
    _, inputs = lineitem_tasks(spark, sf)
    inputs = kept_result(inputs)  # the task spec: small, read three times below
    queries = inputs.withColumn("query", input_query(QUERY_ROOT, None, F.col("campaign"), F.col("site"),
                                                     None, F.col("input_name")))
    if method == "auto":
        # a group key is one queried directory: size it from the catalog's dir column alone
        method = "split" if has_hot_match(catalog, queries, HOT_ROWS) else "window"
    matched = match_query(catalog, queries)
    groups = fixed_groups(matched, ["task_id", "input_name"], order="lfn", size=group_size,
                          value="ref", method=method)
    jobs = zip_groups(groups, inputs, ["task_id"])
    jobs = (jobs.withColumn("refs", F.flatten(F.col("inputs.members")))
                .withColumn("data", F.array_join("refs", ", "))
                .withColumn("sandbox_id", F.concat(F.lit("SB:SandboxSE|/S3/sandbox-store/"), F.col("task_id"),
                                                   F.lit("_"), F.col("gid").cast("string"), F.lit(".tar.zst"))))
    return jobs.select("task_id", "gid", F.size("inputs").cast("long").alias("n_inputs"),
                       F.size("refs").cast("long").alias("n_files"),
                       render_job_text(jobs, data="data").alias("jdl"))


def catalog_match_lineitem(spark, sf):
    """Every task input's query path and the catalog files directly below it."""
    catalog = lineitem_catalog(spark, sf)
    _, inputs = lineitem_tasks(spark, sf)
    queries = inputs.withColumn("query", input_query(QUERY_ROOT, None, F.col("campaign"), F.col("site"),
                                                     None, F.col("input_name")))
    return match_query(catalog, queries).select("task_id", "query", "lfn", "name")


def catalog_snapshot_lineitem(spark, sf):
    """The lineitem catalog written as a snapshot (partitioned by return flag), read back as the
    latest committed snapshot, and matched against every task input's query path."""
    li = table(spark, sf, "lineitem")
    cat = catalog_from_parts(li, lineitem_dir(), lineitem_name(), keep=["l_returnflag"])
    _, inputs = lineitem_tasks(spark, sf)
    queries = inputs.withColumn("query", input_query(QUERY_ROOT, None, F.col("campaign"), F.col("site"),
                                                     None, F.col("input_name")))
    with scratch_dir(spark, "catalog") as root:
        write_catalog_snapshot(cat, root, partition_by=["l_returnflag"])
        m = match_query(read_latest_catalog(spark, root), queries)
        return kept_result(m.groupBy("query").agg(F.count(F.lit(1)).alias("n_files"), F.min("name").alias("first_name")))


def catalog_import_lineitem(spark, sf):
    """The lineitem catalog written as JSON lines and as one legacy document per directory, read back
    in both forms and counted per directory; a catalog that is not there counts nothing."""
    cat = lineitem_catalog(spark, sf).withColumn("creation_epoch", F.lit(0.5))
    entry = F.struct("lfn", F.struct(F.col("creation_epoch").alias("CreationDate")))
    with scratch_dir(spark, "catalog-import") as root:
        # names of a directory share most of their text: compressed, both forms take a fraction of the disk
        cat.write.option("compression", "gzip").json(f"{root}/lines")
        # a legacy document is one file; each holds up to DOCUMENT_ENTRIES entries of the catalog
        n_docs = max(1, -(-cat.count() // DOCUMENT_ENTRIES))
        part = F.pmod(F.xxhash64("lfn"), F.lit(n_docs))
        docs = cat.groupBy(part.alias("doc")).agg(F.to_json(F.map_from_entries(F.collect_list(entry))).alias("value"))
        docs.repartition("doc").write.partitionBy("doc").option("compression", "gzip").text(f"{root}/documents")
        forms = [("lines", read_catalog(spark, f"{root}/lines", "json")),
                 ("documents", read_catalog(spark, f"{root}/documents", "document")),
                 ("nowhere", read_catalog(spark, f"{root}/nowhere"))]
        counted = [df.groupBy("dir").agg(F.count(F.lit(1)).alias("n_files"), F.countDistinct("lfn").alias("n_names"),
                                         F.sum("creation_epoch").alias("epochs")).withColumn("form", F.lit(form))
                   for form, df in forms]
        return kept_result(union_queries(*counted).select("form", "dir", "n_files", "n_names", "epochs"))


def match_pattern_table_events(spark, sf):
    """One directory query with wildcards per (user, kind of pattern), taken from a table, against the
    catalog ``/events/<event_type>/<user_id>/<event_id>``."""
    ev = table(spark, sf, "events")
    user = F.col("user_id").cast("string")
    cat = catalog_from_parts(ev, F.concat(F.lit("/events/"), F.col("event_type"), F.lit("/"), user), F.col("event_id").cast("string"))

    def row(kind, before, after=""):
        return F.struct(F.lit(kind).alias("kind"), F.concat(F.lit(before), user, F.lit(after)).alias("pattern"))

    kinds = F.array(row("any", "lfn:/events/*/"), row("one", "/events/c[kl-n]ic?/"), row("not", "/events/[!a-r]i*/"),
                    row("below", "/events/view/", "?"), row("plain", "/events/signup/", "/"), row("none", "/events/", "/*"),
                    row("root", "/*/error/"))
    asked = ev.select("user_id").distinct().select("user_id", F.inline(kinds))
    return match_pattern_table(cat, asked).select("user_id", "kind", "pattern", "lfn")


def find_files_lineitem(spark, sf):
    """Look up every line's file (written with ``lfn:``, ``LFN:`` or no prefix) in a catalog that
    holds only the finished lines (linestatus F)."""
    li = table(spark, sf, "lineitem")
    path = lineitem_lfn()
    wanted = li.select(F.when(F.col("l_returnflag") == "A", F.concat(F.lit("lfn:"), path))
                        .when(F.col("l_returnflag") == "N", F.concat(F.lit("LFN:"), path))
                        .otherwise(path).alias("lfn"))
    catalog = catalog_from_parts(li.filter(F.col("l_linestatus") == "F"), lineitem_dir(), lineitem_name())
    return find_files(catalog, wanted).select("lfn", "status", "message")


def _orders_catalog(spark, sf):
    o = table(spark, sf, "orders")
    return (o.filter(F.col("o_orderdate") < F.lit("1998-01-01").cast("timestamp_ntz"))
             .select(F.concat(F.lit("/orders/"), F.col("o_orderkey").cast("string")).alias("lfn"),
                     F.col("o_orderstatus").alias("status"),
                     F.col("o_totalprice").cast("string").alias("amount")))


def _line_updates(spark, sf):
    li = table(spark, sf, "lineitem")
    return li.select(F.concat(F.lit("/orders/"), F.col("l_orderkey").cast("string")).alias("lfn"),
                     F.col("l_linestatus").alias("status"),
                     F.col("l_extendedprice").cast("string").alias("amount"),
                     "l_linenumber", "l_partkey", "l_suppkey", _line_seq().alias("seq"))


def _line_seq():
    """One number that orders the lines of an order: line number, part, supplier, ship date."""
    def number(col):
        return col.cast("decimal(38,0)")

    seq = number(F.col("l_linenumber"))
    for col, digits in ((F.col("l_partkey"), 12), (F.col("l_suppkey"), 12), (F.unix_date(F.to_date("l_shipdate")), 6)):
        seq = number(number(seq * F.lit(10**digits).cast("decimal(13,0)")) + number(col))
    return seq


def add_entries_orders(spark, sf):
    """Insert-if-absent of one entry per line into a catalog of the orders before 1998."""
    out = add_entries(_orders_catalog(spark, sf), _line_updates(spark, sf).drop("status"), key="lfn", seq="seq")
    return out.select("lfn", "l_linenumber", "l_partkey", "l_suppkey", "status", "message")


def upsert_orders(spark, sf):
    """Whole-entry replacement: every line rewrites its order's entry; the last line wins."""
    return upsert_metadata(_orders_catalog(spark, sf), _line_updates(spark, sf), key="lfn", seq="seq")


def find_files_bucketed_lineitem(spark, sf):
    """The lookups of :func:`find_files_lineitem` against a catalog in buckets, which is not shuffled for them."""
    li = table(spark, sf, "lineitem")
    path = lineitem_lfn()
    wanted = li.select(F.when(F.col("l_returnflag") == "A", F.concat(F.lit("lfn:"), path))
                        .when(F.col("l_returnflag") == "N", F.concat(F.lit("LFN:"), path))
                        .otherwise(path).alias("lfn"))
    finished = catalog_from_parts(li.filter(F.col("l_linestatus") == "F"), lineitem_dir(), lineitem_name())
    with scratch_dir(spark, "buckets") as root:
        cat = BucketedCatalog.create(spark, root, finished, bucket_count(li.count()))
        found = kept_result(cat.find(wanted).select("lfn", "status", "message"))
        cat.close()
    return found


def _order_versions(spark, sf, root):
    """The orders before 1998 in buckets; first lines, then all others replace entries; orders with a
    returned line are removed."""
    cat = BucketedCatalog.create(spark, root, _orders_catalog(spark, sf), bucket_count(table(spark, sf, "orders").count()))
    lines = _line_updates(spark, sf)
    cat.upsert(lines.where("l_linenumber = 1"))
    cat.upsert(lines.where("l_linenumber > 1"))
    cat.remove(table(spark, sf, "lineitem").where("l_returnflag = 'R'")
               .select(F.concat(F.lit("/orders/"), F.col("l_orderkey").cast("string")).alias("lfn")))
    return cat


def upsert_bucketed_orders(spark, sf):
    """The orders after two rounds of replacement and a removal, none of which rewrote the catalog."""
    with scratch_dir(spark, "buckets") as root:
        cat = _order_versions(spark, sf, root)
        out = kept_result(cat.read())
        cat.close()
    return out


def catalog_changes_orders(spark, sf):
    """What the replacements and the removal changed, from the layers they wrote."""
    with scratch_dir(spark, "buckets") as root:
        cat = _order_versions(spark, sf, root)
        out = kept_result(cat.changes(0, cat.version()["version"]).select("lfn", "change"))
        cat.close()
    return out


def snapshot_changes_orders(spark, sf):
    """Changes of the orders over three committed snapshots, as a stream stopped and started between them:
    the orders before 1998, these with their lines' entries, and those without a returned line."""
    lines = _line_updates(spark, sf)
    first = _orders_catalog(spark, sf)
    second = upsert_metadata(first, lines)
    returned = (table(spark, sf, "lineitem").where("l_returnflag = 'R'")
                .select(F.concat(F.lit("/orders/"), F.col("l_orderkey").cast("string")).alias("lfn")))
    third = second.join(returned, "lfn", "left_anti")
    with scratch_dir(spark, "snapshot-changes") as root:
        for i, state in enumerate((first, second, third)):
            write_catalog_snapshot(state, f"{root}/catalog", snapshot=str(i))
            if i != 1:
                query = stream_catalog_changes(spark, f"{root}/catalog", f"{root}/changes", f"{root}/checkpoint")
                query.awaitTermination()
        return kept_result(read_changes(spark, f"{root}/changes").select(F.col("snapshot").cast("long").alias("snapshot"), "lfn", "change"))


def _event_groups(spark, sf, size, max_groups=None):
    cat = events_catalog(spark, sf)
    return fixed_groups(cat, ["event_type"], order="event_id", size=size, value="event_id", max_groups=max_groups)


def fixed_groups_events(spark, sf):
    g = _event_groups(spark, sf, EVENT_GROUP)
    return g.select("event_type", "gid", F.array_join("members", ",").alias("members"), "n")


def group_limit_events(spark, sf):
    """The first ten groups of every event type; no more rows are ranked than those hold."""
    g = group_limit(_event_groups(spark, sf, EVENT_GROUP, max_groups=LIMIT_GROUPS), LIMIT_GROUPS)
    return g.select("event_type", "gid", F.array_join("members", ",").alias("members"))


def zip_groups_events(spark, sf):
    """Job i takes the i-th group of 5 clicks and the i-th group of 5 views."""
    cat = events_catalog(spark, sf).filter(F.col("event_type").isin("click", "view")) \
        .withColumn("task_id", F.lit("click-view"))
    groups = fixed_groups(cat, ["task_id", "event_type"], order="event_id", size=ZIP_GROUP, value="event_id")
    inputs = spark.createDataFrame([("click-view", "click", 0), ("click-view", "view", 1)],
                                   "task_id string, event_type string, input_pos int")
    jobs = zip_groups(groups, inputs, ["task_id"], input_col="event_type")
    return jobs.select("gid",
                       F.array_join(F.col("inputs")[0]["members"], ",").alias("click_members"),
                       F.array_join(F.col("inputs")[1]["members"], ",").alias("view_members"))


def union_queries_events(spark, sf):
    """Three directory queries, one of them twice: results appended, duplicates kept."""
    cat = events_catalog(spark, sf)
    res = match_patterns(cat, ["/events/click", "events/view", "/events/click/", "/events/s*"])
    return res.select("query_pos", "lfn")


_CAT = """'/grid/data/' || l_returnflag || '/' || l_linestatus || '/' || CAST(year(l_shipdate) AS VARCHAR) || '/'
   || l_orderkey || '_' || l_linenumber || '_' || l_partkey || '_' || l_suppkey || '.sim'"""

_FLAGSHIP_SQL = f"""
WITH cat AS (
  SELECT {_CAT} AS lfn, l_returnflag AS rf, l_linestatus AS ls,
         CAST(year(l_shipdate) AS VARCHAR) AS input_name, year(l_shipdate) AS input_pos
  FROM lineitem),
ranked AS (SELECT *, row_number() OVER (PARTITION BY rf, ls, input_name ORDER BY lfn) AS rn FROM cat),
g AS (SELECT rf, ls, input_name, input_pos, (rn - 1) // 5 AS gid,
             string_agg('LFN:' || lfn, ', ' ORDER BY rn) AS members, count(*) AS n
      FROM ranked GROUP BY rf, ls, input_name, input_pos, (rn - 1) // 5 HAVING count(*) = 5),
k AS (SELECT rf, ls, count(DISTINCT input_name) AS k FROM cat GROUP BY rf, ls),
jobs AS (SELECT rf, ls, gid, string_agg(members, ', ' ORDER BY input_pos) AS data,
                count(*) AS have, sum(n) AS n_files FROM g GROUP BY rf, ls, gid)
SELECT rf || '-' || ls AS task_id, CAST(gid AS BIGINT) AS gid, CAST(have AS BIGINT) AS n_inputs,
       CAST(n_files AS BIGINT) AS n_files,
       '{EXECUTABLE_LINE}' || chr(10) || 'Arguments = job.json;' || chr(10) ||
       'JobName = test;' || chr(10) || 'OutputSandbox = {{std.out, std.err}};' || chr(10) ||
       'Priority = 10;' || chr(10) ||
       'InputSandbox = SB:SandboxSE|/S3/sandbox-store/' || rf || '-' || ls || '_' || CAST(gid AS VARCHAR) || '.tar.zst;'
       || chr(10) || 'InputData = ' || data || ';' AS jdl
FROM jobs JOIN k USING (rf, ls) WHERE have = k
"""

_MATCH_SQL = f"""
SELECT l_returnflag || '-' || l_linestatus AS task_id,
       '/grid/data/' || l_returnflag || '/' || l_linestatus || '/' || CAST(year(l_shipdate) AS VARCHAR) AS query,
       {_CAT} AS lfn,
       l_orderkey || '_' || l_linenumber || '_' || l_partkey || '_' || l_suppkey || '.sim' AS name
FROM lineitem
"""

_SNAPSHOT_SQL = f"""
SELECT '/grid/data/' || l_returnflag || '/' || l_linestatus || '/' || CAST(year(l_shipdate) AS VARCHAR) AS query,
       count(*) AS n_files,
       min(l_orderkey || '_' || l_linenumber || '_' || l_partkey || '_' || l_suppkey || '.sim') AS first_name
FROM lineitem GROUP BY 1
"""

_IMPORT_SQL = f"""
WITH c AS (SELECT '/grid/data/' || l_returnflag || '/' || l_linestatus || '/' || CAST(year(l_shipdate) AS VARCHAR) AS dir,
                  {_CAT} AS lfn FROM lineitem),
n AS (SELECT dir, count(*) AS n_files, count(DISTINCT lfn) AS n_names, 0.5 * count(*) AS epochs FROM c GROUP BY dir)
SELECT 'lines' AS form, dir, n_files, n_names, CAST(epochs AS DOUBLE) AS epochs FROM n
UNION ALL SELECT 'documents', dir, n_files, n_names, CAST(epochs AS DOUBLE) FROM n
"""

_FIND_SQL = f"""
WITH w AS (SELECT CASE WHEN l_returnflag = 'A' THEN 'lfn:' || {_CAT}
                       WHEN l_returnflag = 'N' THEN 'LFN:' || {_CAT} ELSE {_CAT} END AS lfn,
                  {_CAT} AS k FROM lineitem),
c AS (SELECT DISTINCT {_CAT} AS k FROM lineitem WHERE l_linestatus = 'F')
SELECT w.lfn, CASE WHEN c.k IS NULL THEN 'Failed' ELSE 'Successful' END AS status,
       CASE WHEN c.k IS NULL THEN 'File ' || w.lfn || ' not found' END AS message
FROM w LEFT JOIN c ON w.k = c.k
"""

_ADD_SQL = """
WITH cat AS (SELECT '/orders/' || o_orderkey AS lfn FROM orders WHERE o_orderdate < TIMESTAMP '1998-01-01'),
new AS (SELECT '/orders/' || l_orderkey AS lfn, l_linenumber, l_partkey, l_suppkey,
               row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey, l_shipdate) AS rn
        FROM lineitem)
SELECT new.lfn, l_linenumber, l_partkey, l_suppkey,
       CASE WHEN rn = 1 AND cat.lfn IS NULL THEN 'added' ELSE 'rejected' END AS status,
       CASE WHEN rn = 1 AND cat.lfn IS NULL THEN NULL ELSE 'File ' || new.lfn || ' already exists' END AS message
FROM new LEFT JOIN cat ON new.lfn = cat.lfn
"""

_UPSERT_SQL = """
WITH cat AS (SELECT '/orders/' || o_orderkey AS lfn, o_orderstatus AS status, CAST(o_totalprice AS VARCHAR) AS amount
             FROM orders WHERE o_orderdate < TIMESTAMP '1998-01-01'),
upd AS (SELECT '/orders/' || l_orderkey AS lfn,
               arg_max(l_linestatus, (l_linenumber, l_partkey, l_suppkey, l_shipdate)) AS status,
               arg_max(CAST(l_extendedprice AS VARCHAR), (l_linenumber, l_partkey, l_suppkey, l_shipdate)) AS amount
        FROM lineitem GROUP BY l_orderkey)
SELECT * FROM cat WHERE lfn NOT IN (SELECT lfn FROM upd)
UNION ALL SELECT * FROM upd
"""

_RETURNED = "(SELECT '/orders/' || l_orderkey FROM lineitem WHERE l_returnflag = 'R')"
_BUCKETED_SQL = f"SELECT * FROM ({_UPSERT_SQL}) WHERE lfn NOT IN {_RETURNED}"

_STATES = f"""
WITH a AS (SELECT '/orders/' || o_orderkey AS lfn, o_orderstatus AS status, CAST(o_totalprice AS VARCHAR) AS amount
           FROM orders WHERE o_orderdate < TIMESTAMP '1998-01-01'),
b AS ({_UPSERT_SQL}),
c AS (SELECT * FROM b WHERE lfn NOT IN {_RETURNED})
"""


def _compare_sql(old, new, first=""):
    return f"""
SELECT {first} coalesce(o.lfn, n.lfn) AS lfn,
       CASE WHEN o.lfn IS NULL THEN 'added' WHEN n.lfn IS NULL THEN 'removed' ELSE 'replaced' END AS change
FROM {old} o FULL JOIN {new} n ON o.lfn = n.lfn
WHERE o.lfn IS NULL OR n.lfn IS NULL OR (o.status, o.amount) IS DISTINCT FROM (n.status, n.amount)"""


_CHANGES_SQL = _STATES + _compare_sql("a", "c")
_SNAPSHOT_CHANGES_SQL = (_STATES + "SELECT 0::BIGINT AS snapshot, lfn, 'added' AS change FROM a UNION ALL"
                         + _compare_sql("a", "b", "1::BIGINT AS snapshot,") + " UNION ALL" + _compare_sql("b", "c", "2::BIGINT AS snapshot,"))

_GROUPS_SQL = """
WITH r AS (SELECT event_type, event_id,
                  row_number() OVER (PARTITION BY event_type ORDER BY event_id) AS rn FROM events),
g AS (SELECT event_type, (rn - 1) // 7 AS gid, string_agg(CAST(event_id AS VARCHAR), ',' ORDER BY rn) AS members,
             count(*) AS n FROM r GROUP BY event_type, (rn - 1) // 7)
SELECT event_type, CAST(gid AS BIGINT) AS gid, members, n FROM g WHERE n = 7
"""

_LIMIT_SQL = """
WITH r AS (SELECT event_type, event_id,
                  row_number() OVER (PARTITION BY event_type ORDER BY event_id) AS rn FROM events),
g AS (SELECT event_type, (rn - 1) // 7 AS gid, string_agg(CAST(event_id AS VARCHAR), ',' ORDER BY rn) AS members,
             count(*) AS n FROM r GROUP BY event_type, (rn - 1) // 7)
SELECT event_type, CAST(gid AS BIGINT) AS gid, members FROM g WHERE n = 7 AND gid < 10
"""

_ZIP_SQL = """
WITH r AS (SELECT event_type, event_id,
                  row_number() OVER (PARTITION BY event_type ORDER BY event_id) AS rn
           FROM events WHERE event_type IN ('click', 'view')),
g AS (SELECT event_type, (rn - 1) // 5 AS gid, string_agg(CAST(event_id AS VARCHAR), ',' ORDER BY rn) AS members,
             count(*) AS n FROM r GROUP BY event_type, (rn - 1) // 5 HAVING count(*) = 5)
SELECT CAST(c.gid AS BIGINT) AS gid, c.members AS click_members, v.members AS view_members
FROM g c JOIN g v ON c.gid = v.gid AND c.event_type = 'click' AND v.event_type = 'view'
"""

_UNION_SQL = """
SELECT 0 AS query_pos, '/events/click/' || event_id AS lfn FROM events WHERE event_type = 'click'
UNION ALL SELECT 1, '/events/view/' || event_id FROM events WHERE event_type = 'view'
UNION ALL SELECT 2, '/events/click/' || event_id FROM events WHERE event_type = 'click'
UNION ALL SELECT 3, '/events/' || event_type || '/' || event_id FROM events WHERE event_type LIKE 's%'
"""

_PATTERNS_SQL = """
WITH u AS (SELECT DISTINCT user_id FROM events),
e AS (SELECT user_id AS own, event_type, '/events/' || event_type || '/' || user_id || '/' || event_id AS lfn FROM events)
SELECT user_id, 'any' AS kind, 'lfn:/events/*/' || user_id AS pattern, lfn FROM u JOIN e ON own = user_id
UNION ALL SELECT user_id, 'one', '/events/c[kl-n]ic?/' || user_id, lfn FROM u JOIN e ON own = user_id AND event_type = 'click'
UNION ALL SELECT user_id, 'not', '/events/[!a-r]i*/' || user_id, lfn FROM u JOIN e ON own = user_id AND event_type IN ('view', 'signup')
UNION ALL SELECT user_id, 'below', '/events/view/' || user_id || '?', lfn
          FROM u JOIN e ON own // 10 = user_id AND own >= 10 AND event_type = 'view'
UNION ALL SELECT user_id, 'plain', '/events/signup/' || user_id || '/', lfn FROM u JOIN e ON own = user_id AND event_type = 'signup'
UNION ALL SELECT user_id, 'root', '/*/error/' || user_id, lfn FROM u JOIN e ON own = user_id AND event_type = 'error'
"""

QUERIES = {
    "find_files_bucketed_lineitem": (find_files_bucketed_lineitem, _FIND_SQL),
    "upsert_bucketed_orders": (upsert_bucketed_orders, _BUCKETED_SQL),
    "catalog_changes_orders": (catalog_changes_orders, _CHANGES_SQL),
    "snapshot_changes_orders": (snapshot_changes_orders, _SNAPSHOT_CHANGES_SQL),
    "match_pattern_table_events": (match_pattern_table_events, _PATTERNS_SQL),
    "transformation_jobs": (transformation_jobs, _FLAGSHIP_SQL),
    "catalog_match_lineitem": (catalog_match_lineitem, _MATCH_SQL),
    "catalog_snapshot_lineitem": (catalog_snapshot_lineitem, _SNAPSHOT_SQL),
    "catalog_import_lineitem": (catalog_import_lineitem, _IMPORT_SQL),
    "find_files_lineitem": (find_files_lineitem, _FIND_SQL),
    "add_entries_orders": (add_entries_orders, _ADD_SQL),
    "upsert_orders": (upsert_orders, _UPSERT_SQL),
    "fixed_groups_events": (fixed_groups_events, _GROUPS_SQL),
    "group_limit_events": (group_limit_events, _LIMIT_SQL),
    "zip_groups_events": (zip_groups_events, _ZIP_SQL),
    "union_queries_events": (union_queries_events, _UNION_SQL),
}
