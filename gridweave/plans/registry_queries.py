"""Registry, file-reference, validation and hook queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from gridweave.functions.text import md5_text, rot13
from gridweave.operators.hooks import post_command, pre_command, run_hooks
from gridweave.operators.refs import (
    catalog_refs_by_input,
    local_refs,
    reference_errors,
    rewrite_inputs,
    sandbox_manifest,
    staged_inputs,
)
from gridweave.operators.grouping import rank_within, union_queries
from gridweave.operators.plugin_fields import validate_plugin_fields
from gridweave.operators.registry import (
    list_organizations,
    list_plugins,
    lookup_with_fallback,
    register,
    registry_summary,
    registry_tables,
)
from gridweave.operators.validate import check, unknown_key, validate_descriptors, wrong_type
from gridweave.plans.inputs import lineitem_dir, lineitem_name
from gridweave.plans.tables import table
from gridweave.session import kept_result, scratch_dir
from gridweave.sources.catalog import catalog_from_parts, list_files
from gridweave.sources.params import read_parameters
from gridweave.sources.files import write_group_files
from gridweave.sources.sinks import merge_text_outputs, write_with_fallback

# Fixed values of the stand-ins: the plugin keys the validation knows (one per language).
KNOWN_PLUGINS = ["en", "de", "fr"]
# Conversations whose turns make up the text output of one job, and one parameter document.
JOB_CONVERSATIONS = 50
PARAMETER_CONVERSATIONS = 20


def _plugin_entries(spark, sf):
    s, n, r = table(spark, sf, "supplier"), table(spark, sf, "nation"), table(spark, sf, "region")
    j = s.join(n, s["s_nationkey"] == n["n_nationkey"]).join(r, F.col("n_regionkey") == r["r_regionkey"])
    return j.select(F.col("n_name").alias("key"), F.when(F.col("s_acctbal") > 0, F.col("r_name")).alias("vo"),
                    F.col("s_name").alias("description"), F.col("s_suppkey").alias("seq"))


def register_plugins_suppliers(spark, sf):
    """Every supplier registers a plugin named after its nation; without override only the first
    registration of a name is accepted."""
    out = register(_plugin_entries(spark, sf), override=False)
    return out.select("key", "seq", "status", "message")


def _customer_wants(spark, sf):
    c, n, r = table(spark, sf, "customer"), table(spark, sf, "nation"), table(spark, sf, "region")
    return c.join(n, c["c_nationkey"] == n["n_nationkey"]).join(r, F.col("n_regionkey") == r["r_regionkey"]) \
        .select("c_custkey", F.col("n_name").alias("key"), F.col("r_name").alias("vo"))


def lookup_registry_customers(spark, sf):
    """Each customer asks for its nation's plugin within its region's VO; VO entry first, then
    the global one (last registration wins)."""
    glob, per_vo = registry_tables(_plugin_entries(spark, sf), override=True)
    return lookup_with_fallback(_customer_wants(spark, sf), glob, per_vo).select("c_custkey", "key", "vo", "found", "scope")


def lookup_first_registration_customers(spark, sf):
    """The same look-up where a second registration of a name is refused: a refused entry is found
    neither through its VO nor globally."""
    glob, per_vo = registry_tables(_plugin_entries(spark, sf), override=False)
    return lookup_with_fallback(_customer_wants(spark, sf), glob, per_vo).select("c_custkey", "key", "vo", "found", "scope")


def registry_summary_suppliers(spark, sf):
    """Plugins per VO (a VO keeps a name that another VO registers later) and in all."""
    return registry_summary(*registry_tables(_plugin_entries(spark, sf), override=True)).select("vo", "n_plugins")


def list_plugins_suppliers(spark, sf):
    """Every VO that has plugins with each of its plugin names, and the names an unknown VO gets."""
    glob, per_vo = registry_tables(_plugin_entries(spark, sf), override=True)
    vos = list_organizations(per_vo)
    own = per_vo.join(vos, "vo", "left_semi").select("vo", "key")
    return own.unionByName(list_plugins(glob, per_vo, "UNKNOWN").select(F.lit("UNKNOWN").alias("vo"), "key"))


def _line_refs(spark, sf):
    """Lines as file references of their order's job: catalog location for returnflag N, local
    path for A, neither for R."""
    li = table(spark, sf, "lineitem")
    lfn = F.concat(lineitem_dir(), F.lit("/"), lineitem_name())
    return li.select(F.col("l_orderkey").alias("job_id"), F.lit("input-data").alias("input_name"),
                     F.col("l_linenumber").alias("pos"), lineitem_name().alias("ref_id"),
                     F.when(F.col("l_returnflag") == "N", F.concat(F.lit("lfn:"), lfn)).alias("location"),
                     F.when(F.col("l_returnflag") == "A", F.concat(F.lit("file://"), lfn)).alias("path"),
                     F.lit(True).alias("is_list"))


def catalog_refs_lineitem(spark, sf):
    g = catalog_refs_by_input(_line_refs(spark, sf))
    return g.select("job_id", "input_name", F.size("lfns").cast("long").alias("n_lfns"),
                    F.array_join("lfns", ", ").alias("lfns"))


def local_refs_lineitem(spark, sf):
    return local_refs(_line_refs(spark, sf)).select("job_id", "ref_id", "local_path")


def reference_errors_lineitem(spark, sf):
    return reference_errors(_line_refs(spark, sf)).select("job_id", "ref_id", "error")


def rewrite_inputs_lineitem(spark, sf):
    """Stage every order's catalog references against a catalog of the finished lines."""
    li = table(spark, sf, "lineitem")
    catalog = catalog_from_parts(li.filter(F.col("l_linestatus") == "F"), lineitem_dir(), lineitem_name())
    _, jobs = rewrite_inputs(_line_refs(spark, sf), catalog)
    return jobs.select("job_id", "n_catalog", "n_staged", "failed")


def staged_inputs_lineitem(spark, sf):
    """What every job input becomes: found catalog files as local names, all other references as
    they were, lists as lists and the inputs of order status P as single files."""
    li, o = table(spark, sf, "lineitem"), table(spark, sf, "orders")
    catalog = catalog_from_parts(li.filter(F.col("l_linestatus") == "F"), lineitem_dir(), lineitem_name())
    lfn = F.concat(lineitem_dir(), F.lit("/"), lineitem_name())
    refs = li.join(o, li["l_orderkey"] == o["o_orderkey"], "left").select(
        F.col("l_orderkey").alias("job_id"), F.concat(F.lit("input-"), F.col("l_returnflag")).alias("input_name"),
        lineitem_name().alias("pos"),
        F.when(F.col("l_returnflag") == "N", F.concat(F.lit("lfn:"), lfn))
         .when(F.col("l_returnflag") == "R", F.concat(F.lit("file://"), lfn)).alias("location"),
        F.when(F.col("l_returnflag") == "A", lfn).alias("path"),
        (F.coalesce("o_orderstatus", F.lit("")) != "P").alias("is_list"))
    rows, _ = rewrite_inputs(refs, catalog)
    files = F.transform("files", lambda f: F.concat_ws("|", F.coalesce(f["location"], F.lit("-")), F.coalesce(f["path"], F.lit("-"))))
    return staged_inputs(rows).select("job_id", "input_name", "is_list", F.array_join(files, ", ").alias("files"))


def _doc_files(spark, sf):
    d, lab = table(spark, sf, "documents"), table(spark, sf, "labels")
    j = d.join(lab, "doc_id", "left")
    name = F.when(F.coalesce(F.col("toxic"), F.lit(0)) == 1, F.lit("")).otherwise(
        F.concat(F.lit("/docs/"), F.col("source"), F.lit("/doc_"), F.col("doc_id").cast("string"), F.lit(".txt")))
    return j.select(F.col("source").alias("job_id"), F.col("doc_id").alias("pos"), name.alias("name"))


def sandbox_manifest_documents(spark, sf):
    """Documents of a source packed by doc id; the list stops at the first toxic document."""
    manifest, _ = sandbox_manifest(_doc_files(spark, sf))
    return manifest.select(F.col("job_id").alias("source"), F.col("pos").alias("doc_id"), "member")


def sandbox_summary_documents(spark, sf):
    _, summary = sandbox_manifest(_doc_files(spark, sf))
    return summary.select(F.col("job_id").alias("source"), "n_files", "sandbox_id")


def validate_documents(spark, sf):
    """Documents as descriptors: the language names the plugin, the label must exist, the source
    must be an integer."""
    d, lab = table(spark, sf, "documents"), table(spark, sf, "labels")
    known = spark.createDataFrame([(k,) for k in KNOWN_PLUGINS], "key string")
    j = unknown_key(d.join(lab, "doc_id", "left"), known, "lang")
    rules = [
        (F.col("_unknown_lang"), F.concat(F.lit("Unknown plugin: "), F.col("lang"))),
        (F.col("quality").isNull(), F.lit("missing field: quality")),
        (wrong_type("source", "int"), F.concat(F.lit("wrong type for source: "), F.col("source"))),
    ]
    out = check(j, rules)
    return out.select("doc_id", F.array_join("errors", "; ").alias("errors"), "valid")


def validate_descriptors_documents(spark, sf):
    """Documents as descriptors of submissions: plugin from the language, class from the label,
    scheduling key and group size from the source."""
    d, lab = table(spark, sf, "documents"), table(spark, sf, "labels")
    known = spark.createDataFrame([(k,) for k in KNOWN_PLUGINS], "key string")
    number = F.regexp_extract("source", r"(\d+)$", 1)
    odd = F.col("doc_id") % 2 == 1
    t = d.join(lab, "doc_id", "left").select(
        "doc_id", F.when(F.col("quality") == 0, F.lit("Operation")).otherwise(F.lit("CommandLineTool")).alias("task_class"),
        F.col("lang").alias("hook_plugin"),
        F.create_map(F.when(F.coalesce("toxic", F.lit(0)) == 1, F.lit("owner")).otherwise(F.lit("priority")), number).alias("scheduling"),
        F.create_map(F.lit("input-data"), F.when(odd, F.col("source")).otherwise(number)).alias("group_size"))
    out = validate_descriptors(t, known, kind="production")
    return out.select("doc_id", F.array_join("errors", "; ").alias("errors"), "valid")


# Fixed values of the stand-in: the fields of the known plugins (plugin, field, type, required).
PLUGIN_FIELDS = [(p, *f) for p in KNOWN_PLUGINS for f in (
    ("campaign", "str", True), ("events", "int", True), ("input", "File", True), ("sandbox", "list[str]", False))]


def validate_plugin_fields_documents(spark, sf):
    """Documents as descriptors of the plugin named after their language: some without a campaign,
    with a number of events that is none, a file without a path, a sandbox that is no list, an owner
    that the plugin does not know, and some that are no objects."""
    d, lab = table(spark, sf, "documents"), table(spark, sf, "labels")
    j, n = d.join(lab, "doc_id", "left"), F.col("doc_id")

    def field(name, value):
        return F.concat(F.lit(f'"{name}": '), value)

    def quoted(c):
        return F.concat(F.lit('"'), c.cast("string"), F.lit('"'))

    path = F.when(F.col("quality") == 0, F.lit("")).otherwise(F.concat(F.lit("/docs/"), n.cast("string")))
    fields = F.concat_ws(
        ", ", F.when(n % 5 != 0, field("campaign", quoted(n))),
        field("events", F.when(n % 3 == 0, n.cast("string")).when(n % 3 == 1, quoted(n)).otherwise(F.lit('"many"'))),
        field("input", F.concat(F.lit('{"class": "File", "path": '), quoted(path), F.lit("}"))),
        field("sandbox", F.when(n % 7 == 0, quoted(n)).otherwise(F.concat(F.lit("["), quoted(n), F.lit("]")))),
        F.when(F.coalesce("toxic", F.lit(0)) == 1, field("owner", F.lit("1"))))
    json = F.when(n % 11 == 0, F.concat(F.lit("["), n.cast("string"), F.lit("]"))).otherwise(
        F.concat(F.lit("{"), fields, F.lit("}")))
    rules = spark.createDataFrame(PLUGIN_FIELDS, "plugin string, field string, type string, required boolean")
    out = validate_plugin_fields(j.select("doc_id", F.col("lang").alias("hook_plugin"), json.alias("descriptor")), rules)
    return out.select("doc_id", F.array_join("errors", "; ").alias("errors"), "valid")


def _conversation_outputs(spark, sf, root: str) -> None:
    """Write the turns of every JOB_CONVERSATIONS conversations as the files of one job folder: user
    turns as ``.out``, all others as ``.txt``."""
    conv = table(spark, sf, "conversations")
    job = F.floor(F.col("conv_id") / JOB_CONVERSATIONS)
    for kind, own in (("out", F.col("role") == "user"), ("txt", ~F.coalesce(F.col("role") == "user", F.lit(False)))):
        rows = conv.filter(own).select(job.alias("job"), "conv_id", "turn", F.coalesce("text", F.lit("")).alias("text"))
        (rows.repartition("job").sortWithinPartitions("job", "conv_id", "turn").select("job", "text")
             .write.partitionBy("job").option("lineSep", "\n").text(f"{root}/{kind}"))


def read_parameters_conversations(spark, sf):
    """The turns of every PARAMETER_CONVERSATIONS conversations written as one JSON parameter
    document, read back as one row per parameter."""
    conv = table(spark, sf, "conversations")
    key = F.concat(F.lit("turn-"), F.col("conv_id").cast("string"), F.lit("-"), F.col("turn").cast("string"))
    doc = F.floor(F.col("conv_id") / PARAMETER_CONVERSATIONS)
    docs = conv.groupBy(doc.alias("doc")).agg(F.to_json(F.map_from_entries(F.collect_list(F.struct(key, "text")))).alias("value"))
    with scratch_dir(spark, "params") as root:
        docs.repartition("doc").write.partitionBy("doc").text(root)
        params = read_parameters(spark, root)
        return kept_result(params.select(F.regexp_extract("source", r"/doc=(\d+)/", 1).cast("long").alias("doc"), "key", "value"))


def write_with_fallback_orders(spark, sf):
    """An order summary stored on the first storage element that accepts it: the first one
    already holds data and refuses the write, so it lands on the second; read back from there."""
    o = table(spark, sf, "orders")
    summary = o.groupBy("o_orderstatus").agg(F.count(F.lit(1)).alias("n_orders"),
                                             F.round(F.sum("o_totalprice"), 2).alias("total_price"))
    with scratch_dir(spark, "storage") as base:
        targets = [f"{base}/SE-1", f"{base}/SE-2"]
        summary.limit(1).write.parquet(targets[0])
        used = write_with_fallback(summary, targets)
        return kept_result(spark.read.parquet(used).withColumn("stored_on", F.lit(used.rpartition("/")[2])))


def list_files_conversations(spark, sf):
    """The job output tree listed as a catalog (file contents never read): bytes per job folder."""
    with scratch_dir(spark, "job-outputs") as root:
        _conversation_outputs(spark, sf, root)
        cat = list_files(spark, root)
        job = F.regexp_extract("dir", r"/job=(\d+)$", 1).cast("long")
        return kept_result(cat.groupBy(job.alias("job")).agg(F.countDistinct("dir").alias("n_dirs"),
                                                             F.sum("length").alias("n_bytes")))


def merge_text_outputs_conversations(spark, sf):
    """The merged output of every job folder, line by line: each file's header, its lines numbered
    in order, and the empty line behind it (user turns in ``.out`` files, all others in ``.txt``)."""
    with scratch_dir(spark, "job-outputs") as root:
        _conversation_outputs(spark, sf, root)
        merged = [merge_text_outputs(spark, f"{root}/{kind}").withColumn("kind", F.lit(kind)) for kind in ("out", "txt")]
        lines = union_queries(*merged)
        place = F.struct("rank", "file", "block", "line")
        ranked = rank_within(lines.withColumn("place", place), ["kind", "job"], "place")
        value = F.when(F.col("block") < 0, F.substring_index("value", " ", 1)).otherwise(F.col("value"))
        return kept_result(ranked.select("kind", F.regexp_extract("job", r"^job=(.*)$", 1).cast("long").alias("job"),
                                         F.col("rn").alias("line_no"), value.alias("value")))


def group_files_conversations(spark, sf):
    """The merged output of every job folder as one file each, read back whole: lines and digest of what
    follows the first header (which names a scratch folder)."""
    with scratch_dir(spark, "job-outputs") as root:
        _conversation_outputs(spark, sf, root)
        for kind in ("out", "txt"):
            write_group_files(merge_text_outputs(spark, f"{root}/{kind}"), f"{root}/merged/{kind}")
        files = spark.read.option("recursiveFileLookup", "true").text(f"{root}/merged", wholetext=True)
        place = F.regexp_extract_all(F.col("_metadata.file_path"), F.lit(r"/merged/(\w+)/job(?:=|%3D)(\d+)/group\.out$"), F.lit(0))[0]
        body = F.substring("value", F.locate("\n", F.col("value")) + F.lit(1), F.length("value"))
        rows = files.select(F.split(place, "/")[2].alias("kind"), F.regexp_extract(place, r"(\d+)/group", 1).cast("long").alias("job"),
                            body.alias("body"))
        return kept_result(rows.select("kind", "job", (F.size(F.split("body", "\n")) - 1).cast("long").alias("n_lines"),
                                       F.md5("body").alias("digest")))


def run_hooks_documents(spark, sf):
    """Pre-processing ROT13 of every document, post-processing digest."""
    d = table(spark, sf, "documents").select("doc_id", "text")
    pre = pre_command(lambda df: df.withColumn("text", rot13("text")), "Rot13")
    post = post_command(lambda df: df.select("doc_id", md5_text("text").alias("digest")), "Digest")
    return run_hooks(run_hooks(d, "pre", [pre]), "post", [post])


_ENTRIES_SQL = """e AS (SELECT n_name AS key, CASE WHEN s_acctbal > 0 THEN r_name END AS vo, s_name AS description,
                 s_suppkey AS seq
          FROM supplier JOIN nation ON s_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey)"""

_REGISTER_SQL = "WITH " + _ENTRIES_SQL + """,
f AS (SELECT key, min(seq) AS first FROM e GROUP BY key)
SELECT e.key, e.seq, CASE WHEN e.seq = f.first THEN 'added' ELSE 'rejected' END AS status,
       CASE WHEN e.seq = f.first THEN NULL ELSE 'Plugin ' || e.key || ' already exists' END AS message
FROM e JOIN f ON e.key = f.key
"""

_WANTS_SQL = """w AS (SELECT c_custkey, n_name AS key, r_name AS vo
      FROM customer JOIN nation ON c_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey)
SELECT w.c_custkey, w.key, w.vo, CASE WHEN v.key IS NOT NULL THEN v.d ELSE g.d END AS found,
       CASE WHEN v.key IS NOT NULL THEN 'vo' WHEN g.key IS NOT NULL THEN 'global' END AS scope
FROM w LEFT JOIN v ON w.vo = v.vo AND w.key = v.key LEFT JOIN g ON w.key = g.key
"""

_LOOKUP_SQL = "WITH " + _ENTRIES_SQL + """,
g AS (SELECT key, arg_max(description, seq) AS d FROM e GROUP BY key),
v AS (SELECT vo, key, arg_max(description, seq) AS d FROM e WHERE vo IS NOT NULL GROUP BY vo, key),
""" + _WANTS_SQL

_LOOKUP_FIRST_SQL = "WITH " + _ENTRIES_SQL + """,
g AS (SELECT key, arg_min(description, seq) AS d FROM e GROUP BY key),
v AS (SELECT vo, key, description AS d FROM e WHERE vo IS NOT NULL
      AND NOT EXISTS (SELECT 1 FROM e AS earlier WHERE earlier.key = e.key AND earlier.seq < e.seq)),
""" + _WANTS_SQL

_SUMMARY_SQL = "WITH " + _ENTRIES_SQL + """
SELECT vo, count(DISTINCT key) AS n_plugins FROM e WHERE vo IS NOT NULL GROUP BY vo
UNION ALL SELECT NULL, count(DISTINCT key) FROM e
"""

_LIST_PLUGINS_SQL = "WITH " + _ENTRIES_SQL + """
SELECT DISTINCT vo, key FROM e WHERE vo IS NOT NULL
UNION ALL SELECT DISTINCT 'UNKNOWN', key FROM e
"""

_LFN_SQL = """'/grid/data/' || l_returnflag || '/' || l_linestatus || '/' || CAST(year(l_shipdate) AS VARCHAR) || '/'
   || l_orderkey || '_' || l_linenumber || '_' || l_partkey || '_' || l_suppkey || '.sim'"""
_NAME_SQL = "l_orderkey || '_' || l_linenumber || '_' || l_partkey || '_' || l_suppkey || '.sim'"

_CAT_REFS_SQL = f"""
SELECT l_orderkey AS job_id, 'input-data' AS input_name,
       count(*) FILTER (WHERE l_returnflag = 'N') AS n_lfns,
       coalesce(string_agg('lfn:' || {_LFN_SQL}, ', ' ORDER BY l_linenumber, 'lfn:' || {_LFN_SQL})
                FILTER (WHERE l_returnflag = 'N'), '') AS lfns
FROM lineitem GROUP BY l_orderkey
"""

_LOCAL_SQL = f"""
SELECT l_orderkey AS job_id, {_NAME_SQL} AS ref_id, {_LFN_SQL} AS local_path FROM lineitem WHERE l_returnflag = 'A'
"""

_REF_ERR_SQL = f"""
SELECT l_orderkey AS job_id, {_NAME_SQL} AS ref_id, 'File location is not defined.' AS error
FROM lineitem WHERE l_returnflag = 'R'
"""

_REWRITE_SQL = f"""
WITH c AS (SELECT DISTINCT {_LFN_SQL} AS k FROM lineitem WHERE l_linestatus = 'F'),
r AS (SELECT l_orderkey AS job_id, l_returnflag, {_LFN_SQL} AS k FROM lineitem)
SELECT job_id, count(*) FILTER (WHERE l_returnflag = 'N') AS n_catalog,
       count(*) FILTER (WHERE l_returnflag = 'N' AND c.k IS NOT NULL) AS n_staged,
       coalesce(bool_or(l_returnflag = 'N' AND c.k IS NULL), false) AS failed
FROM r LEFT JOIN c ON r.k = c.k GROUP BY job_id
"""

_DOC_FILES_SQL = """f AS (SELECT source AS job_id, doc_id AS pos,
                  CASE WHEN coalesce(toxic, 0) = 1 THEN '' ELSE '/docs/' || source || '/doc_' || doc_id || '.txt' END AS name
           FROM documents LEFT JOIN labels USING (doc_id)),
cut AS (SELECT job_id, min(pos) FILTER (WHERE name = '') AS c FROM f GROUP BY job_id),
kept AS (SELECT f.job_id, f.pos, list_extract(string_split(f.name, '/'), -1) AS member
         FROM f JOIN cut USING (job_id) WHERE cut.c IS NULL OR f.pos < cut.c)"""

_MANIFEST_SQL = "WITH " + _DOC_FILES_SQL + "\nSELECT job_id AS source, pos AS doc_id, member FROM kept"
_SB_SUMMARY_SQL = "WITH " + _DOC_FILES_SQL + """,
h AS (SELECT job_id, sha256(member) AS h FROM kept),
n AS (SELECT job_id, count(*) AS n_files, sum(CAST('0x' || substr(h, 1, 15) AS HUGEINT)) AS a,
             sum(CAST('0x' || substr(h, 16, 15) AS HUGEINT)) AS b FROM h GROUP BY job_id),
j AS (SELECT DISTINCT job_id FROM f)
SELECT j.job_id AS source, coalesce(n_files, 0) AS n_files,
       'sandbox_' || sha256(coalesce(n_files, 0) || ':' || coalesce(a, 0) || ':' || coalesce(b, 0)) AS sandbox_id
FROM j LEFT JOIN n USING (job_id)
"""

_VALIDATE_SQL = """
SELECT doc_id,
  concat_ws('; ',
    CASE WHEN lang NOT IN ('en', 'de', 'fr') THEN 'Unknown plugin: ' || lang END,
    CASE WHEN quality IS NULL THEN 'missing field: quality' END,
    CASE WHEN source IS NOT NULL AND TRY_CAST(source AS INTEGER) IS NULL THEN 'wrong type for source: ' || source END
  ) AS errors,
  (lang IN ('en', 'de', 'fr') AND quality IS NOT NULL AND (source IS NULL OR TRY_CAST(source AS INTEGER) IS NOT NULL)) AS valid
FROM documents LEFT JOIN labels USING (doc_id)
"""

_HOOKS_SQL = """
SELECT doc_id, md5(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz',
                                   'NOPQRSTUVWXYZABCDEFGHIJKLMnopqrstuvwxyzabcdefghijklm')) AS digest
FROM documents
"""

_OUTPUT_LINES = """t AS (SELECT CASE WHEN role = 'user' THEN 'out' ELSE 'txt' END AS kind, conv_id // 50 AS job,
              coalesce(text, '') AS text FROM conversations)"""

_LIST_SQL = f"""WITH {_OUTPUT_LINES}
SELECT CAST(job AS BIGINT) AS job, count(DISTINCT kind) AS n_dirs, CAST(sum(strlen(text) + 1) AS BIGINT) AS n_bytes
FROM t GROUP BY job
"""

_MERGE_SQL = """
WITH t AS (SELECT CASE WHEN role = 'user' THEN 'out' ELSE 'txt' END AS kind, conv_id // 50 AS job, conv_id, turn,
                  string_split(coalesce(text, ''), chr(10)) AS ls FROM conversations),
l AS (SELECT kind, job, conv_id, turn, unnest(range(1, len(ls) + 1)) AS i, unnest(ls) AS value FROM t),
n AS (SELECT kind, job, 1 + row_number() OVER (PARTITION BY kind, job ORDER BY conv_id, turn, i) AS line_no, value FROM l)
SELECT kind, CAST(job AS BIGINT) AS job, CAST(line_no AS BIGINT) AS line_no, value FROM n
UNION ALL SELECT DISTINCT kind, job, 1, '############' FROM n
UNION ALL SELECT kind, job, max(line_no) + 1, '' FROM n GROUP BY kind, job
"""

_GROUP_FILES_SQL = """
WITH t AS (SELECT CASE WHEN role = 'user' THEN 'out' ELSE 'txt' END AS kind, conv_id // 50 AS job,
                  string_agg(coalesce(text, '') || chr(10), '' ORDER BY conv_id, turn) || chr(10) AS body FROM conversations GROUP BY ALL)
SELECT kind, CAST(job AS BIGINT) AS job, CAST(length(body) - length(replace(body, chr(10), '')) AS BIGINT) AS n_lines,
       md5(body) AS digest FROM t
"""

_PARAMS_SQL = """
SELECT conv_id // 20 AS doc, 'turn-' || conv_id || '-' || turn AS key, text AS value FROM conversations
"""

_STAGED_SQL = f"""
WITH c AS (SELECT DISTINCT {_LFN_SQL} AS k FROM lineitem WHERE l_linestatus = 'F'),
r AS (SELECT l_orderkey AS job_id, 'input-' || l_returnflag AS input_name, {_NAME_SQL} AS pos, l_returnflag AS f,
             {_LFN_SQL} AS lfn, coalesce(o_orderstatus, '') <> 'P' AS is_list
      FROM lineitem LEFT JOIN orders ON l_orderkey = o_orderkey)
SELECT job_id, input_name, is_list,
       string_agg(CASE WHEN f = 'N' AND c.k IS NOT NULL THEN '-|' || pos WHEN f = 'N' THEN 'lfn:' || lfn || '|-'
                       WHEN f = 'R' THEN 'file://' || lfn || '|-' ELSE '-|' || lfn END, ', ' ORDER BY pos) AS files
FROM r LEFT JOIN c ON r.lfn = c.k GROUP BY job_id, input_name, is_list
"""

_DESCRIPTORS_SQL = r"""
WITH t AS (SELECT doc_id, lang, source, regexp_extract(source, '(\d+)$', 1) AS number, quality, coalesce(toxic, 0) AS toxic
           FROM documents LEFT JOIN labels USING (doc_id)),
e AS (SELECT doc_id, concat_ws('; ',
    CASE WHEN quality = 0 THEN 'task is not a CommandLineTool, Workflow or ExpressionTool: Operation' END,
    CASE WHEN coalesce(lang, 'QueryBasedPlugin') NOT IN ('en', 'de', 'fr')
         THEN 'Unknown execution hooks plugin: ' || coalesce(lang, 'QueryBasedPlugin') END,
    CASE WHEN toxic = 1 THEN 'unknown scheduling keys: owner' END,
    CASE WHEN TRY_CAST(CASE WHEN doc_id % 2 = 1 THEN source ELSE number END AS INTEGER) IS NULL
         THEN 'group_size is not an integer for: input-data' END,
    'a production must be a Workflow') AS errors FROM t)
SELECT doc_id, errors, errors = '' AS valid FROM e
"""

_PLUGIN_FIELDS_SQL = """
WITH t AS (SELECT doc_id, coalesce(nullif(lang, ''), 'QueryBasedPlugin') AS plugin, quality, coalesce(toxic, 0) AS toxic
           FROM documents LEFT JOIN labels USING (doc_id)),
e AS (SELECT doc_id, CASE
    WHEN plugin NOT IN ('en', 'de', 'fr') THEN 'Unknown execution hooks plugin: ' || plugin
    WHEN doc_id % 11 = 0 THEN 'descriptor is not a JSON object'
    ELSE concat_ws('; ',
        CASE WHEN doc_id % 5 = 0 THEN 'missing field: campaign' END,
        CASE WHEN doc_id % 3 = 2 THEN 'wrong type for events: not int' END,
        CASE WHEN quality = 0 THEN 'wrong type for input: not File' END,
        CASE WHEN doc_id % 7 = 0 THEN 'wrong type for sandbox: not list[str]' END,
        CASE WHEN toxic = 1 THEN 'unexpected field: owner' END) END AS errors FROM t)
SELECT doc_id, errors, errors = '' AS valid FROM e
"""

_FALLBACK_SQL = """
SELECT o_orderstatus, count(*) AS n_orders, round(sum(o_totalprice), 2) AS total_price, 'SE-2' AS stored_on
FROM orders GROUP BY o_orderstatus
"""

QUERIES = {
    "write_with_fallback_orders": (write_with_fallback_orders, _FALLBACK_SQL),
    "lookup_first_registration_customers": (lookup_first_registration_customers, _LOOKUP_FIRST_SQL),
    "list_plugins_suppliers": (list_plugins_suppliers, _LIST_PLUGINS_SQL),
    "staged_inputs_lineitem": (staged_inputs_lineitem, _STAGED_SQL),
    "validate_descriptors_documents": (validate_descriptors_documents, _DESCRIPTORS_SQL),
    "validate_plugin_fields_documents": (validate_plugin_fields_documents, _PLUGIN_FIELDS_SQL),
    "read_parameters_conversations": (read_parameters_conversations, _PARAMS_SQL),
    "list_files_conversations": (list_files_conversations, _LIST_SQL),
    "group_files_conversations": (group_files_conversations, _GROUP_FILES_SQL),
    "merge_text_outputs_conversations": (merge_text_outputs_conversations, _MERGE_SQL),
    "register_plugins_suppliers": (register_plugins_suppliers, _REGISTER_SQL),
    "lookup_registry_customers": (lookup_registry_customers, _LOOKUP_SQL),
    "registry_summary_suppliers": (registry_summary_suppliers, _SUMMARY_SQL),
    "catalog_refs_lineitem": (catalog_refs_lineitem, _CAT_REFS_SQL),
    "local_refs_lineitem": (local_refs_lineitem, _LOCAL_SQL),
    "reference_errors_lineitem": (reference_errors_lineitem, _REF_ERR_SQL),
    "rewrite_inputs_lineitem": (rewrite_inputs_lineitem, _REWRITE_SQL),
    "sandbox_manifest_documents": (sandbox_manifest_documents, _MANIFEST_SQL),
    "sandbox_summary_documents": (sandbox_summary_documents, _SB_SUMMARY_SQL),
    "validate_documents": (validate_documents, _VALIDATE_SQL),
    "run_hooks_documents": (run_hooks_documents, _HOOKS_SQL),
}
