"""Whole flows in one plan each: storing outputs, a production, a submission."""

from __future__ import annotations

from pyspark.sql import functions as F

from gridweave.functions.lfn import LFN_PREFIX_UPPER
from gridweave.operators.catalog import match_query
from gridweave.operators.grouping import fixed_groups, zip_groups
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
)
from gridweave.operators.outputs import parse_outputs, route_outputs, store_and_register
from gridweave.operators.validate import split_valid, validate_descriptors
from gridweave.plans.catalog_queries import _CAT
from gridweave.plans.inputs import QUERY_ROOT, lineitem_catalog, lineitem_tasks
from gridweave.plans.output_queries import _jobs, _parse_sql
from gridweave.plans.tables import table
from gridweave.sources.catalog import catalog_from_lfns


# --- outputs ----------------------------------------------------------------------------------

def _stored_events(spark, sf):
    """Outputs of the successful events: parsed, routed to the user's folder, stored on the first
    of two elements that takes them, entered into a catalog that holds some users' click files."""
    ok, _ = succeeded(_jobs(spark, sf))
    outs = parse_outputs(ok, ["job_id"])
    uid = F.col("user_id").cast("string")
    paths = ok.select("job_id", F.explode(F.array(F.lit("result"), F.lit("data"))).alias("output_name"),
                      F.concat(F.lit("lfn:/store/"), uid).alias("lfn"))
    routed = route_outputs(outs, paths, ok.select("job_id", F.lit("none").alias("output_name")), ["job_id"])
    place = F.col("job_id") * 10 + F.col("pos") + F.when(F.col("output_name") == "data", 5).otherwise(0)
    keys = ["job_id", "output_name", "pos"]
    files = routed.filter("to_catalog").select(*keys, F.col("target").alias("lfn"), place.alias("seq"))
    tried = table(spark, sf, "events").select(F.col("event_id").alias("job_id"), F.inline(F.array(
        F.struct(F.lit(0).alias("at"), F.lit("SE-USER").alias("se"), (F.col("value") > 30).alias("ok"),
                 F.lit("SE-USER refused").alias("message")),
        F.struct(F.lit(1).alias("at"), F.lit("SE-TAPE").alias("se"), (F.col("value") > 10).alias("ok"),
                 F.lit("SE-TAPE refused").alias("message")))))
    attempts = files.select(*keys).join(tried, "job_id").filter(F.col("job_id") % 7 != 0)
    there = table(spark, sf, "events").filter(F.col("user_id") % 3 == 0).select(
        F.concat(F.lit("/store/"), uid, F.lit("/click.txt")).alias("lfn")).distinct()
    return store_and_register(files, attempts, catalog_from_lfns(there), keys, pos="at")


def store_and_register_events(spark, sf):
    """Both outcomes, storage and catalog, of every output file (every seventh job has no attempt)."""
    report, _ = _stored_events(spark, sf)
    return report.select("job_id", "output_name", "pos", "lfn", "stored_se", "attempts", "storage", "storage_error", "entry",
                         "entry_error")


def catalog_after_store_events(spark, sf):
    """The catalog after all output files were entered."""
    _, catalog = _stored_events(spark, sf)
    return catalog.select("lfn", "dir", "name")


# --- a production -----------------------------------------------------------------------------

STEPS = ["F", "O"]


def production_lineitem(spark, sf):
    """One production per return flag with one step per line status: the steps take their group
    size from the workflow (``N``) or keep the tool's, each step's files are grouped per ship year
    and zipped into jobs, and the production succeeded when all its jobs did."""
    li = table(spark, sf, "lineitem")
    flags = li.select(F.col("l_returnflag").alias("production")).distinct()

    def step(status):
        return F.struct(
            F.lit(f"#main/{status}").alias("id"),
            F.array(F.struct(F.lit(f"#main/{status}/size").alias("id"), F.lit("#main/size").alias("source"))).alias("in"),
            F.struct(F.lit("CommandLineTool").alias("class"),
                     F.array(F.struct(F.lit(f"#{status}.cwl#size").alias("id"), F.lit("3").alias("default"))).alias("inputs")
                     ).alias("run"))

    given = F.when(F.col("production") == "N", F.array(F.struct(F.lit("#main/size").alias("id"), F.lit("4").alias("default"))))
    none = F.array().cast("array<struct<id:string,default:string>>")
    productions = flags.select("production", F.coalesce(given, none).alias("wf_inputs"),
                               F.array(*[step(s) for s in STEPS]).alias("steps"))
    sizes = step_defaults(explode_steps(productions, "production"), "wf_inputs", "production").select(
        "production", F.regexp_replace("step_id", "^#main/", "").alias("step"), F.col("default").cast("int").alias("size"))
    _, inputs = lineitem_tasks(spark, sf)
    inputs = inputs.select(F.col("campaign").alias("production"), F.col("site").alias("step"), "input_name", "input_pos")
    queries = inputs.join(sizes, ["production", "step"]).withColumn(
        "query", F.concat_ws("/", F.lit(QUERY_ROOT), "production", "step", "input_name"))
    files = match_query(lineitem_catalog(spark, sf), queries)
    groups = fixed_groups(files, ["production", "step", "input_name"], order="lfn", size="size")
    jobs = zip_groups(groups, inputs, ["production", "step"])
    ok = ~F.exists(F.flatten("inputs.members"), lambda m: m.endswith("13.sim"))
    results = jobs.select("production", "step", ok.alias("ok"))
    done = all_succeeded(results, ["production"], "ok", parents=flags)
    made = results.groupBy("production", "step").agg(F.count(F.lit(1)).alias("n_jobs"),
                                                     F.count(F.when(F.col("ok"), 1)).alias("n_ok"))
    return sizes.join(made, ["production", "step"], "left").join(done, "production").select(
        "production", "step", "size", F.coalesce("n_jobs", F.lit(0)).alias("n_jobs"),
        F.coalesce("n_ok", F.lit(0)).alias("n_ok"), "all_ok")


# --- a submission -----------------------------------------------------------------------------

SEGMENTS = ["AUTOMOBILE", "BUILDING", "FURNITURE", "MACHINERY"]


def submit_jobs_customers(spark, sf):
    """Customers as submissions, orders as their parameter sets: descriptors are checked, hints
    folded, parameters layered, sets expanded to jobs, references collected, texts rendered.  A
    rejected submission is one row with its errors."""
    c, o = table(spark, sf, "customer"), table(spark, sf, "orders")
    number = F.col("c_nationkey").cast("string")
    tasks = c.select(
        F.col("c_custkey").alias("task_id"), "c_acctbal", "c_mktsegment", "c_nationkey",
        F.when(F.col("c_acctbal") < -900, F.lit("Operation")).otherwise(F.lit("Workflow")).alias("task_class"),
        F.col("c_mktsegment").alias("hook_plugin"), F.create_map(F.lit("priority"), number).alias("scheduling"),
        F.create_map(F.lit("input-data"), number).alias("group_size"))
    known = spark.createDataFrame([(s,) for s in SEGMENTS], "key string")
    valid, rejected = split_valid(validate_descriptors(tasks, known))
    hints = valid.select("task_id", F.inline(F.array(
        F.struct(F.lit(0).alias("pos"), F.lit("scheduling").alias("class"), F.lit("priority").alias("key"),
                 F.lit(None).cast("string").alias("subkey"), F.col("scheduling")["priority"].alias("value")),
        F.struct(F.lit(1).alias("pos"), F.lit("scheduling").alias("class"), F.lit("platform").alias("key"),
                 F.lit(None).cast("string").alias("subkey"), F.col("c_mktsegment").alias("value")))))
    priority = fold_hints(hints).filter((F.col("class") == "scheduling") & (F.col("key") == "priority")).select(
        "task_id", F.col("value").cast("int").alias("priority"))

    def layer(key, value, cond=None):
        own = valid if cond is None else valid.filter(cond)
        return own.select("task_id", F.lit(key).alias("key"), F.lit(value).alias("value"), F.lit(0).alias("pos"))

    cores = resolve_parameters(layer("n-cores", "1"), layer("n-cores", "4", F.col("c_mktsegment") == "BUILDING"),
                               layer("n_cores", "8", F.col("c_acctbal") > 9000))
    cores = cores.filter(F.col("key") == "n_cores").select("task_id", F.col("value").cast("int").alias("cores"))
    params = o.select(F.col("o_custkey").alias("task_id"), F.col("o_orderkey").alias("param_seq"), F.array(
        F.concat(F.lit("lfn:/orders/"), F.col("o_orderkey").cast("string"), F.lit(".dat")),
        F.concat(F.lit("file:///local/"), F.col("o_orderkey").cast("string"))).alias("input_refs"))
    ready = valid.select("task_id").join(priority, "task_id", "left").join(cores, "task_id", "left")
    jobs = expand_jobs(ready, params).withColumn(
        "sandbox_id", F.concat(F.lit("SB:SandboxSE|/S3/sandbox-store/"), F.replace("job_id", F.lit(":"), F.lit("_")), F.lit(".tar.zst")))
    done = jobs.select("task_id", "job_id", render_job_text(jobs).alias("jdl"), F.lit("").alias("errors"))
    return done.unionByName(rejected.select("task_id", F.lit(None).cast("string").alias("job_id"),
                                            F.lit(None).cast("string").alias("jdl"), F.array_join("errors", "; ").alias("errors")))


_STORE = _parse_sql("WHERE event_type <> 'error'") + """,
f AS (SELECT p.job_id, p.output_name, p.pos, 'lfn:/store/' || s.user_id || '/' || list_extract(string_split(p.path, '/'), -1) AS lfn,
             p.job_id * 10 + p.pos + CASE WHEN p.output_name = 'data' THEN 5 ELSE 0 END AS seq
      FROM parsed p JOIN s ON s.job_id = p.job_id WHERE p.path IS NOT NULL AND p.output_name IN ('result', 'data')),
there AS (SELECT DISTINCT 'lfn:/store/' || user_id || '/click.txt' AS lfn FROM events WHERE user_id % 3 = 0),
e AS (SELECT f.*, seq = min(seq) OVER (PARTITION BY f.lfn) AND there.lfn IS NULL AS added FROM f LEFT JOIN there USING (lfn))"""

_STORE_SQL = "WITH " + _STORE + """
SELECT e.job_id, output_name, pos, e.lfn,
       CASE WHEN e.job_id % 7 = 0 THEN NULL WHEN value > 30 THEN 'SE-USER' WHEN value > 10 THEN 'SE-TAPE' END AS stored_se,
       CAST(CASE WHEN e.job_id % 7 = 0 THEN 0 ELSE 2 END AS BIGINT) AS attempts,
       CASE WHEN e.job_id % 7 = 0 THEN 'not stored' WHEN value > 10 THEN 'stored' ELSE 'failed' END AS storage,
       CASE WHEN e.job_id % 7 <> 0 AND NOT coalesce(value > 10, false) THEN 'SE-TAPE refused' END AS storage_error,
       CASE WHEN added THEN 'added' ELSE 'rejected' END AS entry,
       CASE WHEN NOT added THEN 'File ' || substr(e.lfn, 5) || ' already exists' END AS entry_error
FROM e JOIN events ON event_id = e.job_id
"""

_AFTER_SQL = "WITH " + _STORE + """,
c AS (SELECT substr(lfn, 5) AS lfn FROM there UNION ALL SELECT substr(lfn, 5) FROM e WHERE added)
SELECT lfn, regexp_replace(lfn, '/[^/]*$', '') AS dir, list_extract(string_split(lfn, '/'), -1) AS name FROM c
"""

_PRODUCTION_SQL = f"""
WITH cat AS (SELECT l_returnflag AS production, l_linestatus AS step, year(l_shipdate) AS y, {_CAT} AS lfn,
                    CASE WHEN l_returnflag = 'N' THEN 4 ELSE 3 END AS size FROM lineitem),
r AS (SELECT *, row_number() OVER (PARTITION BY production, step, y ORDER BY lfn) AS rn FROM cat),
g AS (SELECT production, step, y, (rn - 1) // size AS gid, bool_or(lfn LIKE '%13.sim') AS bad
      FROM r GROUP BY production, step, y, (rn - 1) // size, size HAVING count(*) = size),
k AS (SELECT production, step, count(DISTINCT y) AS k FROM cat GROUP BY production, step),
j AS (SELECT production, step, gid, bool_or(bad) AS bad FROM g JOIN k USING (production, step)
      GROUP BY production, step, gid, k HAVING count(*) = k),
n AS (SELECT production, step, count(*) AS n_jobs, count(*) FILTER (NOT bad) AS n_ok FROM j GROUP BY production, step),
a AS (SELECT production, bool_and(NOT bad) AS ok FROM j GROUP BY production),
s AS (SELECT DISTINCT l_returnflag AS production, unnest(['F', 'O']) AS step FROM lineitem)
SELECT s.production, s.step, CASE WHEN s.production = 'N' THEN 4 ELSE 3 END AS size,
       coalesce(n_jobs, 0) AS n_jobs, coalesce(n_ok, 0) AS n_ok, coalesce(ok, true) AS all_ok
FROM s LEFT JOIN n USING (production, step) LEFT JOIN a ON a.production = s.production
"""

_SUBMIT_SQL = """
WITH t AS (SELECT *, concat_ws('; ',
    CASE WHEN c_acctbal < -900 THEN 'task is not a CommandLineTool, Workflow or ExpressionTool: Operation' END,
    CASE WHEN c_mktsegment NOT IN ('AUTOMOBILE', 'BUILDING', 'FURNITURE', 'MACHINERY')
         THEN 'Unknown execution hooks plugin: ' || c_mktsegment END) AS errors FROM customer)
SELECT c_custkey AS task_id, NULL AS job_id, NULL AS jdl, errors FROM t WHERE errors <> ''
UNION ALL
SELECT c_custkey, c_custkey || ':' || coalesce(CAST(o_orderkey AS VARCHAR), '-'), concat_ws(chr(10),
  '""" + EXECUTABLE_LINE + """', 'Arguments = job.json;',
  'NumberOfProcessors = ' || CASE WHEN c_acctbal > 9000 THEN 8 WHEN c_mktsegment = 'BUILDING' THEN 4 ELSE 1 END || ';',
  'JobName = test;', 'OutputSandbox = {std.out, std.err};',
  CASE WHEN c_nationkey <> 0 THEN 'Priority = ' || c_nationkey || ';' END,
  'InputSandbox = SB:SandboxSE|/S3/sandbox-store/' || c_custkey || '_' || coalesce(CAST(o_orderkey AS VARCHAR), '-') || '.tar.zst;',
  CASE WHEN o_orderkey IS NOT NULL THEN 'InputData = """ + LFN_PREFIX_UPPER + """/orders/' || o_orderkey || '.dat;' END), ''
FROM t LEFT JOIN orders ON o_custkey = c_custkey WHERE errors = ''
"""

QUERIES = {
    "store_and_register_events": (store_and_register_events, _STORE_SQL),
    "catalog_after_store_events": (catalog_after_store_events, _AFTER_SQL),
    "production_lineitem": (production_lineitem, _PRODUCTION_SQL),
    "submit_jobs_customers": (submit_jobs_customers, _SUBMIT_SQL),
}
