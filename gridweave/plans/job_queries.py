"""Job-table queries: expansion, parameter layers, hint folding, step defaults, submission text."""

from __future__ import annotations

from pyspark.sql import functions as F

from gridweave.functions.text import short_id
from gridweave.operators.jobs import (
    EXECUTABLE_LINE,
    all_succeeded,
    expand_jobs,
    explode_steps,
    fold_hints,
    render_job_text,
    resolve_parameters,
    step_defaults,
    waits_for_data,
)
from gridweave.plans.tables import table

# Fixed values of the stand-ins: sites of the scheduling fixture.
SITES = ["SITE-A.example.org", "SITE-B.example.org"]


def expand_jobs_conversations(spark, sf):
    """Tasks = conversations; parameter sets = their system turns (none -> one job without input)."""
    conv = table(spark, sf, "conversations")
    tasks = conv.select(F.col("conv_id").alias("task_id")).distinct()
    params = conv.filter(F.col("role") == "system").select(
        F.col("conv_id").alias("task_id"), F.col("turn").alias("param_seq"), "text")
    jobs = expand_jobs(tasks, params)
    return jobs.select("task_id", "param_seq", "job_id", F.length("text").cast("long").alias("n_chars"))


def _event_params(spark, sf):
    ev = table(spark, sf, "events")
    k = F.get_json_object("props", "$.k")
    base = ev.select(F.col("user_id").alias("task_id"), "event_type", "event_id", k.alias("k"))
    row = [F.col("task_id"), F.col("event_id").cast("string").alias("value"), F.col("event_id").alias("pos")]
    defaults = base.filter(F.col("event_type") == "view").select(
        F.concat(F.lit("param-"), F.col("k")).alias("key"), *row)
    overrides = base.filter(F.col("event_type") == "click").select(
        F.concat(F.lit("param-"), F.col("k")).alias("key"), *row)
    config = base.filter(F.col("event_type") == "purchase").select(
        F.concat(F.lit("param_"), F.col("k")).alias("key"), *row)
    return defaults, overrides, config


def resolve_parameters_events(spark, sf):
    """Per user: views declare inputs (``param-<k>``), clicks override declared ones, purchases
    configure ``param_<k>``; names are then snake-cased and collisions resolved."""
    d, o, c = _event_params(spark, sf)
    return resolve_parameters(d, o, c).select("task_id", "key", "value")


def _conversation_hints(spark, sf):
    """The hints of every turn, in one scan: user turns hold a ``configuration`` entry, assistant
    turns an ``output_paths`` entry, system turns a whole configuration and a priority."""
    conv = table(spark, sf, "conversations")
    word = F.lower(F.regexp_extract("text", r"^\W*(\w+)", 1))
    size = F.length("text").cast("string")

    def hint(cls, key, subkey, value):
        return F.struct(F.lit(cls).alias("class"), F.lit(key).alias("key"), subkey.cast("string").alias("subkey"),
                        value.alias("value"))

    none, role = F.lit(None), F.col("role")
    hints = (F.when(role == "user", F.array(hint("hooks", "configuration", word, size)))
              .when(role == "assistant", F.array(hint("hooks", "output_paths", word, size)))
              .when(role == "system", F.array(hint("hooks", "configuration", none, size),
                                              hint("scheduling", "priority", none, F.col("turn").cast("string")))))
    return conv.select(F.col("conv_id").alias("task_id"), F.col("turn").alias("pos"), F.inline(hints))


def fold_hints_conversations(spark, sf):
    """Turns as hints: user turns merge into ``configuration``, assistant turns into
    ``output_paths``, system turns replace ``configuration`` and set the scheduling priority."""
    return fold_hints(_conversation_hints(spark, sf)).select("task_id", "class", "key", "subkey", "value")


def _lineitem_workflows(spark, sf):
    """A two-step workflow per line (``ship`` tool, ``bill`` sub-workflow) and its inputs: ``mode``
    from the order priority; ``flag`` from the return flag (absent for A, without default for R)."""
    li = table(spark, sf, "lineitem")
    wf = F.concat_ws("_", "l_orderkey", "l_linenumber", "l_partkey", "l_suppkey",
                     F.to_date("l_shipdate").cast("string"))

    def wire(i, src):
        return F.struct(F.lit(i).alias("id"), F.lit(src).alias("source"))

    def inp(i, default):
        return F.struct(F.lit(i).alias("id"), default.alias("default"))

    ship = F.struct(
        F.lit("#main/ship").alias("id"),
        F.array(wire("#main/ship/mode", "#main/mode"), wire("#main/ship/flag", "#main/flag")).alias("in"),
        F.struct(F.lit("CommandLineTool").alias("class"),
                 F.array(inp("#ship.cwl#mode", F.concat(F.lit("tool-"), F.col("l_linestatus"))),
                         inp("#ship.cwl#flag", F.lit("tool-flag")),
                         inp("#ship.cwl#extra", F.lit("x"))).alias("inputs")).alias("run"))
    bill = F.struct(
        F.lit("#main/bill").alias("id"),
        F.array(wire("#main/bill/mode", "#main/mode")).alias("in"),
        F.struct(F.lit("Workflow").alias("class"),
                 F.array(inp("#bill.cwl#mode", F.lit(None).cast("string"))).alias("inputs")).alias("run"))
    o = table(spark, sf, "orders")
    mode = F.struct(F.lit("#main/mode").alias("id"), F.col("o_orderpriority").alias("default"))
    flag = F.struct(F.lit("#main/flag").alias("id"),
                    F.when(F.col("l_returnflag") != "R", F.col("l_returnflag")).alias("default"))
    inputs = F.array_compact(F.array(F.when(F.col("o_orderkey").isNotNull(), mode),
                                     F.when(F.col("l_returnflag") != "A", flag)))
    return li.join(o, li["l_orderkey"] == o["o_orderkey"], "left").select(
        wf.alias("wf_id"), "l_orderkey", inputs.alias("wf_inputs"), F.array(ship, bill).alias("steps"))


def step_defaults_lineitem(spark, sf):
    """Two-step workflow per line; tool inputs wired to workflow inputs take their defaults."""
    steps = explode_steps(_lineitem_workflows(spark, sf))
    return step_defaults(steps, "wf_inputs").select("wf_id", "step_id", F.col("input_pos").cast("long").alias("input_pos"),
                                                  "input", "default", "from_workflow")


def explode_steps_lineitem(spark, sf):
    steps = explode_steps(_lineitem_workflows(spark, sf))
    return steps.select("wf_id", F.col("step_pos").cast("long").alias("step_pos"), "step_id", "kind",
                        F.size("in").cast("long").alias("n_in"), F.size("inputs").cast("long").alias("n_inputs"))


def short_id_pages(spark, sf):
    return table(spark, sf, "pages").select("page_id", short_id("url").alias("short_id"))


def render_job_text_orders(spark, sf):
    """One job per order: cores from the priority digit, scheduling priority from the status,
    sites for pending orders, one local and two catalog references unless finished."""
    o = table(spark, sf, "orders")
    cores = F.substring("o_orderpriority", 1, 1).cast("int") - 1
    prio = F.when(F.col("o_orderstatus") == "F", 0).when(F.col("o_orderstatus") == "O", 10).otherwise(100)
    sites = F.when(F.col("o_orderstatus") == "P", F.array(*[F.lit(s) for s in SITES]))
    refs = F.when(F.col("o_orderstatus") != "F", F.array(
        F.concat(F.lit("lfn:/orders/"), F.col("o_custkey").cast("string"), F.lit("/"),
                 F.col("o_orderkey").cast("string"), F.lit(".dat")),
        F.concat(F.lit("file:///local/"), F.col("o_orderkey").cast("string"), F.lit(".txt")),
        F.concat(F.lit("lfn:/calib/"), F.col("o_orderpriority"), F.lit(".db"))))
    sandbox = F.concat(F.lit("SB:SandboxSE|/S3/sandbox-store/sha256:"), F.col("o_orderkey").cast("string"),
                       F.lit(".tar.zst"))
    jobs = o.select("o_orderkey", cores.alias("cores"), prio.alias("priority"), sites.alias("sites"),
                    refs.alias("input_refs"), sandbox.alias("sandbox_id"))
    return jobs.select("o_orderkey", render_job_text(jobs).alias("jdl"))


def all_succeeded_orders(spark, sf):
    """A line succeeded when finished (linestatus F); an order without lines counts as success."""
    li = table(spark, sf, "lineitem").select(F.col("l_orderkey").alias("o_orderkey"),
                                               (F.col("l_linestatus") == "F").alias("ok"))
    o = table(spark, sf, "orders")
    return all_succeeded(li, ["o_orderkey"], "ok", parents=o)


def waits_for_data_customers(spark, sf):
    """Customers as transformations: configuration when the balance is positive, grouping for the
    BUILDING segment; only those with both wait for catalog data."""
    c = table(spark, sf, "customer")
    tasks = c.select("c_custkey",
                     F.when(F.col("c_acctbal") > 0, F.create_map(F.lit("campaign"), F.col("c_mktsegment")))
                      .otherwise(F.create_map().cast("map<string,string>")).alias("configuration"),
                     F.when(F.col("c_mktsegment") == "BUILDING", F.create_map(F.lit("input-data"), F.lit(5)))
                      .alias("group_size"))
    waiting, single = waits_for_data(tasks)
    return waiting.select("c_custkey", F.lit(True).alias("waits")).unionByName(
        single.select("c_custkey", F.lit(False).alias("waits")))


_EXPAND_SQL = """
WITH t AS (SELECT DISTINCT conv_id FROM conversations),
p AS (SELECT conv_id, turn, text FROM conversations WHERE role = 'system')
SELECT t.conv_id AS task_id, p.turn AS param_seq,
       CAST(t.conv_id AS VARCHAR) || ':' || COALESCE(CAST(p.turn AS VARCHAR), '-') AS job_id,
       CAST(length(p.text) AS BIGINT) AS n_chars
FROM t LEFT JOIN p ON t.conv_id = p.conv_id
"""

_RESOLVE_SQL = """
WITH e AS (SELECT user_id AS task_id, event_type, event_id, json_extract_string(props, '$.k') AS k FROM events),
d AS (SELECT task_id, 'param-' || k AS key, CAST(event_id AS VARCHAR) AS value, 0 AS layer, event_id AS pos
      FROM e WHERE event_type = 'view'),
o AS (SELECT task_id, 'param-' || k AS key, CAST(event_id AS VARCHAR) AS value, 1 AS layer, event_id AS pos
      FROM e WHERE event_type = 'click'),
u AS (SELECT * FROM d
      UNION ALL SELECT * FROM o WHERE EXISTS (SELECT 1 FROM d WHERE d.task_id = o.task_id AND d.key = o.key)
      UNION ALL SELECT task_id, 'param_' || k, CAST(event_id AS VARCHAR), 2, event_id FROM e WHERE event_type = 'purchase'),
m AS (SELECT task_id, key, arg_max(value, (layer, pos)) AS value, min((layer, pos)) AS first
      FROM u GROUP BY task_id, key)
SELECT task_id, replace(key, '-', '_') AS key, arg_max(value, first) AS value
FROM m GROUP BY task_id, replace(key, '-', '_')
"""

_FOLD_SQL = r"""
WITH h AS (
  SELECT conv_id AS task_id, turn AS pos, 'hooks' AS class, 'configuration' AS key,
         lower(regexp_extract(text, '^\W*(\w+)', 1)) AS subkey, CAST(length(text) AS VARCHAR) AS value
  FROM conversations WHERE role = 'user'
  UNION ALL SELECT conv_id, turn, 'hooks', 'output_paths', lower(regexp_extract(text, '^\W*(\w+)', 1)),
         CAST(length(text) AS VARCHAR) FROM conversations WHERE role = 'assistant'
  UNION ALL SELECT conv_id, turn, 'hooks', 'configuration', NULL, CAST(length(text) AS VARCHAR)
         FROM conversations WHERE role = 'system'
  UNION ALL SELECT conv_id, turn, 'scheduling', 'priority', NULL, CAST(turn AS VARCHAR)
         FROM conversations WHERE role = 'system'),
b AS (SELECT task_id, class, key, max(CASE WHEN subkey IS NULL THEN pos END) AS ls, max(pos) AS la
      FROM h GROUP BY task_id, class, key),
k AS (SELECT h.* FROM h JOIN b ON h.task_id = b.task_id AND h.class = b.class AND h.key = b.key
      WHERE CASE WHEN h.class = 'hooks'
                 THEN (CASE WHEN h.subkey IS NULL THEN h.pos = b.la ELSE h.pos > coalesce(b.ls, -1) END)
                 ELSE h.pos = b.la END),
f AS (SELECT task_id, class, key, subkey, arg_max(value, pos) AS value FROM k GROUP BY task_id, class, key, subkey),
d AS (SELECT * FROM (VALUES ('hooks', 'hook_plugin', 'QueryBasedPlugin'), ('hooks', 'output_se', 'SE-USER'),
                            ('scheduling', 'priority', '10')) v(class, key, value)),
t AS (SELECT DISTINCT conv_id AS task_id FROM conversations)
SELECT task_id, class, key, subkey, value FROM f
UNION ALL
SELECT t.task_id, d.class, d.key, NULL AS subkey, d.value FROM t JOIN d ON true
WHERE NOT EXISTS (SELECT 1 FROM f WHERE f.task_id = t.task_id AND f.class = d.class AND f.key = d.key)
"""

_WF = ("CAST(l_orderkey AS VARCHAR) || '_' || l_linenumber || '_' || l_partkey || '_' || l_suppkey || '_' || "
       "CAST(CAST(l_shipdate AS DATE) AS VARCHAR)")

_STEP_DEFAULTS_SQL = f"""
SELECT {_WF} AS wf_id, '#main/ship' AS step_id, CAST(0 AS BIGINT) AS input_pos, 'mode' AS input,
       o_orderpriority AS "default", true AS from_workflow
FROM lineitem JOIN orders ON l_orderkey = o_orderkey
UNION ALL
SELECT {_WF}, '#main/ship', 1, 'flag',
       CASE WHEN l_returnflag = 'A' THEN 'tool-flag' WHEN l_returnflag = 'R' THEN NULL ELSE l_returnflag END,
       l_returnflag <> 'A'
FROM lineitem
UNION ALL SELECT {_WF}, '#main/ship', 2, 'extra', 'x', false FROM lineitem
UNION ALL
SELECT {_WF}, '#main/bill', 0, 'mode', o_orderpriority, true
FROM lineitem JOIN orders ON l_orderkey = o_orderkey
"""

_EXPLODE_SQL = f"""
SELECT {_WF} AS wf_id, CAST(0 AS BIGINT) AS step_pos, '#main/ship' AS step_id, 'CommandLineTool' AS kind,
       CAST(2 AS BIGINT) AS n_in, CAST(3 AS BIGINT) AS n_inputs FROM lineitem
UNION ALL
SELECT {_WF}, 1, '#main/bill', 'Workflow', 1, 1 FROM lineitem
"""

_SHORT_SQL = """
SELECT page_id, list_extract(string_split(list_extract(string_split(url, '#'), -1), '/'), -1) AS short_id FROM pages
"""

_JDL_SQL = """
SELECT o_orderkey, concat_ws(chr(10),
  '""" + EXECUTABLE_LINE + """', 'Arguments = job.json;',
  CASE WHEN CAST(substr(o_orderpriority, 1, 1) AS INTEGER) - 1 > 0
       THEN 'NumberOfProcessors = ' || (CAST(substr(o_orderpriority, 1, 1) AS INTEGER) - 1) || ';' END,
  'JobName = test;', 'OutputSandbox = {std.out, std.err};',
  CASE WHEN o_orderstatus = 'O' THEN 'Priority = 10;' WHEN o_orderstatus <> 'F' THEN 'Priority = 100;' END,
  CASE WHEN o_orderstatus = 'P' THEN 'Site = SITE-A.example.org, SITE-B.example.org;' END,
  'InputSandbox = SB:SandboxSE|/S3/sandbox-store/sha256:' || o_orderkey || '.tar.zst;',
  CASE WHEN o_orderstatus <> 'F' THEN 'InputData = LFN:/orders/' || o_custkey || '/' || o_orderkey || '.dat, LFN:/calib/'
       || o_orderpriority || '.db;' END) AS jdl
FROM orders
"""

_ALL_OK_SQL = """
SELECT o_orderkey, coalesce(bool_and(l_linestatus = 'F'), true) AS all_ok
FROM orders LEFT JOIN lineitem ON l_orderkey = o_orderkey GROUP BY o_orderkey
"""

_WAITS_SQL = """
SELECT c_custkey, (c_acctbal > 0 AND c_mktsegment = 'BUILDING') AS waits FROM customer
"""

QUERIES = {
    "expand_jobs_conversations": (expand_jobs_conversations, _EXPAND_SQL),
    "resolve_parameters_events": (resolve_parameters_events, _RESOLVE_SQL),
    "fold_hints_conversations": (fold_hints_conversations, _FOLD_SQL),
    "explode_steps_lineitem": (explode_steps_lineitem, _EXPLODE_SQL),
    "step_defaults_lineitem": (step_defaults_lineitem, _STEP_DEFAULTS_SQL),
    "short_id_pages": (short_id_pages, _SHORT_SQL),
    "render_job_text_orders": (render_job_text_orders, _JDL_SQL),
    "all_succeeded_orders": (all_succeeded_orders, _ALL_OK_SQL),
    "waits_for_data_customers": (waits_for_data_customers, _WAITS_SQL),
}
