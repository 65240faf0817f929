"""Output-table queries: reported outputs parsed, routed and stored with fallback."""

from __future__ import annotations

from pyspark.sql import functions as F

from gridweave.operators.jobs import succeeded
from gridweave.operators.outputs import first_successful_target, parse_outputs, route_outputs
from gridweave.plans.tables import table


def _stdout():
    """JSON a job prints: an object, a list with a null item, an all-null list, an empty value,
    or (failed jobs) no JSON at all - keyed by the event type."""
    eid = F.col("event_id").cast("string")
    k = F.get_json_object("props", "$.k")
    return (F.when(F.col("event_type") == "click",
                   F.concat(F.lit('{"result": {"path": "/out/'), eid, F.lit('/click.txt"}, "log": null}')))
             .when(F.col("event_type") == "view",
                   F.concat(F.lit('{"result": [{"path": "/out/'), eid, F.lit('/a.txt"}, null, {"path": "/out/'),
                            eid, F.lit('/b.txt"}], "empty": []}')))
             .when(F.col("event_type") == "purchase",
                   F.concat(F.lit('{"result": [null], "data": {"path": "/out/'), eid, F.lit("/k"), k,
                            F.lit('.dat"}, "note": {"path": ""}}')))
             .when(F.col("event_type") == "signup", F.lit('{"result": ""}'))
             .otherwise(F.concat(F.lit("Traceback: job "), eid, F.lit(" failed"))))


def _jobs(spark, sf):
    ev = table(spark, sf, "events")
    return ev.select(F.col("event_id").alias("job_id"), "user_id", "event_type", _stdout().alias("stdout"),
                     F.when(F.col("event_type") == "error", 1).otherwise(0).alias("return_code"))


def parse_outputs_events(spark, sf):
    return parse_outputs(_jobs(spark, sf), ["job_id"]).select("job_id", "output_name", "pos", "path", "error")


def route_outputs_events(spark, sf):
    """Successful jobs only; ``result`` goes to the user's catalog folder (and to the sandbox for
    views), ``data`` and ``note`` of purchases to the catalog and ``data`` to the sandbox; a note has an
    empty path."""
    ok, _ = succeeded(_jobs(spark, sf))
    outs = parse_outputs(ok, ["job_id"])
    uid = F.col("user_id").cast("string")
    purchase = F.col("event_type") == "purchase"

    def entry(output, folder):
        return F.struct(F.lit(output).alias("output_name"), F.concat(F.lit(folder), uid).alias("lfn"))

    paths = ok.select("job_id", F.inline(F.array_compact(F.array(
        entry("result", "lfn:/store/"), F.when(purchase, entry("data", "lfn:/data/")), F.when(purchase, entry("note", "lfn:/note/"))))))
    kept = F.when(F.col("event_type") == "view", F.lit("result")).when(purchase, F.lit("data"))
    sandbox = ok.select("job_id", kept.alias("output_name")).filter(F.col("output_name").isNotNull())
    routed = route_outputs(outs, paths, sandbox, ["job_id"])
    return routed.select("job_id", "output_name", "pos", "path", "to_catalog", "to_sandbox", "target", "error")


def first_target_events(spark, sf):
    """Three storage elements tried in order per event file."""
    ev = table(spark, sf, "events")
    eid = F.col("event_id").cast("string")

    def attempt(pos, se, ok):
        return ev.select("event_id", F.lit(pos).alias("pos"), F.lit(se).alias("se"), ok.alias("ok"),
                         F.when(~ok, F.concat(F.lit(se + " refused "), eid)).alias("message"))

    attempts = attempt(0, "SE-USER", F.col("value") > 30).unionByName(
        attempt(1, "SE-DISK", F.col("event_type").isin("click", "view"))).unionByName(
        attempt(2, "SE-TAPE", F.col("value") > 10))
    res = first_successful_target(attempts, ["event_id"])
    return res.select("event_id", "stored_se", "attempts", "status", "error")


_STDOUT_SQL = """CASE event_type
  WHEN 'click' THEN '{"result": {"path": "/out/' || event_id || '/click.txt"}, "log": null}'
  WHEN 'view' THEN '{"result": [{"path": "/out/' || event_id || '/a.txt"}, null, {"path": "/out/' || event_id || '/b.txt"}], "empty": []}'
  WHEN 'purchase' THEN '{"result": [null], "data": {"path": "/out/' || event_id || '/k' || json_extract_string(props, '$.k') || '.dat"}, "note": {"path": ""}}'
  WHEN 'signup' THEN '{"result": ""}'
  ELSE 'Traceback: job ' || event_id || ' failed' END"""


def _parse_sql(where: str = "") -> str:
    return f"""
s AS (SELECT event_id AS job_id, user_id, event_type, {_STDOUT_SQL} AS stdout FROM events {where}),
bad AS (SELECT job_id, CAST(NULL AS VARCHAR) AS output_name, CAST(NULL AS INTEGER) AS pos,
               CAST(NULL AS VARCHAR) AS path, 'invalid output JSON' AS error
        FROM s WHERE NOT json_valid(stdout)),
kv AS (SELECT job_id, stdout, unnest(json_keys(stdout)) AS output_name FROM s WHERE json_valid(stdout)),
v AS (SELECT job_id, output_name, json_extract(stdout, '$."' || output_name || '"') AS v FROM kv),
nz AS (SELECT * FROM v WHERE json_type(v) <> 'NULL' AND CAST(v AS VARCHAR) NOT IN ('""', '[]', '{{}}', '0', 'false')),
l AS (SELECT job_id, output_name,
             list_filter(CASE WHEN json_type(v) = 'ARRAY' THEN json_extract(v, '$[*]') ELSE [v] END,
                         lambda x: json_type(x) = 'OBJECT' AND json_extract_string(x, '$.path') IS NOT NULL) AS files
      FROM nz),
p AS (SELECT job_id, output_name, files, unnest(generate_series(1, len(files))) AS i FROM l WHERE len(files) > 0),
parsed AS (
  SELECT job_id, output_name, CAST(i - 1 AS INTEGER) AS pos, json_extract_string(files[i], '$.path') AS path,
         CAST(NULL AS VARCHAR) AS error FROM p
  UNION ALL SELECT job_id, output_name, CAST(NULL AS INTEGER), CAST(NULL AS VARCHAR), CAST(NULL AS VARCHAR)
            FROM l WHERE len(files) = 0
  UNION ALL SELECT * FROM bad)"""


_PARSE_SQL = "WITH " + _parse_sql() + "\nSELECT * FROM parsed"

_ROUTE_SQL = "WITH " + _parse_sql("WHERE event_type <> 'error'") + """,
paths AS (SELECT job_id, 'result' AS output_name, 'lfn:/store/' || user_id AS lfn FROM s
          UNION ALL SELECT job_id, 'data', 'lfn:/data/' || user_id FROM s WHERE event_type = 'purchase'
          UNION ALL SELECT job_id, 'note', 'lfn:/note/' || user_id FROM s WHERE event_type = 'purchase'),
sb AS (SELECT job_id, 'result' AS output_name FROM s WHERE event_type = 'view'
       UNION ALL SELECT job_id, 'data' FROM s WHERE event_type = 'purchase')
SELECT p.job_id, p.output_name, p.pos, p.path,
       (paths.lfn IS NOT NULL AND NOT (coalesce(p.path, '') = '' AND p.error IS NULL)) AS to_catalog,
       (sb.job_id IS NOT NULL AND NOT (coalesce(p.path, '') = '' AND p.error IS NULL)) AS to_sandbox,
       CASE WHEN paths.lfn IS NOT NULL AND NOT (coalesce(p.path, '') = '' AND p.error IS NULL)
            THEN paths.lfn || '/' || list_extract(string_split(p.path, '/'), -1) END AS target,
       CASE WHEN coalesce(p.path, '') = '' AND p.error IS NULL
            THEN 'src_path parameter required for filesystem storage of ' || p.output_name ELSE p.error END AS error
FROM parsed p
LEFT JOIN paths ON p.job_id = paths.job_id AND p.output_name = paths.output_name
LEFT JOIN sb ON p.job_id = sb.job_id AND p.output_name = sb.output_name
"""

_FIRST_TARGET_SQL = """
WITH a AS (
  SELECT event_id, 0 AS pos, 'SE-USER' AS se, value > 30 AS ok FROM events
  UNION ALL SELECT event_id, 1, 'SE-DISK', event_type IN ('click', 'view') FROM events
  UNION ALL SELECT event_id, 2, 'SE-TAPE', value > 10 FROM events),
m AS (SELECT event_id, pos, se, ok, CASE WHEN NOT ok THEN se || ' refused ' || event_id END AS message FROM a),
g AS (SELECT event_id, arg_min(se, pos) FILTER (WHERE ok) AS stored_se, arg_max(message, pos) AS last_msg,
             count(*) AS attempts FROM m GROUP BY event_id)
SELECT event_id, stored_se, attempts, CASE WHEN stored_se IS NULL THEN 'failed' ELSE 'stored' END AS status,
       CASE WHEN stored_se IS NULL THEN last_msg END AS error
FROM g
"""

QUERIES = {
    "parse_outputs_events": (parse_outputs_events, _PARSE_SQL),
    "route_outputs_events": (route_outputs_events, _ROUTE_SQL),
    "first_target_events": (first_target_events, _FIRST_TARGET_SQL),
}
