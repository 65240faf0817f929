"""Job tables: expanding parameter sets, layering parameters, folding hints, step defaults,
success checks and the submission text of a job."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from gridweave.functions._cols import as_col
from gridweave.functions.lfn import lfn_upper
from gridweave.functions.text import short_id

# Submission text lines and their defaults.
EXECUTABLE_LINE = "Executable = dirac-cwl-exec;"
ARGUMENTS_LINE = "Arguments = job.json;"
JOB_NAME_LINE = "JobName = test;"
OUTPUT_SANDBOX_LINE = "OutputSandbox = {std.out, std.err};"
DEFAULT_PRIORITY = 10

# Hint classes and the defaults used when a task has no hint for a key.
HOOKS = "hooks"
SCHEDULING = "scheduling"
HINT_DEFAULTS = [
    (HOOKS, "hook_plugin", "QueryBasedPlugin"),
    (HOOKS, "output_se", "SE-USER"),
    (SCHEDULING, "priority", str(DEFAULT_PRIORITY)),
]
#: Position of the defaults, below that of every hint (positions count from 0).
BELOW = -1


# --- expansion -------------------------------------------------------------------------------

def expand_jobs(tasks: DataFrame, params: DataFrame, task_key: str = "task_id",
                seq: str = "param_seq") -> DataFrame:
    """One job per parameter set of a task, or exactly one job without input.

    Written as an inner join (a task with a huge number of parameter sets is a skewed partition
    either side of which can be split, and the task table - one row per task - is usually
    broadcast) plus the tasks without any parameter set (left anti join), instead of a left join
    whose right side could not be split.  ``job_id`` is ``<task>:<param_seq>`` (``<task>:-`` for
    the job without input): stable and collision free, unlike a random number.
    """
    with_params = params.join(tasks, task_key)
    without = tasks.join(params.select(task_key), task_key, "left_anti")
    for c in with_params.columns:
        if c not in without.columns:
            without = without.withColumn(c, F.lit(None).cast(with_params.schema[c].dataType))
    jobs = with_params.unionByName(without.select(*with_params.columns))
    job_id = F.concat_ws(":", F.col(task_key).cast("string"),
                         F.coalesce(F.col(seq).cast("string"), F.lit("-")))
    return jobs.withColumn("job_id", job_id)


def waits_for_data(tasks: DataFrame, configuration: str = "configuration",
                   group_size: str = "group_size") -> tuple[DataFrame, DataFrame]:
    """Split tasks into (waiting for catalog data, single job without input).

    A task waits for data only when it has both a non-empty configuration and a non-empty
    group size map.
    """
    cond = (F.coalesce(F.size(configuration), F.lit(0)) > 0) & (F.coalesce(F.size(group_size), F.lit(0)) > 0)
    return tasks.filter(cond), tasks.filter(~cond)


def succeeded(results: DataFrame, code: str = "return_code") -> tuple[DataFrame, DataFrame]:
    """(jobs with return code 0, the others) - only the first go on to post-processing."""
    ok = F.coalesce(F.col(code) == 0, F.lit(False))
    return results.filter(ok), results.filter(~ok)


def all_succeeded(results: DataFrame, keys: Sequence[str], ok: str = "ok",
                  parents: DataFrame | None = None) -> DataFrame:
    """``all(ok)`` per group; a group without any result is true.

    With ``parents`` (one row per group key) groups that have no result rows appear, as true.
    """
    keys = list(keys)
    agg = results.groupBy(*keys).agg(F.bool_and(F.col(ok)).alias("_all"))
    if parents is not None:
        agg = parents.select(*keys).join(agg, keys, "left")
    return agg.select(*keys, F.coalesce(F.col("_all"), F.lit(True)).alias("all_ok"))


# --- parameters --------------------------------------------------------------------------------

def snake_key(col: Column | str) -> Column:
    """Parameter name with every ``-`` turned into ``_``."""
    return F.replace(as_col(col), F.lit("-"), F.lit("_"))


def resolve_parameters(defaults: DataFrame, overrides: DataFrame | None,
                       configuration: DataFrame | None, task_key: str = "task_id") -> DataFrame:
    """Runtime parameters of every task: defaults < override of declared inputs < configuration.

    Every input is long ``(task_id, key, value, pos)``; ``pos`` is the declaration order inside
    the layer.  Overrides of keys that are not declared inputs are ignored.  Then ``-`` becomes
    ``_`` in all names; when two names collide the one that comes later in the merged order
    (declared inputs first, new configuration keys after) wins.
    Returns ``(task_id, key, value)``.
    """
    cols = [task_key, "key", "value", "pos"]
    layers = [defaults.select(*cols).withColumn("layer", F.lit(0))]
    if overrides is not None:
        declared = defaults.select(task_key, "key").distinct()
        layers.append(overrides.select(*cols).join(declared, [task_key, "key"], "left_semi")
                      .withColumn("layer", F.lit(1)))
    if configuration is not None:
        layers.append(configuration.select(*cols).withColumn("layer", F.lit(2)))
    u = layers[0]
    for layer in layers[1:]:
        u = u.unionByName(layer)
    prec = F.struct(F.col("layer"), F.col("pos"))
    merged = u.groupBy(task_key, "key").agg(F.max_by("value", prec).alias("value"),
                                            F.min(prec).alias("_first"))
    return (merged.withColumn("key", snake_key("key"))
                  .groupBy(task_key, "key").agg(F.max_by("value", "_first").alias("value")))


def fold_hints(hints: DataFrame, tasks: DataFrame | None = None, task_key: str = "task_id",
               defaults: Sequence[tuple[str, str, str]] = tuple(HINT_DEFAULTS)) -> DataFrame:
    """Fold the hints of every task into one value per ``(class, key, subkey)``.

    ``hints`` is long ``(task_id, pos, class, key, subkey, value)``: a map-valued field gives one
    row per entry (``subkey`` set), any other value one row with ``subkey`` null.  Hints apply in
    ``pos`` order.  ``hooks``: a map onto a map merges one level deep, anything else replaces.
    ``scheduling``: the last hint holding a key replaces it.  Keys without a hint take the
    defaults (``hook_plugin``, ``output_se``, ``priority``); without ``tasks`` the tasks are those
    that have hints, and the hints are read once.  The first aggregation leaves one row per
    subkey, the window then sees only those.
    Returns ``(task_id, class, key, subkey, value)``.
    """
    k = [task_key, "class", "key"]
    cols = ["pos", "class", "key", "subkey", "value"]
    # the defaults are scalars below every hint; they ride on the rows of the one scan
    below = F.array(*[F.struct(F.lit(BELOW).cast("long").alias("pos"), F.lit(c).alias("class"), F.lit(kk).alias("key"),
                               F.lit(None).cast("string").alias("subkey"), F.lit(v).alias("value")) for c, kk, v in defaults])
    own = F.struct(F.col("pos").cast("long").alias("pos"), *[F.col(c).cast("string").alias(c) for c in cols[1:]])
    if tasks is None:
        rows = hints.select(task_key, F.inline(F.concat(F.array(own), below) if defaults else F.array(own)))
    else:
        rows = hints.select(task_key, "pos", *cols[1:])
        rows = rows.unionByName(tasks.select(task_key, F.inline(below))) if defaults else rows
    last = rows.groupBy(*k, "subkey").agg(F.max_by("value", "pos").alias("value"), F.max("pos").alias("pos"))
    one_key = Window.partitionBy(*k)
    scalar = F.col("subkey").isNull()
    last = last.withColumn("_last", F.max("pos").over(one_key)).withColumn(
        "_last_scalar", F.max(F.when(scalar, F.col("pos"))).over(one_key))
    merged = F.col("pos") > F.coalesce(F.col("_last_scalar"), F.lit(BELOW - 1))
    keep = F.when((F.col("class") == HOOKS) & ~scalar, merged).otherwise(F.col("pos") == F.col("_last"))
    return last.filter(keep).select(*k, "subkey", "value")


# --- steps of a workflow -----------------------------------------------------------------------

def explode_steps(workflows: DataFrame, wf_key: str = "wf_id", steps: str = "steps") -> DataFrame:
    """One row per workflow step: ``wf_id, step_pos, step_id, kind, in, inputs, ...``.

    ``steps`` is ``array<struct<id, in: array<struct<id, source>>, run: struct<class, inputs:
    array<struct<id, default>>, ...>>>``.  The step's own hints are kept in ``hints`` when the
    step carries them.
    """
    exploded = workflows.select("*", F.posexplode(steps).alias("step_pos", "_s")).drop(steps)
    run_fields = workflows.schema[steps].dataType.elementType["run"].dataType.fieldNames()
    step_fields = workflows.schema[steps].dataType.elementType.fieldNames()
    extra = [F.col("_s")[f].alias(f) for f in step_fields if f not in ("id", "in", "run")]
    return exploded.select(
        *[c for c in exploded.columns if c != "_s"],
        F.col("_s.id").alias("step_id"), F.col("_s.run")["class"].alias("kind"),
        F.col("_s")["in"].alias("in"), F.col("_s.run.inputs").alias("inputs"),
        *[F.col("_s.run")[f].alias(f"run_{f}") for f in run_fields if f not in ("class", "inputs")],
        *extra)


def step_defaults(steps: DataFrame, wf_inputs: DataFrame | str, wf_key: str = "wf_id",
                  step_key: str = "step_id") -> DataFrame:
    """Default of every tool input of every step, taken from the workflow when wired to it.

    ``steps`` holds ``in`` (``array<struct<id, source>>``) and ``inputs``
    (``array<struct<id, default>>``).  ``wf_inputs`` is the name of a column of ``steps`` with the
    workflow's own inputs (``array<struct<id, default>>``, as a workflow document has them), or a
    frame ``(wf_id, id, default)``, which is folded into one array per workflow and joined before
    anything is exploded.  Ids are unique per workflow.  A tool input whose short name matches a
    step ``in`` whose ``source`` is a workflow input takes that input's default - also when it is
    null.  Otherwise the tool default stays.  All look-ups happen inside the step row.
    Returns ``(wf_id, step_id, input_pos, input, default, from_workflow)``.
    """
    if not isinstance(wf_inputs, str):
        folded = wf_inputs.groupBy(wf_key).agg(F.collect_list(F.struct("id", "default")).alias("_wf_in"))
        steps, wf_inputs = steps.join(folded, wf_key, "left"), "_wf_in"
    wired = steps.select(wf_key, step_key, "inputs", F.transform("in", lambda w: short_id(w["id"])).alias("_in_short"),
                         F.col("in.source").alias("_in_src"), F.col(f"{wf_inputs}.id").alias("_wf_id"),
                         F.col(f"{wf_inputs}.default").alias("_wf_default"))
    tool = wired.select(wf_key, step_key, "_in_short", "_in_src", "_wf_id", "_wf_default",
                        F.posexplode("inputs").alias("input_pos", "_i"))
    tool = tool.select("*", short_id(F.col("_i.id")).alias("input"))
    tool = tool.withColumn("_src", F.get("_in_src", F.array_position("_in_short", F.col("input")).cast("int") - 1))
    tool = tool.withColumn("_at", F.coalesce(F.array_position("_wf_id", F.col("_src")), F.lit(0)).cast("int"))
    return tool.select(wf_key, step_key, "input_pos", "input",
                       F.when(F.col("_at") > 0, F.get("_wf_default", F.col("_at") - 1)).otherwise(F.col("_i.default"))
                        .alias("default"),
                       (F.col("_at") > 0).alias("from_workflow"))


# --- submission text ------------------------------------------------------------------------------

def render_job_text(jobs: DataFrame, sandbox: str = "sandbox_id", refs: str | None = "input_refs",
                    cores: str | None = "cores", priority: str | None = "priority",
                    sites: str | None = "sites", data: str | None = None) -> Column:
    """Submission text of a job, lines joined by ``\\n`` (no trailing newline).

    Optional lines: ``NumberOfProcessors`` when cores > 0, ``Priority`` unless 0 (default 10),
    ``Site`` when sites are given (array joined by ``, `` or a plain string), ``InputData`` with
    the catalog references (``lfn:`` written ``LFN:``) when there are any.  ``data`` names a column
    that already holds those references as text, in place of ``refs``.
    """
    schema = jobs.schema

    def opt(name):
        return F.col(name) if name and name in schema.fieldNames() else F.lit(None)

    cores_c = opt(cores)
    prio = F.coalesce(opt(priority).cast("int"), F.lit(DEFAULT_PRIORITY))
    if sites and sites in schema.fieldNames() and isinstance(schema[sites].dataType, T.ArrayType):
        sites_c = F.array_join(F.col(sites), ", ")
    else:
        sites_c = opt(sites).cast("string")
    if data:
        data_line = F.when(F.coalesce(F.length(data), F.lit(0)) > 0, F.concat(F.lit("InputData = "), F.col(data), F.lit(";")))
    elif refs and refs in schema.fieldNames():
        refs_arr = F.filter(F.col(refs), lambda r: r.startswith("lfn:"))
        data = F.array_join(F.transform(refs_arr, lambda r: lfn_upper(r)), ", ")
        data_line = F.when(F.coalesce(F.size(refs_arr), F.lit(0)) > 0,
                           F.concat(F.lit("InputData = "), data, F.lit(";")))
    else:
        data_line = F.lit(None).cast("string")
    lines = [
        F.lit(EXECUTABLE_LINE),
        F.lit(ARGUMENTS_LINE),
        F.when(cores_c > 0, F.concat(F.lit("NumberOfProcessors = "), cores_c.cast("string"), F.lit(";"))),
        F.lit(JOB_NAME_LINE),
        F.lit(OUTPUT_SANDBOX_LINE),
        F.when(prio != 0, F.concat(F.lit("Priority = "), prio.cast("string"), F.lit(";"))),
        F.when(F.coalesce(F.length(sites_c), F.lit(0)) > 0, F.concat(F.lit("Site = "), sites_c, F.lit(";"))),
        F.concat(F.lit("InputSandbox = "), F.col(sandbox).cast("string"), F.lit(";")),
        data_line,
    ]
    return F.concat_ws("\n", *lines)
