"""Validation of descriptors: every rule adds a message; rows split into valid and rejected."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def check(df: DataFrame, rules: Sequence[tuple[Column, Column | str]], out: str = "errors") -> DataFrame:
    """Add ``errors`` (array of the messages of the rules that fail, in rule order) and ``valid``.

    A rule is ``(failing condition, message)``; a null condition counts as passing.
    """
    msgs = [F.when(F.coalesce(cond, F.lit(False)), msg if isinstance(msg, Column) else F.lit(msg))
            for cond, msg in rules]
    return (df.withColumn(out, F.array_compact(F.array(*msgs)))
              .withColumn("valid", F.size(F.col(out)) == 0))


def unknown_key(df: DataFrame, known: DataFrame, col: str, known_col: str = "key") -> DataFrame:
    """Add boolean ``_unknown_<col>``: the value is not among the known keys (left join)."""
    k = known.select(F.col(known_col).alias(f"_k_{col}")).distinct().withColumn(f"_hit_{col}", F.lit(True))
    j = df.join(k, df[col] == k[f"_k_{col}"], "left")
    return j.withColumn(f"_unknown_{col}", F.col(f"_hit_{col}").isNull() & F.col(col).isNotNull()) \
            .drop(f"_k_{col}", f"_hit_{col}")


def wrong_type(col: Column | str, type_name: str) -> Column:
    """True when a present value does not convert to ``type_name``."""
    c = F.col(col) if isinstance(col, str) else col
    return c.isNotNull() & c.try_cast(type_name).isNull()


def unexpected_keys(map_col: Column | str, allowed: Sequence[str]) -> Column:
    """Keys of a map outside ``allowed`` (sorted array; empty when none)."""
    c = F.col(map_col) if isinstance(map_col, str) else map_col
    return F.array_sort(F.array_except(F.map_keys(c), F.array(*[F.lit(a) for a in allowed])))


def split_valid(checked: DataFrame) -> tuple[DataFrame, DataFrame]:
    return checked.filter("valid"), checked.filter(~F.col("valid"))


# The task classes a submission accepts and the keys a scheduling hint may hold.
TASK_CLASSES = ["CommandLineTool", "Workflow", "ExpressionTool"]
SCHEDULING_KEYS = ["platform", "priority", "sites"]


def validate_descriptors(tasks: DataFrame, registry_keys: DataFrame, kind: str = "job") -> DataFrame:
    """The descriptor checks of a submission, one message per failed rule.

    ``tasks`` holds ``task_class``, ``hook_plugin`` (null = default plugin), ``scheduling``
    (``map<string,string>``) and ``group_size`` (``map<string,string>``, values as given).
    ``registry_keys`` lists the known plugin keys (``key``).  ``kind`` is ``job``,
    ``transformation`` or ``production`` (a production must be a ``Workflow``).
    Returns the rows with ``errors`` and ``valid``.
    """
    t = tasks.withColumn("_plugin", F.coalesce(F.col("hook_plugin"), F.lit("QueryBasedPlugin")))
    t = unknown_key(t, registry_keys, "_plugin")
    bad_sched = unexpected_keys(F.coalesce(F.col("scheduling"), F.create_map().cast("map<string,string>")),
                                SCHEDULING_KEYS)
    gs = F.coalesce(F.col("group_size"), F.create_map().cast("map<string,string>"))
    bad_sizes = F.filter(F.map_entries(gs), lambda e: e["value"].try_cast("int").isNull())
    rules = [
        (~F.col("task_class").isin(TASK_CLASSES),
         F.concat(F.lit("task is not a CommandLineTool, Workflow or ExpressionTool: "),
                  F.coalesce(F.col("task_class"), F.lit("null")))),
        (F.col("_unknown__plugin"),
         F.concat(F.lit("Unknown execution hooks plugin: "), F.col("_plugin"))),
        (F.size(bad_sched) > 0, F.concat(F.lit("unknown scheduling keys: "), F.array_join(bad_sched, ", "))),
        (F.size(bad_sizes) > 0, F.concat(F.lit("group_size is not an integer for: "),
                                         F.array_join(F.transform(bad_sizes, lambda e: e["key"]), ", "))),
    ]
    if kind == "production":
        rules.append((F.col("task_class") != "Workflow", F.lit("a production must be a Workflow")))
    return check(t, rules).drop("_plugin", "_unknown__plugin")
