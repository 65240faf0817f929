"""A plugin registry as a table: registration with override, VO-first lookup, summaries."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gridweave.operators.catalog import add_entries


def register(entries: DataFrame, override: bool = False, key: str = "key", seq: str = "seq") -> DataFrame:
    """Outcome of registering ``entries`` in ``seq`` order: a key registered twice is rejected
    unless ``override`` (then the last registration wins)."""
    empty = entries.filter(F.lit(False))
    return add_entries(empty, entries, key=key, seq=seq, override=override, noun="Plugin")


def registry_tables(entries: DataFrame, override: bool = True, key: str = "key", vo: str = "vo",
                    seq: str = "seq") -> tuple[DataFrame, DataFrame]:
    """(global table, per-VO table) of the accepted registrations.

    The global table holds one row per key (any VO); the VO table one row per (vo, key) for
    accepted entries that name a VO.  Without ``override`` only a key's first registration is
    accepted, so a rejected one is in neither table.  With ``override`` every registration is
    accepted and the last one of each key, and of each (vo, key), stands.
    """
    outcome = register(entries, override=override, key=key, seq=seq)
    accepted = outcome.filter(F.col("status") == "added").drop("status", "message", "replaced")
    named = F.coalesce(F.col(vo), F.lit("")) != ""
    if not override:
        return accepted, accepted.filter(named)
    of_vo = entries.filter(named & F.col(key).isNotNull())
    last = of_vo.groupBy(vo, key).agg(F.max(seq).alias("_last"))
    return accepted, of_vo.join(last, [vo, key]).filter(F.col(seq) == F.col("_last")).drop("_last")


def lookup_with_fallback(wanted: DataFrame, global_table: DataFrame, vo_table: DataFrame,
                         payload: str = "description", key: str = "key", vo: str = "vo") -> DataFrame:
    """For every ``(key, vo)`` asked: the VO's entry if it has one, else the global entry, else null.

    Both registry tables are small (one row per plugin); the joins are left joins the adaptive
    planner turns into broadcasts from their measured size.
    """
    v = vo_table.select(F.col(vo).alias("_vo"), F.col(key).alias("_k"), F.col(payload).alias("_v_hit"),
                        F.lit(True).alias("_in_vo"))
    g = global_table.select(F.col(key).alias("_k2"), F.col(payload).alias("_g_hit"), F.lit(True).alias("_in_all"))
    j = wanted.join(v, (wanted[vo] == v["_vo"]) & (wanted[key] == v["_k"]), "left") \
              .join(g, wanted[key] == g["_k2"], "left")
    return (j.withColumn("found", F.when(F.col("_in_vo"), F.col("_v_hit")).otherwise(F.col("_g_hit")))
             .withColumn("scope", F.when(F.col("_in_vo"), F.lit("vo")).when(F.col("_in_all"), F.lit("global")))
             .drop("_vo", "_k", "_v_hit", "_in_vo", "_k2", "_g_hit", "_in_all"))


def registry_summary(global_table: DataFrame, vo_table: DataFrame, key: str = "key", vo: str = "vo") -> DataFrame:
    """(vo, n_plugins): one row per VO that has plugins, and one with null for all plugins."""
    per_vo = vo_table.groupBy(vo).agg(F.countDistinct(key).alias("n_plugins"))
    everything = global_table.agg(F.countDistinct(key).alias("n_plugins"))
    return per_vo.unionByName(everything.select(F.lit(None).cast("string").alias(vo), "n_plugins"))


def list_organizations(vo_table: DataFrame, vo: str = "vo") -> DataFrame:
    """The VOs that have plugins."""
    return vo_table.select(vo).distinct()


def list_plugins(global_table: DataFrame, vo_table: DataFrame, vo_name: str | None = None,
                 key: str = "key", vo: str = "vo") -> DataFrame:
    """Keys of one VO; an unknown or absent VO lists all keys."""
    mine = vo_table.filter(F.col(vo) == vo_name) if vo_name else None
    if mine is None or mine.isEmpty():
        return global_table.select(key)
    return mine.select(key)
