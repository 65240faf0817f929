"""Joins that treat null keys as equal, and broadcasts bounded by measured bytes."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce
from operator import and_

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Largest side that is broadcast by hint, in bytes of its rows as JSON text.
BROADCAST_BYTES = 16_000_000


def null_safe_join(left: DataFrame, right: DataFrame, keys: Sequence[str], how: str = "inner") -> DataFrame:
    """``left.join(right, keys, how)`` where null matches null (still an equi join for the planner)."""
    mark = {k: f"_right_{k}" for k in keys}
    other = right.select(*[F.col(k).alias(mark[k]) for k in keys], *[c for c in right.columns if c not in mark])
    out = left.join(other, reduce(and_, [F.col(k).eqNullSafe(F.col(mark[k])) for k in keys]), how)
    if how in ("left_semi", "left_anti"):
        return out
    if how in ("full", "right"):
        out = out.select(*[F.coalesce(k, mark[k]).alias(k) if k in mark else F.col(k) for k in out.columns
                           if k not in mark.values()])
    return out.drop(*mark.values())


def broadcast_if_small(df: DataFrame, max_bytes: int = BROADCAST_BYTES) -> DataFrame:
    """``df`` with a broadcast hint when its rows measure at most ``max_bytes``; else as it is."""
    size = df.agg(F.sum(F.octet_length(F.to_json(F.struct("*"))))).first()[0]
    return F.broadcast(df) if (size or 0) <= max_bytes else df
