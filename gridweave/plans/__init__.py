"""Registered queries over the driver tables (``queries``) and their SQL oracles (``oracle_sql``)."""

from gridweave.plans.registry import oracle_sql, queries

__all__ = ["queries", "oracle_sql"]
