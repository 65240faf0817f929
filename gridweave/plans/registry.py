"""All registered queries: name -> (spark callable, DuckDB SQL or None)."""

from __future__ import annotations

from gridweave.plans import (
    catalog_queries,
    flow_queries,
    job_queries,
    output_queries,
    registry_queries,
    stream_queries,
    text_queries,
)

_MODULES = [text_queries, catalog_queries, job_queries, output_queries, registry_queries, flow_queries, stream_queries]


def _all():
    out = {}
    for m in _MODULES:
        for name, entry in m.QUERIES.items():
            if name in out:
                raise ValueError(f"duplicate query {name}")
            out[name] = entry
    return out


def queries():
    return {name: fn for name, (fn, _) in _all().items()}


def oracle_sql():
    return {name: sql for name, (_, sql) in _all().items() if sql}
