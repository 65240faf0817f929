"""Readers and writers."""

from gridweave.sources.catalog import (
    CATALOG_SCHEMA,
    catalog_from_lfns,
    empty_catalog,
    list_files,
    read_catalog,
    read_latest_catalog,
    write_catalog_snapshot,
)
from gridweave.sources.params import read_parameters
from gridweave.sources.points import read_points, uniform_points, write_points
from gridweave.sources.sinks import merge_text_outputs, write_with_fallback

__all__ = [
    "CATALOG_SCHEMA", "catalog_from_lfns", "empty_catalog", "list_files", "read_catalog",
    "read_latest_catalog", "write_catalog_snapshot",
    "read_parameters", "read_points", "uniform_points", "write_points",
    "merge_text_outputs", "write_with_fallback",
]
