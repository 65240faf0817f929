"""Logical file name (LFN) expressions: normal form, catalog location, query paths, target names."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from gridweave.functions._cols import as_col, lit_or_col

# Prefixes of catalog references, default query root.
LFN_PREFIX = "lfn:"
LFN_PREFIX_UPPER = "LFN:"
DEFAULT_QUERY_ROOT = "/grid/data"


def normalize_lfn(col: Column | str) -> Column:
    """Remove, once each and in this order, a leading ``lfn:``, ``LFN:`` and ``/``."""
    return F.regexp_replace(as_col(col), r"^(?:lfn:)?(?:LFN:)?/?", "")


def lfn_location(col: Column | str) -> Column:
    """Catalog reference of a path: always ``lfn:/<path without leading slashes>``."""
    return F.concat(F.lit(LFN_PREFIX + "/"), F.regexp_replace(normalize_lfn(col), r"^/+", ""))


def lfn_upper(col: Column | str) -> Column:
    """Replace the first ``lfn:`` by ``LFN:`` (the form used in submission text)."""
    c = as_col(col)
    pos = F.instr(c, LFN_PREFIX)
    return F.when(pos > 0, F.overlay(c, F.lit(LFN_PREFIX_UPPER), pos)).otherwise(c)


def clean_path(col: Column | str) -> Column:
    """Path clean-up as ``pathlib`` does it: drop ``.`` parts, collapse ``//``, no trailing ``/``."""
    c = F.regexp_replace(as_col(col), r"(^|/)(\./|\.$)+", "$1")
    c = F.regexp_replace(c, r"/{2,}", "/")
    return F.when(c == "/", c).otherwise(F.regexp_replace(c, r"(.)/$", "$1"))


def input_query(root=None, vo=None, campaign=None, site=None, data_type=None,
                input_name=None) -> Column:
    """Query path ``root/vo/campaign/site/data_type/input_name``; empty or null parts skipped.

    Arguments are Columns or Python values.  ``root`` defaults to ``/grid/data``.  Leading slashes
    of the inner parts are stripped (a part never resets the path to the file system root).
    """
    root_c = F.coalesce(F.nullif(lit_or_col(root), F.lit("")), F.lit(DEFAULT_QUERY_ROOT))

    def part(p) -> Column:
        c = F.nullif(lit_or_col(p).cast("string"), F.lit(""))
        return F.regexp_replace(c, r"^/+", "")

    joined = F.concat_ws("/", root_c, part(vo), part(campaign), part(site), part(data_type),
                         part(input_name))
    return clean_path(joined)


def target_name(lfn: Column | str, src: Column | str) -> Column:
    """Catalog name of an uploaded file: ``<lfn>/<basename of src>``."""
    base = F.regexp_replace(as_col(lfn), r"(.)/+$", "$1")
    return F.concat_ws("/", base, F.substring_index(as_col(src), "/", -1))
