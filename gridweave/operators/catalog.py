"""Catalog operators: directory queries, lookups, insert-if-absent, upsert."""

from __future__ import annotations

import re
from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gridweave.operators._joins import broadcast_if_small
from gridweave.sources.catalog import canonical_lfn

# Status words and messages of catalog operations.
FOUND = "Successful"
NOT_FOUND = "Failed"
ADDED = "added"
REJECTED = "rejected"


def _not_hidden(name_col: str = "name"):
    return ~F.col(name_col).startswith(".")


def no_clash(df: DataFrame, taken: Sequence[str]) -> None:
    """Refuse a frame that has columns of the names an operator returns itself."""
    clash = sorted({c.lower() for c in df.columns} & {c.lower() for c in taken})
    if clash:
        raise ValueError(f"columns {', '.join(clash)} are also columns of the result: rename them")


def query_key(col) -> F.Column:
    """Directory key of a query path: canonical absolute form, no trailing slash."""
    return F.regexp_replace(canonical_lfn(col), r"(.)/+$", "$1")


def match_query(catalog: DataFrame, queries: DataFrame, query_col: str = "query",
                broadcast_queries: bool | None = None) -> DataFrame:
    """Catalog entries directly below each query path (hidden names excluded).

    ``queries`` may hold any other columns (task id, input name, ...); a path asked for twice gives
    its entries twice, as a concatenated list of query results does.  The match is an equality
    join on the stored ``dir`` column.  The query table (one row per task input) is broadcast
    when its measured bytes allow it (``broadcast_queries=None``), so the catalog is scanned once
    and never shuffled for the match; beyond that the planner picks a shuffle join.  A column that
    both frames have is refused.
    """
    no_clash(queries, catalog.columns)
    q = queries.withColumn("_qdir", query_key(query_col))
    if broadcast_queries is None:
        q = broadcast_if_small(q)
    elif broadcast_queries:
        q = F.broadcast(q)
    cat = catalog.filter(_not_hidden())
    return cat.join(q, cat["dir"] == q["_qdir"], "inner").drop("_qdir")


def has_hot_match(catalog: DataFrame, queries: DataFrame, threshold: int, query_col: str = "query") -> bool:
    """Whether some queried directory holds more than ``threshold`` entries.

    The catalog's row count bounds every directory; only when it exceeds the threshold are the
    directories counted (:func:`largest_match`).
    """
    if catalog.count() <= threshold:
        return False
    return largest_match(catalog, queries, query_col) > threshold


def largest_match(catalog: DataFrame, queries: DataFrame, query_col: str = "query") -> int:
    """Most catalog entries below any one queried directory (visible names only).

    Sizes the groups of a directory match from the narrowest data there is: only the ``dir`` and
    ``name`` columns are read, semi-joined to the (counted, broadcast) query directories and
    counted per directory - no join output, nothing written.
    """
    dirs = broadcast_if_small(queries.select(query_key(query_col).alias("dir")).distinct())
    hits = catalog.filter(_not_hidden()).select("dir").join(dirs, "dir", "left_semi")
    row = hits.groupBy("dir").count().agg(F.max("count").alias("m")).first()
    return int(row["m"] or 0)


def glob_to_regex(pattern: str) -> str:
    """Regex of a glob directory pattern (``*``, ``?``, ``[...]``), as the shell matches names.

    Wildcards stay inside one part of the path and do not match a part's leading dot; a class
    never matches ``/``.
    """
    return "^" + "/".join(_part_regex(part) for part in pattern.split("/")) + "$"


def _part_regex(part: str) -> str:
    out = ["(?!\\.)"] if part[:1] in ("*", "?", "[") else []
    i = 0
    while i < len(part):
        c = part[i]
        close = part.find("]", i + (3 if part[i + 1:i + 2] == "!" else 2)) if c == "[" else -1
        if c == "*":
            out.append("[^/]*")
        elif c == "?":
            out.append("[^/]")
        elif close > 0:
            body = part[i + 1:close].replace("\\", "\\\\").replace("[", "\\[").replace("&&", "&\\&").replace("^", "\\^")
            body = "^" + body[1:] if body.startswith("!") else body
            out.append("(?!/)[" + body.replace("]", "\\]") + "]")
            i = close
        else:
            out.append(re.escape(c))
        i += 1
    return "".join(out)


def _query_dir(path: str) -> str:
    """Directory key of a literal query path (the rule of :func:`query_key`)."""
    key = re.sub(r"^(?:lfn:)?(?:LFN:)?/*", "/", path, count=1)
    return re.sub(r"(.)/+$", r"\1", key)


def match_patterns(catalog: DataFrame, patterns: Sequence[str]) -> DataFrame:
    """Entries below each of a list of query paths; glob characters allowed; duplicates kept.

    One scan for the whole list (a literal in the plan): an entry appears once for every query it
    matches, with ``query_pos``, the query's position, and ``query``.  Without glob paths the
    directories also become an ``IN`` filter that is pushed to the scan.
    """
    if not patterns:
        raise ValueError("no query given")
    hits, plain = [], True
    for i, p in enumerate(patterns):
        d = _query_dir(p)
        globbed = re.search(r"[*?\[]", d) is not None
        plain = plain and not globbed
        hit = F.col("dir").rlike(glob_to_regex(d)) if globbed else F.col("dir") == d
        hits.append(F.when(hit, F.struct(F.lit(i).alias("query_pos"), F.lit(p).alias("query"))))
    cat = catalog.filter(_not_hidden())
    if plain:
        cat = cat.filter(F.col("dir").isin([_query_dir(p) for p in patterns]))
    cat = cat.withColumn("_hit", F.explode(F.array_compact(F.array(*hits))))
    return cat.select(*catalog.columns, "_hit.query_pos", "_hit.query")


def find_files(catalog: DataFrame, wanted: DataFrame, lfn_col: str = "lfn",
               prefilter: bool = False) -> DataFrame:
    """Look every wanted LFN up in the catalog.

    ``prefilter=True`` suits a small batch against a huge catalog: the catalog is first reduced to
    the asked-for keys by a semi join (the key set broadcast when small), so it is never shuffled
    as a whole.  For a batch of the catalog's own size the plain join is cheaper.

    Returns the wanted rows plus ``status`` (``Successful``/``Failed``), ``message``
    (``File <lfn> not found``, or ``File without a name``) and the catalog's ``creation_date`` and
    ``metadata`` (as ``cat_...``) when found.  Wanted rows that have such columns are refused.
    """
    no_clash(wanted, ["status", "message", "cat_creation_date", "cat_metadata"])
    w = wanted.withColumn("_key", canonical_lfn(lfn_col))
    c = catalog.select(F.col("lfn").alias("_key"), F.lit(True).alias("_hit"),
                       F.col("creation_date").alias("cat_creation_date"),
                       F.col("metadata").alias("cat_metadata"))
    if prefilter:
        # small batch, huge catalog: keep only the entries asked for (semi join against the
        # distinct wanted keys, broadcast when small) so the catalog is filtered in its scan
        c = c.join(w.select("_key").distinct(), "_key", "left_semi")
    j = w.join(c, "_key", "left")
    hit = F.coalesce(F.col("_hit"), F.lit(False))
    return (j.withColumn("status", F.when(hit, F.lit(FOUND)).otherwise(F.lit(NOT_FOUND)))
             .withColumn("message", F.when(hit, F.lit(None).cast("string"))
                         .when(F.col(lfn_col).isNull(), F.lit("File without a name"))
                         .otherwise(F.concat(F.lit("File "), F.col(lfn_col), F.lit(" not found"))))
             .drop("_key", "_hit"))


def add_entries(catalog: DataFrame, new: DataFrame, key: str = "lfn", seq: str = "seq",
                override: bool = False, noun: str = "File", prefilter: bool = False) -> DataFrame:
    """Insert-if-absent: outcome of every new row.

    A row without a key is ``rejected`` with a message.  Without ``override`` a row is ``rejected`` (``File <key> already exists``) when the key is in
    the catalog or an earlier row of the batch (smaller ``seq``) has it.  With ``override`` the
    last row of the batch per key is ``added`` (it replaces a catalog entry) and earlier rows are
    ``rejected`` as superseded.  ``seq`` is unique per key; a number (long or decimal) keeps its
    minimum a hash aggregate.  First/last rows come from an aggregation joined back, so a key
    repeated very often is split by the join (adaptive skew handling) rather than ranked in one
    task.  ``prefilter=True`` semi-joins the catalog to the batch's keys first (small batch,
    huge catalog), as in :func:`find_files`.  New rows that have a column ``status``, ``replaced``
    or ``message`` are refused.
    """
    no_clash(new, ["status", "replaced", "message"])
    pick = F.max(seq) if override else F.min(seq)
    chosen = new.groupBy(key).agg(pick.alias("_chosen"))
    existing = catalog.select(F.col(key).alias(key))
    if prefilter:
        # small batch, huge catalog: only the catalog keys of this batch (semi join, the batch's
        # key set broadcast when small), so the catalog is filtered in its scan, not shuffled
        existing = existing.join(new.select(key).distinct(), key, "left_semi")
    existing = existing.distinct().withColumn("_exists", F.lit(True))
    j = new.join(chosen, key, "left").join(existing, key, "left")
    exists = F.coalesce(F.col("_exists"), F.lit(False))
    is_chosen = F.col(seq) == F.col("_chosen")
    ok = F.coalesce(is_chosen if override else (is_chosen & ~exists), F.lit(False))
    why = " superseded in batch" if override else " already exists"
    msg = (F.when(ok, F.lit(None).cast("string")).when(F.col(key).isNull(), F.lit(noun + " without a name"))
            .otherwise(F.concat(F.lit(noun + " "), F.col(key).cast("string"), F.lit(why))))
    return (j.withColumn("status", F.when(ok, F.lit(ADDED)).otherwise(F.lit(REJECTED)))
             .withColumn("replaced", ok & exists)
             .withColumn("message", msg)
             .drop("_chosen", "_exists"))


def apply_additions(catalog: DataFrame, outcome: DataFrame, key: str = "lfn") -> DataFrame:
    """The catalog after :func:`add_entries` (added rows replace catalog rows with their key)."""
    added = outcome.filter(F.col("status") == ADDED).select(*catalog.columns)
    return catalog.join(added.select(key), key, "left_anti").unionByName(added)


def upsert_metadata(catalog: DataFrame, updates: DataFrame, key: str = "lfn",
                    seq: str = "seq") -> DataFrame:
    """Replace the whole entry of every updated key (insert when absent); last update wins.

    ``updates`` must hold the catalog columns plus ``seq``; an update without a key is not applied.
    The latest update per key is a ``max_by`` aggregation (partial, map-side), the untouched
    entries a left anti join.  ``max_by`` of an entry sorts (SortAggregate); a hash-aggregated
    maximum joined back was measured at twice the time, as it reads and shuffles the updates twice.
    """
    cols = [c for c in catalog.columns]
    latest = (updates.filter(F.col(key).isNotNull()).groupBy(key)
                     .agg(F.max_by(F.struct(*[F.col(c) for c in cols if c != key]), F.col(seq)).alias("_v"))
                     .select(key, *[F.col("_v")[c].alias(c) for c in cols if c != key]))
    kept = catalog.join(latest.select(key), key, "left_anti")
    return kept.unionByName(latest.select(*cols))
