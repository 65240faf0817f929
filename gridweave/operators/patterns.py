"""Directory queries with wildcards, taken from a table (P4 for many patterns).

A wildcard stays inside one part of a path, so a pattern can only match directories of its own depth
that agree with it in every part without wildcards, and in the text before the first and after the
last wildcard of the others.  That is an equi join: patterns and directories meet on (depth, which
parts are literal, lengths of those texts, the texts), and only what meets is tested with the
pattern's regular expression.  The directories are the distinct ones of the catalog, taken once for
every such shape of a pattern; its entries are joined to the matches on ``dir``.  Text between two
wildcards (``*x*``) is in no key: such patterns meet every directory that the rest of them allows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gridweave.operators._joins import broadcast_if_small
from gridweave.operators.catalog import _not_hidden, no_clash, query_key

#: Fixed: one piece of a pattern part, a closed class or a single character (as the shell reads it).
_PIECE = r"(\[!?+[\s\S][^\]]*\]|[\s\S])"
_WILD = r"[*?\[]"
#: Fixed: line ends, before which the ``$`` of a regular expression also matches; no key has them last.
_LINE_ENDS = "\n\r\u0085\u2028\u2029"


def _class_regex(piece: Column) -> Column:
    """``[...]`` as a regular expression; a range that runs backwards matches nothing."""
    body = F.substring(piece, F.lit(2), F.length(piece) - 2)
    backwards = F.exists(F.regexp_extract_all(body, F.lit(r"([\s\S]-[\s\S])")),
                         lambda r: F.ascii(r) > F.ascii(F.substring(r, 3, 1)))
    for plain, quoted in (("\\", "\\\\"), ("[", "\\["), ("&&", "&\\&"), ("^", "\\^"), ("]", "\\]")):
        body = F.replace(body, F.lit(plain), F.lit(quoted))
    body = F.when(F.startswith(body, F.lit("!")), F.concat(F.lit("^"), F.substring(body, F.lit(2), F.length(body)))).otherwise(body)
    return F.when(backwards, F.lit("(?!)")).otherwise(F.concat(F.lit("(?!/)["), body, F.lit("]")))


def _part_regex(part: Column) -> Column:
    """One part of a pattern; its wildcards do not match a leading dot or ``/``."""
    def piece(p):
        quoted = p.rlike(r"^[\x00-\x7F]$") & ~p.rlike("^[A-Za-z0-9]$")
        return (F.when(p == "*", F.lit("[^/]*")).when(p == "?", F.lit("[^/]")).when(F.length(p) > 1, _class_regex(p))
                .when(quoted, F.concat(F.lit("\\"), p)).otherwise(p))

    body = F.array_join(F.transform(F.regexp_extract_all(part, F.lit(_PIECE)), piece), "")
    return F.concat(F.when(part.rlike("^" + _WILD), F.lit("(?!\\.)")).otherwise(F.lit("")), body)


def pattern_regex(pattern: str | Column) -> Column:
    """The regular expression of a glob directory pattern, as a column expression."""
    parts = F.split(F.col(pattern) if isinstance(pattern, str) else pattern, "/")
    return F.concat(F.lit("^"), F.array_join(F.transform(parts, _part_regex), "/"), F.lit("$"))


def _head(part: Column) -> Column:
    """The text before the first wildcard of a pattern part."""
    return F.regexp_extract(part, r"^[^*?\[]*", 0)


def _without_line_end(part: Column) -> Column:
    return F.rtrim(part, F.lit(_LINE_ENDS))


def _tail(part: Column) -> Column:
    """The text after the last wildcard of a pattern part."""
    return _without_line_end(F.regexp_extract(part, r"[^*?\[\]]*\z", 0))


def _fixed_text(head: Column, tail: Column) -> Column:
    return F.concat(head, F.lit("/"), tail)


def candidates(dirs: DataFrame, patterns: DataFrame, pattern_col: str = "pattern", dir_col: str = "dir") -> DataFrame:
    """Rows of ``patterns`` with every directory (``_dir``) that has the pattern's fixed texts in their places,
    and the pattern's regular expression (``_regex``, null without wildcards) that is still to be tested."""
    key = query_key(pattern_col)
    asked = patterns.withColumn("_parts", F.split(key, "/")).where(F.col("_parts").isNotNull())
    wild = F.exists("_parts", lambda p: p.rlike(_WILD))

    def per_part(wanted, literal):
        return F.transform("_parts", lambda p: F.when(p.rlike(_WILD), wanted(p)).otherwise(literal(p)))

    asked = asked.select(*patterns.columns, F.size("_parts").alias("_depth"),
                         per_part(lambda p: F.length(_head(p)), lambda p: F.lit(-1)).alias("_heads"),
                         per_part(lambda p: F.length(_tail(p)), lambda p: F.lit(-1)).alias("_tails"),
                         F.array_join(per_part(lambda p: _fixed_text(_head(p), _tail(p)), lambda p: p), "/").alias("_fixed"),
                         F.when(wild, pattern_regex(key)).alias("_regex"))
    shapes = asked.select("_depth", "_heads", "_tails").distinct()
    own = dirs.select(F.col(dir_col).alias("_dir"), F.split(dir_col, "/").alias("_own"))

    def fixed(part, i):
        head, tail = F.get("_heads", i), F.get("_tails", i)
        cut = _fixed_text(F.substring(part, F.lit(1), head), F.right(_without_line_end(part), tail))
        return F.when(head < 0, part).otherwise(cut)

    own = (own.withColumn("_depth", F.size("_own")).join(broadcast_if_small(shapes), "_depth")
           .select("_dir", "_depth", "_heads", "_tails", F.array_join(F.transform("_own", fixed), "/").alias("_fixed")))
    return asked.join(own, ["_depth", "_heads", "_tails", "_fixed"])


def match_directories(dirs: DataFrame, patterns: DataFrame, pattern_col: str = "pattern", dir_col: str = "dir") -> DataFrame:
    """Rows of ``patterns`` with every directory of ``dirs`` (distinct) that they match, as ``dir_col``.

    A null pattern matches nothing; a pattern without wildcards is the directory itself.
    """
    no_clash(patterns, [dir_col])
    met = candidates(dirs, patterns, pattern_col, dir_col)
    return (met.where(F.col("_regex").isNull() | F.expr("_dir rlike _regex"))
            .select(*patterns.columns, F.col("_dir").alias(dir_col)))


def match_pattern_table(catalog: DataFrame, patterns: DataFrame, pattern_col: str = "pattern") -> DataFrame:
    """Catalog entries directly below the directories that each row of ``patterns`` asks for.

    Hidden names are left out, a row or pattern given twice gives its entries twice.  Returns the
    catalog's columns and those of ``patterns``; equal names are refused.  The matches (one row per
    pattern and directory) are broadcast if their measured bytes allow it, otherwise the planner
    joins by a shuffle, in which adaptive execution can split a directory with very many entries.
    """
    no_clash(patterns, catalog.columns)
    cat = catalog.filter(_not_hidden())
    dirs = cat.select(F.col("dir").alias("_asked_dir")).distinct()
    asked = match_directories(dirs, patterns, pattern_col, "_asked_dir")
    hit = broadcast_if_small(asked)
    return cat.join(hit, cat["dir"] == hit["_asked_dir"]).select(*[cat[c] for c in catalog.columns], *patterns.columns)
