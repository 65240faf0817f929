"""SimHash near-duplicates, linked by a grid join over segment bit counts.

A 64-bit fingerprint is cut into 32 two-bit segments, and its embedding is the vector of their bit
counts, kept in unary in one long (``embed``).  The Manhattan distance of two embeddings is the
number of bits in which those longs differ, and never exceeds the fingerprints' bit distance.

The grid has cells of side one over six groups of axes.  Within distance d <= 3 at least three of
the six groups agree, so every close pair shares a cell in one of the 20 projections onto three
groups.  Each pair is taken in the first projection it shares, must be within d by Manhattan
distance, then by exact bit distance; all three tests are part of the join condition, so pairs
that fail are never rows.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gridweave.llm.common import materialize
from gridweave.llm.components import connected_components

_SEED = 42
_ODD = 0x5555555555555555
#: Shingles hashed before their bits are added up; bounds memory for very long texts.
_BLOCK = 1 << 16
GROUPS, MAX_DISTANCE = 6, 3


def _signed(x: int) -> int:
    return x - (1 << 64) if x >= 1 << 63 else x


def _group_masks() -> list[int]:
    """Bits of each group of neighbouring segments (6, 6, 5, 5, 5, 5 segments of two bits)."""
    edges = np.linspace(32, 0, GROUPS + 1).round().astype(int)[::-1]
    return [sum(3 << (2 * s) for s in range(a, b)) for a, b in zip(edges[:-1], edges[1:], strict=True)]


def fingerprint(text: bytes | None, shingle: int = 3) -> int:
    """SimHash of a text: ASCII lower case, words between ASCII white space, word shingles."""
    import xxhash

    words = text.lower().split() if text else []
    if not words:
        return 0
    joined = b" ".join(words)
    size = np.fromiter(map(len, words), np.int64, len(words))
    stop = (size + 1).cumsum() - 1
    start = stop - size
    k = min(shingle, len(words))
    a, b = start[: len(words) - k + 1].tolist(), stop[k - 1:].tolist()
    digest, ones = xxhash.xxh64_intdigest, np.zeros(64, np.int64)
    for at in range(0, len(a), _BLOCK):
        h = np.array([digest(joined[i:j], _SEED) for i, j in zip(a[at:at + _BLOCK], b[at:at + _BLOCK], strict=True)],
                     dtype="<u8")
        bits = np.unpackbits(h.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
        ones += bits.sum(axis=0, dtype=np.int64)
    return int(sum(1 << i for i in np.flatnonzero(2 * ones > len(a)).tolist()))


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = 3) -> DataFrame:
    """(doc_id, fp): the fingerprint as a signed long, one row per input row; null text is empty (zero)."""
    src = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("binary").alias("text"))

    def run(batches: Iterator) -> Iterator:
        import pyarrow as pa

        for batch in batches:
            fps = [_signed(fingerprint(t.as_py(), shingle)) for t in batch.column("text")]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(fps, pa.int64())], ["doc_id", "fp"])

    return src.mapInArrow(run, "doc_id long, fp long")


def embed(fp: Column) -> Column:
    """Per two-bit segment its bit count in unary: low bit if any is set, high bit if both are."""
    odd = F.lit(_ODD)
    half = F.shiftrightunsigned(fp, 1)
    return fp.bitwiseOR(half).bitwiseAND(odd).bitwiseOR(F.shiftleft(fp.bitwiseAND(half).bitwiseAND(odd), 1))


def close_pairs(points: DataFrame, max_distance: int = MAX_DISTANCE) -> DataFrame:
    """(a, b): node pairs whose fingerprints differ in 1 to ``max_distance`` bits, each pair once.

    ``points`` has one row (fp, node) per distinct fingerprint.  max_distance is at most 3.
    """
    if not 0 <= max_distance <= GROUPS - 3:
        raise ValueError("max_distance must be between 0 and 3")
    masks = [_signed(m) for m in _group_masks()]
    views = list(combinations(range(GROUPS), 3))
    cells = F.array(*[F.struct(F.lit(i).alias("view"), F.col("e").bitwiseAND(
        F.lit(masks[x] | masks[y] | masks[z])).alias("cell")) for i, (x, y, z) in enumerate(views)])
    placed = (points.withColumn("e", embed(F.col("fp"))).withColumn("c", F.explode(cells))
              .select("c.view", "c.cell", "fp", "e", "node"))
    x, y = placed.alias("x"), placed.alias("y")
    gap = F.col("x.e").bitwiseXOR(F.col("y.e"))
    first = F.lit(False)
    for i, view in enumerate(views):
        earlier = [g for g in range(view[-1]) if g not in view]
        here = F.col("x.view") == i
        for g in earlier:
            here = here & (gap.bitwiseAND(F.lit(masks[g])) != 0)
        first = first | here
    near = ((F.col("x.view") == F.col("y.view")) & (F.col("x.cell") == F.col("y.cell")) & (F.col("x.fp") < F.col("y.fp"))
            & (F.bit_count(gap) <= max_distance)
            & (F.bit_count(F.col("x.fp").bitwiseXOR(F.col("y.fp"))) <= max_distance) & first)
    return x.join(y, near).select(F.col("x.node").alias("a"), F.col("y.node").alias("b"))


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = 3,
                    max_distance: int = MAX_DISTANCE) -> DataFrame:
    """(doc_id, fp, component_id): one row per input row.

    ``component_id`` is the smallest id among all texts reachable by links of at most
    ``max_distance`` bits.  Equal fingerprints are one node, named by its smallest id, so a group
    of copies of any size is one row in the pair search.  Texts without a word, null ones too, have
    fingerprint zero and link like any other.  Repeated rows of an id link its texts; rows without
    an id take the component of their fingerprint (null if none of its rows has an id).
    """
    fps = materialize(fingerprints(docs, id_col, text_col, shingle), "fingerprints")
    points = materialize(fps.groupBy("fp").agg(F.min("doc_id").alias("node")), "points")
    links = close_pairs(points.where("node is not null"), max_distance)
    several = fps.groupBy("doc_id").agg(F.min("fp").alias("lo"), F.max("fp").alias("hi")).where("lo <> hi")
    same_id = (fps.join(several, "doc_id", "left_semi").join(points, "fp")
               .select(F.col("doc_id").alias("a"), F.col("node").alias("b")))
    groups = connected_components(links.unionByName(same_id))
    named = points.join(groups, "node", "left").select("fp", F.coalesce("component", "node").alias("component_id"))
    return fps.join(named, "fp", "left").select("doc_id", "fp", "component_id")


def _free_name(docs: DataFrame, name: str) -> str:
    """``name``, lengthened until ``docs`` has no such column."""
    taken = {c.lower() for c in docs.columns}
    while name in taken:
        name += "_"
    return name


def keep_first(docs: DataFrame, id_col: str = "doc_id", **options) -> DataFrame:
    """One row of ``docs`` per group, that of the smallest id, all columns as they were.

    Of repeated rows of that id the one whose JSON form is smallest stays.  Rows without an id stay only where
    no row of their group has one, and then one stays.  Columns of ``docs`` may have any other names.
    """
    id_name, row_name = _free_name(docs, "__id"), _free_name(docs, "__row")
    groups = materialize(near_duplicates(docs, id_col=id_col, **options), "simhash-groups")
    stay = groups.where(F.col("doc_id") == F.col("component_id")).groupBy("doc_id").agg(F.count("*").alias("n"))
    here = F.col(id_name) == docs[id_col]

    def rows_of(ids):
        return docs.join(ids.select(F.col("doc_id").alias(id_name)), here, "left_semi")

    if stay.where("n > 1").isEmpty():
        with_id = rows_of(stay)
    else:
        row = F.struct(*[F.col(f"`{c}`") for c in docs.columns])
        one = rows_of(stay.where("n > 1")).groupBy(id_col).agg(F.min_by(row, F.to_json(row)).alias(row_name))
        with_id = rows_of(stay.where("n = 1")).unionByName(one.select(f"{row_name}.*"))
    alone = groups.where("component_id is null").agg(F.count("*")).first()[0]
    if not alone:
        return with_id
    own = docs.where(F.col(id_col).isNull()).withColumn(row_name, F.monotonically_increasing_id())
    own = materialize(own, "rows-without-id")
    named = near_duplicates(own, id_col=row_name, **options)
    free = groups.where("component_id is null").select("fp").distinct()
    first = named.join(free, "fp", "left_semi").where("doc_id = component_id").select(F.col("doc_id").alias(row_name))
    return with_id.unionByName(own.join(first, row_name, "left_semi").drop(row_name))


def query(spark, sf_dir):
    """SimHash near-duplicates over all of ``documents``."""
    out = near_duplicates(spark.read.parquet(f"{sf_dir}/documents.parquet"))
    return out.select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")
