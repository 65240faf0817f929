"""Embedding near-duplicates by cross-polytope hashing.

Every distinct vector is turned by three sign-and-Hadamard rotations per hash; a hash is the
largest coordinate with its sign, and K hashes make the bucket of one table.  Besides its own
bucket a vector probes the next best ones.  Two vectors meet in a bucket that is the own bucket of
at least one of them; a pair is compared in the first bucket where it meets and nowhere else, by
cosine in double precision.

Nothing grows with the square of a group in any task's output: equal vectors are one row with a
count, a bucket of more than CELL rows is dealt out as pairs of parts, and a compared cell returns
a link count per row and a spanning forest of its links, not the links.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from gridweave.llm.common import materialize
from gridweave.llm.components import connected_components

#: Tables: this many for every doubling of the vectors' width, and at least so many (README: recall at the threshold).
TABLES_PER_DOUBLING, MIN_TABLES = 2, 8
HASHES, PROBES = 3, 2
#: Rows of a part of a bucket; larger buckets are compared part by part.
CELL = 1000
#: Pairs of small cells compared at once in a task.
_PAIRS = 200_000


def hadamard(x: np.ndarray) -> np.ndarray:
    """Fast Walsh-Hadamard transform of each row (length a power of two), scaled to keep norms."""
    n, h = x.shape[1], 1
    while h < n:
        z = x.reshape(len(x), n // (2 * h), 2, h)
        x = np.concatenate([z[:, :, :1] + z[:, :, 1:], z[:, :, :1] - z[:, :, 1:]], axis=2).reshape(len(x), n)
        h *= 2
    return x / np.sqrt(n)


def tables_for(width: int) -> int:
    """Tables that find about 99.9 % of the pairs at cosine 0.95."""
    return max(MIN_TABLES, TABLES_PER_DOUBLING * (width - 1).bit_length())


def codes(x: np.ndarray, tables: int | None = None, hashes: int = HASHES, probes: int = PROBES, seed: int = 7) -> np.ndarray:
    """Bucket numbers (rows, tables, 1 + probes): the own bucket, then the nearest other ones.

    The rotations depend on ``seed`` and the width alone, so all tasks use the same.
    """
    tables = tables or tables_for(x.shape[1])
    width = 1 << max(1, (x.shape[1] - 1).bit_length())
    padded = np.zeros((len(x), width))
    padded[:, :x.shape[1]] = x
    rng = np.random.default_rng([seed, width])
    out = np.empty((len(x), tables, 1 + probes), np.int64)
    scale = (2 * width) ** np.arange(hashes)
    flips = [s for r in range(1, hashes + 1) for s in combinations(range(hashes), r)]
    for t in range(tables):
        best, other, gap = [], [], []
        for _ in range(hashes):
            y = padded
            for _ in range(3):
                y = hadamard(y * rng.choice([-1.0, 1.0], width))
            size = np.abs(y)
            top = np.argpartition(-size, 1, axis=1)[:, :2]
            high = np.take_along_axis(size, top, 1)
            swap = high[:, 0] < high[:, 1]
            top[swap], high[swap] = top[swap][:, ::-1], high[swap][:, ::-1]
            side = 2 * top + (np.take_along_axis(y, top, 1) < 0)
            best.append(side[:, 0])
            other.append(side[:, 1])
            gap.append(high[:, 0] - high[:, 1])
        best, step, gap = np.stack(best, 1), np.stack(other, 1) - np.stack(best, 1), np.stack(gap, 1)
        out[:, t, 0] = best @ scale
        if probes:
            cost = np.stack([gap[:, list(s)].sum(1) for s in flips], 1)
            near = np.argsort(cost, axis=1, kind="stable")[:, :probes]
            to = np.stack([out[:, t, 0] + (step[:, list(s)] * scale[list(s)]).sum(1) for s in flips], 1)
            out[:, t, 1:] = np.take_along_axis(to, near, 1)
    return out


def _first_meeting(ci: np.ndarray, cj: np.ndarray, table: int, code: int | np.ndarray) -> np.ndarray:
    """Whether this table and bucket are the first where the rows of ``ci`` and ``cj`` meet.

    ``ci`` and ``cj`` are code arrays broadcast against each other, (..., tables, 1 + probes).
    """
    never = np.iinfo(np.int64).max
    first = None
    for t in range(table + 1):
        own_i, own_j = ci[..., t, 0], cj[..., t, 0]
        at = np.where(own_i == own_j, own_i, never)
        for p in range(1, ci.shape[-1]):
            at = np.minimum(at, np.where(ci[..., t, p] == own_j, own_j, never))
            at = np.minimum(at, np.where(cj[..., t, p] == own_i, own_i, never))
        if t < table:
            first = (at == never) if first is None else first & (at == never)
        else:
            here = at == code
    return here if first is None else first & here


def _compare_large(x, c, part, weight, table, code, a, b, threshold):
    """(weight linked to each row, smallest row linked to it directly or not) in one cell, by blocks."""
    n = len(x)
    adjacent = np.zeros((n, n), bool)
    for lo in range(0, n, 256):
        hi = min(n, lo + 256)
        near = (x[lo:hi] @ x.T) >= threshold
        if a != b:
            near &= part[lo:hi, None] != part[None, :]
        near[np.arange(hi - lo), np.arange(lo, hi)] = False
        i, j = np.nonzero(near)
        for k in range(0, len(i), _PAIRS):
            own, oth = i[k:k + _PAIRS], j[k:k + _PAIRS]
            ok = _first_meeting(c[lo + own], c[oth], table, code)
            adjacent[lo + own[ok], oth[ok]] = True
    label = np.arange(n)
    while True:
        low = np.minimum(label, np.where(adjacent, label[None, :], n).min(axis=1, initial=n))
        low = low[low]
        if (low == label).all():
            break
        label = low
    return adjacent @ weight, label


class _Cells:
    """Compares the rows of whole cells: large ones alone, small ones of one size together."""

    def __init__(self, threshold: float):
        self.threshold = threshold

    def compare(self, rows: dict, bounds: np.ndarray):
        """(ids, counts, edges a, edges b) of consecutive cells given by ``bounds``."""
        size = np.diff(bounds)
        ids, counts, ea, eb = [], [], [], []
        x, c, w, node = rows["x"], rows["codes"], rows["weight"], rows["node"]
        for k in np.flatnonzero(size > 64):
            s = slice(bounds[k], bounds[k + 1])
            i = bounds[k]
            n, mate = _compare_large(x[s], c[s], rows["part"][s], w[s], int(rows["view"][i]), int(rows["code"][i]),
                                     int(rows["a"][i]), int(rows["b"][i]), self.threshold)
            ids.append(node[s])
            counts.append(n)
            linked = mate != np.arange(len(mate))
            ea.append(node[s][linked])
            eb.append(node[s][mate[linked]])
        small = (size > 1) & (size <= 64)
        start, size = bounds[:-1][small], size[small]
        order = np.argsort(size, kind="stable")
        for n in np.unique(size):
            own = start[order[np.searchsorted(size[order], n):np.searchsorted(size[order], n, "right")]]
            p, q = np.triu_indices(n, 1)
            step = max(1, _PAIRS // len(p))
            for k in range(0, len(own), step):
                i, j = (own[k:k + step, None] + p).ravel(), (own[k:k + step, None] + q).ravel()
                if (rows["a"] != rows["b"]).any():
                    keep = (rows["a"][i] == rows["b"][i]) | (rows["part"][i] != rows["part"][j])
                    i, j = i[keep], j[keep]
                near = np.einsum("ij,ij->i", x[i], x[j]) >= self.threshold
                i, j = i[near], j[near]
                for t in np.unique(rows["view"][i]):
                    at = rows["view"][i] == t
                    ii, jj = i[at], j[at]
                    ok = _first_meeting(c[ii], c[jj], int(t), rows["code"][ii])
                    ii, jj = ii[ok], jj[ok]
                    ids += [node[ii], node[jj]]
                    counts += [w[jj], w[ii]]
                    ea.append(node[ii])
                    eb.append(node[jj])
        empty = np.empty(0, np.int64)
        return tuple(np.concatenate([empty, *v]).astype(np.int64) for v in (ids, counts, ea, eb))


def linked_vectors(vectors: DataFrame, id_col: str = "vec_id", vec_col: str = "embedding", threshold: float = 0.95,
                   tables: int | None = None, hashes: int = HASHES, probes: int = PROBES, cell: int = CELL) -> DataFrame:
    """(vec_id, n_links, component_id, kept): one row per input row.

    Rows link at cosine >= ``threshold``; ``n_links`` counts the other rows linked directly, equal
    vectors too, and ``component_id`` is the smallest id reachable.  A vector that is null, zero or
    empty, or holds a null or non-finite component links with nothing.  Vectors of different
    lengths never link.  Rows without an id count as links but name no component.  Recall against
    brute force is measured in the tests; no link found is below the threshold.
    """
    kind = vectors.schema[vec_col].dataType
    single = isinstance(kind, T.ArrayType) and isinstance(kind.elementType, T.FloatType)
    v = vectors.select(F.col(id_col).cast("long").alias("vec_id"), F.col(vec_col).alias("v"))
    sound = (F.size("v") > 0) & F.forall("v", lambda e: e.isNotNull() & ~F.isnan(e) & (F.abs(e) < float("inf"))) & F.exists(
        "v", lambda e: e != 0)
    v = materialize(v.withColumn("v", F.when(sound, F.col("v"))), "vectors")
    classes = materialize(v.where("v is not null").groupBy("v").agg(F.min("vec_id").alias("low"), F.count("*").alias("weight"))
                          .withColumn("node", F.monotonically_increasing_id()), "vector-classes")
    entries = _entries(classes, tables, hashes, probes, single)
    entries = materialize(entries, "buckets")
    large = (entries.groupBy("view", "code", "dim").agg(F.count("*").alias("rows")).where(F.col("rows") > cell)
             .withColumn("parts", F.ceil(F.col("rows") / cell).cast("int")).drop("rows"))
    placed = (entries.join(large, ["view", "code", "dim"], "left").withColumn("parts", F.coalesce("parts", F.lit(1)))
              .withColumn("part", F.pmod(F.xxhash64("node"), F.col("parts")).cast("int"))
              .withColumn("other", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)))
              .withColumn("a", F.least("part", "other")).withColumn("b", F.greatest("part", "other")).drop("other", "parts"))
    key = ["view", "code", "dim", "a", "b"]
    dealt = placed.repartition(*key).sortWithinPartitions(*key)
    found = materialize(_compare(dealt, threshold, 1 + probes, single), "links")
    counts = found.where("edge is null").groupBy("node").agg(F.sum("n").alias("n"))
    groups = connected_components(found.where("edge is not null").select(F.col("node").alias("a"), F.col("edge").alias("b")))
    groups = groups.join(classes.select("node", "low"), "node")
    least = groups.groupBy("component").agg(F.min("low").alias("least"))
    groups = groups.join(least, "component").select("node", "least")
    named = (classes.join(counts, "node", "left").join(groups, "node", "left")
             .select("v", (F.col("weight") - 1 + F.coalesce("n", F.lit(0))).alias("n_links"),
                     F.coalesce("least", "low").alias("component_id")))
    return (v.join(named, "v", "left")
            .select("vec_id", F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"),
                    F.when(F.col("v").isNull(), F.col("vec_id")).otherwise(F.col("component_id")).alias("component_id"))
            .withColumn("kept", F.coalesce(F.col("vec_id") == F.col("component_id"), F.lit(False))))


def _matrix(column, single) -> np.ndarray:
    return np.frombuffer(b"".join(column), np.float32 if single else np.float64).reshape(len(column), -1).astype(np.float64)


def _unit(x: np.ndarray) -> np.ndarray:
    x = x / np.abs(x).max(axis=1, keepdims=True)
    return x / np.sqrt(np.einsum("ij,ij->i", x, x))[:, None]


def _entries(classes: DataFrame, tables: int | None, hashes: int, probes: int, single: bool) -> DataFrame:
    """One row per class, table and probed bucket, with the vector's bytes and all its codes."""

    def run(batches: Iterator) -> Iterator:
        import pyarrow as pa

        for big in batches:
            for lo in range(0, big.num_rows, 1000):
                batch = big.slice(lo, 1000)
                raw = batch.column("v").to_pylist()
                width = np.array([len(r) for r in raw])
                for d in np.unique(width):
                    own = np.flatnonzero(width == d)
                    x = np.array([raw[i] for i in own], np.float32 if single else np.float64)
                    c = codes(_unit(x.astype(np.float64)), tables, hashes, probes)
                    views = c.shape[1]
                    per = views * (1 + probes)
                    node = np.array(batch.column("node").to_pylist())[own]
                    weight = np.array(batch.column("weight").to_pylist())[own]
                    yield pa.RecordBatch.from_arrays(
                        [pa.array(np.tile(np.repeat(np.arange(views, dtype=np.int32), 1 + probes), len(own))),
                         pa.array(c.ravel()), pa.array(np.full(len(own) * per, d, np.int32)),
                         pa.array(np.repeat(node, per)), pa.array(np.repeat(weight, per)),
                         pa.array([r.tobytes() for r in x for _ in range(per)], pa.binary()),
                         pa.array([r.tobytes() for r in c for _ in range(per)], pa.binary())],
                        ["view", "code", "dim", "node", "weight", "x", "codes"])

    return classes.select("v", "node", "weight").mapInArrow(
        run, "view int, code long, dim int, node long, weight long, x binary, codes binary")


def _compare(dealt: DataFrame, threshold: float, width: int, single: bool) -> DataFrame:
    """(node, n, edge): link counts (edge null) and forest edges of every cell of sorted ``dealt``."""
    keys = ["view", "code", "dim", "a", "b"]

    def run(batches: Iterator) -> Iterator:
        import pyarrow as pa

        cells, held = _Cells(threshold), None

        def out(rows):
            col = {k: rows.column(k).to_numpy() for k in (*keys, "node", "weight", "part")}
            differ = np.zeros(rows.num_rows - 1, bool)
            for k in keys:
                differ |= col[k][1:] != col[k][:-1]
            bounds = np.concatenate([[0], np.flatnonzero(differ) + 1, [rows.num_rows]])
            lone = np.diff(bounds) == 1
            keep = ~np.repeat(lone, np.diff(bounds))
            if not keep.any():
                return
            rows, col = rows.filter(pa.array(keep)), {k: v[keep] for k, v in col.items()}
            size = np.diff(bounds)[~lone]
            bounds = np.concatenate([[0], size.cumsum()])
            xs, cs = rows.column("x").to_pylist(), rows.column("codes").to_pylist()
            for d in np.unique(col["dim"]):
                own = col["dim"] == d
                mine = {k: v[own] for k, v in col.items()}
                mine["x"] = _unit(_matrix([x for x, o in zip(xs, own.tolist(), strict=True) if o], single))
                raw = [c for c, o in zip(cs, own.tolist(), strict=True) if o]
                mine["codes"] = np.frombuffer(b"".join(raw), np.int64).reshape(len(raw), -1, width)
                cell_own = own[bounds[:-1]]
                ids, n, ea, eb = cells.compare(mine, np.concatenate([[0], size[cell_own].cumsum()]))
                node, back = np.unique(ids, return_inverse=True)
                total = np.bincount(back, n, len(node)).astype(np.int64)
                yield pa.RecordBatch.from_arrays(
                    [pa.array(np.concatenate([node, ea])), pa.array(np.concatenate([total, np.zeros(len(ea), np.int64)])),
                     pa.concat_arrays([pa.nulls(len(node), pa.int64()), pa.array(eb, pa.int64())])], ["node", "n", "edge"])

        for big in batches:
            for lo in range(0, big.num_rows, 4000):
                batch = big.slice(lo, 4000)
                held = batch if held is None else pa.concat_batches([held, batch])
                last = [held.column(k)[held.num_rows - 1].as_py() for k in keys]
                same = np.ones(held.num_rows, bool)
                for k, v in zip(keys, last, strict=True):
                    same &= held.column(k).to_numpy() == v
                cut = int(np.argmax(same))  # the last cell may go on in the next batch
                if cut:
                    yield from out(held.slice(0, cut))
                    held = held.slice(cut)
        if held is not None and held.num_rows:
            yield from out(held)

    return dealt.select(*keys, "node", "weight", "part", "x", "codes").mapInArrow(run, "node long, n long, edge long")


def query(spark, sf_dir):
    """Near-duplicates among all vectors of ``embeddings``."""
    return linked_vectors(spark.read.parquet(f"{sf_dir}/embeddings.parquet"))


SQL = """
WITH RECURSIVE v AS (SELECT vec_id, CAST(embedding AS DOUBLE[]) AS e FROM embeddings),
l AS (SELECT a.vec_id AS x, b.vec_id AS y FROM v a JOIN v b ON a.vec_id <> b.vec_id AND list_cosine_similarity(a.e, b.e) >= 0.95),
r AS (SELECT vec_id AS node, vec_id AS reach FROM v UNION SELECT r.node, l.y FROM r JOIN l ON l.x = r.reach),
c AS (SELECT node, min(reach) AS component_id FROM r GROUP BY node),
n AS (SELECT x, count(*) AS n FROM l GROUP BY x)
SELECT vec_id, coalesce(n.n, 0) AS n_links, component_id, vec_id = component_id AS kept
FROM v JOIN c ON node = vec_id LEFT JOIN n ON x = vec_id
"""
