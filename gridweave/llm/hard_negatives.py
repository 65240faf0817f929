"""Hard negatives by angular triangle filtering.

Every row stores its norm and its angles to a few reference directions.  For two rows and a
reference with angles p and q, the angle between the rows lies in [|p - q|, min(p + q, 2 pi - p - q)];
its cosine times both norms bounds their inner product, with a margin for rounding.  Rows lie in
the order of (nearest reference, angle to it), so a window of consecutive rows has narrow ranges of
angles and norms, and one bound holds for an anchor and a whole window.  Only the windows whose
bounds overlap the scores asked for are scored, in integers.

The anchors are taken in batches of a bounded size; each batch is broadcast and all rows stream past
it, as they lie, without a shuffle.  A task returns at most k rows per anchor, and only rows at least
as good as the k-th best of a small fixed sample.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from gridweave.llm.common import materialize, scratch_path

#: Rows from which the reference directions and the first thresholds are taken, and the directions.
SAMPLE, REFERENCES = 2048, 32
#: Anchors of one broadcast batch (about), and bytes of their vectors and angles.
BATCH_ANCHORS, BATCH_BYTES = 20_000, 16_000_000
#: Consecutive rows that share one bound; anchors scored against them at once.
ROWS, SLAB = 256, 4096
#: Candidates kept at least before a task's best lists are brought up to date (or one per list).
HELD = 2000
#: Margin of stored angles (32-bit, arc cosine near 1), in radians, and of products, relative.
ANGLE_MARGIN, PRODUCT_MARGIN = 4e-6, 1e-9
#: Squared norms from here on could give scores outside 64 bits.
NORM2_LIMIT = 2.0 ** 62
_LEAST, _LAST = np.iinfo(np.int64).min, np.iinfo(np.int64).max


def references(x: np.ndarray, n: int = REFERENCES) -> np.ndarray:
    """Unit directions spread over the rows of ``x``: farthest first, then five spherical k-means steps."""
    norm = np.sqrt((x * x).sum(axis=1))
    u = x[norm > 0] / norm[norm > 0, None]
    if not len(u):
        return np.empty((0, x.shape[1]))
    picked, near = [0], u @ u[0]
    while len(picked) < min(n, len(u)) and near.min() < 1 - 1e-9:
        picked.append(int(near.argmin()))
        near = np.maximum(near, u @ u[picked[-1]])
    refs = u[picked]
    for _ in range(5):
        home = (u @ refs.T).argmax(axis=1)
        sums = np.zeros_like(refs)
        np.add.at(sums, home, u)
        size = np.sqrt((sums * sums).sum(axis=1))
        refs = np.where(size[:, None] > 1e-9, sums / np.maximum(size, 1e-9)[:, None], refs)
    return refs


def _width(x: np.ndarray, n: int) -> np.ndarray:
    """``x`` with zeros up to ``n`` columns."""
    return x if x.shape[1] == n else np.pad(x, ((0, 0), (0, n - x.shape[1])))


def _matrix(raw: list[bytes]) -> np.ndarray:
    """Rows of stored 32-bit integers as doubles, the shorter ones ended by zeros."""
    size = np.fromiter(map(len, raw), np.int64, len(raw)) // 4
    wide = int(size.max(initial=0))
    if (size == wide).all():
        return np.frombuffer(b"".join(raw), "<i4").reshape(len(raw), wide).astype(np.float64)
    out = np.zeros((len(raw), wide))
    for i, r in enumerate(raw):
        out[i, :size[i]] = np.frombuffer(r, "<i4")
    return out


def angles(x: np.ndarray, norm: np.ndarray, refs: np.ndarray) -> np.ndarray:
    """Angles (rows, references); a zero row, whose products are all zero, gets right angles."""
    n = max(x.shape[1], refs.shape[1])
    cos = _width(x, n) @ _width(refs, n).T / np.where(norm > 0, norm, 1)[:, None]
    return np.arccos(np.clip(cos, -1, 1)).astype(np.float32)


def score_bounds(a_angles, a_norm, least, most, norm_least, norm_most):
    """(low, high) of the inner products of each anchor with rows of one window.

    ``least`` and ``most`` are the window's angles per reference, the norms its smallest and largest.
    """
    if a_angles.shape[1]:
        apart = np.maximum(a_angles - most, least - a_angles).max(axis=1).astype(np.float64)
        together = np.minimum(a_angles + most, 2 * np.pi - a_angles - least).min(axis=1).astype(np.float64)
    else:
        apart, together = np.zeros(len(a_norm)), np.full(len(a_norm), np.pi)
    near = np.cos(np.clip(apart - ANGLE_MARGIN, 0, np.pi))
    far = np.cos(np.clip(together + ANGLE_MARGIN, 0, np.pi))
    margin = PRODUCT_MARGIN * a_norm * norm_most + 0.5
    high = a_norm * near * np.where(near > 0, norm_most, norm_least) + margin
    low = a_norm * far * np.where(far > 0, norm_least, norm_most) - margin
    return low, high


def _scores(a: np.ndarray, b: np.ndarray, largest: float) -> np.ndarray:
    """Exact integer inner products of all rows of ``a`` and ``b``, none larger than ``largest``."""
    n = max(a.shape[1], b.shape[1])
    a, b = _width(a, n), _width(b, n)
    if largest < 2.0 ** 52:
        return (a @ b.T).astype(np.int64)
    return a.astype(np.int64) @ b.astype(np.int64).T


class BestLists:
    """The ``k`` best (score, id, row) of each list; ties go to smaller ids, then rows.

    ``floor`` rows are a threshold only: what they beat is out, but they are not members themselves.
    """

    def __init__(self, lists: int, k: int):
        self.k, self.held, self.n_held = k, [], 0
        self.score = np.full((lists, k), _LEAST)
        self.id, self.row = np.full((lists, k), _LAST), np.full((lists, k), _LAST)
        self.least, self.least_id, self.least_row = (m[:, -1].copy() for m in (self.score, self.id, self.row))

    def passes(self, which, score, ids, row):
        """Whether candidates are as good as their list's threshold."""
        t, i, r = self.least[which], self.least_id[which], self.least_row[which]
        return (score > t) | ((score == t) & ((ids < i) | ((ids == i) & (row <= r))))

    def offer(self, which, score, ids, row) -> None:
        ok = self.passes(which, score, ids, row)
        if ok.any():
            self.held.append((which[ok], score[ok], ids[ok], row[ok]))
            self.n_held += int(ok.sum())
            if self.n_held >= max(HELD, len(self.score)):
                self.settle()

    def settle(self) -> None:
        if not self.held:
            return
        which, score, ids, row = (np.concatenate(c) for c in zip(*self.held, strict=True))
        self.held, self.n_held = [], 0
        own = np.unique(which)
        which = np.concatenate([np.repeat(own, self.k), which])
        score, ids, row = (np.concatenate([m[own].ravel(), c]) for m, c in
                           ((self.score, score), (self.id, ids), (self.row, row)))
        order = np.lexsort((row, ids, ~score, which))  # ~score: falling, without overflow
        which = which[order]
        nth = np.arange(len(which)) - np.searchsorted(which, which)
        best = order[nth < self.k]
        for m, c in ((self.score, score), (self.id, ids), (self.row, row)):
            m[own] = c[best].reshape(len(own), self.k)
        up = self.passes(own, self.score[own, -1], self.id[own, -1], self.row[own, -1])
        for m, c in ((self.least, self.score), (self.least_id, self.id), (self.least_row, self.row)):
            m[own[up]] = c[own[up], -1]

    def keep_thresholds_only(self) -> None:
        self.settle()
        self.score[:], self.id[:], self.row[:] = _LEAST, _LAST, _LAST

    def rows(self):
        """(list, score, id, row) of all members."""
        self.settle()
        at, nth = np.nonzero(self.score > _LEAST)
        return at, self.score[at, nth], self.id[at, nth], self.row[at, nth]


class Rows:
    """Vectors with ids, labels, norms and angles, in the order they lie."""

    def __init__(self, x, ids, label, row, norm, theta):
        self.x, self.id, self.label, self.row, self.norm, self.theta = x, ids, label, row, norm, theta

    def __len__(self):
        return len(self.row)

    def part(self, at):
        return Rows(self.x[at], self.id[at], self.label[at], self.row[at], self.norm[at], self.theta[at])

    @staticmethod
    def of(batch):
        """From a table with the columns of ``measured``."""
        def col(name):
            return batch.column(name).to_numpy(zero_copy_only=False)

        raw = batch.column("theta").to_pylist()
        theta = np.frombuffer(b"".join(raw), "<f4").reshape(len(raw), -1) if raw else np.empty((0, 0), np.float32)
        return Rows(_matrix(batch.column("q").to_pylist()), col("id"), col("label"), col("row"), col("norm"), theta)


def _windows(rows: Rows) -> Iterator[Rows]:
    for lo in range(0, len(rows), ROWS):
        yield rows.part(slice(lo, lo + ROWS))


def _overlapping(anchors: Rows, window: Rows, wanted) -> Iterator[tuple]:
    """(anchor numbers, integer scores) of the anchors whose bounds ``wanted(low, high)`` asks for."""
    low, high = score_bounds(anchors.theta, anchors.norm, window.theta.min(axis=0), window.theta.max(axis=0),
                             window.norm.min(), window.norm.max())
    at = np.flatnonzero(wanted(low, high))
    for lo in range(0, len(at), SLAB):
        own = at[lo:lo + SLAB]
        yield own, _scores(anchors.x[own], window.x, float(anchors.norm[own].max() * window.norm.max()))


def offer_positives(anchors: Rows, window: Rows, best: BestLists) -> None:
    """Rows of an anchor's label, other than itself, that may be among its best."""
    here = np.isin(anchors.label, window.label)
    for own, score in _overlapping(anchors, window, lambda low, high: here & (high >= best.least)):
        ok = (score >= best.least[own, None]) & (anchors.label[own, None] == window.label[None]) & (
            anchors.row[own, None] != window.row[None])
        i, j = np.nonzero(ok)
        best.offer(own[i], score[i, j], window.id[j], window.row[j])


def offer_negatives(anchors: Rows, window: Rows, best: BestLists, least: np.ndarray, most: np.ndarray) -> None:
    """Rows of another label whose score is in the range (least, most) of one of the anchor's positives."""
    n = least.shape[1]
    if not n:
        return
    need = np.maximum(least, best.least.reshape(least.shape))

    def wanted(low, high):
        return ((high[:, None] >= need) & (low[:, None] <= most) & (need <= most)).any(axis=1)

    lowest, highest = need.min(axis=1), most.max(axis=1)
    for own, score in _overlapping(anchors, window, wanted):
        ok = (score >= lowest[own, None]) & (score <= highest[own, None]) & (anchors.label[own, None] != window.label[None])
        i, j = np.nonzero(ok)
        score, i = score[i, j], own[i]
        for s in range(n):
            hit = (score >= need[i, s]) & (score <= most[i, s])
            best.offer(i[hit] * n + s, score[hit], window.id[j[hit]], window.row[j[hit]])


def measured(vectors: DataFrame, id_col: str, vec_col: str, label_col: str, anchor: Column, scale: float) -> DataFrame:
    """(row, vec_id, label, anchor, q, norm): the rows that take part, components as integers floor(scale * x)."""
    sound = F.col("v").isNotNull() & F.forall("v", lambda e: e.isNotNull() & ~F.isnan(e) & (F.abs(e) < float("inf")))
    src = vectors.select(F.col(id_col).cast("long").alias("vec_id"), F.col(label_col).cast("long").alias("label"),
                         F.coalesce(anchor, F.lit(False)).alias("anchor"), F.col(vec_col).cast("array<double>").alias("v"))

    def run(batches: Iterator) -> Iterator:
        import pyarrow as pa

        for batch in batches:
            q = [np.floor(scale * np.asarray(v, np.float64)) for v in batch.column("v").to_pylist()]
            norm2 = np.array([float(np.dot(v, v)) for v in q])
            keep = norm2 < NORM2_LIMIT
            kept = batch.filter(pa.array(keep))
            raw = pa.array([v.astype("<i4").tobytes() for v, k in zip(q, keep.tolist(), strict=True) if k], pa.binary())
            yield pa.RecordBatch.from_arrays([*(kept.column(c) for c in ("row", "vec_id", "label", "anchor")), raw,
                                              pa.array(np.sqrt(norm2[keep]))], ["row", "vec_id", "label", "anchor", "q", "norm"])

    return (src.where(sound & F.col("label").isNotNull()).withColumn("row", F.monotonically_increasing_id())
            .mapInArrow(run, "row long, vec_id long, label long, anchor boolean, q binary, norm double"))


def _located(rows: DataFrame, refs: np.ndarray) -> DataFrame:
    """``rows`` with their angles, in the order of (nearest reference, angle to it)."""

    def run(batches: Iterator) -> Iterator:
        import pyarrow as pa

        for big in batches:
            for lo in range(0, big.num_rows, 2000):
                batch = big.slice(lo, 2000)
                theta = angles(_matrix(batch.column("q").to_pylist()), batch.column("norm").to_numpy(), refs)
                if theta.shape[1]:
                    home, near = theta.argmin(axis=1), theta.min(axis=1)
                else:
                    home, near = np.zeros(len(theta), np.int64), np.zeros(len(theta), np.float32)
                ids = batch.column("vec_id").fill_null(_LAST)
                cols = [batch.column("row"), batch.column("vec_id"), ids, batch.column("label"), batch.column("anchor"),
                        batch.column("q"), batch.column("norm"), pa.array([t.tobytes() for t in theta.astype("<f4")], pa.binary()),
                        pa.array(home.astype(np.int32)), pa.array(near.astype(np.float32))]
                yield pa.RecordBatch.from_arrays(cols, ["row", "vec_id", "id", "label", "anchor", "q", "norm", "theta", "home", "near"])

    located = rows.mapInArrow(run, "row long, vec_id long, id long, label long, anchor boolean, q binary, norm double, "
                                   "theta binary, home int, near float")
    order = ["home", "near", "row"]  # the row keeps equal vectors from piling up in one partition
    return located.repartitionByRange(*order).sortWithinPartitions(*order)


def _search(rows: DataFrame, fixed, offer, k: int, per_anchor: int) -> DataFrame:
    """(list, score, id, row): each task's best of every list, lists numbered anchor * per_anchor + part.

    ``fixed`` is the broadcast (anchors, sample, more); ``offer(anchors, window, best, *more)`` fills the lists.
    """

    def run(batches: Iterator) -> Iterator:
        import pyarrow as pa

        anchors, sample, more = fixed.value
        best = BestLists(len(anchors) * per_anchor, k)
        for window in _windows(sample):
            offer(anchors, window, best, *more)
        best.keep_thresholds_only()
        for batch in batches:
            for window in _windows(Rows.of(batch)):
                offer(anchors, window, best, *more)
        cols = best.rows()
        for lo in range(0, len(cols[0]), 10_000):
            yield pa.RecordBatch.from_arrays([pa.array(c[lo:lo + 10_000].astype(np.int64)) for c in cols],
                                             ["list", "score", "id", "row"])

    return (rows.select("id", "label", "row", "q", "norm", "theta")
            .mapInArrow(run, "list long, score long, id long, row long"))


def _first(found: DataFrame, k: int) -> DataFrame:
    order = Window.partitionBy("list").orderBy(F.desc("score"), "id", "row")
    return found.withColumn("nth", F.row_number().over(order)).where(F.col("nth") <= k)


def mine(vectors: DataFrame, anchor: Column, id_col: str = "vec_id", vec_col: str = "embedding", label_col: str = "label",
         positives: int = 5, negatives: int = 3, low: int = 50, high: int = 95, scale: float = 256,
         batch_anchors: int = BATCH_ANCHORS) -> DataFrame:
    """(anchor_id, positive_id, rank, negative_id, positive_score, negative_score): hard negatives of the ``anchor`` rows.

    Components become floor(scale * x) and scores are integer inner products.  An anchor's positives
    are its ``positives`` best other rows of the same label; for each, the ``negatives`` best rows of
    other labels with low % <= negative score / positive score <= high % (so none for a positive with
    a negative score).  Higher scores come first, ties by smaller id, then by row as read.

    Rows with a null label, a null vector or a null or non-finite component take no part, nor do rows
    whose integer vector has a length of 2^31 or more (scores would leave 64 bits).  An empty vector
    scores 0 with everything; shorter vectors count as ended by zeros.  Rows without an id come after
    all others among ties and are returned as null.  Repeated rows are rows of their own: a copy of
    an anchor is one of its positives.  A null ``anchor`` condition is false.  Empty tables and
    anchors without positives or negatives give no rows.  Other columns are not read.
    """
    rows = materialize(measured(vectors, id_col, vec_col, label_col, anchor, scale), "vectors")
    spark = rows.sparkSession
    sample = (rows.withColumn("id", F.coalesce("vec_id", F.lit(_LAST))).orderBy(F.xxhash64("row"), "row").limit(SAMPLE)
              .select("row", "id", "label", "q", "norm").toArrow())
    x = _matrix(sample.column("q").to_pylist())
    refs = references(x)
    norm = sample.column("norm").to_numpy()
    sample = Rows(x, *(sample.column(c).to_numpy() for c in ("id", "label", "row")), norm, angles(x, norm, refs))
    rows = materialize(_located(rows, refs), "located-vectors")
    size = rows.where("anchor").agg(F.count("*"), F.sum(F.octet_length("q") + F.octet_length("theta"))).first()
    batches = max(-(-size[0] // batch_anchors), -(-(size[1] or 0) // BATCH_BYTES))
    out = scratch_path(spark, "hard-negatives")
    found = rows.where("anchor").limit(0).select(F.lit(0).cast("long").alias("anchor_id"), F.lit(0).cast("long").alias("positive_id"),
                                                 F.lit(0).alias("rank"), F.lit(0).cast("long").alias("negative_id"),
                                                 F.lit(0).cast("long").alias("positive_score"),
                                                 F.lit(0).cast("long").alias("negative_score"))
    schema = found.schema
    found.write.parquet(out)
    for b in range(batches):
        own = rows.where(F.col("anchor") & (F.pmod(F.xxhash64("row"), F.lit(batches)) == b))
        made = _mine_batch(rows, own.toArrow(), sample, positives, negatives, low, high)
        if made is not None:
            made.write.mode("append").parquet(out)
    return spark.read.schema(schema).parquet(out)


def _nullable(col: str) -> Column:
    return F.when(F.col(col) != _LAST, F.col(col))


def _mine_batch(rows, table, sample, positives, negatives, low, high):
    """The rows of ``mine`` for the anchors in ``table``, None if it is empty."""
    if not table.num_rows:
        return None
    spark = rows.sparkSession
    anchors = Rows.of(table.combine_chunks())
    fixed = spark.sparkContext.broadcast((anchors, sample, ()))
    # the lists are named by number; at most ``positives`` rows per anchor of the batch come back
    near = _first(_search(rows, fixed, offer_positives, positives, 1), positives).select("list", "nth", "score", "id").toArrow()
    at, nth = near.column("list").to_numpy(), near.column("nth").to_numpy() - 1
    score = near.column("score").to_numpy()
    least, most = np.full((len(anchors), positives), _LAST), np.full((len(anchors), positives), _LEAST)
    ranges = [(-(-low * s // 100), high * s // 100) for s in score.tolist()]
    least[at, nth], most[at, nth] = [max(lo, _LEAST) for lo, _ in ranges], [min(hi, _LAST) for _, hi in ranges]
    fixed = spark.sparkContext.broadcast((anchors, sample, (least, most)))
    hard = _first(_search(rows, fixed, offer_negatives, negatives, positives), negatives)
    pairs = spark.createDataFrame(_pairs(anchors, at, nth, near, positives))
    return (hard.select("list", F.col("nth").cast("int").alias("rank"), F.col("id").alias("negative"), F.col("score").alias("negative_score"))
            .join(F.broadcast(pairs), "list")  # at most ``positives`` rows per anchor of a bounded batch
            .select(_nullable("anchor").alias("anchor_id"), _nullable("positive").alias("positive_id"), "rank",
                    _nullable("negative").alias("negative_id"), "positive_score", "negative_score"))


def _pairs(anchors, at, nth, near, positives):
    import pyarrow as pa

    return pa.table({"list": pa.array(at * positives + nth), "anchor": pa.array(anchors.id[at]),
                     "positive": near.column("id"), "positive_score": near.column("score")})


def query(spark, sf_dir):
    """Hard negatives of every fiftieth vector of ``embeddings`` against all of them."""
    v = spark.read.parquet(f"{sf_dir}/embeddings.parquet")
    v = v.withColumn("label", F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label")))
    return mine(v, F.col("vec_id") % 50 == 0)


SQL = """
WITH v AS (
  SELECT vec_id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label,
         list_transform(embedding, lambda x: floor(256 * CAST(x AS DOUBLE))) AS q
  FROM embeddings
  WHERE label IS NOT NULL AND embedding IS NOT NULL
    AND len(list_filter(embedding, lambda x: x IS NULL OR isnan(x) OR isinf(x))) = 0),
s AS (SELECT a.vec_id AS anchor_id, b.vec_id AS other_id, a.label = b.label AS same,
             CAST(list_inner_product(a.q, b.q) AS BIGINT) AS score
      FROM v a JOIN v b ON a.vec_id % 50 = 0 AND a.vec_id <> b.vec_id),
p AS (SELECT anchor_id, other_id AS positive_id, score AS positive_score FROM s WHERE same
      QUALIFY row_number() OVER (PARTITION BY anchor_id ORDER BY score DESC, other_id) <= 5)
SELECT p.anchor_id, positive_id,
       CAST(row_number() OVER (PARTITION BY p.anchor_id, positive_id ORDER BY score DESC, other_id) AS INT) AS rank,
       other_id AS negative_id, positive_score, score AS negative_score
FROM p JOIN s ON s.anchor_id = p.anchor_id AND NOT same AND 50 * positive_score <= 100 * score AND 100 * score <= 95 * positive_score
QUALIFY rank <= 3
"""
