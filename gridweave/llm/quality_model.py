"""Quality classifier: random-indexing word vectors, pooled per document, and a small network.

Every token falls into one of BUCKETS by a hash of all its bytes and has a sparse ternary index vector.  A bucket's
word vector is the sum of the index vectors of its neighbours within RADIUS tokens over the whole
corpus; tasks add them up as integers and Spark sums the tasks, so the result does not depend on
order.  A document is the mean and the spread of its unit word vectors.  The driver fits a
two-layer network on a bounded sample of labelled rows and calibrates it with a temperature.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gridweave.llm.common import id_crc32, materialize, text_or_empty

BUCKETS, DIM, NONZERO, RADIUS = 1 << 14, 32, 4, 2
#: Labelled rows that the network is fitted on, at most about this many.
SAMPLE_ROWS = 20_000
_CHUNK_BYTES = 4_000_000
#: Word vectors gathered at once to be pooled, unless one text has more.
_POOL_TOKENS = 300_000

_CLASS = np.array([0 if b in (9, 10, 11, 12, 13, 32) else 1 if b >= 128 or chr(b).isalnum() else 2 for b in range(256)],
                  np.uint8)
_UNSPACED = 3
#: Code points from U+0800 up that are not letters of spaced words: (first, last, class).
_RANGES = np.array([(0x0E00, 0x0FFF, _UNSPACED), (0x1000, 0x109F, _UNSPACED), (0x1780, 0x17FF, _UNSPACED),
                    (0x200B, 0x200B, 0), (0x2E80, 0x2FFF, _UNSPACED), (0x3000, 0x3000, 0), (0x3001, 0x3004, 2),
                    (0x3005, 0x3007, _UNSPACED), (0x3008, 0x3020, 2), (0x3021, 0x302F, _UNSPACED), (0x3030, 0x3030, 2),
                    (0x3031, 0x303C, _UNSPACED), (0x303D, 0x303F, 2), (0x3040, 0x312F, _UNSPACED), (0x31A0, 0xA4CF, _UNSPACED),
                    (0xF900, 0xFAFF, _UNSPACED), (0xFE30, 0xFE4F, 2), (0xFF01, 0xFF0F, 2), (0xFF1A, 0xFF20, 2),
                    (0xFF3B, 0xFF40, 2), (0xFF5B, 0xFF65, 2), (0xFF66, 0xFF9F, _UNSPACED), (0x1B000, 0x1B16F, _UNSPACED),
                    (0x20000, 0x3FFFF, _UNSPACED)])
_MASK = np.array([(1 << 8 * k) - 1 for k in range(9)], np.uint64)


def index_vectors() -> tuple[np.ndarray, np.ndarray]:
    """(places, signs) of each bucket's nonzero components; equal in every task."""
    rng = np.random.default_rng(11)
    places = np.argsort(rng.random((BUCKETS, DIM)), axis=1)[:, :NONZERO]
    return places, rng.choice([-1, 1], (BUCKETS, NONZERO))


def tokens(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """(bucket of every token, first token of every text and the total).

    A token is a run of letters and digits (other bytes from 128 up count as letters) or a run of
    other signs between white space; runs of letters that are written without spaces (Chinese,
    Japanese, Thai ...) are their pairs of neighbouring letters instead.  Its bucket comes from all
    its bytes and its length.  A token equal to the one before it in its text goes to the last
    bucket, whatever it is.
    """
    import xxhash

    raw = b" ".join(texts) + b" "
    b = np.frombuffer(raw, np.uint8)
    cls = _CLASS[b]
    letter, width = _mark_wide(b, cls)
    edge = np.flatnonzero(np.append(True, cls[1:] != cls[:-1]))
    stop = np.append(edge[1:], len(b))
    real = (cls[edge] > 0) & (cls[edge] != _UNSPACED)
    start, size = edge[real], (stop - edge)[real]
    if len(letter):
        near = letter[:-1] + width[:-1] == letter[1:]
        alone = ~(np.append(near, False) | np.append(False, near))
        start = np.concatenate([start, letter[:-1][near], letter[alone]])
        size = np.concatenate([size, (width[:-1] + width[1:])[near], width[alone]])
        order = np.argsort(start)
        start, size = start[order], size[order]
    words = np.ndarray((len(raw) + 17,), "<u8", raw + bytes(24), strides=(1,))
    h = size.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)
    for o in (0, 8, 16):
        h ^= words[np.minimum(start + o, len(raw))] & _MASK[np.clip(size - o, 0, 8)]
        h *= np.uint64(0xC2B2AE3D27D4EB4F)
        h ^= h >> np.uint64(29)
    long = np.flatnonzero(size > 24)
    if len(long):
        rest = np.fromiter((xxhash.xxh64_intdigest(raw[i + 24:i + n]) for i, n in zip(start[long].tolist(), size[long].tolist(),
                                                                                     strict=True)), np.uint64, len(long))
        mixed = (h[long] ^ rest) * np.uint64(0xC2B2AE3D27D4EB4F)
        h[long] = mixed ^ (mixed >> np.uint64(29))
    ends = (np.fromiter(map(len, texts), np.int64, len(texts)) + 1).cumsum()
    first = np.searchsorted(start, np.append(0, ends))
    bucket = (h % np.uint64(BUCKETS - 1)).astype(np.int64)
    again = np.append(False, h[1:] == h[:-1])[:len(h)]
    again[first[:-1][first[:-1] < len(h)]] = False
    bucket[again] = BUCKETS - 1
    return bucket, first


def _mark_wide(b: np.ndarray, cls: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Set the class of the characters of _RANGES in UTF-8 bytes; (place, bytes) of the letters written without spaces."""
    at = np.flatnonzero(b >= 0xE0)
    if not len(at):
        return at, at
    far = np.append(b, np.zeros(3, np.uint8))
    four = b[at] >= 0xF0
    tail = [far[at + k].astype(np.int64) for k in (1, 2, 3)]
    whole = (tail[0] >> 6 == 2) & (tail[1] >> 6 == 2) & (~four | (tail[2] >> 6 == 2))
    cp = (b[at].astype(np.int64) & 15) << 12 | (tail[0] & 63) << 6 | tail[1] & 63
    cp = np.where(four, (cp & 0x7FFF) << 6 | tail[2] & 63, cp)
    spot = np.searchsorted(_RANGES[:, 0], cp, "right") - 1
    known = whole & (spot >= 0) & (cp <= _RANGES[spot, 1])
    at, width, kind = at[known], 3 + four[known], _RANGES[spot[known], 2]
    for k in range(4):
        own = width > k
        cls[at[own] + k] = kind[own]
    return at[kind == _UNSPACED], width[kind == _UNSPACED]


def _chunks(texts: list[bytes]) -> Iterator[list[bytes]]:
    at = 0
    while at < len(texts):
        n, size = at, 0
        while n < len(texts) and (n == at or size + len(texts[n]) <= _CHUNK_BYTES):
            size += len(texts[n])
            n += 1
        yield texts[at:n]
        at = n


def add_contexts(total: np.ndarray, token: np.ndarray, first: np.ndarray, places: np.ndarray, signs: np.ndarray) -> None:
    """Add to ``total`` (BUCKETS, DIM) the index vectors of every token's neighbours in its text."""
    doc = np.repeat(np.arange(len(first) - 1), np.diff(first))
    for o in range(1, RADIUS + 1):
        near = doc[o:] == doc[:-o]
        left, right = token[:-o][near], token[o:][near]
        for own, other in ((left, right), (right, left)):
            for k in range(NONZERO):
                flat = np.bincount(own * DIM + places[other, k], signs[other, k], BUCKETS * DIM)
                total += flat.astype(np.int64).reshape(BUCKETS, DIM)


def word_vectors(docs: DataFrame, text_col: str = "text") -> np.ndarray:
    """Unit word vector of every bucket (BUCKETS, DIM), from all texts; zero where nothing was seen.

    Its size is fixed, so it is gathered to the driver whatever the corpus.
    """
    names = [f"d{i}" for i in range(DIM)]

    def run(batches: Iterator) -> Iterator:
        import pyarrow as pa

        total, (places, signs) = np.zeros((BUCKETS, DIM), np.int64), index_vectors()
        for batch in batches:
            for texts in _chunks(batch.column("text").to_pylist()):
                token, first = tokens(texts)
                if len(token):
                    add_contexts(total, token, first, places, signs)
        seen = np.flatnonzero(total.any(axis=1))
        yield pa.RecordBatch.from_arrays([pa.array(seen.astype(np.int32)), *[pa.array(total[seen, i]) for i in range(DIM)]],
                                         ["bucket", *names])

    part = docs.select(text_or_empty(text_col).cast("binary").alias("text")).mapInArrow(
        run, "bucket int, " + ", ".join(f"{n} long" for n in names))
    rows = part.groupBy("bucket").agg(*[F.sum(n).alias(n) for n in names]).toPandas()
    out = np.zeros((BUCKETS, DIM), np.float32)
    if len(rows):
        v = rows[names].to_numpy(np.float64)
        out[rows["bucket"].to_numpy()] = v / np.maximum(np.linalg.norm(v, axis=1, keepdims=True), 1e-12)
    return out


def pool(texts: list[bytes], vectors: np.ndarray) -> np.ndarray:
    """Mean and standard deviation of the word vectors of each text (texts, 2 DIM); zero if empty."""
    out = np.zeros((len(texts), 2 * DIM), np.float32)
    at = 0
    for part in _chunks(texts):
        token, first = tokens(part)
        lo = 0
        while lo < len(part):
            hi = max(lo + 1, int(np.searchsorted(first, first[lo] + _POOL_TOKENS, "right")) - 1)
            n = np.diff(first[lo:hi + 1])
            full = np.flatnonzero(n)
            if len(full):
                v = vectors[token[first[lo]:first[hi]]]
                heads = first[lo:hi][full] - first[lo]
                size = n[full, None]
                mean = np.add.reduceat(v, heads, axis=0, dtype=np.float64) / size
                square = np.add.reduceat(v * v, heads, axis=0, dtype=np.float64) / size
                out[at + lo + full] = np.hstack([mean, np.sqrt(np.maximum(square - mean**2, 0))])
            lo = hi
        at += len(part)
    return out


@dataclass
class Network:
    """Standardised inputs, one tanh layer, one logistic output divided by a temperature."""

    centre: np.ndarray
    scale: np.ndarray
    w1: np.ndarray
    b1: np.ndarray
    w2: np.ndarray
    b2: float
    temperature: float = 1.0

    def logit(self, x: np.ndarray) -> np.ndarray:
        return np.tanh(((x - self.centre) / self.scale) @ self.w1 + self.b1) @ self.w2 + self.b2

    def score(self, x: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(self.logit(np.asarray(x, np.float64)) / self.temperature, -50, 50)))


def fit_network(x: np.ndarray, y: np.ndarray, hidden: int = 24, epochs: int = 60, decay: float = 1e-3) -> Network:
    """Fit on four fifths of the rows with Adam; the temperature minimises the loss on the last fifth.

    No rows give the score 0.5, rows of one label a constant score.
    """
    x, y = np.asarray(x, np.float64).reshape(len(y), -1 if len(y) else 2 * DIM), np.asarray(y, np.float64)
    if len(set(y.tolist())) < 2:
        share = (y.sum() + 1) / (len(y) + 2)
        return Network(np.zeros(x.shape[1]), np.ones(x.shape[1]), np.zeros((x.shape[1], 1)), np.zeros(1), np.zeros(1),
                       float(np.log(share / (1 - share))))
    rng = np.random.default_rng(5)
    order = rng.permutation(len(y))
    held, own = order[:len(y) // 5], order[len(y) // 5:]
    net = Network(x[own].mean(0), x[own].std(0) + 1e-6, rng.normal(0, x.shape[1] ** -0.5, (x.shape[1], hidden)),
                  np.zeros(hidden), rng.normal(0, hidden**-0.5, hidden), 0.0)
    state = [np.concatenate([net.w1.ravel(), net.b1, net.w2, [net.b2]])]
    m, v, t = np.zeros_like(state[0]), np.zeros_like(state[0]), 0
    d = x.shape[1] * hidden
    z = (x - net.centre) / net.scale
    for epoch in range(epochs):
        rate = 0.01 * (1 - epoch / epochs) + 1e-4
        for lot in np.array_split(rng.permutation(own), max(1, len(own) // 128)):
            p = state[0]
            w1, b1, w2, b2 = p[:d].reshape(-1, hidden), p[d:d + hidden], p[d + hidden:-1], p[-1]
            h = np.tanh(z[lot] @ w1 + b1)
            err = (1 / (1 + np.exp(-np.clip(h @ w2 + b2, -50, 50))) - y[lot]) / len(lot)
            back = np.outer(err, w2) * (1 - h * h)
            grad = np.concatenate([(z[lot].T @ back + decay * w1).ravel(), back.sum(0), h.T @ err + decay * w2, [err.sum()]])
            t += 1
            m, v = 0.9 * m + 0.1 * grad, 0.999 * v + 0.001 * grad * grad
            state[0] = p - rate * (m / (1 - 0.9**t)) / (np.sqrt(v / (1 - 0.999**t)) + 1e-8)
    p = state[0]
    net.w1, net.b1, net.w2, net.b2 = p[:d].reshape(-1, hidden), p[d:d + hidden], p[d + hidden:-1], float(p[-1])
    if len(held):
        logit = net.logit(x[held])
        grid = np.geomspace(0.25, 8, 61)
        loss = [np.logaddexp(0, np.where(y[held] > 0, -1, 1) * logit / g).mean() for g in grid]
        net.temperature = float(grid[int(np.argmin(loss))])
    return net


def pooled(docs: DataFrame, vectors: np.ndarray, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, x): the pooled vector of every row as little-endian 32-bit floats."""
    shared = docs.sparkSession.sparkContext.broadcast(vectors)

    def run(batches: Iterator) -> Iterator:
        import pyarrow as pa

        for batch in batches:
            x = pool(batch.column("text").to_pylist(), shared.value)
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array([r.tobytes() for r in x], pa.binary())],
                                             ["doc_id", "x"])

    src = docs.select(F.col(id_col).cast("long").alias("doc_id"), text_or_empty(text_col).cast("binary").alias("text"))
    return src.mapInArrow(run, "doc_id long, x binary")


def train(vectors_of_docs: DataFrame, labels: DataFrame, label_col: str = "quality", sample_rows: int = SAMPLE_ROWS) -> Network:
    """Fit on about ``sample_rows`` labelled rows outside the held-out fold, picked by a hash of the id.

    Only the pooled vector and the label are used.  Null ids and labels teach nothing; of several
    labels of one id the largest counts.
    """
    known = (labels.where(F.col("doc_id").isNotNull() & F.col(label_col).isNotNull() & (id_crc32() % 5 != 0))
             .groupBy(F.col("doc_id").cast("long").alias("doc_id")).agg(F.max(F.col(label_col)).alias("y")))
    n = known.count()
    dice = F.pmod(F.xxhash64("doc_id", F.lit("quality")), F.lit(1 << 30))
    picked = known.where(dice < int((1 << 30) * min(1.0, sample_rows / max(n, 1))))
    rows = vectors_of_docs.join(picked, "doc_id").select("doc_id", "x", "y").orderBy("doc_id", "x").collect()
    x = np.frombuffer(b"".join(r["x"] for r in rows), np.float32).reshape(len(rows), -1) if rows else np.zeros((0, 2 * DIM))
    return fit_network(x, np.array([1.0 if r["y"] > 0 else 0.0 for r in rows]))


def score(vectors_of_docs: DataFrame, net: Network) -> DataFrame:
    """(doc_id, score) of every pooled row."""

    def run(batches: Iterator) -> Iterator:
        import pyarrow as pa

        for batch in batches:
            if batch.num_rows:
                x = np.frombuffer(b"".join(batch.column("x").to_pylist()), np.float32).reshape(batch.num_rows, -1)
                yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(net.score(x), pa.float64())],
                                                 ["doc_id", "score"])

    return vectors_of_docs.mapInArrow(run, "doc_id long, score double")


def classify(docs: DataFrame, labels: DataFrame, threshold: float = 0.3, **options) -> DataFrame:
    """(doc_id, held_out, score, predicted) of every row of ``docs``.

    Null and empty texts have the zero vector and its score; repeated rows get equal scores; an
    empty table gives no rows.
    """
    rows = materialize(pooled(docs, word_vectors(docs)), "pooled-vectors")
    out = score(rows, train(rows, labels, **options))
    return out.select("doc_id", (id_crc32() % 5 == 0).alias("held_out"), "score",
                      (F.col("score") >= threshold).cast("int").alias("predicted"))


def query(spark, sf_dir):
    """Quality of every document, learned from the labelled rows outside the held-out fold."""
    return classify(spark.read.parquet(f"{sf_dir}/documents.parquet"), spark.read.parquet(f"{sf_dir}/labels.parquet"))
