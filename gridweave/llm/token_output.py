"""Token-ID output: best-fit-decreasing packing into id matrices, written as a binary table.

A segment tree over remaining capacities answers "the smallest capacity that still takes this
piece" in the logarithm of the window.  Documents longer than a window are split without loss.
Each row of the output table is one window: its ids as little-endian numbers of the least width
that holds the vocabulary, cumulative segment lengths, positions that restart in each segment, and
the (document, start) of every segment.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from gridweave.llm import bpe
from gridweave.llm.common import scratch_path, text_or_empty

WINDOW, END_ID, PAD_ID = 2048, 50256, 50256
#: Ids a task holds before it packs and writes them.
BUFFER_IDS = 8_000_000

SCHEMA = ("sequence_id long, n_ids int, ids binary, positions binary, cu_seqlens array<int>, "
          "doc_ids array<long>, starts array<long>")


class CapacityTree:
    """Counts of bins by remaining capacity, with the smallest fitting capacity found by descent."""

    def __init__(self, window: int):
        self.leaves = 1 << window.bit_length()
        self.count = [0] * (2 * self.leaves)

    def add(self, capacity: int, n: int) -> None:
        i = capacity + self.leaves
        while i:
            self.count[i] += n
            i >>= 1

    def best_fit(self, size: int) -> int | None:
        """The smallest capacity of at least ``size`` that a bin has."""
        i = size + self.leaves
        if self.count[i]:
            return size
        while i > 1:
            if not i & 1 and self.count[i + 1]:  # a right neighbour holds larger capacities
                i += 1
                while i < self.leaves:
                    i = 2 * i if self.count[2 * i] else 2 * i + 1
                return i - self.leaves
            i >>= 1
        return None


def best_fit_decreasing(sizes: list[int], window: int) -> list[list[int]]:
    """Bins of item numbers: largest item first, into the bin with the least room that takes it."""
    tree, room, bins = CapacityTree(window), {}, []
    for item in sorted(range(len(sizes)), key=lambda i: -sizes[i]):
        size = sizes[item]
        c = tree.best_fit(size)
        if c is None:
            bins.append([item])
            at, left = len(bins) - 1, window - size
        else:
            tree.add(c, -1)
            at, left = room[c].pop(), c - size
            bins[at].append(item)
        if left:
            tree.add(left, 1)
            room.setdefault(left, []).append(at)
    return bins


def pack_windows(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", window: int = WINDOW,
                 tokenizer: str | None = None, end_id: int = END_ID, pad_id: int = PAD_ID) -> DataFrame:
    """One row per window, see SCHEMA; every task packs its own rows, BUFFER_IDS ids at a time.

    Each document is its ids and ``end_id``; null and empty texts are the end id alone, repeated
    rows are packed once each, an empty table gives no rows.  ``ids`` is padded with ``pad_id`` to
    the window, ``n_ids`` counts the real ones, padding has position 0.
    """
    path = tokenizer or bpe.default_path()

    def run(batches: Iterator) -> Iterator:
        import pyarrow as pa
        from pyspark import TaskContext

        coder, number = bpe.load(path), TaskContext.get().partitionId() << 32
        wide = "<u2" if max(coder.ranks.values(), default=0) < 1 << 16 and max(end_id, pad_id) < 1 << 16 else "<u4"
        place = "<u2" if window <= 1 << 16 else "<u4"
        pieces: list = []

        def flush():
            nonlocal number
            for lo in range(0, len(bins := best_fit_decreasing([len(p[2]) for p in pieces], window)), 256):
                rows = []
                for own in bins[lo:lo + 256]:
                    ids, pos, at, cu = np.full(window, pad_id, wide), np.zeros(window, place), 0, [0]
                    for k in own:
                        n = len(pieces[k][2])
                        ids[at:at + n] = pieces[k][2]
                        pos[at:at + n] = np.arange(n)
                        at += n
                        cu.append(at)
                    rows.append((number, at, ids.tobytes(), pos.tobytes(), cu, [pieces[k][0] for k in own],
                                 [pieces[k][1] for k in own]))
                    number += 1
                kinds = [pa.int64(), pa.int32(), pa.binary(), pa.binary(), pa.list_(pa.int32()), pa.list_(pa.int64()),
                         pa.list_(pa.int64())]
                names = ["sequence_id", "n_ids", "ids", "positions", "cu_seqlens", "doc_ids", "starts"]
                yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows, strict=True), kinds, strict=True)],
                                                 names)
            pieces.clear()

        held = 0
        for big in batches:
            for lo in range(0, big.num_rows, 1000):
                batch = big.slice(lo, 1000)
                ids, bounds = coder.encode(batch.column("text").to_pylist())
                for i, doc in enumerate(batch.column("doc_id").to_pylist()):
                    own = np.append(ids[bounds[i]:bounds[i + 1]], end_id).astype(wide)
                    pieces += [(doc, at, own[at:at + window]) for at in range(0, len(own), window)]
                    held += len(own)
                if held >= BUFFER_IDS:
                    yield from flush()
                    held = 0
        yield from flush()

    src = docs.select(F.col(id_col).cast("long").alias("doc_id"), text_or_empty(text_col).alias("text"))
    return src.mapInArrow(run, SCHEMA)


def write_tokens(docs: DataFrame, path: str, **options) -> None:
    """Write the windows of ``docs`` as a table at ``path`` (Spark's committed Parquet output)."""
    pack_windows(docs, **options).write.option("compression", "zstd").parquet(path)


def read_tokens(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(SCHEMA).parquet(path)


def segments(windows: DataFrame, window: int = WINDOW) -> DataFrame:
    """One row per segment of stored windows: (doc_id, start, length, sequence_id, offset, ids_crc32,
    positions_reset).  ``positions_reset`` tells whether its positions begin at 0 and end at length - 1.
    """
    w = windows.select("*", (F.octet_length("ids") / window).cast("int").alias("wide"),
                       (F.octet_length("positions") / window).cast("int").alias("place"),
                       F.posexplode("doc_ids").alias("k", "doc_id"))
    at, end = F.get("cu_seqlens", F.col("k")), F.get("cu_seqlens", F.col("k") + 1)
    w = w.select("*", at.alias("offset"), (end - at).alias("length"), F.get("starts", F.col("k")).alias("start"))

    def cut(col, width):
        return F.substring(F.col(col), F.col("offset") * F.col(width) + 1, F.col("length") * F.col(width))

    first, last = F.hex(F.substring(F.col("positions"), F.col("offset") * F.col("place") + 1, F.col("place"))), F.hex(
        F.substring(F.col("positions"), (F.col("offset") + F.col("length") - 1) * F.col("place") + 1, F.col("place")))
    return w.select("doc_id", "start", F.col("length").cast("long").alias("length"), "sequence_id",
                    F.col("offset").cast("long").alias("offset"), F.crc32(cut("ids", "wide")).alias("ids_crc32"),
                    ((_little(first) == 0) & (_little(last) == F.col("length") - 1)).alias("positions_reset"))


def _little(hexed):
    """The number of 2 or 4 little-endian bytes given in hexadecimal."""
    pairs = [F.substring(hexed, 1 + 2 * i, 2) for i in (3, 2, 1, 0)]
    return F.conv(F.concat(*pairs), 16, 10).cast("long")


def query(spark, sf_dir):
    """All documents tokenised, packed, written as binary windows and read back by segment."""
    path = scratch_path(spark, "tokens")
    write_tokens(spark.read.parquet(f"{sf_dir}/documents.parquet"), path)
    return segments(read_tokens(spark, path))
