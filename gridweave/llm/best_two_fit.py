"""Best-two-fit packing of whole documents into as few sequences as possible.

Sequences are filled one at a time: greedily, with the largest unpacked document that fits; when
none fits any more, the sequence's smallest document is taken out again if two unpacked documents
together fill the gap it leaves more tightly (the tightest such pair goes in).

The choices depend only on how many documents of each size are unpacked.  So Spark tokenises and
counts sizes, one count per size (at most ``window``) reaches the driver, the sequences are planned
there as *kinds* (the sizes a sequence holds and how often it is made), and every document finds its
place from its rank among the documents of its size.  No document, id or text leaves the tasks
for the driver, and no task leaves a half-filled sequence behind.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from gridweave.llm import word_bpe
from gridweave.llm.common import materialize, text_or_empty

WINDOW, END_ID = 4096, 1
#: Rows of (task, size) ranks up to which they are broadcast (three longs each); beyond, a shuffle join.
BROADCAST_ROWS = 500_000
#: Bytes of text tokenised at once in a task.
BATCH_BYTES = 4_000_000
#: Pieces of one output batch.
ROWS_OUT = 2000


@dataclass
class Plan:
    """Where the documents of each size go: one entry per (kind of sequence, size in it).

    Entry e takes the documents of ``size[e]`` with ranks from ``base[e]``, ``mult[e]`` to each
    sequence from ``first[e]`` on, at ``at[e]`` and following.  Entries are sorted by size and base.
    """

    size: np.ndarray
    base: np.ndarray
    mult: np.ndarray
    first: np.ndarray
    at: np.ndarray
    sequences: int

    def place(self, size: np.ndarray, rank: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(sequence, offset) of documents given by size and rank in it."""
        if not len(size):
            return np.empty(0, np.int64), np.empty(0, np.int64)
        lo, hi = np.searchsorted(self.size, size), np.searchsorted(self.size, size, "right")
        while (wide := hi - lo > 1).any():
            mid = (lo + hi) // 2
            right = wide & (self.base[np.minimum(mid, len(self.base) - 1)] <= rank)
            lo = np.where(right, mid, lo)
            hi = np.where(wide & ~right, mid, hi)
        k = rank - self.base[lo]
        return self.first[lo] + k // self.mult[lo], self.at[lo] + k % self.mult[lo] * size


class _Sizes:
    """Unpacked documents by size; the largest size of at most g is one look at a bit set."""

    def __init__(self, counts: np.ndarray):
        self.left = counts.tolist()
        self.bits = sum(1 << s for s, n in enumerate(self.left) if n)

    def take(self, size: int, n: int) -> None:
        self.left[size] -= n
        if self.left[size]:
            self.bits |= 1 << size
        else:
            self.bits &= ~(1 << size)

    def largest(self, limit: int) -> int:
        return (self.bits & ((1 << limit + 1) - 1)).bit_length() - 1 if limit > 0 else -1

    def tightest_pair(self, least: int, most: int) -> tuple[int, int] | None:
        """Two unpacked documents x >= y of the largest sum in least < x + y <= most."""
        best, pair, x = least, None, self.largest(most - 1)
        while x > 0 and 2 * x > best:
            y = self.largest(min(x, most - x))
            if y == x and self.left[x] < 2:
                y = self.largest(x - 1)
            if y > 0 and x + y > best:
                best, pair = x + y, (x, y)
                if best == most:
                    break
            x = self.largest(x - 1)
        return pair


def _fill(sizes: _Sizes, window: int) -> tuple[dict[int, int], dict[int, int]]:
    """The greedy content of the next sequence and its content after the exchange (size -> number).

    ``sizes`` is left with the final content taken out.
    """
    greedy, gap, size = {}, window, sizes.largest(window)
    while size > 0:
        n = min(sizes.left[size], gap // size)
        greedy[size] = n
        sizes.take(size, n)
        gap -= n * size
        size = sizes.largest(min(gap, size - 1))
    final = dict(greedy)
    if gap and sum(greedy.values()) > 1:
        least = min(greedy)
        pair = sizes.tightest_pair(least, gap + least)
        if pair:
            sizes.take(least, -1)
            final[least] -= 1
            for s in pair:
                sizes.take(s, 1)
                final[s] = final.get(s, 0) + 1
    return greedy, {s: n for s, n in final.items() if n}


def plan(counts: np.ndarray, window: int = WINDOW) -> Plan:
    """The best-two-fit sequences of ``counts[s]`` documents of each size s (0 < s <= window).

    Consecutive sequences of one kind are made at once: a choice is the largest or tightest among
    the sizes left, and sizes only run out, so it stays the same while the sizes it looks at last.
    """
    sizes, used, entries, n = _Sizes(np.asarray(counts, np.int64)), [0] * (window + 1), [], 0
    while sizes.bits:
        before = sizes.left.copy()
        greedy, final = _fill(sizes, window)
        need = {s: max(greedy.get(s, 0), final.get(s, 0)) for s in greedy.keys() | final.keys()}
        times = 1 + min((before[s] - need[s]) // final[s] for s in final)
        at = 0
        for s in sorted(final, reverse=True):
            sizes.take(s, (times - 1) * final[s])
            entries.append((s, used[s], final[s], n, at))
            used[s] += times * final[s]
            at += s * final[s]
        n += times
    cols = np.array(sorted(entries), np.int64).reshape(-1, 5).T
    return Plan(*cols, sequences=n)


def pieces(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", window: int = WINDOW,
           tokenizer: str | None = None, end_id: int = END_ID) -> DataFrame:
    """(doc_id, piece, start, length, ids, task, nth): each document's ids, cut only beyond ``window``.

    ``ids`` are little-endian unsigned 32-bit numbers; ``nth`` counts the pieces of one length in a task.
    """
    path = tokenizer or word_bpe.default_path()

    def run(batches: Iterator) -> Iterator:
        import pyarrow as pa
        from pyspark import TaskContext

        coder, task = word_bpe.load(path), TaskContext.get().partitionId()
        seen = np.zeros(window + 1, np.int64)

        def out(doc, texts):
            ids, bounds = coder.encode(texts)
            n = np.diff(bounds) + 1
            full = np.empty(int(n.sum()), "<u4")
            stop = n.cumsum()
            keep = np.ones(len(full), bool)
            keep[stop - 1] = False
            full[keep], full[stop - 1] = ids, end_id
            parts = (n + window - 1) // window
            own = np.repeat(np.arange(len(n)), parts)
            piece = np.arange(len(own)) - np.repeat(parts.cumsum() - parts, parts)
            start = piece * window
            length = np.minimum(window, n[own] - start)
            order = np.argsort(length, kind="stable")
            sizes, first, many = np.unique(length[order], return_index=True, return_counts=True)
            nth = np.empty(len(own), np.int64)
            nth[order] = np.arange(len(own)) - np.repeat(first, many) + np.repeat(seen[sizes], many)
            seen[sizes] += many
            edges = np.append((stop - n)[own] + start, len(full)).astype(np.int64) * 4  # pieces lie one after the other
            raw = pa.LargeBinaryArray.from_buffers(pa.large_binary(), len(own), [None, pa.py_buffer(edges), pa.py_buffer(full)])
            cols = [pa.array(doc, pa.int64()).take(pa.array(own)), pa.array(piece, pa.int32()), pa.array(start), pa.array(length),
                    raw, pa.array(np.full(len(own), task, np.int32)), pa.array(nth)]
            for lo in range(0, len(own), ROWS_OUT):
                part = [c.slice(lo, ROWS_OUT) for c in cols]
                part[4] = part[4].cast(pa.binary())
                yield pa.RecordBatch.from_arrays(part, ["doc_id", "piece", "start", "length", "ids", "task", "nth"])

        for batch in batches:
            ids, texts, lo, size = batch.column("doc_id").to_pylist(), batch.column("text").to_pylist(), 0, 0
            for i, text in enumerate(texts):
                size += len(text)
                if size >= BATCH_BYTES or i + 1 == len(texts):
                    yield from out(ids[lo:i + 1], texts[lo:i + 1])
                    lo, size = i + 1, 0

    src = docs.select(F.col(id_col).cast("long").alias("doc_id"), text_or_empty(text_col).cast("binary").alias("text"))
    return src.mapInArrow(run, "doc_id long, piece int, start long, length long, ids binary, task int, nth long")


def pack(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", window: int = WINDOW,
         tokenizer: str | None = None, end_id: int = END_ID) -> DataFrame:
    """One row per piece: (doc_id, piece, start, length, ids, sequence_id, offset).

    A document is the ids of its text and ``end_id``.  Only documents longer than ``window`` are
    cut, into pieces of ``window`` ids, the last one shorter.  A null text counts as empty and is
    the end id alone; repeated rows are packed once each; a null id stays null; equal lengths are
    interchangeable and go by task and row.  An empty table gives no rows.  Other columns of
    ``docs`` are not read.  Sequences are numbered from 0 without gaps.
    """
    if window < 1:
        raise ValueError("window must be at least 1")
    cut = materialize(pieces(docs, id_col, text_col, window, tokenizer, end_id), "pieces")
    runs = materialize(cut.groupBy("task", "length").agg(F.count("*").alias("n")), "piece-lengths")
    counts = np.zeros(window + 1, np.int64)
    for r in runs.groupBy("length").agg(F.sum("n").alias("n")).collect():  # at most ``window`` rows
        counts[r["length"]] = r["n"]
    made = plan(counts, window)
    before = Window.partitionBy("length").orderBy("task").rowsBetween(Window.unboundedPreceding, -1)
    ranks = runs.select("task", "length", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("before"))
    if runs.count() <= BROADCAST_ROWS:
        ranks = F.broadcast(ranks)

    @F.pandas_udf("struct<sequence_id: long, offset: long>")
    def place(length, rank):
        import pandas as pd

        return pd.DataFrame(dict(zip(("sequence_id", "offset"), made.place(length.to_numpy(), rank.to_numpy()), strict=True)))

    return (cut.join(ranks, ["task", "length"]).withColumn("to", place("length", F.col("before") + F.col("nth")))
            .select("doc_id", "piece", "start", "length", "ids", "to.sequence_id", "to.offset"))


def sequences(packed: DataFrame) -> DataFrame:
    """(sequence_id, n_ids, ids, doc_ids, offsets): the packed sequences themselves, from ``pack``'s rows.

    A group is one sequence, so at most ``window`` ids.
    """
    own = F.array_sort(F.collect_list(F.struct("offset", "doc_id", "length", "ids")))
    return (packed.groupBy("sequence_id").agg(own.alias("own"))
            .select("sequence_id", F.aggregate("own", F.lit(0).cast("long"), lambda n, p: n + p["length"]).alias("n_ids"),
                    F.aggregate("own", F.lit(b""), lambda b, p: F.concat(b, p["ids"])).alias("ids"),
                    F.col("own.doc_id").alias("doc_ids"), F.col("own.offset").alias("offsets")))


def query(spark, sf_dir):
    """All documents packed whole into sequences of at most 4096 ids."""
    packed = pack(spark.read.parquet(f"{sf_dir}/documents.parquet"))
    return packed.withColumn("ids_crc32", F.crc32("ids")).drop("ids")
