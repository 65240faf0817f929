"""Sum-of-squares packing of token ids into fixed windows.

Every task packs its own rows as they come.  Whole windows are cut off a document first; its tail
goes to the open window whose use makes the sum over fill levels of (open windows at that level)
squared smallest, or to a new window if that is smaller.  ``levels[h]`` counts the open windows
with h ids.  Cuts are free: when a task holds as many open windows as it may, a tail that fits none of
them fills one up, of the level where that lowers the sum of squares most, and its rest is placed
again.  At the end of a task the open windows are closed into each other by cutting, so a task leaves
at most one window short.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gridweave.llm import bpe
from gridweave.llm.common import text_or_empty

WINDOW, END_ID = 2048, 1
#: Open windows a task may hold; at that number tails are cut rather than given a new window.
MAX_OPEN = 1024

SCHEMA = ("doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, "
          "offset long, ids binary")


class Packer:
    """Online packing of (document, ids); ``add`` and ``close`` return finished windows.

    A window is a list of pieces (document, start, ids, ids of the document).
    """

    def __init__(self, window: int = WINDOW, max_open: int = MAX_OPEN):
        self.window, self.max_open = window, max_open
        self.levels = np.zeros(window + 1, np.int64)
        self.open: dict[int, list] = {}
        self.n_open = 0

    def place(self, size: int, fresh: bool = True) -> int:
        """The fill level that takes ``size`` ids at the least sum of squares (0: a new window, or without ``fresh`` none).

        Moving a window from h to h + size changes the sum by 2 (levels[h + size] - levels[h]) + 2,
        a full window by -2 levels[h] + 1, a new one by 2 levels[size] + 1.  Ties go to the fullest.
        """
        room = self.window - size
        if room <= 0:
            return 0
        cost = 2 * (self.levels[size:self.window + 1] - self.levels[:room + 1]) + 2
        cost[room] = 1 - 2 * self.levels[room]
        cost[0] = 2 * self.levels[size] + 1 if fresh else np.iinfo(np.int64).max
        cost[1:][self.levels[1:room + 1] == 0] = np.iinfo(np.int64).max
        return int(room - np.argmin(cost[::-1]))

    def add(self, doc, ids: np.ndarray) -> list[list]:
        done, n = [], len(ids)
        whole = n - n % self.window
        for at in range(0, whole, self.window):
            done.append([(doc, at, ids[at:at + self.window], n)])
        at = whole
        while at < n:
            size = n - at
            fresh = self.n_open < self.max_open
            h = self.place(size, fresh)
            if not fresh and self.levels[h] == 0:  # it fits no open window: the level that loses most by one filled up
                least = max(1, self.window - size + 1)
                h = least + int(np.argmax(self.levels[least:self.window]))
                size = self.window - h
            win = self.open[h].pop() if h else []
            if h:
                self.levels[h] -= 1
                self.n_open -= 1
            win.append((doc, at, ids[at:at + size].copy(), n))
            at += size
            if h + size == self.window:
                done.append(win)
            else:
                self.open.setdefault(h + size, []).append(win)
                self.levels[h + size] += 1
                self.n_open += 1
        return done

    def close(self) -> list[list]:
        """Close all open windows: the fullest are filled up with cuts from the emptiest."""
        windows = [w for h in sorted(self.open, reverse=True) for w in self.open[h]]
        self.open, self.n_open = {}, 0
        self.levels[:] = 0
        done, last = [], len(windows) - 1
        for i, win in enumerate(windows):
            if i > last:
                break
            room = self.window - sum(len(p[2]) for p in win)
            while room and last > i:
                source = windows[last]
                if not source:
                    last -= 1
                    continue
                doc, start, ids, n = source.pop()
                if len(ids) > room:
                    source.append((doc, start, ids[:len(ids) - room], n))
                    start, ids = start + len(ids) - room, ids[len(ids) - room:]
                win.append((doc, start, ids, n))
                room -= len(ids)
            if win:
                done.append(win)
        return done


def pack(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", window: int = WINDOW,
         tokenizer: str | None = None, end_id: int = END_ID, with_ids: bool = False) -> DataFrame:
    """One row per piece: (doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset, ids).

    A null text counts as empty and still has its end id; repeated rows are packed once each.
    Sequences are numbered partition << 32 | window; ``ids`` holds the piece's ids as
    little-endian 32-bit numbers, or null unless ``with_ids``.  An empty table gives no rows.
    """
    path = tokenizer or bpe.default_path()
    src = docs.select(F.col(id_col).cast("long").alias("doc_id"), text_or_empty(text_col).alias("text"))

    def run(batches: Iterator) -> Iterator:
        import pyarrow as pa
        from pyspark import TaskContext

        packer, coder, number = Packer(window), bpe.load(path), TaskContext.get().partitionId() << 32

        def rows(windows):
            nonlocal number
            cols = [[] for _ in range(8)]
            for win in windows:
                at = 0
                for doc, start, ids, n in win:
                    raw = ids.astype("<u4").tobytes()
                    for c, v in zip(cols, (doc, start, len(ids), zlib.crc32(raw), n, number, at, raw if with_ids else None),
                                    strict=True):
                        c.append(v)
                    at += len(ids)
                number += 1
            names = ["doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset", "ids"]
            kinds = [pa.int64()] * 7 + [pa.binary()]
            return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(cols, kinds, strict=True)], names)

        for big in batches:
            for lo in range(0, big.num_rows, 1000):
                batch = big.slice(lo, 1000)
                ids, bounds = coder.encode(batch.column("text").to_pylist())
                done = []
                for i, doc in enumerate(batch.column("doc_id").to_pylist()):
                    done += packer.add(doc, np.append(ids[bounds[i]:bounds[i + 1]], np.int32(end_id)))
                yield rows(done)
        yield rows(packer.close())

    return src.mapInArrow(run, SCHEMA)


def query(spark, sf_dir):
    """All documents packed into windows of 2048 ids."""
    return pack(spark.read.parquet(f"{sf_dir}/documents.parquet")).drop("ids")
