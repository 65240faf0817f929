"""Byte-level BPE ids of whole texts, a batch at a time.

A batch is cut into pretokens with array operations on its code points, every distinct pretoken is
merged once, and the ids are gathered back.  The ids equal those of the ``tokenizers`` library on
the same file, with its default settings (tested); a text with a code point whose class has changed
between Unicode versions, or outside the basic plane, or with the string of an added token, is
encoded by that library itself.
"""

from __future__ import annotations

import functools
import itertools
import json
import os
import unicodedata

import numpy as np

#: Fixed: the split pattern of the vocabulary file.
PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""

SPACE, LETTER, NUMBER, OTHER, END, UNSURE = 0, 1, 2, 3, 4, 255
#: Characters taken through the array operations at once, and pretokens kept with their ids.
CHUNK_CHARS, CACHE_WORDS = 500_000, 500_000
_MASK = np.array([(1 << 8 * k) - 1 for k in range(9)], np.uint64)


@functools.lru_cache(maxsize=1)
def _class_table() -> np.ndarray:
    """Class of every code point; UNSURE where the oldest and the present Unicode tables differ."""
    def kind(cat, cp):
        if cat[0] == "Z" or 9 <= cp <= 13:
            return SPACE
        return {"L": LETTER, "N": NUMBER}.get(cat[0], OTHER)

    table = np.full(0x110000, UNSURE, np.uint8)
    old = unicodedata.ucd_3_2_0
    for cp in range(0x10000):
        c = chr(cp)
        was = old.category(c)
        if was not in ("Cn", "Cs"):
            k = kind(was, cp)
            if k == kind(unicodedata.category(c), cp):
                table[cp] = k
    table[[0x85, 0x1C, 0x1D, 0x1E, 0x1F]] = UNSURE
    return table


def _byte_alphabet() -> dict[str, int]:
    """The printable stand-in of every byte in a byte-level vocabulary file."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    out = {chr(b): b for b in plain}
    rest = (b for b in range(256) if b not in set(plain))
    return out | {chr(256 + i): b for i, b in enumerate(rest)}


class ByteBPE:
    """``encode(texts)`` gives all ids in one array and each text's bounds in it."""

    def __init__(self, path: str):
        import tiktoken

        self.path = path
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        alphabet = _byte_alphabet()
        special = {t["content"] for t in spec.get("added_tokens", ())}
        self._special = sorted(special)
        self.ranks = {bytes(alphabet[c] for c in word): i
                      for word, i in spec["model"]["vocab"].items() if word not in special}
        self._merge = tiktoken.Encoding("vocabulary", pat_str=PATTERN, mergeable_ranks=self.ranks,
                                        special_tokens={})._core_bpe.encode_single_piece
        self._whole = None
        self._reset()

    def _slow(self, text: str) -> list[int]:
        if self._whole is None:
            from tokenizers import Tokenizer

            os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
            self._whole = Tokenizer.from_file(self.path)
        return self._whole.encode(text, add_special_tokens=False).ids

    def encode(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        parts, counts, at = [], [], 0
        while at < len(texts):
            n, chars = at, 0
            while n < len(texts) and (n == at or chars + len(texts[n]) <= CHUNK_CHARS):
                chars += len(texts[n])
                n += 1
            ids, count = self._chunk(texts[at:n])
            parts.append(ids)
            counts.append(count)
            at = n
        bounds = np.concatenate([[0], *counts]).cumsum()
        return (np.concatenate(parts) if parts else np.empty(0, np.int32)), bounds.astype(np.int64)

    def _chunk(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        cps, cls, ends = self._classes(texts)
        doubtful = np.unique(np.searchsorted(ends, np.flatnonzero(cls == UNSURE)))
        marked = [i for i, t in enumerate(texts) if any(s in t for s in self._special)]
        slow = {int(i): np.array(self._slow(texts[i]), np.int32) for i in {*doubtful.tolist(), *marked}}
        if slow:
            texts = ["" if i in slow else t for i, t in enumerate(texts)]
            cps, cls, ends = self._classes(texts)
        ids, counts = self._fast(texts, cps, cls, ends)
        if slow:
            pieces = np.split(ids, counts.cumsum()[:-1])
            for i, x in slow.items():
                pieces[i] = x
                counts[i] = len(x)
            ids = np.concatenate(pieces)
        return ids, counts

    @staticmethod
    def _classes(texts):
        joined = "\0".join(texts) + "\0"
        cps = np.frombuffer(joined.encode("utf-32-le"), "<u4")
        cls = _class_table()[cps]
        ends = (np.fromiter(map(len, texts), np.int64, len(texts)) + 1).cumsum() - 1
        cls[ends] = END
        return cps, cls, ends

    @staticmethod
    def _starts(cps, cls):
        """Where pretokens start, END marks among them."""
        before = np.empty_like(cls)
        before[0], before[1:] = END, cls[:-1]
        start = cls != before
        after = np.flatnonzero(start & (before == SPACE) & (cls != END))  # what follows a space run
        start[after - 1] = True
        start[after[cps[after - 1] == 32]] = False  # a single space belongs to the next pretoken
        start[0] = True
        quote = np.flatnonzero(start & (cps == 39))
        if len(quote):
            far = np.concatenate([cps, np.zeros(3, cps.dtype)])
            one, two = far[quote + 1], far[quote + 2]
            short = quote[np.isin(one, [ord(c) for c in "stmd"])]
            pair = quote[((two == ord("e")) & ((one == ord("r")) | (one == ord("v")))) | ((one == ord("l")) & (two == ord("l")))]
            start[short + 1] = False
            start[short + 2] = True
            start[pair + 1] = False
            start[pair + 3] = True
        return np.flatnonzero(start)

    def _fast(self, texts, cps, cls, ends):
        starts = self._starts(cps, cls)
        real = cls[starts] != END
        stops = np.append(starts[1:], len(cps))[real]
        starts = starts[real]
        first = np.searchsorted(starts, np.append(0, ends + 1))  # of each text's pretokens
        if not len(starts):
            return np.empty(0, np.int32), np.zeros(len(texts), np.int64)
        raw = ("\0".join(texts) + "\0").encode()
        if len(raw) != len(cps):
            at = np.zeros(len(cps) + 1, np.int64)
            np.cumsum(1 + (cps >= 0x80) + (cps >= 0x800), out=at[1:])
            starts, stops = at[starts], at[stops]
        row = self._rows(raw, starts, stops)
        count = self._size[row]
        out_end = count.cumsum()
        shift = self._base[row] - (out_end - count)
        ids = self._flat[np.repeat(shift, count) + np.arange(out_end[-1])]
        edge = np.append(0, out_end)[first]
        return ids, np.diff(edge)

    def _reset(self):
        """No pretoken known: by hash in order, its key columns, and its row of ids."""
        self._hash, self._row = np.empty(0, np.uint64), np.empty(0, np.int64)
        self._keys = [np.empty(0, np.uint64) for _ in range(4)]
        self._flat, self._base, self._size = np.empty(0, np.int32), np.empty(0, np.int64), np.empty(0, np.int64)

    def _rows(self, raw, starts, stops):
        """The row of ids of each pretoken.  Exact: the hash sorts, the keys decide."""
        if len(self._size) > CACHE_WORDS:
            self._reset()
        size = stops - starts
        words = np.ndarray((len(raw) + 17,), "<u8", raw + bytes(24), strides=(1,))
        keys = [words[np.minimum(starts + o, len(raw))] & _MASK[np.clip(size - o, 0, 8)] for o in (0, 8, 16)]
        keys.append(size.astype(np.uint64))
        h = keys[3] * np.uint64(0x9E3779B97F4A7C15)
        for k in keys[:3]:
            h ^= k
            h *= np.uint64(0xC2B2AE3D27D4EB4F)
            h ^= h >> np.uint64(29)
        order = np.argsort(h, kind="stable")
        hs = h[order]
        fresh = np.append(True, hs[1:] != hs[:-1])
        group = fresh.cumsum() - 1
        rep, hs = order[fresh], hs[fresh]
        spot = np.minimum(np.searchsorted(self._hash, hs), max(len(self._hash) - 1, 0))
        known = self._hash[spot] == hs if len(self._hash) else np.zeros(len(hs), bool)
        row = np.empty(len(hs), np.int64)
        row[known] = self._row[spot[known]]
        new = rep[~known]
        if len(new):
            row[~known] = self._learn([raw[a:b] for a, b in zip(starts[new].tolist(), stops[new].tolist(), strict=True)])
            at = np.searchsorted(self._hash, hs[~known])
            self._hash = np.insert(self._hash, at, hs[~known])
            self._row = np.insert(self._row, at, row[~known])
            self._keys = [np.insert(old, at, k[new]) for old, k in zip(self._keys, keys, strict=True)]
            spot = np.searchsorted(self._hash, hs)
        same = size <= 24
        for old, k in zip(self._keys, keys, strict=True):
            same[order] &= k[order] == old[spot][group]
        out = np.empty(len(starts), np.int64)
        out[order] = row[group]
        odd = np.flatnonzero(~same)  # longer than the keys, or another pretoken with the same hash
        if len(odd):
            text = [raw[starts[i]:stops[i]] for i in odd.tolist()]
            place = {w: None for w in text}
            place = dict(zip(place, self._learn(list(place)).tolist(), strict=True))
            out[odd] = [place[w] for w in text]
        return out

    def _learn(self, words):
        """Merge new pretokens and append their ids; their rows."""
        ranks, merge = self.ranks, self._merge
        coded = [(one,) if (one := ranks.get(w)) is not None else merge(w) for w in words]
        size = np.fromiter(map(len, coded), np.int64, len(coded))
        flat = np.fromiter(itertools.chain.from_iterable(coded), np.int32, int(size.sum()))
        first = len(self._size)
        self._base = np.concatenate([self._base, len(self._flat) + size.cumsum() - size])
        self._size = np.concatenate([self._size, size])
        self._flat = np.concatenate([self._flat, flat])
        return np.arange(first, first + len(words))


@functools.lru_cache(maxsize=2)
def load(path: str) -> ByteBPE:
    """The encoder of a vocabulary file, once per Python worker."""
    return ByteBPE(path)


def default_path() -> str:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")
