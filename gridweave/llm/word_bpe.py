"""Word-level BPE ids of whole texts, a batch at a time.

The vocabulary's normaliser and split pattern never carry anything over white space, so a text's
ids are the ids of its words (cut at ASCII white space) one after the other.  Every distinct word
is encoded once and the ids are gathered back with array operations; the result equals that of the
``tokenizers`` library, with its default settings, on the whole text (tested).

Words of ASCII and accented Latin letters, digits and signs are split here and merged by the byte-pair
routine of ``tiktoken``, in which the end of a word is one byte more that merges first; all others
are encoded by the library itself.
"""

from __future__ import annotations

import functools
import itertools
import json
import os
import re
from collections import defaultdict

import numpy as np

#: A worker forgets its words beyond this many, or this many bytes of them.
CACHE_WORDS, CACHE_BYTES = 600_000, 16_000_000
#: Fixed: the split pattern of the vocabulary file, for lower-case words of the characters below.
ACCENTED = "".join(chr(c) for c in range(0xC0, 0x180) if c not in (0xD7, 0xF7, 0x130, 0x149, 0x17F))
PATTERN = "'s|'t|'re|'ve|'m|'ll|'d|[a-z" + ACCENTED.lower() + "]+|[0-9]|[^a-z" + ACCENTED.lower() + "0-9]+"
#: Marks the end of a word; UTF-8 has no such byte.
_END = b"\xff"


def _byte_alphabet() -> dict[str, int]:
    """The byte of every printable stand-in in the vocabulary file."""
    plain = {*range(33, 127), *range(161, 173), *range(174, 256)}
    rest = [b for b in range(256) if b not in plain]
    return {chr(b): b for b in plain} | {chr(256 + i): b for i, b in enumerate(rest)}


class WordBPE:
    """``encode(texts)`` (UTF-8 bytes) gives all ids in one array and each text's bounds in it."""

    def __init__(self, path: str):
        import tiktoken
        from tokenizers import Tokenizer

        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        self._whole = Tokenizer.from_file(path)
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        suffix, alphabet = spec["model"]["end_of_word_suffix"], _byte_alphabet()
        special = {t["content"] for t in spec.get("added_tokens", ())}
        ranks = {_END: len(spec["model"]["vocab"]) + len(special)}
        for word, i in spec["model"]["vocab"].items():
            if word not in special:
                stem = word.removesuffix(suffix)
                ranks[bytes(alphabet[c] for c in stem) + _END * (stem != word)] = i
        for b in range(256):
            ranks.setdefault(bytes([b]), ranks[_END] + 1 + b)  # never in a text
        self._merge = tiktoken.Encoding("words", pat_str=".", mergeable_ranks=ranks, special_tokens={})._core_bpe.encode_single_piece
        self._split = re.compile(PATTERN).findall
        self._plain = re.compile("[\x21-\x3b\x3d-\x7e" + ACCENTED + "]+").fullmatch  # without "<", which begins the added tokens
        self._sign = {b: self._merge(bytes([b]) + _END) for b in b".,;:!?)"}
        self._reset()

    def _reset(self) -> None:
        self._row: defaultdict[bytes, int] = defaultdict()
        self._row.default_factory = self._row.__len__  # a new word gets the next row
        self._bytes = 0
        self._flat, self._base, self._size = np.empty(0, np.int32), np.empty(0, np.int64), np.empty(0, np.int64)

    def _code(self, word: bytes) -> list[int]:
        """The ids of one word."""
        if word.isalpha():  # of bytes: ASCII letters only
            return self._merge(word.lower() + _END)
        if word[-1] in self._sign and word[:-1].isalpha():
            return self._merge(word[:-1].lower() + _END) + self._sign[word[-1]]
        text = word.decode()
        if not self._plain(text):
            return self._whole.encode(text, add_special_tokens=False).ids
        return [i for piece in self._split(text.lower()) for i in self._merge(piece.encode() + _END)]

    def _learn(self, words: list[bytes]) -> None:
        coded = list(map(self._code, words))
        size = np.fromiter(map(len, coded), np.int64, len(coded))
        self._base = np.concatenate([self._base, len(self._flat) + size.cumsum() - size])
        self._size = np.concatenate([self._size, size])
        self._flat = np.concatenate([self._flat, np.fromiter(itertools.chain.from_iterable(coded), np.int32, int(size.sum()))])
        self._bytes += sum(map(len, words))

    def encode(self, texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        if len(self._row) > CACHE_WORDS or self._bytes > CACHE_BYTES:
            self._reset()
        # the vocabulary is of lower-case words; only an added token must keep its case
        split = [(t if b"<|" in t else t.lower()).split() for t in texts]
        words = list(itertools.chain.from_iterable(split))
        row = np.fromiter(map(self._row.__getitem__, words), np.int64, len(words))
        new = list(itertools.islice(reversed(self._row), len(self._row) - len(self._size)))
        if new:
            self._learn(new[::-1])
        count = self._size[row]
        end = count.cumsum()
        total = int(end[-1]) if len(end) else 0
        ids = self._flat[np.repeat(self._base[row] - (end - count), count) + np.arange(total)]
        last = np.fromiter(map(len, split), np.int64, len(split)).cumsum()
        return ids, np.append(0, end)[np.append(0, last)]


@functools.lru_cache(maxsize=2)
def load(path: str) -> WordBPE:
    """The encoder of a vocabulary file, once per Python worker."""
    return WordBPE(path)


def default_path() -> str:
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")
