"""SentencePiece encoding and decoding: an Aho-Corasick automaton drives a single-pass Viterbi.

The automaton holds all normal pieces of the model.  One pass over a text reports, at every
position, the pieces that end there by following output links; each relaxes the best score of that
position.  Characters that no piece covers become the bytes of their UTF-8 form.

No piece has the space mark behind another character, so no piece crosses from one word into the
next space; the best path of a text is the best paths of its words side by side, and each distinct
word is passed through the automaton once per task (cache of a bounded number of words).
"""

from __future__ import annotations

import functools
import re
import zlib
from array import array
from collections.abc import Iterator

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gridweave.llm.common import text_or_empty

#: Fixed by the model format: the space mark, and the penalty of a character without a piece.
MARK, UNKNOWN_PENALTY = "▁", 10.0
CACHE_WORDS = 400_000
_NEVER = float("-inf")
_SPLIT = re.compile(f"{MARK}*[^{MARK}]+|{MARK}+")


class Codec:
    """``encode(text)`` gives ids as little-endian 32-bit bytes, ``decode(ids)`` the text."""

    def __init__(self, pieces: list[tuple[str, float, str]]):
        """``pieces``: (piece, score, kind) by id; kind is normal, byte, unknown or control."""
        import ahocorasick

        self.automaton = ahocorasick.Automaton()
        self.bytes_of: list[bytes] = []
        self.byte_id: dict[int, int] = {}
        self.single: set[str] = set()
        self.unknown_id, low = 0, 0.0
        crossing = []
        for i, (piece, score, kind) in enumerate(pieces):
            raw = b""
            if kind == "normal":
                self.automaton.add_word(piece, (len(piece) - 1, score, i))
                low = min(low, score)
                raw = piece.encode()
                if len(piece) == 1:
                    self.single.add(piece)
                if MARK in piece.lstrip(MARK):
                    crossing.append(piece)
            elif kind == "byte":
                self.byte_id[int(piece[3:5], 16)] = i
                raw = bytes([int(piece[3:5], 16)])
            elif kind == "unknown":
                self.unknown_id, raw = i, " ⁇ ".encode()
            self.bytes_of.append(raw)
        self.automaton.make_automaton()
        self.unknown_score = low - UNKNOWN_PENALTY
        self.whole_words = not crossing
        #: A line end in no piece is always bytes of its own, so lines are best apart.
        self.line_end = None if any("\n" in p for p, _, k in pieces if k == "normal") else array(
            "i", [self.byte_id.get(10, self.unknown_id)]).tobytes()
        self._cache: dict[str, bytes] = {}

    def viterbi(self, text: str) -> list[int]:
        """Ids of the best path; at equal scores the longer last piece wins."""
        n = len(text)
        best, back = [_NEVER] * (n + 1), [None] * (n + 1)
        best[0] = 0.0
        if self.single.issuperset(text):
            for end, found in self.automaton.iter(text):
                here = best[end - found[0]] + found[1]
                if here > best[end + 1]:
                    best[end + 1], back[end + 1] = here, found
        else:
            done = 0  # positions up to here have taken their unknown step
            for end, found in self.automaton.iter(text):
                if done < end:
                    done = self._unknown_steps(text, best, back, done, end)
                here = best[end - found[0]] + found[1]
                if here > best[end + 1]:
                    best[end + 1], back[end + 1] = here, found
            self._unknown_steps(text, best, back, done, n)
        out, at = [], n
        while at:
            found = back[at]
            if found is None:
                raw = text[at - 1].encode()
                out += [self.byte_id.get(b, self.unknown_id) for b in reversed(raw)] if self.byte_id else [self.unknown_id]
                at -= 1
            else:
                out.append(found[2])
                at -= found[0] + 1
        return out[::-1]

    def _unknown_steps(self, text, best, back, done, upto):
        """Let every position after ``done`` and up to ``upto`` be reached by an unknown character."""
        for at in range(done + 1, upto + 1):
            if text[at - 1] not in self.single:
                here = best[at - 1] + self.unknown_score
                if here > best[at]:
                    best[at], back[at] = here, None
        return upto

    def _word(self, word: str) -> bytes:
        if len(self._cache) > CACHE_WORDS:
            self._cache.clear()
        ids = self._cache[word] = array("i", self.viterbi(word)).tobytes()
        return ids

    def encode(self, text: str) -> bytes:
        """Ids of a whole text; the empty text has none.  Spaces become marks, one is put in front."""
        if not text:
            return b""
        if not self.whole_words:
            return array("i", self.viterbi(MARK + text.replace(" ", MARK))).tobytes()
        if self.line_end is not None and "\n" in text:
            return self.line_end.join([self._line(x, "" if i else MARK) for i, x in enumerate(text.split("\n"))])
        return self._line(text, MARK)

    def _line(self, text: str, front: str) -> bytes:
        if MARK in text or "  " in text or text[:1] == " ":
            words = _SPLIT.findall(front + text.replace(" ", MARK))
        else:
            first, *rest = text.split(" ")
            words = [front + first, *[MARK + w for w in rest]] if front or first else [MARK + w for w in rest]
        get = self._cache.get
        parts = [get(w) for w in words]
        if None in parts:
            parts = [self._word(w) if p is None else p for w, p in zip(words, parts, strict=True)]
        return b"".join(parts)

    def decode(self, ids: bytes) -> str:
        """The text of ids: pieces and bytes joined, marks as spaces, without the space in front."""
        raw = b"".join(map(self.bytes_of.__getitem__, array("i", ids)))
        text = raw.decode("utf-8", "replace").replace(MARK, " ")
        return text[1:] if text.startswith(" ") else text


@functools.lru_cache(maxsize=2)
def load(path: str) -> Codec:
    """The codec of a SentencePiece model file, once per Python worker."""
    import sentencepiece

    m = sentencepiece.SentencePieceProcessor(model_file=path)

    def kind(i):
        return ("byte" if m.is_byte(i) else "unknown" if m.is_unknown(i) else
                "control" if m.is_control(i) or m.is_unused(i) else "normal")

    return Codec([(m.id_to_piece(i), m.get_score(i), kind(i)) for i in range(m.get_piece_size())])


def default_path() -> str:
    import public_tokenizers

    return public_tokenizers.path("piece_bpe_32k.model")


def encode(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", model: str | None = None) -> DataFrame:
    """(doc_id, ids): the ids of every row's whole text as little-endian 32-bit bytes.

    Null and empty texts have no ids; repeated rows get equal ids; an empty table gives no rows.
    """
    path = model or default_path()

    def run(batches: Iterator) -> Iterator:
        import pyarrow as pa

        codec = load(path)
        for big in batches:
            for lo in range(0, big.num_rows, 500):
                batch = big.slice(lo, 500)
                ids = [codec.encode(t.as_py()) for t in batch.column("text")]
                yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(ids, pa.binary())], ["doc_id", "ids"])

    src = docs.select(F.col(id_col).cast("long").alias("doc_id"), text_or_empty(text_col).alias("text"))
    return src.mapInArrow(run, "doc_id long, ids binary")


def decode(encoded: DataFrame, model: str | None = None) -> DataFrame:
    """(doc_id, text) of rows (doc_id, ids); null ids are the empty text."""
    path = model or default_path()

    def run(batches: Iterator) -> Iterator:
        import pyarrow as pa

        codec = load(path)
        for batch in batches:
            texts = [codec.decode(i.as_py() or b"") for i in batch.column("ids")]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(texts, pa.string())], ["doc_id", "text"])

    return encoded.select("doc_id", "ids").mapInArrow(run, "doc_id long, text string")


def round_trip(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", model: str | None = None) -> DataFrame:
    """(doc_id, n_ids, ids_crc32, n_byte_ids, restored) of every row, encoded and decoded in one pass.

    ``n_byte_ids`` counts ids of single bytes; ``restored`` tells whether decoding gives the text
    back (with space marks in it read as spaces, as the format has it).
    """
    path = model or default_path()

    def run(batches: Iterator) -> Iterator:
        import numpy as np
        import pyarrow as pa

        codec = load(path)
        byte_like = np.zeros(len(codec.bytes_of), bool)
        byte_like[list(codec.byte_id.values())] = True
        for batch in batches:
            out = []
            for t in batch.column("text"):
                text = t.as_py()
                ids = codec.encode(text)
                back = codec.decode(ids) == text.replace(MARK, " ")
                out.append((len(ids) // 4, zlib.crc32(ids), int(byte_like[np.frombuffer(ids, "<i4")].sum()), back))
            cols = list(zip(*out, strict=True)) or [[]] * 4
            kinds = [pa.int64(), pa.int64(), pa.int64(), pa.bool_()]
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), *[pa.array(c, k) for c, k in zip(cols, kinds, strict=True)]],
                ["doc_id", "n_ids", "ids_crc32", "n_byte_ids", "restored"])

    src = docs.select(F.col(id_col).cast("long").alias("doc_id"), text_or_empty(text_col).alias("text"))
    return src.mapInArrow(run, "doc_id long, n_ids long, ids_crc32 long, n_byte_ids long, restored boolean")


def query(spark, sf_dir):
    """All documents encoded with the 32k piece vocabulary and decoded again."""
    return round_trip(spark.read.parquet(f"{sf_dir}/documents.parquet"))
