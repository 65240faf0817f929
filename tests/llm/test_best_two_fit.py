"""Operator 11 and its word-level encoder."""

import random
import zlib
from collections import defaultdict

import numpy as np
import pytest
from tokenizers import Tokenizer

from conftest import SF_SMALL
from gridweave.llm import best_two_fit, word_bpe


@pytest.fixture(scope="module")
def whole():
    return Tokenizer.from_file(word_bpe.default_path())


def _random_text(rng):
    alphabet = ["a", "B", "é", "ß", "Σ", "İ", "日", "本", "9", "²", "'s", "'re", ".", "!?", " ", "  ", "\n", "\t", "\x0b", "\x0c",
                "\x1c", "\x85", "\xa0", " ", "́", "̸", "=", "<|endoftext|>", "<|startoftext|>", "<|", "<|ENDOFTEXT|>", "I", "İ", "K", "\U0001f600", "\0"]
    return "".join(rng.choice(alphabet) for _ in range(rng.randrange(40)))


def test_ids_equal_the_library_on_whole_texts(whole):
    rng = random.Random(5)
    texts = ["", " ", "a <|endoftext|> b", *(_random_text(rng) for _ in range(20_000))]
    coder = word_bpe.load(word_bpe.default_path())
    for lo in range(0, len(texts), 999):
        part = texts[lo:lo + 999]
        ids, bounds = coder.encode([t.encode() for t in part])
        for t, a, b in zip(part, bounds, bounds[1:], strict=False):
            assert ids[a:b].tolist() == whole.encode(t, add_special_tokens=False).ids, repr(t)


def test_words_merged_here_equal_the_library(whole):
    """Every entry of the vocabulary, and random words of the characters that are split here."""
    rng = random.Random(6)
    own = word_bpe.WordBPE(word_bpe.default_path())
    chars = [chr(c) for c in range(0x21, 0x7F)] + list("abcdefghij" * 6) + list(word_bpe.ACCENTED)
    words = ["".join(rng.choice(chars) for _ in range(rng.randint(1, 14))) for _ in range(60_000)]
    words += [c for c in chars] + [w for w in whole.get_vocab()] + [w.removesuffix("</w>") for w in whole.get_vocab()]
    words = [w for w in words if own._plain(w)]
    assert len(words) > 100_000
    for w, e in zip(words, whole.encode_batch(words, add_special_tokens=False), strict=True):
        assert own._code(w.encode()) == e.ids, w


def test_cache_limit_does_not_change_ids(whole, monkeypatch):
    monkeypatch.setattr(word_bpe, "CACHE_WORDS", 3)
    coder = word_bpe.WordBPE(word_bpe.default_path())
    for text in ("one two three four five", "five four", "", "six one"):
        ids, bounds = coder.encode([text.encode()])
        assert ids.tolist() == whole.encode(text, add_special_tokens=False).ids and bounds.tolist() == [0, len(ids)]


def _one_by_one(counts, window):
    """Best-two-fit as described, one sequence and one document at a time, over plain lists."""
    left = [s for s, n in enumerate(counts) for _ in range(n)]
    out = []
    while left:
        seq = []
        for s in sorted(left, reverse=True):
            if sum(seq) + s <= window:
                seq.append(s)
                left.remove(s)
        gap = window - sum(seq)
        if gap and len(seq) > 1:
            least, best = min(seq), None
            for x in sorted(set(left), reverse=True):
                for y in sorted(set(left), reverse=True):
                    if x >= y and (x > y or left.count(x) > 1) and least < x + y <= gap + least and (
                            best is None or x + y > sum(best)):
                        best = (x, y)
            if best:
                seq.remove(least)
                left.append(least)
                for s in best:
                    left.remove(s)
                seq += best
        out.append(sorted(seq))
    return out


@pytest.mark.parametrize("seed", range(60))
def test_plan_equals_one_sequence_at_a_time(seed):
    rng = random.Random(seed)
    window = rng.choice([1, 2, 7, 20, 40])
    counts = np.zeros(window + 1, np.int64)
    for _ in range(rng.randrange(90)):
        counts[rng.choice([rng.randint(1, window), rng.randint(1, max(1, window // 3)), window])] += 1
    got = best_two_fit.plan(counts, window)
    content = defaultdict(list)
    for size in range(1, window + 1):
        seq, at = got.place(np.full(counts[size], size), np.arange(counts[size]))
        for s, o in zip(seq.tolist(), at.tolist(), strict=True):
            content[s].append((o, size))
    want = _one_by_one(counts, window)
    assert [sorted(s for _, s in content[i]) for i in range(len(want))] == want and got.sequences == len(want) == len(content)
    for own in content.values():
        at = 0
        for o, size in sorted(own):
            assert o == at
            at += size
        assert at <= window


def test_exchange_saves_sequences():
    counts = np.zeros(101, np.int64)
    counts[[60, 30, 21, 19]] = [10, 10, 10, 10]  # greedy alone fills 60 + 30; the exchange finds 60 + 21 + 19
    assert best_two_fit.plan(counts, 100).sequences == 14
    kinds = best_two_fit.plan(counts, 100)
    seq, _ = kinds.place(np.array([60, 21, 19]), np.array([0, 0, 0]))
    assert len(set(seq.tolist())) == 1


def test_plan_of_a_billion_documents_is_small():
    counts = np.zeros(4097, np.int64)
    rng = np.random.default_rng(1)
    counts[1:] = rng.pareto(1.1, 4096) * 100_000
    counts[1:500] += 2_000_000
    made = best_two_fit.plan(counts)
    assert counts.sum() > 1e9 and len(made.size) < 60_000
    least = max((counts * np.arange(4097)).sum() / 4096, counts[2049:].sum())  # no two of the latter share a sequence
    assert made.sequences <= 1.002 * least + 1


def _check(rows, docs, window, whole):
    ids = {}
    for i, (_, text) in enumerate(docs):
        ids[i] = whole.encode(text or "", add_special_tokens=False).ids + [1]
    want = sorted((str(docs[i][0]), p // window, p, x[p:p + window]) for i, x in ids.items() for p in range(0, len(x), window))
    got = sorted((str(r.doc_id), r.piece, r.start, np.frombuffer(r.ids, "<u4").tolist()) for r in rows)
    assert got == want
    held = defaultdict(list)
    for r in rows:
        assert r.length == len(r.ids) // 4
        held[r.sequence_id].append((r.offset, r.length))
    for own in held.values():
        at = 0
        for o, n in sorted(own):
            assert o == at
            at += n
        assert 0 < at <= window
    assert sorted(held) == list(range(len(held)))
    return len(held)


@pytest.mark.parametrize("window", [1, 3, 16, 4096])
def test_every_piece_has_its_ids_and_a_gapless_place(spark, whole, window):
    rng = random.Random(window)
    docs = [(i, _random_text(rng)) for i in range(120)] + [(5, "same row"), (5, "same row"), (None, "no id"), (7, None), (8, ""),
                                                           (9, "word " * 5000)]
    df = spark.createDataFrame([(*d, "x", 0, "y") for d in docs], "doc_id long, text string, ids string, nth int, task string")
    rows = best_two_fit.pack(df.repartition(5), window=window).collect()
    _check(rows, docs, window, whole)


def test_sequences_hold_the_ids_of_their_pieces(spark, whole):
    docs = [(i, "some words " * i) for i in range(40)]
    packed = best_two_fit.pack(spark.createDataFrame(docs, "doc_id long, text string"), window=32)
    for r in best_two_fit.sequences(packed).collect():
        ids = np.frombuffer(r.ids, "<u4")
        assert len(ids) == r.n_ids <= 32 and len(r.doc_ids) == len(r.offsets)
        assert (ids[np.array(r.offsets[1:], int) - 1] == 1).all() or len(r.offsets) == 1 or r.n_ids == 32


def test_ranks_by_a_shuffle_join_are_the_same(spark, whole, monkeypatch):
    docs = [(i, "a b c " * (i % 7)) for i in range(200)]
    df = spark.createDataFrame(docs, "doc_id long, text string").repartition(6)
    monkeypatch.setattr(best_two_fit, "BROADCAST_ROWS", 0)
    rows = best_two_fit.pack(df, window=16).collect()
    _check(rows, docs, 16, whole)


def test_empty_table(spark):
    assert best_two_fit.pack(spark.createDataFrame([], "doc_id long, text string")).collect() == []


def test_query_on_the_whole_table(spark, whole):
    docs = [tuple(r) for r in spark.read.parquet(f"{SF_SMALL}/documents.parquet").select("doc_id", "text").collect()]
    rows = best_two_fit.pack(spark.read.parquet(f"{SF_SMALL}/documents.parquet")).collect()
    n = _check(rows, docs, 4096, whole)
    assert n <= 1.02 * sum(r.length for r in rows) / 4096 + 1
    by_key = {(r.doc_id, r.piece): zlib.crc32(r.ids) for r in rows}
    from gridweave.llm.queries import queries

    out = queries()["op11_best_two_fit"](spark, SF_SMALL).collect()
    assert {(r.doc_id, r.piece): r.ids_crc32 for r in out} == by_key
