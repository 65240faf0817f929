"""Operator 12 against brute force."""

import random
import re
from collections import Counter, defaultdict

import numpy as np
import pytest

from gridweave.llm import phrase_mining as pm

SCHEMA = "lang string, text string, chunk string, idx string, n string, word string, f string, rank int"


def _frame(spark, docs):
    return spark.createDataFrame([(*d, "c", "i", "n", "w", "f", 1) for d in docs], SCHEMA)


def _brute(docs, min_count, top=2000, longest=5):
    f = defaultdict(Counter)
    for lang, text in docs:
        low = re.sub("[A-Z]", lambda m: m.group().lower(), text or "")
        for piece in re.split("[.,;:!?\n\x0b\x0c\r]", low):
            w = re.findall("[^ \t]+", piece)
            for k in range(1, longest + 1):
                f[lang or "und"].update(tuple(w[i:i + k]) for i in range(len(w) - k + 1))
    out = []
    for lang, count in f.items():
        n = sum(c for p, c in count.items() if len(p) == 1)
        cand = {p: c for p, c in count.items() if len(p) > 1 and c >= min_count}
        gone = {q for p, c in cand.items() for k in range(2, len(p)) for i in range(len(p) - k + 1)
                if c >= cand[q := p[i:i + k]]}
        scored = []
        for p, a in cand.items():
            if p not in gone:
                cut = min(((1000 * a * n) // (count[p[:k]] * count[p[k:]]), k) for k in range(1, len(p)))
                scored.append((-cut[0], -a, " ".join(p).encode(), count[p[:cut[1]]], count[p[cut[1]:]]))
        for rank, (s, a, p, le, r) in enumerate(sorted(scored)[:top], 1):
            out.append((lang, rank, p.decode(), -a, le, r, n, -s))
    return sorted(out)


def _docs(seed, n=150):
    rng = random.Random(seed)
    fixed = ["new york city", "the end", "á é Í", "a a a a a a", "one two three four five six seven"]
    docs = []
    for _ in range(n):
        parts = []
        for _ in range(rng.randrange(12)):
            parts.append(rng.choice([rng.choice(fixed), rng.choice("abcdeXYZ"), rng.choice(fixed).title()]))
            parts.append(rng.choice([" ", " ", " ", "  ", "\t", ".", ", ", "\n", "\x0b", "\x0c", " \r", "!?", "\x1c", "\x85", "\xa0", ";:"]))
        docs.append((rng.choice(["en", "en", "de", None]), "".join(parts)))
    return docs


@pytest.mark.parametrize(("seed", "chunk", "broadcast"), [(1, 2_000_000, 1000), (2, 50, 1000), (3, 7, 0)])
def test_equals_brute_force(spark, monkeypatch, seed, chunk, broadcast):
    monkeypatch.setattr(pm, "BROADCAST_SYMBOLS", broadcast)
    monkeypatch.setattr(pm, "SHARE_PAIRS", 200)
    docs = [*_docs(seed), (None, None), ("en", ""), ("xx", "..."), ("yy", "only one")]
    got = pm.collocations(_frame(spark, docs).repartition(4), min_count=5, chunk_words=chunk).collect()
    want = _brute(docs, 5)
    assert len(want) > 20 and sorted(map(tuple, got)) == want


def test_top_and_longest(spark):
    docs = _docs(9)
    got = pm.collocations(_frame(spark, docs), min_count=3, top=4, longest=3).collect()
    assert sorted(map(tuple, got)) == _brute(docs, 3, 4, 3)


def test_copies_and_empty_tables(spark):
    docs = [("en", "to be or not to be")] * 30
    assert sorted(map(tuple, pm.collocations(_frame(spark, docs), min_count=30).collect())) == _brute(docs, 30)
    for none in ([], [(None, None)], [("en", "!!!")], [("en", "a")]):
        assert pm.collocations(_frame(spark, none), min_count=1).collect() == []


def test_scores_beyond_64_bits(spark):
    """1000 a n and l r of a corpus of 10^13 words, through the operator's own expression."""
    from unittest.mock import patch

    a, n, le, r = 3_000_000_000_001, 90_000_000_000_017, 7_000_000_000_003, 5_000_000_000_011
    every = spark.createDataFrame([("en", 2, bytearray(b"x y"), a, [le, a], [r, a], 0)],
                                  "lang string, words int, phrase binary, f long, heads array<long>, tails array<long>, contained long")
    totals = spark.createDataFrame([("en", n)], "lang string, n long")
    with patch.object(pm, "phrases", lambda *_: (every, totals)):
        row = pm.collocations(None).first()
    assert row.score == 1000 * a * n // (le * r) and (row.l, row.r, row.phrase) == (le, r, "x y")


@pytest.mark.parametrize("seed", range(20))
@pytest.mark.parametrize("bits", [1, 3, 6])
def test_counted_addresses(monkeypatch, seed, bits):
    monkeypatch.setattr(pm, "TILE_BITS", bits)
    rng = np.random.default_rng(seed)
    symbols = int(rng.integers(1, 400))
    n = int(rng.integers(0, 6000))
    a, b = (np.minimum(rng.geometric(0.1, n) - 1, symbols - 1) for _ in range(2))
    key, count = pm.count_addresses(pm.addresses(a, b, symbols))
    want = Counter(zip(a.tolist(), b.tolist(), strict=True))
    first, second = pm.ranks(key, symbols)
    assert dict(zip(zip(first.tolist(), second.tolist(), strict=True), count.tolist(), strict=True)) == want
    assert (np.diff(key) > 0).all()
    twice = pm.count_addresses(np.concatenate([key, key]), np.concatenate([count, 3 * count]))
    assert (twice[0] == key).all() and (twice[1] == 4 * count).all()
    assert (pm.unpacked(pm.packed(key), len(key)) == key).all()


def test_long_text_is_cut_between_pieces_only(monkeypatch):
    monkeypatch.setattr(pm, "CUT_BYTES", 3)
    text = b"One two, three four.five six seven"
    lists = list(pm.pieces_of(text))
    assert len(lists) > 2
    assert b" ".join(w for own in lists for w in own) == b"one two \xff three four \xff five six seven \xff"
    assert all(own[-1] == b"\xff" for own in lists)


def test_breaks():
    seq = np.array([-1, -1, 3, 4, -1, -1, -1, 5, -1], np.int32)
    assert pm.without_repeated_breaks(seq).tolist() == [3, 4, -1, 5]
    assert pm.without_repeated_breaks(np.empty(0, np.int32)).tolist() == []
