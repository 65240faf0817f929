"""Operators 1, 2, 3, 4, 5, 7 and 9 against brute force, exact round trips and held-out accuracy."""

import random
import zlib

import numpy as np
import pandas as pd
import pytest
import xxhash
from pyspark.sql import functions as F

from conftest import SF_SMALL
from gridweave.llm import (
    bpe,
    langid,
    quality_model,
    quality_rules,
    sentencepiece_viterbi,
    simhash,
    sos_packing,
    token_output,
)

SF = "/root/testdata/sf0.01"
SCHEMA = ("doc_id long, text string, lang string, source string, n_chars long, words string, fp long, kept string, "
          "component_id string, host string, score string, ids string, node long, row string")
LONG = "alpha beta  gamma\n" * 40_000


def _row(doc_id, text, lang="en", source="s0"):
    return (doc_id, text, lang, source, 0, "x", 1, "x", "x", "x", "x", "x", 1, "x")


@pytest.fixture(scope="module")
def messy(spark):
    """Nulls in every column, empty and long texts, repeated rows and ids, clashing column names."""
    body = " ".join(f"word{i} runs" for i in range(60))
    rows = [_row(1, body), _row(1, body), _row(2, body), _row(3, None), _row(4, ""), _row(5, " \t\n\x0b "), _row(6, LONG),
            _row(7, "Ünï çödé 日本 😀 don't <|endoftext|> ▁x  y\x00z"), _row(None, body), _row(None, "lonely text without an id " * 9),
            _row(8, "one two", None, None), _row(9, "..!!", None, "s1"), (None,) * 14]
    return spark.createDataFrame(rows, SCHEMA)


@pytest.fixture(scope="module")
def nothing(spark):
    return spark.createDataFrame([], SCHEMA)


# --- operator 1 -------------------------------------------------------------------------------


def _codec(pieces):
    return sentencepiece_viterbi.Codec([(p, float(s), k) for p, s, k in pieces])


def _best_score(word, scores, unknown):
    best = [0.0] + [None] * len(word)
    for e in range(1, len(word) + 1):
        options = [best[s] + scores[word[s:e]] for s in range(e) if word[s:e] in scores and best[s] is not None]
        if word[e - 1] not in scores:
            options.append(best[e - 1] + unknown)
        best[e] = max(options) if options else None
    return best[-1]


def test_viterbi_is_optimal():
    codec = sentencepiece_viterbi.load(sentencepiece_viterbi.default_path())
    import sentencepiece

    m = sentencepiece.SentencePieceProcessor(model_file=sentencepiece_viterbi.default_path())
    scores = {m.id_to_piece(i): m.get_score(i) for i in range(m.get_piece_size())
              if not (m.is_byte(i) or m.is_control(i) or m.is_unknown(i))}
    rng = random.Random(3)
    for _ in range(300):
        word = "▁" + "".join(rng.choice("theraionds🧿éq") for _ in range(rng.randint(0, 12)))
        ids = codec.viterbi(word)
        got = sum(m.get_score(i) for i in ids if not m.is_byte(i)) + codec.unknown_score * word.count("🧿")
        assert got == pytest.approx(_best_score(word, scores, codec.unknown_score))


def test_pieces_across_words_use_the_whole_text():
    codec = _codec([("<unk>", 0, "unknown"), ("▁", -1, "normal"), ("a", -1, "normal"), ("a▁a", -0.5, "normal")])
    assert not codec.whole_words
    assert np.frombuffer(codec.encode("a a"), "<i4").tolist() == [1, 3]


def test_unknown_without_byte_pieces():
    codec = _codec([("<unk>", 0, "unknown"), ("▁", -1, "normal"), ("ab", -1, "normal")])
    assert np.frombuffer(codec.encode("abzab"), "<i4").tolist() == [1, 2, 0, 2]


def test_sentencepiece_round_trip(messy, nothing):
    ids = sentencepiece_viterbi.encode(messy)
    back = sorted((r["doc_id"] or 0, r["text"]) for r in sentencepiece_viterbi.decode(ids).collect())
    want = sorted((r["doc_id"] or 0, (r["text"] or "").replace("▁", " ")) for r in messy.collect())
    assert back == want
    rows = sentencepiece_viterbi.round_trip(messy).collect()
    assert len(rows) == 13 and all(r["restored"] for r in rows)
    assert sentencepiece_viterbi.round_trip(nothing).count() == 0


# --- byte-level BPE, operators 7 and 9 ----------------------------------------------------------


def test_bpe_equals_the_tokenizer_library():
    from tokenizers import Tokenizer

    own = bpe.load(bpe.default_path())
    ref = Tokenizer.from_file(bpe.default_path())
    rng = random.Random(5)
    parts = ["a", "'", " ", "s", "re", "ll", "\n", "1", "!", "é", "  ", "\t", "<|endoftext|>", "日", "’", "😀", "\x85", "\x1c", "Ⅷ",
             "²", "\0", "d", "ve", "x" * 30, "​", "ᲂ", "_", "́", "word", " the"]
    texts = ["".join(rng.choice(parts) for _ in range(rng.randint(0, 25))) for _ in range(4000)] + ["", "", LONG[:3000]]
    ids, bounds = own.encode(texts)
    for i, e in enumerate(ref.encode_batch(texts, add_special_tokens=False)):
        assert ids[bounds[i]:bounds[i + 1]].tolist() == e.ids, texts[i]


def _reference_ids(text):
    from tokenizers import Tokenizer

    ref = Tokenizer.from_file(bpe.default_path())
    return ref.encode(text or "", add_special_tokens=False).ids


def test_sum_of_squares_choice_is_the_least():
    rng = random.Random(1)
    p = sos_packing.Packer(16)
    for k in range(400):
        size = rng.randint(1, 15)
        before = p.levels[1:16].copy()

        def total(h, size=size, before=before):
            n = np.concatenate([[0], before, [0]])
            if h:
                n[h] -= 1
            if h + size < 16:
                n[h + size] += 1
            return int((n[1:16] ** 2).sum())

        options = [h for h in range(16) if h + size <= 16 and (h == 0 or before[h - 1] > 0)]
        h = p.place(size)
        assert h in options and total(h) == min(map(total, options))
        p.add(k, np.arange(size))


@pytest.mark.parametrize("max_open", [4, 4096])
def test_packer_loses_nothing(max_open):
    rng = random.Random(2)
    p = sos_packing.Packer(32, max_open)
    docs = {k: np.array([rng.randrange(1000) for _ in range(rng.choice([1, 5, 31, 32, 33, 100]))]) for k in range(300)}
    windows = [w for k, ids in docs.items() for w in p.add(k, ids)] + p.close()
    pieces = {}
    for w in windows:
        assert 0 < sum(len(x[2]) for x in w) <= 32
        for doc, start, ids, n in w:
            assert n == len(docs[doc])
            pieces.setdefault(doc, []).append((start, ids))
    for k, ids in docs.items():
        got = sorted(pieces[k], key=lambda x: x[0])
        assert [s for s, _ in got] == np.cumsum([0, *[len(x) for _, x in got[:-1]]]).tolist()
        assert np.concatenate([x for _, x in got]).tolist() == ids.tolist()
    if max_open > 300:
        assert sum(sum(len(x[2]) for x in w) < 32 for w in windows) <= 1


def test_packing_of_messy_rows(messy, nothing):
    r = sos_packing.pack(messy, with_ids=True).toPandas()
    for _, own in r.groupby("sequence_id"):
        own = own.sort_values("offset")
        assert own.offset.tolist() == np.cumsum([0, *own.length[:-1]]).tolist() and own.length.sum() <= 2048
    for doc, text in [(3, None), (4, ""), (7, messy.where("doc_id = 7").first()["text"]), (6, LONG)]:
        own = r[r.doc_id == doc].sort_values("start")
        ids = np.concatenate([np.frombuffer(x, "<u4") for x in own.ids])
        assert ids.tolist() == [*_reference_ids(text), 1] and set(own.doc_tokens) == {len(ids)}
        assert [zlib.crc32(x) for x in own.ids] == own.ids_crc32.tolist()
    n = (r.length.groupby(r.doc_id).sum())
    assert n[1] == 2 * n[2]  # a repeated row is packed twice
    assert sos_packing.pack(nothing).count() == 0


def test_packing_query_covers_all_documents(spark):
    r = sos_packing.query(spark, SF_SMALL).toPandas()
    total = r.groupby("doc_id").agg(n=("length", "sum"), doc=("doc_tokens", "first"))
    assert (total.n == total.doc).all()
    assert len(total) == spark.read.parquet(f"{SF_SMALL}/documents.parquet").count()
    fill = r.groupby("sequence_id").length.sum()
    short = fill[~fill.isin([2**k for k in range(12)])]
    assert (2048 - short).sum() < 2048  # one partition: at most one padded window


def test_capacity_tree_is_best_fit():
    rng = random.Random(4)
    for _ in range(30):
        tree, have = token_output.CapacityTree(50), []
        for _ in range(60):
            c = rng.randint(1, 50)
            tree.add(c, 1)
            have.append(c)
            size = rng.randint(1, 50)
            assert tree.best_fit(size) == min((x for x in have if x >= size), default=None)


def test_best_fit_decreasing_against_a_plain_loop():
    rng = random.Random(6)
    sizes = [rng.randint(1, 64) for _ in range(400)]
    bins = token_output.best_fit_decreasing(sizes, 64)
    assert sorted(i for b in bins for i in b) == list(range(400))
    room, n = [], 0
    for s in sorted(sizes, reverse=True):
        fits = [k for k in range(len(room)) if room[k] >= s]
        if fits:
            room[min(fits, key=lambda k: room[k])] -= s
        else:
            room.append(64 - s)
    assert sorted(64 - sum(sizes[i] for i in b) for b in bins) == sorted(room)


def test_token_output_round_trip(spark, messy, nothing, tmpdir_path):
    token_output.write_tokens(messy, f"{tmpdir_path}/t", window=512)
    w = token_output.read_tokens(spark, f"{tmpdir_path}/t")
    got = {}
    for r in w.collect():
        ids, pos, cu = np.frombuffer(r["ids"], "<u2"), np.frombuffer(r["positions"], "<u2"), r["cu_seqlens"]
        assert len(ids) == len(pos) == 512 and cu[0] == 0 and cu[-1] == r["n_ids"] and (ids[cu[-1]:] == 50256).all()
        for doc, start, a, b in zip(r["doc_ids"], r["starts"], cu[:-1], cu[1:], strict=True):
            assert pos[a:b].tolist() == list(range(b - a))
            got.setdefault(doc, []).append((start, ids[a:b]))
    for doc, text in [(3, None), (4, ""), (7, messy.where("doc_id = 7").first()["text"]), (6, LONG)]:
        ids = np.concatenate([x for _, x in sorted(got[doc], key=lambda x: x[0])])
        assert ids.tolist() == [*_reference_ids(text), 50256]
    seg = token_output.segments(w, 512).toPandas()
    assert seg.positions_reset.all() and seg.length.sum() == sum(r["n_ids"] for r in w.collect())
    token_output.write_tokens(nothing, f"{tmpdir_path}/e")
    assert token_output.read_tokens(spark, f"{tmpdir_path}/e").count() == 0


def test_token_output_query(spark):
    seg = token_output.query(spark, SF_SMALL).toPandas()
    sos = sos_packing.query(spark, SF_SMALL).toPandas()
    assert seg.groupby("doc_id").length.sum().to_dict() == sos.groupby("doc_id").length.sum().to_dict()


# --- operator 2 -------------------------------------------------------------------------------


def test_contexts_against_a_plain_loop():
    texts = [b"a b c a b", b"", b"x", b"c c c a !!! a"]
    token, first = quality_model.tokens(texts)
    places, signs = quality_model.index_vectors()
    want = np.zeros((quality_model.BUCKETS, quality_model.DIM), np.int64)
    for d in range(len(texts)):
        own = token[first[d]:first[d + 1]]
        for i, a in enumerate(own):
            for j, b in enumerate(own):
                if 0 < abs(i - j) <= quality_model.RADIUS:
                    want[a, places[b]] += signs[b]
    got = np.zeros_like(want)
    quality_model.add_contexts(got, token, first, places, signs)
    assert (got == want).all()
    assert np.diff(first).tolist() == [5, 0, 1, 6]


def _tokens(text):
    token, first = quality_model.tokens([text.encode()])
    assert first.tolist() == [0, len(token)]
    return token.tolist()


def test_whole_tokens_are_hashed():
    same = "x" * 30
    assert _tokens(same + "a" * 50) != _tokens(same + "b" * 50) and _tokens(same + "a" * 50) == _tokens(same + "a" * 50)
    assert len(_tokens("a" * 300_000 + "b")) == 1


def test_letters_without_spaces_are_pairs():
    text = "今日は東京で新しい本を読んだ"
    pairs = [_tokens(text[i:i + 2])[0] for i in range(len(text) - 1)]
    assert _tokens(text) == pairs and len(set(pairs)) == len(pairs)
    assert _tokens("今日\u3000東京。本") == [*_tokens("今日"), *_tokens("東京"), *_tokens("。"), *_tokens("本")]
    assert _tokens("abc東京でdéf") == [*_tokens("abc"), *_tokens("東京"), *_tokens("京で"), *_tokens("déf")]
    assert len(_tokens("สวัสดีครับ")) == 9 and len(_tokens("\U00020000\U00020001\U00020002")) == 2
    assert len(_tokens("don’t привет 한국어 élève")) == 4  # spaced scripts keep their words
    bad = b"a \xe3\x81 b \xe6"
    assert np.diff(quality_model.tokens([bad, b"x"])[1]).tolist() == [4, 1]
    rng = np.random.default_rng(0)
    v = rng.normal(size=(quality_model.BUCKETS, quality_model.DIM)).astype(np.float32)
    own, other = quality_model.pool([(text + "終").encode(), (text + "止").encode()], v)
    assert not np.allclose(own, other)


def test_pool_in_parts_is_the_same(monkeypatch):
    rng = np.random.default_rng(0)
    v = rng.normal(size=(quality_model.BUCKETS, quality_model.DIM)).astype(np.float32)
    texts = [b"", b"a b a", b"q", b"  ", b"", b"z y x !", "東京で本".encode()] * 3
    whole = quality_model.pool(texts, v)
    monkeypatch.setattr(quality_model, "_POOL_TOKENS", 2)
    assert np.array_equal(quality_model.pool(texts, v), whole)


def test_pool_of_each_text_alone():
    rng = np.random.default_rng(0)
    v = rng.normal(size=(quality_model.BUCKETS, quality_model.DIM)).astype(np.float32)
    texts = [b"", b"a b a", b"q", b"  ", b"z y x !"]
    both = quality_model.pool(texts, v)
    for i, t in enumerate(texts):
        assert np.allclose(both[i], quality_model.pool([t], v)[0])
        own = v[quality_model.tokens([t])[0]]
        want = np.concatenate([own.mean(0), own.std(0)]) if len(own) else np.zeros(2 * quality_model.DIM)
        assert np.allclose(both[i], want, atol=2e-3)  # spread of equal 32-bit vectors


def test_network_learns_and_is_calibrated():
    rng = np.random.default_rng(1)
    x = rng.normal(size=(3000, 5))
    p = 1 / (1 + np.exp(-3 * x[:, 0] * x[:, 1]))
    net = quality_model.fit_network(x[:2000], rng.random(2000) < p[:2000], decay=1e-4)
    s = net.score(x[2000:])
    assert np.abs(s - p[2000:]).mean() < 0.15 and 0.25 <= net.temperature <= 8
    assert quality_model.fit_network(x[:4], np.ones(4)).score(x)[0] == pytest.approx(5 / 6)
    assert quality_model.fit_network(np.zeros((0, 5)), np.zeros(0)).score(np.zeros((1, 64)))[0] == 0.5


def test_classifier_held_out_accuracy(spark):
    r = quality_model.query(spark, SF).toPandas().merge(pd.read_parquet(f"{SF}/labels.parquet"), on="doc_id")
    held = r[r.held_out]
    assert (held.predicted == held.quality).mean() > 0.95
    assert all(h == (zlib.crc32(str(d).encode()) % 5 == 0) for d, h in zip(r.doc_id, r.held_out, strict=True))


def test_classifier_of_messy_rows(spark, messy, nothing):
    labels = spark.createDataFrame([(1, 1, 0), (1, 0, 1), (3, 0, 0), (None, 1, 1), (6, None, 0), (9, 0, 0), (2, 1, 0)],
                                   "doc_id long, quality int, toxic int")
    rows = quality_model.classify(messy, labels).collect()
    assert len(rows) == 13 and all(0 <= r["score"] <= 1 and r["predicted"] == int(r["score"] >= 0.3) for r in rows)
    by = {}
    for r in rows:
        by.setdefault(r["doc_id"], set()).add(r["score"])
    assert by[1] == by[2] and by[3] == by[4] == by[5]
    assert quality_model.classify(nothing, labels).count() == 0
    assert {r["score"] for r in quality_model.classify(messy, labels.limit(0)).collect()} == {0.5}


# --- operator 3 -------------------------------------------------------------------------------


def _plain_rules(text):
    text = text or ""
    words = [w for w in text.replace("\t", " ").replace("\n", " ").replace("\x0b", " ").replace("\x0c", " ").replace("\r", " ")
             .split(" ") if w]
    lines = [x for x in text.split("\n") if x.strip(" \t\n\x0b\x0c\r")]
    grams = [tuple(words[i:i + 3]) for i in range(len(words) - 2)]
    count = {}
    for g in grams:
        count[g] = count.get(g, 0) + 1
    inside = {i + d for i, g in enumerate(grams) if count[g] > 1 for d in range(3)}
    return (len(words), sum(map(len, words)), sum(c in "#*$%&|<>" for c in text), len(lines) - len(set(lines)), len(inside),
            len(words) < 50 or 100 * len(inside) > 50 * len(words))


@pytest.mark.parametrize("hash_bits", [64, 6])
def test_base_rules_against_plain_python(spark, messy, hash_bits):
    rng = random.Random(7)
    texts = ["".join(rng.choice(["a", "b", "cc", " ", " ", "\n", "\t", "#", " ", "é"]) for _ in range(rng.randint(0, 200)))
             for _ in range(150)] + [r["text"] for r in messy.select("text").collect()]
    docs = spark.createDataFrame([(i, t, "s") for i, t in enumerate(texts)], "doc_id long, text string, source string")
    cols = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed"]
    for r in quality_rules.base_rules(docs, hash_bits=hash_bits).collect():
        assert tuple(r[c] for c in cols) == _plain_rules(texts[r["doc_id"]]), texts[r["doc_id"]][:200]


def test_host_verdicts_shrink_and_reject(spark):
    good, bad = " ".join(f"w{i}" for i in range(60)), "short"
    rows = [(i, good if i % 10 else bad, f"h{i % 7}") for i in range(700)]
    rows += [(1000 + i, good if i % 20 == 0 else bad, "spam") for i in range(200)] + [(5000, bad, "tiny"), (5001, good, "tiny")]
    rows += [(6000, good, None), (6001, bad, None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string")
    r = {x["doc_id"]: x for x in quality_rules.judge(docs).collect()}
    assert len(r) == len(rows)
    assert all(not r[i]["kept"] and r[i]["host_rejected"] for i in range(1000, 1200))
    assert all(r[i]["kept"] == bool(i % 10) for i in range(700))
    assert r[5001]["kept"] and r[6000]["kept"] and not r[6001]["kept"]  # two documents do not condemn a host
    kept = quality_rules.keep_good(docs)
    assert kept.columns == docs.columns
    assert {x["doc_id"] for x in kept.collect()} == {i for i, x in r.items() if x["kept"]}


def test_quality_rules_of_messy_rows(messy, nothing):
    rows = quality_rules.judge(messy).collect()
    assert len(rows) == 13
    kept = quality_rules.keep_good(messy)
    assert kept.columns == messy.columns
    assert sorted(r["doc_id"] or 0 for r in kept.collect()) == sorted(r["doc_id"] or 0 for r in rows if r["kept"])
    assert quality_rules.judge(nothing).count() == 0 and quality_rules.keep_good(nothing).count() == 0


# --- operator 4 -------------------------------------------------------------------------------


def _plain_fingerprint(text):
    low = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
    words = [w for w in low.replace("\t", " ").replace("\n", " ").replace("\x0b", " ").replace("\x0c", " ").replace("\r", " ")
             .split(" ") if w]
    if not words:
        return 0
    grams = [" ".join(words[i:i + 3]) for i in range(len(words) - 2)] or [" ".join(words)]
    hs = [xxhash.xxh64_intdigest(g.encode(), 42) for g in grams]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hs) > len(hs))


def _plain_components(pairs, nodes):
    up = {n: n for n in nodes}

    def find(n):
        while up[n] != n:
            n = up[n]
        return n

    for a, b in pairs:
        a, b = find(a), find(b)
        up[max(a, b)] = min(a, b)
    return {n: find(n) for n in nodes}


def test_embedding_is_a_lower_bound(spark):
    rng = random.Random(8)
    rows = [(rng.getrandbits(64) - (1 << 63), rng.getrandbits(64) - (1 << 63)) for _ in range(200)]
    df = spark.createDataFrame(rows, "a long, b long")
    gap = F.bit_count(simhash.embed(F.col("a")).bitwiseXOR(simhash.embed(F.col("b"))))
    for r in df.select("a", "b", gap.alias("g")).collect():
        a, b = r["a"] % 2**64, r["b"] % 2**64
        plain = sum(abs(bin(a >> k & 3).count("1") - bin(b >> k & 3).count("1")) for k in range(0, 64, 2))
        assert r["g"] == plain <= bin(a ^ b).count("1")


@pytest.mark.parametrize("most", [0, 1, 2, 3])
def test_close_pairs_against_all_pairs(spark, most):
    rng = random.Random(9)
    base = [rng.getrandbits(64) for _ in range(12)]
    fps = {0, 2**64 - 1, *base}
    for b in base:
        for _ in range(25):
            x = b
            for _ in range(rng.randint(1, 5)):
                x ^= 1 << rng.randrange(64)
            fps.add(x)
    fps = sorted(fps)
    df = spark.createDataFrame([(f - 2**64 if f >= 2**63 else f, i) for i, f in enumerate(fps)], "fp long, node long")
    got = [tuple(sorted(r)) for r in simhash.close_pairs(df, most).collect()]
    want = {(i, j) for i in range(len(fps)) for j in range(i + 1, len(fps)) if bin(fps[i] ^ fps[j]).count("1") <= most}
    assert len(got) == len(set(got)) and set(got) == want


def test_simhash_against_brute_force(spark):
    docs = spark.read.parquet(f"{SF_SMALL}/documents.parquet")
    plain = {r["doc_id"]: _plain_fingerprint(r["text"]) for r in docs.select("doc_id", "text").collect()}
    ids = sorted(plain)
    pairs = [(a, b) for i, a in enumerate(ids) for b in ids[i + 1:] if bin(plain[a] ^ plain[b]).count("1") <= 3]
    want = _plain_components(pairs, ids)
    got = simhash.query(spark, SF_SMALL).collect()
    assert {r["doc_id"]: int(r["fingerprint"], 16) for r in got} == plain
    assert {r["doc_id"]: r["component_id"] for r in got} == want and len(set(want.values())) < len(want)


def test_simhash_of_messy_rows(messy, nothing):
    rows = simhash.near_duplicates(messy).collect()
    assert len(rows) == 13
    by = {}
    for r in rows:
        by.setdefault(r["doc_id"], set()).add((r["fp"], r["component_id"]))
    assert {c for _, c in by[1] | by[2]} == {1} and by[3] == by[4] == by[5] == {(0, 3)}
    assert {c for _, c in by[None]} == {1, 3, None}
    kept = simhash.keep_first(messy)
    assert kept.columns == messy.columns
    assert sorted(r["doc_id"] or 0 for r in kept.collect()) == [0, 1, 3, 6, 7, 8, 9]
    assert simhash.keep_first(nothing).count() == 0 and simhash.near_duplicates(nothing).count() == 0


def test_repeated_ids_with_other_texts_are_one_node(spark):
    docs = spark.createDataFrame([(1, "a b c d e"), (1, "q r s t u v w"), (2, "q r s t u v w"), (3, "z")], "doc_id long, text string")
    assert {(r["doc_id"], r["component_id"]) for r in simhash.near_duplicates(docs).collect()} == {(1, 1), (2, 1), (3, 3)}


# --- operator 5 -------------------------------------------------------------------------------


def test_language_held_out_accuracy(spark):
    r = langid.query(spark, SF).toPandas()
    d = pd.read_parquet(f"{SF}/documents.parquet")[["doc_id", "lang"]].merge(r, on="doc_id")
    held = d[d.held_out]
    assert (held.lang == held.lang_pred).mean() > 0.98 and d.score.between(0, 1).all()
    assert all(h == (zlib.crc32(str(i).encode()) % 4 == 2) for i, h in zip(d.doc_id, d.held_out, strict=True))


def test_language_model_has_both_levels():
    rng = np.random.default_rng(2)
    x = rng.normal(size=(120, langid.DIM)).astype(np.float32) * 0.01
    langs = ["en", "de", "fr", "es", "it", "zz"] * 20
    for i, a in enumerate(langs):
        x[i, {"en": 0, "de": 1, "fr": 2, "es": 3, "it": 4, "zz": 5}[a]] += 1
    m = langid.fit(x, langs)
    assert set(m.rest) == {"germanic", "romance", "zz"}
    assert set(m.pairs) == {("de", "en"), ("es", "fr"), ("es", "it"), ("fr", "it")}


def test_language_of_messy_rows(spark, messy, nothing):
    rows = {(r["doc_id"], r["lang_pred"]): r["score"] for r in langid.predict(messy, langid.train(messy)).collect()}
    assert all(rows[i, "und"] == 0 for i in (3, 4, 5, 9)) and rows[7, "en"] == 1.0
    assert langid.predict(nothing, langid.train(nothing)).count() == 0
    assert {r["lang_pred"] for r in langid.predict(messy, langid.Model()).collect()} == {"und"}
    kept = langid.keep_known(messy)
    assert kept.columns == messy.columns and sorted(r["doc_id"] or 0 for r in kept.collect()) == [0, 0, 1, 1, 2, 6, 7, 8]


def test_texts_in_no_learned_language_go(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    model = langid.train(docs)
    known = [r["text"] for r in docs.where(F.length("text") > 60).orderBy("doc_id").limit(400).collect()]
    mixed = [a[:500] + " " + b[:500] for a, b in zip(known, known[1:], strict=False)]
    rng = random.Random(3)
    other = ["w szczebrzeszynie chrząszcz brzmi w trzcinie i szczebrzeszyn z tego słynie",
             "Příliš žluťoučký kůň úpěl ďábelské ódy a pak šel domů spát do postele",
             "Все люди рождаются свободными и равными в своём достоинстве и правах",
             "人人生而自由在尊严和权利上一律平等他们赋有理性和良心", "Όλοι οι άνθρωποι γεννιούνται ελεύθεροι"]
    other += ["".join(rng.choice("abcdefghijklmnopqrstuvwxyz    ") for _ in range(400)) for _ in range(20)]
    texts = known + mixed + other
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    kept = {r["doc_id"] for r in langid.keep_known(df, model=model).collect()}
    assert kept == set(range(len(known) + len(mixed)))
