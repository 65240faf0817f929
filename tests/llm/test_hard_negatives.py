"""Operator 13 against brute force."""

import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from gridweave.llm import hard_negatives as hn

SCHEMA = "vec_id long, embedding array<double>, label int, q string, id string, row string, list int, anchor string"


def _frame(spark, rows):
    return spark.createDataFrame([(*r, "q", "i", "r", 1, "a") for r in rows], SCHEMA)


def _brute(rows, is_anchor, positives=5, negatives=3, low=50, high=95):
    ok = [(i, v, lab) for i, v, lab in rows
          if lab is not None and v is not None and all(x is not None and math.isfinite(x) for x in v)]
    whole = [[math.floor(256 * x) for x in v] for _, v, _ in ok]
    last = 1 << 70
    out = []
    for a, (aid, _, lab) in enumerate(ok):
        if aid is None or not is_anchor(aid):
            continue
        score = [sum(x * y for x, y in zip(whole[a], q, strict=False)) for q in whole]
        by = sorted((i for i in range(len(ok)) if i != a), key=lambda i: (-score[i], last if ok[i][0] is None else ok[i][0]))
        for p in [i for i in by if ok[i][2] == lab][:positives]:
            hard = [i for i in by if ok[i][2] != lab and low * score[p] <= 100 * score[i] <= high * score[p]][:negatives]
            out += [(aid, ok[p][0], r, ok[i][0], score[p], score[i]) for r, i in enumerate(hard, 1)]
    return sorted(out, key=str)


def _got(df):
    return sorted((tuple(r) for r in df.select("anchor_id", "positive_id", "rank", "negative_id", "positive_score",
                                               "negative_score").collect()), key=str)


def _clustered(n, dim, seed, labels=4, noise=(0.05, 0.5)):
    rng = np.random.default_rng(seed)
    centre = rng.normal(size=(labels, dim))
    out = []
    for i in range(n):
        c = rng.integers(labels)
        v = centre[c] + rng.normal(size=dim) * rng.choice(noise)
        out.append((i, (v / np.linalg.norm(v)).tolist(), int(c if rng.random() < 0.8 else rng.integers(labels))))
    return out


@pytest.mark.parametrize(("dim", "batch"), [(8, 1000), (3, 7), (40, 1000)])
def test_equals_brute_force(spark, dim, batch):
    rows = _clustered(500, dim, dim)
    df = _frame(spark, rows).repartition(5)
    assert _got(hn.mine(df, F.col("vec_id") % 10 == 0, batch_anchors=batch)) == _brute(rows, lambda i: i % 10 == 0)


def test_nulls_ties_copies_and_odd_rows(spark):
    rng = random.Random(3)
    rows = [(i, [float(rng.randint(-2, 2)) / 16 for _ in range(3)], rng.randint(0, 2)) for i in range(160)]  # many equal scores
    rows += [(500, [0.5, 0.5, 0.5], 1)] * 40 + [(510, [0.5, 0.5, 0.5], 2)] * 3
    rows += [(600, None, 1), (610, [], 1), (620, [None, 1.0, 1.0], 1), (630, [float("nan"), 1.0, 0.0], 1), (None, [0.5, 0.5, 0.5], 2),
             (None, [0.4, 0.5, 0.5], 1), (640, [float("inf"), 1.0, 0.0], 2), (650, [1.0, 0.0, 0.0], None), (660, [0.0, 0.0, 0.0], 2),
             (670, [0.3, 0.3], 0), (680, [0.3, 0.3, 0.2, 9.0], 0)]
    got = _got(hn.mine(_frame(spark, rows).repartition(4), F.col("vec_id") % 10 == 0))
    assert got == _brute(rows, lambda i: i % 10 == 0)


def test_large_components_keep_exact_scores(spark):
    rng = random.Random(4)
    rows = [(i, [rng.uniform(-1, 1) * 3e6 for _ in range(4)], i % 2) for i in range(80)]
    got = _got(hn.mine(_frame(spark, rows), F.col("vec_id") < 20))
    assert got == _brute(rows, lambda i: i < 20)
    huge = [(1000, [1e300, 0.0, 0.0, 0.0], 0)]
    assert _got(hn.mine(_frame(spark, rows + huge), F.col("vec_id") < 20)) == got


@pytest.mark.parametrize("rows", [[], [(0, [1.0, 2.0], 1)], [(0, [1.0], 1), (1, [1.0], 1)], [(0, [0.0], 1), (1, [0.0], 1), (2, [0.0], 2)],
                                  [(0, [1.0], 1), (10, [-1.0], 1), (2, [-0.7], 2)], [(1, [1.0], 1)]])
def test_small_tables(spark, rows):
    assert _got(hn.mine(_frame(spark, rows), F.col("vec_id") % 10 == 0)) == _brute(rows, lambda i: i % 10 == 0)


@pytest.mark.parametrize("seed", range(20))
def test_bounds_hold_for_every_pair(seed):
    rng = np.random.default_rng(seed)
    dim = int(rng.integers(1, 20))
    x = np.floor(256 * rng.normal(size=(200, dim)) * rng.choice([0.01, 1, 100], (200, 1)))
    x[rng.integers(200)] = 0
    x[5] = x[6]
    norm = np.sqrt((x * x).sum(axis=1))
    refs = hn.references(x[:50], 6)
    theta = hn.angles(x, norm, refs)
    score = x @ x.T
    for lo in range(0, 200, 25):
        part = slice(lo, lo + 25)
        low, high = hn.score_bounds(theta, norm, theta[part].min(axis=0), theta[part].max(axis=0), norm[part].min(), norm[part].max())
        assert (score[:, part] <= high[:, None]).all() and (score[:, part] >= low[:, None]).all()


def test_most_windows_are_not_scored(monkeypatch):
    """On clustered rows, the bounds leave a part of all pairs to be scored, and the best rows are all found."""
    rows = _clustered(6000, 16, 9, labels=8, noise=(0.05, 0.1))
    x = np.floor(256 * np.array([v for _, v, _ in rows]))
    norm = np.sqrt((x * x).sum(axis=1))
    refs = hn.references(x[:1000])
    theta = hn.angles(x, norm, refs)
    order = np.lexsort((theta.min(axis=1), theta.argmin(axis=1)))
    label = np.array([lab for _, _, lab in rows])
    every = hn.Rows(x, np.arange(6000), label, np.arange(6000), norm, theta)
    seen, scores = [], hn._scores
    monkeypatch.setattr(hn, "_scores", lambda a, b, largest: seen.append(len(a) * len(b)) or scores(a, b, largest))
    anchors, best = every.part(slice(0, 6000, 50)), hn.BestLists(120, 5)
    for window in hn._windows(every.part(slice(0, 1000))):
        hn.offer_positives(anchors, window, best)
    best.keep_thresholds_only()
    seen.clear()
    for window in hn._windows(every.part(order)):
        hn.offer_positives(anchors, window, best)
    assert sum(seen) < 0.4 * 120 * 6000
    best.settle()
    for a, own in enumerate(best.row):
        score = x @ anchors.x[a]
        same = [i for i in np.lexsort((np.arange(6000), -score)) if label[i] == anchors.label[a] and i != anchors.row[a]]
        assert own.tolist() == same[:5]
