"""Stages of the pipeline on clashing column names, repeated ids and small samples."""

import numpy as np
from gridweave.llm import langid, simhash

A = "one two three four five six seven eight nine ten"
B = "red green blue cyan black white grey pink brown gold"


def test_keep_first_with_helper_names_and_rows_without_id(spark):
    rows = [(3, A, 1, 2), (1, A, 3, 4), (None, A, 5, 6), (None, B, 7, 8), (None, B, 7, 8)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, __id int, `__ROW` int")
    got = simhash.keep_first(docs)
    assert got.columns == docs.columns
    assert sorted((tuple(r) for r in got.collect()), key=str) == sorted([(1, A, 3, 4), (None, B, 7, 8)], key=str)


def test_keep_first_of_a_repeated_id_does_not_depend_on_order(spark):
    rows = [(1, B, "x"), (1, A, "y"), (1, A, "b"), (2, A, "c"), (4, "alone here", "d")]
    want = {(1, A, "b"), (4, "alone here", "d")}
    for part in (rows, rows[::-1]):
        docs = spark.createDataFrame(part, "doc_id long, text string, `a.b` string").repartition(3)
        assert {tuple(r) for r in simhash.keep_first(docs).collect()} == want
    assert simhash.keep_first(docs.limit(0)).count() == 0


def test_likelihood_margin_shrinks_with_the_sample():
    rng = np.random.default_rng(1)
    texts = [" ".join(rng.choice(["the", "house", "and", "water", "green", "under"], 60)) for _ in range(400)]
    x = np.array([langid.features(t) for t in texts])
    floors = []
    for n in (1, 10, 49, 51, 400):
        model = langid.fit(x[:n], ["en"] * n)
        least = float(np.quantile([model.likelihood(row) for row in x[:n]], 0.001))
        floors.append(least - model.floor)
        assert all(model.knows(t, 0.3) for t in texts[:n])
    assert np.allclose(floors, [0.8 * (1 + 50 / n) for n in (1, 10, 49, 51, 400)])
    assert not langid.fit(x, ["en"] * 400).knows("Ωμέγα και άλφα " * 20, 0.3)


def test_keep_known_sends_texts_only_and_keeps_rows_as_they_are(spark):
    rng = np.random.default_rng(1)
    texts = [" ".join(rng.choice(["the", "house", "and", "water", "green", "under"], 60)) for _ in range(60)]
    model = langid.fit(np.array([langid.features(t) for t in texts]), ["en"] * 60)
    rows = [(i, t, "x" * 9, {"k": i}) for i, t in enumerate([texts[0], None, "", "123 456", "Ωμέγα και άλφα " * 20, texts[1], texts[1]])]
    docs = spark.createDataFrame(rows, "id long, text string, `TEXT.b` string, `c0` map<string, long>").toDF("id", "text", "a.b", "Id")
    got = langid.keep_known(docs, model=model)
    assert got.schema == docs.schema
    assert sorted(tuple(r) for r in got.collect()) == [(i, t, "x" * 9, {"k": i}) for i, t, *_ in (rows[0], rows[5], rows[6])]
    plan = got._jdf.queryExecution().executedPlan().toString()
    assert "MapInArrow" not in plan and "ArrowEvalPython" in plan  # rows do not pass through Python
    assert langid.keep_known(docs.limit(0), model=model).count() == 0
