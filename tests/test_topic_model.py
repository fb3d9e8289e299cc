import math

import numpy as np
import pytest

import __spark_entry__ as entry
from farglass.operators import topic_model, vectors

FOLDER = "/root/testdata/sf0.001"
FRUIT, TOOLS = ["apple", "pear", "plum"], ["bolt", "nail", "screw"]


def test_digamma_and_trigamma():
    euler = 0.5772156649015329
    assert topic_model.digamma(np.array([1.0, 0.5, 12.0])) == pytest.approx([-euler, -euler - 2 * math.log(2), -euler + sum(1 / i for i in range(1, 12))])
    assert topic_model.trigamma(np.array([1.0, 0.5])) == pytest.approx([math.pi**2 / 6, math.pi**2 / 2])


def test_texts_are_inferred_together_as_alone():
    rng = np.random.default_rng(1)
    sizes = [1, 7, 3, 12]
    starts, beta, n = np.cumsum(sizes) - sizes, rng.random((23, 3)), rng.integers(1, 5, 23).astype(float)
    alpha = np.array([0.2, 0.3, 0.5])
    alone = [topic_model.infer(np.array([0]), n[a : a + s], beta[a : a + s], alpha)[0] for a, s in zip(starts, sizes, strict=True)]
    together = topic_model.infer(starts, n, beta, alpha)
    assert together == pytest.approx(np.array(alone))
    # A text's parameters sum to its words and the prior.
    assert together.sum(axis=1) == pytest.approx([n[a : a + s].sum() + 1 for a, s in zip(starts, sizes, strict=True)], rel=1e-9)


def test_planted_topics_are_found_and_odd_texts_kept(spark):
    texts = [(i, (FRUIT if i % 2 else TOOLS) * 4) for i in range(60)] + [(100, ["unseen"]), (101, []), (102, None), (103, ["apple", None, "pear"])]
    texts = spark.createDataFrame(texts, "id long, words array<string>")
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "7")  # texts go over the ends of batches
    try:
        model = topic_model.fit(texts, "id", "words", 2, share=0.5, rounds=25)
        assert sorted(sorted(w) for w in topic_model.likeliest(model, 3)) == [FRUIT, TOOLS]
        assert {r.word: r.df for r in model.weights.collect()} == {w: 30 + (w in ("apple", "pear")) for w in FRUIT + TOOLS}
        found = {r.id: r.topics for r in topic_model.document_topics(model, texts, "id", "words").collect()}
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
    assert len(found) == 64 and found[100] == found[101] == found[102] == [0.0, 0.0]
    side = int(np.argmax(found[1]))
    assert all(np.argmax(found[i]) == (side if i % 2 else 1 - side) and sum(found[i]) == pytest.approx(1) for i in range(60)) and np.argmax(found[103]) == side
    best, table = topic_model.search(texts, "id", "words", [2], n=3, share=0.5, rounds=25)
    assert table == [(2, 1, pytest.approx(vectors.coherence(topic_model.likeliest(best, 3), texts, "words")))]


def test_no_query_keeps_the_words_on_the_driver(spark, monkeypatch):
    """The model of ``fit_topics`` is a row for each word on the driver, sent there in every round."""
    monkeypatch.setattr(vectors, "fit_topics", lambda *_, **__: pytest.fail("the words are on the driver"))
    monkeypatch.setattr(topic_model.fit, "__kwdefaults__", topic_model.fit.__kwdefaults__ | {"rounds": 2})
    assert entry.queries()["v9_topic_words"](spark, FOLDER).count() == 40
    found = entry.queries()["v10_o5_document_topics"](spark, FOLDER).collect()
    assert len(found) == 200 and [r.first for r in found] == sorted((r.first for r in found), reverse=True)
