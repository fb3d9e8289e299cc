"""Ranked search against plain scoring of every document, and what the treaps cut off."""

import math
import random
import re
from collections import Counter

import numpy as np
import pytest

from farglass.llm import ranked_search

WORD = re.compile(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")
LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
SCHEMA = "doc_id long, text string, item string, n string, `a.b` string, rank string"


def words(text):
    return WORD.findall((text or "").translate(LOWER))


def plain(docs, items, k=10):
    counts = [(d, Counter(words(t))) for d, t in docs]
    n_docs, n_terms = sum(bool(c) for _, c in counts), sum(sum(c.values()) for _, c in counts)
    df = Counter(w for _, c in counts for w in c)
    out = []
    for item, text in items:
        scored = []
        for d, c in counts:
            m = 10 + (90 * sum(c.values()) * n_docs) // max(n_terms, 1)
            s = sum(math.floor(1000 * math.log((2 * n_docs + 2) / (2 * df[w] + 1))) * ((10**9 * c[w]) // (1000 * c[w] + 8 * m)) for w in set(words(text)) if w in c)
            if s > 0:
                scored.append((-s, d is None, d or 0, d))
        out += [(item, i + 1, x[3], -x[0]) for i, x in enumerate(sorted(scored, key=lambda x: x[:3])[:k])]
    return sorted(out, key=str)


def corpus():
    rng = random.Random(11)
    common, rare = ["the", "of", "And", "être", "x1"], [f"w{i}" for i in range(60)] + ["K", "ſharp", "naïve"]
    docs = [(i, " ".join(rng.choice(common if rng.random() < 0.6 else rare) + rng.choice([" ", ",", "\n", "-", "_", "\x7f"]) for _ in range(rng.choice([0, 1, 3, 20, 80])))) for i in range(300)]
    docs += [(i, "the same copy of w1 and w2") for i in range(1000, 1040)]  # ties
    docs += [(5, "w3 w3 the"), (5, "w3 w3 the"), (None, "w3 w4 w4"), (None, "w3 w4 w4"), (2000, None), (2001, ""), (2002, "THE " * 5000 + "w9 " * 4000)]
    items = [(i, " ".join(rng.choice(common + rare) for _ in range(rng.choice([1, 2, 6, 30])))) for i in range(25)]
    items += [(7, "w3 w4"), (7, "the"), (None, "w1 w2 W1"), (90, None), (91, "unseen words only"), (92, ""), (93, "copy")]
    return docs, items


def got(spark, docs, items, k=10):
    docs = spark.createDataFrame([(*r, "i", "n", "x", "r") for r in docs], SCHEMA)
    items = spark.createDataFrame([(*r, "own") for r in items], "item_id long, text string, item string")
    return sorted((tuple(r) for r in ranked_search.search(docs, items, k).select("item_id", "rank", "doc_id", "score").collect()), key=str)


@pytest.mark.parametrize("k", [1, 10, 1000])
def test_against_plain_scoring(spark, k):
    docs, items = corpus()
    random.Random(3).shuffle(docs)
    assert got(spark, docs, items, k) == plain(docs, items, k)


def test_small_blocks_of_documents_and_queries(spark, monkeypatch):
    docs, items = corpus()
    monkeypatch.setattr(ranked_search, "ITEM_TERMS", 90)
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "20")
    try:
        assert got(spark, docs, items) == plain(docs, items)
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")


@pytest.mark.parametrize("rows", [([], []), ([(1, "a")], []), ([], [(1, "a")]), ([(1, None)], [(1, "a")])])
def test_least_tables(spark, rows):
    assert got(spark, *rows) == []


def treaps_of(n, terms, seed):
    rng = np.random.default_rng(seed)
    held = rng.random((n, terms)) < rng.random(terms) ** 3
    lengths = held.sum(axis=1)
    flat = np.tile(np.arange(terms), (n, 1))[held]
    counts = rng.geometric(0.7, len(flat))
    weights = np.array([math.floor(1000 * math.log((2 * n + 2) / (2 * held[:, t].sum() + 1))) for t in range(terms)])
    sizes = lengths + rng.integers(0, 50, n)
    return ranked_search.Treaps(rng.permutation(n) * 3, np.zeros(n, bool), sizes, lengths, flat, counts, weights, n, int(sizes.sum()))


def test_treaps_are_search_trees_and_heaps():
    t = treaps_of(500, 12, 1)
    for root in t.root[t.root != t.end]:
        stack, seen = [(root, -1, 10**9, 1 << 62)], []
        while stack:
            p, low, high, top = stack.pop()
            if p != t.end:
                assert low < t.doc[p] < high and t.value[p] <= top
                seen.append(p)
                stack += [(t.left[p], low, t.doc[p], t.value[p]), (t.right[p], t.doc[p], high, t.value[p])]
        assert sorted(seen) == list(range(min(seen), max(seen) + 1))


def test_subtrees_that_cannot_enter_are_cut_off():
    t = treaps_of(20_000, 30, 2)
    best, asked = ranked_search.Best(10), np.ones(30, bool)
    seen = t.search(np.arange(30), asked, best)
    scores = np.array([t._scores(np.array([d]), asked)[0] if t.doc_starts[d] < t.doc_starts[d + 1] else 0 for d in range(20_000)])
    order = np.lexsort((t.ids, -scores))[:10]
    assert best.scores.tolist() == scores[order].tolist() and best.ids.tolist() == t.ids[order].tolist()
    assert seen < 10_000
