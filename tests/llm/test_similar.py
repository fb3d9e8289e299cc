"""The near-dedup stage against brute-force Jaccard similarity."""

import random
from itertools import combinations

from farglass.llm import similar


def brute(texts, k=5):
    """Components by exact similarity of word shingles: id to smallest id."""
    sets = {}
    for key, text in texts.items():
        w = (text or "").encode().lower().split()
        sets[key] = {b" ".join(w[i : i + k]) for i in range(max(1, len(w) - k + 1))} if w else set()
    parent = {x: x for x in sets}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in combinations(sorted(sets), 2):
        if 5 * len(sets[a] & sets[b]) >= 4 * len(sets[a] | sets[b]):
            a, b = sorted((find(a), find(b)))
            parent[b] = a
    return {x: find(x) for x in sets}


def made_texts():
    """Copies with more and more changed words, on both sides of 0.8, chains of copies and odd texts."""
    rng = random.Random(5)
    texts = [None, "", " \x0b", "one", "ONE\tone", "one one", "a b c d e", "A b c\nd e", "a b c d e f", "É a b c d"]
    for size in (30, 60, 120, 300):
        for _ in range(6):
            base = [f"w{rng.randint(0, 400)}" for _ in range(size)]
            for changes in range(0, 1 + size // 25):
                w = list(base)
                for k in rng.sample(range(size), changes):
                    w[k] = "changed"
                texts.append(" ".join(w))
            for _ in range(4):  # a chain: each link a copy of the last
                base[rng.randrange(size)] = f"x{rng.randint(0, 9)}"
                texts.append("  ".join(base))
    rng.shuffle(texts)
    return dict(enumerate(texts))


def test_near_dedup_stage_matches_brute_force(spark):
    import corpus_pipeline

    texts = made_texts()
    docs = spark.createDataFrame([(k, t, "clash") for k, t in texts.items()], "doc_id long, text string, node string")
    want = brute(texts)
    assert {r.doc_id: r.component_id for r in similar.near_duplicates(docs).collect()} == want
    kept = corpus_pipeline.near_dedup(spark, docs, "")
    assert sorted(r.doc_id for r in kept.collect()) == sorted(set(want.values())) and kept.columns == docs.columns
    assert similar.near_duplicates(docs.limit(0)).collect() == []


def test_near_dedup_stage_on_sample(spark):
    import corpus_pipeline

    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    want = brute({r.doc_id: r.text for r in docs.collect()})
    assert {r.doc_id for r in corpus_pipeline.near_dedup(spark, docs, "").collect()} == set(want.values())
