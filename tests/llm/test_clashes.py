"""Users' columns that bear the operators' own names, repeated rows, ties and nothing at all."""

import random

import pytest
from pyspark.sql import functions as F

from farglass.llm import decontamination, licenses, quality
from farglass.llm.columns import free_prefix
from test_words_and_rules import brute_contamination, brute_license, frame, words

LICENSE = ["license_rules", "license_low", "license_text", "license_matches", "license_all", "license_found", "license_labels", "LICENSE_score", "found", "a.b"]
QUALITY = ["quality_words", "quality_windows", "quality_sorted", "quality_starts", "quality_lines", "quality_n_words", "quality_kept", "quality_base_failed", "own_id", "verdict", "bad", "fold", *quality.FEATURES]
BENCH = ["bench_hash", "bench_own_id", "bench_own_hash", "bench_hits", "bench_n_hit", "bench_contaminated", "own_id", "own_hash", "words", "term", "window", "pos", "here", "context", "a.b"]
PASSAGE = " ".join(f"w{k}" for k in range(20))


def named(spark, texts, names):
    return frame(spark, texts).select("doc_id", "text", *(F.lit(f"own {n}").alias(n) for n in names))


def unchanged(rows, names):
    return all(r[n] == f"own {n}" for r in rows for n in names)


def test_free_prefix():
    assert free_prefix(["a", "b"], "x_") == "x_" and free_prefix(["X_a", "x__b", "y"], "x_") == "x___"


def test_license_names(spark):
    texts = ["under the mit license", None, "SPDX-License-Identifier: GPL-3.0-or-later"]
    rows = licenses.scan(named(spark, texts, LICENSE)).collect()
    assert unchanged(rows, LICENSE) and all(r["license__labels"] == brute_license(r.text)[2] for r in rows)


def test_quality_names(spark):
    docs = named(spark, ["one two three four five six seven eight nine ten", None, "x " * 50], QUALITY)
    rows = quality.judge(docs, []).collect()
    assert unchanged(rows, QUALITY) and {r.doc_id: r["quality__kept"] for r in rows} == {0: True, 1: False, 2: False}
    assert quality.keep(docs, []).columns == docs.columns and unchanged(quality.keep(docs, []).collect(), QUALITY)
    labels = spark.createDataFrame([(0, 1, "x"), (1, None, "x"), (None, 0, "x")], "doc_id long, quality int, own_id string")
    assert quality.learn(docs, labels) == []


def test_decontamination_names_and_repeats(spark):
    items = spark.createDataFrame([(0, PASSAGE, "x"), (1, PASSAGE, "y"), (None, "tiny", "z")], "item_id long, text string, term string")
    near = PASSAGE.replace("w6 ", "w6 inserted ")
    texts = [PASSAGE + " tail", near, None, "a tiny text", near, "free of it"]
    docs = named(spark, texts, BENCH)
    docs = docs.union(docs)
    rows = decontamination.contamination(docs, items).collect()
    assert len(rows) == 12 and unchanged(rows, BENCH)
    for r in rows:
        n, hit, found = brute_contamination(r.text, [(0, PASSAGE), (1, PASSAGE), ("", "tiny")])
        assert (r["bench__n_words"], r["bench__n_hit"], r["bench__items"]) == (n, hit, found)
    counts = {r.doc_id: r["bench__n_near"] for r in rows}
    alone = {r.doc_id: r["bench__n_near"] for r in decontamination.contamination(named(spark, texts, BENCH), items).collect()}
    assert counts == alone and counts[1] == counts[4] > 0  # repeated rows do not add up
    kept = decontamination.clean(docs, items)
    assert kept.columns == docs.columns and unchanged(kept.collect(), BENCH)
    assert decontamination.contamination(docs.limit(0), items).collect() == []


def brute_near(texts, items, window=13, slop=3):
    """Places of windows that are not exact, by the docstring's words."""
    counts = {}
    for t in texts:
        for w in words(t):
            counts[w] = counts.get(w, 0) + 1
    wins = {tuple(w[s : s + window]) for w in map(words, items) for s in range(len(w) - window + 1)}
    out = []
    for t in texts:
        w, found = words(t), 0
        for win in wins:
            order = sorted((counts.get(x, 0), k) for k, x in enumerate(win))
            if not order[0][0]:
                continue
            a, b = order[0][1], order[1][1]
            for pos, x in enumerate(w):
                first = pos - a
                if x != win[a] or first < 0 or win == tuple(w[first : first + window]):
                    continue
                lists = any(0 <= j < len(w) and w[j] == win[b] for j in range(first + b - slop, first + b + slop + 1))
                around = set(w[max(0, first - slop) : max(0, first - slop) + window + 2 * slop])
                found += lists and len(set(win) & around) >= decontamination.NEAR_SHARE * len(set(win))
        out.append(found)
    return out


def test_proximity_matches_brute_force(spark):
    rng = random.Random(4)
    items = [" ".join(rng.choice("abcdefghijklmnopqrstuvwxyz") + rng.choice("xyz") for _ in range(rng.randint(5, 30))) for _ in range(8)]
    texts = []
    for _ in range(40):
        w = rng.choice(items).split()
        for _ in range(rng.randint(0, 4)):
            w.insert(rng.randrange(len(w) + 1), rng.choice(["in", "ax", "by"]))
        texts.append(" ".join(["pre"] * rng.randint(0, 3) + w + w[: rng.randint(0, len(w))]))
    table = spark.createDataFrame(list(enumerate(items)), "item_id long, text string")
    rows = decontamination.contamination(frame(spark, texts), table).orderBy("doc_id").collect()
    assert [r.bench_n_near for r in rows] == brute_near(texts, items) and sum(r.bench_n_near for r in rows)
    assert [(r.bench_n_hit, r.bench_items) for r in rows] == [brute_contamination(t, list(enumerate(items)))[1:] for t in texts]


def test_long_text_of_a_repeated_term(spark):
    text = "zz yy " * 60_000 + PASSAGE
    items = spark.createDataFrame([(0, "zz yy " * 10), (1, PASSAGE)], "item_id long, text string")
    row = decontamination.contamination(frame(spark, [text]), items).first()
    assert (row.bench_n_words, row.bench_n_hit, row.bench_items) == (120_020, 120_020, ["0", "1"])


def labelled(n, rule, seed=1):
    rng = random.Random(seed)
    rows = [{f: round(rng.random(), 2) for f in quality.FEATURES} | {"fold": k % 3} for k in range(n)]
    return [r | {"bad": int(rule(r))} for r in rows]


@pytest.mark.parametrize("rule", [lambda r: r["symbol_share"] > 0.7 and r["upper_share"] <= 0.5 or r["mark_share"] > 0.9, lambda r: (r["word_length"] > 0.3) != (r["digit_share"] > 0.6), lambda r: False, lambda r: True])
def test_the_conditional_says_what_the_list_says(spark, rule):
    rows = labelled(900, rule)
    rules = quality.learn_list(rows)
    made = spark.createDataFrame([tuple(r[f] for f in quality.FEATURES) for r in rows], ", ".join(f"quality_{f} double" for f in quality.FEATURES)).select(quality.accepts(rules)).collect()
    said = [r[0] for r in made]
    assert said == [quality.verdict(rules, r) for r in rows]
    assert sum(a == (not r["bad"]) for a, r in zip(said, rows)) >= 0.95 * len(rows) or not rules
    assert not rules or not rules[-1].keeps


def test_a_list_whose_order_matters():
    keep, reject = (quality.Rule((quality.Condition("symbol_share", True, 0.5),), keeps, 9, 0) for keeps in (True, False))
    row = dict.fromkeys(quality.FEATURES, 1.0)
    assert quality.verdict([keep, reject], row) and not quality.verdict([reject, keep], row)


def test_equal_gains_and_repeated_ids(spark):
    rows = [r | {"upper_share": r["symbol_share"]} for r in labelled(600, lambda r: r["symbol_share"] > 0.5)]
    assert quality.learn_list(rows) == quality.learn_list(rows) and quality.learn_list(rows)[0].conditions[0].feature == "symbol_share"
    docs = frame(spark, ["good words " * 6, "# # # " * 9])
    docs = docs.union(docs).union(docs.withColumn("doc_id", F.lit(0)))
    labels = spark.createDataFrame([(0, 1), (0, 0), (1, 0)], "doc_id long, quality int")
    assert quality.learn(docs, labels) == [] and quality.learn(docs.limit(0), labels) == []
    assert quality.judge(docs.limit(0), []).collect() == []
