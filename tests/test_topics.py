"""Topics from clusters against plain versions, and planted groups that are found again."""

import math
import random
from collections import Counter, defaultdict

from farglass.operators import topics

GROUPS = [["tea", "cup", "milk"], ["rope", "sail", "mast"], ["drum", "horn", "lute"]]


def planted():
    """Twelve topics, four from each of three groups; some texts have none."""
    rng = random.Random(8)
    rows = []
    for d in range(240):
        t = d % 12
        words = GROUPS[t % 3] + [f"own{t}", "the", "of"]
        rows += [(d, None if d % 20 == 7 else t, rng.choice(words)) for _ in range(8)]
    return rows


def frame(spark, rows):
    return spark.createDataFrame(rows, "doc long, t long, w string")


def plain_scores(rows):
    tf = Counter((t, w) for _, t, w in rows if t is not None)
    size, uses = Counter(), Counter()
    for (t, w), n in tf.items():
        size[t] += n
        uses[w] += n
    mean = sum(size.values()) / len(size)
    return {(t, w): n / size[t] * math.log(1 + mean / uses[w]) for (t, w), n in tf.items()}


def units(scores):
    by = defaultdict(dict)
    for (t, w), s in scores.items():
        by[t][w] = s
    return {t: {w: s / math.sqrt(sum(x * x for x in ws.values())) for w, s in ws.items()} for t, ws in by.items()}


def plain_tree(scores):
    sums, size, out = units(scores), Counter(), []
    size.update(sums.keys())
    while True:
        pairs = [(-round(sum(x * sums[b].get(w, 0) for w, x in sums[a].items()) / (size[a] * size[b]), 12), a, b) for a in sums for b in sums if a < b]
        if not pairs or min(pairs)[0] >= 0:
            return out
        s, a, b = min(pairs)
        out.append((a, b, -s))
        for w, x in sums.pop(b).items():
            sums[a][w] = sums[a].get(w, 0) + x
        size[a] += size.pop(b)


def test_words_of_topics(spark):
    rows = planted()
    got = {(r.topic, r.word): r.score for r in topics.class_words(frame(spark, rows), "t", "w").collect()}
    want = plain_scores(rows)
    assert got.keys() == want.keys() and all(abs(got[k] - want[k]) < 1e-12 for k in want)
    first = {r.topic: r.word for r in topics.top_words(topics.class_words(frame(spark, rows), "t", "w"), 1).collect()}
    assert first == {t: max((w for u, w in want if u == t), key=lambda w: (want[t, w],)) for t in range(12)}


def test_tree_and_planted_groups(spark):
    rows = planted()
    scored = topics.class_words(frame(spark, rows), "t", "w")
    tree = topics.merge_tree(scored)
    got, want = {(r.a, r.b): r.similarity for r in tree.collect()}, plain_tree(plain_scores(rows))
    assert got.keys() == {(a, b) for a, b, _ in want} and all(abs(got[a, b] - s) < 1e-9 for a, b, s in want)
    cut = {r.topic: r.merged for r in topics.cut_tree(tree, scored.select("topic").distinct(), 3).collect()}
    assert cut == {t: t % 3 for t in range(12)}


def test_texts_without_a_topic_are_given_one(spark):
    rows = planted() + [(999, None, "unseen")]
    scored = topics.class_words(frame(spark, rows), "t", "w")
    got = {r.doc: (r.topic, r.similarity) for r in topics.reassign(frame(spark, rows), "doc", "t", "w", scored).collect()}
    vectors, want = units(plain_scores(rows)), {}
    for d in {d for d, t, _ in rows if t is None}:
        tf = Counter(w for e, _, w in rows if e == d)
        alike = {t: round(sum(n * v.get(w, 0) for w, n in tf.items()) / math.sqrt(sum(n * n for n in tf.values())), 12) for t, v in vectors.items()}
        best = min(alike, key=lambda t: (-alike[t], t))
        if alike[best] > 0:
            want[d] = (best, alike[best])
    assert got.keys() == want.keys() and all(got[d][0] == want[d][0] and abs(got[d][1] - want[d][1]) < 1e-9 for d in want)
    assert 999 not in got and sum(t % 3 == d % 3 for d, (t, _) in got.items()) / len(got) > 0.9


def test_no_topics(spark):
    scored = topics.class_words(frame(spark, [(1, None, "a")]), "t", "w")
    assert scored.collect() == [] and topics.merge_tree(scored).collect() == []
    assert topics.reassign(frame(spark, [(1, None, "a")]), "doc", "t", "w", scored).collect() == []
