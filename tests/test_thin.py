"""Thin products, factorised words and layouts against dense versions."""

import random
from collections import Counter
from math import log

import numpy as np
from pyspark.ml.feature import PCA
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.sql import functions as F

from farglass.operators import layout, text_vectors, thin


def sparse(seed=1, n=60):
    rng = np.random.default_rng(seed)
    u = np.linalg.qr(rng.standard_normal((n, 6)))[0]
    dense = u @ np.diag([9, 7, -6, 5, 4, 3]) @ u.T
    return (dense + dense.T) / 2


def entries(spark, dense):
    return spark.createDataFrame([(i, j, float(v)) for (i, j), v in np.ndenumerate(dense)], "row long, col long, value double")


def test_products_and_bases(spark, monkeypatch):
    monkeypatch.setattr(thin, "BROADCAST_NUMBERS", 0)
    dense = sparse()
    x = thin.random_thin(spark.range(60), 5, 3)
    m = np.array([r.x for r in x.orderBy("id").collect()])
    got = thin.multiply(entries(spark, dense), x, 5)
    assert np.allclose([r.x for r in got.orderBy("id").collect()], dense @ m)
    assert np.allclose(thin.inner(x, 5), m.T @ m) and np.allclose(thin.inner(x, 5, got), m.T @ dense @ m)
    basis = np.array([r.x for r in thin.orthonormal(x, 5).orderBy("id").collect()])
    assert np.allclose(basis.T @ basis, np.eye(5))


def test_eigenpairs_agree_with_a_dense_solver(spark):
    dense = sparse()
    values, vectors = thin.eigenpairs(entries(spark, dense), spark.range(60), 5, spare=3, rounds=3)
    want, basis = np.linalg.eigh(dense)
    order = sorted(np.argsort(-np.abs(want))[:5], key=lambda i: -want[i])
    got = np.array([r.x for r in vectors.orderBy("id").collect()])
    assert np.allclose(values, want[order]) and np.allclose(np.abs((got * basis[:, order]).sum(axis=0)), 1)


def sentences():
    rng = random.Random(2)
    groups = [["tea", "cup", "milk", "pot"], ["rope", "sail", "mast", "deck"], ["drum", "horn", "flute", "lute"]]
    return [(i, [rng.choice(groups[i % 3] + ["the", "of"]) for _ in range(rng.randint(0, 12))]) for i in range(300)] + [(900, ["once"]), (901, []), (902, None)]


def plain_association(rows, window, least, power=0.75):
    counts = Counter(w for _, ws in rows for w in ws or [])
    words = sorted(w for w, n in counts.items() if n >= least)
    pairs = Counter()
    for _, ws in rows:
        for i, a in enumerate(ws or []):
            for b in (ws or [])[i + 1 : i + 1 + window]:
                pairs[min(a, b), max(a, b)] += 1
    m = np.zeros((len(words), len(words)))
    for (a, b), n in pairs.items():
        if a in words and b in words:
            m[words.index(a), words.index(b)] = m[words.index(b), words.index(a)] = n
    sums, p = m.sum(axis=1), (1 + power) / 2
    shares = sums**p / (sums**p).sum()
    with np.errstate(divide="ignore"):
        return words, np.maximum(np.log(m / m.sum() / np.outer(shares, shares)), 0)


def test_word_and_text_vectors(spark):
    rows = sentences()
    texts = spark.createDataFrame(rows, "id long, words array<string>")
    words, dense = plain_association(rows, 3, 5)
    matrix, vocabulary = text_vectors.association(texts, "words", window=3, least=5)
    names = {r.id: r.word for r in vocabulary.collect()}
    got = np.zeros_like(dense)
    for r in matrix.collect():
        got[words.index(names[r.row]), words.index(names[r.col])] = r.value
    assert np.allclose(got, dense) and "once" not in words
    found = text_vectors.word_vectors(texts, "words", 5, window=3, least=5, rounds=10)
    vectors = {r.word: np.array(r.vector) for r in found.collect()}
    values, basis = np.linalg.eigh(dense)
    best = np.argsort(-np.abs(values))[:5]
    want = basis[:, best] * np.sqrt(np.abs(values[best]))
    own = np.array([vectors[w] for w in words])
    assert np.allclose(own @ own.T, want @ want.T, atol=1e-6)  # the same up to rotation
    placed = {r.id: r.vector for r in text_vectors.text_vectors(texts, "id", "words", found, 5).collect()}
    assert len(placed) == len(rows) and placed[900] is None and placed[901] is None and placed[902] is None
    total = sum(Counter(w for _, ws in rows for w in ws or [] if w in words).values())
    n = Counter(w for _, ws in rows for w in ws or [])
    first = next(i for i, ws in rows if len(ws) > 3)
    mean = sum(vectors[w] * (1e-3 / (1e-3 + n[w] / total)) for w in rows[first][1])
    assert np.allclose(placed[first], mean / np.linalg.norm(mean))
    groups = [[np.array(placed[i]) for i in range(g, 300, 3) if placed[i] is not None and len(rows[i][1]) > 4] for g in range(3)]
    near = np.mean([a @ b for g in groups for a, b in zip(g, g[1:], strict=False)])
    far = np.mean([a @ b for a, b in zip(groups[0], groups[1], strict=False)])
    assert near > far + 0.3


def test_no_words(spark):
    texts = spark.createDataFrame([(1, []), (2, None)], "id long, words array<string>")
    assert text_vectors.association(texts, "words")[0].collect() == []


def kept_neighbours(a, b, k=10):
    def near(x):
        d = ((x[:, None] - x[None]) ** 2).sum(axis=2)
        np.fill_diagonal(d, np.inf)
        return [set(r) for r in np.argsort(d, axis=1)[:, :k]]

    return np.mean([len(p & q) / k for p, q in zip(near(a), near(b), strict=True)])


def test_layout_keeps_neighbours_better_than_principal_components(spark):
    rng = np.random.default_rng(5)
    x = (rng.standard_normal((20, 15)) * 3)[np.arange(300) % 20] + rng.standard_normal((300, 15))  # twenty groups
    points = spark.createDataFrame([(i, [float(v) for v in r]) for i, r in enumerate(x)] + [(900, [float(v) for v in x[0]]), (901, None)], "key long, v array<double>")
    run = lambda: {r.key: r.x for r in layout.embed(points, "key", "v", 2, k=8, rounds=8, trees=3).collect()}
    got = run()
    assert got[900] == got[0] and 901 not in got and len(got) == 301
    made = points.where("key < 300").withColumn("f", array_to_vector("v"))
    flat = PCA(k=2, inputCol="f", outputCol="p").fit(made).transform(made).orderBy("key").select(vector_to_array("p").alias("p")).collect()
    own = kept_neighbours(x, np.array([got[i] for i in range(300)]))
    assert own > kept_neighbours(x, np.array([r.p for r in flat])) + 0.1
    again = run()
    assert max(abs(a - b) for i in got for a, b in zip(got[i], again[i], strict=True)) < 1e-6


def test_curve_and_fuzzy_weights(spark):
    a, b = layout.curve(0.1, 1.0)
    assert abs(a - 1.577) < 0.02 and abs(b - 0.895) < 0.02
    graph = spark.createDataFrame([(1, [(1.0, 2), (2.0, 3), (4.0, 4)]), (2, [(1.0, 1)]), (3, []), (4, [(0.5, 3)])], "id long, near array<struct<distance:double,id:long>>")
    w = {(r.u, r.v): r.w for r in layout.fuzzy_graph(graph).collect()}
    assert all(abs(w[u, v] - w[v, u]) < 1e-12 for u, v in w) and w[1, 2] == 1 and w[3, 4] == 1
    assert abs(1 + w[1, 3] + w[1, 4] - log(3, 2)) < 1e-6


def test_small_tables(spark):
    points = spark.createDataFrame([(1, [1.0, 2.0]), (2, [0.0, 1.0])], "key long, v array<double>")
    assert [r.x for r in layout.embed(points, "key", "v").collect()] == [[0.0, 0.0]] * 2
    assert layout.embed(points.limit(0), "key", "v").collect() == []


def test_columns_are_doubles(spark):
    assert thin.random_thin(spark.range(3), 2).select(F.col("x")[0]).dtypes[0][1] == "double"


def test_steps_that_nothing_reads_are_deleted(spark, monkeypatch):
    """Of the rounds, and of the pairs on their way to the matrix, only results stay on disk."""
    from farglass import runtime

    made, store = [], runtime.materialise
    for module in (thin, text_vectors, runtime):
        monkeypatch.setattr(module, "materialise", lambda df, name: made.append((name, store(df, name))) or made[-1][1])
    texts = spark.createDataFrame(sentences(), "id long, words array<string>")
    matrix, vocabulary = text_vectors.association(texts, "words", window=3)
    thin.eigenpairs(matrix, vocabulary.select("id"), 3, spare=2, rounds=2)
    left = runtime._MADE.get()
    stay = sorted(name for name, df in made if df._farglass_folder in left)
    assert stay.count("basis") == stay.count("product") == 0 and len(made) > 15
    assert [n for n in stay if n not in ("hot_keys", "ordered")] == ["association", "eigenvectors", "vocabulary"]
    assert matrix.count() and vocabulary.count()
