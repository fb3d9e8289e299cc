"""Neighbour graphs and density clusters against plain versions over all pairs."""

from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from farglass.operators import density, neighbours

K = 8


def blobs(seed=3, per=45, heavy=14):
    """Five groups, two of them close together, noise, copies, and a part of its own far away."""
    rng = np.random.default_rng(seed)
    centres = [(0, 0, 0), (3, 0, 0), (0, 9, 0), (9, 9, 0), (500, 0, 0)]
    points = [np.array(c) + rng.normal(0, 0.5 + 0.1 * i, 3) for i, c in enumerate(centres) for _ in range(per)]
    points += [rng.uniform(-6, 15, 3) for _ in range(30)]
    points += [np.array([0.1, 0.2, 0.3])] * heavy + [np.array([60.0, 60.0, 60.0])] * 3
    rng.shuffle(points)
    return [(i * 7 + 3, [float(v) for v in p]) for i, p in enumerate(points)]


def plain_graph(points, k):
    ids, x = np.array([i for i, _ in points]), np.array([v for _, v in points])
    out = {}
    for n, i in enumerate(ids):
        d = np.sqrt(((x[n] - x) ** 2).sum(axis=1))
        order = [j for j in np.lexsort((ids, d)) if j != n][:k]
        out[i] = [(d[j], ids[j]) for j in order]
    return out


def plain_forest(graph, weights, min_samples):
    core = {i: 0.0 if weights[i] > min_samples else near[min(min_samples, len(near)) - 1][0] for i, near in graph.items()}
    edges = {}
    for i, near in graph.items():
        for d, j in near:
            edges[min(i, j), max(i, j)] = max(d, core[i], core[j])
    root, out = {i: i for i in graph}, []

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for w, u, v in sorted((w, u, v) for (u, v), w in edges.items()):
        a, b = find(u), find(v)
        if a != b:
            root[a] = b
            out.append((w, u, v))
    return out


def plain_clusters(graph, weights, min_size, min_samples, method):
    """Chosen clusters as ``{id: (cluster, w)}`` by following all merges in order."""
    comp, members, born, place, splits = {i: i for i in graph}, {i: [i] for i in graph}, {}, {}, []
    n = dict(weights)
    for i, w in weights.items():
        if w >= min_size:
            born[i], place[i] = ("heavy", i), (("heavy", i), 0.0)
    for rank, (w, u, v) in enumerate(plain_forest(graph, weights, min_samples)):
        a, b = comp[u], comp[v]
        big_a, big_b = n[a] >= min_size, n[b] >= min_size
        cluster = born.get(a) if big_a else born.get(b)
        if n[a] + n[b] >= min_size and big_a == big_b:
            cluster = rank
        if big_a and big_b:
            splits += [(born[a], rank, w, n[a]), (born[b], rank, w, n[b])]
        elif n[a] + n[b] >= min_size:
            for side, big in ((a, big_a), (b, big_b)):
                if not big:
                    place.update({i: (cluster, w) for i in members[side]})
        members[a] += members.pop(b)
        n[a] += n[b]
        for i in members[a]:
            comp[i] = a
        if cluster is not None:
            born[a] = cluster
    parents, children = {c: (p, w) for c, p, w, _ in splits}, defaultdict(list)
    for c, p, _, _ in splits:
        children[p].append(c)
    clusters = {c for c, _ in place.values()} | set(parents) | set(children)
    if method == "leaf":
        taken = {c for c in clusters if not children[c]}
    else:
        least = min([w for _, w in place.values() if w > 0] + [w for _, _, w, _ in splits])
        own = {}
        for c in clusters:
            begin = 1 / max(parents[c][1], least) if c in parents else 0.0
            left = [(w, weights[i]) for i, (d, w) in place.items() if d == c] + [(w, m) for _, p, w, m in splits if p == c]
            own[c] = sum(m * (1 / max(w, least) - begin) for w, m in left)
        taken = set()

        def value(c):
            below = sum(value(x) for x in children[c])
            if (own[c] >= below and c in parents) or below == 0:
                taken.add(c)
            return max(own[c], below)

        for c in clusters:
            if c not in parents:
                value(c)
    out = {}
    for i, (c, w) in place.items():
        chosen = None
        while True:
            chosen = c if c in taken else chosen
            if c not in parents:
                break
            c = parents[c][0]
        if chosen is not None:
            out[i] = (chosen, w)
    return out


def plain_answer(points, min_size, min_samples, method, noise, k=K):
    kinds = {}
    for i, v in points:
        kinds.setdefault(tuple(v), []).append(i)
    weights = {min(ids): len(ids) for ids in kinds.values()}
    graph = plain_graph([(min(ids), v) for v, ids in kinds.items()], k)
    inside = plain_clusters(graph, weights, min_size, min_samples, method)
    first = defaultdict(lambda: 1 << 60)
    least = defaultdict(lambda: float("inf"))
    for i, (c, w) in inside.items():
        first[c] = min(first[c], i)
        if w > 0:
            least[c] = min(least[c], w)
    label = {c: n for n, c in enumerate(sorted(first, key=first.get))}
    held = {i: (label[c], least[c] / max(w, least[c]) if least[c] < float("inf") else 1.0) for i, (c, w) in inside.items()}
    out = {}
    for i, near in graph.items():
        if noise:
            out[i] = held.get(i, (-1, 0.0))
            continue
        share, total = Counter(), 0.0
        for d, j in [(near[0][0], i), *near]:
            part = near[0][0] / d
            total += part
            if j in held:
                share[held[j][0]] += part * held[j][1]
        out[i] = max(((s / total, -c) for c, s in share.items()), default=(0.0, 2))
        out[i] = (-out[i][1], out[i][0])
    return {key: out[min(ids)] for ids in kinds.values() for key in ids}


def frame(spark, points):
    return spark.createDataFrame([(i, v, "x") for i, v in points], "key long, v array<double>, label string")


@pytest.mark.parametrize(("method", "noise", "min_samples", "bucket"), [("leaf", False, 1, 1 << 20), ("eom", True, 3, 40)])
def test_density_clusters_against_plain_merges(spark, monkeypatch, method, noise, min_samples, bucket):
    monkeypatch.setattr(density, "BUCKET", bucket)
    points = blobs()
    got = density.density_clusters(frame(spark, points), "key", "v", min_size=10, min_samples=min_samples, method=method, noise_labels=noise, k=K, trees=2, leaf=1000)
    got = {r.key: (r.label, round(r.probability, 9)) for r in got.collect()}
    want = {i: (c, round(p, 9)) for i, (c, p) in plain_answer(points, 10, min_samples, method, noise).items()}
    assert got == want and len({c for c, _ in want.values()}) >= 5


def test_beyond_the_broadcast_bounds(spark, monkeypatch):
    import farglass.runtime as runtime

    monkeypatch.setattr(runtime, "BROADCAST_ROWS", 0)
    monkeypatch.setattr(runtime, "HOT_SHARE", 10)
    monkeypatch.setattr(density, "BUCKET", 30)
    points = blobs(per=15)
    got = density.density_clusters(frame(spark, points), "key", "v", min_size=6, k=K, trees=1, leaf=1000)
    assert {r.key: (r.label, round(r.probability, 9)) for r in got.collect()} == {i: (c, round(p, 9)) for i, (c, p) in plain_answer(points, 6, 1, "leaf", False).items()}


def test_least_tables(spark):
    for points in ([], [(1, [0.0, 0.0])], [(1, [0.0, 0.0]), (2, [0.0, 0.0])], [(1, [0.0, 1.0]), (2, None), (3, [1.0, 0.0])]):
        got = density.density_clusters(frame(spark, points), "key", "v", min_size=2, k=K)
        assert {r.key for r in got.collect()} == {i for i, v in points if v}


def test_recall_and_reruns(spark):
    vectors = spark.read.parquet("/root/testdata/sf0.1/embeddings.parquet")
    kinds, rows = neighbours.distinct_points(vectors, "vec_id", "embedding")
    assert rows.count() == vectors.count() == 2000
    graph = neighbours.neighbour_graph(kinds, 15, trees=16)
    assert neighbours.recall(graph, kinds, kinds.where("id % 10 = 0"), 15) >= 0.9
    again = neighbours.neighbour_graph(kinds.repartition(5), 15, trees=16)
    assert graph.exceptAll(again).isEmpty() and again.exceptAll(graph).isEmpty()


def test_a_group_of_equal_projections_is_halved(spark):
    points = spark.range(400).select("id", F.array(F.lit(1.0), F.lit(0.0)).alias("vector"))
    sizes = [r["count"] for r in neighbours._leaves(points, 2, 50, 1).groupBy("tree", "node").count().collect()]
    assert len(sizes) == 16 and max(sizes) < 100
