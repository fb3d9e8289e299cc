"""Neighbour embedding: points laid out in few dimensions so that graph neighbours stay together.

The neighbour graph gets fuzzy weights: a point's nearest has weight 1, the others fall off so that all
weigh log2(k) together; the two directions of an edge are united as probabilities. The start is made of
the leading eigenvectors of the normalised graph. Then come rounds in which every point moves at once:
its neighbours draw it, and a hashed sample of points, the same for all in a round and bounded, pushes
it as all points would. Steps are damped by the pull that a point is under, so they do not overshoot.
Every choice is by hash, so reruns agree.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from farglass.operators import neighbours, thin
from farglass.runtime import lookup, materialise

#: Points that push in one round, about.
PUSHERS = 400
#: Pushes for each pull.
NEGATIVE = 5
#: Points whose places are broadcast in every round; a broadcast passes the driver each time.
BROADCAST_POINTS = 10_000


def curve(min_dist: float, spread: float) -> tuple[float, float]:
    """a and b of 1 / (1 + a d^2b), fitted to 1 up to ``min_dist`` and exp(-(d - min_dist) / spread) beyond."""
    d = np.linspace(1e-3, 3 * spread, 300)
    want = np.where(d < min_dist, 1.0, np.exp(-(d - min_dist) / spread))
    centre, width = np.array([0.0, 0.0]), np.array([5.0, 1.5])
    for _ in range(25):  # a grid around the best point, each time half as wide
        a, b = (np.exp(c + w * np.linspace(-1, 1, 21)) for c, w in zip(centre, width, strict=True))
        miss = ((1 / (1 + a[:, None, None] * d ** (2 * b[None, :, None])) - want) ** 2).sum(axis=2)
        i, j = np.unravel_index(miss.argmin(), miss.shape)
        centre, width = np.log([a[i], b[j]]), width / 2
    return float(np.exp(centre[0])), float(np.exp(centre[1]))


def _fuzzy(batches: Iterator) -> Iterator:
    import pyarrow as pa

    for batch in batches:
        ids, near = batch.column(0).to_numpy(), batch.column(1)
        sizes = np.asarray(near.value_lengths())
        if not sizes.sum():
            continue
        flat = near.flatten()
        k = int(sizes.max())
        inside = np.arange(k) < sizes[:, None]
        apart = np.full((len(ids), k), np.inf)
        apart[inside] = flat.field("distance").to_numpy(zero_copy_only=False)
        rho = np.where(sizes > 0, apart[:, 0], 0.0)[:, None]
        over = np.where(inside, apart - rho, np.inf)
        low, high, goal = np.zeros(len(ids)), np.full(len(ids), np.inf), np.log2(np.maximum(sizes, 2))
        sigma = np.ones(len(ids))
        for _ in range(64):
            much = np.exp(-over / sigma[:, None]).sum(axis=1) > goal
            high, low = np.where(much, sigma, high), np.where(much, low, sigma)
            sigma = np.where(np.isinf(high), sigma * 2, (low + high) / 2)
            sigma = np.clip(sigma, 1e-9, 1e12)
        w = np.exp(-over / sigma[:, None])[inside]
        yield pa.RecordBatch.from_arrays([pa.array(np.repeat(ids, sizes)), flat.field("id"), pa.array(w)], names=["u", "v", "w"])


def fuzzy_graph(graph: DataFrame) -> DataFrame:
    """``u, v, w`` in both directions, from ``id, near``."""
    one = materialise(graph.select("id", "near").mapInArrow(_fuzzy, "u long, v long, w double").where("w > 0"), "directed")
    both = one.select("u", "v", F.col("w").alias("there"), F.lit(0.0).alias("back")).unionByName(one.select(F.col("v").alias("u"), F.col("u").alias("v"), F.lit(0.0).alias("there"), F.col("w").alias("back")))
    sums = both.groupBy("u", "v").agg(F.max("there").alias("there"), F.max("back").alias("back"))
    return materialise(sums.select("u", "v", (F.col("there") + F.col("back") - F.col("there") * F.col("back")).alias("w")), "fuzzy_graph")


def spectral_start(edges: DataFrame, ids: DataFrame, size: int, seed: int) -> DataFrame:
    """Eigenvectors of the normalised graph after the first, 10 wide at most."""
    degrees = materialise(edges.groupBy("u").agg(F.sum("w").alias("d")), "degrees")
    halves = lookup(edges, degrees.withColumnRenamed("d", "du"), "u")
    halves = lookup(materialise(halves, "half_normal"), degrees.select(F.col("u").alias("v"), F.col("d").alias("dv")), "v")
    # Half of the identity makes all eigenvalues positive, so that the largest come first.
    normal = halves.select(F.col("u").alias("row"), F.col("v").alias("col"), (F.col("w") / F.sqrt(F.col("du") * F.col("dv")) / 2).alias("value"))
    normal = materialise(normal.union(ids.select("id", F.col("id").alias("col"), F.lit(0.5))), "normal")
    _, vectors = thin.eigenpairs(normal, ids, size + 1, rounds=6, seed=seed)
    x = vectors.select("id", F.slice("x", 2, size).alias("x"))
    most = x.agg(F.max(F.array_max(F.transform("x", F.abs)))).first()[0] or 1.0
    # A little noise by hash parts points that the graph does not tell apart.
    noise = thin.random_thin(x.select("id"), size, seed + 1).withColumnRenamed("x", "noise")
    return materialise(x.join(noise, "id").select("id", F.zip_with("x", "noise", lambda v, e: v * (10 / most) + e * 1e-4).alias("x")), "start")


def _moved(pushers: np.ndarray, a: float, b: float, rate: float) -> Callable[[Iterator], Iterator]:
    def rows(batches: Iterator) -> Iterator:
        import pyarrow as pa

        for batch in batches:
            if not batch.num_rows:
                continue
            x, pull = np.stack(batch.column(1).to_numpy(zero_copy_only=False)), np.stack(batch.column(2).to_numpy(zero_copy_only=False))
            stiff, degree = (batch.column(i).to_numpy()[:, None] for i in (3, 4))
            push = np.zeros_like(x)
            for p in pushers:
                away = x - p
                d2 = (away * away).sum(axis=1, keepdims=True)
                push += np.clip(away * (2 * b / ((0.001 + d2) * (1 + a * d2**b))), -4, 4)
            y = x + rate * (pull + push * (NEGATIVE * degree / max(1, len(pushers)))) / (1 + stiff)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.ListArray.from_arrays(np.arange(0, y.size + 1, y.shape[1], dtype="int32"), y.ravel())], names=["id", "x"])

    return rows


def _ends(edges: DataFrame, x: DataFrame, n: int) -> DataFrame:
    """``own, other, w`` with the places of both ends as ``x`` and ``y``; of many points none is broadcast,
    by a hint, as the optimiser would go by the few bytes that they take on disk."""
    how = "broadcast" if n <= BROADCAST_POINTS else "shuffle_hash"
    met = edges.join(x.select(F.col("id").alias("other"), F.col("x").alias("y")).hint(how), "other")
    return met.join(x.select(F.col("id").alias("own"), "x").hint(how), "own")


def embed_graph(graph: DataFrame, size: int = 2, *, min_dist: float = 0.1, spread: float = 1.0, rounds: int = 25, seed: int = 1) -> DataFrame:
    """``id, x`` (``size`` coordinates) from a neighbour graph (``id, near``)."""
    a, b = curve(min_dist, spread)
    ids = materialise(graph.select("id"), "ids")
    n = ids.count()
    edges = fuzzy_graph(graph)
    x = spectral_start(edges, ids, size, seed)
    degrees = materialise(edges.groupBy(F.col("u").alias("id")).agg(F.sum("w").alias("degree")), "pulls")
    share, how = min(1.0, PUSHERS / max(1, n)), "merge" if n > BROADCAST_POINTS else "broadcast"
    for r in range(rounds):
        chosen = x.where(F.pmod(F.xxhash64(F.lit(seed), F.lit(r), "id"), F.lit(1 << 30)) < int(share * (1 << 30)))
        pushers = np.array([p.x for p in chosen.orderBy("id").collect()]).reshape(-1, size)  # about PUSHERS rows
        both = _ends(edges.withColumnsRenamed({"u": "own", "v": "other"}), x, n)
        apart = F.zip_with("y", "x", lambda p, q: p - q)
        pair = both.select("own", "w", apart.alias("to")).withColumn("d2", F.aggregate("to", F.lit(0.0), lambda s, v: s + v * v))
        force = F.col("w") * (2 * a * b) * F.pow(F.greatest("d2", F.lit(1e-12)), F.lit(b - 1)) / (1 + a * F.pow("d2", F.lit(b)))
        pair = pair.withColumn("force", F.least(force, F.lit(1e6)))
        pulls = pair.groupBy(F.col("own").alias("id")).agg(*(F.sum(F.col("force") * F.get("to", F.lit(j))).alias(f"p{j}") for j in range(size)), F.sum("force").alias("stiff"))
        state = x.join(pulls.select("id", F.array(*(f"p{j}" for j in range(size))).alias("pull"), "stiff").hint(how), "id").join(degrees.hint(how), "id")
        x = materialise(state.select("id", "x", "pull", "stiff", "degree").mapInArrow(_moved(pushers, a, b, 1 - r / rounds), "id long, x array<double>"), f"layout_{r}")
    return x


def embed(points: DataFrame, key: str, vector: str, size: int = 2, *, k: int = 15, min_dist: float = 0.1, spread: float = 1.0, rounds: int = 25, trees: int = 16, seed: int = 1) -> DataFrame:
    """``key, x``: coordinates of every row with a vector; equal vectors share theirs.

    Tables of fewer than ``size`` + 10 different vectors have no layout to speak of and get zeros.
    """
    kinds, rows = neighbours.distinct_points(points, key, vector)
    if kinds.count() < size + 10:
        placed = kinds.select("id", F.array_repeat(F.lit(0.0), size).alias("x"))
    else:
        placed = embed_graph(neighbours.neighbour_graph(kinds, k, trees=trees, seed=seed), size, min_dist=min_dist, spread=spread, rounds=rounds, seed=seed)
    return lookup(materialise(rows, "row_ids"), placed, "id").select(F.col("key").alias(key), "x")
