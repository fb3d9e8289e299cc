"""Graph of nearest neighbours by trees of random projections.

Every tree halves the points at the median of one random projection after another, until about
``leaf`` points are together; only these are compared with each other, so the work grows as the number
of points times ``trees`` * ``leaf``. All nodes of all trees are halved in one round, at the exact
median of a hashed sample of bounded size, so reruns agree. A point keeps the nearest of what its
leaves show it. ``recall`` measures the graph against all pairs for a set of queries.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from farglass.runtime import lookup, materialise

#: Rows of a node that its median is taken from, about.
SAMPLE = 2000


def distinct_points(points: DataFrame, key: str, vector: str) -> tuple[DataFrame, DataFrame]:
    """Different vectors as ``id`` (smallest key), ``vector``, ``weight`` (rows); and ``key, id`` of every row.

    Rows without a vector are in neither table.
    """
    rows = points.where(F.col(vector).isNotNull()).select(F.col(key).cast("long").alias("key"), F.transform(vector, lambda x: x.cast("double")).alias("vector"))
    rows = materialise(rows, "vectors")
    kinds = materialise(rows.groupBy("vector").agg(F.min("key").alias("id"), F.count("*").alias("weight")), "different_vectors")
    alone = kinds.where("weight = 1").select(F.col("id").alias("key"), "id")
    copies = lookup(rows, kinds.where("weight > 1").select("vector", "id"), "vector").select("key", "id")
    return kinds, alone.unionByName(copies)


def _projector(trees: int, depth: int, seed: int) -> Callable[[Iterator], Iterator]:
    def rows(batches: Iterator) -> Iterator:
        import numpy as np
        import pyarrow as pa

        schema = pa.schema([("id", pa.int64()), ("tree", pa.int32()), ("at", pa.list_(pa.float64()))])
        planes = None
        for batch in batches:
            x = np.stack(batch.column(1).to_numpy(zero_copy_only=False)) if batch.num_rows else np.zeros((0, 1))
            if planes is None:
                planes = np.random.default_rng(seed).standard_normal((x.shape[1], trees * depth))
            at = (x @ planes).reshape(len(x) * trees, depth)
            lists = pa.ListArray.from_arrays(np.arange(0, at.size + 1, depth, dtype="int32"), at.ravel()) if depth else pa.array([[]] * len(at), pa.list_(pa.float64()))
            yield pa.RecordBatch.from_arrays([pa.array(np.repeat(batch.column(0).to_numpy(), trees)), pa.array(np.tile(np.arange(trees, dtype="int32"), len(x))), lists], schema=schema)

    return rows


def _leaves(points: DataFrame, trees: int, leaf: int, seed: int) -> DataFrame:
    """``id, tree, node``: the leaf of each point in each tree."""
    n = points.count()
    depth = max(0, math.ceil(math.log2(max(1, n) / leaf)))
    now = materialise(points.select("id", "vector").mapInArrow(_projector(trees, depth, seed), "id long, tree int, at array<double>").withColumn("node", F.lit(0).cast("long")), "projections")
    for d in range(depth):
        here, share = F.get("at", F.lit(d)), min(1.0, SAMPLE * 2.0**d / n)
        chosen = now.where(F.pmod(F.xxhash64(F.lit(d), "tree", "id"), F.lit(1 << 30)) < int(share * (1 << 30)))
        medians = materialise(chosen.groupBy("tree", "node").agg(F.percentile(here, 0.5).alias("median")), "medians")
        # Points at the median itself go either way, so that no run of equal projections stays together.
        side = F.when(here == F.col("median"), F.xxhash64(F.lit(d), "id", "tree").bitwiseAND(1)).otherwise((here > F.coalesce("median", F.lit(0.0))).cast("long"))
        halved = now.join(F.broadcast(medians) if (1 << d) * trees <= 50_000 else medians, ["tree", "node"], "left")
        now = materialise(halved.select("id", "tree", "at", (F.col("node") * 2 + side).alias("node")), "halved")
    return now.select("id", "tree", "node")


def _nearest(k: int) -> Callable:
    def table(group):
        import numpy as np
        import pyarrow as pa

        ids, x = group.column("id").to_numpy(), np.stack(group.column("vector").to_numpy())
        n, near, apart = len(ids), [], []
        squares = (x * x).sum(axis=1)
        for a in range(0, n, 512):
            rough = squares[None, :] + squares[a : a + 512, None] - 2 * (x[a : a + 512] @ x.T)
            rough[np.arange(len(rough)), np.arange(a, a + len(rough))] = np.inf
            m = min(n - 1, k + 8)  # a few more, as the rough distance may change the order
            best = np.argpartition(rough, m - 1, axis=1)[:, :m] if m else np.zeros((len(rough), 0), int)
            exact = np.sqrt(((x[a : a + 512, None, :] - x[best]) ** 2).sum(axis=2))
            for i in range(len(rough)):
                order = np.lexsort((ids[best[i]], exact[i]))[:k]
                near.append(ids[best[i][order]])
                apart.append(exact[i][order])
        pairs = pa.array([[{"distance": float(d), "id": int(j)} for d, j in zip(ds, js, strict=True)] for ds, js in zip(apart, near, strict=True)], pa.list_(pa.struct([("distance", pa.float64()), ("id", pa.int64())])))
        return pa.table({"id": ids, "near": pairs})

    return table


def neighbour_graph(points: DataFrame, k: int = 15, *, trees: int = 12, leaf: int = 256, seed: int = 1) -> DataFrame:
    """``id, near``: the ``k`` nearest other points as structs of ``distance`` (Euclidean) and ``id``, by both.

    ``points``: ``id, vector`` with different vectors of one length. For cosine distance give unit vectors.
    """
    spread = _leaves(points, trees, leaf, seed).join(points.select("id", "vector"), "id")
    shown = spread.groupBy("tree", "node").applyInArrow(_nearest(k), "id long, near array<struct<distance:double,id:long>>")
    # At most ``trees`` lists of ``k`` for a point.
    merged = F.slice(F.array_sort(F.array_distinct(F.flatten(F.collect_list("near")))), 1, k)
    return materialise(shown.groupBy("id").agg(merged.alias("near")), "neighbours")


def recall(graph: DataFrame, points: DataFrame, queries: DataFrame, k: int) -> float:
    """Share of the true ``k`` nearest of ``queries`` (a stated set of rows of ``points``) that the graph has."""
    asked = queries.select(F.col("id").alias("query"), F.col("vector").alias("query_vector"))
    apart = F.aggregate(F.zip_with("vector", "query_vector", lambda a, b: (a - b) * (a - b)), F.lit(0.0), lambda s, x: s + x)
    scored = points.join(F.broadcast(asked), F.col("id") != F.col("query")).select("query", F.struct(apart.alias("distance"), "id").alias("found"))
    # A window of rank <= k is cut in each partition first (WindowGroupLimit).
    true = scored.withColumn("rank", F.row_number().over(Window.partitionBy("query").orderBy("found"))).where(F.col("rank") <= k)
    hits = true.select(F.col("query").alias("id"), F.col("found.id").alias("other")).join(graph, "id")
    return hits.agg(F.avg(F.array_contains(F.transform(F.slice("near", 1, k), lambda s: s["id"]), F.col("other")).cast("int"))).first()[0] or 0.0
