"""Density clusters: a hierarchy of mutual reachability on a neighbour graph, with soft membership.

The graph's edges weigh as much as the largest of their length and the core distances of their ends
(the distance within which a point has ``min_samples`` others). The steps, all of them joins and sums:

* ``minimum_forest``: Boruvka rounds; every component takes its least edge, chains of choices are
  shortened by pointer jumping. Edges are ordered by (weight, ends), so the forest is one.
* The hierarchy of merges. Edges are ranked and dealt into buckets of bounded size. Halves of the rank
  range are contracted level by level, as a binary search over ranks that all edges and points take
  together; then the merges of each bucket are followed in one task, over components that have names.
* A merge of two components of ``min_size`` points or more is a split of a cluster; smaller ones fall
  out of it. Clusters are chosen as leaves of the tree of splits, or by excess of mass.
* Membership: a point's share of its neighbours (nearer ones count more) that are in each chosen
  cluster. A point without any is labelled -2; with ``noise_labels`` points outside of chosen clusters
  are labelled -1 and others have the strength of their density.

The graph may be in several parts; each is then a hierarchy of its own. Points without a vector get no
row; equal vectors are one point with a weight and get the same answer.
"""

from __future__ import annotations

import math
from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from farglass.operators import neighbours
from farglass.operators.components import connected_components
from farglass.runtime import lookup, materialise, numbered

#: Merges that one task follows.
BUCKET = 200_000
#: A bucket or group of buckets and a point's number in one key.
_SHIFT = 40


def reachability(graph: DataFrame, weights: DataFrame, min_samples: int) -> DataFrame:
    """``u, v, w``: each edge of the graph once, with its mutual reachability distance.

    ``graph``: ``id, near``; ``weights``: ``id, weight``. A point of weight above ``min_samples`` has
    core distance 0. Where the graph shows fewer than ``min_samples`` points the farthest shown counts.
    """
    longer = F.get("near", F.least(F.lit(min_samples), F.size("near")) - 1)["distance"]
    cores = materialise(graph.join(weights, "id").select("id", F.when(F.col("weight") > min_samples, 0.0).otherwise(longer).alias("core")), "cores")
    edges = graph.select(F.col("id").alias("a"), F.explode("near").alias("e")).select(F.least("a", "e.id").alias("u"), F.greatest("a", "e.id").alias("v"), F.col("e.distance").alias("d"))
    edges = materialise(edges.groupBy("u", "v").agg(F.min("d").alias("d")), "graph_edges")
    edges = lookup(edges, cores.withColumnsRenamed({"id": "u", "core": "core_u"}), "u")
    edges = lookup(materialise(edges, "half_weighed"), cores.withColumnsRenamed({"id": "v", "core": "core_v"}), "v")
    return edges.select("u", "v", F.greatest("d", "core_u", "core_v").alias("w"))


def _jumped(links: DataFrame) -> DataFrame:
    """``node, root`` from ``node, parent`` (a root is its own parent): pointers are doubled until none moves."""
    while True:
        further = links.select(F.col("node").alias("parent"), F.col("parent").alias("root"))
        after = materialise(lookup(links, further, "parent").select("node", F.col("root").alias("parent"), (F.col("root") != F.col("parent")).alias("moved")), "pointers")
        if after.where("moved").isEmpty():
            return after.select("node", F.col("parent").alias("root"))
        links = after.select("node", "parent")


def minimum_forest(edges: DataFrame) -> DataFrame:
    """``u, v, w``: the edges of the minimum spanning forest, ordered by (w, u, v) where weights tie."""
    left = materialise(edges.where("u <> v").select(F.col("u").alias("a"), F.col("v").alias("b"), F.struct("w", "u", "v").alias("e")), "open_edges")
    chosen = []
    while True:
        both = left.union(left.select("b", "a", "e"))
        best = materialise(both.groupBy("a").agg(F.min(F.struct("e", "b")).alias("x")).select(F.col("a").alias("node"), F.col("x.b").alias("parent"), "x.e"), "least_edges")
        if best.isEmpty():
            break
        chosen.append(best.select("e").distinct())
        # Two components that chose one edge point at each other; the smaller becomes the root.
        back = best.select(F.col("node").alias("parent"), F.col("parent").alias("back"))
        links = lookup(best.select("node", "parent"), back, "parent").select("node", F.when((F.col("back") == F.col("node")) & (F.col("node") < F.col("parent")), F.col("node")).otherwise(F.col("parent")).alias("parent"))
        roots = materialise(_jumped(materialise(links, "links")), "roots")
        left = lookup(left, roots.withColumnsRenamed({"node": "a", "root": "root_a"}), "a")
        left = lookup(materialise(left, "half_moved"), roots.withColumnsRenamed({"node": "b", "root": "root_b"}), "b")
        left = left.where("root_a <> root_b").groupBy(F.least("root_a", "root_b").alias("a"), F.greatest("root_a", "root_b").alias("b")).agg(F.min("e").alias("e"))
        left = materialise(left, "open_edges")
    forest = edges.sparkSession.createDataFrame([], "w double, u long, v long").select(F.struct("w", "u", "v").alias("e"))
    for part in chosen:
        forest = forest.union(part)
    return forest.select("e.u", "e.v", "e.w")


def _follow(min_size: int) -> Callable:
    """The merges of one bucket, in order of rank, over the components that it begins with."""

    def table(group):
        import pyarrow as pa

        cols = {c: group.column(c).to_pylist() for c in ("rank", "w", "a", "b", "size_a", "size_b", "born_a", "born_b")}
        order = sorted(range(len(cols["rank"])), key=cols["rank"].__getitem__)
        root: dict[int, int] = {}
        size, born, small = {}, {}, {}
        out: list[tuple] = []

        def find(x: int) -> int:
            while root[x] != x:
                root[x] = root[root[x]]
                x = root[x]
            return x

        def add(x: int, n: int, by) -> int:
            if x not in root:
                root[x], size[x], born[x], small[x] = x, n, by, [x] if n < min_size else []
            return find(x)

        bucket = group.column("bucket")[0].as_py() if group.num_rows else 0
        for i in order:
            rank, w = cols["rank"][i], cols["w"][i]
            a, b = add(cols["a"][i], cols["size_a"][i], cols["born_a"][i]), add(cols["b"][i], cols["size_b"][i], cols["born_b"][i])
            big_a, big_b, n = size[a] >= min_size, size[b] >= min_size, size[a] + size[b]
            cluster = born[a] if big_a else born[b]
            if n >= min_size and big_a == big_b:
                cluster = rank
                out.append(("birth", bucket, rank, w, rank, None, None))
            if big_a and big_b:
                out.append(("split", bucket, rank, w, rank, born[a], size[a]))
                out.append(("split", bucket, rank, w, rank, born[b], size[b]))
            elif n >= min_size:
                out += [("entry", bucket, rank, w, cluster, x, None) for x in small[a] + small[b]]
            keep, gone = (a, b) if size[a] >= size[b] else (b, a)
            root[gone], size[keep], born[keep] = keep, n, cluster
            small[keep] = small[keep] + small[gone] if n < min_size else []
        names = ("kind", "bucket", "rank", "w", "cluster", "other", "size")
        kinds = (pa.string(), pa.int64(), pa.int64(), pa.float64(), pa.int64(), pa.int64(), pa.int64())
        return pa.table([pa.array([r[i] for r in out], t) for i, t in enumerate(kinds)], names=names)

    return table


_EVENTS = "kind string, bucket long, rank long, w double, cluster long, other long, size long"


def _key(group: str, node: str) -> Column:
    return F.shiftleft(group, _SHIFT).bitwiseOR(F.col(node))


def hierarchy(forest: DataFrame, weights: DataFrame, min_size: int) -> tuple[DataFrame, DataFrame]:
    """The clusters' tree and the points' places in it.

    ``forest``: ``u, v, w`` with points numbered from 0; ``weights``: ``id, weight``. Returns
    ``cluster, parent, w, size`` (a row for each cluster that splits off at distance ``w``) and
    ``id, cluster, w`` (the distance at which the point leaves the cluster, going down). A point that
    weighs ``min_size`` by itself is a cluster, numbered -2 - id, and leaves it at 0.
    """
    ranked = numbered(forest, "w", "u", "v")
    edges = materialise(ranked.select("rank", F.floor(F.col("rank") / BUCKET).cast("long").alias("bucket"), "w", F.col("u").alias("a"), F.col("v").alias("b"), F.lit(0).cast("long").alias("g")), "ranked_edges")
    n = edges.count()
    bits = max(0, math.ceil(math.log2(max(1, -(-n // BUCKET)))))
    weights = materialise(weights.select("id", "weight"), "weights")
    sizes = weights.select(F.lit(0).cast("long").alias("g"), F.col("id").alias("node"), F.col("weight").alias("size"))
    points = weights.where(F.col("weight") < min_size).select("id", F.lit(0).cast("long").alias("g"), F.col("id").alias("node"))
    levels = []
    for level in range(bits):
        # The bit of the bucket that tells the lower half of a group from the upper one.
        upper = F.shiftright("bucket", bits - level - 1).bitwiseAND(1)
        low = edges.where(upper == 0)
        found = connected_components(low.select(_key("g", "a").alias("u"), _key("g", "b").alias("v")))
        found = found.select(F.shiftright("node", _SHIFT).alias("g"), F.col("node").bitwiseAND((1 << _SHIFT) - 1).alias("node"), F.col("component").bitwiseAND((1 << _SHIFT) - 1).alias("component"))
        found = materialise(found, "halves")
        joined = found.join(sizes, ["g", "node"]).groupBy("g", "component").agg(F.sum("size").alias("joint"))
        found = materialise(lookup(found, joined, "g", "component"), "sized_halves")
        names = found.select("g", "node", "component")
        high = edges.where(upper == 1)
        for end in ("a", "b"):
            moved = materialise(high.join(names.withColumnRenamed("node", end), ["g", end], "left"), "moving")
            high = moved.withColumn(end, F.coalesce("component", end)).drop("component")
        after = low.withColumn("g", F.col("g") * 2).unionByName(high.select(*low.columns).withColumn("g", F.col("g") * 2 + 1))
        after = materialise(after, "halved_edges")
        ends = after.select("g", F.explode(F.array("a", "b")).alias("node")).distinct()
        joint = found.select((F.col("g") * 2 + 1).alias("g"), F.col("component").alias("node"), "joint").distinct()
        before = sizes.select(F.explode(F.array(F.col("g") * 2, F.col("g") * 2 + 1)).alias("g"), "node", "size")
        sizes = materialise(ends.join(before, ["g", "node"], "left").join(joint, ["g", "node"], "left").select("g", "node", F.coalesce("joint", "size").alias("size")), "sizes")
        # A point whose component is large enough after the lower half has entered in it.
        held = points.join(found, ["g", "node"], "left")
        enters = F.coalesce(F.col("joint") >= min_size, F.lit(False))
        points = materialise(held.select("id", F.when(enters, F.col("g") * 2).otherwise(F.col("g") * 2 + 1).alias("g"), F.when(enters, F.col("node")).otherwise(F.coalesce("component", "node")).alias("node")), "searched")
        levels.append((found, after.where(F.col("g").bitwiseAND(1) == 0)))
        edges = after
    sized = materialise(lookup(edges, sizes.select("g", F.col("node").alias("a"), F.col("size").alias("size_a")), "g", "a"), "half_sized")
    sized = materialise(lookup(sized, sizes.select("g", F.col("node").alias("b"), F.col("size").alias("size_b")), "g", "b"), "sized_edges")
    unborn = sized.withColumns({"born_a": F.lit(None).cast("long"), "born_b": F.lit(None).cast("long")})
    births = materialise(unborn.groupBy("bucket").applyInArrow(_follow(min_size), _EVENTS).where("kind = 'birth'").select("rank"), "births")
    # The cluster of a component is its latest birth; the same halves carry births to later buckets.
    born = weights.where(F.col("weight") >= min_size).select(F.lit(0).cast("long").alias("g"), F.col("id").alias("node"), (-2 - F.col("id")).alias("born"))
    for found, low in levels:
        new = low.join(births, "rank").select((F.col("g") / 2).cast("long").alias("g"), F.col("a").alias("node"), F.col("rank").alias("born"))
        inside = born.unionByName(new).join(found.select("g", "node", "component"), ["g", "node"], "left")
        upper = inside.select((F.col("g") * 2 + 1).alias("g"), F.coalesce("component", "node").alias("node"), "born").groupBy("g", "node").agg(F.max("born").alias("born"))
        born = materialise(born.select((F.col("g") * 2).alias("g"), "node", "born").unionByName(upper), "born")
    for end in ("a", "b"):
        named = born.select("g", F.col("node").alias(end), F.col("born").alias(f"born_{end}"))
        sized = materialise(sized.join(named, ["g", end], "left"), "born_edges")
    events = materialise(sized.groupBy("bucket").applyInArrow(_follow(min_size), _EVENTS), "events")
    splits = events.where("kind = 'split'").select(F.col("other").alias("cluster"), F.col("cluster").alias("parent"), "w", "size")
    entries = events.where("kind = 'entry'").select(F.col("bucket").alias("g"), F.col("other").alias("node"), "cluster", "w")
    inside = lookup(points, entries, "g", "node").select("id", "cluster", "w")
    heavy = weights.where(F.col("weight") >= min_size).select("id", (-2 - F.col("id")).alias("cluster"), F.lit(0.0).alias("w"))
    return splits, inside.unionByName(heavy)


def choose(splits: DataFrame, places: DataFrame, weights: DataFrame, method: str) -> DataFrame:
    """``cluster, chosen``: the chosen cluster that each cluster of the tree lies in, if any.

    ``leaf``: clusters that do not split. ``eom``: those whose stability (the sum over points of the
    density at which they leave minus that at which the cluster begins) is not less than the sum of
    what was chosen below, as many rounds as the tree is high; a part's whole tree is chosen only if it
    does not split. Densities of points at distance 0 count as that of the least distance above 0.
    """
    if method not in ("leaf", "eom"):
        raise ValueError(f"method is leaf or eom, not {method}")
    tree = materialise(splits, "splits")
    parents = tree.select(F.col("parent").alias("cluster")).distinct()
    clusters = materialise(places.select("cluster").union(tree.select("cluster")).union(parents).distinct(), "clusters")
    if method == "leaf":
        picked = clusters.join(parents, "cluster", "left_anti")
        return picked.select("cluster", F.col("cluster").alias("chosen"))
    least = places.where("w > 0").select("w").union(tree.select("w")).agg(F.min("w").alias("least"))
    density = 1 / F.greatest("w", F.coalesce("least", F.lit(1.0)))  # one row is broadcast
    begins = clusters.join(tree.select("cluster", "parent", F.lit(1.0).alias("one"), "w"), "cluster", "left").crossJoin(F.broadcast(least)).select("cluster", "parent", F.coalesce(F.when(F.col("w").isNotNull(), density), F.lit(0.0)).alias("begin"))
    left = lookup(places, weights.select("id", "weight"), "id").select("cluster", "w", F.col("weight").alias("n"))
    left = left.unionByName(tree.select(F.col("parent").alias("cluster"), "w", F.col("size").alias("n"))).crossJoin(F.broadcast(least)).groupBy("cluster").agg(F.sum(F.col("n") * density).alias("mass"), F.sum("n").alias("n"))
    state = begins.join(left, "cluster").select("cluster", "parent", (F.col("mass") - F.col("n") * F.col("begin")).alias("own"))
    state = state.join(tree.groupBy(F.col("parent").alias("cluster")).agg(F.count("*").alias("waits")), "cluster", "left").withColumn("waits", F.coalesce("waits", F.lit(0)))
    state = materialise(state.withColumns({"below": F.lit(0.0), "taken": F.lit(None).cast("boolean")}), "stabilities")
    while True:
        ready = state.where("taken is null and waits = 0").select("cluster", "parent", ((F.col("own") >= F.col("below")) & F.col("parent").isNotNull() | (F.col("below") == 0)).alias("now"), F.greatest("own", "below").alias("value"))
        ready = materialise(ready, "decided")
        if ready.isEmpty():
            break
        given = ready.groupBy(F.col("parent").alias("cluster")).agg(F.count("*").alias("done"), F.sum("value").alias("more"))
        state = state.join(ready.select("cluster", "now"), "cluster", "left").join(given, "cluster", "left")
        state = materialise(state.select("cluster", "parent", "own", (F.col("waits") - F.coalesce("done", F.lit(0))).alias("waits"), (F.col("below") + F.coalesce("more", F.lit(0.0))).alias("below"), F.coalesce("taken", "now").alias("taken")), "stabilities")
    # The highest taken cluster at or above each: pointers stop at a taken cluster without a taken one above.
    up = state.select("cluster", "parent", "taken")
    top = _topmost(up)
    return top


def _topmost(tree: DataFrame) -> DataFrame:
    """``cluster, chosen`` from ``cluster, parent, taken``: pointers carry the highest taken cluster they pass."""
    now = materialise(tree.select("cluster", F.when(F.col("taken"), F.col("cluster")).alias("chosen"), F.col("parent").alias("up")), "carried")
    while not now.where("up is not null").isEmpty():
        above = now.select(F.col("cluster").alias("up"), F.col("chosen").alias("above"), F.col("up").alias("next"))
        now = materialise(now.where("up is null").select("cluster", "chosen", F.lit(None).cast("long").alias("up")).unionByName(lookup(now.where("up is not null"), above, "up").select("cluster", F.coalesce("above", "chosen").alias("chosen"), F.col("next").alias("up"))), "carried")
    return now.where("chosen is not null").select("cluster", "chosen")


def density_clusters(
    points: DataFrame, key: str, vector: str, *, min_size: int = 15, min_samples: int = 1, method: str = "leaf", noise_labels: bool = False, k: int = 15, trees: int = 16, leaf: int = 256, seed: int = 1
) -> DataFrame:
    """``key, label, probability`` for every row with a vector.

    Labels number the chosen clusters from 0 by their smallest key. Without ``noise_labels`` the label
    is that of the largest membership, which is the probability, and -2 where there is none. With them
    it is -1 outside of chosen clusters, and the probability is the density at which the point leaves
    its cluster over the largest of the cluster (0 for noise).
    """
    kinds, rows = neighbours.distinct_points(points, key, vector)
    graph = neighbours.neighbour_graph(kinds, k, trees=trees, leaf=leaf, seed=seed)
    found = cluster_graph(graph, kinds.select("id", "weight"), min_size=min_size, min_samples=min_samples, method=method, noise_labels=noise_labels)
    return lookup(materialise(rows, "row_ids"), found, "id").select(F.col("key").alias(key), "label", "probability")


def cluster_graph(graph: DataFrame, weights: DataFrame, *, min_size: int = 15, min_samples: int = 1, method: str = "leaf", noise_labels: bool = False) -> DataFrame:
    """``id, label, probability`` from a neighbour graph (``id, near``) and weights (``id, weight``)."""
    numbers = materialise(numbered(weights.select("id", "weight"), "id").select("id", "weight", F.col("rank").alias("no")), "numbers")
    edges = reachability(graph, weights, min_samples)
    edges = lookup(materialise(edges, "reachable"), numbers.select(F.col("id").alias("u"), F.col("no").alias("a")), "u")
    edges = lookup(materialise(edges, "half_numbered"), numbers.select(F.col("id").alias("v"), F.col("no").alias("b")), "v").select(F.col("a").alias("u"), F.col("b").alias("v"), "w")
    own = numbers.select(F.col("no").alias("id"), "weight")
    splits, places = hierarchy(materialise(minimum_forest(materialise(edges, "weighed_edges")), "forest"), own, min_size)
    places = materialise(places, "places")
    tops = materialise(choose(splits, places, own, method), "chosen")
    inside = materialise(lookup(places, tops, "cluster").select("id", "chosen", "w"), "inside")
    # A row for each chosen cluster; numbered by range sort.
    labels = numbered(inside.groupBy("chosen").agg(F.min("id").alias("first"), F.min(F.when(F.col("w") > 0, F.col("w"))).alias("least")), "first").select("chosen", F.col("rank").cast("int").alias("label"), "least")
    inside = materialise(lookup(inside, materialise(labels, "labels"), "chosen").select("id", "label", F.coalesce(F.col("least") / F.greatest("w", "least"), F.lit(1.0)).alias("strength")), "labelled")
    names = numbers.select("id", "no")
    if noise_labels:
        out = names.join(inside.withColumnRenamed("id", "no"), "no", "left")
        return out.select("id", F.coalesce("label", F.lit(-1)).alias("label"), F.coalesce("strength", F.lit(0.0)).alias("probability"))
    member = materialise(soft_membership(graph, names, inside), "membership")
    best = member.groupBy("id").agg(F.max(F.struct("membership", (-F.col("label")).alias("label"))).alias("x")).select("id", (-F.col("x.label")).alias("label"), F.col("x.membership").alias("probability"))
    return names.join(best, "id", "left").select("id", F.coalesce("label", F.lit(-2)).alias("label"), F.coalesce("probability", F.lit(0.0)).alias("probability"))


def soft_membership(graph: DataFrame, names: DataFrame, inside: DataFrame) -> DataFrame:
    """``id, label, membership``: at most one row for each point and label among its neighbours' and its own.

    A neighbour counts its strength over its distance, relative to the nearest; the point itself, if in a
    cluster, as one at the nearest distance. Shares are of all neighbours, so noise around a point lowers
    its membership.
    """
    held = materialise(names.join(inside.withColumnRenamed("id", "no"), "no").select("id", "label", "strength"), "held")
    near = graph.select("id", F.lit(1.0).alias("part"), F.col("id").alias("other")).unionByName(
        graph.select("id", F.explode("near").alias("e"), F.get("near", F.lit(0))["distance"].alias("least")).select("id", F.coalesce(F.try_divide("least", "e.distance"), F.lit(1.0)).alias("part"), F.col("e.id").alias("other"))
    )
    near = materialise(near, "parts")
    total = near.groupBy("id").agg(F.sum("part").alias("total"))
    shares = lookup(near, held.withColumnRenamed("id", "other"), "other").groupBy("id", "label").agg(F.sum(F.col("part") * F.col("strength")).alias("share"))
    return shares.join(total, "id").select("id", "label", (F.col("share") / F.col("total")).alias("membership"))
