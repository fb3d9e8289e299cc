"""Prefix trie of conversations by prefix doubling.

A conversation's turns get dense names. Blocks of two, four, eight turns, aligned to their length, are
named from the names of their halves, so a conversation of n turns takes about log2(n) join rounds,
whatever it shares with others. A prefix of d turns is named by the binary digits of d: that of the
higher digits first, then one more block. Equal prefixes have equal names, so a node of the trie is a
group of rows with one name.

Blocks are named in the order of their halves (a missing half first), so the name of the block that
holds a whole conversation is its rank among all sequences, and the members of a node are a run of
ranks. Sums over subtrees are then differences of prefix sums in the order (first rank, depth), and no
step walks up or down the trie.

Defined results: null roles and texts are empty; turns with a null number come first, those with equal
numbers in the order of role and digest; repeated turns are turns. Rows without ``conv_id`` belong to
no conversation and are left out. An empty table has no nodes, not even a root. Turns are compared by
SHA-256 of role and text. A conversation may hold any part of the rows: no step groups by conversation
alone without sums that are formed before the shuffle.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from farglass.runtime import lookup, materialise, numbered

#: Name of the root; other prefixes have larger ones.
ROOT = 0
NOTHING = hashlib.sha256(b"").hexdigest()


def _part() -> Column:
    """The partition's number, which is in the upper bits of ``_place``."""
    return F.shiftright("_place", 33)


def numbered_turns(conversations: DataFrame) -> DataFrame:
    """``conv_id, pos`` (from 0), ``turn_key`` (digest of role and text) and ``n_bytes`` of the text.

    Rows are sorted by range, so one conversation may spread over many tasks; a turn's place is its
    place in its partition plus the conversation's rows in the partitions before.
    """
    role, text = F.coalesce(F.col("role").cast("string"), F.lit("")), F.coalesce(F.col("text").cast("string"), F.lit(""))
    turns = conversations.where(F.col("conv_id").isNotNull()).select(
        F.col("conv_id").cast("long").alias("conv_id"),
        "turn",
        role.alias("role"),
        F.unhex(F.sha2(F.concat(F.octet_length(role).cast("string"), F.lit(":"), role, text), 256)).alias("turn_key"),
        F.octet_length(text).cast("long").alias("n_bytes"),
    )
    order = (F.col("conv_id"), F.col("turn").asc_nulls_first(), F.col("role"), F.col("turn_key"))
    ordered = materialise(turns.repartitionByRange(*order).sortWithinPartitions(*order).drop("turn", "role").withColumn("_place", F.monotonically_increasing_id()), "ordered_turns")
    ordered = ordered.withColumn("_part", _part())
    runs = ordered.groupBy("conv_id", "_part").agg(F.min("_place").alias("_first"), F.count("*").alias("n"))
    # A row for each conversation and partition that has it.
    before = F.sum("n").over(Window.partitionBy("conv_id").orderBy("_part")) - F.col("n")
    shifts = runs.select("conv_id", "_part", (before - F.col("_first")).alias("_shift"))
    return ordered.join(shifts, ["conv_id", "_part"]).select("conv_id", (F.col("_place") + F.col("_shift")).alias("pos"), "turn_key", "n_bytes")


def lengths(turns: DataFrame) -> DataFrame:
    return turns.groupBy("conv_id").agg(F.count("*").alias("length"))


def splice(turns: DataFrame, step: int = 5, modulus: int = 9) -> tuple[DataFrame, DataFrame]:
    """Conversations that begin with turns of another: ``turns`` and ``lengths`` of the rebuilt ones.

    Conversation c takes the first h turns of conversation c - c % step, where h is the CRC-32 of c's
    decimal digits modulo ``modulus``, then its own turns after its first h.
    """
    own = lengths(turns)
    plan = own.select("conv_id", "length", (F.crc32(F.col("conv_id").cast("string")) % modulus).alias("h"), (F.col("conv_id") - F.col("conv_id") % step).alias("base"))
    plan = plan.join(own.select(F.col("conv_id").alias("base"), F.col("length").alias("there")), "base", "left")
    plan = materialise(plan.withColumn("taken", F.least("h", F.coalesce("there", F.lit(0)))), "splices")
    kept = lookup(turns.where(F.col("pos") >= 0), plan.select("conv_id", "h", "taken"), "conv_id").where(F.col("pos") >= F.col("h"))
    kept = kept.select("conv_id", (F.col("pos") - F.col("h") + F.col("taken")).alias("pos"), "turn_key", "n_bytes")
    # A base gives fewer than ``modulus`` turns to each of the few conversations that begin with it.
    given = turns.where(F.col("pos") < modulus - 1).withColumnRenamed("conv_id", "base").join(plan.select("base", "conv_id", "taken"), "base")
    given = given.where(F.col("pos") < F.col("taken")).select("conv_id", "pos", "turn_key", "n_bytes")
    sizes = plan.select("conv_id", (F.col("taken") + F.greatest(F.col("length") - F.col("h"), F.lit(0))).alias("length"))
    return materialise(kept.unionByName(given), "spliced"), sizes


def _named(rows: DataFrame, *keys: str, ordered: bool = False) -> tuple[DataFrame, int]:
    """``rows`` with ``name``, dense from 0 and equal where the keys are equal; and how many names there
    are. Copies are counted before anything moves, and names that many rows have are broadcast."""
    found = numbered(rows.select(*keys).distinct(), *(keys if ordered else ()))
    names = found.select(*keys, F.col("rank").alias("name"))
    n = names.count()
    return lookup(rows, names, *keys, rows=n), n


def block_names(turns: DataFrame, longest: int) -> list[DataFrame]:
    """Level j: ``conv_id, k, name, whole`` for turns k * 2**j and on; the last block of a conversation
    may lack turns, then it is not ``whole``. Levels go on until one block holds any conversation."""
    named, _ = _named(turns.select("conv_id", F.col("pos").alias("k"), "turn_key"), "turn_key")
    levels = [materialise(named.select("conv_id", "k", "name", F.lit(True).alias("whole")), "blocks_0")]
    while (1 << (len(levels) - 1)) < longest:
        second = F.col("k").bitwiseAND(1) == 1
        halves = levels[-1].groupBy("conv_id", F.shiftright("k", 1).alias("k")).agg(
            F.max(F.when(~second, F.col("name"))).alias("left"),
            F.coalesce(F.max(F.when(second, F.col("name"))), F.lit(-1)).alias("right"),
            F.coalesce(F.max(F.when(second, F.col("whole"))), F.lit(False)).alias("whole"),
        )
        named, _ = _named(materialise(halves, "halves"), "left", "right", ordered=True)
        levels.append(materialise(named.select("conv_id", "k", "name", "whole"), f"blocks_{len(levels)}"))
    return levels


def prefix_names(levels: list[DataFrame], sizes: DataFrame) -> DataFrame:
    """``conv_id, depth, name`` for every prefix, the empty one included.

    A prefix whose length ends in the binary digits 1 0...0 (j zeros) is one block of level j after
    the prefix without that digit, which an earlier round has named.
    """
    prefixes, names = sizes.select("conv_id", F.lit(0).cast("long").alias("depth"), F.lit(ROOT).cast("long").alias("name")), ROOT + 1
    for j in range(len(levels) - 1, -1, -1):
        blocks = levels[j].where(F.col("whole") & (F.col("k").bitwiseAND(1) == 0)).select("conv_id", F.shiftleft("k", j).alias("depth"), F.col("name").alias("block"))
        pairs = materialise(prefixes.withColumnRenamed("name", "before").join(blocks, ["conv_id", "depth"]), "pairs")
        named, n = _named(pairs, "before", "block")
        longer = materialise(named.select("conv_id", (F.col("depth") + (1 << j)).alias("depth"), (F.col("name") + names).alias("name")), f"prefixes_{j}")
        prefixes, names = prefixes.unionByName(longer), names + n
    return prefixes


def _cut(batches: Iterator) -> Iterator:
    """A batch's ids of each node as one string; rows come sorted by (name, conv_id)."""
    import numpy as np
    import pyarrow as pa
    from pyspark import TaskContext

    part, n = TaskContext.get().partitionId(), 0
    for batch in batches:
        names, ids = batch.column(0).to_numpy(), batch.column(1).to_pylist()
        starts = np.flatnonzero(np.r_[True, names[1:] != names[:-1]]) if len(ids) else []
        ends = [*starts[1:], len(ids)]
        pieces = [",".join(map(str, ids[a:b])) for a, b in zip(starts, ends, strict=False)]
        yield pa.RecordBatch.from_pydict({"name": names[starts] if len(ids) else [], "part": [part] * len(pieces), "n": list(range(n, n + len(pieces))), "piece": pieces}, schema=pa.schema([("name", pa.int64()), ("part", pa.int32()), ("n", pa.int64()), ("piece", pa.string())]))
        n += len(pieces)


def _fold(batches: Iterator) -> Iterator:
    """SHA-256 of each node's pieces, which come in order; one piece is held at a time."""
    import pyarrow as pa

    schema, name, digest = pa.schema([("name", pa.int64()), ("ends_sha256", pa.string())]), None, None
    for batch in batches:
        done: list[tuple] = []
        for own, piece in zip(batch.column(0).to_pylist(), batch.column(3).to_pylist(), strict=True):
            if own != name:
                if digest:
                    done.append((name, digest.hexdigest()))
                name, digest = own, hashlib.sha256()
                digest.update(piece.encode())
            else:
                digest.update(b"," + piece.encode())
        yield pa.RecordBatch.from_pydict({"name": [x[0] for x in done], "ends_sha256": [x[1] for x in done]}, schema=schema)
    if digest:
        yield pa.RecordBatch.from_pydict({"name": [name], "ends_sha256": [digest.hexdigest()]}, schema=schema)


def list_digests(ends: DataFrame) -> DataFrame:
    """``name, ends_sha256``: SHA-256 of each name's ids, ascending and joined by commas.

    A digest of one list is sequential, so its pieces meet in one task; but ids are joined to pieces
    of a batch each where they were sorted, and the last task streams them.
    """
    order = ("name", "conv_id")
    pieces = ends.select(*order).repartitionByRange(*order).sortWithinPartitions(*order).mapInArrow(_cut, "name long, part int, n long, piece string")
    return pieces.repartition("name").sortWithinPartitions("name", "part", "n").mapInArrow(_fold, "name long, ends_sha256 string")


def _subtree_sums(nodes: DataFrame, *values: str) -> DataFrame:
    """``nodes`` with each of ``values`` (not negative) replaced by its sum over the node's subtree.

    In the order (first, depth) a subtree is a run that ends with the last node whose ``first`` is
    ``last``; so a sum is the difference of two prefix sums.
    """
    ordered = materialise(nodes.repartitionByRange("first", "depth").sortWithinPartitions("first", "depth").withColumn("_place", F.monotonically_increasing_id()), "preorder")
    ordered = ordered.withColumn("_part", _part())
    totals = ordered.groupBy("_part").agg(*(F.sum(v).alias(v) for v in values))
    # A row for each partition.
    earlier = Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    bases = totals.select("_part", *(F.coalesce(F.sum(v).over(earlier), F.lit(0)).alias(f"_base_{v}") for v in values))
    up_to = Window.partitionBy("_part").orderBy("_place").rowsBetween(Window.unboundedPreceding, 0)
    summed = ordered.withColumns({f"_to_{v}": F.sum(v).over(up_to) for v in values}).join(F.broadcast(bases), "_part")
    summed = materialise(summed.withColumns({f"_to_{v}": F.col(f"_to_{v}") + F.col(f"_base_{v}") for v in values}), "prefix_sums")
    ends = summed.groupBy(F.col("first").alias("last")).agg(*(F.max(f"_to_{v}").alias(f"_end_{v}") for v in values))
    return lookup(summed, ends, "last").select(*(c for c in nodes.columns if c not in values), *((F.col(f"_end_{v}") - F.col(f"_to_{v}") + F.col(v)).alias(v) for v in values))


def trie(turns: DataFrame, sizes: DataFrame) -> DataFrame:
    """A row for each node: ``conv_id`` (smallest member), ``depth, parent_conv_id, n_convs, n_children,
    n_leaves, saved_tokens, ends_sha256``.

    ``turns``: ``conv_id, pos, turn_key, n_bytes``; ``sizes``: ``conv_id, length``, with conversations
    of no turns too. Both are read several times and should be materialised.
    """
    longest = sizes.agg(F.max("length")).first()[0] or 0
    levels = block_names(turns, longest) if longest else []
    prefixes = materialise(prefix_names(levels, sizes), "prefixes")
    ranks = levels[-1].select("conv_id", F.col("name").alias("rank")) if longest else sizes.select("conv_id", F.lit(-1).cast("long").alias("rank"))
    about = materialise(sizes.join(ranks, "conv_id", "left").select("conv_id", "length", F.coalesce("rank", F.lit(-1)).alias("rank")), "ranks")
    members = lookup(prefixes, about, "conv_id")
    nodes = members.groupBy("name").agg(F.min("conv_id").alias("conv_id"), F.min("depth").alias("depth"), F.count("*").alias("n_convs"), F.min("rank").alias("first"), F.max("rank").alias("last"))
    steps = prefixes.withColumnsRenamed({"name": "parent", "depth": "pos"}).join(turns.select("conv_id", "pos", "n_bytes"), ["conv_id", "pos"])
    nodes = nodes.join(steps.withColumn("depth", F.col("pos") + 1).drop("pos"), ["conv_id", "depth"], "left")
    nodes = materialise(nodes.select("name", "conv_id", "depth", "n_convs", "first", "last", F.coalesce("parent", F.lit(-1)).alias("parent"), F.coalesce("n_bytes", F.lit(0)).alias("n_bytes")), "nodes")
    children = nodes.groupBy(F.col("parent").alias("name")).agg(F.count("*").alias("n_children"))
    ends = list_digests(members.where(F.col("depth") == F.col("length")))
    nodes = nodes.join(children, "name", "left").join(ends, "name", "left")
    nodes = nodes.withColumns({"n_children": F.coalesce("n_children", F.lit(0)), "ends_sha256": F.coalesce("ends_sha256", F.lit(NOTHING))})
    nodes = nodes.withColumns({"n_leaves": (F.col("n_children") == 0).cast("long"), "saved_tokens": (F.col("n_convs") - 1) * F.col("n_bytes")})
    nodes = materialise(_subtree_sums(nodes, "n_leaves", "saved_tokens"), "summed_nodes")
    owners = nodes.select(F.col("name").alias("parent"), F.col("conv_id").alias("parent_conv_id"))
    owners = owners.union(nodes.where(F.col("name") == ROOT).select(F.lit(-1).cast("long"), F.lit(None).cast("long")))
    return lookup(nodes, owners, "parent").select("conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256")


def conversation_trie(conversations: DataFrame) -> DataFrame:
    """The trie of the conversations as they are (``conv_id, turn, role, text``; more columns are ignored)."""
    turns = materialise(numbered_turns(conversations), "turns")
    return trie(turns, materialise(lengths(turns), "lengths"))


def spliced_trie(conversations: DataFrame) -> DataFrame:
    """The trie of the conversations that ``splice`` makes."""
    turns, sizes = splice(materialise(numbered_turns(conversations), "turns"))
    return trie(turns, sizes)
