"""SimHash near-duplicates by a positional byte index with count filtering.

A 64-bit fingerprint has eight positional bytes. Fingerprints that differ in at most four bits
differ in at most four bytes, so they share at least four: the guaranteed minimum. The index has a
list for every set of ``WIDTH`` positions and every value of the bytes there (one position alone
would give lists of 1/256 of all fingerprints). Two fingerprints that share the bytes of positions S
meet in the list of each WIDTH of them; every meeting is a hit that names its positions. Hits are
tallied per pair: the positions of all hits together are the shared ones. Pairs with fewer than the
minimum are dropped, and the rest is verified bit by bit.

Components, not pairs, are what duplicates need, and a group of thousands of near copies has
millions of pairs. So lists are first reduced by stars: each member is compared with its list's
smallest fingerprint, and links found make components. A list whose members are in one component by
then needs no more. In the others only members outside the list's largest component give hits, with
members of other components. No link between different components is lost: one of its ends is outside
the largest one, in every list of the pair, so its tally is whole. Lists that are crowded even so
(``CROWD``) are split by the bytes of further positions, up to the guaranteed minimum; a pair that
reaches it meets in the part for any such positions.

Nulls: a null text is an empty one; texts without words have fingerprint 0 and are linked like any
other. A null id counts as no id: it never names a component unless all ids of it are null (then it
is null). Repeated rows share a component. An empty table gives no rows. Other columns are ignored.
"""

from __future__ import annotations

from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from farglass.llm.columns import all_of, free_prefix, own
from farglass.operators import components
from farglass.runtime import checked_broadcast, materialise, split_join

BYTES = 8
WIDTH = 3
SEED = 42
#: A list with more pairs to compare is split by a further position's bytes.
CROWD = 16
#: Fingerprints to a task.
SPREAD = 10_000
#: Shingles of a text whose hashes are in hand at a time.
CHUNK = 1 << 15
PREFIX = "near_"


def fingerprint(text: str, shingle: int = 4, seed: int = SEED) -> int:
    """Majority SimHash of the XXH64 hashes of a text's word shingles, repeats included."""
    from xxhash import xxh64_intdigest as xxh

    words = text.encode().lower().split()  # bytes: lower() and split() know ASCII only
    if not words:
        return 0
    line = b" ".join(words)
    if len(words) <= shingle:
        return xxh(line, seed)
    lengths = np.fromiter(map(len, words), np.int64, len(words))
    ends = np.cumsum(lengths + 1) - 1
    starts = (ends - lengths)[: len(words) - shingle + 1]
    ends = ends[shingle - 1 :]
    counts = np.zeros(64, np.int64)
    for k in range(0, len(starts), CHUNK):
        counts += ones(np.array([xxh(line[a:b], seed) for a, b in zip(starts[k : k + CHUNK].tolist(), ends[k : k + CHUNK].tolist())], "<u8"))
    return majority(counts, len(starts))


def ones(hashes: np.ndarray) -> np.ndarray:
    """How many of the hashes set each bit."""
    return np.unpackbits(hashes.astype("<u8").view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)


def majority(counts: np.ndarray, n: int) -> int:
    """The bits that more than half of ``n`` hashes set."""
    return int(np.packbits(2 * counts > n, bitorder="little").view("<u8")[0])


def text_hash(text_col: str) -> Column:
    """What tells rows of one id apart."""
    return F.xxhash64(own(text_col))


def fingerprints(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", shingle: int = 4) -> DataFrame:
    """``own_id, text_hash, fp`` (XXH64 of the text as it is; the 64 bits as a signed long) for every row."""

    def compute(batches):
        for batch in batches:
            made = np.array([fingerprint(x or "", shingle) for x in batch.column(2).to_pylist()], np.uint64)
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(made.view(np.int64))], names=["own_id", "text_hash", "fp"])

    slim = docs.select(own(id_col).cast("long").alias("own_id"), text_hash(text_col).alias("text_hash"), own(text_col).alias("text"))
    return slim.mapInArrow(compute, "own_id long, text_hash long, fp long")


def covering(width: int = WIDTH) -> list[tuple[int, ...]]:
    """All sets of ``width`` byte positions."""
    return list(combinations(range(BYTES), width))


def _name(number: int, positions: tuple[int, ...]) -> Column:
    """A list's name: the number of its positions, then the bytes there."""
    name = F.lit(number).cast("long")
    for p in positions:
        name = F.shiftleft(name, 8).bitwiseOR(F.shiftrightunsigned("fp", 8 * p).bitwiseAND(255))
    return name


def _mask(width: int, name: Column) -> Column:
    """The positions of a list as a bit set."""
    masks = F.array(*(F.lit(sum(1 << p for p in c)) for c in covering(width)))
    return F.get(masks, F.shiftright(name, 8 * width).cast("int"))


def postings(nodes: DataFrame, width: int) -> DataFrame:
    """``list, fp``: each fingerprint in the lists of its bytes."""
    return nodes.select("fp", F.explode(F.array(*(_name(k, c) for k, c in enumerate(covering(width))))).alias("list"))


def _largest(placed: DataFrame) -> DataFrame:
    """``list, main, pairs`` of lists with several components: the one with most members, and how
    many pairs there are to compare."""
    held = placed.groupBy("list", "component").agg(F.count("*").alias("n"))
    largest = held.groupBy("list").agg(F.max(F.struct("n", "component")).alias("top"), F.sum("n").alias("members"), F.count("*").alias("parts"))
    return largest.where("parts > 1").select("list", F.col("top.component").alias("main"), ((F.col("members") - F.col("top.n")) * F.col("members")).alias("pairs"))


def _hits(mixed: DataFrame, width: int) -> DataFrame:
    """``u, v, mask``: meetings of members of different components, from ``list, fp, component, main``."""
    others = mixed.where("component <> main").select("list", F.col("fp").alias("u"), F.col("component").alias("cu"))
    everyone = mixed.select("list", F.col("fp").alias("v"), F.col("component").alias("cv"))
    met = others.join(everyone, "list").where("cu <> cv")
    return met.select(F.least("u", "v").alias("u"), F.greatest("u", "v").alias("v"), _mask(width, F.col("list")).alias("mask"))


def splitting(width: int, wider: int) -> list[tuple[int, ...]]:
    """The sets of ``width`` positions whose crowded lists must be split into parts of ``wider`` ones.

    Two fingerprints that share a set of one position more meet in all lists within it. Any two of these
    lists name all its positions, so its part is needed only if at most one of them is not crowded. Two of
    each such set are enough to split, then: one of the two is crowded.
    """
    kept = covering(width)
    if wider != width + 1:
        return kept
    around = {c: [q for q in covering(wider) if set(c) < set(q)] for c in kept}
    held = {q: wider for q in covering(wider)}
    for c in sorted(kept, key=lambda c: sum(c) % 7 != 1):  # this order leaves the fewest of those tried, 34 of 56
        if all(held[q] > 2 for q in around[c]):
            kept.remove(c)
            held |= {q: held[q] - 1 for q in around[c]}
    return kept


def _split(crowded: DataFrame, width: int, wider: int) -> DataFrame:
    """``list, fp, component`` in the parts of crowded lists: those of more positions around theirs."""
    base, numbers = F.col("base"), {c: k for k, c in enumerate(covering(width))}
    crowded = crowded.where(F.shiftright("list", 8 * width).isin([numbers[c] for c in splitting(width, wider)]))
    parts = [F.struct(_name(k, c).alias("list"), F.lit(sum(1 << p for p in c)).alias("mask")) for k, c in enumerate(covering(wider))]
    # Only the parts around the row's list are made rows, not one for each set of positions.
    around = F.filter(F.array(*parts), lambda p: p["mask"].bitwiseAND(base) == base)
    told = crowded.withColumn("base", _mask(width, F.col("list"))).select("fp", "component", F.explode(around).alias("part"))
    return told.select(F.col("part.list").alias("list"), "fp", "component").distinct()


def links(nodes: DataFrame, most: int = 4, width: int = WIDTH, crowd: int = CROWD) -> DataFrame:
    """Links ``u, v`` that connect what fingerprints within ``most`` bits connect."""
    least = BYTES - most
    if not 1 <= width <= least:
        raise ValueError(f"lists of {width} positions do not hold every pair that shares {least} bytes")

    def close(a: str, b: str) -> Column:
        return F.bit_count(F.col(a).bitwiseXOR(F.col(b))) <= most

    # Fingerprints are short rows that become many: a few files of them would leave cores idle.
    listed = postings(nodes.repartition(nodes.count() // SPREAD + 1), width)
    hubs = materialise(listed.groupBy("list").agg(F.min("fp").alias("hub"), F.count("*").alias("n")).where("n > 1").select("list", "hub"), "hubs")
    # Members of lists of two and more. Most lists have one member and end here.
    met = materialise(listed.join(checked_broadcast(hubs), "list").select("list", "fp", "hub"), "postings")
    stars = materialise(met.where(close("fp", "hub") & (F.col("fp") != F.col("hub"))).select(F.col("fp").alias("u"), F.col("hub").alias("v")).distinct(), "stars")
    comps = materialise(components.connected_components(stars), "star_components")
    placed = met.select("list", "fp").join(checked_broadcast(comps.withColumnsRenamed({"node": "fp"})), "fp", "left")
    placed = materialise(placed.select("list", "fp", F.coalesce("component", "fp").alias("component")), "placed")
    mixed = materialise(placed.join(_largest(placed), "list"), "mixed")
    hits = _hits(mixed.where(F.col("pairs") <= crowd), width)
    crowded = mixed.where(F.col("pairs") > crowd).select("list", "fp", "component")
    if width < least and not crowded.isEmpty():
        parts = materialise(_split(crowded, width, least), "parts")
        hits = hits.union(_hits(parts.join(_largest(parts), "list"), least))
    elif width == least:
        hits = _hits(mixed, width)
    tallied = hits.groupBy("u", "v").agg(F.bit_or("mask").alias("mask"))
    return stars.union(tallied.where((F.bit_count("mask") >= least) & close("u", "v")).select("u", "v"))


def name_components(rows: DataFrame, comps: DataFrame, node: str) -> DataFrame:
    """``rows (own_id, <node>, ..)`` with ``component`` (a node) and ``component_id`` (its smallest id)."""
    nodes = rows.groupBy(node).agg(F.min("own_id").alias("first_id"))
    grouped = nodes.join(comps.withColumnsRenamed({"node": node}), node, "left").select(node, "first_id", F.coalesce("component", node).alias("component"))
    grouped = materialise(grouped, "grouped")
    names = materialise(grouped.groupBy("component").agg(F.min("first_id").alias("component_id")), "component_names")
    named = materialise(split_join(grouped.select(node, "component"), names, "component"), "named")
    return split_join(rows, named, node)


def near_duplicates(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", shingle: int = 4, most: int = 4, width: int = WIDTH) -> DataFrame:
    """Rows ``<id_col>, text_hash, fp, component, component_id`` for every row of ``docs``."""
    prints = materialise(fingerprints(docs, id_col=id_col, text_col=text_col, shingle=shingle), "fingerprints")
    nodes = materialise(prints.select("fp").distinct(), "nodes")
    named = name_components(prints, components.connected_components(links(nodes, most, width)), "fp")
    return named.select(F.col("own_id").alias(id_col), "text_hash", "fp", "component", "component_id")


def keep_one(docs: DataFrame, found: DataFrame, *, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row of each component of ``found``, with the columns it had.

    It is the row with the smallest id (null ids come last), of rows with that id the one whose text
    has the smallest hash, and of repeated rows the one whose columns have (maps aside). Rows are
    told by id and text, so different texts under one id are judged apart.
    """
    p = free_prefix([*docs.columns, *found.columns], PREFIX)
    key = F.struct(F.col(id_col).isNull().alias("none"), F.col(id_col).alias("id"), F.col("text_hash").alias("hash"))
    counted = materialise(found.groupBy(key.alias("key"), "component").agg(F.count("*").alias("n")), "keys")
    first = materialise(counted.groupBy("component").agg(F.min("key").alias("key")), "first")
    gone = materialise(counted.select("key").join(first.select("key"), "key", "left_anti").select("key.id", "key.hash").toDF(f"{p}id", f"{p}hash"), "gone")
    twice = materialise(counted.where("n > 1").join(first.select("key"), "key", "left_semi").select("key.id", "key.hash").toDF(f"{p}id", f"{p}hash"), "twice")
    hashed = docs.withColumn(f"{p}text", text_hash(text_col))
    same = own(id_col).eqNullSafe(F.col(f"{p}id")) & (F.col(f"{p}text") == F.col(f"{p}hash"))
    kept = hashed.join(checked_broadcast(gone), same, "left_anti")
    if twice.isEmpty():
        return kept.select(*all_of(docs))
    small = checked_broadcast(twice)
    plain = [own(f.name) for f in docs.schema.fields if "map<" not in f.dataType.simpleString()]
    order = Window.partitionBy(own(id_col), f"{p}text").orderBy(F.xxhash64(*plain))
    once = kept.join(small, same, "left_semi").withColumn(f"{p}row", F.row_number().over(order)).where(F.col(f"{p}row") == 1)
    return kept.join(small, same, "left_anti").select(*all_of(docs)).union(once.select(*all_of(docs)))
