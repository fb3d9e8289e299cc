"""Near-duplicates by the Jaccard similarity of word shingles: candidates by SimHash, lists by MinHash for
what its fingerprints miss, then an exact test.

Each set of shingles has a SimHash fingerprint. Equal fingerprints and those that ``simhash.links`` finds
near (its byte index with count filtering) are candidates; those that pass the exact test make the first
components. Fingerprints miss pairs of similar sets, so MinHash lists bring together the rest.

Texts with the same words are one node from the start. ``BANDS`` lists of ``ROWS`` least hashes each
bring nodes together: two nodes of similarity s miss each other in all lists with a chance of
(1 - s^ROWS)^BANDS, 3 in a million at 0.8 and less above. What meets is only a candidate; it is
linked if the shingle sets themselves are similar enough, counted in integers.

A shingle that no other text has is shared with nobody, so what a node can share at most is the number
of its other shingles. Two nodes whose numbers fall short of the similarity asked for are no candidates:
an exact bound, which needs no set. Another is the parity of a set's hashes in ``PARITY`` bins: what two
sets do not share is at least the number of bins in which their parities differ. In a group of copies
with changes of their own the two leave those whose changes are few.

As in ``simhash``, lists are first reduced by stars: members are compared with their list's hub, and
links found make components. The first hub is the member with the smallest part of shingles of its
own, which of copies is the original or next to it. Another round with other hubs follows; after it,
members outside their list's largest component are compared with the list's members of other
components, so no candidate that could still join two components is left out.

Nulls: a null text is an empty one; texts without words share a component. A null id never names a
component unless all ids of it are null. Repeated rows share a component. An empty table gives no
rows. Words, like shingles, are told apart by 64-bit hashes.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from farglass.llm import simhash
from farglass.llm.columns import own
from farglass.llm.simhash import SEED, name_components, text_hash
from farglass.operators import components
from farglass.runtime import checked_broadcast, materialise

BANDS = 32
ROWS = 5
STAR_ROUNDS = 2
#: Longs of 64 bins each.
PARITY = 4
#: Shingles whose hashes are permuted at once.
CHUNK = 2048
_random = np.random.default_rng(SEED)
_FACTORS = _random.integers(0, 1 << 63, (BANDS * ROWS, 1), np.uint64) * np.uint64(2) + np.uint64(1)
_OFFSETS = _random.integers(0, 1 << 63, (BANDS * ROWS, 1), np.uint64)


def line(text: Column) -> Column:
    """Lower-case words with single spaces between them; case and white space are ASCII's."""
    low = F.translate(F.coalesce(text, F.lit("")), "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    return F.trim(F.regexp_replace(low, r"[ \t\n\x0B\f\r]+", " "))


def shingles(words: str, shingle: int = 5) -> np.ndarray:
    """The distinct XXH64 hashes of a line's word shingles; a shorter line is one shingle."""
    from xxhash import xxh64_intdigest as xxh

    if not words:
        return np.zeros(0, np.uint64)
    data = words.encode()
    parts = data.split(b" ")
    if len(parts) <= shingle:
        return np.array([xxh(data, SEED)], np.uint64)
    lengths = np.fromiter(map(len, parts), np.int64, len(parts))
    ends = np.cumsum(lengths + 1) - 1
    starts = (ends - lengths)[: len(parts) - shingle + 1].tolist()
    return np.unique(np.array([xxh(data[a:b], SEED) for a, b in zip(starts, ends[shingle - 1 :].tolist())], np.uint64))


def bands(hashes: np.ndarray) -> np.ndarray:
    """One 64-bit name of a list for each band; the band's number goes into it."""
    least = np.full(BANDS * ROWS, np.iinfo(np.uint64).max, np.uint64)
    for k in range(0, len(hashes), CHUNK):
        np.minimum(least, (_FACTORS * hashes[k : k + CHUNK] + _OFFSETS).min(axis=1), out=least)
    name = np.arange(BANDS, dtype=np.uint64)
    for row in least.reshape(BANDS, ROWS).T:
        name = (name ^ row) * np.uint64(0x9E3779B97F4A7C15)
        name ^= name >> np.uint64(29)
    return name


def parity(hashes: np.ndarray) -> np.ndarray:
    """For each bin whether it holds an odd number of hashes, 64 bins to a long."""
    odd = np.bincount((hashes % np.uint64(64 * PARITY)).astype(np.int64), minlength=64 * PARITY) & 1
    return np.packbits(odd.astype(np.uint8), bitorder="little").view("<i8")


def print_of(hashes: np.ndarray) -> int:
    """The SimHash fingerprint of a set of hashes."""
    return simhash.majority(sum((simhash.ones(hashes[k : k + CHUNK]) for k in range(0, len(hashes), CHUNK)), np.zeros(64, np.int64)), len(hashes))


def near_prints(prints: DataFrame) -> DataFrame:
    """Candidates ``u, v`` for ``node, fp``: nodes of one fingerprint, and of near ones as ``simhash.links``
    connects them, by the smallest node of each."""
    first = materialise(prints.groupBy("fp").agg(F.min("node").alias("first")), "first_nodes")
    same = prints.join(first, "fp").where("node <> first").select(F.col("node").alias("u"), F.col("first").alias("v"))
    near = simhash.links(first.select("fp"))
    for end in "uv":
        near = near.join(first.select(F.col("fp").alias(end), F.col("first").alias(f"first_{end}")), end)
    return same.union(near.select("first_u", "first_v"))


def signatures(lines: DataFrame, shingle: int) -> DataFrame:
    """``node, n, bands, parity, fp`` for ``node, line``: the number of shingles, the names of the lists,
    the parities, the fingerprint."""

    def compute(batches):
        for batch in batches:
            made = [shingles(x, shingle) for x in batch.column(1).to_pylist()]
            names = pa.array([bands(x).view(np.int64) for x in made], pa.list_(pa.int64()))
            odd = pa.array([parity(x) for x in made], pa.list_(pa.int64()))
            prints = pa.array(np.array([print_of(x) for x in made], np.uint64).view(np.int64))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(list(map(len, made)), pa.int32()), names, odd, prints], names=["node", "n", "bands", "parity", "fp"])

    return lines.mapInArrow(compute, "node long, n int, bands array<long>, parity array<long>, fp long")


def sets(lines: DataFrame, shingle: int) -> DataFrame:
    """``node, hashes`` for ``node, line``."""

    def compute(batches):
        for batch in batches:
            made = pa.array([shingles(x, shingle).view(np.int64) for x in batch.column(1).to_pylist()], pa.list_(pa.int64()))
            yield pa.RecordBatch.from_arrays([batch.column(0), made], names=["node", "hashes"])

    return lines.mapInArrow(compute, "node long, hashes array<long>")


def similar(pairs: DataFrame, held: DataFrame, share: tuple[int, int]) -> DataFrame:
    """Those of the pairs ``u, v`` whose sets share at least ``share`` of their union."""
    one, other = (held.select(F.col("node").alias(x), F.col("hashes").alias(f"of_{x}")) for x in "uv")
    common, total = F.size(F.array_intersect("of_u", "of_v")), F.size("of_u") + F.size("of_v")
    return pairs.join(one, "u").join(other, "v").where(common * sum(share) >= total * share[0]).select("u", "v")


def alone(held: DataFrame) -> DataFrame:
    """``node, alone``: how many of a set's hashes no other set has; nodes without any are left out."""
    once = held.select("node", F.explode("hashes").alias("h")).groupBy("h").agg(F.count("*").alias("n"), F.min("node").alias("node")).where("n = 1")
    return once.groupBy("node").agg(F.count("*").cast("int").alias("alone"))


def links(met: DataFrame, held: DataFrame, odd: DataFrame, share: tuple[int, int] = (4, 5), known: DataFrame | None = None) -> DataFrame:
    """Links ``u, v`` that connect what similar members of the lists ``list, node, n`` connect;
    ``odd`` has ``node, parity``. Links ``known`` before are among the result, and what they connect is
    not compared."""
    key = ["list"]
    # Sets of a and b that share s have a similarity of s / (a + b - s).
    fits = F.least("cu", "cv") * sum(share) >= (F.col("nu") + F.col("nv")) * share[0]
    apart = sum((F.bit_count(F.get("pu", F.lit(k)).bitwiseXOR(F.get("pv", F.lit(k)))) for k in range(PARITY)), F.lit(0))
    near = apart * sum(share) <= (F.col("nu") + F.col("nv")) * (share[1] - share[0])
    met = met.join(checked_broadcast(materialise(alone(held), "alone")), "node", "left").withColumn("common", F.col("n") - F.coalesce("alone", F.lit(0))).drop("alone")
    met = materialise(met, "bounded")
    found, placed = known, met.withColumn("component", F.col("node"))
    if known is not None:
        comps = materialise(components.connected_components(known), "known_components").withColumnsRenamed({"component": "joined"})
        placed = materialise(met.join(checked_broadcast(comps), "node", "left").select(*key, "node", "n", "common", F.coalesce("joined", "node").alias("component")), "placed")
    for turn in range(STAR_ROUNDS + 1):
        held_by = placed.groupBy(*key, "component").agg(F.count("*").alias("n"), F.min(F.struct((-F.col("common") / F.greatest("n", F.lit(1)) if turn == 0 else F.xxhash64("node", F.lit(turn))).alias("h"), "node", F.col("n").alias("size"), "common")).alias("hub"), F.min("n").alias("least"))
        mixed = held_by.groupBy(*key).agg(F.max(F.struct("n", "component"))["component"].alias("main"), F.min("hub").alias("hub"), F.min("least").alias("least"), F.count("*").alias("parts")).where("parts > 1")
        mixed = materialise(mixed.select(*key, "main", "least", F.col("hub.node").alias("hub"), F.col("hub.size").alias("hub_n"), F.col("hub.common").alias("hub_common")), "mixed")
        if mixed.isEmpty():
            break
        # Members that can be similar to no size of set in their list go.
        members = placed.join(mixed, key).where(F.col("common") * sum(share) >= (F.col("n") + F.col("least")) * share[0])
        if turn < STAR_ROUNDS:
            hubs = placed.select(F.col("node").alias("hub"), F.col("component").alias("hub_component")).distinct()
            pairs = members.where("node <> hub").select(F.col("node").alias("u"), F.col("hub").alias("v"), F.col("n").alias("nu"), F.col("hub_n").alias("nv"), F.col("common").alias("cu"), F.col("hub_common").alias("cv"), "component")
            pairs = pairs.where(fits).select("u", "v", "component").distinct().join(hubs.withColumnRenamed("hub", "v"), "v").where("component <> hub_component").select("u", "v")
        else:
            members = materialise(members.join(checked_broadcast(odd), "node"), "members")
            others = members.where("component <> main").select(*key, F.col("node").alias("u"), F.col("n").alias("nu"), F.col("common").alias("cu"), F.col("parity").alias("pu"), F.col("component").alias("one"))
            everyone = members.select(*key, F.col("node").alias("v"), F.col("n").alias("nv"), F.col("common").alias("cv"), F.col("parity").alias("pv"), F.col("component").alias("other"))
            pairs = others.join(everyone, key).where((F.col("one") != F.col("other")) & fits & near).select(F.least("u", "v").alias("u"), F.greatest("u", "v").alias("v")).distinct()
        made = materialise(similar(pairs, held, share), "similar")
        found = made if found is None else found.union(made)
        if turn < STAR_ROUNDS:
            comps = materialise(components.connected_components(found), "star_components")
            comps = checked_broadcast(comps.withColumnsRenamed({"component": "joined"}))
            placed = materialise(met.join(comps, "node", "left").select(*key, "node", "n", "common", F.coalesce("joined", "node").alias("component")), "placed")
    return met.select(F.col("node").alias("u"), F.col("node").alias("v")).limit(0) if found is None else found


def near_duplicates(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", shingle: int = 5, share: tuple[int, int] = (4, 5)) -> DataFrame:
    """Rows ``<id_col>, text_hash, node, component, component_id`` for every row of ``docs``; ``share``
    is the least similarity."""
    lines = docs.select(own(id_col).cast("long").alias("own_id"), text_hash(text_col).alias("text_hash"), line(own(text_col)).alias("line"))
    lines = lines.select("own_id", "text_hash", F.xxhash64("line").alias("node"), "line")
    rows = materialise(lines.select("own_id", "text_hash", "node"), "rows")
    marks = materialise(signatures(lines.select("node", "line"), shingle), "signatures")
    # Copies go before their lists are opened, and of the lists only those with two members go on.
    once = materialise(marks.groupBy("node").agg(F.first("n").alias("n"), F.first("bands").alias("bands"), F.first("parity").alias("parity"), F.first("fp").alias("fp")), "distinct_signatures")
    listed = once.select("node", "n", F.explode("bands").alias("list"))
    shared = materialise(listed.groupBy("list").agg(F.count("*").alias("members")).where("members > 1").select("list"), "shared_lists")
    met = materialise(listed.join(checked_broadcast(shared), "list"), "met")
    asked = materialise(near_prints(once.select("node", "fp")), "near_prints")
    wanted = materialise(met.select("node").union(asked.select("u")).union(asked.select("v")).distinct(), "wanted")
    texts = lines.select("node", "line").join(checked_broadcast(wanted), "node", "left_semi").groupBy("node").agg(F.first("line").alias("line"))
    held = materialise(sets(texts, shingle), "sets")
    odd = materialise(once.select("node", "parity").join(checked_broadcast(wanted), "node", "left_semi"), "parities")
    known = materialise(similar(asked, held, share), "similar_prints")
    named = name_components(rows, components.connected_components(links(met, held, odd, share, known)), "node")
    return named.select(F.col("own_id").alias(id_col), "text_hash", "node", "component", "component_id")
