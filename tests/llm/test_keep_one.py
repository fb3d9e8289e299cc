"""Which row of a group of copies stays, and fingerprints of crowded lists and long texts."""

import random
from itertools import combinations

import numpy as np
from pyspark.sql import functions as F

from farglass.llm import simhash, similar
from test_near_and_pages import brute_components, brute_fingerprint

NAMES = ["near_id", "near_hash", "near_text", "near_row", "text_hash", "fp", "component", "component_id", "node", "own_id", "line", "n", "a.b"]
ONE = "this is the first of two texts that have one id but nothing else in common at all"
TWO = "quite other words stand here and none of them was seen in any other row before this"


def table(spark, rows):
    docs = spark.createDataFrame(rows, "doc_id long, text string, tag string")
    return docs.select("*", *(F.lit(f"own {n}").alias(n) for n in NAMES))


def kept(docs, finder):
    out = simhash.keep_one(docs, finder(docs))
    rows = out.collect()
    assert out.columns == docs.columns and all(r[n] == f"own {n}" for r in rows for n in NAMES)
    return sorted(((r.doc_id, r.text, r.tag) for r in rows), key=str)


def test_rows_are_told_by_id_and_text(spark):
    rows = [(5, ONE, "b"), (5, TWO, "a"), (5, ONE, "a"), (9, ONE, "c"), (None, ONE, "d"), (None, "alone without an id", "e"), (None, "alone without an id", "e"), (7, None, "f"), (8, "", "g"), (6, None, "f")]
    for finder in (simhash.near_duplicates, similar.near_duplicates):
        got = kept(table(spark, rows), finder)
        assert got == kept(table(spark, rows[::-1]).repartition(3), finder)  # in whatever order they come
        assert len(got) == 4 and sum(r[:2] == (5, ONE) for r in got) == 1
        assert {(5, TWO, "a"), (None, "alone without an id", "e"), (6, None, "f")} <= set(got)
        assert kept(table(spark, rows).limit(0), finder) == []


def test_beyond_the_broadcast_bounds(spark, monkeypatch):
    import farglass.runtime as runtime

    rng = random.Random(2)
    rows = [(rng.randint(0, 30), rng.choice([ONE, TWO, None, ONE + " more words of it", f"text number {rng.randint(0, 9)}"]), "x") for _ in range(120)]
    for finder in (simhash.near_duplicates, similar.near_duplicates):
        want = kept(table(spark, rows), finder)
        monkeypatch.setattr(runtime.checked_broadcast, "__defaults__", (None, 0))
        assert kept(table(spark, rows), finder) == want
        monkeypatch.undo()


def test_crowded_lists_are_split(spark):
    rng = random.Random(8)
    head = rng.getrandbits(24) << 40
    prints = {head | rng.getrandbits(40) for _ in range(150)}  # all share three bytes, few four
    for p in list(prints)[:20]:
        q = p
        for b in rng.sample(range(40), rng.randint(3, 5)):
            q ^= 1 << b
        prints.add(q)
    signed = {p: int(np.uint64(p).view(np.int64)) for p in prints}
    want = brute_components(signed.values(), [(signed[a], signed[b]) for a, b in combinations(prints, 2) if (a ^ b).bit_count() <= 4])
    nodes = spark.createDataFrame([(x,) for x in signed.values()], "fp long")
    for width, crowd in ((3, 4), (2, 4), (4, 4), (1, 100), (3, 10**9)):
        assert brute_components(signed.values(), [tuple(r) for r in simhash.links(nodes, 4, width, crowd).collect()]) == want
    for most in (2, 3, 5):
        want = brute_components(signed.values(), [(signed[a], signed[b]) for a, b in combinations(prints, 2) if (a ^ b).bit_count() <= most])
        assert brute_components(signed.values(), [tuple(r) for r in simhash.links(nodes, most, 2, 4).collect()]) == want


def test_fingerprint_in_chunks(monkeypatch):
    rng = random.Random(1)
    text = " ".join(rng.choice(["a", "B", "é", "word", "x9"]) for _ in range(300))
    monkeypatch.setattr(simhash, "CHUNK", 7)
    assert simhash.fingerprint(text) == brute_fingerprint(text)
    monkeypatch.undo()
    assert simhash.fingerprint("some words " * 200_000) == simhash.fingerprint("some words " * 200_000)


def test_the_tally_counts_shared_positions(spark):
    """Pairs that meet in a list but share three bytes only give no link, whatever their bits."""
    base = 0x1122334455667788
    three = base ^ 0x0101010101 << 24  # five bytes differ by a bit each: five bits, three shared bytes
    four = base ^ 0x01010101 << 32
    nodes = spark.createDataFrame([(int(np.uint64(x).view(np.int64)),) for x in (base, three, four)], "fp long")
    got = {frozenset(int(np.int64(x).view(np.uint64)) for x in r) for r in simhash.links(nodes).collect()}
    assert frozenset((base, four)) in got and frozenset((base, three)) not in got
    listed = simhash.postings(nodes, 3).collect()
    assert len(listed) == 3 * 56 and len({r.list for r in listed}) < 3 * 56
