"""The prefix trie against a plain one, on odd rows and beyond the broadcast bounds."""

import hashlib
import random
import zlib
from collections import defaultdict

import pytest

from farglass.llm import prefix_trie

SCHEMA = "conv_id long, turn long, role string, text string, name long, `a.b` string, _place string, depth string"


def plain_turns(rows):
    turns = defaultdict(list)
    for conv, turn, role, text in rows:
        if conv is not None:
            role, text = role or "", text or ""
            key = hashlib.sha256(f"{len(role.encode())}:{role}{text}".encode()).digest()
            turns[conv].append((turn is not None, turn or 0, role, key, text))
    return {c: [(t[2], t[4]) for t in sorted(ts)] for c, ts in turns.items()}


def plain_splice(turns):
    out = {}
    for c, own in turns.items():
        h = zlib.crc32(str(c).encode()) % 9
        base = c - (abs(c) % 5) * (1 if c >= 0 else -1)
        out[c] = turns.get(base, [])[:h] + own[h:]
    return out


def plain_trie(turns):
    members = defaultdict(list)
    for c, ts in turns.items():
        for d in range(len(ts) + 1):
            members[tuple(ts[:d])].append(c)
    children = defaultdict(int)
    for p in members:
        if p:
            children[p[:-1]] += 1
    leaves, saved = defaultdict(int), defaultdict(int)
    for p, cs in members.items():
        for k in range(len(p) + 1):
            leaves[p[:k]] += not children[p]
            saved[p[:k]] += (len(cs) - 1) * (len(p[-1][1].encode()) if p else 0)
    return sorted(
        (min(cs), len(p), -1 if not p else min(members[p[:-1]]), len(cs), children[p], leaves[p], saved[p], hashlib.sha256(",".join(str(c) for c in sorted(c for c in cs if len(turns[c]) == len(p))).encode()).hexdigest())
        for p, cs in members.items()
    )


def got(df):
    return sorted(tuple(-1 if v is None else v for v in r) for r in df.collect())


def frame(spark, rows):
    return spark.createDataFrame([(*r, 7, "x", "y", "z") for r in rows], SCHEMA)


def odd_rows():
    rng = random.Random(4)
    rows = []
    for c in range(-12, 60):
        for t in range(rng.choice([0, 1, 2, 3, 5, 9, 17, 33])):
            rows.append((c * 10_000_019 if c % 7 == 0 else c, rng.choice([t, t, None]), rng.choice(["user", "assistant", None, ""]), rng.choice(["a", "b", "", None, "é" * 3, "a,b"])))
    same = [(500 + i, t, "user", f"turn {t}") for i in range(40) for t in range(6)]  # a group of copies
    longer = [(900, t, "user", f"turn {t % 3}") for t in range(150)] + [(901, t, "user", f"turn {t % 3}") for t in range(149)]
    alone = [(1003, None, None, None), (None, 1, "user", "no conversation"), (1000, 5, "user", "long " * 30_000)]
    return rows + rows[:15] + same + longer + alone


def test_against_a_plain_trie(spark):
    rows = odd_rows()
    random.Random(1).shuffle(rows)
    table = frame(spark, rows)
    assert got(prefix_trie.spliced_trie(table)) == plain_trie(plain_splice(plain_turns(rows)))


def test_beyond_the_broadcast_bounds(spark, monkeypatch):
    import farglass.runtime as runtime

    monkeypatch.setattr(runtime, "BROADCAST_ROWS", 0)
    monkeypatch.setattr(runtime, "HOT_SHARE", 20)
    rows = [r for r in odd_rows() if r[0] is None or r[0] < 20 or r[0] > 400]
    assert got(prefix_trie.conversation_trie(frame(spark, rows))) == plain_trie(plain_turns(rows))


@pytest.mark.parametrize("rows", [[], [(None, 1, "user", "x")], [(4, None, None, None)], [(3, 1, "u", "x")]])
def test_least_tables(spark, rows):
    assert got(prefix_trie.spliced_trie(frame(spark, rows))) == plain_trie(plain_splice(plain_turns(rows)))


def test_digests_of_lists_in_pieces(spark):
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "7")
    try:
        rows = [(i % 3 if i % 2 else 1, i - 50) for i in range(300)]
        out = {r.name: r.ends_sha256 for r in prefix_trie.list_digests(spark.createDataFrame(rows, "name long, conv_id long")).collect()}
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
    assert out == {n: hashlib.sha256(",".join(str(c) for m, c in sorted(rows) if m == n).encode()).hexdigest() for n in (0, 1, 2)}
