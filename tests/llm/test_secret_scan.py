"""Secret scans: candidates against plain matching, and what ownership decides."""

import hashlib
import random
import re

import duckdb

from farglass.llm import queries, secret_scan
from farglass.llm.sql import SECRETS
from pyspark.sql import functions as F

SCHEMA = "doc_id long, text string, source string, secret_found string, row string, `a.b` string"
RANDOM = "Zk3" + "aB9xQ7rT2mN4vC6wE8pL"


def hexes(n, seed):
    rng = random.Random(seed)
    return "".join(rng.choice("0123456789abcdef") for _ in range(n))


def texts():
    rng = random.Random(5)
    parts = [
        'token = "' + hexes(40, 1) + '"', "password: short", "PassWord='longenough1'", "api_key=" + hexes(33, 2), "apikey : token: abcdefgh12345", "secret==abcdefgh", "AKIA" + "A1B2C3D4E5F6", "AKIASHORT", hexes(31, 3), hexes(32, 4) + "G", "xAKIAAKIA" + "Q" * 20,
        "ghp_" + RANDOM * 2, "https://user:hunter22x@host/path", RANDOM + RANDOM, RANDOM.lower() + RANDOM.lower(), "é–ü", "日本 ", "\U0001f600", "paſſword=12345678", "toKen=12345678", "word", "\n", "xoxb-1234567890-abcdef", "token" + " " * 50 + "=" + "aaaaaaaaaa",
    ]
    return ["".join(rng.choice(parts) + rng.choice([" ", "", ",", "\n"]) for _ in range(rng.randint(0, 9))) for _ in range(150)]


def rows_of():
    rng = random.Random(6)
    rows = [(i, t, f"src{i % 7}") for i, t in enumerate(texts())]
    rows += [(1000 + i, f"sample token = {hexes(40, 9)} and {'Copied' + RANDOM + RANDOM}", f"src{i % 5}") for i in range(60)]  # a widely copied example
    rows += [(2000 + i, f"key {'Own' + RANDOM + RANDOM} here", None) for i in range(30)]  # one owner, few repositories
    rows += [(3000 + i, f"key {'Spread' + RANDOM + RANDOM} here", "src1") for i in range(100)]  # one owner, many repositories
    rows += [(None, "token: ABCDEFGH12345", None), (None, "token: ABCDEFGH12345", None), (7, None, "src0"), (8, "", None), (9, "word " * 50_000 + "password=" + "ab1c" * 5, "src2")]
    rows += [(4000, "see https://me:own9pass@host now", "src3")]
    rng.shuffle(rows)
    return rows


def frame(spark, rows):
    return spark.createDataFrame([(*r, "own", "own", "own") for r in rows], SCHEMA)


def test_base_kinds_as_plain_patterns():
    plain = {"assign": (re.compile(r"""(?ai)(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""), 2, 8), "access": (re.compile("AKIA[A-Z0-9]+"), 0, 16), "hex": (re.compile("[0-9a-f]+"), 0, 32)}
    for t in texts():
        want = sorted((m.start(), no, m.end()) for no, (p, g, least) in enumerate(plain.values()) for m in p.finditer(t) if len(m.group(g)) >= least)
        assert [c[:3] for c in secret_scan.candidates_of(t) if c[1] < 3] == want


def test_hint_is_in_every_text_with_a_candidate():
    hint = re.compile(secret_scan.HINT)
    assert all(hint.search(t) or not secret_scan.candidates_of(t) for t in texts() + [r[1] for r in rows_of() if r[1]])


def plain_scan(rows):
    found = [(i, d, s, secret_scan.candidates_of(t or "")) for i, (d, t, s) in enumerate(rows)]
    owners, repositories = {}, {}
    for _, d, s, spans in found:
        for c in spans:
            owners.setdefault(c[3], set()).add(s)
            repositories.setdefault(c[3], set()).add(d)
    names, out = list(secret_scan.KINDS), []
    for _, d, _, spans in found:
        kept = [(names[no], a, b, varied and not (len(owners[x]) >= 3 or len(repositories[x]) >= 100)) for a, no, b, x, varied in spans]
        out.append((d, ",".join(f"{k}:{a}:{b}" for k, a, b, live in kept if live or k in secret_scan.BASE)))
    return sorted(out, key=str)


def test_ownership_decides_on_added_spans(spark):
    rows = rows_of()
    out = secret_scan.scan(frame(spark, rows), "doc_id", "secret_found", "row", "a.b")
    got = [(r.doc_id, r.s) for r in out.select("doc_id", secret_scan.listed(F.col("secret__spans")).alias("s")).collect()]
    assert sorted(got, key=str) == plain_scan(rows)
    by = {d: s for d, s in got if d}
    assert all("mixed" not in by[1000 + i] and "assign" in by[1000 + i] for i in range(60))
    assert all(by[2000 + i].startswith("mixed:4:") for i in range(30)) and not any(by[3000 + i] for i in range(100))
    assert {r["a.b"] for r in out.collect()} == {"own"}


def test_beyond_the_broadcast_bounds(spark, monkeypatch):
    import farglass.runtime as runtime

    monkeypatch.setattr(runtime, "BROADCAST_ROWS", 0)
    monkeypatch.setattr(runtime, "HOT_SHARE", 10)
    out = secret_scan.scan(frame(spark, rows_of()), "doc_id")
    assert sorted(((r.doc_id, r.s) for r in out.select("doc_id", secret_scan.listed(F.col("secret__spans")).alias("s")).collect()), key=str) == plain_scan(rows_of())


def test_query_equals_sql_on_odd_rows(spark, tmp_path):
    frame(spark, rows_of()).select("doc_id", "text", "source").coalesce(1).write.parquet(f"{tmp_path}/documents.parquet")
    con = duckdb.connect()
    con.execute(f"create view documents as select * from read_parquet('{tmp_path}/documents.parquet/*.parquet')")
    found = con.execute(SECRETS)
    names = [c[0] for c in found.description]
    want = sorted(map(str, found.fetchall()))
    assert sorted(str(tuple(r[n] for n in names)) for r in queries.op12_secret_scan(spark, str(tmp_path)).collect()) == want
    assert any("mixed" in w for w in want) and any("login" in w for w in want)


def test_no_rows(spark):
    assert secret_scan.scan(frame(spark, []), "doc_id").collect() == []


def test_digests_not_values_are_kept():
    value = hexes(40, 1)
    assert {c[3] for c in secret_scan.candidates_of(f'token = "{value}"')} == {hashlib.sha256(value.encode()).digest()}
