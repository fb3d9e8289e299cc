"""SimHash near-duplicates, components, main text and the pipeline."""

import random
from itertools import combinations

import numpy as np
import pytest
import xxhash
from pyspark.sql import Row

from farglass.llm import html_text, simhash
from farglass.operators import components

DOCS = "doc_id long, text string, lang string, source string, fp string"


def brute_fingerprint(text, k=4):
    words = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
    for c in "\t\n\x0b\x0c\r":
        words = words.replace(c, " ")
    words = [w for w in words.split(" ") if w]
    if not words:
        return 0
    shingles = [" ".join(words[i : i + k]) for i in range(len(words) - k + 1)] or [" ".join(words)]
    hashes = [xxhash.xxh64_intdigest(s.encode(), 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def brute_components(nodes, edges):
    parent = {n: n for n in nodes}

    def find(x):
        while parent[x] != x:
            parent[x] = parent[parent[x]]
            x = parent[x]
        return x

    for a, b in edges:
        a, b = find(a), find(b)
        parent[max(a, b)] = min(a, b)
    return {n: find(n) for n in nodes}


@pytest.mark.parametrize("text", [None, "", " \x0b", "one", "One two THREE", "a b c d", "a b c d e É\x85x", "x " * 300, "  y z w v u"])
def test_fingerprint(text):
    assert simhash.fingerprint(text or "") == brute_fingerprint(text)


@pytest.mark.parametrize("width", [2, 3, 4])
def test_covering_holds_every_four(width):
    chosen = [set(c) for c in simhash.covering(width)]
    assert all(any(c <= set(four) for c in chosen) for four in combinations(range(8), 4))


def links_found(spark, prints, most=4, width=3):
    nodes = spark.createDataFrame([(int(np.uint64(p).view(np.int64)),) for p in set(prints)], "fp long")
    return [(r.u, r.v) for r in simhash.links(nodes, most, width).collect()]


@pytest.mark.parametrize("width", [2, 3])
def test_links_connect_what_brute_force_connects(spark, width):
    rng = random.Random(width)
    prints = [rng.getrandbits(64) for _ in range(60)]
    for p in list(prints[:25]):  # chains of near prints, with links at exactly four bits and none at five
        for _ in range(rng.randint(1, 12)):
            for b in rng.sample(range(64), rng.randint(1, 5)):
                p ^= 1 << b
            prints.append(p)
    common = prints[0] & ~0xFFFFFFFFFF
    prints += [common | rng.getrandbits(40) for _ in range(150)]  # one crowded list
    prints = sorted(set(prints))
    signed = {p: int(np.uint64(p).view(np.int64)) for p in prints}
    want = brute_components(signed.values(), [(signed[a], signed[b]) for a, b in combinations(prints, 2) if (a ^ b).bit_count() <= 4])
    got_edges = links_found(spark, prints, 4, width)
    assert all((a ^ b).bit_count() <= 4 for a, b in ((x & (1 << 64) - 1, y & (1 << 64) - 1) for x, y in got_edges))
    assert brute_components(signed.values(), got_edges) == want


def test_components_of_a_long_path_and_a_star(spark):
    rng = random.Random(3)
    path = list(range(0, 200))
    rng.shuffle(path)
    edges = list(zip(path, path[1:])) + [(1000, k) for k in range(1001, 1300)] + [(5000, 5000), (6000, 6001), (6001, 6000)]
    rng.shuffle(edges)
    got = {r.node: r.component for r in components.connected_components(spark.createDataFrame(edges, "u long, v long")).collect()}
    nodes = {x for e in edges if e[0] != e[1] for x in e}
    assert got == brute_components(nodes, [e for e in edges if e[0] != e[1]])
    assert components.connected_components(spark.createDataFrame([], "u long, v long")).collect() == []


def test_few_edges_stay_in_one_partition(spark, monkeypatch):
    """Rounds over a small table would leave a shuffle file for each pair of partitions."""
    plans, store = [], components.materialise
    monkeypatch.setattr(components, "materialise", lambda df, name: plans.append(df._jdf.queryExecution().executedPlan().toString()) or store(df, name))
    chain = spark.createDataFrame([(k, k + 1) for k in range(40)], "u long, v long")
    assert {r.component for r in components.connected_components(chain).collect()} == {0}
    assert len(plans) > 2 and not any("Exchange hashpartitioning" in p for p in plans[1:])
    monkeypatch.setattr(components, "FEW", 0)
    assert {r.component for r in components.connected_components(chain).collect()} == {0}


def test_near_duplicates_match_brute_force(spark):
    rng = random.Random(9)
    base = [" ".join(rng.choice(["alpha", "beta", "Gamma", "delta", "eps"]) + str(rng.randint(0, 30)) for _ in range(rng.randint(30, 90))) for _ in range(12)]
    texts = [None, "", " ", "short", "Short"] + base
    for t in base:
        w = t.split()
        for _ in range(4):
            x = list(w)
            x[rng.randrange(len(x))] = "changed"
            texts.append(" ".join(x))
    texts += base[:5]
    order = list(range(len(texts)))
    rng.shuffle(order)
    rows = spark.createDataFrame([Row(k, texts[k], "en", "s", "clash") for k in order], DOCS)
    prints = {k: brute_fingerprint(t) for k, t in enumerate(texts)}
    want = brute_components(prints, [(a, b) for a, b in combinations(prints, 2) if (prints[a] ^ prints[b]).bit_count() <= 4])
    found = simhash.near_duplicates(rows)
    assert {r.doc_id: r.component_id for r in found.collect()} == want
    assert {r.doc_id: r.fp & (1 << 64) - 1 for r in found.collect()} == prints
    kept = simhash.keep_one(rows.union(rows.limit(3)), simhash.near_duplicates(rows.union(rows.limit(3))))
    assert sorted(r.doc_id for r in kept.collect()) == sorted(set(want.values())) and kept.columns == rows.columns
    assert simhash.near_duplicates(rows.limit(0)).collect() == []


ARTICLE = "<p>This is the text of the article and it has a number of the words that are to be seen in it as it goes on for some time."


@pytest.mark.parametrize(
    "html,text",
    [
        (None, ""),
        ("", ""),
        ("<html><body></body></html>", ""),
        ("<nav><a href=x>menu</a></nav><article><h1>A title</h1><p>One &amp; two\n\t three&nbsp;four<br>five<p>Short.</article><footer>&copy; x</footer>", "A title One & two three four five Short."),
        ("<script>var t='</p><p>no';</script><style>p{}</style><!-- <p>no --><article><p>yes</article>", "yes"),
        ("<article><p>Body of it.<div class='ad'>Buy now</div><aside>See also</aside><form><p>Name</p></form><section id=comments><p>Nice article</p></section><p>The end.</article>", "Body of it. The end."),
        ("<article><p>Cut off in the mid", "Cut off in the mid"),
        ("<main><article><p>Inner words</article></main><div class='cookie-notice'>We use cookies</div>", "Inner words"),
        ("<article><p><b>Bold <i>open<p>next</article>", "Bold open next"),
        ("<article><p>a < b and c > d &lt;tag&gt; &#233; &eacute; &am</article>", "a < b and c > d <tag> é é &am"),
        ("<body><div id='menu'><a href=1>Home</a> <a href=2>Away</a></div>" + ARTICLE + ARTICLE + "<div>Related: <a href=1>The one</a></div></body>", None),
        ("<article><header><h1>Head</h1></header><p>Text of it</article>", "Head Text of it"),
        ("<div class='article-body'><article class='post'><p>Kept words</p></article></div>", "Kept words"),
    ],
)
def test_main_text(html, text):
    want = " ".join([" ".join(ARTICLE[3:].split())] * 2) if text is None else text
    assert html_text.extract(html) == want


def test_main_text_of_pages(spark):
    rows = [(1, "u", "<article><p>x y</article>", "clash"), (2, None, None, "clash"), (1, "u", "<article><p>x y</article>", "clash")]
    made = html_text.extract_pages(spark.createDataFrame(rows, "page_id long, url string, html string, text string")).collect()
    assert sorted((r.page_id, r.text, r.n_chars) for r in made) == [(1, "x y", 3), (1, "x y", 3), (2, "", 0)]
    assert html_text.extract("<p>" * 20000 + "<article>" + "<div>" * 5000 + "deep") == "deep"
