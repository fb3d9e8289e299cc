"""The pattern automaton against regular expressions over class letters, and the filter of spans."""

import random
import re

import pytest
from pyspark.sql import functions as F

from farglass.operators import patterns


def plain_spans(pattern, letters):
    rule = re.compile(pattern.replace(" ", ""))
    return [(s, e) for s in range(len(letters)) for e in range(s + 1, len(letters) + 1) if rule.fullmatch(letters, s, e)]


def plain_longest(spans):
    kept = []
    for s, e in sorted(spans, key=lambda x: (x[0] - x[1], x[0])):
        if all(e <= a or b <= s for a, b in kept):
            kept.append((s, e))
    return sorted(kept)


@pytest.mark.parametrize("pattern", [*patterns.PHRASES.values(), patterns.NOUN_CHUNK, "A+ .? N", "N", ". N* .", "[NA]+ V? [NA]+"])
def test_automaton_finds_every_span(spark, pattern):
    rng = random.Random(hash(pattern) % 1000)
    rows = ["".join(rng.choice("TNAVRDPBHCXO") if rng.random() < 0.4 else rng.choice("TNAV") for _ in range(rng.randint(0, 14))) for _ in range(60)] + ["", "N" * 30, "T"]
    table = spark.createDataFrame([(i, list(r)) for i, r in enumerate(rows)], "i int, letters array<string>")
    compiled = patterns.Pattern(pattern)
    got = table.select("i", compiled.spans(F.col("letters")).alias("all"), patterns.longest_spans(compiled.spans(F.col("letters"))).alias("kept")).collect()
    for r in got:
        want = plain_spans(pattern, rows[r.i])
        assert sorted(tuple(s) for s in r.all) == want and [tuple(s) for s in r.kept] == plain_longest(want)


def test_terms_are_rows(spark):
    sentences = spark.createDataFrame([(1, "green heat pump is not very useful".split()), (2, "heat pump heat pump works".split()), (3, "the pump heat".split()), (4, []), (5, None), (6, "modern boilers have a green heat pump".split())], "id int, words array<string>")
    terms = spark.createDataFrame([("heat pump",), ("Heat-Pump",), ("pump",), ("",), (None,)], "term string")
    rows = {(r.id, r.term): r.words for r in patterns.with_terms(sentences, ["id"], "words", terms, "term").collect()}
    assert rows[2, "heat pump"] == ["\x01", "\x01", "works"] and rows[2, "Heat-Pump"] == rows[2, "heat pump"]
    assert (3, "heat pump") not in rows and rows[3, "pump"] == ["the", "\x01", "heat"] and not {4, 5} & {i for i, _ in rows}
    found = patterns.term_phrases(sentences, ["id"], "words", terms.limit(1), "term", lexicon={"green": "A", "boilers": "N", "works": "V"}).collect()
    got = {(r.id, r.pattern, r.phrase) for r in found}
    assert {(1, "adj_phrase", "green heat pump"), (1, "term_is", "heat pump is not very useful"), (2, "verb_subj", "heat pump works"), (6, "adj_phrase", "green heat pump")} <= got


def test_noun_chunks(spark):
    sentences = spark.createDataFrame([(1, "the useful heat pump warms all old houses slowly".split())], "id int, words array<string>")
    chunks = patterns.noun_chunks(sentences, ["id"], "words", lexicon={"warms": "V", "old": "A"})
    assert [r.phrase for r in chunks.orderBy("n").collect()] == ["the useful heat pump", "all old houses"]
    terms = spark.createDataFrame([("heat pump",), ("old",), ("he",)], "t string")
    assert {(r.term, r.phrase) for r in patterns.chunks_with(chunks, terms, "t").collect()} == {("heat pump", "the useful heat pump"), ("old", "all old houses")}


@pytest.mark.parametrize("pattern", ["", "N* A?", "n", "N)", "[NA"])
def test_bad_patterns(pattern):
    with pytest.raises(ValueError):
        patterns.Pattern(pattern)
