"""The pipeline and the queries opN against plain Python, and stages on odd tables."""

import base64
import hashlib
import zlib

import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from farglass.llm import encoding, html_text, quality, queries
from test_near_and_pages import brute_components, brute_fingerprint
from test_similar import brute as brute_similar
from test_words_and_rules import brute_contamination, brute_license, brute_quality

D = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def docs(spark):
    return {r.doc_id: r for r in queries.table(spark, D, "documents").collect()}


def rows(spark, name):
    return queries.queries()[name](spark, D).collect()


def test_pipeline_against_brute_force(spark, docs):
    table = queries.table(spark, D, "documents")
    items = [(r.item_id, r.text) for r in queries.table(spark, D, "benchmark").collect()]
    assert [n for n, _ in corpus_pipeline.STAGES] == ["quality_rules", "simhash_near_dedup", "benchmark_decontamination", "mix_sources", "token_output"]
    kept = corpus_pipeline.quality_rules(spark, table, D)
    rules = quality.learn(table, queries.table(spark, D, "labels"))
    good = {r.doc_id: r.text for r in kept.collect()}
    assert set(good) == {r.doc_id for r in quality.judge(table, rules).where("quality_kept").collect()} and 0 < len(good) < len(docs)
    once = corpus_pipeline.near_dedup(spark, kept, D)
    alone = {r.doc_id for r in once.collect()}
    assert alone == set(brute_similar(good).values()) and len(alone) < len(good)
    clean = corpus_pipeline.decontaminate(spark, once, D)
    counts = {k: brute_contamination(good[k], items) for k in alone}
    assert {r.doc_id for r in clean.collect()} == {k for k, (n, hit, _) in counts.items() if not (hit and 20 * hit >= n)} != alone
    mixed = corpus_pipeline.mix_sources(spark, clean, D)
    assert mixed.columns == clean.columns == once.columns == kept.columns == table.columns
    out = corpus_pipeline.token_output(spark, mixed, D).collect()
    assert len(out) == mixed.count()
    out.sort(key=lambda r: r.start)
    assert [r.start for r in out] == [sum(x.n_tokens for x in out[:k]) for k in range(len(out))] and [r.doc_id for r in out] == sorted(r.doc_id for r in out)


def test_stages_on_odd_tables(spark):
    """Null ids, texts and sources, repeated ids and rows, clashing names, and nothing at all."""
    long = "one of many words that make up a text of more than ten words for the rules number "
    given = [(1, long + "1", "en", None, 5), (1, "quite other words which stand in a second text under the very same id as before", "en", "a", 5), (None, long + "3", None, "a", None), (2, None, "en", "b", 0), (3, "", "en", "b", 0), (1, long + "1", "en", None, 5)]
    names = ["quality_kept", "near_id", "bench_n_hit", "mix_copies", "component", "text_hash", "start"]
    for table in (spark.createDataFrame(given, "doc_id long, text string, lang string, source string, n_chars long"), None):
        table = spark.createDataFrame([], "doc_id long, text string, lang string, source string, n_chars long") if table is None else table
        table = table.select("*", *(F.lit(f"own {n}").alias(n) for n in names))
        seen = table
        for name, stage in corpus_pipeline.STAGES[:-1]:
            seen = stage(spark, seen, D)
            assert seen.columns == table.columns, name
            assert all(r[n] == f"own {n}" for r in seen.collect() for n in names), name
        out = corpus_pipeline.token_output(spark, seen, D)
        assert out.columns == ["doc_id", "start", "n_tokens", "ids_crc32"] and out.count() == seen.count()
    kept = corpus_pipeline.near_dedup(spark, corpus_pipeline.quality_rules(spark, spark.createDataFrame(given, "doc_id long, text string, lang string, source string, n_chars long"), D), D)
    assert sum(r.doc_id == 1 for r in kept.collect()) == 2  # two texts under one id are two documents


def test_op1(spark, docs):
    for r in rows(spark, "op1_license_scan"):
        n, base, labels, score = brute_license(docs[r.doc_id].text)
        firsts = [f for f, _ in base]
        assert (r.n_words, r.n_base, r.first_word, r.last_word) == (n, len(base), min(firsts, default=None), max(firsts, default=None))
        assert (r.base_labels, r.labels, r.score) == (",".join(sorted({x for _, x in base})), ",".join(labels), score)


def test_op3_and_op6(spark, docs):
    ids, counts = (encoding.load(queries.tokenizer(n)) for n in (queries.IDS_TOKENIZER, queries.COUNT_TOKENIZER))
    at = 0
    for r in sorted(rows(spark, "op3_token_files"), key=lambda r: r.doc_id):
        own = [*ids.encode(docs[r.doc_id].text or "", add_special_tokens=False).ids, 0]
        assert (r.start, r.n_tokens, r.ids_crc32) == (at, len(own), zlib.crc32(b"".join(i.to_bytes(4, "little") for i in own)))
        at += len(own)
    for r in rows(spark, "op6_token_counts"):
        text = docs[r.doc_id].text or ""
        n = len(counts.encode(text, add_special_tokens=False))
        assert (r.n_bytes, r.n_tokens, r.over_limit) == (len(text.encode()), n, n > 2048)


def test_op4(spark, docs):
    found = rows(spark, "op4_hilbert_shards")
    assert sorted(r.doc_id for r in found) == sorted(docs)
    for r in found:
        data = (docs[r.doc_id].text or "").encode()
        assert (r.size, r.text_crc32, r.law, r.grown_shard) == (len(data) + 1, zlib.crc32(data), "rows", None)
    for s in range(16):
        assert sorted(r.slot for r in found if r.shard == s) == list(range(sum(r.shard == s for r in found)))


def test_op5_and_op8(spark):
    pages = {r.page_id: r for r in queries.table(spark, D, "pages").collect()}
    last = {}
    for k in sorted(pages):
        last[pages[k].html or ""] = k
    for r in rows(spark, "op5_warc"):
        data, keeper = (pages[r.page_id].html or "").encode(), last[pages[r.page_id].html or ""]
        assert (r.payload_bytes, r.payload_digest) == (len(data), base64.b32encode(hashlib.sha1(data).digest()).decode())
        assert (r.record_type, r.refers_to) == (("response", None) if keeper == r.page_id else ("revisit", keeper))
    for r in rows(spark, "op8_html_text"):
        text = html_text.extract(pages[r.page_id].html)
        assert (r.url, r.text, r.n_chars) == (pages[r.page_id].url, text, len(text))


def test_op7(spark, docs):
    items = [(r.item_id, r.text) for r in queries.table(spark, D, "benchmark").collect()]
    for r in rows(spark, "op7_decontaminate"):
        n, hit, named = brute_contamination(docs[r.doc_id].text, items)
        assert (r.n_words, r.n_hit, r.n_items, r.contaminated) == (n, hit, len(named), bool(hit and 20 * hit >= n))
        assert r.items_sha256 == hashlib.sha256(",".join(named).encode()).hexdigest()


def test_op9(spark, docs):
    prints = {k: brute_fingerprint(r.text) for k, r in docs.items()}
    keys = sorted(prints)
    want = brute_components(prints, [(a, b) for i, a in enumerate(keys) for b in keys[i + 1 :] if (prints[a] ^ prints[b]).bit_count() <= 4])
    found = rows(spark, "op9_simhash")
    assert {r.doc_id: r.component_id for r in found} == want and {r.doc_id: r.fingerprint for r in found} == {k: f"{p:016x}" for k, p in prints.items()}


def test_op10(spark, docs):
    rules = quality.learn(queries.table(spark, D, "documents"), queries.table(spark, D, "labels"))
    ratios = {r.doc_id: {f: r[f"quality_{f}"] for f in quality.FEATURES} for r in quality.signals(queries.table(spark, D, "documents")).collect()}
    for r in rows(spark, "op10_quality_rules"):
        n, chars, symbols, dups, repeats = brute_quality(docs[r.doc_id].text)
        failed = n < 10 or 100 * repeats > 20 * n
        assert (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words, r.base_failed) == (n, chars, symbols, dups, repeats, failed)
        assert r.kept == (not failed and quality.verdict(rules, ratios[r.doc_id]))
