"""Token files, token counts, WARC archives, mixing and sharding."""

import base64
import gzip
import hashlib
import random
import zlib

import numpy as np
import public_tokenizers
import pytest
from pyspark.sql import Row
from pyspark.sql import functions as F

from farglass.llm import encoding, hilbert, mixing, token_counts, token_files, warc

DOCS = "doc_id long, text string, lang string, source string, n_chars long"
IDS = str(public_tokenizers.path("byte_bpe_50k.json"))
COUNTS = str(public_tokenizers.path("word_bpe_49k.json"))
TEXTS = [
    None, "", " ", "\n", "plain words here", "two  spaces", "line one\nline two", "ends \n starts", "tab\tand nbsp", "<|endoftext|> in <|startoftext|> text", "it's we'll I'M", "é́ combining ̈ mark", "中文 テキスト 한국어", "\x1c odd \x85 white space",
    "numbers 12345 and 1,000.50", "word " * 5000, " lead and trail ", "a\n\n\nb", "same text", "same text", "🙂 emoji🙂", "\r\nwindows\r\nlines",
]


def frame(spark, texts, sources=None):
    return spark.createDataFrame([Row(k, t, "en", sources[k] if sources else "s", 1) for k, t in enumerate(texts)], DOCS)


def test_encoders_equal_the_library():
    lib, counter = encoding.load(IDS), encoding.load(COUNTS)
    texts = [t or "" for t in TEXTS]
    whole = [np.array(lib.encode(t, add_special_tokens=False).ids, "<u2").tobytes() for t in texts]
    assert encoding.IdEncoder(IDS, "H").encode(texts) == whole
    assert encoding.IdEncoder(IDS, "H", memo=3).encode(texts) == whole
    counts = [len(counter.encode(t, add_special_tokens=False)) for t in texts]
    assert encoding.TokenCounter(COUNTS).count(texts) == counts
    assert encoding.TokenCounter(COUNTS, memo=2).count(texts) == counts


def test_encoders_equal_the_library_on_random_texts():
    rng, lib, counter = random.Random(5), encoding.load(IDS), encoding.load(COUNTS)
    parts = ["a", "B", "the", " ", " ", " ", "\n", "'s", "!", "é", "́", "12", "\t", "<|endoftext|>", " ", "\x1d", "ß", "中", "-"]
    texts = ["".join(rng.choices(parts, k=rng.randint(0, 30))) for _ in range(1500)]
    assert encoding.IdEncoder(IDS, "H").encode(texts) == [np.array(lib.encode(t, add_special_tokens=False).ids, "<u2").tobytes() for t in texts]
    assert encoding.TokenCounter(COUNTS).count(texts) == [len(counter.encode(t, add_special_tokens=False)) for t in texts]


def test_token_files_round_trip(spark):
    docs = frame(spark, TEXTS).union(frame(spark, TEXTS[4:6])).repartition(3)
    written = token_files.write_token_files(docs, IDS)
    rows = token_files.read_token_files(spark, written, rows=4).orderBy("position").collect()
    lib = encoding.load(IDS)
    texts = sorted([(k, t or "") for k, t in enumerate(TEXTS)] + [(0, TEXTS[4]), (1, TEXTS[5])])
    at = 0
    assert [r.doc_id for r in rows] == [k for k, _ in texts]
    for r, (_, t) in zip(rows, texts):
        ids = np.array([*lib.encode(t, add_special_tokens=False).ids, 0], "<u4")
        assert (r.start, r.n_tokens, r.ids_crc32) == (at, len(ids), zlib.crc32(ids.tobytes()))
        at += len(ids)


def test_token_files_of_nothing_and_null_ids(spark):
    assert token_files.read_token_files(spark, token_files.write_token_files(frame(spark, []), IDS)).collect() == []
    docs = spark.createDataFrame([(None, "a"), (-5, "b"), (None, None)], "doc_id long, text string")
    rows = token_files.read_token_files(spark, token_files.write_token_files(docs, IDS)).orderBy("position").collect()
    assert [r.doc_id for r in rows] == [None, None, -5] and [r.start for r in rows] == [0, 1, 3]


def test_token_counts_use_and_extend_the_cache(spark, tmp_path):
    lib, cache = encoding.load(COUNTS), str(tmp_path / "cache")
    first = {r.doc_id: r for r in token_counts.count_tokens(frame(spark, TEXTS[:12]), COUNTS, cache).collect()}
    assert all(first[k].n_tokens == len(lib.encode(t or "", add_special_tokens=False)) and first[k].n_bytes == len((t or "").encode()) for k, t in enumerate(TEXTS[:12]))
    assert not any(r.cached for r in first.values())
    again = {r.doc_id: r for r in token_counts.count_tokens(frame(spark, TEXTS), COUNTS, cache).collect()}
    assert len(again) == len(TEXTS) and all(again[k].cached for k in range(12)) and not again[15].cached
    assert all(again[k].n_tokens == len(lib.encode(t or "", add_special_tokens=False)) for k, t in enumerate(TEXTS))
    stored = spark.read.parquet(cache)
    assert stored.count() == stored.select("digest").distinct().count()
    assert token_counts.count_tokens(frame(spark, []), COUNTS, cache).collect() == []


def pages(spark, payloads):
    return spark.createDataFrame([(k, None if k == 1 else f"http://x/{k}", p, 1) for k, p in enumerate(payloads)], "page_id long, url string, html string, payload int")


def test_warc_round_trip(spark):
    payloads = ["<p>a", None, "", "<p>a", "é" * 40000, "<p>a", "\r\n\r\n", ""]
    folder, names = warc.write_warc(pages(spark, payloads).repartition(2), file_bytes=300)
    rows = {r.own_id: r for r in warc.read_warc(spark, folder, names, payloads=True).collect()}
    for k, p in enumerate(payloads):
        data = (p or "").encode()
        last = max(j for j, q in enumerate(payloads) if (q or "") == (p or ""))
        r = rows[k]
        assert (r.payload_bytes, r.payload_digest) == (len(data), base64.b32encode(hashlib.sha1(data).digest()).decode())
        assert (r.record_type, r.refers_to) == (("response", None) if k == last else ("revisit", last))
        assert r.payload == ((p or "") if k == last else None) and r.url == (None if k == 1 else f"http://x/{k}")
    assert names.count() > 2
    folder, names = warc.write_warc(pages(spark, payloads), least=2)
    assert {r.own_id for r in warc.read_warc(spark, folder, names).collect() if r.record_type == "revisit"} == {0, 3}
    assert warc.read_warc(spark, *warc.write_warc(pages(spark, []))).collect() == []


def test_warc_reader_finds_damage():
    good = warc.make_record(1, "http://x/", b"abc", warc.digest(b"abc"), None, False)
    assert warc.parse_record(gzip.decompress(good))["payload"] == b"abc"
    raw = gzip.decompress(good)
    for broken in (raw.replace(b"abc", b"abd"), raw[:-1], raw.replace(b"WARC/1.1", b"WORC/1.1")):
        with pytest.raises(warc.WarcError):
            warc.parse_record(broken)

    class Stream:
        def __init__(self, data):
            self.data = data

        def read(self, n):
            out, self.data = self.data[:n], self.data[n:]
            return out

    assert len(list(warc.members(Stream(good * 3), 7))) == 3
    with pytest.raises(warc.WarcError):
        list(warc.members(Stream(good + good[:-5]), 7))


def brute_targets(sizes, weights=(3, 1, 2), share=1.5, most=2.0):
    order = sorted(sizes, key=lambda s: (s is None, s or ""))
    w = {s: float(weights[k % 3]) for k, s in enumerate(order)}
    left, free, out = share * sum(sizes.values()), set(sizes), {}
    while free:
        level = left / sum(w[s] for s in free)
        capped = {s for s in free if most * sizes[s] <= level * w[s]}
        if not capped:
            return out | {s: level * w[s] for s in free}
        out |= {s: most * sizes[s] for s in capped}
        left -= sum(out[s] for s in capped)
        free -= capped
    return out


@pytest.mark.parametrize("seed", range(3))
def test_mix_meets_its_targets(spark, seed):
    rng = random.Random(seed)
    sources = [rng.choice(["a", "b", "B", "é", None, "z"] + ["a"] * 6) for _ in range(400)]
    texts = [None if rng.random() < 0.02 else "w " * rng.randint(0, 60) for _ in sources]
    rows = mixing.mix(frame(spark, texts, sources)).collect()
    sizes = {}
    for s, t in zip(sources, texts):
        sizes[s] = sizes.get(s, 0) + len((t or "").split())
    targets = brute_targets(sizes)
    taken = dict.fromkeys(sizes, 0)
    for r in rows:
        assert r.mix_source_size == sizes[r.source] and r.mix_target == pytest.approx(targets[r.source])
        assert 0 <= r.mix_copies <= 2
        taken[r.source] += r.mix_size * r.mix_copies
    for s in sizes:  # four standard deviations of independent draws
        fraction = targets[s] / max(sizes[s], 1) % 1
        spread = (sum(r.mix_size**2 for r in rows if r.source == s) * fraction * (1 - fraction)) ** 0.5
        assert abs(taken[s] - targets[s]) <= 4 * spread + 1e-6
    emitted = mixing.emit(mixing.mix(frame(spark, texts, sources)))
    assert emitted.count() == sum(r.mix_copies for r in rows) and emitted.columns == frame(spark, []).columns


def test_mix_of_nothing(spark):
    assert mixing.mix(frame(spark, [])).collect() == []
    assert [r.mix_target for r in mixing.mix(frame(spark, [None, ""])).collect()] == [0.0, 0.0]


@pytest.mark.parametrize("dims,bits", [(1, 4), (2, 1), (2, 4), (3, 3), (4, 2)])
def test_hilbert_index_is_a_continuous_bijection(dims, bits):
    grid = np.stack(np.meshgrid(*[np.arange(1 << bits)] * dims, indexing="ij"), axis=-1).reshape(-1, dims)
    index = hilbert.hilbert_index(grid, bits)
    assert sorted(index.tolist()) == list(range(len(grid)))
    path = grid[np.argsort(index)]
    assert (np.abs(np.diff(path, axis=0)).sum(axis=1) == 1).all()


@pytest.mark.parametrize("n", [0, 1, 5, 16, 37, 400])
def test_shards_hold_the_rows_law(spark, n):
    rng = random.Random(n)
    texts = [rng.choice([None, "", "same text", "x" * rng.randint(0, 5000), "é"]) for _ in range(n)]
    rows = hilbert.shard_rows(frame(spark, texts, [rng.choice([None, "a", "b", "c"]) for _ in texts]), shards=16).collect()
    assert sorted(r.doc_id for r in rows) == list(range(n))
    counts = [0] * 16
    for r in rows:
        counts[r.shard] += 1
        data = (texts[r.doc_id] or "").encode()
        assert (r.size, r.text_crc32, r.law, r.grown_shard) == (len(data) + 1, zlib.crc32(data), "rows", None)
    if n:
        assert max(counts) - min(counts) <= 1
    for s in range(16):
        assert sorted(r.slot for r in rows if r.shard == s) == list(range(counts[s]))
    order = sorted(rows, key=lambda r: (r.shard, r.slot))
    assert [r.curve for r in order] == sorted(r.curve for r in rows)


def test_the_copy_is_a_bernoulli_draw(spark):
    """200 sources of one document each: the share that draws the extra copy is the fraction."""
    for size, share in ((10, 1.5), (10, 0.9), (7, 1.81)):
        docs = frame(spark, ["w " * size] * 200, [f"s{k:03d}" for k in range(200)])
        rows = mixing.mix(docs, weights=(1,), share=share, most=5.0).collect()
        fraction = share % 1
        assert all(r.mix_rate == pytest.approx(share) and r.mix_copies in (int(share), int(share) + 1) for r in rows)
        drawn = sum(r.mix_copies - int(share) for r in rows)
        assert abs(drawn - 200 * fraction) <= 3 * (200 * fraction * (1 - fraction)) ** 0.5
    assert len({r.mix_copies for r in rows}) == 2


def test_rows_without_ids_draw_by_their_texts(spark):
    docs = frame(spark, [f"w{k} w" for k in range(400)], ["s"] * 400).withColumn("doc_id", F.lit(None).cast("long"))
    rows = mixing.mix(docs, weights=(1,), share=1.75, most=5.0).collect()
    drawn = sum(r.mix_copies - 1 for r in rows)
    assert abs(drawn - 300) <= 3 * (400 * 0.75 * 0.25) ** 0.5


def test_mix_keeps_columns_of_its_own_names(spark):
    names = ["mix_size", "mix_copies", "mix_source", "MIX_number", "source_size", "target", "a.b"]
    docs = frame(spark, ["a b", None, "c"], ["x", "y", None]).select("doc_id", "text", "source", *(F.lit(f"own {n}").alias(n) for n in names))
    mixed = mixing.mix(docs)
    assert mixed.columns == docs.columns + [f"mix__{c}" for c in ("size", "source_size", "target", "rate", "copies")]
    assert sorted((r.doc_id, r["mix__size"]) for r in mixed.collect()) == [(0, 2), (1, 0), (2, 1)]
    out = mixing.emit(mixed)
    assert out.columns == docs.columns and out.count() == sum(r["mix__copies"] for r in mixed.collect())
    assert all(r[n] == f"own {n}" for r in out.collect() for n in names)


def test_warc_reads_long_records_in_pieces():
    """A record of 40 MB is inflated, framed and verified without ever being held."""
    import io
    import tracemalloc

    payload = bytes(range(256)) * 160_000
    record = warc.make_record(1, None, payload, warc.digest(payload), None, False)
    stream = io.BytesIO(record + warc.make_record(2, "u", b"", warc.digest(b""), 1, True))
    tracemalloc.start()
    found = [warc.parse_record(m, keep=False) for m in warc.members(stream)]
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert [f["http"]["content-length"] for f in found] == [str(len(payload)), "0"] and found[0]["payload"] == b"" and peak < 4 << 20
    for chunk in (1, 5, 1000):
        small = warc.make_record(None, None, b"a\r\n\r\nb", warc.digest(b"a\r\n\r\nb"), None, False)
        assert [warc.parse_record(m)["payload"] for m in warc.members(io.BytesIO(small * 2), chunk)] == [b"a\r\n\r\nb"] * 2


def test_files_with_clashing_names(spark, tmp_path):
    names = ["id", "own_id", "text_", "digest", "n_tokens", "n_bytes", "shard", "size", "crc", "curve", "n0", "s0", "c0", "v0", "payload", "sha", "kept", "a.b"]
    docs = frame(spark, ["one", None, "two"]).select("doc_id", "text", "lang", "source", *(F.lit("x").alias(n) for n in names))
    assert token_files.read_token_files(spark, token_files.write_token_files(docs, IDS)).count() == 3
    assert sorted(r.n_bytes for r in token_counts.count_tokens(docs, COUNTS, str(tmp_path / "c")).collect()) == [0, 3, 3]
    assert hilbert.shard_rows(docs).count() == 3
    rows = pages(spark, ["a", None]).select("page_id", "url", "html", *(F.lit("x").alias(n) for n in names))
    assert warc.read_warc(spark, *warc.write_warc(rows)).count() == 2


def test_long_texts(spark, tmp_path):
    lib, long = encoding.load(COUNTS), "many words, and numbers 12 " * 40_000
    row = token_counts.count_tokens(frame(spark, [long]), COUNTS, str(tmp_path / "long")).first()
    assert row.n_tokens == 40_000 * len(lib.encode("many words, and numbers 12", add_special_tokens=False)) and row.n_bytes == len(long)
    ids = encoding.load(IDS)
    row = token_files.read_token_files(spark, token_files.write_token_files(frame(spark, [long]), IDS)).first()
    assert row.n_tokens == len(ids.encode(long, add_special_tokens=False)) + 1


def test_shards_of_equal_cells(spark):
    docs = frame(spark, ["same"] * 40)
    rows = hilbert.shard_rows(docs.union(docs), shards=7).collect()
    assert len({r.curve for r in rows}) == 1 and [r.doc_id for r in sorted(rows, key=lambda r: (r.shard, r.slot))] == sorted(r.doc_id for r in rows)
