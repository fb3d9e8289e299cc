"""License scans, quality rules and decontamination against plain Python."""

import hashlib
import re

from pyspark.sql import Row
from pyspark.sql import functions as F

from farglass.llm import decontamination, license_rules, licenses, quality
from farglass.llm.words import license_word_count

DOCS = "doc_id long, text string, lang string, source string, n_chars long, license_text string"
LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
SAMPLE = "/root/testdata/sf0.001"


def words(text):
    return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", (text or "").translate(LOWER))


def frame(spark, texts):
    return spark.createDataFrame([Row(k, t, "en", "s", 1, "clash") for k, t in enumerate(texts)], DOCS)


TEXTS = [
    None, "", "...", "Licensed under the MIT License.", "under the mit license UNDER-THE_MIT LICENSE", "CC BY-NC 4.0 and cc\nby\nnc", "Licensed under the Apache License, Version 2.0",
    "é MIT license É under the mít license", "SPDX-License-Identifier: GPL-3.0-or-later", "underthe mit license", "word " * 3000 + "apache license version 2 " * 50, "Permission is hereby granted, free of charge, to any person obtaining a copy",
    "CC BY NC SA 4.0 license", "Licensed under the Apache License, Version 2.0", "occ by ncx cc by nc",
]


def brute_license(text):
    w = words(text)
    line = " " + " ".join(w) + " "
    found = []
    for r in license_rules.build():
        for m in re.finditer(r.pattern, line):
            first = line[: m.start()].count(" ") - 1
            found.append((first, first + m[0].count(" ") + 1, r))
    kept = []
    for a in found:
        inside = any(
            b is not a and b[0] <= a[0] and b[1] >= a[1] and b[2].priority >= a[2].priority
            and ((b[0], b[1]) != (a[0], a[1]) or b[2].priority > a[2].priority or b[2].number < a[2].number)
            for b in found
        )
        if not inside:
            kept.append(a)
    base = [f for f in found if f[2].base]
    labels = sorted({f[2].label for f in kept} | {f[2].label for f in base})
    return len(w), sorted((f[0], f[2].label) for f in base), labels, max([f[2].confidence for f in kept], default=0.0)


def test_license_scan_matches_brute_force(spark):
    rows = licenses.scan(frame(spark, TEXTS).drop("license_text")).withColumn("n_words", license_word_count(F.col("text"))).collect()
    for r in rows:
        n, base, labels, score = brute_license(r.text)
        assert (r.n_words, r.license_labels, r.license_score) == (n, labels, score), r.text
        assert sorted((x.first, x.label) for x in r.license_found if x.base) == base


def test_license_rules_are_hundreds_and_hold_an_anchor():
    rules = license_rules.build()
    assert len(rules) > 300 and len({r.number for r in rules}) == len(rules)
    for r in rules:
        if r.base or "licen" in "".join(r.gates) or "spdx" in r.gates:
            continue
        assert any(a in " ".join(r.gates) for a in licenses.ANCHORS), r


def test_license_scan_of_nothing(spark):
    assert licenses.scan(frame(spark, [])).collect() == []


def brute_quality(text):
    text = text or ""
    w = re.findall(r"[^\x20\x09-\x0D]+", text)
    seen = {}
    for i in range(len(w) - 4):
        seen.setdefault(tuple(w[i : i + 5]), []).append(i)
    hit = {i + k for starts in seen.values() if len(starts) > 1 for i in starts for k in range(5)}
    lines = [x for x in text.split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
    return len(w), sum(map(len, w)), len(re.findall(r"[#*$%&|<>]", text)), len(lines) - len(set(lines)), len(hit)


QUALITY = [None, "", " \n\t ", "a b c d e", "a b c d e a b c d e", "x " * 500, "a a a a a a", "l1 a b\nl1 a b\n \n \nl2 #$%\nl1 a b", "é ü | <a> & b c d e f é ü | <a> & b", "one two three four five six seven eight nine ten eleven one two three four five\x0bsix"]


def test_quality_signals_match_brute_force(spark):
    made = quality.judge(frame(spark, QUALITY), []).collect()
    for r in made:
        n, chars, symbols, dups, repeats = brute_quality(r.text)
        assert (r.quality_n_words, r.quality_word_chars, r.quality_n_symbols, r.quality_n_dup_lines, r.quality_n_repeat_words) == (n, chars, symbols, dups, repeats), r.text
        assert r.quality_base_failed == (n < 10 or 100 * repeats > 20 * n)
        assert r.quality_kept == (not r.quality_base_failed)


def test_quality_signals_of_sample(spark):
    for r in quality.signals(spark.read.parquet(f"{SAMPLE}/documents.parquet")).collect():
        assert (r.quality_n_words, r.quality_word_chars, r.quality_n_symbols, r.quality_n_dup_lines, r.quality_n_repeat_words) == brute_quality(r.text)


def test_decision_list_finds_planted_thresholds():
    rows = [dict.fromkeys(quality.FEATURES, 0.0) | {"bad": 0, "fold": k % 3, "symbol_share": (k % 100) / 200, "upper_share": (k * 7 % 50) / 100} for k in range(600)]
    for r in rows:
        r["bad"] = int(r["symbol_share"] > 0.4 or r["upper_share"] > 0.45)
    rules = quality.learn_list(rows)
    assert rules and all((any(rule.holds(r) for rule in rules)) == bool(r["bad"]) for r in rows)
    assert quality.learn_list([r for r in rows if not r["bad"]]) == [] and quality.learn_list([]) == []


def test_quality_learns_on_held_out_labels(spark):
    docs, labels = (spark.read.parquet(f"/root/testdata/sf0.01/{t}.parquet") for t in ("documents", "labels"))
    train, test = labels.where("doc_id % 4 <> 0"), labels.where("doc_id % 4 = 0")
    judged = quality.judge(docs, quality.learn(docs, train)).join(test, "doc_id").where("not quality_base_failed").collect()
    assert all(r.quality_kept for r in judged if r.quality == 1)
    assert sum(r.quality_kept for r in judged if r.quality == 0) <= 0.1 * len(judged)
    assert quality.learn(docs, labels.where("quality > 5")) == []


def brute_contamination(text, items, window=13):
    w, hit, named = words(text), set(), set()
    for name, item in items:
        x = words(item)
        if not x:
            continue
        k = min(window, len(x))
        for s in range(len(x) - k + 1):
            for i in range(len(w) - k + 1):
                if w[i : i + k] == x[s : s + k]:
                    hit.update(range(i, i + k))
                    named.add(str(name))
    return len(w), len(hit), sorted(named)


def test_decontamination_matches_brute_force(spark):
    passage = " ".join(f"w{k}" for k in range(20))
    items = [(0, passage), (1, "only four short words"), (2, None), (3, "..."), (10, "a b a b a b a b a b a b a b a b"), (11, passage), (12, "zz " * 13)]
    texts = [None, "", passage, passage.upper().replace(" ", "-"), " ".join(passage.split()[:12]), "x " * 300 + passage, "x " * 800 + passage[: len(passage) // 2], "say only FOUR short words. only four short words!", "b a " * 30, passage + " y " + passage, passage, "zz " * 40]
    found = decontamination.contamination(frame(spark, texts), spark.createDataFrame(items, "item_id long, text string")).collect()
    assert len(found) == len(texts)
    for r in found:
        n, hit, named = brute_contamination(r.text, items)
        assert (r.bench_n_words, r.bench_n_hit, r.bench_items) == (n, hit, named), r.text
        assert r.bench_contaminated == (hit > 0 and 20 * hit >= n)
    assert decontamination.clean(frame(spark, texts), spark.createDataFrame(items, "item_id long, text string")).count() == sum(not r.bench_contaminated for r in found)


def test_decontamination_in_blocks_and_without_items(spark, monkeypatch):
    monkeypatch.setattr(decontamination, "BLOCK", 6)
    passage = " ".join(f"w{k}" for k in range(40))
    items = spark.createDataFrame([(0, passage)], "item_id long, text string")
    row = decontamination.contamination(frame(spark, [passage + " tail"]), items).first()
    assert (row.bench_n_hit, row.bench_items) == (40, ["0"])
    row = decontamination.contamination(frame(spark, [passage]), items.limit(0)).first()
    assert (row.bench_n_hit, row.bench_items, row.bench_contaminated) == (0, [], False)
    assert hashlib.sha256(b"").hexdigest() == spark.range(1).select(F.sha2(F.lit(""), 256)).first()[0]


def test_extra_columns_with_clashing_names(spark):
    names = ("own_id", "own_hash", "words", "n_words", "labels", "base", "size", "target", "quality", "component_id", "fingerprint", "shard", "curve")
    docs = frame(spark, ["under the mit license", None]).select("doc_id", "text", "source", *(F.lit("x").alias(n) for n in names))
    items = spark.createDataFrame([(0, "the mit license")], "item_id long, text string")
    assert [r.bench_n_hit for r in decontamination.contamination(docs, items).orderBy("doc_id").collect()] == [3, 0]
    assert licenses.scan(docs).count() == quality.judge(docs, []).count() == 2
    assert decontamination.clean(docs, items).columns == docs.columns


def test_proximity_matches(spark):
    passage = [f"w{k}" for k in range(13)]
    near = passage[:6] + ["inserted"] + passage[6:]
    row = decontamination.contamination(frame(spark, [" ".join(near)]), spark.createDataFrame([(0, " ".join(passage))], "item_id long, text string")).first()
    assert row.bench_n_hit == 0 and row.bench_n_near >= 1
