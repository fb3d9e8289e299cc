"""Gates of license rules let every alternative of their patterns pass."""

from re import _constants as c
from re import _parser
import re

from test_words_and_rules import brute_license, frame

from farglass.llm import license_rules, licenses


def samples(parsed, most):
    """A text for each alternative, with the least or the most repeats."""
    made = [""]
    for op, arg in parsed:
        if op is c.LITERAL:
            parts = [chr(arg)]
        elif op is c.IN:
            first = arg[0]
            parts = ["7"] if first[0] is c.CATEGORY else [chr(first[1] if first[0] is c.LITERAL else first[1][0])]
        elif op is c.BRANCH:
            parts = [s for branch in arg[1] for s in samples(branch, most)]
        elif op is c.SUBPATTERN:
            parts = samples(arg[3], most)
        elif op is c.MAX_REPEAT:
            n = min(arg[1], max(arg[0], 1)) if most else arg[0]
            parts = [s * n for s in samples(arg[2], most)] if n else [""]
        else:
            assert op in (c.ASSERT, c.ASSERT_NOT), op
            parts = [""]
        made = [a + b for a in made for b in parts]
    return made


def test_every_alternative_passes_its_gates():
    for r in license_rules.build():
        for most in (False, True):
            for s in set(samples(_parser.parse(r.pattern), most)):
                line = f" {s} "
                assert re.search(r.pattern, line), (r, s)
                assert all(any(a in line for a in g.split("|")) for g in r.gates), (r, s)


LOST = [
    "Licensed under the MPL 2.0", "License: MPL-2.0", "Licensed under the Mozilla Public License 1.1", "Licensed under the Open Software License 3.0", "NCSA license", "Do What The Fuck You Want To Public License",
    "Licensed under Creative Commons Attribution-Non-Commercial 4.0", "Licensed under Creative Commons Attribution Share-Alike 3.0",
]


def test_scan_finds_what_gates_used_to_drop(spark):
    for r in licenses.scan(frame(spark, LOST).drop("license_text")).collect():
        _, _, labels, score = brute_license(r.text)
        assert r.license_labels and (r.license_labels, r.license_score) == (labels, score), r.text


TEXTS = [
    ("Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer.", "bsd"),
    ("This program is distributed in the hope that it will be useful,\n but WITHOUT ANY WARRANTY", "gpl"),
    ("either version 2.1 of the License, or (at your option) any later version.", "lgpl-2.1"),
    ("This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0.", "mpl-2"),
    ("This work is licensed under a Creative Commons Attribution-NonCommercial-ShareAlike 4.0 International License.", "cc-by-nc-sa"),
    ("https://creativecommons.org/licenses/by-nc/4.0/", "cc-by-nc"),
    ("This is free and unencumbered software released into the public domain.", "unlicense"),
    ("To the extent possible under law, Jane Doe has waived all copyright and related or neighboring rights", "cc0-1"),
    ("Unauthorized copying of this file, via any medium is strictly prohibited", "proprietary"),
    ("You may not reverse engineer, decompile or disassemble the product", "eula"),
]


def test_phrases_of_license_texts(spark):
    assert len(license_rules.TEXTS) > 110 and len({r.pattern for r in license_rules.build()}) == len(license_rules.build())
    for r, (text, label) in zip(licenses.scan(frame(spark, [t for t, _ in TEXTS])).orderBy("doc_id").collect(), TEXTS):
        _, _, labels, score = brute_license(text)
        assert label in r["license__labels"] and (r["license__labels"], r["license__score"]) == (labels, score), text


def test_gated_rules_hold_an_anchor():
    for r in license_rules.build():
        for s in set(samples(_parser.parse(r.pattern), False)):
            assert r.base or any(a in f" {s} " for a in licenses.ANCHORS), r


def test_a_text_of_very_many_matches(spark):
    n = 30_000
    docs = spark.createDataFrame([(1, "cc by nc " * n + "licensed under the mit license " * 300)], "doc_id long, text string")
    found = licenses.scan(docs).first().license_found
    kept = [d.first for d in found if d.base]
    assert kept == [3 * i for i in range(n)] + [3 * n + 5 * i + 1 for i in range(300)]
    inside = [(d.first, d.stop) for d in found if d.kept]
    assert all(a[1] <= b[0] for a, b in zip(inside, inside[1:], strict=False))
