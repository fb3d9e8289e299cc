"""Lemmas mined from endings and names told by capitals, on a made corpus."""

import random

from farglass.operators import morphology

STEMS = ["walk", "jump", "talk", "play", "turn", "learn", "help", "work", "look", "call", "open", "paint", "clean", "start", "visit", "listen", "answer", "watch", "plant", "print", "boat", "tree", "farm", "lamp", "desk"]


def corpus():
    rng = random.Random(3)
    verbs, nouns = STEMS[:20], STEMS[20:]
    rows = []
    for i in range(2500):
        v, n = rng.choice(verbs), rng.choice(nouns)
        rows.append((i, f"They {v}{rng.choice(['', 'ing', 'ed', 's'])} the {n}{rng.choice(['', 's'])} of {rng.choice(['Marta', 'Oslo', 'paris'])} and bless it. Oslo {v}{rng.choice(['', 's', 'ing'])}"))
    return rows


def tables(spark):
    rows = spark.createDataFrame(corpus(), "id long, text string")
    words = rows.selectExpr("id", "filter(split(lower(text), '[^a-z]+'), w -> w <> '') as words")
    return rows, words


def test_lemmas_of_a_made_corpus(spark):
    _, words = tables(spark)
    steps = morphology.lemmas(morphology.vocabulary(words, "words"), stems=5, support=5)
    got = {r.word: r.lemma for r in steps.collect()}
    for v in STEMS[:20]:
        assert got[f"{v}ing"] == got[f"{v}ed"] == got[f"{v}s"] == v
    assert all(got[f"{n}s"] == n for n in STEMS[20:]) and not {"walk", "tree", "bless", "the"} & set(got)


def test_steps_are_followed_to_their_end(spark):
    words = [f"{s}{e}" for s in STEMS for e in ("", "ing", "ings")]
    table = spark.createDataFrame([(w, 5) for w in words], "word string, n long")
    got = {r.word: r.lemma for r in morphology.lemmas(table, stems=5, support=5).collect()}
    assert all(got[f"{s}ings"] == got[f"{s}ing"] == s for s in STEMS)


def test_names_and_clean_tokens(spark):
    rows, words = tables(spark)
    sentences = rows.selectExpr("explode(split(text, '[.] ')) as sentence")
    names = morphology.name_words(sentences, "sentence")
    assert {r.word for r in names.collect()} == {"marta", "oslo"}  # Oslo and They also begin sentences; paris is not capital
    lemma = morphology.lemmas(morphology.vocabulary(words, "words"), stems=5, support=5)
    more = words.unionByName(spark.createDataFrame([(9000, []), (9001, None), (9002, ["oslo"]), (9003, ["walks", "unseen", "walks"])], "id long, words array<string>"))
    got = {r.id: r.words for r in morphology.clean_tokens(more, "id", "words", lemma, names).collect()}
    assert got[9000] == got[9001] == got[9002] == [] and got[9003] == ["walk", "unseen", "walk"] and len(got) == 2504
    assert not any({"marta", "oslo", "walking"} & set(ws) for ws in got.values())


def test_nothing(spark):
    empty = spark.createDataFrame([], "id long, words array<string>")
    assert morphology.lemmas(morphology.vocabulary(empty, "words")).collect() == []
