"""Lemmas and names learned from the corpus.

Endings are mined: a pair of endings counts how many stems occur with both, and a word goes back to the
shorter form that the best supported pair leads to. Names are words that stand with a capital letter
where no sentence begins. Both need counts of different words only; texts are read once for each and
not shuffled.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from farglass.runtime import lookup, materialise

#: Longest ending and shortest stem.
ENDING, STEM = 4, 3


def vocabulary(texts: DataFrame, words: str, least: int = 2) -> DataFrame:
    """``word, n`` of the words that occur ``least`` times or more."""
    return texts.select(F.explode(words).alias("word")).groupBy("word").agg(F.count("*").alias("n")).where(F.col("n") >= least)


def _splits(words: DataFrame) -> DataFrame:
    """``word, n, stem, ending`` for endings of 0 to ``ENDING`` letters behind ``STEM`` or more."""
    longest = F.least(F.lit(ENDING), F.char_length("word") - STEM)
    cut = words.where(F.char_length("word") >= STEM).select("word", "n", F.explode(F.sequence(F.lit(0), longest)).alias("k"))
    return cut.select("word", "n", F.expr("left(word, char_length(word) - k)").alias("stem"), F.expr("right(word, k)").alias("ending"))


def ending_pairs(words: DataFrame, *, stems: int = 30, support: int = 20) -> tuple[DataFrame, DataFrame]:
    """Pairs of endings, ``longer, shorter, support`` (stems that occur with both), and the splits they are from.

    Only endings that ``stems`` or more stems have are paired, so a stem has few of them whatever it is.
    """
    splits = materialise(_splits(words), "splits")
    common = materialise(splits.groupBy("ending").agg(F.count("*").alias("n_stems")).where(F.col("n_stems") >= stems).select("ending"), "common_endings")
    kept = materialise(lookup(splits, common, "ending"), "common_splits")
    both = kept.select("stem", F.col("ending").alias("longer")).join(kept.select("stem", F.col("ending").alias("shorter")), "stem")
    both = both.where(F.char_length("longer") > F.char_length("shorter"))
    return materialise(both.groupBy("longer", "shorter").agg(F.count("*").alias("support")).where(F.col("support") >= support), "ending_pairs"), kept


def lemma_steps(words: DataFrame, *, stems: int = 30, support: int = 20) -> DataFrame:
    """``word, lemma, support`` for words that lead to another one: by the pair of most support, then the
    longest stem, then the first ending. Only words as frequent as a tenth of the word are led to."""
    pairs, splits = ending_pairs(words, stems=stems, support=support)
    long = splits.select("stem", "word", "n", F.col("ending").alias("longer"))
    short = splits.select("stem", F.col("word").alias("lemma"), F.col("n").alias("lemma_n"), F.col("ending").alias("shorter"))
    led = long.join(short, "stem").where((F.char_length("longer") > F.char_length("shorter")) & (F.col("lemma_n") * 10 >= F.col("n")))
    led = lookup(materialise(led, "led"), pairs, "longer", "shorter")
    best = led.groupBy("word").agg(F.min(F.struct((-F.col("support")).alias("s"), (-F.char_length("stem")).alias("l"), "shorter", "lemma")).alias("x"))
    return best.select("word", F.col("x.lemma").alias("lemma"), (-F.col("x.s")).alias("support"))


def lemmas(words: DataFrame, *, stems: int = 30, support: int = 20) -> DataFrame:
    """``word, lemma`` for words that have one: steps are followed to their end, doubling at each round.

    A step always leads to a shorter word, so there are no circles.
    """
    now = materialise(lemma_steps(words, stems=stems, support=support).select("word", "lemma"), "lemmas")
    while True:
        onward = now.select(F.col("word").alias("lemma"), F.col("lemma").alias("further"))
        after = materialise(now.join(onward, "lemma", "left").select("word", F.coalesce("further", "lemma").alias("lemma"), F.col("further").isNotNull().alias("moved")), "lemmas")
        if after.where("moved").isEmpty():
            return after.select("word", "lemma")
        now = after.select("word", "lemma")


def name_words(sentences: DataFrame, column: str, *, least: int = 3, share: float = 0.9) -> DataFrame:
    """``word, n, n_capital``: lower-cased words that stand within sentences ``least`` times or more and
    have a capital there in ``share`` of the cases. A sentence's first word tells nothing."""
    inner = F.slice(F.filter(F.split(column, r"[^\p{L}']+"), lambda w: w != ""), 2, F.char_length(F.coalesce(column, F.lit(""))) + 1)
    words = sentences.select(F.explode(inner).alias("w"))
    counts = words.groupBy(F.lower("w").alias("word")).agg(F.count("*").alias("n"), F.count(F.when(F.col("w").rlike(r"^\p{Lu}"), 1)).alias("n_capital"))
    return counts.where((F.col("n") >= least) & (F.col("n_capital") >= F.col("n") * share))


def clean_tokens(texts: DataFrame, key: str, words: str, lemma: DataFrame, names: DataFrame) -> DataFrame:
    """``key, <words>``: tokens in order, without names, each as its lemma. A text without tokens keeps an
    empty array.

    Words meet the tables once for each text and different word; the array is put together from a map.
    """
    table = lemma.select("word", "lemma").unionByName(names.select("word", F.lit(None).cast("string").alias("lemma")))
    # A name is dropped even where it has a lemma.
    table = materialise(table.groupBy("word").agg(F.when(F.count("lemma") == F.count("*"), F.max("lemma")).alias("lemma")), "word_table")
    ids = materialise(texts.select(F.monotonically_increasing_id().alias("_row"), F.col(key), F.col(words)), "token_rows")
    opened = materialise(ids.select("_row", F.explode(F.array_distinct(words)).alias("word")), "different_words")
    known = lookup(opened, table, "word").groupBy("_row").agg(F.map_from_entries(F.collect_list(F.struct("word", F.coalesce("lemma", F.lit("")).alias("lemma")))).alias("_map"))
    joined = ids.join(known, "_row", "left")
    changed = F.transform(words, lambda w: F.coalesce(F.try_element_at("_map", w), w))
    return joined.select(key, F.coalesce(F.filter(changed, lambda w: w != ""), F.array().cast("array<string>")).alias(words))
