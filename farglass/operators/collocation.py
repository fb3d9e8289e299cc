"""Tokens, phrases and collocation statistics over sentence tables.

The long table (sentence, ngram, tf) takes the place of a document-term matrix; the year stays a
column throughout, so all years are worked on at once.
"""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from farglass.runtime import materialise


def tokens(text: Column, stop_words: Sequence[str] = (), least: int = 2) -> Column:
    """Lower-case letter tokens that are not links, stop words or too short."""
    bare = F.regexp_replace(F.lower(text), r"https?://\S+|www\.\S+", " ")
    found = F.filter(F.split(bare, r"[^\p{L}']+"), lambda w: F.char_length(w) >= least)
    return F.filter(found, lambda w: ~w.isin(list(stop_words))) if stop_words else found


def ngrams(words: Column, longest: int = 2) -> Column:
    """All runs of one to ``longest`` words, joined by spaces.

    Shifted copies of the array are zipped: a slice for each place would copy the array each time, so
    that a text of one long sentence took the square of its length.
    """
    def runs(n: int) -> Column:
        if n == 1:
            return words
        many = F.size(words) - (n - 1)
        made = F.slice(words, 1, F.greatest(many, F.lit(0)))
        for k in range(1, n):
            made = F.zip_with(made, F.slice(words, k + 1, F.greatest(many, F.lit(0))), lambda x, y: F.concat_ws(" ", x, y))
        return F.when(many > 0, made).otherwise(F.array().cast("array<string>"))

    return F.flatten(F.array(*(runs(n) for n in range(1, longest + 1))))


def _term_rows(sentences: DataFrame, keys: Sequence[str], words: str, longest: int) -> DataFrame:
    """``keys, ngram, tf``. Sentences are dealt out whole, so their n-grams are counted where they are opened."""
    dealt = sentences.select(*keys, words).repartition(*keys)
    return dealt.select(*keys, F.explode(ngrams(F.col(words), longest)).alias("ngram")).groupBy(*keys, "ngram").agg(F.count("*").alias("tf"))


def term_table(sentences: DataFrame, keys: Sequence[str], words: str, longest: int = 2, min_sentences: int = 2) -> DataFrame:
    """``keys, ngram, tf`` of the n-grams that are in ``min_sentences`` sentences or more."""
    rows = _term_rows(sentences, keys, words, longest)
    known = rows.groupBy("ngram").agg(F.count("*").alias("n")).where(F.col("n") >= min_sentences).select("ngram")
    return rows.join(known, "ngram", "left_semi")


def term_totals(sentences: DataFrame, keys: Sequence[str], words: str, longest: int = 2, min_sentences: int = 2) -> DataFrame:
    """``ngram, n_sentences, total``: the sums of ``term_table``, which is not made for them."""
    sums = _term_rows(sentences, keys, words, longest).groupBy("ngram").agg(F.count("*").alias("n_sentences"), F.sum("tf").alias("total"))
    return sums.where(F.col("n_sentences") >= min_sentences)


def cooccurrence(table: DataFrame, keys: Sequence[str], by: Sequence[str], terms: Sequence[str]) -> DataFrame:
    """``by, term, ngram, both``: summed products of frequencies in the same sentence.

    The left side holds the search terms alone, so the join has at most the sentence's n-grams for
    each of them.
    """
    left = table.where(F.col("ngram").isin(list(terms))).select(*keys, F.col("ngram").alias("term"), F.col("tf").alias("tf1"))
    return left.join(table, list(keys)).where("term <> ngram").groupBy(*by, "term", "ngram").agg(F.sum(F.col("tf1") * F.col("tf")).alias("both"))


def positive_pmi(table: DataFrame, pairs: DataFrame, n_sentences: DataFrame, by: Sequence[str], least: int = 1, power: float = 0.75) -> DataFrame:
    """Pairs with ``pmi`` above 0: log2 of the joint share over the shares, the context's share
    raised to ``power``. ``n_sentences`` has the sentences of each ``by`` group as ``n``."""
    totals = table.groupBy(*by, "ngram").agg(F.sum("tf").alias("total"))
    return _positive(totals, pairs.where(F.col("both") >= least), n_sentences, by, power)


def _positive(totals: DataFrame, pairs: DataFrame, n_sentences: DataFrame, by: Sequence[str], power: float) -> DataFrame:
    """``pairs`` with the contexts' totals as ``n2`` have no need of the second join."""
    joined = pairs if "n2" in pairs.columns else pairs.join(totals.withColumnRenamed("total", "n2"), [*by, "ngram"])
    ends = totals.withColumnsRenamed({"ngram": "term", "total": "n1"})
    joined = joined.join(ends, [*by, "term"])
    joined = joined.join(n_sentences, list(by)) if by else joined.crossJoin(F.broadcast(n_sentences))  # one row
    n = F.col("n").cast("double")
    pmi = F.log2((F.col("both") / n) / ((F.col("n1") / n) * (F.pow("n2", F.lit(power)) / F.pow(n, F.lit(power)))))
    return joined.withColumn("pmi", pmi).where("pmi > 0").select(*by, "term", "ngram", "both", "pmi")


def _runs(words: str, longest: int) -> Column:
    """At each place the words ``w1``, ``w2``, ... from there on, null behind the last one."""
    return F.arrays_zip(*(F.slice(words, k, F.greatest(F.size(words), F.lit(1))).alias(f"w{k}") for k in range(1, longest + 1)))


def _shorter(runs: DataFrame, by: Sequence[str], longest: int, **sums: Column) -> DataFrame:
    """``by, ngram, ..`` from aggregated runs: the whole ones, and shorter n-grams as sums over what follows."""
    parts = []
    for n in range(longest, 0, -1):
        names = [f"w{k}" for k in range(1, n + 1)]
        if n < longest:
            runs = runs.groupBy(*by, *names).agg(*(f.alias(name) for name, f in sums.items()))
        parts.append(runs.where(F.col(names[-1]).isNotNull()).select(*by, F.concat_ws(" ", *names).alias("ngram"), *sums))
    return reduce(DataFrame.union, parts)


def term_counts(sentences: DataFrame, words: str, by: Sequence[str], longest: int = 2, min_sentences: int = 2) -> DataFrame:
    """``by, ngram, total``: occurrences of the n-grams that are in ``min_sentences`` sentences or more.

    One row for each place, with the run of words that begins there; shorter n-grams are sums over
    longer ones. Whether one is in two sentences is told by the least and greatest sentence that have
    it; a higher ``min_sentences`` needs their number. The result is stored.
    """
    if min_sentences > 2:
        made = sentences.select(*by, ngrams(F.col(words), longest).alias("all"))
        counted = F.concat(
            F.transform("all", lambda x: F.struct(x.alias("ngram"), F.lit(1).alias("one"), F.lit(0).alias("sentence"))),
            F.transform(F.array_distinct("all"), lambda x: F.struct(x.alias("ngram"), F.lit(0).alias("one"), F.lit(1).alias("sentence"))),
        )
        sums = made.select(*by, F.inline_outer(counted)).where(F.col("ngram").isNotNull()).groupBy(*by, "ngram").agg(F.sum("one").alias("total"), F.sum("sentence").alias("sentences"))
        sums = materialise(sums, "ngram_sums")
        known = sums.groupBy("ngram").agg(F.sum("sentences").alias("n")).where(F.col("n") >= min_sentences).select("ngram")
        return materialise(sums.join(known, "ngram", "left_semi").select(*by, "ngram", "total"), "ngram_totals")
    # The number of a sentence lies in its row: each is made once, in whatever order.
    opened = sentences.select(*by, words, F.monotonically_increasing_id().alias("_s")).select(*by, "_s", F.inline_outer(_runs(words, longest))).where(F.col("w1").isNotNull())
    runs = opened.groupBy(*by, *(f"w{k}" for k in range(1, longest + 1))).agg(F.count("*").alias("total"), F.min("_s").alias("low"), F.max("_s").alias("high"))
    runs = materialise(runs, "run_sums")
    sums = _shorter(runs, by, longest, total=F.sum("total"), low=F.min("low"), high=F.max("high"))
    if min_sentences < 2:
        return materialise(sums.select(*by, "ngram", "total"), "ngram_totals")
    if not by:
        return materialise(sums.where("low <> high").select("ngram", "total"), "ngram_totals")
    # Dealt out once for both sides; an n-gram's rows are as many as the groups that have it, so nothing is sorted.
    dealt = sums.repartition("ngram")
    known = dealt.groupBy("ngram").agg(F.min("low").alias("low"), F.max("high").alias("high")).where("low <> high").select("ngram")
    return materialise(dealt.join(known.hint("shuffle_hash"), "ngram", "left_semi").select(*by, "ngram", "total"), "ngram_totals")


def _term_pairs(sentences: DataFrame, words: str, counts: DataFrame, by: Sequence[str], terms: Sequence[str], longest: int) -> DataFrame:
    """``term_pairs`` with the n-gram's ``total`` as ``n2``."""
    def times(term: str) -> Column:
        parts = term.split(" ")
        held = F.filter(words, lambda x: x == parts[0]) if len(parts) == 1 else F.filter(ngrams(F.col(words), longest), lambda x: x == F.lit(term))
        return F.struct(F.lit(term).alias("term"), F.size(held).alias("n"))

    hits = F.filter(F.array(*map(times, terms)), lambda h: h["n"] > 0)
    opened = sentences.select(*by, words, F.explode_outer(hits).alias("hit")).where(F.col("hit").isNotNull())
    opened = opened.select(*by, F.col("hit.term").alias("term"), F.col("hit.n").alias("n"), F.inline_outer(_runs(words, longest))).where(F.col("w1").isNotNull())
    runs = materialise(opened.groupBy(*by, "term", *(f"w{k}" for k in range(1, longest + 1))).agg(F.sum("n").alias("both")), "term_runs")
    both = _shorter(runs, [*by, "term"], longest, both=F.sum("both")).where("term <> ngram")
    known = counts.where(F.col("ngram").isin(list(terms))).select(F.col("ngram").alias("term")).distinct()  # the terms at most
    return both.hint("shuffle_hash").join(counts.withColumnRenamed("total", "n2"), [*by, "ngram"]).join(F.broadcast(known), "term", "left_semi").select(*by, "term", "ngram", "both", "n2")


def term_pairs(sentences: DataFrame, words: str, counts: DataFrame, by: Sequence[str], terms: Sequence[str], longest: int = 2) -> DataFrame:
    """``by, term, ngram, both`` as ``cooccurrence`` has them, straight from the sentences.

    A sentence's product of frequencies is its occurrences of the n-gram, each counted as often as the
    term occurs. So only sentences with a term are opened, a row for each place, and nothing is joined
    but the n-grams that ``counts`` (``by, ngram, total``) holds.
    """
    return _term_pairs(sentences, words, counts, by, terms, longest).drop("n2")


def scored_pairs(sentences: DataFrame, words: str, by: Sequence[str], terms: Sequence[str], longest: int = 2, min_sentences: int = 2, power: float = 0.75) -> DataFrame:
    """``positive_pmi`` of the terms with all n-grams of their sentences."""
    sentences = materialise(sentences.select(*by, words), "sentence_words")
    counts = term_counts(sentences, words, by, longest, min_sentences)
    pairs = _term_pairs(sentences, words, counts, by, terms, longest)
    ends = counts.where(F.col("ngram").isin(list(terms)))
    return _positive(ends, pairs, sentences.groupBy(*by).agg(F.count("*").alias("n")), by, power)


def ranked(pairs: DataFrame, by: Sequence[str]) -> DataFrame:
    """``rank`` from 0 by falling co-occurrence, and ``share``, the rank over the group's size."""
    group = Window.partitionBy(*by, "term")
    order = group.orderBy(F.desc("both"), "ngram")
    return pairs.withColumn("rank", F.row_number().over(order) - 1).withColumn("share", F.col("rank") / F.count("*").over(group))


def combine_terms(scored: DataFrame, by: Sequence[str], least: int = 2) -> DataFrame:
    """Over all search terms: the greatest PMI and the summed frequency, above ``least``, ranked."""
    best = scored.groupBy(*by, "ngram").agg(F.max("pmi").alias("pmi"), F.sum("both").alias("freq")).where(F.col("freq") > least)
    return best.withColumn("rank", F.row_number().over(Window.partitionBy(*by).orderBy(F.desc("freq"), "ngram")) - 1)


def over_time(combined: DataFrame, year: str = "year") -> DataFrame:
    """First year, years seen, spread of the inverse rank and mean PMI of each n-gram."""
    return combined.groupBy("ngram").agg(
        F.min(year).alias("first_year"), F.count("*").alias("n_years"), F.round(F.stddev_pop(1 / (F.col("rank") + 1)), 3).alias("sd_inverse_rank"), F.round(F.avg("pmi"), 3).alias("mean_pmi")
    )


def phrase_scores(sentences: DataFrame, words: str, min_count: int = 5) -> DataFrame:
    """``a, b, n, npmi`` of neighbouring words.

    Each word is counted with the word behind it (null for the last one) in one pass; words' own
    counts are sums of that, and words too rare for any phrase are left out before they are joined.
    """
    following = F.arrays_zip(F.col(words).alias("a"), F.slice(words, 2, F.greatest(F.size(words), F.lit(1))).alias("b"))
    pairs = materialise(sentences.select(F.inline_outer(following)).where(F.col("a").isNotNull()).groupBy("a", "b").agg(F.count("*").alias("n")), "word_pairs")
    one = pairs.groupBy(F.col("a").alias("x")).agg(F.sum("n").alias("n"))
    total = one.agg(F.sum("n").alias("total"))
    one = materialise(one.where(F.col("n") >= min_count), "word_counts")
    two = pairs.where((F.col("n") >= min_count) & F.col("b").isNotNull())
    joined = two.join(one.select(F.col("x").alias("a"), F.col("n").alias("na")), "a").join(one.select(F.col("x").alias("b"), F.col("n").alias("nb")), "b").crossJoin(F.broadcast(total))
    p = F.col("n") / F.col("total")
    npmi = F.ln(p / ((F.col("na") / F.col("total")) * (F.col("nb") / F.col("total")))) / -F.ln(p)
    return joined.select("a", "b", "n", npmi.alias("npmi"))


def merge_phrases(sentences: DataFrame, words: str, phrases: DataFrame, keys: Sequence[str], separator: str = "_") -> DataFrame:
    """Sentences with accepted neighbours merged, from left to right, a word going into one phrase.

    ``phrases`` (a, b) is joined on the pair, so any number of them will do. In a run of chained
    pairs every other one is merged, beginning with the first.
    """
    # Each word is zipped with the next: the array itself beside every word would be the square of its length.
    following = F.arrays_zip(F.col(words).alias("a"), F.slice(words, 2, F.greatest(F.size(words), F.lit(1))).alias("b"))
    pairs = sentences.where(F.size(words) > 0).select(*keys, F.posexplode(following).alias("i", "ab")).select(*keys, "i", "ab.a", "ab.b")
    known = phrases.select("a", "b").distinct().withColumn("known", F.lit(1))
    flagged = pairs.join(known, ["a", "b"], "left").withColumn("known", F.coalesce("known", F.lit(0)))
    line = Window.partitionBy(*keys).orderBy("i")
    # A run is a maximal row of consecutive known pairs; its pairs 0, 2, 4, ... are merged.
    broken = F.sum(1 - F.col("known")).over(line)
    runs = flagged.withColumn("run", broken).withColumn("at", F.sum("known").over(Window.partitionBy(*keys, "run").orderBy("i")) - 1)
    starts = runs.withColumn("starts", (F.col("known") == 1) & (F.col("at") % 2 == 0))
    taken = starts.withColumn("inside", F.coalesce(F.lag("starts").over(line), F.lit(False)))
    token = F.when(F.col("starts"), F.concat_ws(separator, "a", "b")).otherwise(F.col("a"))
    kept = taken.where(~F.col("inside")).select(*keys, F.struct("i", token.alias("t")).alias("x"))
    return kept.groupBy(*keys).agg(F.transform(F.array_sort(F.collect_list("x")), lambda x: x["t"]).alias(words))


def merge_ngrams(sentences: DataFrame, words: str, keys: Sequence[str], longest: int = 3, min_count: int = 5, threshold: float = 0.35) -> DataFrame:
    """Phrases of up to ``longest`` words: scoring and merging, ``longest`` - 1 times over.

    A phrase that one round has made is a word of the next. Sentences without words are left out.
    """
    for turn in range(longest - 1):
        accepted = phrase_scores(sentences, words, min_count).where(F.col("npmi") > threshold)
        sentences = materialise(merge_phrases(sentences, words, accepted, keys), f"merged_{turn + 1}")
    return sentences


def candidate_phrases(text: Column, stop_words: Sequence[str]) -> Column:
    """Runs of words between stop words and marks: an approximation of noun chunks."""
    cut = F.regexp_replace(F.lower(text), r"(?<![\p{L}])(?:" + "|".join(stop_words) + r")(?![\p{L}])", "|")
    parts = F.transform(F.split(cut, r"[^\p{L}\p{N} '-]+"), lambda p: F.trim(F.regexp_replace(p, r"\s+", " ")))
    return F.filter(parts, lambda p: p != "")


def term_patterns(sentences: DataFrame, keys: Sequence[str], words: str, term: str, widest: int = 2) -> DataFrame:
    """``keys, at, phrase``: each place of a word with up to ``widest`` words before or behind it, the
    longest span for each place; in the place of part-of-speech patterns."""
    at = F.filter(F.transform(F.sequence(F.lit(0), F.size(words) - 1), lambda i: F.when(F.get(words, i) == term, i)), lambda i: i.isNotNull())
    places = sentences.where(F.array_contains(words, term)).select(*keys, words, F.explode(at).alias("at"))
    first = F.greatest(F.col("at") - widest, F.lit(0))
    return places.select(*keys, "at", F.array_join(F.slice(words, first + 1, F.col("at") - first + 1 + widest), " ").alias("phrase"))
