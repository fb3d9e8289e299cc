"""A discourse study: which texts speak of a set of terms, how often, and in what words.

``Discourse`` holds the texts and the terms. Every result is a property that is computed when first
asked for; those that others build on are stored in the shared folder, so nothing is computed twice
and a lost executor costs a re-read. ``save`` writes results for good.
"""

from __future__ import annotations

from collections.abc import Sequence
from functools import cached_property

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from farglass.operators import collocation, search
from farglass.runtime import materialise
from farglass.sources.tables import write_table

RESULTS = ("documents", "sentences", "mention_counts", "shares", "term_ranks", "terms_over_time", "phrases", "phrase_counts")


class Discourse:
    """Texts (id, year, text and whatever else) that mention any of the terms.

    ``terms`` are lower-case words or phrases; a text speaks of them if it holds one between white
    space or closing marks. ``required`` lists terms of which a text must hold at least one besides.
    """

    def __init__(self, texts: DataFrame, terms: Sequence[str], *, required: Sequence[str] = (), stop_words: Sequence[str] = (), longest: int = 2, min_sentences: int = 2, years: int = 3):
        if not terms:
            raise ValueError("a discourse has at least one term")
        self.texts, self.terms, self.required = texts, list(terms), list(required)
        self.stop_words, self.longest, self.min_sentences, self.years = list(stop_words), longest, min_sentences, years

    @cached_property
    def documents(self) -> DataFrame:
        """The texts that speak of the terms, lower-cased."""
        low = self.texts.withColumn("text", F.lower("text"))
        found = low.where(F.col("text").rlike(search.wordish(self.terms)))
        found = found.where(F.col("text").rlike(search.wordish(self.required))) if self.required else found
        return materialise(found, "discourse_documents")

    @cached_property
    def sentences(self) -> DataFrame:
        """``id, year, pos, sentence, words`` of the documents."""
        cut = search.sentences(self.documents, ["id", "year"], "text")
        return materialise(cut.withColumn("words", collocation.tokens(F.col("sentence"), self.stop_words)), "discourse_sentences")

    @cached_property
    def mentions(self) -> DataFrame:
        """The sentences that hold a term."""
        return materialise(search.mentions(self.sentences, self.terms), "discourse_mentions")

    @property
    def mention_counts(self) -> DataFrame:
        """``year, n_documents, n_sentences`` of the mentions."""
        return self.mentions.groupBy("year").agg(F.count_distinct("id").alias("n_documents"), F.count("*").alias("n_sentences"))

    @property
    def shares(self) -> DataFrame:
        """``year, n, total, share``: documents of a year and their part of all texts."""
        total = self.texts.groupBy("year").agg(F.count("*").alias("total"))
        counts = self.documents.groupBy("year").agg(F.count("*").alias("n"))
        return total.join(counts, "year", "left").select("year", F.coalesce("n", F.lit(0)).alias("n"), "total").withColumn("share", F.try_divide("n", "total"))

    @cached_property
    def _scored(self) -> DataFrame:
        single = [t for t in self.terms if len(t.split()) <= self.longest]
        return materialise(collocation.scored_pairs(self.sentences, "words", ["year"], single, self.longest, self.min_sentences), "discourse_pmi")

    @cached_property
    def term_ranks(self) -> DataFrame:
        """``year, ngram, pmi, freq, rank``: what stands with the terms, by year."""
        return materialise(collocation.combine_terms(self._scored, ["year"]), "discourse_ranks")

    @property
    def terms_over_time(self) -> DataFrame:
        """First year, number of years, spread of ranks and mean PMI of each n-gram."""
        return collocation.over_time(self.term_ranks)

    @cached_property
    def phrases(self) -> DataFrame:
        """``id, pos, at, phrase, term``: the words around each place of a one-word term."""
        found = None
        for term in (t for t in self.terms if " " not in t):
            one = collocation.term_patterns(self.mentions, ["id", "year", "pos"], "words", term).withColumn("term", F.lit(term))
            found = one if found is None else found.unionByName(one)
        return materialise(found if found is not None else self.mentions.select("id", "year", "pos").withColumns({"at": F.lit(0), "phrase": F.lit(""), "term": F.lit("")}).limit(0), "discourse_phrases")

    @property
    def phrase_counts(self) -> DataFrame:
        """``period, phrase, n`` in runs of ``years`` years."""
        return search.period_chunks(self.phrases, "year", self.years).groupBy("period", "phrase").agg(F.count("*").alias("n"))

    def texts_with(self, words: Sequence[str]) -> DataFrame:
        """Documents that hold all of the words."""
        return self.documents.where(search.has_all(F.col("text"), list(words)))

    def save(self, folder: str, names: Sequence[str] = RESULTS) -> None:
        """Write results as Parquet below a folder, one for each name."""
        unknown = set(names) - set(RESULTS)
        if unknown:
            raise ValueError(f"no results named {', '.join(sorted(unknown))}")
        for name in names:
            write_table(getattr(self, name), f"{folder.rstrip('/')}/{name}")
