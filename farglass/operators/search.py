"""Term search over texts and sentences."""

from __future__ import annotations

import re
from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def has_all(text: Column, terms: Sequence[str]) -> Column:
    """Whether all terms are substrings of the text."""
    return reduce(lambda a, b: a & b, (F.contains(text, F.lit(t)) for t in terms))


def match_queries(texts: DataFrame, column: str, queries: Sequence[Sequence[str]]) -> DataFrame:
    """A boolean column ``query_k`` for each query (all its terms) and ``has_any_terms``."""
    flags = {f"query_{k}": F.coalesce(has_all(F.col(column), q), F.lit(False)) for k, q in enumerate(queries)}
    return texts.withColumns(flags).withColumn("has_any_terms", reduce(lambda a, b: a | b, (F.col(k) for k in flags)))


def term_hits(texts: DataFrame, key: str, column: str, terms: Sequence[str]) -> DataFrame:
    """(key, term) for every term that a lower-cased text holds; no matrix is built."""
    low = F.lower(column)
    return texts.select(key, F.explode(F.array_compact(F.array(*(F.when(F.contains(low, F.lit(t)), F.lit(t)) for t in terms)))).alias("term"))


def hits_by_area(texts: DataFrame, key: str, column: str, areas: dict[str, Sequence[str]]) -> DataFrame:
    """(key, area, hits): the terms of each area that are in the text, as ``[a, b]``."""
    low = F.lower(column)
    parts = [F.struct(F.lit(area).alias("area"), F.array_compact(F.array(*(F.when(F.contains(low, F.lit(t)), F.lit(t)) for t in terms))).alias("found")) for area, terms in areas.items()]
    rows = texts.select(key, F.inline(F.array(*parts))).where(F.size("found") > 0)
    return rows.select(key, "area", F.concat(F.lit("["), F.array_join("found", ", "), F.lit("]")).alias("hits"))


def wordish(terms: Sequence[str], literal: bool = True) -> str:
    """A pattern for any of the terms between white space or closing marks."""
    return "|".join(rf"(?:\s|^){re.escape(t) if literal else t}(?:,?\s|\.|$)" for t in terms)


def sentences(texts: DataFrame, keys: Sequence[str], column: str) -> DataFrame:
    """``keys, pos, sentence``: each text cut behind . ! ? and at line ends; blank ones go.

    The text's keys stay with every sentence. The outer explode keeps Spark from inferring a filter
    that would split every text a second time.
    """
    parts = F.filter(F.transform(F.split(F.col(column), r"(?<=[.!?])\s+|\n+"), lambda s: F.trim(s)), lambda s: s != "")
    return texts.select(*keys, F.posexplode_outer(parts).alias("pos", "sentence")).where(F.col("sentence").isNotNull())


def mentions(found: DataFrame, terms: Sequence[str], column: str = "sentence") -> DataFrame:
    """Sentences that hold any of the terms between white space or closing marks."""
    return found.where(F.col(column).rlike(wordish(terms)))


def mention_counts(texts: DataFrame, key: str, year: str, column: str, terms: Sequence[str]) -> DataFrame:
    """``year, term, n_documents, n_sentences`` for every year and term, zeros included."""
    cut = sentences(texts.withColumn(column, F.lower(column)), [key, year], column)
    found = term_hits(cut.withColumn("where", F.struct(key, "pos")), "where", "sentence", terms).select(F.col(f"where.{key}").alias(key), "term")
    counts = found.join(texts.select(key, year), key).groupBy(year, "term").agg(F.count_distinct(key).alias("n_documents"), F.count("*").alias("n_sentences"))
    every = texts.select(year).distinct().select(year, F.explode(F.array(*map(F.lit, terms))).alias("term"))
    return every.join(counts, [year, "term"], "left").fillna(0, ["n_documents", "n_sentences"])


def share_of_baseline(hits: DataFrame, baseline: DataFrame, key: str, category: str, year: str) -> DataFrame:
    """For each year and category the distinct keys and their share of the year's baseline."""
    counts = hits.dropDuplicates([key, category]).groupBy(year, category).agg(F.count("*").alias("n"))
    totals = baseline.groupBy(year).agg(F.count("*").alias("total"))
    return counts.join(totals, year, "left").withColumn("share", F.try_divide("n", "total"))


def period_chunks(rows: DataFrame, year: str, size: int) -> DataFrame:
    """``period``: labels of runs of ``size`` different years, such as 2001-2003."""
    years = rows.select(year).distinct()
    numbered = years.withColumn("chunk", F.floor((F.row_number().over(Window.orderBy(year)) - 1) / size))
    ends = numbered.groupBy("chunk").agg(F.min(year).alias("a"), F.max(year).alias("b"))
    labels = numbered.join(ends, "chunk").select(year, F.concat_ws("-", F.col("a").cast("string"), F.col("b").cast("string")).alias("period"))
    return rows.join(F.broadcast(labels), year)
