"""Reshaping: delimited text to rows, wide to long and back, indicator columns."""

from __future__ import annotations

import re
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def split_trim(text: Column, separator: str = ",") -> Column:
    """Trimmed parts of a text, empty ones kept; null gives an empty array."""
    return F.coalesce(F.transform(F.split(text, re.escape(separator)), lambda x: F.trim(x)), F.array().cast("array<string>"))


def explode_list(table: DataFrame, key: str, column: str, separator: str = ",") -> DataFrame:
    """Distinct (key, part) rows of a delimited column; a null column is one row with null."""
    parts = F.transform(F.split(F.col(column), re.escape(separator)), lambda x: F.trim(x))
    return table.select(key, F.explode_outer(parts).alias(column)).distinct()


def explode_parallel(table: DataFrame, keep: Sequence[str], columns: Sequence[str], guarded: str, separator: str = ";") -> DataFrame:
    """Rows of several lists that run in step. Where the guarded list's length differs from the
    first one's, its values are null in all rows."""
    arrays = {c: F.split(F.col(c), re.escape(separator)) for c in columns}
    first = arrays[columns[0]]
    arrays[guarded] = F.when(F.size(first) == F.size(arrays[guarded]), arrays[guarded])
    # A null array would make the zip null, so the guarded one becomes a list of nulls.
    arrays[guarded] = F.coalesce(arrays[guarded], F.transform(first, lambda _: F.lit(None).cast("string")))
    zipped = F.arrays_zip(*(a.alias(c) for c, a in arrays.items()))
    return table.select(*keep, F.explode(zipped).alias("z")).select(*keep, *(F.trim(F.col("z")[c]).alias(c) for c in columns))


def yearly_values(table: DataFrame, key: str, column: str, years: Sequence[int] | None = None, separator: str = ";") -> DataFrame:
    """(key, year, value) rows of a column such as "METRIC (2016,2017)" with a text for each year."""
    if years is None:
        years = [int(y) for y in re.findall(r"\d{4}", column[column.index("(") :])]
    values = F.split(F.col(f"`{column}`"), re.escape(separator))
    zipped = F.arrays_zip(F.array(*map(F.lit, years)).alias("year"), values.alias("value"))
    return table.where(F.col(f"`{column}`").isNotNull()).select(key, F.inline(zipped)).select(key, "year", F.expr("try_cast(trim(value) as double)").alias("value")).where("year is not null and value is not null")


def indicator_name(value: str, prefix: str) -> str:
    return prefix + re.sub(r"\W+", "_", value.lower()).strip("_")


def one_hot(pairs: DataFrame, key: str, column: str, values: Sequence[str], prefix: str = "") -> DataFrame:
    """A count column for each value, named by it; more than 1 where a pair repeats."""
    return pairs.groupBy(key).agg(*(F.count(F.when(F.col(column) == v, 1)).alias(indicator_name(v, prefix)) for v in values))


def binarise(table: DataFrame, labels: str, values: Sequence[str], veto: str | None = None) -> DataFrame:
    """0/1 columns for the labels of an array; a row with the veto label has none."""
    free = ~F.array_contains(labels, veto) if veto else F.lit(True)
    return table.withColumns({v: F.coalesce((F.array_contains(labels, v) & free).cast("int"), F.lit(0)) for v in values})


def to_labels(table: DataFrame, columns: Sequence[str], out: str) -> DataFrame:
    """Names of the columns that are 1; null where none is."""
    names = F.array_compact(F.array(*(F.when(F.col(c) == 1, F.lit(c)) for c in columns)))
    return table.withColumn(out, F.when(F.size(names) > 0, names))


def label_counts(table: DataFrame, labels: str, none: str = "not_relevant") -> DataFrame:
    """Rows for each label, with a bucket for rows without labels."""
    return table.select(F.explode_outer(labels).alias("label")).groupBy(F.coalesce("label", F.lit(none)).alias("label")).agg(F.count("*").alias("n"))


def drop_columns(table: DataFrame, substrings: Sequence[str]) -> DataFrame:
    """Without the columns whose name holds any of the substrings."""
    return table.drop(*(c for c in table.columns if any(s in c for s in substrings)))


def tidy_names(table: DataFrame) -> DataFrame:
    """Column names in lower case with underscores for spaces."""
    return table.toDF(*(c.replace(" ", "_").lower() for c in table.columns))


def recode_list(values: Column, mapping: dict[str, str]) -> Column:
    """Array with its values recoded, unmapped ones left out, each once."""
    table = F.create_map(*(F.lit(x) for pair in mapping.items() for x in pair))
    return F.array_distinct(F.array_compact(F.transform(values, lambda v: F.try_element_at(table, v))))


def parents(values: Column, mapping: dict[str, list[str]], sentinel: str) -> Column:
    """Distinct parent groups of an array's values, a value itself where it has none; a null array is
    the sentinel alone."""
    pairs = [x for k, v in mapping.items() for x in (F.lit(k), F.array(*map(F.lit, v)))]
    table = F.create_map(*pairs)
    found = F.array_distinct(F.flatten(F.transform(values, lambda v: F.coalesce(F.try_element_at(table, v), F.array(v)))))
    return F.coalesce(found, F.array(F.lit(sentinel)))
