"""Data checks: schema and row differences, null shares, duplicates."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def null_shares(table: DataFrame) -> DataFrame:
    """``column, percent_null`` in one pass over the table."""
    shares = table.agg(*(F.round(F.coalesce(F.avg(F.col(f"`{c}`").isNull().cast("int")), F.lit(0.0)) * 100, 6).alias(c) for c in table.columns))
    return shares.unpivot([], table.columns, "column", "percent_null")


def snapshot_diff(old: dict[str, DataFrame], new: dict[str, DataFrame]) -> DataFrame:
    """``table, in_old, in_new, n_old, n_new, columns_gone, columns_added`` for two sets of tables."""
    spark = next(iter((old | new).values())).sparkSession
    rows = []
    for name in sorted(old.keys() | new.keys()):
        a, b = old.get(name), new.get(name)
        ca, cb = set(a.columns if a else ()), set(b.columns if b else ())
        rows.append((name, a is not None, b is not None, a.count() if a else None, b.count() if b else None, sorted(ca - cb), sorted(cb - ca)))
    return spark.createDataFrame(rows, "table string, in_old boolean, in_new boolean, n_old long, n_new long, columns_gone array<string>, columns_added array<string>")


def duplicates(table: DataFrame, keys: Sequence[str]) -> DataFrame:
    """All rows whose keys are there more than once, with their number."""
    counted = table.withColumn("n_copies", F.count("*").over(Window.partitionBy(*keys)))
    return counted.where("n_copies > 1")
