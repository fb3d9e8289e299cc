"""Functions for SQL text: a partitioned table function and an aggregate, both in Python.

``register(spark)`` makes them known to ``spark.sql``. The table function keeps one run of its partition
at a time; the aggregate gets a group as Arrow batches and is meant for groups of bounded size.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Row, SparkSession
from pyspark.sql import functions as F


class Runs:
    """Runs of rows with one ``kind`` in a partition that comes in order: ``owner, kind, n, total``."""

    def __init__(self):
        self.now = None

    def eval(self, row: Row) -> Iterator[tuple]:
        owner, kind, value = row["owner"], row["kind"], row["value"] or 0.0
        if self.now and self.now[1] == kind:
            self.now = (owner, kind, self.now[2] + 1, self.now[3] + value)
        else:
            if self.now:
                yield self.now
            self.now = (owner, kind, 1, value)

    def terminate(self) -> Iterator[tuple]:
        if self.now:
            yield self.now


def median_deviation(values: pd.Series) -> float:
    """Median of the absolute deviations from the median; null for no values."""
    kept = values.dropna()
    return float((kept - kept.median()).abs().median()) if len(kept) else None


def register(spark: SparkSession) -> None:
    """``runs(TABLE(t) PARTITION BY owner ORDER BY ...)`` for a table of ``owner, kind, value``, and
    ``median_deviation(x)``."""
    spark.udtf.register("runs", F.udtf(Runs, returnType="owner long, kind string, n long, total double"))
    spark.udf.register("median_deviation", F.pandas_udf(median_deviation, "double"))
