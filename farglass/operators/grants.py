"""Grants of two sources in one form."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def standardise(rows: DataFrame, *, id: str, org: str, start: str, amount: str, second: bool) -> DataFrame:
    """``id, org_id, start, amount, is_second``."""
    return rows.select(F.col(id).alias("id"), F.col(org).alias("org_id"), F.col(start).alias("start"), F.col(amount).alias("amount"), F.lit(int(second)).alias("is_second"))


def summary(grants: DataFrame) -> DataFrame:
    """Each organisation's number of grants, their total, whether the second source has any, and the
    amount of the last one (by start, then id)."""
    return grants.groupBy("org_id").agg(
        F.count("*").alias("n_grants"), F.coalesce(F.sum("amount"), F.lit(0.0)).alias("total"), F.max("is_second").alias("has_second"), F.max_by("amount", F.struct("start", "id")).alias("last_amount")
    )
