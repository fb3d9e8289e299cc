"""Exact quantiles of groups of any size.

Equal values of a group are counted before anything moves; the counts are sorted by range, and running
sums over partitions tell which value holds a wanted rank. No task gathers a group.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from farglass.runtime import checked_broadcast, materialise


def exact_quantiles(rows: DataFrame, by: Sequence[str], value: str, shares: Sequence[float], names: Sequence[str]) -> DataFrame:
    """``by`` and a column of ``names`` for each of ``shares``, linear between the two nearest ranks.

    Null values do not count; a group of nulls alone has null quantiles. Null keys are groups.
    """
    keys = [F.col(c).alias(f"_k{i}") for i, c in enumerate(by)]
    keyed = [f"_k{i}" for i in range(len(by))]
    counts = rows.groupBy(*keys, F.col(value).cast("double").alias("_value")).agg(F.count("*").alias("_n"))
    order = [*(F.col(k).asc_nulls_first() for k in keyed), F.col("_value").asc_nulls_last()]
    ordered = materialise(counts.repartitionByRange(*order).sortWithinPartitions(*order).withColumn("_place", F.monotonically_increasing_id()), "value_counts")
    held = F.when(F.col("_value").isNotNull(), F.col("_n")).otherwise(0)
    ordered = ordered.withColumns({"_part": F.shiftright("_place", 33), "_held": held})
    # A row for each group and partition that has it; a group has few partitions unless it fills them.
    runs = ordered.groupBy(*keyed, "_part").agg(F.sum("_held").alias("_sum"))
    own = Window.partitionBy(*keyed).orderBy("_part")
    bases = runs.select(*keyed, "_part", (F.sum("_sum").over(own) - F.col("_sum")).alias("_base"), F.sum("_sum").over(Window.partitionBy(*keyed)).alias("_total"))
    inside = Window.partitionBy(*keyed, "_part").orderBy("_place").rowsBetween(Window.unboundedPreceding, 0)
    same = [F.col(f"a.{k}").eqNullSafe(F.col(f"b.{k}")) for k in keyed]
    upto = ordered.withColumn("_upto", F.sum("_held").over(inside)).alias("a").join(checked_broadcast(bases).alias("b"), [*same, F.col("a._part") == F.col("b._part")])
    upto = upto.select(*(F.col(f"a.{k}").alias(k) for k in keyed), "_value", "_total", (F.col("_base") + F.col("_upto") - F.col("_held")).alias("_from"), (F.col("_base") + F.col("_upto")).alias("_to"))

    def at(rank):
        """The value that holds a rank from 0."""
        return F.max(F.when((rank >= F.col("_from")) & (rank < F.col("_to")), F.col("_value")))

    sums = []
    for share, name in zip(shares, names, strict=True):
        exact = F.round((F.col("_total") - 1) * F.lit(float(share)), 9)
        sums += [at(F.floor(exact)).alias(f"_low_{name}"), at(F.ceil(exact)).alias(f"_high_{name}"), F.max(exact - F.floor(exact)).alias(f"_part_{name}")]
    found = upto.groupBy(*keyed).agg(*sums)
    return found.select(*(F.col(k).alias(c) for k, c in zip(keyed, by, strict=True)), *((F.col(f"_low_{n}") + (F.col(f"_high_{n}") - F.col(f"_low_{n}")) * F.col(f"_part_{n}")).alias(n) for n in names))
