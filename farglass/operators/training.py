"""Training sets: labels for a part of the noise, exact shares of every stratum, and a complement label.

Rows are drawn by their rank in the order of (stratum, hash of the key). Ranks come from a range sort and
prefix sums, so no task holds a stratum, quotas are met to the row and reruns agree.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from farglass.runtime import checked_broadcast, materialise, numbered


def draw(key: str, salt: str) -> Column:
    """What the order within a stratum is made of."""
    return F.md5(F.concat(F.lit(f"{salt}:"), F.coalesce(F.col(key).cast("string"), F.lit(""))))


def quotas(counts: DataFrame, share: float) -> DataFrame:
    """``quota`` of each stratum (``stratum, n``): together ceil(share * all rows), each its exact part
    rounded down, and one more for the largest remainders, of equal ones for the first strata."""
    # A row for each stratum.
    total = counts.withColumn("all", F.sum("n").over(Window.partitionBy()))
    exact = total.withColumn("exact", F.ceil(F.round(F.col("all") * F.lit(share), 9)) * F.col("n") / F.col("all"))
    floors = exact.withColumn("quota", F.floor(F.round("exact", 9))).withColumn("rest", F.round(F.col("exact") - F.col("quota"), 9))
    left = F.ceil(F.round(F.col("all") * F.lit(share), 9)) - F.sum("quota").over(Window.partitionBy())
    order = F.row_number().over(Window.orderBy(F.desc("rest"), F.asc_nulls_first("stratum")))
    return floors.withColumn("quota", F.col("quota") + (order <= left).cast("long")).select("stratum", "n", "quota")


def take_exact(rows: DataFrame, stratum: str, key: str, share: float, *, salt: str = "0", out: str = "taken") -> DataFrame:
    """``rows`` with a flag that is set for ``share`` of each stratum, exactly (see ``quotas``).

    A null stratum is one of its own. Rows that repeat a key are drawn in any order between them.
    """
    ranked = numbered(rows.withColumn("_draw", draw(key, salt)), F.asc_nulls_first(stratum), F.col("_draw"), F.asc_nulls_first(key))
    ranked = materialise(ranked.withColumnRenamed("rank", "_rank").drop("total", "_draw"), "drawn")
    counts = ranked.groupBy(F.col(stratum).alias("stratum")).agg(F.count("*").alias("n"), F.min("_rank").alias("_first"))
    limits = materialise(quotas(counts.select("stratum", "n"), share).join(counts.select(F.col("stratum").alias("s"), "_first"), F.col("stratum").eqNullSafe(F.col("s"))).select("stratum", "quota", "_first"), "quotas")
    found = ranked.join(checked_broadcast(limits), F.col(stratum).eqNullSafe(F.col("stratum")))
    return found.withColumn(out, F.col("_rank") - F.col("_first") < F.col("quota")).select(*rows.columns, out)


def training_sets(rows: DataFrame, key: str, label: str, noise: Column, *, noise_share: float = 0.5, test_share: float = 0.2, salt: str = "0") -> DataFrame:
    """``rows`` with ``label`` (0 or 1), ``not_<label>`` and ``part``: train, test or review.

    ``label`` is 1, 0 or null (not evaluated). Of the rows that ``noise`` names and that are not 1,
    ``noise_share`` are labelled 0. Labelled rows are dealt to train and test by ``test_share`` of each
    label. The others are for review: their label is a hashed coin, their complement 0.
    """
    doubtful = rows.withColumn("_noise", F.coalesce(noise, F.lit(False)) & (F.coalesce(F.col(label), F.lit(-1)) != 1))
    part = take_exact(doubtful.where("_noise").withColumn("_one", F.lit(1)), "_one", key, noise_share, salt=f"{salt}-noise", out="_zero").drop("_one")
    labelled = part.withColumn(label, F.when(F.col("_zero"), F.lit(0)).otherwise(F.col(label))).drop("_zero").unionByName(doubtful.where("not _noise")).drop("_noise")
    labelled = materialise(labelled.withColumn(label, F.col(label).cast("int")), "labelled")
    split = take_exact(labelled.where(F.col(label).isNotNull()), label, key, test_share, salt=f"{salt}-test", out="_test")
    known = split.withColumns({f"not_{label}": 1 - F.col(label), "part": F.when(F.col("_test"), "test").otherwise("train")}).drop("_test")
    coin = F.when(draw(key, f"{salt}-coin").substr(1, 1) < "8", 0).otherwise(1)
    rest = labelled.where(F.col(label).isNull()).withColumns({label: coin, f"not_{label}": F.lit(0), "part": F.lit("review")})
    return known.unionByName(rest)
