"""Mixing sources to target weights.

Tokens (words) are summed by source, targets follow from the weights, and each document comes
floor(rate) times plus one copy that a Bernoulli draw decides, with the rate's fraction as its
probability. The draw is a hash of the seed and the document id, so reruns agree, and documents draw
independently of each other.

So a source's words are its target in the mean, with a standard deviation of at most half the root
of the sum of its documents' squared sizes: a source of many documents comes near its target, one of
a few documents may miss it by half a document or more.

Nulls: a null text has size 0; the null source is a source of its own and comes last; a null id
draws by its text. Repeated rows draw alike. Sources without words have target 0. An empty table
gives no rows. Further columns pass through; where one begins with ``mix_``, the columns added take
another underscore (``columns.free_prefix``).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from farglass.llm.columns import all_of, free_prefix, own
from farglass.llm.words import solid_word_count
from farglass.runtime import checked_broadcast, materialise

SEED = 0
PREFIX = "mix_"


def draw(id_col: Column, text_col: Column, seed: int = SEED) -> Column:
    """A number in [0, 1) of 32 bits of the MD5 of ``seed:id``; without an id its text's MD5 stands for it."""
    name = F.coalesce(id_col.cast("string"), F.concat(F.lit("null:"), F.md5(F.coalesce(text_col, F.lit("")))))
    hashed = F.md5(F.concat_ws(":", F.lit(str(seed)), name))
    return F.conv(F.substring(hashed, 1, 8), 16, 10).cast("long") / F.lit(4294967296.0)


def source_targets(sizes: DataFrame, weights: tuple[int, ...], share: float, most: float) -> DataFrame:
    """Targets by source: ``source, source_size, target``.

    Sources in code point order, null last, get the weights in turn. ``share`` times all words is
    dealt out by weight; a target above ``most`` times its source is cut to that, and the excess is
    dealt to the others by weight again until none is above. With sources in rising order of the
    cap for each weight, that is one water level: the first source whose cap is over the level of
    what is left ends the capped ones. ``sizes`` has a row for each source, so the one-task window
    holds source names and never documents.
    """
    order = Window.orderBy(F.col("source").asc_nulls_last())
    weight = F.element_at(F.array(*map(F.lit, weights)), (F.row_number().over(order) - 1) % len(weights) + 1)
    named = sizes.withColumn("weight", weight.cast("double")).withColumn("cap", F.col("source_size") * F.lit(float(most)))
    everything = Window.partitionBy()
    rising = Window.orderBy(F.col("cap") / F.col("weight"), F.col("source").asc_nulls_last()).rowsBetween(Window.unboundedPreceding, -1)
    left = F.lit(float(share)) * F.sum("source_size").over(everything) - F.coalesce(F.sum("cap").over(rising), F.lit(0.0))
    weights_left = F.sum("weight").over(everything) - F.coalesce(F.sum("weight").over(rising), F.lit(0.0))
    level = named.withColumn("level", left / weights_left).withColumn("open", F.col("cap") > F.col("level") * F.col("weight"))
    first = F.max(F.when(F.col("open"), F.col("level"))).over(everything)  # levels rise up to the first open source and fall after it
    return level.withColumn("target", F.coalesce(F.least("cap", F.col("weight") * first), F.col("cap"))).select("source", "source_size", "target")


def plan_mix(docs: DataFrame, *, text_col: str, source_col: str, weights: tuple[int, ...], share: float, most: float) -> DataFrame:
    """Rates by source: ``source, source_size, target, rate``."""
    sizes = docs.select(own(source_col).alias("source"), solid_word_count(own(text_col)).alias("size")).groupBy("source").agg(F.sum("size").alias("source_size"))
    targets = source_targets(materialise(sizes, "source_sizes"), weights, share, most)
    rate = F.coalesce(F.least(F.try_divide("target", "source_size"), F.lit(float(most))), F.lit(0.0))
    return materialise(targets.withColumn("rate", rate), "mix_plan")


def mix(
    docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", weights: tuple[int, ...] = (3, 1, 2), share: float = 1.5, most: float = 2.0, seed: int = SEED
) -> DataFrame:
    """The documents with ``mix_size, mix_source_size, mix_target, mix_rate, mix_copies``."""
    p = free_prefix(docs.columns, PREFIX)
    rates = plan_mix(docs, text_col=text_col, source_col=source_col, weights=weights, share=share, most=most)
    rates = rates.toDF(f"{p}source", f"{p}source_size", f"{p}target", f"{p}rate")
    sized = docs.withColumn(f"{p}size", solid_word_count(own(text_col)))
    joined = sized.join(checked_broadcast(rates), own(source_col).eqNullSafe(F.col(f"{p}source")))
    whole = F.floor(f"{p}rate")
    copies = whole + (draw(own(id_col), own(text_col), seed) < F.col(f"{p}rate") - whole).cast("long")
    return joined.select(*all_of(docs), *(F.col(p + c) for c in ("size", "source_size", "target", "rate")), copies.alias(f"{p}copies"))


def emit(mixed: DataFrame) -> DataFrame:
    """Each document as many times as the mix takes it, without the five columns that ``mix`` added."""
    columns, copies = all_of(mixed)[:-5], own(mixed.columns[-1])
    number = free_prefix(mixed.columns, PREFIX) + "number"
    repeated = mixed.where(copies > 0).select(*columns, F.explode(F.sequence(F.lit(1), copies.cast("int"))).alias(number))
    return repeated.drop(number)
