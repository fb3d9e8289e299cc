"""Feature tables of companies for predicting success: from arrays of dated events, or from sums alone."""

from __future__ import annotations

from collections.abc import Sequence
from datetime import date

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from farglass.operators.funding import months_between_days
from farglass.runtime import materialise


def event_arrays(events: DataFrame, key: str, when: str, fields: dict[str, str], out: str) -> DataFrame:
    """Each key's events in date order as an array of structs (day first)."""
    parts = [F.col(when).cast("date").alias("day"), *(F.col(c).alias(k) for k, c in fields.items())]
    return events.where(F.col(when).isNotNull()).groupBy(key).agg(F.array_sort(F.collect_list(F.struct(*parts))).alias(out))



def company_features(companies: DataFrame, rounds: DataFrame, start: date, end: date, horizon: date) -> DataFrame:
    """Companies founded in [start, end) with features of that window and a label for later rounds.

    ``companies``: id, founded_on and more; ``rounds``: org_id, announced_on, id, amount, kind. The
    label is whether a round falls in [end, horizon). Missing first and last dates give -1 months.
    """
    cohort = companies.where((F.col("founded_on") >= F.lit(start)) & (F.col("founded_on") < F.lit(end)))
    events = event_arrays(rounds, "org_id", "announced_on", {"id": "id", "amount": "amount", "kind": "kind"}, "events")
    joined = cohort.join(events, cohort["id"] == events["org_id"], "left").drop("org_id")
    typed = events.schema["events"].dataType
    window = F.coalesce(F.filter("events", lambda e: (e["day"] >= F.lit(start)) & (e["day"] < F.lit(end))), F.array().cast(typed))
    staged = joined.withColumn("window", window)
    first, last = F.array_min(F.transform("window", lambda e: e["day"])), F.array_max(F.transform("window", lambda e: e["day"]))
    latest = F.try_element_at("window", F.lit(-1))
    return staged.withColumns(
        {
            "n_rounds": F.size("window"),
            "raised": F.aggregate("window", F.lit(0.0), lambda s, e: s + F.coalesce(e["amount"], F.lit(0.0))),
            "has_investment": (F.size("window") > 0).cast("int"),
            "last_kind": F.coalesce(latest["kind"], F.lit("none")),
            "last_amount": F.coalesce(latest["amount"], F.lit(0.0)),
            "n_kinds": F.size(F.array_distinct(F.transform("window", lambda e: e["kind"]))),
            "months_before_first": months_between_days(F.col("founded_on"), first),
            "months_since_last": months_between_days(last, F.lit(end)),
            "future_round": F.coalesce(F.exists("events", lambda e: (e["day"] >= F.lit(end)) & (e["day"] < F.lit(horizon))), F.lit(False)).cast("int"),
        }
    ).drop("events", "window")


def in_window(day: Column, start: date, end: date) -> Column:
    return day.between(F.lit(start), F.lit(end))


def round_features(rounds: DataFrame, investments: DataFrame, start: date, end: date) -> DataFrame:
    """``org_id`` with what its rounds in [start, end] come to, by conditional sums and latest structs, and
    the distinct investors of all of them and of the last one.

    Only pairs of (organisation, investor) meet after the join with investments; no array of an
    organisation's events is made.
    """
    inside = rounds.where(in_window(F.col("announced_on"), start, end)).select("org_id", F.col("id").alias("round_id"), "announced_on", "amount", "kind")
    last = F.max(F.struct("announced_on", "round_id", "amount", "kind"))
    sums = inside.groupBy("org_id").agg(
        F.count("*").alias("n_funding_rounds"), F.sum(F.coalesce("amount", F.lit(0.0))).alias("total_investment"), F.min("announced_on").alias("first_round_on"), F.max("announced_on").alias("last_round_on"), F.count_distinct("kind").alias("n_round_kinds"), last.alias("last")
    )
    sums = materialise(sums.select("*", F.col("last.round_id").alias("last_round_id"), F.col("last.kind").alias("last_round_kind"), F.col("last.amount").alias("last_round_amount")).drop("last"), "round_sums")
    backed = inside.select("org_id", "round_id").join(investments.where(F.col("investor_id").isNotNull()).select("round_id", "investor_id"), "round_id")
    backed = backed.join(sums.select("org_id", "last_round_id"), "org_id").groupBy("org_id", "investor_id").agg(F.max(F.col("round_id") == F.col("last_round_id")).alias("in_last"))
    backers = backed.groupBy("org_id").agg(F.count("*").alias("n_investors_total"), F.count(F.when(F.col("in_last"), 1)).alias("n_investors_last_round"))
    return sums.join(backers, "org_id", "left")


def founder_features(people: DataFrame, degrees: DataFrame) -> DataFrame:
    """``org_id, n_founders, male_founder_share, founder_max_degrees, founder_mean_degrees``.

    ``people``: ``person_id, org_id, is_founder, gender``; a founder without a degree has no count.
    """
    held = degrees.groupBy("person_id").agg(F.count("*").alias("n_degrees"))
    founders = people.where(F.col("is_founder") & F.col("org_id").isNotNull()).join(held, "person_id", "left")
    return founders.groupBy("org_id").agg(F.count("*").alias("n_founders"), F.avg((F.coalesce("gender", F.lit("")) == "male").cast("int")).alias("male_founder_share"), F.max("n_degrees").alias("founder_max_degrees"), F.avg("n_degrees").alias("founder_mean_degrees"))


def grant_features(grants: DataFrame, start: date, end: date) -> DataFrame:
    """``org_id, n_grants, total_grants, first_grant_on, last_grant_on, last_grant_amount, has_public_grant``.

    ``grants``: ``org_id, grant_id, day, amount, public`` (0 or 1), null amounts as 0.
    """
    amount = F.coalesce("amount", F.lit(0.0))
    inside = grants.where(in_window(F.col("day"), start, end))
    return inside.groupBy("org_id").agg(
        F.count("grant_id").alias("n_grants"), F.sum(amount).alias("total_grants"), F.min("day").alias("first_grant_on"), F.max("day").alias("last_grant_on"), F.max_by(amount, F.struct("day", "grant_id")).alias("last_grant_amount"), F.max("public").alias("has_public_grant")
    )


def exits(days: DataFrame, start: date, end: date, name: str) -> DataFrame:
    """``org_id, <name>_in_window, <name>_later`` (0 or 1) from ``org_id, day``."""
    return days.groupBy("org_id").agg(F.max(in_window(F.col("day"), start, end).cast("int")).alias(f"{name}_in_window"), F.max((F.col("day") > F.lit(end)).cast("int")).alias(f"{name}_later"))


def success_dataset(
    companies: DataFrame,
    *,
    rounds: DataFrame,
    investments: DataFrame,
    people: DataFrame,
    degrees: DataFrame,
    grants: DataFrame,
    acquisitions: DataFrame,
    listings: DataFrame,
    indicators: DataFrame,
    industries: DataFrame,
    groups: Sequence[str],
    start: date,
    end: date,
    flags: Sequence[str] = (),
) -> DataFrame:
    """Companies founded in [start, end], neither acquired nor listed in it, with features of the window and
    ``future_success``: a round, an acquisition or a listing after it.

    ``companies``: ``id, founded_on, location_id`` and the columns of ``flags``, which become ``has_<flag>``;
    companies without a location are left out. ``indicators``: ``location_id, year, value``, of which the
    newest year before the window's end counts. ``industries``: ``id, industry``; each of ``groups`` becomes
    a column ``in_<group>`` of 0 and 1, and ``no_industry`` tells those without any. Rounds, grants and
    exits are tables of events by ``org_id``. Months are -1 where a date is missing, as are counts of
    investors without a round; other missing sums are 0.
    """
    cohort = companies.where(in_window(F.col("founded_on"), start, end) & F.col("location_id").isNotNull())
    cohort = cohort.select("id", "founded_on", "location_id", *((F.col(f).isNotNull()).cast("int").alias(f"has_{f}") for f in flags))
    later = rounds.groupBy("org_id").agg(F.max((F.col("announced_on") > F.lit(end)).cast("int")).alias("round_later"))
    parts = [round_features(rounds, investments, start, end), founder_features(people, degrees), grant_features(grants, start, end), exits(acquisitions, start, end, "acquired"), exits(listings, start, end, "listed"), later]
    out = cohort
    for part in parts:
        out = out.join(part.withColumnRenamed("org_id", "id"), "id", "left")
    named = industries.groupBy("id").agg(*(F.max((F.col("industry") == g).cast("int")).alias(f"in_{g}") for g in groups))
    out = out.join(named.withColumn("industry_known", F.lit(1)), "id", "left")
    newest = indicators.where(F.col("year") < F.lit(end.year)).groupBy("location_id").agg(F.max_by("value", "year").alias("indicator"))
    out = out.join(newest, "location_id", "left")  # as many rows as there are places
    zero = lambda c: F.coalesce(c, F.lit(0))
    out = out.where((zero("acquired_in_window") == 0) & (zero("listed_in_window") == 0))
    months = {
        "months_before_first_investment": months_between_days(F.col("founded_on"), F.col("first_round_on")), "months_since_last_investment": months_between_days(F.col("last_round_on"), F.lit(end)), "months_since_founded": months_between_days(F.col("founded_on"), F.lit(end)),
        "months_before_first_grant": months_between_days(F.col("founded_on"), F.col("first_grant_on")), "months_since_last_grant": months_between_days(F.col("last_grant_on"), F.lit(end)),
    }
    return out.select(
        "id", "location_id", *(f"has_{f}" for f in flags),
        zero("n_funding_rounds").alias("n_funding_rounds"), F.coalesce("total_investment", F.lit(0.0)).alias("total_investment"), zero("n_round_kinds").alias("n_round_kinds"), F.coalesce("last_round_kind", F.lit("none")).alias("last_round_kind"), F.coalesce("last_round_amount", F.lit(0.0)).alias("last_round_amount"),
        F.when(F.col("n_funding_rounds").isNull(), -1).otherwise(zero("n_investors_total")).alias("n_investors_total"), F.when(F.col("n_funding_rounds").isNull(), -1).otherwise(zero("n_investors_last_round")).alias("n_investors_last_round"),
        *(v.alias(k) for k, v in months.items()),
        zero("n_founders").alias("n_founders"), F.coalesce("male_founder_share", F.lit(0.0)).alias("male_founder_share"), zero("founder_max_degrees").alias("founder_max_degrees"), F.coalesce("founder_mean_degrees", F.lit(0.0)).alias("founder_mean_degrees"),
        (zero("n_grants") > 0).cast("int").alias("has_grant"), zero("n_grants").alias("n_grants"), F.coalesce("total_grants", F.lit(0.0)).alias("total_grants"), F.coalesce("last_grant_amount", F.lit(0.0)).alias("last_grant_amount"), zero("has_public_grant").alias("has_public_grant"),
        *(zero(f"in_{g}").alias(f"in_{g}") for g in groups), F.col("industry_known").isNull().cast("int").alias("no_industry"), "indicator",
        F.greatest(zero("round_later"), zero("acquired_later"), zero("listed_later")).alias("future_success"),
    )
