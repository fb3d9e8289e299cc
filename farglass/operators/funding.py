"""Funding tables: projects, companies, rounds, and what links them."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from farglass.operators.series import fill_periods, period_quantiles, period_totals


def deduplicate_projects(projects: DataFrame, keys: Sequence[str] = ("title", "description"), start: str = "start", amount: str = "amount") -> DataFrame:
    """One row for each key, that with the earliest start (then the smallest amount), with the group's
    summed amount. Sums and earliest rows are formed before the shuffle."""
    first = F.min_by(F.struct(*projects.columns), F.struct(F.col(start).isNull(), F.col(start), F.col(amount)))
    rows = projects.groupBy(*(F.col(k).alias(f"_{k}") for k in keys)).agg(F.coalesce(F.sum(amount), F.lit(0)).alias("_sum"), first.alias("_first"))
    return rows.select(*((F.col("_sum") if c == amount else F.col(f"_first.{c}")).alias(c) for c in projects.columns))


def project_series(projects: DataFrame, period: str, min_year: int, max_year: int, by: Sequence[str] = ()) -> DataFrame:
    """Number of distinct projects and total (thousands) and median (thousands) amounts by period.

    Projects are counted once at their earliest start; amounts come from all rows. The two series
    meet on the period.
    """
    keys = (*by, "title", "description")
    counts = period_totals(deduplicate_projects(projects, keys), "start", period, {"n_projects": F.count("*")}, by)
    money = period_totals(projects, "start", period, {"amount_total": F.coalesce(F.sum("amount"), F.lit(0)) / 1000.0}, by)
    middle = period_quantiles(projects, "start", "amount", period, [0.5], ["amount_median"], by)
    same = [money[c].eqNullSafe(middle[c]) for c in (*by, "period")]
    money = money.join(middle, same, "left").select(*(money[c] for c in money.columns), (middle["amount_median"] / 1000.0).alias("amount_median"))
    both = counts.join(money, [*by, "period"], "full_outer")
    return fill_periods(both, period, min_year, max_year, by)


def company_series(companies: DataFrame, rounds: DataFrame, period: str, min_year: int, max_year: int, by: Sequence[str] = ()) -> DataFrame:
    """Companies founded, rounds and raised amounts by period; both tables carry the ``by`` columns."""
    founded = period_totals(companies, "founded_on", period, {"n_founded": F.count("id")}, by)
    raised = period_totals(rounds, "announced_on", period, {"n_rounds": F.count("id"), "raised": F.coalesce(F.sum("amount"), F.lit(0.0))}, by)
    return fill_periods(founded.join(raised, [*by, "period"], "full_outer"), period, min_year, max_year, by)


def by_geography(companies: DataFrame, rounds: DataFrame, geography: str) -> DataFrame:
    """Companies, rounds and raised amounts by a geography column; null places go."""
    placed = companies.where(F.col(geography).isNotNull())
    counts = placed.groupBy(geography).agg(F.count("id").alias("n_companies"))
    money = rounds.join(placed.select(F.col("id").alias("org_id"), geography), "org_id").groupBy(geography).agg(F.count("*").alias("n_rounds"), F.sum("amount").alias("raised"))
    return counts.join(money, geography, "left").fillna(0, ["n_rounds", "raised"])


def with_funds(companies: DataFrame, funding: str, deals: str) -> DataFrame:
    """Companies that have raised money or had a round."""
    return companies.where((F.coalesce(funding, F.lit(0)) > 0) | (F.coalesce(deals, F.lit(0)) > 0))


def bridge(left: DataFrame, links: DataFrame, right: DataFrame, left_id: str, right_id: str, how: str = "left", kind: str | None = None) -> DataFrame:
    """Rows of ``left`` with what a link table ties them to, over two equi-joins.

    ``kind`` filters the links by ``table_name``; that is pruned at the scan if the table is
    partitioned by it.
    """
    chosen = links if kind is None else links.where(F.col("table_name") == kind)
    return left.join(chosen.select(left_id, right_id), left_id, how).join(right, right_id, how)


def start_end(funds: DataFrame, key: str, start: str, end: str) -> DataFrame:
    """First start and last end of each key; nulls are ignored."""
    return funds.groupBy(key).agg(F.min(start).alias(start), F.max(end).alias(end))


def latest_row(rows: DataFrame, key: str, when: str, tie: str) -> DataFrame:
    """Each key's row with the latest date; among equal dates the largest ``tie``."""
    latest = F.max_by(F.struct(*rows.columns), F.struct(F.col(when).isNotNull(), F.col(when), F.col(tie)))
    return rows.groupBy(F.col(key).alias("_key")).agg(latest.alias("_row")).select("_row.*")


def latest_values(rows: DataFrame, key: str, when: str, columns: Sequence[str]) -> DataFrame:
    """For each key and column the last value that is not null, in date order: not the last row."""
    return rows.groupBy(key).agg(*(F.max_by(c, F.when(F.col(c).isNotNull(), F.struct(when, c))).alias(c) for c in columns))


def in_industries(companies: DataFrame, categories: DataFrame, names: Sequence[str]) -> DataFrame:
    """Companies that the category table ties to any of the industries."""
    chosen = categories.where(F.col("industry").isin(list(names))).select(F.col("organization_id").alias("id"))
    return companies.join(chosen, "id", "left_semi")


def category_membership(ids: DataFrame, categories: DataFrame, wanted: Sequence[str], key: str = "id", category: str = "category") -> DataFrame:
    """A boolean column for each wanted category and ``any_category``; unknown ones are all false."""
    flags = categories.where(F.col(category).isin(list(wanted))).groupBy(key).agg(*(F.max(F.col(category) == c).alias(c) for c in wanted))
    joined = ids.join(flags, key, "left").fillna(False, list(wanted))
    return joined.withColumn("any_category", F.coalesce(F.greatest(*wanted) if len(wanted) > 1 else F.col(wanted[0]), F.lit(False)))


def amount_range(amount: Column, edges: Sequence[float], labels: Sequence[str], *, closed: str = "left", least: float = 0.001) -> Column:
    """Label of the range of an amount in thousands; edges are in millions.

    ``closed`` says which edge belongs to a range: ``left`` [a, b) or ``right`` (a, b]. Null and
    amounts under ``least`` are n/a; amounts from the last edge on get the last label.
    """
    if closed not in ("left", "right") or len(labels) != len(edges) + 1:
        raise ValueError("closed is left or right, with a label more than edges")
    value = amount / 1e3
    out = F.when(value.isNull() | (value < least), "n/a")
    for edge, label in zip(edges, labels):
        out = out.when(value < edge if closed == "left" else value <= edge, label)
    return out.otherwise(labels[-1])


# Edges in millions and labels of deal sizes.
DEAL_EDGES = (1, 4, 15, 40, 100, 250)
DEAL_LABELS = ("£0-1M", "£1-4M", "£4-15M", "£15-40M", "£40-100M", "£100-250M", "£250+")
STAGE_LABELS = ("£0-1M (pre-seed)", "£1-4M (seed)", "£4-15M (series A)", "£15-40M (series B)", "£40-100M (series C)", "£100-250M", "£250+")
COARSE_EDGES = (5, 20, 100)
COARSE_LABELS = ("£0-5M", "£5-20M", "£20-100M", "£100M+")


def lowest_of_range(label: Column) -> Column:
    """Lower bound of a plain range label: -1 for n/a, 251 for 250+."""
    return F.when(label == "n/a", -1).when(label == "250+", 251).otherwise(F.split_part(label, F.lit("-"), F.lit(1)).cast("int"))


def months_between_days(first: Column, second: Column) -> Column:
    """Whole months of 30.436875 days from first to second, towards zero; -1 if either is null."""
    return F.coalesce((F.datediff(second, first) / 30.436875).cast("int"), F.lit(-1))


def signed_log10(x: Column) -> Column:
    """log10 of the absolute value with the sign; null for 0."""
    return F.when(x > 0, F.log10(x)).when(x < 0, -F.log10(-x))
