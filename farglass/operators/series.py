"""Time series by category: periods, gap filling, smoothing, growth and trend types.

Series are long tables: a row for each category and period. Periods are dates of a month's,
quarter's or year's first day. Every operator works on all categories at once.
"""

from __future__ import annotations

from collections.abc import Sequence
from datetime import date

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from farglass.operators.quantiles import exact_quantiles
from farglass.runtime import checked_broadcast

MONTHS = {"month": 1, "quarter": 3, "year": 12}


def check_period(period: str) -> str:
    if period not in MONTHS:
        raise ValueError(f"period must be one of {', '.join(MONTHS)}, not {period!r}")
    return period


def period_start(when: Column, period: str) -> Column:
    """First day of the period that a date or timestamp is in."""
    return F.trunc(when.cast("date"), check_period(period))


def period_totals(rows: DataFrame, when: str, period: str, aggregates: dict[str, Column], by: Sequence[str] = ()) -> DataFrame:
    """Aggregates for each category and period; rows without a date are left out."""
    dated = rows.withColumn("period", period_start(F.col(when), period)).where(F.col("period").isNotNull())
    return dated.groupBy(*by, "period").agg(*(v.alias(k) for k, v in aggregates.items()))


def period_quantiles(rows: DataFrame, when: str, value: str, period: str, shares: Sequence[float], names: Sequence[str], by: Sequence[str] = ()) -> DataFrame:
    """Exact quantiles of a value for each category and period, however many rows those have."""
    dated = rows.withColumn("period", period_start(F.col(when), period)).where(F.col("period").isNotNull())
    return exact_quantiles(dated, [*by, "period"], value, shares, names)


def fill_periods(series: DataFrame, period: str, min_year: int, max_year: int, by: Sequence[str] = (), values: Sequence[str] | None = None) -> DataFrame:
    """A row for every period from the first of ``min_year`` to the last of ``max_year``, or to the
    data's last period where that is later; missing values are 0 and earlier periods go.

    With categories each gets all periods. The calendar is as long as the years asked for, so it is
    small whatever the data.
    """
    months = MONTHS[check_period(period)]
    values = [c for c in series.columns if c not in (*by, "period")] if values is None else list(values)
    last = F.greatest(F.max("period"), F.lit(date(max_year, 13 - months, 1)))
    calendar = series.agg(last.alias("last")).select(F.explode(F.sequence(F.lit(date(min_year, 1, 1)), "last", F.expr(f"interval {months} months"))).alias("period"))
    if by:
        calendar = series.select(*by).distinct().crossJoin(F.broadcast(calendar))
        condition = [F.col(f"k.{c}").eqNullSafe(F.col(f"s.{c}")) for c in by] + [F.col("k.period") == F.col("s.period")]
        joined = calendar.alias("k").join(series.alias("s"), condition, "left")
        return joined.select(*(F.col(f"k.{c}") for c in by), "k.period", *(F.coalesce(F.col(f"s.{c}"), F.lit(0)).alias(c) for c in values))
    joined = calendar.join(series, "period", "left")
    return joined.select("period", *(F.coalesce(F.col(c), F.lit(0)).alias(c) for c in values))


def spread_over_periods(rows: DataFrame, start: str, end: str, amount: str, period: str) -> DataFrame:
    """A row for each period from start to end, both included, with an even part of the amount.

    Rows whose end is before their start, or that lack either date, are spread over one period or
    none: the start's if there is a start.
    """
    months = MONTHS[check_period(period)]
    first, last = period_start(F.col(start), period), period_start(F.col(end), period)
    periods = F.sequence(first, F.greatest(first, last), F.expr(f"interval {months} months"))
    spread = rows.withColumn("periods", F.when(first.isNotNull(), periods)).withColumn("n_periods", F.size("periods"))
    return spread.select(*rows.columns, "n_periods", F.explode("periods").alias("period")).withColumn(amount, F.col(amount) / F.col("n_periods"))


def moving_average(series: DataFrame, value: str, window: int, by: Sequence[str] = (), order: str = "period", out: str | None = None) -> DataFrame:
    """Trailing average over the last ``window`` rows, of those there are; nulls are skipped."""
    frame = Window.partitionBy(*by).orderBy(order).rowsBetween(1 - window, 0)
    return series.withColumn(out or f"{value}_sma{window}", F.avg(value).over(frame))


def percentage_change(initial: Column, new: Column) -> Column:
    """Change in percent; null from a base of zero."""
    return F.try_divide((new - initial).cast("double"), initial.cast("double")) * 100


def magnitude_and_growth(series: DataFrame, value: str, first: int, last: int, window: int = 3, by: Sequence[str] = (), year: str = "year") -> DataFrame:
    """Mean over the years first to last, growth in percent from first to last of the series, and
    growth of the series smoothed over ``window`` years."""
    smooth = moving_average(series, value, window, by, year, "smooth")

    def at(y: int, c: str) -> Column:
        return F.max(F.when(F.col(year) == y, F.col(c)))

    return smooth.groupBy(*by).agg(
        F.avg(F.when(F.col(year).between(first, last), F.col(value))).alias("magnitude"),
        percentage_change(at(first, value), at(last, value)).alias("growth"),
        percentage_change(at(first, "smooth"), at(last, "smooth")).alias("smoothed_growth"),
    )


def compare_years(series: DataFrame, value: str, year: int, reference: int, by: Sequence[str] = (), column: str = "year") -> DataFrame:
    """The values of two years, their difference and the change in percent."""
    at = lambda y: F.max(F.when(F.col(column) == y, F.col(value)))
    both = series.groupBy(*by).agg(at(year).alias("value"), at(reference).alias("reference"))
    return both.withColumns({"difference": F.col("value") - F.col("reference"), "change": percentage_change(F.col("reference"), F.col("value"))})


def rolling_growth(series: DataFrame, value: str, window: int, back: int, by: Sequence[str] = (), year: str = "year") -> DataFrame:
    """For each year the smoothed level and its change in percent against ``back`` rows before."""
    level = moving_average(series, value, window, by, year, "level")
    before = F.lag("level", back).over(Window.partitionBy(*by).orderBy(year))
    return level.withColumn("growth", percentage_change(before, F.col("level")))


def trend_type(table: DataFrame, magnitude: str, growth: str, by: Sequence[str] = (), mid_point: float | None = None, tolerance: float = 0.1) -> DataFrame:
    """``trend``: emerging, hot, dormant or stable by the quadrant; a star for each value near its
    border; n/a for no growth. The middle is the median of each ``by`` group unless given."""
    middle = F.lit(mid_point) if mid_point is not None else F.col("middle")
    medians = table.groupBy(*by).agg(F.median(magnitude).alias("middle"))
    if mid_point is not None:
        joined = table
    elif by:
        joined = table.join(medians, list(by))
    else:
        joined = table.crossJoin(F.broadcast(medians))
    m, g = F.col(magnitude), F.col(growth)
    kind = F.when((g > 0) & (m < middle), "emerging").when((g > 0) & (m >= middle), "hot").when((g < 0) & (m < middle), "dormant").when((g < 0) & (m >= middle), "stable")
    near_middle = F.when(F.abs(F.try_divide(m - middle, middle)) < tolerance, "*").otherwise("")
    flat = F.when(F.abs(g) < tolerance, "*").otherwise("")
    return joined.withColumn("trend", F.coalesce(F.concat(kind, near_middle, flat), F.lit("n/a"))).drop("middle")


def linear_trend(series: DataFrame, value: str, by: Sequence[str] = (), x: str = "year") -> DataFrame:
    """Slope and intercept of the least-squares line."""
    y, at = F.col(value).cast("double"), F.col(x).cast("double")
    return series.groupBy(*by).agg(F.regr_slope(y, at).alias("slope"), F.regr_intercept(y, at).alias("intercept"))


def daily_rates(rates: DataFrame, currency: str = "currency", day: str = "day", rate: str = "rate") -> DataFrame:
    """Rates for every day between a currency's first and last, missing days by linear
    interpolation. A row for each known rate spans the days up to the next one, so no currency's
    calendar is joined to anything."""
    w = Window.partitionBy(currency).orderBy(day)
    spans = rates.where(F.col(rate).isNotNull()).select(currency, F.col(day).alias("d0"), F.col(rate).alias("r0"), F.lead(day).over(w).alias("d1"), F.lead(rate).over(w).alias("r1"))
    days = F.sequence("d0", F.coalesce(F.date_sub("d1", 1), "d0"), F.expr("interval 1 day"))
    share = F.coalesce(F.try_divide(F.datediff(F.col(day), "d0").cast("double"), F.datediff("d1", "d0").cast("double")), F.lit(0.0))
    return spans.select(currency, F.explode(days).alias(day), "d0", "r0", "d1", "r1").select(currency, day, (F.col("r0") + share * (F.coalesce("r1", "r0") - F.col("r0"))).alias(rate))


def convert_currency(rows: DataFrame, rates: DataFrame, *, amount: str, currency: str, day: str, out: str, native: str = "GBP", earliest: date = date(2000, 1, 1)) -> DataFrame:
    """Amounts in the native currency by the day's rate (units of the currency for one native).

    Days outside a currency's rates take its nearest rate; days before ``earliest`` give null unless
    the amount is native already. ``rates`` (currency, day, rate) is a small reference table.
    """
    filled = daily_rates(rates).withColumnsRenamed({"currency": "rate_currency", "day": "rate_day"})
    ends = filled.groupBy("rate_currency").agg(F.min("rate_day").alias("rate_first"), F.max("rate_day").alias("rate_last")).withColumnRenamed("rate_currency", "end_currency")
    near = rows.join(checked_broadcast(ends), F.col(currency) == F.col("end_currency"), "left").withColumn("near_day", F.greatest(F.least(F.col(day).cast("date"), "rate_last"), "rate_first"))
    joined = near.join(filled, (F.col("end_currency") == F.col("rate_currency")) & (F.col("near_day") == F.col("rate_day")), "left")
    value = F.when(F.col(currency) == native, F.col(amount)).when(F.col(day).cast("date") >= F.lit(earliest), F.try_divide(F.col(amount), F.col("rate")))
    return joined.withColumn(out, value).select(*rows.columns, out)
