from datetime import date

import pytest
from pyspark.sql import functions as F

from farglass.operators import funding, series


def rows(df, *columns):
    return [tuple(r) for r in df.orderBy(*df.columns[:1]).select(*(columns or df.columns)).collect()]


def yearly(spark, values, first=2000):
    return spark.createDataFrame([(first + k, float(v)) for k, v in enumerate(values)], "year int, v double")


def test_fill_periods(spark):
    s = spark.createDataFrame([(date(2000, 1, 1), 1.0), (date(2002, 1, 1), 3.0)], "period date, v double")
    assert [r[1] for r in rows(series.fill_periods(s, "year", 2000, 2002))] == [1.0, 0.0, 3.0]
    assert [r[1] for r in rows(series.fill_periods(s, "year", 1999, 2002))] == [0.0, 1.0, 0.0, 3.0]
    assert [r[1] for r in rows(series.fill_periods(s, "year", 1999, 2005))] == [0.0, 1.0, 0.0, 3.0, 0.0, 0.0, 0.0]
    assert [r[0].year for r in rows(series.fill_periods(s, "year", 2001, 2001))] == [2001, 2002]
    assert len(rows(series.fill_periods(s, "month", 2000, 2001))) == 25
    with pytest.raises(ValueError):
        series.fill_periods(s, "day", 2000, 2001)


def test_fill_periods_by_category_with_null_category(spark):
    s = spark.createDataFrame([("a", date(2000, 1, 1), 1), (None, date(2001, 1, 1), 2)], "k string, period date, v int")
    got = {(r.k, r.period.year): r.v for r in series.fill_periods(s, "year", 2000, 2001, ["k"]).collect()}
    assert got == {("a", 2000): 1, ("a", 2001): 0, (None, 2000): 0, (None, 2001): 2}


PROJECTS = "title string, description string, amount long, start string"


def test_deduplicate_projects(spark):
    p = spark.createDataFrame([("A", "aaa", 1, "2011"), ("A", "aaa", 2, "2009"), ("A", "diff", 5, "2001"), ("B", "bbb", 10, "2020")], PROJECTS)
    got = sorted((r.start, r.title, r.description, r.amount) for r in funding.deduplicate_projects(p).collect())
    assert got == [("2001", "A", "diff", 5), ("2009", "A", "aaa", 3), ("2020", "B", "bbb", 10)]


def test_funding_per_period_counts_and_totals(spark):
    p = spark.createDataFrame([("a", "x", 1000, "2001-02-01"), ("b", "x", 2000, "2002-10-01"), ("b", "x", 10000, "2002-12-01"), ("c", "x", 5000, "2004-04-01")], PROJECTS)
    got = rows(funding.project_series(p, "year", 2001, 2004), "n_projects", "amount_total")
    assert got == [(1, 1.0), (1, 12.0), (0, 0.0), (1, 5.0)]


def test_medians(spark):
    p = spark.createDataFrame([(str(k), "x", a, d) for k, (a, d) in enumerate([(1000, "2001-01-01"), (2000, "2001-05-01"), (3000, "2001-09-01"), (10000, "2002-01-01"), (5000, "2002-02-01"), (12000, "2002-03-01"), (None, "2002-04-01")])], PROJECTS)
    assert rows(funding.project_series(p, "year", 2001, 2002), "amount_median") == [(2.0,), (10.0,)]


def test_moving_average(spark):
    s = yearly(spark, [1, 3, 5])
    assert [r.v_sma3 for r in series.moving_average(s, "v", 3, order="year").orderBy("year").collect()] == [1, 2, 3]
    assert [r.v_sma2 for r in series.moving_average(s, "v", 2, order="year").orderBy("year").collect()] == [1, 2, 4]


def test_magnitude_and_growth(spark):
    s = yearly(spark, [1, 3, 5, 4])
    m = lambda a, b, w: series.magnitude_and_growth(s, "v", a, b, w).first()
    assert m(2001, 2002, 1).magnitude == 4.0 and m(2000, 2002, 1).magnitude == 3.0
    assert m(2001, 2003, 2).smoothed_growth == pytest.approx(125.0) and m(2000, 2002, 3).smoothed_growth == pytest.approx(200.0)
    assert m(2001, 2003, 2).magnitude == 4.0


def test_percentage_change(spark):
    df = spark.createDataFrame([(10.0, 15.0), (20.0, 15.0), (20.0, 100.0), (20.0, 0.0), (0.0, 1.0), (None, 1.0)], "a double, b double")
    assert [r[0] for r in df.select(series.percentage_change(F.col("a"), F.col("b"))).collect()] == [50, -25, 400, -100, None, None]


@pytest.mark.parametrize("period,n,parts", [("year", 4, (250.0, 500.0)), ("quarter", 15, (66.667, 133.333)), ("month", 43, (23.2558, 46.5116))])
def test_spread(spark, period, n, parts):
    p = spark.createDataFrame([(1, date(2020, 1, 1), date(2023, 7, 1), 1000.0), (2, date(2021, 1, 1), date(2024, 7, 1), 2000.0), (3, date(2021, 1, 1), date(2020, 1, 1), 7.0), (4, None, date(2020, 1, 1), 7.0)], "id int, a date, b date, amount double")
    got = series.spread_over_periods(p, "a", "b", "amount", period).collect()
    for k, part in zip((1, 2), parts):
        mine = [r for r in got if r.id == k]
        assert len(mine) == n and mine[0].amount == pytest.approx(part, abs=1e-3)
    assert [r.amount for r in got if r.id == 3] == [7.0] and not [r for r in got if r.id == 4]


def test_trend_types(spark):
    t = spark.createDataFrame([("a", 10.0, 5.0), ("b", 1.0, 5.0), ("c", 10.0, -5.0), ("d", 1.0, -5.0), ("e", 5.0, 0.0), ("f", 5.2, 0.05)], "k string, m double, g double")
    got = {r.k: r.trend for r in series.trend_type(t, "m", "g", mid_point=5.0).collect()}
    assert got == {"a": "hot", "b": "emerging", "c": "stable", "d": "dormant", "e": "n/a", "f": "hot**"}


def test_currency(spark):
    rates = spark.createDataFrame([("USD", date(2001, 1, 20), 1.4), ("USD", date(2001, 1, 24), 1.6)], "currency string, day date, rate double")
    deals = spark.createDataFrame([(1, 700.0, "USD", date(2001, 1, 20)), (2, 750.0, "USD", date(2001, 1, 22)), (3, 160.0, "USD", date(2005, 1, 1)), (4, 140.0, "USD", date(2000, 5, 1)), (5, 9.0, "GBP", date(1990, 1, 1)), (6, 9.0, "USD", date(1999, 12, 31)), (7, 9.0, "XXX", date(2001, 1, 1))], "id int, a double, c string, d date")
    got = {r.id: r.gbp for r in series.convert_currency(deals, rates, amount="a", currency="c", day="d", out="gbp").collect()}
    assert [None if got[k] is None else round(got[k], 6) for k in range(1, 8)] == [500.0, 500.0, 100.0, 100.0, 9.0, None, None]


def test_amount_ranges(spark):
    df = spark.createDataFrame([(None,), (0.5,), (1.0,), (1000.0,), (999.9,), (250000.0,), (5000.0,)], "a double")
    left = [r[0] for r in df.select(funding.amount_range(F.col("a"), funding.DEAL_EDGES, funding.DEAL_LABELS)).collect()]
    assert left == ["n/a", "n/a", "£0-1M", "£1-4M", "£0-1M", "£250+", "£4-15M"]
    right = [r[0] for r in df.select(funding.amount_range(F.col("a"), funding.COARSE_EDGES, funding.COARSE_LABELS, closed="right")).collect()]
    assert right[3:] == ["£0-5M", "£0-5M", "£100M+", "£0-5M"]
