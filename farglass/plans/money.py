"""Queries on funding and time series.

Sums are rounded at a digit where no exact value can lie halfway (cents have two, thousands of them
five), so that the order of a sum never decides the last digit.
"""

from __future__ import annotations

from datetime import date

from pyspark.sql import functions as F
from pyspark.sql import Window

from farglass.operators import funding, series
from farglass.operators.quantiles import exact_quantiles
from farglass.plans import standins as S
from farglass.plans.registry import query

R, C, P = f"with {S.ROUNDS}", f"with {S.COMPANIES}", f"with {S.PROJECTS}"


def yearly(spark, d, by=("industry",)):
    """Rounds by category and year: ``industry, year, n_rounds, raised``."""
    joined = S.rounds(spark, d).join(S.companies(spark, d).select(F.col("id").alias("org_id"), "industry", "country"), "org_id")
    totals = series.period_totals(joined, "announced_on", "year", {"n_rounds": F.count("*"), "raised": F.sum("amount")}, by)
    return series.fill_periods(totals, "year", 1995, 2001, by).withColumn("year", F.year("period"))


YEARLY = f"""{C}, cats as (select distinct industry from companies), years as (select unnest(range(1995, 2002)) as year),
sums as (select industry, year(announced_on) as year, count(*) as n_rounds, sum(amount) as raised from rounds join companies on org_id = companies.id group by all),
yearly as (select industry, year, coalesce(n_rounds, 0) as n_rounds, coalesce(raised, 0) as raised from cats cross join years left join sums using (industry, year))"""


@query(f"""{P}, d as (select *, sum(amount) over (partition by title, description) as s, row_number() over (partition by title, description order by start, amount) as r from projects)
select title, description, start, s as amount from d where r = 1""")
def a1_deduplicate_projects(spark, d):
    return funding.deduplicate_projects(S.projects(spark, d)).select("title", "description", "start", "amount")


@query(f"""{R}, m as (select date_trunc('month', announced_on)::date as period, count(*) as n_rounds, round(sum(amount::decimal(18, 2))::double / 1000, 5) as raised from rounds group by 1),
cal as (select unnest(generate_series(date '1994-01-01', date '2002-12-01', interval 1 month))::date as period)
select period, coalesce(n_rounds, 0) as n_rounds, coalesce(raised, 0) as raised from cal left join m using (period)""")
def a2_monthly_funding(spark, d):
    totals = series.period_totals(S.rounds(spark, d), "announced_on", "month", {"n_rounds": F.count("*"), "raised": F.round(F.sum(F.col("amount").cast("decimal(18,2)")).cast("double") / 1000, 5)})
    return series.fill_periods(totals, "month", 1994, 2002)


@query(f"{R} select date_trunc('quarter', announced_on)::date as period, kind, round(median(amount) / 1000, 6) as median_amount from rounds group by all")
def a3_median_per_quarter(spark, d):
    return series.period_quantiles(S.rounds(spark, d), "announced_on", "amount", "quarter", [0.5], ["m"], ["kind"]).select("kind", "period", F.round(F.col("m") / 1000, 6).alias("median_amount"))


@query(f"{C} select country, count(*) as n_companies from companies group by country")
def a6_companies_by_country(spark, d):
    return S.companies(spark, d).where(F.col("country").isNotNull()).groupBy("country").agg(F.count("id").alias("n_companies"))


@query(f"""{C}, a as (select region, count(*) as n_companies from companies group by region),
b as (select region, count(*) as n_rounds, round(sum(amount), 2) as raised from rounds join companies on org_id = companies.id group by region)
select region, n_companies, n_rounds, raised from a join b using (region)""")
def a7_funding_by_geography(spark, d):
    return funding.by_geography(S.companies(spark, d), S.rounds(spark, d), "region").withColumn("raised", F.round("raised", 2))


@query(f"""{R} select org_id, count(*) as n_rounds, round(sum(amount), 2) as total, min(announced_on) as first_on, max(announced_on) as last_on, max(case when kind = '1-URGENT' then 1 else 0 end) as has_urgent
from rounds group by org_id""")
def a13_grant_features(spark, d):
    return S.rounds(spark, d).groupBy("org_id").agg(
        F.count("*").alias("n_rounds"), F.round(F.sum("amount"), 2).alias("total"), F.min("announced_on").alias("first_on"), F.max("announced_on").alias("last_on"), F.max((F.col("kind") == "1-URGENT").cast("int")).alias("has_urgent")
    )


@query("""select o_custkey as org_id, count(distinct l_suppkey) as n_investors, sum(distinct l_linenumber) as line_kinds from orders join lineitem on o_orderkey = l_orderkey
where o_orderdate between timestamp '1996-01-01' and timestamp '1997-12-31' group by o_custkey""")
def a15_distinct_investors_in_window(spark, d):
    joined = S.read(spark, d, "orders").where(F.col("o_orderdate").between("1996-01-01", "1997-12-31")).join(S.read(spark, d, "lineitem"), F.col("o_orderkey") == F.col("l_orderkey"))
    return joined.groupBy(F.col("o_custkey").alias("org_id")).agg(F.count_distinct("l_suppkey").alias("n_investors"), F.sum_distinct("l_linenumber").alias("line_kinds"))


@query(f"{C} select country, industry, count(*) as n, grouping_id(country, industry) as level from companies group by grouping sets ((country), (country, industry), ())")
def a27_grouping_sets(spark, d):
    return S.companies(spark, d).groupingSets([["country"], ["country", "industry"], []], "country", "industry").agg(F.count("*").alias("n"), F.grouping_id().alias("level"))


@query(f"{R} select kind, count(*) as n, round(avg(amount), 6) as mean, round(stddev_samp(amount), 3) as sd, min(amount) as low, round(quantile_cont(amount, 0.25), 6) as q1, round(quantile_cont(amount, 0.5), 6) as q2, round(quantile_cont(amount, 0.75), 6) as q3, max(amount) as high from rounds group by kind")
def a29_summary_statistics(spark, d):
    rounds = S.rounds(spark, d)
    middle = exact_quantiles(rounds, ["kind"], "amount", [0.25, 0.5, 0.75], ["q1", "q2", "q3"])
    sums = rounds.groupBy("kind").agg(F.count("*").alias("n"), F.round(F.avg("amount"), 6).alias("mean"), F.round(F.stddev_samp("amount"), 3).alias("sd"), F.min("amount").alias("low"), F.max("amount").alias("high"))
    return sums.join(middle, "kind").select("kind", "n", "mean", "sd", "low", *(F.round(q, 6).alias(q) for q in ("q1", "q2", "q3")), "high")


@query(f"""{C} select year(founded_on) as year, count(*) as n, count(*) filter (industry = 'BUILDING') as n_building, count(*) filter (industry = 'BUILDING') / count(*) as share
from companies where founded_on is not null group by 1""")
def a24_share_series(spark, d):
    hit = F.count(F.when(F.col("industry") == "BUILDING", 1))
    return S.companies(spark, d).where(F.col("founded_on").isNotNull()).groupBy(F.year("founded_on").alias("year")).agg(F.count("*").alias("n"), hit.alias("n_building"), (hit / F.count("*")).alias("share"))


@query(f"{R} select round(sum(case when kind = '1-URGENT' then amount end) / sum(amount), 8) as share, sum(case when kind = '1-URGENT' then 1 else 0 end) as n_hit, count(*) as n from rounds")
def a21_share_of_funding(spark, d):
    hit = F.col("kind") == "1-URGENT"
    return S.rounds(spark, d).agg(F.round(F.sum(F.when(hit, F.col("amount"))) / F.sum("amount"), 8).alias("share"), F.sum(hit.cast("int")).alias("n_hit"), F.count("*").alias("n"))


@query(f"{R} select (date_trunc('year', announced_on) + interval 1 year - interval 1 day)::date as year_end, count(*) as n, round(sum(amount), 2) as raised from rounds group by 1")
def a26_calendar_year_totals(spark, d):
    return S.rounds(spark, d).groupBy(F.last_day(F.add_months(F.trunc("announced_on", "year"), 11)).alias("year_end")).agg(F.count("*").alias("n"), F.round(F.sum("amount"), 2).alias("raised"))


@query(f"""{P}, m as (select date_trunc('year', start)::date as period, category, count(distinct project_id) as n from projects group by all),
cal as (select unnest(generate_series(date '1993-01-01', date '2003-01-01', interval 1 year))::date as period), cats as (select distinct category from projects)
select category, period, coalesce(n, 0) as n from cats cross join cal left join m using (category, period)""")
def t1_fill_periods(spark, d):
    totals = series.period_totals(S.projects(spark, d), "start", "year", {"n": F.count_distinct("project_id")}, ["category"])
    return series.fill_periods(totals, "year", 1993, 2003, ["category"])


@query(f"""{P}, s as (select category, amount, unnest(generate_series(date_trunc('month', start), greatest(date_trunc('month', start), date_trunc('month', "end")), interval 1 month))::date as period,
len(generate_series(date_trunc('month', start), greatest(date_trunc('month', start), date_trunc('month', "end")), interval 1 month)) as n from projects)
select category, period, round(sum(amount / n), 4) as amount, count(*) as n from s group by all""")
def t2_spread_over_months(spark, d):
    spread = series.spread_over_periods(S.projects(spark, d), "start", "end", "amount", "month")
    return spread.groupBy("category", "period").agg(F.round(F.sum("amount"), 4).alias("amount"), F.count("*").alias("n"))


@query(f"""{P}, d as (select *, row_number() over (partition by title, description order by start, amount) as r from projects),
c as (select date_trunc('year', start)::date as period, count(*) as n_projects from d where r = 1 group by 1),
m as (select date_trunc('year', start)::date as period, round(sum(amount) / 1000, 6) as amount_total, round(median(amount) / 1000, 6) as amount_median from projects group by 1),
cal as (select unnest(generate_series(date '1994-01-01', date '2002-01-01', interval 1 year))::date as period)
select period, coalesce(n_projects, 0) as n_projects, coalesce(amount_total, 0) as amount_total, coalesce(amount_median, 0) as amount_median from cal left join c using (period) left join m using (period)""")
def t3_project_series(spark, d):
    return funding.project_series(S.projects(spark, d), "year", 1994, 2002).withColumns({"amount_total": F.round("amount_total", 6), "amount_median": F.round("amount_median", 6)})


@query(f"""{C}, r as (select region, date_trunc('year', announced_on)::date as period, count(*) as n_rounds, round(sum(amount), 2) as raised from rounds join companies on org_id = companies.id group by all),
f as (select region, date_trunc('year', founded_on)::date as period, count(*) as n_founded from companies where founded_on is not null group by all),
cal as (select unnest(generate_series(date '1994-01-01', date '2002-01-01', interval 1 year))::date as period), g as (select distinct region from companies)
select region, period, coalesce(n_founded, 0) as n_founded, coalesce(n_rounds, 0) as n_rounds, coalesce(raised, 0) as raised from g cross join cal left join f using (region, period) left join r using (region, period)""")
def t5_company_series_by_region(spark, d):
    companies = S.companies(spark, d)
    placed = S.rounds(spark, d).join(companies.select(F.col("id").alias("org_id"), "region"), "org_id")
    return funding.company_series(companies, placed, "year", 1994, 2002, ["region"]).withColumn("raised", F.round("raised", 2))


@query(YEARLY + " select * from (pivot (select industry, year, n_rounds from yearly) on industry in ('AUTOMOBILE', 'BUILDING', 'FURNITURE', 'HOUSEHOLD', 'MACHINERY') using sum(n_rounds) group by year)")
def t6_industry_table(spark, d):
    return yearly(spark, d).groupBy("year").pivot("industry", ["AUTOMOBILE", "BUILDING", "FURNITURE", "HOUSEHOLD", "MACHINERY"]).agg(F.sum("n_rounds"))


RATE_ROWS = [("EUR", date(1995, 1, 2), 1.2), ("EUR", date(1997, 6, 1), 1.5), ("EUR", date(2001, 12, 31), 1.6), ("USD", date(1996, 1, 1), 1.5), ("USD", date(2000, 7, 1), 1.4)]
RATE_SQL = "rates(currency, day, rate) as (values " + ", ".join(f"('{c}', date '{day}', {r}::double)" for c, day, r in RATE_ROWS) + ")"


@query(f"""{R}, {RATE_SQL}, spans as (select currency, day as d0, rate as r0, lead(day) over w as d1, lead(rate) over w as r1 from rates window w as (partition by currency order by day)),
ends as (select currency, min(day) as a, max(day) as b from rates group by currency),
x as (select id, announced_on, amount, case id % 3 when 0 then 'GBP' when 1 then 'USD' else 'EUR' end as currency from rounds),
n as (select x.*, greatest(least(announced_on, b), a) as near from x left join ends using (currency)),
j as (select n.*, r0 + coalesce((near - d0) / nullif(d1 - d0, 0), 0) * (coalesce(r1, r0) - r0) as rate from n left join spans on n.currency = spans.currency and near >= d0 and (near < d1 or (d1 is null and near = d0)))
select id, currency, round(case when currency = 'GBP' then amount when announced_on >= date '1996-01-01' then amount / rate end, 8) as gbp from j""")
def t9_convert_currency(spark, d):
    rates = spark.createDataFrame(RATE_ROWS, "currency string, day date, rate double")
    rows = S.rounds(spark, d).withColumn("currency", F.element_at(F.array(F.lit("GBP"), F.lit("USD"), F.lit("EUR")), (F.col("id") % 3 + 1).cast("int")))
    return series.convert_currency(rows, rates, amount="amount", currency="currency", day="announced_on", out="gbp", earliest=date(1996, 1, 1)).select("id", "currency", F.round("gbp", 8).alias("gbp"))


MAGNITUDE = YEARLY + """, s as (select *, avg(raised) over (partition by industry order by year rows between 2 preceding and current row) as sm from yearly),
mg as (select industry, avg(case when year between 1996 and 2000 then raised end) as magnitude,
100 * (max(case when year = 2000 then raised end) - max(case when year = 1996 then raised end)) / nullif(max(case when year = 1996 then raised end), 0) as growth,
100 * (max(case when year = 2000 then sm end) - max(case when year = 1996 then sm end)) / nullif(max(case when year = 1996 then sm end), 0) as smoothed_growth from s group by industry)"""


@query(MAGNITUDE + " select industry, round(magnitude, 2) as magnitude, round(growth, 6) as growth, round(smoothed_growth, 6) as smoothed_growth from mg")
def t13_magnitude_and_growth(spark, d):
    found = series.magnitude_and_growth(yearly(spark, d), "raised", 1996, 2000, 3, ["industry"])
    return found.select("industry", F.round("magnitude", 2).alias("magnitude"), F.round("growth", 6).alias("growth"), F.round("smoothed_growth", 6).alias("smoothed_growth"))


@query(YEARLY + """, v as (select industry, max(case when year = 2000 then n_rounds end) as value, max(case when year = 1996 then n_rounds end) as reference from yearly group by industry)
select *, value - reference as difference, round(100.0 * (value - reference) / nullif(reference, 0), 6) as change from v""")
def t14_compare_years(spark, d):
    return series.compare_years(yearly(spark, d), "n_rounds", 2000, 1996, ["industry"]).withColumn("change", F.round("change", 6))


TRENDS = MAGNITUDE + """, t as (select *, median(magnitude) over () as mid from mg)
select industry, round(magnitude, 2) as magnitude, round(smoothed_growth, 6) as growth,
coalesce(case when smoothed_growth > 0 and magnitude < mid then 'emerging' when smoothed_growth > 0 then 'hot' when smoothed_growth < 0 and magnitude < mid then 'dormant' when smoothed_growth < 0 then 'stable' end
|| case when abs((magnitude - mid) / mid) < 0.1 then '*' else '' end || case when abs(smoothed_growth) < 0.1 then '*' else '' end, 'n/a') as trend"""


@query(TRENDS + " from t")
def t15_trend_type(spark, d):
    found = series.magnitude_and_growth(yearly(spark, d), "raised", 1996, 2000, 3, ["industry"])
    typed = series.trend_type(found, "magnitude", "smoothed_growth")
    return typed.select("industry", F.round("magnitude", 2).alias("magnitude"), F.round("smoothed_growth", 6).alias("growth"), "trend")


@query(TRENDS + ", n_companies, n_deals from t join (select industry, count(*) as n_companies, sum(n_deals)::bigint as n_deals from companies group by industry) using (industry)")
def t16_trends_table(spark, d):
    """Trend of each category with its companies and deals."""
    counts = S.companies(spark, d).groupBy("industry").agg(F.count("*").alias("n_companies"), F.sum("n_deals").alias("n_deals"))
    return t15_trend_type(spark, d).join(counts, "industry")


@query(YEARLY + """, l as (select *, avg(raised) over (partition by industry order by year rows between 1 preceding and current row) as level from yearly)
select industry, year, round(level, 3) as level, round(100 * (level - lag(level, 2) over w) / nullif(lag(level, 2) over w, 0), 6) as growth from l window w as (partition by industry order by year)""")
def t17_rolling_growth(spark, d):
    return series.rolling_growth(yearly(spark, d), "raised", 2, 2, ["industry"]).select("industry", "year", F.round("level", 3).alias("level"), F.round("growth", 6).alias("growth"))


@query(f"{C} select id, n_deals from companies where coalesce(funding, 0) > 0 or coalesce(n_deals, 0) > 0")
def t19_companies_with_funds(spark, d):
    return funding.with_funds(S.companies(spark, d), "funding", "n_deals").select("id", "n_deals")


@query(YEARLY + " select industry, round(regr_slope(n_rounds, year), 6) as slope, round(regr_intercept(n_rounds, year), 3) as intercept from yearly group by industry")
def t21_linear_trend(spark, d):
    return series.linear_trend(yearly(spark, d), "n_rounds", ["industry"]).select("industry", F.round("slope", 6).alias("slope"), F.round("intercept", 3).alias("intercept"))


@query(YEARLY + " select industry, year, round(raised, 2) as raised, round(avg(raised) over (partition by industry order by year rows between 2 preceding and current row), 3) as raised_sma3 from yearly")
def w1_moving_average(spark, d):
    return series.moving_average(yearly(spark, d), "raised", 3, ["industry"], "year").select("industry", "year", F.round("raised", 2).alias("raised"), F.round("raised_sma3", 3).alias("raised_sma3"))


@query(f"{R} select * from rounds qualify row_number() over (partition by org_id order by announced_on desc, id desc) = 1")
def w2_latest_round(spark, d):
    return funding.latest_row(S.rounds(spark, d), "org_id", "announced_on", "id")


@query(f"""{R}, x as (select org_id, announced_on, case when id % 2 = 0 then amount end as amount, case when id % 3 = 0 then kind end as kind from rounds)
select org_id, (max((announced_on, amount)) filter (amount is not null))[2] as amount, (max((announced_on, kind)) filter (kind is not null))[2] as kind from x group by org_id""")
def w3_latest_values(spark, d):
    rows = S.rounds(spark, d).select("org_id", "announced_on", F.when(F.col("id") % 2 == 0, F.col("amount")).alias("amount"), F.when(F.col("id") % 3 == 0, F.col("kind")).alias("kind"))
    return funding.latest_values(rows, "org_id", "announced_on", ["amount", "kind"])


@query("select o_custkey as org, min(o_orderdate)::date as start, max(l_shipdate)::date as \"end\" from orders join lineitem on o_orderkey = l_orderkey group by o_custkey")
def w4_start_end(spark, d):
    joined = S.read(spark, d, "orders").join(S.read(spark, d, "lineitem"), F.col("o_orderkey") == F.col("l_orderkey"))
    rows = joined.select(F.col("o_custkey").alias("org"), F.col("o_orderdate").cast("date").alias("start"), F.col("l_shipdate").cast("date").alias("end"))
    return funding.start_end(rows, "org", "start", "end")


@query(f"{R} select id, org_id, row_number() over (partition by org_id order by announced_on, id) - 1 as number from rounds")
def w5_event_number(spark, d):
    return S.rounds(spark, d).select("id", "org_id", (F.row_number().over(Window.partitionBy("org_id").orderBy("announced_on", "id")) - 1).alias("number"))


@query("""select user_id, event_id, last_value(case when event_id % 4 = 0 then event_type end ignore nulls) over (partition by user_id order by ts, event_id rows between unbounded preceding and current row) as carried from events""")
def w6_carry_forward(spark, d):
    w = Window.partitionBy("user_id").orderBy("ts", "event_id").rowsBetween(Window.unboundedPreceding, 0)
    return S.read(spark, d, "events").select("user_id", "event_id", F.last(F.when(F.col("event_id") % 4 == 0, F.col("event_type")), ignorenulls=True).over(w).alias("carried"))


def _range_sql(edges, labels, op):
    cases = " ".join(f"when amount / 1e3 {op} {e} then '{label}'" for e, label in zip(edges, labels))
    return f"case when amount is null or amount / 1e3 < 0.001 then 'n/a' {cases} else '{labels[-1]}' end"


@query(f"""{R} select id, {_range_sql(funding.DEAL_EDGES, funding.DEAL_LABELS, '<')} as deal, {_range_sql(funding.DEAL_EDGES, funding.STAGE_LABELS, '<')} as stage,
{_range_sql(funding.COARSE_EDGES, funding.COARSE_LABELS, '<=')} as coarse from rounds""")
def f21_amount_ranges(spark, d):
    a = F.col("amount")
    return S.rounds(spark, d).select(
        "id", funding.amount_range(a, funding.DEAL_EDGES, funding.DEAL_LABELS).alias("deal"), funding.amount_range(a, funding.DEAL_EDGES, funding.STAGE_LABELS).alias("stage"),
        funding.amount_range(a, funding.COARSE_EDGES, funding.COARSE_LABELS, closed="right").alias("coarse"),
    )


@query(f"{C} select id, coalesce(trunc((date '2001-01-01' - founded_on) / 30.436875)::int, -1) as age_months from companies")
def f26_months_between(spark, d):
    return S.companies(spark, d).select("id", funding.months_between_days(F.col("founded_on"), F.lit(date(2001, 1, 1))).alias("age_months"))


@query(f"{R} select id, year(announced_on) as y, year(announced_on) || '-Q' || quarter(announced_on) as q, strftime(announced_on, '%Y-%m') as m from rounds")
def f27_period_labels(spark, d):
    on = F.col("announced_on")
    return S.rounds(spark, d).select("id", F.year(on).alias("y"), F.concat(F.year(on).cast("string"), F.lit("-Q"), F.quarter(on).cast("string")).alias("q"), F.date_format(on, "yyyy-MM").alias("m"))


@query("select c_custkey as id, round(case when c_acctbal > 0 then log10(c_acctbal) when c_acctbal < 0 then -log10(-c_acctbal) end, 9) as g from customer")
def f24_signed_log(spark, d):
    return S.read(spark, d, "customer").select(F.col("c_custkey").alias("id"), F.round(funding.signed_log10(F.col("c_acctbal")), 9).alias("g"))
