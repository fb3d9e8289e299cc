"""Queries on joins, sets, reshaping, features and data checks."""

from __future__ import annotations

from datetime import date

from pyspark.sql import Window
from pyspark.sql import functions as F

from farglass.operators import checks, features, funding, linking, shape
from farglass.plans import standins as S
from farglass.plans.registry import query

R, C, P = f"with {S.ROUNDS}", f"with {S.COMPANIES}", f"with {S.PROJECTS}"


@query("select c_custkey as id, year(o_orderdate) as year, o_orderkey from customer join orders on c_custkey = o_custkey where year(o_orderdate) between 1996 and 1998")
def p2_year_filter(spark, d):
    orders = S.read(spark, d, "orders").where(F.col("o_orderdate") >= F.lit("1996-01-01")).where(F.col("o_orderdate") < F.lit("1999-01-01"))
    return orders.select(F.col("o_custkey").alias("id"), F.year("o_orderdate").alias("year"), "o_orderkey").join(S.read(spark, d, "customer").select(F.col("c_custkey").alias("id")), "id", "left_semi")


@query("select event_id, case when event_type in ('click', 'purchase') then 1 else 0 end as has_action, coalesce(case event_type when 'click' then 'press' when 'view' then 'look' end, event_type) as action from events")
def p8_p11_indicator_and_recode(spark, d):
    table = F.create_map(F.lit("click"), F.lit("press"), F.lit("view"), F.lit("look"))
    return S.read(spark, d, "events").select("event_id", F.col("event_type").isin("click", "purchase").cast("int").alias("has_action"), F.coalesce(F.try_element_at(table, F.col("event_type")), "event_type").alias("action"))


@query("""select o_orderkey as id, coalesce(case when o_orderkey % 3 = 0 then null else o_orderpriority end, case when c_custkey % 2 = 0 then c_mktsegment end) as v from orders left join customer on o_custkey = c_custkey""")
def p9_p10_fill_from_other(spark, d):
    rows = S.read(spark, d, "orders").select(F.col("o_orderkey").alias("id"), F.col("o_custkey").alias("k"), F.when(F.col("o_orderkey") % 3 != 0, F.col("o_orderpriority")).alias("v"))
    other = S.read(spark, d, "customer").select(F.col("c_custkey").alias("k"), F.when(F.col("c_custkey") % 2 == 0, F.col("c_mktsegment")).alias("v"))
    return linking.fill_from(rows, other, "k", "v").select("id", "v")


@query("select r_name, list_sort(list(distinct n_name)) as names, count(*) as n from region join nation on r_regionkey = n_regionkey group by r_name")
def p19_groups_of_industries(spark, d):
    joined = S.read(spark, d, "region").join(S.read(spark, d, "nation"), F.col("r_regionkey") == F.col("n_regionkey"))
    return joined.groupBy("r_name").agg(F.sort_array(F.collect_set("n_name")).alias("names"), F.count("*").alias("n"))


@query("""select o_orderkey as project_id, s_suppkey as org_id, s_name, n_name from orders left join (select distinct l_orderkey, l_suppkey from lineitem) on o_orderkey = l_orderkey
left join supplier on l_suppkey = s_suppkey left join nation on s_nationkey = n_nationkey""")
def j1_j5_project_organisations(spark, d):
    projects = S.read(spark, d, "orders").select(F.col("o_orderkey").alias("project_id"))
    links = S.read(spark, d, "lineitem").select(F.col("l_orderkey").alias("project_id"), F.col("l_suppkey").alias("org_id")).distinct()
    places = F.broadcast(S.read(spark, d, "nation").select(F.col("n_nationkey").alias("s_nationkey"), "n_name"))
    orgs = S.read(spark, d, "supplier").select(F.col("s_suppkey").alias("org_id"), "s_name", "s_nationkey").join(places, "s_nationkey", "left")
    return funding.bridge(projects, links, orgs, "project_id", "org_id").select("project_id", "org_id", "s_name", "n_name")


@query("select o_orderkey as id, c_name as name, c_mktsegment as segment from orders left join customer on o_custkey = c_custkey")
def j4_many_to_one(spark, d):
    rows = S.read(spark, d, "orders").select(F.col("o_orderkey").alias("id"), F.col("o_custkey").alias("k"))
    return linking.many_to_one(rows, S.read(spark, d, "customer").select(F.col("c_custkey").alias("k"), F.col("c_name").alias("name"), F.col("c_mktsegment").alias("segment")), "k").drop("k")


@query("""select o_orderkey as id, l_suppkey as investor, coalesce(round(sum(l_extendedprice), 2), 0) as invested from orders left join lineitem on o_orderkey = l_orderkey and l_quantity > 10 group by all""")
def j7_round_investors(spark, d):
    lines = S.read(spark, d, "lineitem").where(F.col("l_quantity") > 10).select(F.col("l_orderkey").alias("id"), F.col("l_suppkey").alias("investor"), "l_extendedprice")
    joined = S.read(spark, d, "orders").select(F.col("o_orderkey").alias("id")).join(lines, "id", "left")
    return joined.groupBy("id", "investor").agg(F.coalesce(F.round(F.sum("l_extendedprice"), 2), F.lit(0.0)).alias("invested"))


@query(f"{C} select id, name from companies where industry in ('BUILDING', 'MACHINERY')")
def j8_p16_in_industries(spark, d):
    companies = S.companies(spark, d)
    return funding.in_industries(companies, companies.select(F.col("id").alias("organization_id"), "industry"), ["BUILDING", "MACHINERY"]).select("id", "name")


@query("select p_brand as brand, list_sort(list(p_partkey)) as ids, list_sort(list(distinct p_size)) as sizes, arg_max(p_name, (len(p_name), p_name)) as longest from part group by p_brand")
def a9_a12_collect(spark, d):
    parts = S.read(spark, d, "part")
    return parts.groupBy(F.col("p_brand").alias("brand")).agg(F.sort_array(F.collect_list("p_partkey")).alias("ids"), F.sort_array(F.collect_set("p_size")).alias("sizes"), F.max_by("p_name", F.struct(F.char_length("p_name"), "p_name")).alias("longest"))


@query(f"""{R}, a as (select date_trunc('year', announced_on)::date as period, count(*) as n from rounds where kind = '1-URGENT' and announced_on < date '1999-01-01' group by 1),
b as (select date_trunc('year', announced_on)::date as period, count(*) as m from rounds where kind = '2-HIGH' and announced_on >= date '1997-01-01' group by 1) select period, n, m from a full join b using (period)""")
def j12_full_outer_series(spark, d):
    r = S.rounds(spark, d).withColumn("period", F.trunc("announced_on", "year"))
    a = r.where((F.col("kind") == "1-URGENT") & (F.col("announced_on") < date(1999, 1, 1))).groupBy("period").agg(F.count("*").alias("n"))
    b = r.where((F.col("kind") == "2-HIGH") & (F.col("announced_on") >= date(1997, 1, 1))).groupBy("period").agg(F.count("*").alias("m"))
    return a.join(b, "period", "full_outer")


@query("select o_orderkey as id from orders where o_orderkey not in (select l_orderkey from lineitem join supplier on l_suppkey = s_suppkey where regexp_matches(s_name, '1$|7'))")
def j13_without_matching(spark, d):
    lines = S.read(spark, d, "lineitem").join(S.read(spark, d, "supplier"), F.col("l_suppkey") == F.col("s_suppkey")).select(F.col("l_orderkey").alias("id"), "s_name")
    return linking.without_matching(S.read(spark, d, "orders").select(F.col("o_orderkey").alias("id")), lines, "id", "s_name", ["1$", "7"])


@query("""with l as (select c_custkey as id, case when c_custkey % 3 = 0 then lower(c_name) end as a, c_mktsegment || c_nationkey as b from customer),
r as (select s_suppkey as rid, case when s_suppkey % 2 = 0 then 'customer#' || lpad((s_suppkey * 3)::varchar, 9, '0') end as a, (['AUTOMOBILE','BUILDING','FURNITURE','HOUSEHOLD','MACHINERY'])[(s_suppkey % 5 + 1)::int] || s_nationkey as b from supplier),
m as (select id, min(rid) as rid, 0 as step from l join r using (a) group by id union all select id, min(rid), 1 from l join r using (b) group by id)
select id, arg_min(rid, step) as rid, min(step)::int as step from m group by id""")
def j15_cascade_match(spark, d):
    left = S.read(spark, d, "customer").select(F.col("c_custkey").alias("id"), F.when(F.col("c_custkey") % 3 == 0, F.lower("c_name")).alias("a"), F.concat("c_mktsegment", F.col("c_nationkey").cast("string")).alias("b"))
    kinds = F.array(*map(F.lit, ["AUTOMOBILE", "BUILDING", "FURNITURE", "HOUSEHOLD", "MACHINERY"]))
    right = S.read(spark, d, "supplier").select(
        F.col("s_suppkey").alias("rid"), F.when(F.col("s_suppkey") % 2 == 0, F.concat(F.lit("customer#"), F.lpad((F.col("s_suppkey") * 3).cast("string"), 9, "0"))).alias("a"),
        F.concat(F.element_at(kinds, (F.col("s_suppkey") % 5 + 1).cast("int")), F.col("s_nationkey").cast("string")).alias("b"),
    )
    return linking.cascade_match(left, right, [(F.col("a"), F.col("a")), (F.col("b"), F.col("b"))], "id", "rid")


@query("""with g as (select p_partkey as id, p_brand as block, p_name as name, list_distinct(list_transform(range(1, greatest(len(p_name) - 2, 1) + 1), lambda i: substr(p_name, i, 3))) as g from part where p_partkey % 2 = 0),
h as (select p_partkey as id, p_brand as block, p_name as name, list_distinct(list_transform(range(1, greatest(len(p_name) - 2, 1) + 1), lambda i: substr(p_name, i, 3))) as h from part where p_partkey % 2 = 1)
select g.id as left_id, h.id as right_id, round(len(list_intersect(g, h)) / len(list_distinct(list_concat(g, h))), 9) as similarity, round(levenshtein(g.name, h.name) / greatest(len(g.name), len(h.name)), 9) as edit_share
from g join h using (block) where len(list_intersect(g, h)) / len(list_distinct(list_concat(g, h))) >= 0.6""")
def j16_fuzzy_match(spark, d):
    parts = S.read(spark, d, "part").select(F.col("p_partkey").alias("id"), F.col("p_brand").alias("block"), F.col("p_name").alias("name"))
    found = linking.fuzzy_match(parts.where("id % 2 = 0"), parts.where("id % 2 = 1"), "id", "id", "name", "block", 0.6)
    return found.select("left_id", "right_id", F.round("similarity", 9).alias("similarity"), F.round("edit_share", 9).alias("edit_share"))


@query(f"""{C}, facts as (select country, year(announced_on) as year, count(*)::double as v from rounds join companies on org_id = companies.id where country like '%A%' group by all),
n as (select country, arg_max(v, year) as indicator from facts where year < 1999 group by country) select id, coalesce(indicator, -1) as indicator from companies left join n using (country)""")
def j19_latest_before(spark, d):
    companies = S.companies(spark, d)
    joined = S.rounds(spark, d).join(companies.where(F.col("country").contains("A")).select(F.col("id").alias("org_id"), "country"), "org_id")
    facts = joined.groupBy("country", F.year("announced_on").alias("year")).agg(F.count("*").cast("double").alias("v"))
    return linking.latest_before(companies.select("id", "country"), facts, ["country"], "year", 1999, "v", "indicator").select("id", "indicator")


@query("""select e.event_id, f.value as last_purchase from events e asof left join (select user_id, ts, max(value) as value from events where event_type = 'purchase' group by all) f on e.user_id = f.user_id and e.ts >= f.ts where e.event_type <> 'purchase'""")
def j19_as_of(spark, d):
    e = S.read(spark, d, "events")
    facts = e.where("event_type = 'purchase'").groupBy(F.col("user_id").alias("u"), F.col("ts").alias("t")).agg(F.max("value").alias("last_purchase"))
    rows = e.where("event_type <> 'purchase'").select("event_id", "user_id", "ts")
    return linking.as_of(rows, facts.withColumnRenamed("u", "user_id"), "user_id", "ts", "t", ["last_purchase"]).select("event_id", "last_purchase")


@query("select c_custkey as id from customer where c_custkey not in (select o_custkey from orders where o_orderdate >= timestamp '1999-01-01')")
def u4_st2_missing_from(spark, d):
    landed = S.read(spark, d, "orders").where(F.col("o_orderdate") >= "1999-01-01").select(F.col("o_custkey").alias("id"))
    return linking.missing_from(S.read(spark, d, "customer").select(F.col("c_custkey").alias("id")), landed, "id")


@query("""select 'industry' as kind, c_mktsegment as label, count(*) as n from customer group by all union all select 'status', o_orderstatus, count(*) from orders group by all union all select 'brand', p_brand, count(*) from part group by all""")
def u1_u5_label_union(spark, d):
    def labels(table, kind, column):
        return S.read(spark, d, table).where(F.col(column).isNotNull()).groupBy(F.lit(kind).alias("kind"), F.col(column).alias("label")).agg(F.count("*").alias("n"))

    return labels("customer", "industry", "c_mktsegment").unionByName(labels("orders", "status", "o_orderstatus")).unionByName(labels("part", "brand", "p_brand"))


@query("select o_custkey as id from orders where o_orderstatus = 'F' intersect select o_custkey from orders where o_orderpriority = '1-URGENT'")
def u3_intersect(spark, d):
    orders = S.read(spark, d, "orders")
    return orders.where("o_orderstatus = 'F'").select(F.col("o_custkey").alias("id")).intersect(orders.where("o_orderpriority = '1-URGENT'").select("o_custkey"))


@query("select distinct p_partkey as id, trim(unnest(string_split(replace(p_name, ' ', ' , '), ','))) as tag from part")
def r1_explode_list(spark, d):
    parts = S.read(spark, d, "part").select(F.col("p_partkey").alias("id"), F.regexp_replace("p_name", " ", " , ").alias("tag"))
    return shape.explode_list(parts, "id", "tag")


@query("""with x as (select o_custkey as id, list(o_orderkey::varchar order by o_orderkey) as a, case when o_custkey % 3 = 0 then list(o_orderpriority order by o_orderkey)[1:-2] else list(o_orderpriority order by o_orderkey) end as b from orders group by o_custkey)
select id, unnest(a) as kind, unnest(case when len(b) = 0 and len(a) = 1 then [''] when len(a) = len(b) then b else list_transform(a, lambda i: null::varchar) end) as investors from x""")
def r2_explode_parallel(spark, d):
    grouped = S.read(spark, d, "orders").groupBy(F.col("o_custkey").alias("id")).agg(F.array_sort(F.collect_list(F.struct("o_orderkey", "o_orderpriority"))).alias("s"))
    a, b = F.transform("s", lambda x: x["o_orderkey"].cast("string")), F.transform("s", lambda x: x["o_orderpriority"])
    short = F.when(F.col("id") % 3 == 0, F.slice(b, F.lit(1), F.size(b) - 1)).otherwise(b)
    rows = grouped.select("id", F.array_join(a, ";").alias("kind"), F.array_join(short, ";").alias("investors"))
    return shape.explode_parallel(rows, ["id"], ["kind", "investors"], "investors")


@query("""select c_custkey as id, y as year, round(c_acctbal + y, 2) as value from customer, (values (2016), (2017), (2018)) t(y)""")
def r3_yearly_values(spark, d):
    wide = S.read(spark, d, "customer").select(F.col("c_custkey").alias("id"), F.concat_ws(";", *(F.format_string("%.2f", F.col("c_acctbal") + y) for y in (2016, 2017, 2018))).alias("BALANCE (2016,2017,2018)"))
    return shape.yearly_values(wide, "id", "BALANCE (2016,2017,2018)").withColumn("value", F.round("value", 2))


@query("""select doc_id as id, t as term from documents, (values ('the'), ('and'), ('que')) x(t) where contains(lower(text), t)""")
def r4_melt_hits(spark, d):
    from farglass.operators import search

    return search.term_hits(S.read(spark, d, "documents"), "doc_id", "text", ["the", "and", "que"]).select(F.col("doc_id").alias("id"), "term")


@query("""select * from (pivot (select o_custkey as id, lower(regexp_replace(substr(o_orderpriority, 3), '\\W+', '_', 'g')) as k from orders) on k in ('urgent', 'high', 'medium', 'not_specified', 'low') using count(*) group by id)""".replace("count(*)", "count(k)"))
def r8_one_hot(spark, d):
    pairs = S.read(spark, d, "orders").select(F.col("o_custkey").alias("id"), F.substring("o_orderpriority", 3, 50).alias("k"))
    return shape.one_hot(pairs, "id", "k", ["URGENT", "HIGH", "MEDIUM", "NOT SPECIFIED", "LOW"])


@query("""with l as (select o_custkey as id, list(distinct o_orderstatus) as s from orders group by o_custkey)
select id, case when list_contains(s, 'F') and not list_contains(s, 'P') then 1 else 0 end as F, case when list_contains(s, 'O') and not list_contains(s, 'P') then 1 else 0 end as O,
case when list_contains(s, 'P') or not (list_contains(s, 'F') or list_contains(s, 'O')) then null else list_filter(['F', 'O'], lambda x: list_contains(s, x)) end as labels from l""")
def r10_r11_binarise(spark, d):
    rows = S.read(spark, d, "orders").groupBy(F.col("o_custkey").alias("id")).agg(F.collect_set("o_orderstatus").alias("s"))
    return shape.to_labels(shape.binarise(rows, "s", ["F", "O"], veto="P"), ["F", "O"], "labels").drop("s")


@query("""with l as (select c_custkey as id, list(distinct o_orderpriority) filter (o_orderstatus = 'F') as s from customer left join orders on c_custkey = o_custkey group by c_custkey)
select coalesce(x, 'not_relevant') as label, count(*) as n from (select case when s is null or len(s) = 0 then [null] else s end as s from l), unnest(s) t(x) group by 1""")
def a20_label_counts(spark, d):
    rows = S.read(spark, d, "customer").join(S.read(spark, d, "orders"), F.col("c_custkey") == F.col("o_custkey"), "left").groupBy("c_custkey").agg(F.collect_set(F.when(F.col("o_orderstatus") == "F", F.col("o_orderpriority"))).alias("s"))
    return shape.label_counts(rows, "s")


@query("select column_name as column, 0.0 as percent_null from (describe (select * from orders)) union all select 'maybe', (select round(100.0 * avg((o_orderkey % 4 = 0)::int), 6) from orders)")
def q3_null_shares(spark, d):
    return checks.null_shares(S.read(spark, d, "orders").withColumn("maybe", F.when(F.col("o_orderkey") % 4 != 0, F.lit(1))))


@query("select l_orderkey, l_suppkey, l_linenumber, count(*) over (partition by l_orderkey, l_suppkey) as n_copies from lineitem qualify n_copies > 1")
def q4_duplicates(spark, d):
    return checks.duplicates(S.read(spark, d, "lineitem").select("l_orderkey", "l_suppkey", "l_linenumber"), ["l_orderkey", "l_suppkey"])


@query(f"{C} select count(*) as n, count(*) filter (country = 'UNITED KINGDOM') as n_uk, count(distinct country) as n_countries, min(founded_on) as first_on, sum(n_deals)::bigint as n_deals from companies")
def q5_data_report(spark, d):
    return S.companies(spark, d).agg(F.count("*").alias("n"), F.count(F.when(F.col("country") == "UNITED KINGDOM", 1)).alias("n_uk"), F.count_distinct("country").alias("n_countries"), F.min("founded_on").alias("first_on"), F.sum("n_deals").alias("n_deals"))


@query(f"{C} select id, name, n_deals, round(coalesce(funding, 0), 2) as funding from companies order by coalesce(funding, 0) desc, id limit 10")
def o2_top_funded(spark, d):
    return S.companies(spark, d).withColumn("funding", F.coalesce("funding", F.lit(0.0))).orderBy(F.desc("funding"), "id").limit(10).select("id", "name", "n_deals", F.round("funding", 2).alias("funding"))


@query(f"""{C}, w as (select org_id, count(*) as n, sum(amount) as raised, count(distinct kind) as kinds, min(announced_on) as a, max(announced_on) as b, max((announced_on, id, amount, kind)) as l from rounds
where announced_on >= date '1995-01-01' and announced_on < date '1998-01-01' group by org_id), f as (select distinct org_id from rounds where announced_on >= date '1998-01-01' and announced_on < date '2001-01-01')
select c.id, coalesce(n, 0)::int as n_rounds, round(coalesce(raised, 0), 2) as raised, (n is not null)::int as has_investment, coalesce(l[4], 'none') as last_kind, coalesce(l[3], 0) as last_amount, coalesce(kinds, 0)::int as n_kinds,
coalesce(trunc((a - founded_on) / 30.436875)::int, -1) as months_before_first, coalesce(trunc((date '1998-01-01' - b) / 30.436875)::int, -1) as months_since_last, (f.org_id is not null)::int as future_round
from companies c left join w on c.id = w.org_id left join f on c.id = f.org_id where founded_on >= date '1995-01-01' and founded_on < date '1998-01-01'""")
def d1_company_features(spark, d):
    made = features.company_features(S.companies(spark, d), S.rounds(spark, d), date(1995, 1, 1), date(1998, 1, 1), date(2001, 1, 1))
    return made.select("id", "n_rounds", F.round("raised", 2).alias("raised"), "has_investment", "last_kind", "last_amount", "n_kinds", "months_before_first", "months_since_last", "future_round")


@query(f"{C}, m as (select id, bool_or(industry = 'BUILDING') as building, bool_or(country = 'FRANCE') as france from companies group by id) select id, building, france, building or france as any_category from m")
def x6_category_membership(spark, d):
    companies = S.companies(spark, d)
    pairs = companies.select("id", F.when(F.col("industry") == "BUILDING", F.lit("building")).alias("category")).union(companies.select("id", F.when(F.col("country") == "FRANCE", F.lit("france"))))
    return funding.category_membership(companies.select("id"), pairs, ["building", "france"])


@query("select event_type, time_bucket(interval 1 day, ts)::date as day, count(*) as n, round(sum(value), 4) as total from events group by all")
def st1_daily_events(spark, d):
    from farglass.streaming import events

    return events.daily_totals(S.read(spark, d, "events")).withColumn("total", F.round("total", 4))


@query("""select user_id, min(ts) as first_ts, count(*) as n from (select *, sum(new) over (partition by user_id order by ts, event_id) as s from
(select *, case when ts - lag(ts) over (partition by user_id order by ts, event_id) < interval 6 hour then 0 else 1 end as new from events)) group by user_id, s""")
def st1_sessions(spark, d):
    from farglass.streaming import events

    return events.sessions(S.read(spark, d, "events"), "6 hours").select("user_id", "first_ts", "n")


@query("select o_custkey as id, len(list(o_orderkey)) as n, list_sort(list(distinct o_orderpriority)) as kinds from orders group by o_custkey having count(*) filter (o_orderstatus = 'F') > 0")
def s9_sql_scan(spark, d):
    S.read(spark, d, "orders").createOrReplaceTempView("scan_orders")
    return spark.sql("select o_custkey as id, size(collect_list(o_orderkey)) as n, sort_array(collect_set(o_orderpriority)) as kinds from scan_orders group by o_custkey having count_if(o_orderstatus = 'F') > 0")


@query("select event_id, user_id, json_extract_string(props, '$.' || json_keys(props)[1]) as first_prop from events")
def s6_nested_json(spark, d):
    keys = F.json_object_keys("props")
    return S.read(spark, d, "events").select("event_id", "user_id", F.from_json("props", "map<string,string>").alias("m"), keys[0].alias("k")).select("event_id", "user_id", F.try_element_at("m", F.col("k")).alias("first_prop"))
