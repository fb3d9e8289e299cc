"""Smaller queries: projections, counts, orders, set operations, array and link features."""

from __future__ import annotations

from datetime import date

from pyspark.sql import functions as F

from farglass.functions import dates
from farglass.functions import html as H
from farglass.functions import text as T
from farglass.operators import collocation, features, funding, grants, linking, search, series, shape, vectors
from farglass.plans import standins as S
from farglass.plans.registry import query
from farglass.runtime import checked_broadcast, numbered

R, C, P = f"with {S.ROUNDS}", f"with {S.COMPANIES}", f"with {S.PROJECTS}"
DOCS = "with docs as (select doc_id as id, text, lang, source, (2000 + doc_id % 20)::int as year from documents)"


def docs(spark, d):
    return S.read(spark, d, "documents").select(F.col("doc_id").alias("id"), "text", "lang", "source", (2000 + F.col("doc_id") % 20).cast("int").alias("year"))


@query("select c_custkey as id, c_name as name, c_acctbal as balance_usd from customer")
def p1_p5_p13_rename_and_drop(spark, d):
    wide = S.read(spark, d, "customer").withColumnsRenamed({"c_custkey": "ID", "c_name": "Name", "c_acctbal": "Balance USD", "not there": "x"})
    return shape.drop_columns(shape.tidy_names(wide), ["nation", "segment"])


@query(f"{C} select id from companies where contains(coalesce(case when id % 4 = 0 then null else industry end, ''), 'BUILD') or country in ('FRANCE', 'GERMANY')")
def p3_p6_p7_filters(spark, d):
    companies = S.companies(spark, d)
    role = F.coalesce(F.when(F.col("id") % 4 != 0, F.col("industry")), F.lit(""))
    return companies.where(F.contains(role, F.lit("BUILD")) | F.col("country").isin("FRANCE", "GERMANY")).select("id")


@query("select c_custkey as id, coalesce(case when c_custkey % 3 = 0 then null else c_mktsegment end, 'none') as segment, coalesce(case when c_custkey % 5 = 0 then null else c_acctbal end, 0) as balance from customer where not (c_custkey % 3 = 0 and c_custkey % 5 = 0)")
def p14_p15_nulls(spark, d):
    rows = S.read(spark, d, "customer").select(F.col("c_custkey").alias("id"), F.when(F.col("c_custkey") % 3 != 0, F.col("c_mktsegment")).alias("segment"), F.when(F.col("c_custkey") % 5 != 0, F.col("c_acctbal")).alias("balance"))
    return rows.dropna(how="all", subset=["segment", "balance"]).fillna({"segment": "none", "balance": 0.0})


@query("""with l as (select o_custkey as id, list_sort(list(distinct o_orderpriority)) as p from orders group by o_custkey)
select id, list_sort(list_distinct(list_filter(list_transform(p, lambda x: case when x in ('1-URGENT', '2-HIGH') then 'fast' when x = '5-LOW' then 'slow' end), lambda x: x is not null))) as kinds from l""")
def p12_recode_list(spark, d):
    rows = S.read(spark, d, "orders").groupBy(F.col("o_custkey").alias("id")).agg(F.sort_array(F.collect_set("o_orderpriority")).alias("p"))
    return rows.select("id", F.sort_array(shape.recode_list(F.col("p"), {"1-URGENT": "fast", "2-HIGH": "fast", "5-LOW": "slow"})).alias("kinds"))


@query(f"{C} select industry as label, 'industry' as kind, id from companies where industry = 'BUILDING' union all select country, 'country', id from companies where country = 'FRANCE'")
def p18_by_labels(spark, d):
    companies = S.companies(spark, d)
    labels = companies.select("id", F.col("industry").alias("label"), F.lit("industry").alias("kind")).union(companies.select("id", "country", F.lit("country")))
    wanted = spark.createDataFrame([("BUILDING", "industry"), ("FRANCE", "country")], "label string, kind string")
    return labels.join(checked_broadcast(wanted), ["label", "kind"]).select("label", "kind", "id")


@query(f"{C} select rounds.id, org_id, year(announced_on) as year, round(amount / 1000, 5) as thousands, country from rounds join companies on org_id = companies.id where announced_on > date '1996-06-30'")
def j6_j11_rounds_with_places(spark, d):
    places = S.companies(spark, d).select(F.col("id").alias("org_id"), "country")
    return S.rounds(spark, d).where(F.col("announced_on") > date(1996, 6, 30)).join(places, "org_id").select("id", "org_id", F.year("announced_on").alias("year"), F.round(F.col("amount") / 1000, 5).alias("thousands"), "country")


@query("select c_custkey as a, s_suppkey as b from customer join supplier on c_nationkey = s_nationkey and c_custkey % 10 = s_suppkey % 10")
def j14_two_keys(spark, d):
    a = S.read(spark, d, "customer").select(F.col("c_custkey").alias("a"), F.col("c_nationkey").alias("n"), (F.col("c_custkey") % 10).alias("k"))
    b = S.read(spark, d, "supplier").select(F.col("s_suppkey").alias("b"), F.col("s_nationkey").alias("n"), (F.col("s_suppkey") % 10).alias("k"))
    return linking.many_to_many(a, b, ["n", "k"]).select("a", "b")


@query("select c_custkey as id, coalesce(case when n_nationkey % 2 = 0 then n_name end, '-1') as code from customer left join nation on c_nationkey = n_nationkey")
def j18_lookup_with_default(spark, d):
    codes = S.read(spark, d, "nation").where("n_nationkey % 2 = 0").select(F.col("n_nationkey").alias("c_nationkey"), F.col("n_name").alias("code"))
    return S.read(spark, d, "customer").join(F.broadcast(codes), "c_nationkey", "left").select(F.col("c_custkey").alias("id"), F.coalesce("code", F.lit("-1")).alias("code"))


@query("""with l as (select o_custkey as org, list(distinct o_orderkey) as ids from orders group by o_custkey), x as (select org, unnest(ids) as o_orderkey from l) select distinct org, l_partkey as project from x join lineitem on o_orderkey = l_orderkey""")
def j21_explode_lookup(spark, d):
    lookup = S.read(spark, d, "orders").groupBy(F.col("o_custkey").alias("org")).agg(F.to_json(F.collect_set("o_orderkey")).alias("ids"))
    pairs = lookup.select("org", F.explode(F.from_json("ids", "array<bigint>")).alias("l_orderkey"))
    return pairs.join(S.read(spark, d, "lineitem"), "l_orderkey").select("org", F.col("l_partkey").alias("project")).dropDuplicates(["org", "project"])


@query(f"{C} select industry, count(*) as n, list_sort(list(distinct country)) as countries from companies group by industry")
def a8_a10_top_industries(spark, d):
    return S.companies(spark, d).groupBy("industry").agg(F.count("*").alias("n"), F.sort_array(F.collect_set("country")).alias("countries"))


@query("select lang, sum(len(string_split(text, ' ')))::bigint as n_words, list_sort(list_distinct(flatten(list(string_split(source, 'r'))))) as parts from documents group by lang")
def a11_concat_arrays(spark, d):
    rows = S.read(spark, d, "documents")
    sums = rows.groupBy("lang").agg(F.sum(F.size(F.split("text", " "))).alias("n_words"))
    parts = rows.groupBy("lang", "source").count().select("lang", F.explode(F.split("source", "r")).alias("part")).distinct()
    parts = parts.groupBy(F.col("lang").alias("own")).agg(F.sort_array(F.collect_list("part")).alias("parts"))
    return sums.join(parts, F.col("lang").eqNullSafe(F.col("own"))).drop("own")


@query("select user_id, count(*) as n, round(sum(value), 4) as total, round(avg(value), 6) as mean, max(value) as high from events group by user_id")
def a14_sum_mean_max(spark, d):
    return S.read(spark, d, "events").groupBy("user_id").agg(F.count("*").alias("n"), F.round(F.sum("value"), 4).alias("total"), F.round(F.avg("value"), 6).alias("mean"), F.max("value").alias("high"))


@query(f"{R} select org_id, coalesce(round(sum(amount) filter (announced_on between date '1996-01-01' and date '1997-12-31'), 2), 0) as raised, count(*) filter (announced_on >= date '2000-01-01') as n_recent from rounds group by org_id")
def a16_a25_window_sums(spark, d):
    on = F.col("announced_on")
    return S.rounds(spark, d).groupBy("org_id").agg(
        F.coalesce(F.round(F.sum(F.when(on.between(date(1996, 1, 1), date(1997, 12, 31)), F.col("amount"))), 2), F.lit(0.0)).alias("raised"), F.count(F.when(on >= date(2000, 1, 1), 1)).alias("n_recent")
    )


@query("select l_returnflag as theme, l_linestatus as subtheme, count(distinct l_orderkey) as n from lineitem group by all")
def a18_theme_counts(spark, d):
    return S.read(spark, d, "lineitem").groupBy(F.col("l_returnflag").alias("theme"), F.col("l_linestatus").alias("subtheme")).agg(F.count_distinct("l_orderkey").alias("n"))


@query("with a as (select distinct o_custkey as k from orders where o_orderpriority = '1-URGENT'), b as (select distinct o_custkey as k from orders where o_orderstatus = 'F') select count(*) as n, count(b.k) as n_both, count(b.k) / count(*) as share from a left join b using (k)")
def a23_overlap(spark, d):
    flags = S.read(spark, d, "orders").groupBy("o_custkey").agg(F.max((F.col("o_orderpriority") == "1-URGENT").cast("int")).alias("a"), F.max((F.col("o_orderstatus") == "F").cast("int")).alias("b"))
    return flags.agg(F.sum("a").alias("n"), F.sum(F.col("a") * F.col("b")).alias("n_both")).withColumn("share", F.try_divide("n_both", "n"))


@query("select distinct p_type as label from part")
def a28_distinct_values(spark, d):
    return S.read(spark, d, "part").select(F.col("p_type").alias("label")).distinct()


@query("select n, count(*) as freq from (select count(*) as n from lineitem group by l_orderkey) group by n")
def a30_list_lengths(spark, d):
    return S.read(spark, d, "lineitem").groupBy("l_orderkey").agg(F.collect_list("l_linenumber").alias("x")).groupBy(F.size("x").cast("long").alias("n")).agg(F.count("*").alias("freq"))


@query(f"{C} select industry, id, row_number() over (order by list_position(['MACHINERY', 'BUILDING', 'HOUSEHOLD', 'FURNITURE', 'AUTOMOBILE'], industry), coalesce(funding, 0) desc, id) as rank from companies")
def o1_o4_custom_order(spark, d):
    order = F.array(*map(F.lit, ["MACHINERY", "BUILDING", "HOUSEHOLD", "FURNITURE", "AUTOMOBILE"]))
    # A sum of doubles depends on the order of its rows in the last digits, which would part equal sums.
    rows = S.companies(spark, d).select("industry", "id", F.array_position(order, F.col("industry")).alias("place"), F.round(F.coalesce("funding", F.lit(0.0)), 4).alias("funding"))
    return numbered(rows, F.col("place"), F.col("funding").desc(), F.col("id")).select("industry", "id", (F.col("rank") + 1).alias("rank"))


@query("select o_orderkey as id from orders where ('0x' || substr(md5(o_orderkey::varchar), 1, 6))::bigint % 10 = 0")
def o6_hash_sample(spark, d):
    orders = S.read(spark, d, "orders")
    return orders.where(F.conv(F.substring(F.md5(F.col("o_orderkey").cast("string")), 1, 6), 16, 10).cast("long") % 10 == 0).select(F.col("o_orderkey").alias("id"))


@query(f"{R} select * from (pivot (select year(announced_on)::int as year, kind, amount from rounds) on kind in ('1-URGENT', '2-HIGH') using count(amount) as n, round(avg(amount), 6) as mean group by year)")
def r5_r6_two_value_pivot(spark, d):
    table = S.rounds(spark, d).groupBy(F.year("announced_on").alias("year")).pivot("kind", ["1-URGENT", "2-HIGH"]).agg(F.count("amount").alias("n"), F.round(F.avg("amount"), 6).alias("mean"))
    return table


@query(f"{R}, o as (select org_id, list(announced_on order by announced_on, id) as days from rounds group by org_id) select org_id, days from o")
def r7_numbered_columns(spark, d):
    rows = features.event_arrays(S.rounds(spark, d), "org_id", "announced_on", {"id": "id"}, "e")
    return rows.select("org_id", F.transform("e", lambda x: x["day"]).alias("days"))


@query("select r_name as l1, list_sort(list(distinct n_name)) as l2 from region join nation on r_regionkey = n_regionkey group by r_name")
def r13_taxonomy(spark, d):
    joined = S.read(spark, d, "region").join(S.read(spark, d, "nation"), F.col("r_regionkey") == F.col("n_regionkey"))
    return joined.groupBy(F.col("r_name").alias("l1")).agg(F.sort_array(F.collect_set("n_name")).alias("l2"))


@query("select id, list_transform(string_split(t, ','), lambda x: trim(x)) as parts, list_has_any(list_transform(string_split(t, ','), lambda x: trim(x)), ['ring', 'small']) as hit from (select p_partkey as id, replace(p_name, ' ', ' , ') as t from part)")
def f1_f2_lists(spark, d):
    parts = S.read(spark, d, "part").select(F.col("p_partkey").alias("id"), shape.split_trim(F.regexp_replace("p_name", " ", " , ")).alias("parts"))
    return parts.withColumn("hit", F.arrays_overlap("parts", F.array(F.lit("ring"), F.lit("small"))))


@query(f"{DOCS} select id, regexp_replace(text, '([^a-zA-Z0-9 #(++)+])', ' ', 'g') as bare, regexp_replace(text, '([^a-zA-Z0-9 #(++)+])', ' \\1 ', 'g') as padded from docs")
def f5_punctuation(spark, d):
    return docs(spark, d).select("id", T.remove_punctuation(F.col("text")).alias("bare"), T.pad_punctuation(F.col("text")).alias("padded"))


@query()
def f9_clean_chain(spark, d):
    return docs(spark, d).select("id", T.clean(F.col("text"), ["the", "and"], keep_punctuation=True).alias("cleaned"), T.clean_minimal(F.col("text"), False).alias("minimal"))


@query()
def f11_tag_texts(spark, d):
    return S.read(spark, d, "pages").select("page_id", H.tag_texts(F.col("html"), ["h1", "p"]).alias("segments"))


@query("select c_custkey as id, trim(regexp_replace(lower(c_name), '[^a-z0-9]+', ' ', 'g')) as name from customer")
def f15_company_names(spark, d):
    return S.read(spark, d, "customer").select(F.col("c_custkey").alias("id"), T.company_name(F.col("c_name")).alias("name"))


@query("select p_partkey as id, ' ' || replace(p_name, '_', ' ') || ' ' as padded from part")
def f18_tokens_to_text(spark, d):
    return S.read(spark, d, "part").select(F.col("p_partkey").alias("id"), T.tokens_to_text(F.split("p_name", " ")).alias("padded"))


@query(f"""{R}, r as (select id, case when amount / 1e3 < 0.001 then 'n/a' when amount / 1e3 < 1 then '0-1' when amount / 1e3 < 4 then '1-4' when amount / 1e3 < 15 then '4-15' when amount / 1e3 < 40 then '15-40' when amount / 1e3 < 100 then '40-100' when amount / 1e3 < 250 then '100-250' else '250+' end as label from rounds)
select id, label, case label when 'n/a' then -1 when '250+' then 251 else split_part(label, '-', 1)::int end as low from r""")
def f22_lowest_of_range(spark, d):
    labels = ("0-1", "1-4", "4-15", "15-40", "40-100", "100-250", "250+")
    rows = S.rounds(spark, d).select("id", funding.amount_range(F.col("amount"), funding.DEAL_EDGES, labels).alias("label"))
    return rows.withColumn("low", funding.lowest_of_range(F.col("label")))


@query("select id, year, case when month is null then null else make_date(year, month, 1) end as day, stamp from (select c_custkey as id, (1990 + c_custkey % 30)::int as year, case when c_custkey % 2 = 0 then 1 else 3 end as month, case when c_custkey % 3 = 0 then null else make_timestamp(2000 + c_custkey % 20, 1, 2, 3, 4, 5) end as stamp from customer)")
def f28_f30_dates(spark, d):
    k = F.col("c_custkey")
    year = (1990 + k % 30).cast("int")
    month = F.when(k % 2 == 0, year.cast("string")).otherwise(F.concat(F.lit("mar/"), year.cast("string")))
    stamp = F.when(k % 3 == 0, "9999-01-02T03:04:05Z").otherwise(F.concat((2000 + k % 20).cast("string"), F.lit("-01-02T03:04:05Z")))
    return S.read(spark, d, "customer").select(k.alias("id"), year.alias("year"), T.impute_month(month).alias("day"), T.clean_date(stamp).cast("timestamp_ntz").alias("stamp"))


@query(f"""{R}, w as (select org_id, list(announced_on) as days, count(*) filter (announced_on between date '1996-01-01' and date '1997-12-31') as n, min(announced_on) filter (announced_on between date '1996-01-01' and date '1997-12-31') as a,
max(announced_on) filter (announced_on between date '1996-01-01' and date '1997-12-31') as b, (max((announced_on, id)))[2] as last_id from rounds group by org_id) select org_id, (n > 0)::int as flag, n::int as n, a, b, last_id from w""")
def f31_f33_window_features(spark, d):
    a, b = date(1996, 1, 1), date(1997, 12, 31)
    rows = features.event_arrays(S.rounds(spark, d), "org_id", "announced_on", {"id": "id"}, "e").withColumn("days", F.transform("e", lambda x: x["day"]))
    inside = dates.days_between(F.col("days"), a, b)
    return rows.select("org_id", dates.any_between(F.col("days"), a, b).alias("flag"), F.size(inside).alias("n"), dates.first_day(inside).alias("a"), dates.last_day(inside).alias("b"), dates.last_id(F.col("e")).alias("last_id"))


@query("select conv_id, turn, case when regexp_matches(text, '^Question,? ') or role = 'system' then 'Procedural' else role end as kind from conversations")
def f39_speech_class(spark, d):
    rows = S.read(spark, d, "conversations")
    heading = F.when(F.col("role") == "system", F.lit("Preamble")).otherwise(F.lit(""))
    return rows.select("conv_id", "turn", T.speech_class(F.col("text"), heading, F.col("role")).alias("kind"))


@query(f"""{C}, f as (select date_trunc('quarter', founded_on)::date as period, count(*) as n_founded from companies where founded_on is not null group by 1), r as (select date_trunc('quarter', announced_on)::date as period, count(*) as n_rounds, round(sum(amount), 2) as raised from rounds group by 1),
cal as (select unnest(generate_series(date '1995-01-01', date '2001-10-01', interval 3 month))::date as period) select period, coalesce(n_founded, 0) as n_founded, coalesce(n_rounds, 0) as n_rounds, coalesce(raised, 0) as raised from cal left join f using (period) left join r using (period)""")
def t4_company_series(spark, d):
    return funding.company_series(S.companies(spark, d), S.rounds(spark, d), "quarter", 1995, 2001).withColumn("raised", F.round("raised", 2))


@query(f"""{R}, y as (select kind as category, 'orders' as signal, year(announced_on) as year, count(*)::double as v from rounds group by all union all select event_type, 'events', 1995 + (epoch(ts)::bigint // 86400 % 7) as year, count(*)::double from events group by all),
g as (select signal, category, avg(v) as magnitude, 100 * (max(case when year = 2000 then v end) - max(case when year = 1996 then v end)) / nullif(max(case when year = 1996 then v end), 0) as growth from y where year between 1996 and 2000 group by all),
m as (select *, median(magnitude) over (partition by signal) as mid from g) select signal, category, round(magnitude, 6) as magnitude, round(growth, 6) as growth,
coalesce(case when growth > 0 and magnitude < mid then 'emerging' when growth > 0 then 'hot' when growth < 0 and magnitude < mid then 'dormant' when growth < 0 then 'stable' end || case when abs((magnitude - mid) / mid) < 0.1 then '*' else '' end || case when abs(growth) < 0.1 then '*' else '' end, 'n/a') as trend from m""")
def t18_combined_signals(spark, d):
    a = S.rounds(spark, d).groupBy(F.col("kind").alias("category"), F.lit("orders").alias("signal"), F.year("announced_on").alias("year")).agg(F.count("*").cast("double").alias("v"))
    day = F.unix_date(F.col("ts").cast("date"))
    b = S.read(spark, d, "events").groupBy(F.col("event_type").alias("category"), F.lit("events").alias("signal"), (1995 + day % 7).cast("int").alias("year")).agg(F.count("*").cast("double").alias("v"))
    found = series.magnitude_and_growth(a.unionByName(b), "v", 1996, 2000, 1, ["signal", "category"])
    typed = series.trend_type(found, "magnitude", "growth", ["signal"])
    return typed.select("signal", "category", F.round("magnitude", 6).alias("magnitude"), F.round("growth", 6).alias("growth"), "trend")


@query(f"{C} select industry as category, id from companies where id not in (select org_id from rounds where kind = '5-LOW')")
def t20_category_ids(spark, d):
    rejected = S.rounds(spark, d).where("kind = '5-LOW'").select(F.col("org_id").alias("id"))
    return S.companies(spark, d).select(F.col("industry").alias("category"), "id").join(rejected, "id", "left_anti").select("category", "id")


@query("select id, min(k)::int as k from (select c_custkey as id, 0 as k from customer where c_custkey % 2 = 0 union all select o_custkey, 1 from orders) group by id")
def u2_union_dedupe(spark, d):
    from farglass.sources import tables

    a = S.read(spark, d, "customer").where("c_custkey % 2 = 0").select(F.col("c_custkey").alias("id"), F.lit(0).alias("k"))
    b = S.read(spark, d, "orders").select(F.col("o_custkey").alias("id"), F.lit(1).alias("k"))
    return tables.combine([a, b], ["id"], ["k"])


@query(f"{DOCS} select id, regexp_matches(text, '(?:\\s|^)the(?:,?\\s|\\.|$)') as has_the from docs where not regexp_matches(text, '(?:\\s|^)und(?:,?\\s|\\.|$)')")
def x7_x8_wordish(spark, d):
    return docs(spark, d).where(~F.col("text").rlike(search.wordish(["und"]))).select("id", F.col("text").rlike(search.wordish(["the"])).alias("has_the"))


@query(f"{DOCS} select distinct id, year, lang, len(text) as n_chars from docs where coalesce(text, '') <> ''")
def x13_metadata(spark, d):
    return docs(spark, d).where(F.coalesce("text", F.lit("")) != "").select("id", "year", "lang", F.char_length("text").cast("long").alias("n_chars")).dropDuplicates(["id"])


@query(f"{DOCS} select id, list_filter(regexp_split_to_array(regexp_replace(lower(text), 'https?://\\S+|www\\.\\S+', ' ', 'g'), '[^\\p{{L}}'']+'), lambda w: len(w) >= 2 and w not in ('the', 'and', 'of')) as tokens from docs")
def n1_tokens(spark, d):
    return docs(spark, d).select("id", collocation.tokens(F.col("text"), ["the", "and", "of"]).alias("tokens"))


@query(f"""{DOCS}, parts as (select id, list_filter(list_transform(regexp_split_to_array(regexp_replace(text, '([.!?])\\s+', '\\1\n', 'g'), '\n+'), lambda s: trim(s)), lambda s: s <> '') as p from docs),
cut as (select id, pos, list_filter(regexp_split_to_array(lower(sentence), '[^\\p{{L}}'']+'), lambda x: len(x) >= 1) as w from (select id, unnest(p) as sentence, generate_subscripts(p, 1) - 1 as pos from parts)),
places as (select id, pos, w, unnest(range(0, len(w))) as k from cut where list_contains(w, 'the'))
select id, pos::int as pos, k::int as "at", array_to_string(w[greatest(k - 2, 0) + 1 : k + 3], ' ') as phrase from places where w[k + 1] = 'the'""")
def n13_term_patterns(spark, d):
    cut = search.sentences(docs(spark, d), ["id", "year"], "text").withColumn("words", collocation.tokens(F.col("sentence"), least=1))
    return collocation.term_patterns(cut, ["id", "pos"], "words", "the")


@query("select vec_id, round(p1 / nullif(p1 + p2, 0), 9) as relevance, case when p1 >= p2 then 0 else 1 end as best from (select vec_id, abs(embedding[1])::double as p1, abs(embedding[2])::double as p2 from embeddings)")
def v14_relevance(spark, d):
    p = [F.abs(F.get("embedding", F.lit(k))).cast("double") for k in (0, 1)]
    best = (F.array_position(F.array(*p), F.array_max(F.array(*p))) - 1).cast("int")
    return S.read(spark, d, "embeddings").select("vec_id", F.round(vectors.relevance_score(*p), 9).alias("relevance"), best.alias("best"))


@query(f"""{R}, a as (select id, org_id, announced_on as start, amount, 0 as is_second from rounds where kind = '1-URGENT' union all select p.project_id, l_suppkey, p.start, p.amount, 1 from (select project_id, start, amount from (with {S.PROJECTS} select * from projects)) p join (select distinct l_orderkey, l_suppkey from lineitem where l_linenumber = 1) on project_id = l_orderkey)
select org_id, count(*) as n_grants, round(sum(amount), 2) as total, max(is_second) as has_second, (max((start, id, amount)))[3] as last_amount from a group by org_id""")
def d2_grants(spark, d):
    first = grants.standardise(S.rounds(spark, d).where("kind = '1-URGENT'"), id="id", org="org_id", start="announced_on", amount="amount", second=False)
    leads = S.read(spark, d, "lineitem").where("l_linenumber = 1").select(F.col("l_orderkey").alias("project_id"), "l_suppkey").distinct()
    second = grants.standardise(S.projects(spark, d).join(leads, "project_id"), id="project_id", org="l_suppkey", start="start", amount="amount", second=True)
    return grants.summary(first.unionByName(second)).withColumn("total", F.round("total", 2))


def _clean_sql(x: str) -> str:
    return f"trim(regexp_replace(lower({x}), '[^a-z0-9]+', ' ', 'g'))"


def _grams_sql(x: str) -> str:
    return f"list_distinct(list_transform(range(1, greatest(len({x}) - 2, 1) + 1), lambda i: substr({x}, i, 3)))"


_ALIKE = "len(list_intersect(a.g, b.g)) / len(list_distinct(list_concat(a.g, b.g)))"


@query(f"""with a as (select *, {_grams_sql('clean')} as g from (select c_custkey as id, 'c' || c_custkey || '.com' as site, {_clean_sql('c_name')} as clean, regexp_replace(lower(c_name), '[^a-z0-9]', '', 'g') as key, c_nationkey as country from customer)),
b as (select *, {_grams_sql('clean')} as g from (select s_suppkey as id, 'c' || s_suppkey * 3 || '.com' as site, {_clean_sql('s_name')} as clean, regexp_replace(lower(s_name), '[^a-z0-9]', '', 'g') as key, s_nationkey as country from supplier)),
one as (select a.id as left_id, min(b.id) as right_id, 'site' as how from a join b using (site) group by a.id),
two as (select a.id as left_id, min(b.id) as right_id, 'name' as how from a join b using (key, country) where a.id not in (select left_id from one) group by a.id),
rest as (select * from a where id not in (select left_id from one union all select left_id from two))
select * from one union all select * from two union all select a.id, b.id, 'similar' from rest a join b using (country) where {_ALIKE} >= 0.5""")
def l1_company_lookup(spark, d):
    a = S.read(spark, d, "customer").select(F.col("c_custkey").alias("id"), F.col("c_name").alias("name"), F.concat(F.lit("https://www.c"), F.col("c_custkey").cast("string"), F.lit(".com/")).alias("site"), F.col("c_nationkey").alias("country"))
    b = S.read(spark, d, "supplier").select(F.col("s_suppkey").alias("id"), F.col("s_name").alias("name"), F.concat(F.lit("http://c"), (F.col("s_suppkey") * 3).cast("string"), F.lit(".com")).alias("site"), F.col("s_nationkey").alias("country"))
    return linking.company_lookup(a, b, least=0.5)


@query(f"""with a as (select id, country, {_grams_sql('clean')} as g from (select c_custkey as id, {_clean_sql('c_name')} as clean, c_nationkey as country from customer union all select c_custkey, {_clean_sql("'Supplier#' || lpad(c_custkey::varchar, 9, '0')")}, c_nationkey from customer where c_custkey % 2 = 0)),
b as (select s_suppkey as id, s_nationkey as country, {_grams_sql(_clean_sql('s_name'))} as g from supplier)
select id, list_sort(list(distinct other)) as matches from (select a.id, b.id as other from a join b using (country) where {_ALIKE} >= 0.6) group by id""")
def l2_organisation_lookup(spark, d):
    key = F.col("c_custkey")
    legal = F.when(key % 2 == 0, F.concat(F.lit("Supplier#"), F.lpad(key.cast("string"), 9, "0")))
    organisations = S.read(spark, d, "customer").select(key.alias("id"), F.col("c_name").alias("name"), legal.alias("legal_name"), F.col("c_nationkey").alias("country"))
    research = S.read(spark, d, "supplier").select(F.col("s_suppkey").alias("id"), F.col("s_name").alias("name"), F.col("s_nationkey").alias("country"))
    return linking.organisation_lookup(organisations, research, 0.6)


@query("select l_orderkey as k, count(*) as n from lineitem group by l_orderkey, l_linenumber having count(*) > 1")
def q1_repeated_keys(spark, d):
    return S.read(spark, d, "lineitem").groupBy(F.col("l_orderkey").alias("k"), "l_linenumber").agg(F.count("*").alias("n")).where("n > 1").select("k", "n")
