"""Queries for rows of the survey that others only touch on the way."""

from __future__ import annotations

from datetime import date

import pandas as pd
from pyspark.ml import PipelineModel
from pyspark.sql import functions as F

from farglass import cli
from farglass.functions import dates
from farglass.functions import text as T
from farglass.operators import collocation, features, search, series, shape, vectors
from farglass.operators.discourse import Discourse
from farglass.plans import standins as S
from farglass.plans.money import MAGNITUDE, YEARLY, yearly
from farglass.plans.registry import query
from farglass.plans.texts import DOCS, TOKENS, _scored, docs
from farglass.runtime import scratch_path
from farglass.sources import tables

R, C = f"with {S.ROUNDS}", f"with {S.COMPANIES}"


@query("select o_orderkey as id, o_custkey as org, c_name from orders join customer on o_custkey = c_custkey")
def p4_drop_suffixed(spark, d):
    a = S.read(spark, d, "orders").select(F.col("o_orderkey").alias("id"), F.col("o_custkey").alias("org"))
    b = S.read(spark, d, "customer").select(F.col("c_custkey").alias("org"), "c_name", F.col("c_acctbal").alias("id_drop"), F.col("c_mktsegment").alias("kind_drop"))
    return shape.drop_columns(a.join(b, "org"), ["_drop"]).select("id", "org", "c_name")


@query("select o_custkey as id, make_date(min(year(o_orderdate)), 1, 1) as founded_on from orders where o_custkey % 7 <> 0 group by o_custkey")
def p17_founded_from_year(spark, d):
    rows = S.read(spark, d, "orders").where("o_custkey % 7 <> 0").select(F.col("o_custkey").alias("id"), F.date_format("o_orderdate", "yyyy-MM-dd").alias("day"), "o_orderkey")
    first = tables.first_by_key(rows, ["id"], ["day", "o_orderkey"])
    return first.select("id", T.impute_month(F.substring("day", 1, 4)).alias("founded_on"))


@query("select c_custkey as left_id, c_name as left_name, s_suppkey as right_id, s_name as right_name from customer join supplier on c_custkey = s_suppkey * 2")
def j17_matches_back(spark, d):
    matches = S.read(spark, d, "supplier").select((F.col("s_suppkey") * 2).alias("left_id"), F.col("s_suppkey").alias("right_id"))
    a = S.read(spark, d, "customer").select(F.col("c_custkey").alias("left_id"), F.col("c_name").alias("left_name"))
    b = S.read(spark, d, "supplier").select(F.col("s_suppkey").alias("right_id"), F.col("s_name").alias("right_name"))
    return matches.join(a, "left_id").join(b, "right_id").select("left_id", "left_name", "right_id", "right_name")


@query("""with q as (select embedding as qv from embeddings where vec_id = 0) select vec_id, round(list_cosine_similarity(embedding::double[], qv::double[]), 6) as similarity from embeddings, q where vec_id <> 0""")
def j23_one_against_all(spark, d):
    store = S.read(spark, d, "embeddings")
    one = store.where("vec_id = 0").select(F.col("embedding").alias("one")).limit(1)
    scored = store.where("vec_id <> 0").crossJoin(F.broadcast(one))  # a single row
    return scored.select("vec_id", F.round(vectors.cosine(F.col("embedding"), F.col("one")), 6).alias("similarity"))


@query(f"""{R}, y as (select date_trunc('year', announced_on)::date as period, count(*) as n, round(sum(amount::decimal(18, 2))::double, 2) as usd, round(sum((amount / 2)::decimal(18, 4))::double, 4) as gbp from rounds group by 1),
cal as (select unnest(generate_series(date '1994-01-01', date '2002-01-01', interval 1 year))::date as period) select period, coalesce(n, 0) as n, coalesce(usd, 0) as usd, coalesce(gbp, 0) as gbp from cal left join y using (period)""")
def a5_investments_per_period(spark, d):
    amount = F.col("amount")
    sums = {"n": F.count("*"), "usd": F.round(F.sum(amount.cast("decimal(18,2)")).cast("double"), 2), "gbp": F.round(F.sum((amount / 2).cast("decimal(18,4)")).cast("double"), 4)}
    return series.fill_periods(series.period_totals(S.rounds(spark, d), "announced_on", "year", sums), "year", 1994, 2002)


@query(f"{DOCS}, y as (select distinct year from docs), n as (select year, (row_number() over (order by year) - 1) // 3 as chunk from y), e as (select chunk, min(year) || '-' || max(year) as period from n group by chunk) select period, source as phrase, count(*) as n from docs join n using (year) join e using (chunk) group by all")
def a19_phrases_per_period(spark, d):
    return search.period_chunks(docs(spark, d), "year", 3).groupBy("period", F.col("source").alias("phrase")).agg(F.count("*").alias("n"))


@query(YEARLY + ", l as (select industry, list(n_rounds order by year) as v from yearly group by industry) select industry, v as per_year from l")
def r12_series_as_rows(spark, d):
    return yearly(spark, d).groupBy("industry").agg(F.transform(F.sort_array(F.collect_list(F.struct("year", "n_rounds"))), lambda x: x["n_rounds"]).alias("per_year"))


@query(f"{DOCS} select id, regexp_replace(text, '([a-z])([A-Z])([a-z])', '\\1. \\2\\3', 'g') as repaired from docs")
def f3_repaired_sentences(spark, d):
    return docs(spark, d).select("id", T.repair_sentences(F.col("text")).alias("repaired"))


@query("select k, ' ' || lower(trim(k)) || ' ' as padded, ' ' || lower(trim(k)) || 's ' as plural from (select distinct p_type as k from part)")
def f19_keywords(spark, d):
    keys = S.read(spark, d, "part").select(F.col("p_type").alias("k")).distinct()
    low = F.lower(F.trim("k"))
    return keys.select("k", F.concat(F.lit(" "), low, F.lit(" ")).alias("padded"), F.concat(F.lit(" "), low, F.lit("s ")).alias("plural"))


@query("select n_nationkey as id, case when n_regionkey = 0 then null else round(100.0 * (n_nationkey - n_regionkey) / n_regionkey, 6) end as change from nation")
def f23_percentage_change(spark, d):
    return S.read(spark, d, "nation").select(F.col("n_nationkey").alias("id"), F.round(series.percentage_change(F.col("n_regionkey"), F.col("n_nationkey")), 6).alias("change"))


@query(f"{R} select org_id, count(*) filter (announced_on between date '1996-01-01' and date '1997-12-31')::int as n, min(announced_on) filter (announced_on between date '1996-01-01' and date '1997-12-31') as first_on, max(announced_on) filter (announced_on between date '1996-01-01' and date '1997-12-31') as last_on from rounds group by org_id")
def f32_dates_in_window(spark, d):
    rows = features.event_arrays(S.rounds(spark, d), "org_id", "announced_on", {"id": "id"}, "e").withColumn("days", F.transform("e", lambda x: x["day"]))
    inside = dates.days_between(F.col("days"), date(1996, 1, 1), date(1997, 12, 31))
    return rows.select("org_id", F.size(inside).alias("n"), dates.first_day(inside).alias("first_on"), dates.last_day(inside).alias("last_on"))


@query("select p_partkey as id, lower(split_part(p_type, ' ', 1)) as answer, string_split(split_part(p_name, ' ', 1) || ' and ' || split_part(p_name, ' ', 2), ' and ') as categories from part")
def f37_answers(spark, d):
    parts = S.read(spark, d, "part")
    told = F.concat(F.lit("Answer: "), F.split_part("p_type", F.lit(" "), F.lit(1)), F.lit("."))
    pair = F.concat(F.split_part("p_name", F.lit(" "), F.lit(1)), F.lit(" and "), F.split_part("p_name", F.lit(" "), F.lit(2)))
    return parts.select(F.col("p_partkey").alias("id"), F.lower(F.regexp_extract(told, r"Answer:\s*(\w+)", 1)).alias("answer"), F.split(pair, " and ").alias("categories"))


@query(YEARLY + " select industry, year, n_rounds from yearly")
def t7_category_series(spark, d):
    return yearly(spark, d).select("industry", "year", "n_rounds")


@query(MAGNITUDE + " select industry, round(magnitude, 2) as magnitude from mg")
def t10_magnitude(spark, d):
    return series.magnitude_and_growth(yearly(spark, d), "raised", 1996, 2000, 3, ["industry"]).select("industry", F.round("magnitude", 2).alias("magnitude"))


@query(MAGNITUDE + " select industry, round(growth, 6) as growth from mg")
def t11_growth(spark, d):
    return series.magnitude_and_growth(yearly(spark, d), "raised", 1996, 2000, 3, ["industry"]).select("industry", F.round("growth", 6).alias("growth"))


@query(MAGNITUDE + " select industry, round(smoothed_growth, 6) as growth from mg")
def t12_smoothed_growth(spark, d):
    return series.magnitude_and_growth(yearly(spark, d), "raised", 1996, 2000, 3, ["industry"]).select("industry", F.round("smoothed_growth", 6).alias("growth"))


@query(f"{DOCS} select id, coalesce(contains(text, 'the'), false) as present from docs")
def x1_term_present(spark, d):
    return docs(spark, d).select("id", F.coalesce(search.has_all(F.col("text"), ["the"]), F.lit(False)).alias("present"))


@query(f"{DOCS} select id from docs where contains(text, 'the') and contains(text, 'of')")
def x2_x5_all_terms(spark, d):
    return docs(spark, d).where(search.has_all(F.col("text"), ["the", "of"])).select("id")


@query("with c as (select 'documents' as corpus, doc_id::varchar as id, text from documents union all select 'conversations', conv_id || '-' || turn, text from conversations) select corpus, id, list_filter(regexp_split_to_array(regexp_replace(lower(text), 'https?://\\S+|www\\.\\S+', ' ', 'g'), '[^\\p{L}'']+'), lambda w: len(w) >= 2) as tokens from c")
def n3_tokenise_corpora(spark, d):
    path = scratch_path(spark, "tokens")
    talk = S.read(spark, d, "conversations").select(F.lit("conversations").alias("corpus"), F.concat_ws("-", F.col("conv_id").cast("string"), F.col("turn").cast("string")).alias("id"), "text")
    rows = S.read(spark, d, "documents").select(F.lit("documents").alias("corpus"), F.col("doc_id").cast("string").alias("id"), "text").union(talk)
    tables.write_table(rows.select("corpus", "id", collocation.tokens(F.col("text")).alias("tokens")), path, partition_by=["corpus"])
    return spark.read.parquet(path).select("corpus", "id", "tokens")


@query(TOKENS + """, cb as (select year, ngram, max(pmi) as pmi, sum("both")::bigint as freq from pm where pmi > 0 group by all having sum("both") > 2) select year, ngram, freq, row_number() over (partition by year order by freq desc, ngram) - 1 as rank from cb""")
def n11_term_ranks(spark, d):
    return collocation.combine_terms(_scored(spark, d), ["year"]).select("year", "ngram", "freq", "rank")


@query("select count(*) as n, count(*) as n_same from documents join labels using (doc_id)")
def v12_model_saved_and_loaded(spark, d):
    rows = S.read(spark, d, "documents").join(S.read(spark, d, "labels"), "doc_id").select("doc_id", collocation.tokens(F.col("text")).alias("words"), F.col("quality").cast("double").alias("label"))
    model, path = vectors.train_classifier(rows, "words", "label", 1 << 10), scratch_path(spark, "model")
    model.write().save(path)
    both = vectors.probability(model, rows).select("doc_id", "p").join(vectors.probability(PipelineModel.load(path), rows, "q").select("doc_id", "q"), "doc_id")
    return both.agg(F.count("*").alias("n"), F.count(F.when(F.col("p") == F.col("q"), 1)).alias("n_same"))


@query("select distinct r_name as region_label, r_regionkey as region_key from region")
def d4_prefixed_columns(spark, d):
    rows = S.read(spark, d, "region").select(F.col("r_name").alias("label"), F.col("r_regionkey").alias("key"))
    return rows.union(rows).toDF(*(f"region_{c}" for c in rows.columns)).distinct()


@query("select c_custkey as id, upper(left(c_name, 3)) || length(c_name) as code from customer")
def ud1_function_of_a_column(spark, d):
    @F.pandas_udf("string")
    def code(names: pd.Series) -> pd.Series:
        return names.str[:3].str.upper() + names.str.len().astype(str)

    return S.read(spark, d, "customer").select(F.col("c_custkey").alias("id"), code("c_name").alias("code"))


@query(f"{C} select country, count(*) as n from companies where industry = 'BUILDING' group by country")
def ud2_table_functions(spark, d):
    def in_industry(rows, name):
        return rows.where(F.col("industry") == name)

    def per_country(rows):
        return rows.groupBy("country").agg(F.count("*").alias("n"))

    return S.companies(spark, d).transform(in_industry, "BUILDING").transform(per_country)


@query(f"{R} select kind, round(max(amount) - min(amount), 2) as spread from rounds group by kind")
def ud3_custom_aggregate(spark, d):
    def spread(c):
        return F.max(c) - F.min(c)

    return S.rounds(spark, d).groupBy("kind").agg(F.round(spread("amount"), 2).alias("spread"))


@query(f"{DOCS} select id, contains(lower(text), 'the') as plain, regexp_matches(lower(text), '(?:\\s|^)the(?:,?\\s|\\.|$)') as wordish from docs")
def ud4_pluggable_search(spark, d):
    ways = {"plain": lambda c: F.contains(c, F.lit("the")), "wordish": lambda c: c.rlike(search.wordish(["the"]))}
    return docs(spark, d).select("id", *(way(F.lower("text")).alias(name) for name, way in ways.items()))


SPOKEN = f"""{DOCS}, low as (select id, year, lower(text) as text from docs), found as (select * from low where regexp_matches(text, '(?:\\s|^)the(?:,?\\s|\\.|$)|(?:\\s|^)und(?:,?\\s|\\.|$)')),
parts as (select id, year, list_filter(list_transform(regexp_split_to_array(regexp_replace(text, '([.!?])\\s+', '\\1\n', 'g'), '\n+'), lambda s: trim(s)), lambda s: s <> '') as p from found),
cut as (select id, year, unnest(p) as sentence from parts)"""


@query(SPOKEN + """ select year, count(distinct id) as n_documents, count(*) as n_sentences from cut where regexp_matches(sentence, '(?:\\s|^)the(?:,?\\s|\\.|$)|(?:\\s|^)und(?:,?\\s|\\.|$)') group by year""")
def x14_discourse_mentions(spark, d):
    return Discourse(docs(spark, d), ["the", "und"]).mention_counts


@query(SPOKEN + """, t as (select year, count(*) as total from docs group by year), c as (select year, count(*) as n from found group by year) select year, coalesce(n, 0) as n, total, coalesce(n, 0) / total as share from t left join c using (year)""")
def x14_discourse_shares(spark, d):
    return Discourse(docs(spark, d), ["the", "und"]).shares


@query(f"""{C}, r as (select region, date_trunc('year', announced_on)::date as period, count(*) as n_rounds, round(sum(amount), 2) as raised from rounds join companies on org_id = companies.id group by all),
f as (select region, date_trunc('year', founded_on)::date as period, count(*) as n_founded from companies where founded_on is not null group by all),
cal as (select unnest(generate_series(date '1994-01-01', date '2002-01-01', interval 1 year))::date as period), g as (select distinct region from companies)
select region, period, coalesce(n_founded, 0) as n_founded, coalesce(n_rounds, 0) as n_rounds, coalesce(raised, 0) as raised from g cross join cal left join f using (region, period) left join r using (region, period)""")
def t8_command_line(spark, d):
    """The company series by region, by way of the command line."""
    folder = scratch_path(spark, "cli")
    tables.write_table(S.companies(spark, d), f"{folder}/companies.parquet")
    tables.write_table(S.rounds(spark, d), f"{folder}/rounds.parquet")
    cli.main(["companies", "--companies", f"{folder}/companies.parquet", "--rounds", f"{folder}/rounds.parquet", "--out", f"{folder}/out", "--by", "region", "--first", "1994", "--last", "2002"], spark)
    return spark.read.parquet(f"{folder}/out").select("region", "period", "n_founded", "n_rounds", F.round("raised", 2).alias("raised"))
