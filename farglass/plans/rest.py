"""Queries that show the remaining operators."""

from __future__ import annotations

from datetime import date

from pyspark.sql import functions as F

from farglass.functions import html as H
from farglass.functions import text as T
from farglass.operators import checks, collocation, funding, linking, search, shape, topic_model, vectors
from farglass.plans import standins as S
from farglass.plans.more import docs
from farglass.plans.registry import query
from farglass.plans.texts import SENTENCES, TERMS, TOKENS, _scored, _sentences
from farglass.runtime import materialise, numbered

R, C, P = f"with {S.ROUNDS}", f"with {S.COMPANIES}", f"with {S.PROJECTS}"


@query(f"{C} select year(founded_on) as year, count(*) as n_founded from companies where founded_on is not null group by 1")
def a4_founded_per_year(spark, d):
    return S.companies(spark, d).where(F.col("founded_on").isNotNull()).groupBy(F.year("founded_on").alias("year")).agg(F.count("id").alias("n_founded"))


@query("select p_type as kind, count(*) as n, min(p_name) as example from part group by p_type order by n desc")
def a17_o3_top_values(spark, d):
    return S.read(spark, d, "part").groupBy(F.col("p_type").alias("kind")).agg(F.count("*").alias("n"), F.min("p_name").alias("example")).orderBy(F.desc("n"), "kind")


@query(f"{R} select o.o_orderkey as project_id, l_partkey as fund_id, l_shipdate::date as fund_start, l_extendedprice as amount from orders o join lineitem on o_orderkey = l_orderkey where l_returnflag = 'R' and l_extendedprice > 20000")
def j2_j3_project_funds(spark, d):
    funds = S.read(spark, d, "lineitem").where("l_returnflag = 'R' and l_extendedprice > 20000").select(F.col("l_orderkey").alias("project_id"), F.col("l_partkey").alias("fund_id"), F.col("l_shipdate").cast("date").alias("fund_start"), F.col("l_extendedprice").alias("amount"))
    return S.read(spark, d, "orders").select(F.col("o_orderkey").alias("project_id")).join(funds, "project_id")


@query("select c_custkey as id, coalesce(list_sort(list(p_type) filter (p_type is not null)), []) as industries from customer left join (select o_custkey, p_type from orders join lineitem on o_orderkey = l_orderkey join part on l_partkey = p_partkey) on c_custkey = o_custkey group by c_custkey")
def j9_industry_lists(spark, d):
    rows = S.read(spark, d, "orders").join(S.read(spark, d, "lineitem"), F.col("o_orderkey") == F.col("l_orderkey")).join(S.read(spark, d, "part"), F.col("l_partkey") == F.col("p_partkey"))
    companies = S.read(spark, d, "customer").select(F.col("c_custkey").alias("id"))
    listed = rows.select(F.col("o_custkey").alias("id"), "p_type")
    return companies.join(listed, "id", "left").groupBy("id").agg(F.sort_array(F.collect_list("p_type")).alias("industries"))


@query("select n_name as country, s_name as person, count(c_custkey) as n from nation join supplier on n_nationkey = s_nationkey left join customer on c_nationkey = n_nationkey and c_custkey = s_suppkey group by all")
def j10_inner_then_left(spark, d):
    people = S.read(spark, d, "nation").join(S.read(spark, d, "supplier"), F.col("n_nationkey") == F.col("s_nationkey"))
    joined = people.join(S.read(spark, d, "customer"), (F.col("c_nationkey") == F.col("n_nationkey")) & (F.col("c_custkey") == F.col("s_suppkey")), "left")
    return joined.groupBy(F.col("n_name").alias("country"), F.col("s_name").alias("person")).agg(F.count("c_custkey").alias("n"))


@query(f"{C}, f as (select org_id, count(*) as n, round(max(amount), 2) as most from rounds where announced_on < date '1996-01-01' group by org_id) select id, coalesce(n, 0) as n, coalesce(most, 0) as most from companies left join f on id = org_id")
def j20_features_back(spark, d):
    f = S.rounds(spark, d).where(F.col("announced_on") < date(1996, 1, 1)).groupBy(F.col("org_id").alias("id")).agg(F.count("*").alias("n"), F.round(F.max("amount"), 2).alias("most"))
    return S.companies(spark, d).select("id").join(f, "id", "left").fillna({"n": 0, "most": 0.0})


@query("""with p as (select page_id as id, lower(split_part(rtrim(replace(replace(replace(url, 'https://', ''), 'http://', ''), 'www.', ''), '/'), '/', 1)) as host from pages), b as (select host, min(id) as right_id from p where host <> '' group by host) select id as left_id, right_id, nullif(p.host, '') as host from p left join b on p.host = b.host and p.host <> ''""")
def j22_website_join(spark, d):
    p = S.read(spark, d, "pages").select(F.col("page_id").alias("id"), F.split_part(T.website(F.col("url")), F.lit("/"), F.lit(1)).alias("host")).withColumn("host", F.nullif("host", F.lit("")))
    known = p.where("host is not null").groupBy("host").agg(F.min("id").alias("right_id"))
    return p.join(known, "host", "left").select(F.col("id").alias("left_id"), "right_id", "host")


def _pairs(spark, d):
    sentences = materialise(_sentences(spark, d).select("year", "words"), "sentence_words")
    return collocation.term_pairs(sentences, "words", collocation.term_counts(sentences, "words", ["year"]), ["year"], TERMS)


@query(TOKENS + ' select year, term, ngram, "both" from co')
def n6_cooccurrence(spark, d):
    return _pairs(spark, d)


@query(TOKENS + ' select year, term, ngram, row_number() over (partition by year, term order by "both" desc, ngram) - 1 as rank, round((row_number() over (partition by year, term order by "both" desc, ngram) - 1) / count(*) over (partition by year, term), 9) as share from co')
def w7_ranked_terms(spark, d):
    return collocation.ranked(_pairs(spark, d), ["year"]).select("year", "term", "ngram", "rank", F.round("share", 9).alias("share"))


@query(TOKENS + ' select year, ngram, round(max(pmi), 6) as pmi, sum("both")::bigint as freq from pm where pmi > 0 group by all having sum("both") > 2')
def n8_n9_combined_terms(spark, d):
    return collocation.combine_terms(_scored(spark, d), ["year"]).select("year", "ngram", F.round("pmi", 6).alias("pmi"), "freq")


@query("select o_custkey as org, o_orderkey as id, row_number() over (order by o_orderdate, o_orderkey) - 1 as round_id from orders")
def w9_surrogate_ids(spark, d):
    rows = numbered(S.read(spark, d, "orders").select("o_custkey", "o_orderkey", "o_orderdate"), "o_orderdate", "o_orderkey")
    return rows.select(F.col("o_custkey").alias("org"), F.col("o_orderkey").alias("id"), F.col("rank").alias("round_id"))


@query(SENTENCES + " select year, count(*) as n_sentences, count(distinct id) as n_documents from sentences where contains(lower(sentence), 'the') and contains(lower(sentence), 'ing') group by year")
def x10_x11_comentions(spark, d):
    cut = search.sentences(docs(spark, d), ["id", "year"], "text").where(search.has_all(F.lower("sentence"), ["the", "ing"]))
    return cut.groupBy("year").agg(F.count("*").alias("n_sentences"), F.count_distinct("id").alias("n_documents"))


@query("select p_partkey as id, contains(lower(p_type), 'steel') as is_steel, case when p_size > 25 then 'large' when p_size > 10 then 'middle' else 'small' end as size, 'Tags: ' || array_to_string(list_sort(string_split(p_name, ' ')), ', ') as label from part")
def f34_f36_flags_and_labels(spark, d):
    parts = S.read(spark, d, "part")
    size = F.when(F.col("p_size") > 25, "large").when(F.col("p_size") > 10, "middle").otherwise("small")
    return parts.select(F.col("p_partkey").alias("id"), F.contains(F.lower("p_type"), F.lit("steel")).alias("is_steel"), size.alias("size"), F.concat(F.lit("Tags: "), F.array_join(F.sort_array(F.split("p_name", " ")), ", ")).alias("label"))


@query("""with l as (select o_custkey as id, list_sort(list(distinct o_orderpriority)) as p from orders group by o_custkey) select id, list_sort(list_distinct(flatten(list_transform(p, lambda x: case when x = '1-URGENT' then ['fast', 'all'] when x = '5-LOW' then ['slow', 'all'] else [x] end)))) as groups from l""")
def f35_parent_groups(spark, d):
    rows = S.read(spark, d, "orders").groupBy(F.col("o_custkey").alias("id")).agg(F.collect_set("o_orderpriority").alias("p"))
    return rows.select("id", F.sort_array(shape.parents(F.col("p"), {"1-URGENT": ["fast", "all"], "5-LOW": ["slow", "all"]}, "none")).alias("groups"))


@query("select s_suppkey as id, lower(regexp_replace(s_name, '\\s', '', 'g')) as code, s_acctbal / 2 as half, case when s_acctbal <> 0 then round(1000 / s_acctbal, 9) end as ratio from supplier")
def f25_f38_codes(spark, d):
    return S.read(spark, d, "supplier").select(F.col("s_suppkey").alias("id"), T.postcode(F.col("s_name")).alias("code"), (F.col("s_acctbal") / 2).alias("half"), F.round(F.try_divide(F.lit(1000.0), "s_acctbal"), 9).alias("ratio"))


@query("select user_id, event_id, date_trunc('milliseconds', ts) as at, strftime(ts, '%Y-%m-%d') as day from events")
def f29_millis(spark, d):
    at = F.timestamp_millis(F.unix_millis(F.col("ts").cast("timestamp")))
    return S.read(spark, d, "events").select("user_id", "event_id", at.cast("timestamp_ntz").alias("at"), F.date_format("ts", "yyyy-MM-dd").alias("day"))


@query("select page_id, regexp_replace(regexp_replace(regexp_replace(regexp_replace(regexp_extract(html, '(?s)<h1>(.*?)</h1>', 1), '&lt;?', '<', 'g'), '&gt;?', '>', 'g'), '&quot;?', '\"', 'g'), '&amp;?', '&', 'g') as title from pages")
def f12_decode_references(spark, d):
    return S.read(spark, d, "pages").select("page_id", H.decode_references(F.regexp_extract("html", "(?s)<h1>(.*?)</h1>", 1)).alias("title"))


@query()
def f8_f17_scrubbed(spark, d):
    return docs(spark, d).select("id", T.singulars(F.lower("text")).alias("singular"), T.scrub_description(F.col("text"), F.element_at(F.split("text", " "), 1)).alias("scrubbed"))


@query("select table_name, in_old, in_new, n_old, n_new from (values ('customer', true, true), ('orders', true, false)) t(table_name, in_old, in_new), (select (select count(*) from customer) as a, (select count(*) from orders) as b), lateral (select case when table_name = 'customer' then a else b end as n_old, case when table_name = 'customer' then a end as n_new) x")
def q2_snapshot_diff(spark, d):
    old = {t: S.read(spark, d, t) for t in ("customer", "orders")}
    return checks.snapshot_diff(old, {"customer": old["customer"].drop("c_name")}).withColumnRenamed("table", "table_name").select("table_name", "in_old", "in_new", "n_old", "n_new")


@query()
def v3_hash_embeddings(spark, d):
    words = docs(spark, d).select("id", collocation.tokens(F.col("text")).alias("words"))
    return vectors.hash_embeddings(words, "words", 64).select("id", "embedding")


@query()
def v7_divisive_clusters(spark, d):
    return vectors.divisive_clusters(S.read(spark, d, "embeddings"), "embedding", 4).select("vec_id", "cluster")


@query()
def v10_o5_document_topics(spark, d):
    texts = docs(spark, d).select("id", collocation.tokens(F.col("text"), least=3).alias("words"))
    found = topic_model.document_topics(topic_model.fit(texts, "id", "words", 3), texts, "id", "words")
    return found.withColumn("first", F.get("topics", F.lit(0))).orderBy(F.desc("first"), "id")


@query(f"{C} select id, (max((announced_on, rounds.id, kind, amount)))[3] as last_kind, (max((announced_on, rounds.id, kind, amount)))[4] as last_amount from (select id from companies) c join (select *, id as rid from rounds) rounds on c.id = org_id where announced_on < date '1999-01-01' group by c.id".replace("select id, (max", "select c.id, (max").replace("rounds.id, kind", "rid, kind"))
def d3_last_round(spark, d):
    r = S.rounds(spark, d).where(F.col("announced_on") < date(1999, 1, 1))
    last = F.max(F.struct("announced_on", F.col("id").alias("rid"), "kind", "amount"))
    return r.groupBy(F.col("org_id").alias("id")).agg(last.alias("l")).select("id", F.col("l.kind").alias("last_kind"), F.col("l.amount").alias("last_amount"))


@query(f"{R}, p as (select id, org_id, case when amount is null or amount / 1e3 < 0.001 then 'n/a' else '>0' end as has from rounds) select org_id, count(*) filter (has = '>0') as n_funded, bool_or(has = '>0') as any_funded from p group by org_id")
def d5_f22_update_rows(spark, d):
    funded = funding.amount_range(F.col("amount"), (), (">0",)) == ">0"
    return S.rounds(spark, d).groupBy("org_id").agg(F.count(F.when(funded, 1)).alias("n_funded"), F.bool_or(funded).alias("any_funded"))


@query("select c_custkey as id, list_sort(list(distinct o_orderpriority)) as kinds, max(case when o_orderpriority = '1-URGENT' then 1 else 0 end) as k_urgent, max(case when o_orderpriority = '5-LOW' then 1 else 0 end) as k_low from customer join orders on c_custkey = o_custkey group by c_custkey")
def r9_dummies(spark, d):
    rows = S.read(spark, d, "orders").groupBy(F.col("o_custkey").alias("id")).agg(F.sort_array(F.collect_set("o_orderpriority")).alias("kinds"))
    return shape.binarise(rows, "kinds", ["1-URGENT", "5-LOW"]).withColumnsRenamed({"1-URGENT": "k_urgent", "5-LOW": "k_low"})


@query("select c_custkey as id, c_name from customer where c_custkey not in (select o_custkey from orders) or c_custkey % 2 = 0")
def st2_resume(spark, d):
    customers = S.read(spark, d, "customer").select(F.col("c_custkey").alias("id"), "c_name")
    landed = S.read(spark, d, "orders").where("o_custkey % 2 <> 0").select(F.col("o_custkey").alias("id"))
    return linking.missing_from(customers, landed, "id")
