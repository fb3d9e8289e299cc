"""Queries on sources and sinks: each writes to the shared folder and reads back."""

from __future__ import annotations

from pyspark.sql import functions as F

from farglass.plans import standins as S
from farglass.plans.registry import query
from farglass.runtime import scratch_path
from farglass.sources import tables

CUSTOMERS = "c_custkey long, c_name string, c_acctbal double"


def customers(spark, d):
    return S.read(spark, d, "customer").select(F.col("c_custkey").cast("long").alias("c_custkey"), "c_name", "c_acctbal")


@query("select c_custkey as id, c_name as name, c_acctbal as balance from customer")
def s1_s11_csv_with_header(spark, d):
    path = scratch_path(spark, "customers.csv")
    tables.write_table(customers(spark, d), path, kind="csv")
    return tables.read_csv(spark, path, CUSTOMERS).select(F.col("c_custkey").alias("id"), F.col("c_name").alias("name"), F.col("c_acctbal").alias("balance"))


@query("select distinct c_custkey::varchar as id, c_mktsegment as kind from customer")
def s2_text_rows(spark, d):
    rows = S.read(spark, d, "customer").select(F.col("c_custkey").cast("string").alias("id"), F.col("c_mktsegment").alias("kind"))
    odd = spark.createDataFrame([("no id", "x"), (None, "y")], "id string, kind string")
    path = scratch_path(spark, "twice.csv")
    tables.write_table(rows.union(rows).union(odd), path, kind="csv")
    return tables.read_text_table(spark, path, ["id", "kind"], id_column="id", id_pattern="^[0-9]+$")


@query("select o_custkey as id, o_orderkey as first_order from orders qualify row_number() over (partition by o_custkey order by o_orderdate, o_orderkey) = 1")
def s3_first_row_by_key(spark, d):
    rows = S.read(spark, d, "orders").select(F.col("o_custkey").alias("id"), F.col("o_orderkey").alias("first_order"), "o_orderdate")
    return tables.first_by_key(rows, ["id"], ["o_orderdate", "first_order"]).select("id", "first_order")


@query("select n_nationkey::varchar as id, n_name as name from nation")
def s4_csv_without_header(spark, d):
    path = scratch_path(spark, "nations.csv")
    S.read(spark, d, "nation").select(F.col("n_nationkey").cast("string"), "n_name").write.csv(path)
    return tables.read_csv(spark, path, "id string, name string", header=False)


@query("select r_regionkey::bigint as id, r_name as name from region")
def s5_json_array(spark, d):
    path = scratch_path(spark, "regions") + ".json"
    rows = S.read(spark, d, "region").select(F.struct(F.col("r_regionkey").alias("id"), F.col("r_name").alias("name")).alias("x"))
    rows.agg(F.to_json(F.collect_list("x"))).coalesce(1).write.text(path)  # a fixed handful of rows in one array
    return tables.read_any(spark, path, schema="id long, name string")


@query("select r_regionkey::bigint as id, r_name || ' é' as name from region")
def s7_csv_latin_1(spark, d):
    path = scratch_path(spark, "latin")
    S.read(spark, d, "region").select(F.col("r_regionkey").alias("id"), F.concat("r_name", F.lit(" é")).alias("name")).write.option("header", True).option("encoding", "ISO-8859-1").csv(path)
    return tables.read_csv(spark, path, "id long, name string", encoding="ISO-8859-1")


@query("select c_custkey as id, c_name as name from customer")
def s10_appended_chunks(spark, d):
    path = scratch_path(spark, "chunks")
    rows = S.read(spark, d, "customer").select(F.col("c_custkey").cast("long").alias("id"), F.col("c_name").alias("name"))
    for k in range(3):
        tables.write_table(rows.where(F.col("id") % 3 == k), path, kind="csv", mode="append")
    return tables.read_csv(spark, path, "id long, name string")


@query("select id, max(kind) as kind, max(city) as city from (select c_custkey as id, c_mktsegment as kind, null as city from customer union all select o_custkey, null, null from orders where o_custkey not in (select c_custkey from customer)) group by id")
def s12_folder_of_tables(spark, d):
    folder = scratch_path(spark, "folder")
    tables.write_table(S.read(spark, d, "customer").select(F.col("c_custkey").alias("id"), F.col("c_mktsegment").alias("kind")), f"{folder}/a.csv", kind="csv")
    tables.write_table(S.read(spark, d, "orders").select(F.col("o_custkey").alias("id"), F.lit(None).cast("string").alias("city")).distinct(), f"{folder}/b.csv", kind="csv")
    a = tables.read_any(spark, f"{folder}/a.csv", schema="id long, kind string")
    b = tables.read_any(spark, f"{folder}/b.csv", schema="id long, city string")
    return tables.combine([a, b], ["id"], [F.col("kind").desc_nulls_last()])


@query("select p_type as line from part group by p_type")
def s13_text_lines(spark, d):
    path = scratch_path(spark, "lines")
    S.read(spark, d, "part").select("p_type").distinct().write.text(path)
    return spark.read.text(path).select(F.col("value").alias("line"))


@query("select 2000 + doc_id % 20 as year, source, count(*) as n from documents group by all")
def s17_hits_per_year(spark, d):
    return S.read(spark, d, "documents").groupBy((2000 + F.col("doc_id") % 20).alias("year"), "source").agg(F.count("*").alias("n"))


@query("select n_nationkey::bigint as n_nationkey, n_name, n_regionkey::bigint as n_regionkey from nation")
def s19_records(spark, d):
    rows = S.read(spark, d, "nation").select("n_nationkey", "n_name", "n_regionkey")
    told = tables.records(rows, "n_nationkey").withColumn("fields", F.from_json("record", "n_name string, n_regionkey long"))
    return tables.flatten_struct(told, "fields", ["n_nationkey"]).withColumn("n_nationkey", F.col("n_nationkey").cast("long"))


@query("select conv_id, turn, role, length(text) as n_chars from conversations")
def s20_xml_speeches(spark, d):
    path = scratch_path(spark, "speeches")
    rows = S.read(spark, d, "conversations").select(F.col("conv_id").alias("_conv"), F.col("turn").alias("_turn"), F.col("role").alias("speaker"), F.col("text").alias("body"))
    rows.write.format("xml").option("rowTag", "speech").option("rootTag", "debate").save(path)
    schema = "_conv long, _turn long, speaker string, body string"
    made = tables.read_speeches(spark, path, schema=schema)
    return made.select(F.col("_conv").alias("conv_id"), F.col("_turn").alias("turn"), F.col("speaker").alias("role"), F.char_length("body").alias("n_chars"))


@query("select p_partkey as id, string_split(p_name, ' ') as tokens from part")
def s21_token_corpus(spark, d):
    path = scratch_path(spark, "corpus")
    tables.write_table(S.read(spark, d, "part").select(F.col("p_partkey").alias("id"), F.split("p_name", " ").alias("tokens")), path)
    return tables.read_any(spark, path + "/*.parquet")


@query("select l_orderkey as project_id, l_partkey as other_id from lineitem where l_returnflag = 'R'")
def s22_link_table(spark, d):
    path = scratch_path(spark, "links")
    links = S.read(spark, d, "lineitem").select(F.col("l_orderkey").alias("project_id"), F.col("l_partkey").alias("other_id"), F.col("l_returnflag").alias("table_name"))
    tables.write_table(links, path, partition_by=["table_name"])
    return spark.read.parquet(path).where("table_name = 'R'").drop("table_name")


@query("select distinct s_suppkey as id, s_name as name from supplier where s_suppkey % 4 <> 0")
def s23_names_by_id(spark, d):
    rows = S.read(spark, d, "supplier").select(F.col("s_suppkey").alias("id"), F.when(F.col("s_suppkey") % 4 != 0, F.col("s_name")).alias("name"))
    return tables.names_by_id(rows.union(rows), "id", "name")


@query("select 'nation' as name, count(*) as n from nation union all select 'region', count(*) from region union all select 'supplier', count(*) from supplier")
def s25_s26_s27_extract_and_catalogue(spark, d):
    folder, source = scratch_path(spark, "extract"), tables.Catalogue(spark, d)
    names = ("nation", "region", "supplier")
    for name in names:
        tables.write_table(source[name], f"{folder}/{name}.parquet")
    made = tables.Catalogue(spark, folder)
    counts = [made[name].agg(F.lit(name).alias("name"), F.count("*").alias("n")) for name in names]
    return counts[0].unionByName(counts[1]).unionByName(counts[2])
