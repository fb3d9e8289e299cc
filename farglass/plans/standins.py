"""The driver's tables in the roles of the library's data model."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def rounds(spark, d) -> DataFrame:
    """Orders as funding rounds."""
    return read(spark, d, "orders").select(
        F.col("o_orderkey").alias("id"), F.col("o_custkey").alias("org_id"), F.col("o_orderdate").cast("date").alias("announced_on"), F.col("o_totalprice").alias("amount"), F.col("o_orderpriority").alias("kind")
    )


def companies(spark, d) -> DataFrame:
    """Customers as companies, founded on their first order's day."""
    places = read(spark, d, "nation").join(read(spark, d, "region"), F.col("n_regionkey") == F.col("r_regionkey"))
    first = rounds(spark, d).groupBy("org_id").agg(F.min("announced_on").alias("founded_on"), F.count("*").alias("n_deals"), F.sum("amount").alias("funding"))
    who = read(spark, d, "customer").join(F.broadcast(places), F.col("c_nationkey") == F.col("n_nationkey")).join(first, F.col("c_custkey") == F.col("org_id"), "left")
    return who.select(F.col("c_custkey").alias("id"), F.col("c_name").alias("name"), F.col("n_name").alias("country"), F.col("r_name").alias("region"), F.col("c_mktsegment").alias("industry"), "founded_on", "n_deals", "funding")


def projects(spark, d) -> DataFrame:
    """Orders as research projects, from the order to the last shipment."""
    last = read(spark, d, "lineitem").groupBy("l_orderkey").agg(F.max("l_shipdate").cast("date").alias("end"), F.sum("l_quantity").alias("quantity"))
    orders = read(spark, d, "orders").join(last, F.col("o_orderkey") == F.col("l_orderkey"))
    return orders.select(
        F.col("o_orderkey").alias("project_id"), F.concat(F.lit("T"), (F.col("o_orderkey") % 500).cast("string")).alias("title"), F.concat(F.lit("D"), (F.col("o_custkey") % 7).cast("string")).alias("description"),
        F.col("o_orderdate").cast("date").alias("start"), "end", F.col("quantity").alias("amount"), F.col("o_orderpriority").alias("category"),
    )


#: The same in SQL, as WITH clauses to put before a query.
ROUNDS = "rounds as (select o_orderkey as id, o_custkey as org_id, o_orderdate::date as announced_on, o_totalprice as amount, o_orderpriority as kind from orders)"
COMPANIES = (
    ROUNDS
    + ", firsts as (select org_id, min(announced_on) as founded_on, count(*) as n_deals, sum(amount) as funding from rounds group by org_id)"
    + ", companies as (select c_custkey as id, c_name as name, n_name as country, r_name as region, c_mktsegment as industry, founded_on, n_deals, funding"
    + " from customer join nation on c_nationkey = n_nationkey join region on n_regionkey = r_regionkey left join firsts on c_custkey = org_id)"
)
PROJECTS = (
    "lasts as (select l_orderkey, max(l_shipdate)::date as \"end\", sum(l_quantity) as quantity from lineitem group by l_orderkey), "
    "projects as (select o_orderkey as project_id, 'T' || (o_orderkey % 500) as title, 'D' || (o_custkey % 7) as description, o_orderdate::date as start, \"end\", quantity as amount, o_orderpriority as category"
    " from orders join lasts on o_orderkey = l_orderkey)"
)
