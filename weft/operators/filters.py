"""Scans, projections, predicates, subqueries and reshaping."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from weft.plans.catalog import query
from weft.sources.tables import sql, table


@query("SELECT l_orderkey, l_linenumber, l_partkey FROM lineitem")
def scan_projection(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey")


@query()
def sample_repeatable(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "lineitem").sample(0.1, seed=7).select("l_orderkey", "l_partkey", "l_quantity")


@query("SELECT o_orderkey, o_custkey, o_totalprice FROM orders WHERE md5(CAST(o_orderkey AS VARCHAR)) < '199a'")
def sample_by_key(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A tenth of the keys by their hash: the same rows in any engine, order and partitioning, and of any table with that key."""
    return table(spark, sf_dir, "orders").where(F.md5(F.col("o_orderkey").cast("string")) < "199a").select("o_orderkey", "o_custkey", "o_totalprice")


@query("SELECT l_orderkey, l_partkey, round(l_extendedprice * (1 - l_discount) * (1 + l_tax), 2) AS charge FROM lineitem WHERE l_quantity > 49 AND l_shipdate >= TIMESTAMP '1998-01-01'")
def filter_project(spark: SparkSession, sf_dir: str) -> DataFrame:
    lines = table(spark, sf_dir, "lineitem").where((F.col("l_quantity") > 49) & (F.col("l_shipdate") >= F.lit("1998-01-01").cast("timestamp_ntz")))
    return lines.select("l_orderkey", "l_partkey", F.round(F.col("l_extendedprice") * (1 - F.col("l_discount")) * (1 + F.col("l_tax")), 2).alias("charge"))


@query("""
SELECT p_partkey, CASE WHEN p_size < 10 THEN 'small' WHEN p_size < 30 THEN 'medium' ELSE 'large' END AS size_class
FROM part WHERE p_type IN ('ECONOMY', 'PROMO') AND p_size BETWEEN 5 AND 40 AND p_brand LIKE 'Brand#%' AND regexp_matches(p_name, '^[a-m]')""")
def predicates(spark: SparkSession, sf_dir: str) -> DataFrame:
    parts = table(spark, sf_dir, "part").where(F.col("p_type").isin("ECONOMY", "PROMO") & F.col("p_size").between(5, 40) & F.col("p_brand").like("Brand#%") & F.col("p_name").rlike("^[a-m]"))
    return parts.select("p_partkey", F.when(F.col("p_size") < 10, "small").when(F.col("p_size") < 30, "medium").otherwise("large").alias("size_class"))


EXISTS = "SELECT o_orderkey FROM orders o WHERE EXISTS (SELECT 1 FROM lineitem l WHERE l.l_orderkey = o.o_orderkey AND l.l_quantity > 45)"


@query(EXISTS)
def correlated_exists(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sql(spark, sf_dir, EXISTS, "orders", "lineitem")


SCALAR = "SELECT l_orderkey, l_linenumber, l_partkey, l_quantity FROM lineitem l WHERE l_quantity > (SELECT 1.5 * avg(l_quantity) FROM lineitem x WHERE x.l_partkey = l.l_partkey)"


@query(SCALAR)
def scalar_subquery(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sql(spark, sf_dir, SCALAR, "lineitem")


LATERAL = "SELECT c_custkey, t.o_orderkey FROM customer c, LATERAL (SELECT o_orderkey FROM orders o WHERE o.o_custkey = c.c_custkey ORDER BY o_totalprice DESC, o_orderkey LIMIT 2) t"


#: The same with the places numbered by a window of our own: of a correlated ORDER BY with LIMIT Spark makes a window without an order, over rows sorted before a shuffle that may deal them in any order.
LATERAL_PLACES = """
SELECT c_custkey, t.o_orderkey FROM customer c, LATERAL (SELECT o_orderkey FROM (
    SELECT o_orderkey, o_custkey, row_number() OVER (PARTITION BY o_custkey ORDER BY o_totalprice DESC NULLS LAST, o_orderkey NULLS LAST) AS place FROM orders
) o WHERE o.o_custkey = c.c_custkey AND o.place <= 2) t"""


@query(LATERAL)
def lateral_top_orders(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sql(spark, sf_dir, LATERAL_PLACES, "customer", "orders")


TYPES = ("click", "error", "purchase", "signup", "view")


@query(f"SELECT user_id, {', '.join(f'count(*) FILTER (event_type = {t!r}) AS {t}s' for t in TYPES)} FROM events GROUP BY user_id")
def pivot(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The types are named, so that no job has to find them."""
    wide = table(spark, sf_dir, "events").groupBy("user_id").pivot("event_type", list(TYPES)).agg(F.count(F.lit(1)))
    return wide.select("user_id", *[F.coalesce(c, F.lit(0)).cast("long").alias(f"{c}s") for c in TYPES])


@query("""
SELECT p_partkey, 'size' AS measure, CAST(p_size AS DOUBLE) AS amount FROM part UNION ALL SELECT p_partkey, 'price', p_retailprice FROM part""")
def unpivot(spark: SparkSession, sf_dir: str) -> DataFrame:
    parts = table(spark, sf_dir, "part").select("p_partkey", F.col("p_size").cast("double").alias("size"), F.col("p_retailprice").alias("price"))
    return parts.unpivot("p_partkey", ["size", "price"], "measure", "amount")
