"""Set operations and duplicates."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from weft.plans.catalog import query
from weft.sources.tables import table


def _sides(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    return table(spark, sf_dir, "orders").select(F.col("o_custkey").alias("k")), table(spark, sf_dir, "events").select(F.col("user_id").alias("k"))


def _sql(op: str) -> str:
    return f"SELECT o_custkey AS k FROM orders {op} SELECT user_id FROM events"


@query(_sql("UNION ALL"))
def union_all(spark: SparkSession, sf_dir: str) -> DataFrame:
    a, b = _sides(spark, sf_dir)
    return a.unionAll(b)


@query(_sql("UNION"))
def union_distinct(spark: SparkSession, sf_dir: str) -> DataFrame:
    a, b = _sides(spark, sf_dir)
    return a.union(b).distinct()


@query(_sql("INTERSECT"))
def intersect(spark: SparkSession, sf_dir: str) -> DataFrame:
    a, b = _sides(spark, sf_dir)
    return a.intersect(b)


@query(_sql("INTERSECT ALL"))
def intersect_all(spark: SparkSession, sf_dir: str) -> DataFrame:
    a, b = _sides(spark, sf_dir)
    return a.intersectAll(b)


@query(_sql("EXCEPT"))
def except_distinct(spark: SparkSession, sf_dir: str) -> DataFrame:
    a, b = _sides(spark, sf_dir)
    return a.subtract(b)


@query(_sql("EXCEPT ALL"))
def except_all(spark: SparkSession, sf_dir: str) -> DataFrame:
    a, b = _sides(spark, sf_dir)
    return a.exceptAll(b)


@query("SELECT l_partkey, min(l_orderkey) AS l_orderkey FROM lineitem GROUP BY l_partkey")
def first_of_each(spark: SparkSession, sf_dir: str) -> DataFrame:
    """dropDuplicates keeps any row of a key; a minimum says which."""
    return table(spark, sf_dir, "lineitem").groupBy("l_partkey").agg(F.min("l_orderkey").alias("l_orderkey"))


@query("SELECT DISTINCT p_brand, p_type FROM part")
def distinct_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "part").select("p_brand", "p_type").distinct()
