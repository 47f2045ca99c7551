"""Window functions and top-k."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from weft.plans.catalog import query
from weft.sources.tables import sql, table


@query("""
SELECT o_orderkey, row_number() OVER w AS rn, rank() OVER p AS rk, dense_rank() OVER p AS dr, ntile(4) OVER w AS quarter,
       round(percent_rank() OVER w, 8) AS pr, round(cume_dist() OVER w, 8) AS cd
FROM orders WINDOW w AS (PARTITION BY o_custkey ORDER BY o_totalprice, o_orderkey), p AS (PARTITION BY o_custkey ORDER BY o_orderpriority)""")
def ranks(spark: SparkSession, sf_dir: str) -> DataFrame:
    w, p = W.partitionBy("o_custkey").orderBy("o_totalprice", "o_orderkey"), W.partitionBy("o_custkey").orderBy("o_orderpriority")
    long = lambda c, over, name: c.over(over).cast("long").alias(name)
    return table(spark, sf_dir, "orders").select(
        "o_orderkey", long(F.row_number(), w, "rn"), long(F.rank(), p, "rk"), long(F.dense_rank(), p, "dr"), long(F.ntile(4), w, "quarter"), F.round(F.percent_rank().over(w), 8).alias("pr"), F.round(F.cume_dist().over(w), 8).alias("cd")
    )


@query("""
SELECT event_id, lag(event_type) OVER w AS before, lead(event_type) OVER w AS after, first_value(event_id) OVER w AS first_id, nth_value(event_id, 2) OVER w AS second_id,
       last_value(CASE WHEN event_type = 'purchase' THEN event_id END IGNORE NULLS) OVER w AS last_buy
FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id)""")
def neighbours(spark: SparkSession, sf_dir: str) -> DataFrame:
    w = W.partitionBy("user_id").orderBy("ts", "event_id")
    return table(spark, sf_dir, "events").select(
        "event_id", F.lag("event_type").over(w).alias("before"), F.lead("event_type").over(w).alias("after"), F.first("event_id").over(w).alias("first_id"), F.nth_value("event_id", 2).over(w).alias("second_id"),
        F.last(F.when(F.col("event_type") == "purchase", F.col("event_id")), ignorenulls=True).over(w).alias("last_buy"),
    )


@query("SELECT o_orderkey, round(sum(o_totalprice) OVER (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey ROWS BETWEEN 2 PRECEDING AND CURRENT ROW), 2) AS last3 FROM orders")
def rows_frame(spark: SparkSession, sf_dir: str) -> DataFrame:
    w = W.partitionBy("o_custkey").orderBy("o_orderdate", "o_orderkey").rowsBetween(-2, 0)
    return table(spark, sf_dir, "orders").select("o_orderkey", F.round(F.sum("o_totalprice").over(w), 2).alias("last3"))


RANGE = "SELECT event_id, count(*) OVER (PARTITION BY user_id ORDER BY ts RANGE BETWEEN INTERVAL '1' HOUR PRECEDING AND CURRENT ROW) AS in_hour FROM events"


@query(RANGE)
def range_frame(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sql(spark, sf_dir, RANGE, "events")


@query("SELECT o_custkey, o_orderkey, k FROM (SELECT o_custkey, o_orderkey, row_number() OVER (PARTITION BY o_custkey ORDER BY o_totalprice DESC, o_orderkey) AS k FROM orders) WHERE k <= 3")
def top_per_group(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The limit is pushed below the shuffle as a group limit."""
    k = F.row_number().over(W.partitionBy("o_custkey").orderBy(F.desc("o_totalprice"), "o_orderkey"))
    return table(spark, sf_dir, "orders").select("o_custkey", "o_orderkey", k.cast("long").alias("k")).where("k <= 3")


@query("SELECT o_orderkey, o_totalprice FROM orders ORDER BY o_totalprice DESC, o_orderkey LIMIT 100")
def top_k(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "orders").orderBy(F.desc("o_totalprice"), "o_orderkey").limit(100).select("o_orderkey", "o_totalprice")


@query("SELECT c_custkey, c_acctbal FROM customer ORDER BY c_acctbal NULLS LAST, c_custkey")
def sort_all(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "customer").select("c_custkey", "c_acctbal").orderBy(F.asc_nulls_last("c_acctbal"), "c_custkey")
