"""Recursion over a table: a fixpoint of joins, each round settled."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from weft.plans.catalog import query
from weft.sources.tables import settled, table


#: Rounds whose nodes stand in tables of their own before they are put together.
MERGED = 16


def reached(starts: DataFrame, edges: DataFrame) -> DataFrame:
    """(node, hops): the nodes that edges (source, target) lead to from starts (node), by the fewest edges.

    Each round goes on from the nodes that are new, by a join, a distinct before
    the shuffle's end and an anti join with what is known; circles end there.
    Null nodes and edges with a null end lead nowhere; repeated ones count once.
    """
    edges = settled(edges.select("source", "target").where("source IS NOT NULL AND target IS NOT NULL").distinct())
    fresh = settled(starts.select("node").where("node IS NOT NULL").distinct().withColumn("hops", F.lit(0).cast("long")))
    rounds = [fresh]
    while not fresh.isEmpty():
        known = reduce(DataFrame.unionByName, rounds).select("node")
        ahead = fresh.join(edges, F.col("node") == F.col("source")).select(F.col("target").alias("node"), F.col("hops") + 1).toDF("node", "hops").distinct()
        fresh = settled(ahead.join(known, "node", "left_anti"))
        rounds.append(fresh)
        if len(rounds) > MERGED:
            rounds = [settled(reduce(DataFrame.unionByName, rounds))]
    return reduce(DataFrame.unionByName, rounds)


LINKS = "l_discount >= 0.09 AND l_quantity >= 45"


@query(f"""
WITH RECURSIVE links AS (SELECT DISTINCT o_custkey AS customer, l_suppkey AS supplier FROM lineitem JOIN orders ON l_orderkey = o_orderkey WHERE {LINKS}),
edges AS (SELECT 2 * customer AS source, 2 * supplier + 1 AS target FROM links UNION ALL SELECT 2 * supplier + 1, 2 * customer FROM links),
walk(node, hops) AS (SELECT CAST(1 AS BIGINT), CAST(0 AS BIGINT) UNION SELECT target, hops + 1 FROM walk JOIN edges ON node = source WHERE hops < 60)
SELECT node, min(hops) AS hops FROM walk GROUP BY node""")
def recursive_cte(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Customers (even numbers) and suppliers (odd ones) linked by large discounted lines, from supplier 0 on."""
    links = table(spark, sf_dir, "lineitem").where(LINKS).join(table(spark, sf_dir, "orders"), F.col("l_orderkey") == F.col("o_orderkey")).select((2 * F.col("o_custkey")).alias("c"), (2 * F.col("l_suppkey") + 1).alias("s"))
    edges = links.select(F.col("c").alias("source"), F.col("s").alias("target")).unionByName(links.select(F.col("s").alias("source"), F.col("c").alias("target")))
    return reached(spark.range(1, 2).withColumnRenamed("id", "node"), edges)
