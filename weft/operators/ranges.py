"""Windows over ranges: one hot key, or no key at all, spreads over tasks.

The rows are dealt by ranges of key and order and settled; a row's range is a
column. A key that runs over several ranges carries on from one to the next:
what it has come to before a range is found among one row for each key and
range. Only the first key of a range can have begun before it, so at most one
row a range is carried, and the window itself runs within key and range.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from weft.plans.catalog import query
from weft.sources.tables import settled, table


def _sorted(order: list[str]) -> list[Column]:
    """Columns in rising order, nulls first; with a minus before the name falling, nulls last."""
    return [F.desc(c[1:]) if c[0] == "-" else F.asc(c) for c in order]


def running(df: DataFrame, by: list[str], order: list[str], **columns: tuple[str, str] | tuple[str]) -> DataFrame:
    """The rows with columns over all rows of the same key up to this one, those of the same order too.

    columns, by name: ("row_number",), ("rank",), ("dense_rank",), or ("sum", c),
    ("count", c), ("last", c): the last value of c that isn't null, for rising orders.
    by may be empty: then all rows are one sequence. Null keys are keys like
    others; row numbers of equal orders are in no fixed order; a sum of nothing is null.
    """
    sorts, names = _sorted(order), [c.lstrip("-") for c in order]
    ranged = settled(df.withColumn("_all", F.lit(0)).repartitionByRange(*by, *sorts).withColumn("_part", F.spark_partition_id()))
    key = by or ["_all"]
    held: dict[str, Column] = {}
    for name, (kind, *of) in columns.items():
        if kind in ("row_number", "rank"):
            held[name] = F.count("*")
        elif kind == "dense_rank":
            held[name] = F.count_distinct(F.struct(*names))
        elif kind == "last":
            held[name] = F.max(F.when(F.col(of[0]).isNotNull(), F.struct(*names, F.col(of[0]).alias("_of"))))
        else:
            held[name] = {"sum": F.sum, "count": F.count}[kind](of[0])
    ends = ranged.groupBy(*key, "_part").agg(*[c.alias(f"_end_{name}") for name, c in held.items()])
    earlier = W.partitionBy(*key).orderBy("_part").rowsBetween(W.unboundedPreceding, -1)
    carry = {name: F.last(f"_end_{name}", True) if columns[name][0] == "last" else F.sum(f"_end_{name}") for name in columns}
    carried = ends.select(*key, "_part", F.count("*").over(earlier).alias("_ranges"), *[c.over(earlier).alias(f"_before_{name}") for name, c in carry.items()]).where("_ranges > 0").drop("_ranges")
    same = [F.col(f"a.{c}").eqNullSafe(F.col(f"b.{c}")) for c in [*key, "_part"]]
    rows = ranged.alias("a").join(F.broadcast(carried.alias("b")), same, "left").select("a.*", *[f"_before_{name}" for name in columns])  # a row a range at most
    w = W.partitionBy(*key, "_part").orderBy(*sorts)
    found = []
    for name, (kind, *of) in columns.items():
        before = F.col(f"_before_{name}")
        if kind == "last":
            found.append(F.coalesce(F.last(of[0], True).over(w), before["_of"]))
        elif kind == "sum":
            here = F.sum(of[0]).over(w)
            found.append(F.when(here.isNull(), before).otherwise(here + F.coalesce(before, F.lit(0))))
        elif kind == "count":
            found.append(F.count(of[0]).over(w) + F.coalesce(before, F.lit(0)))
        else:
            found.append({"row_number": F.row_number, "rank": F.rank, "dense_rank": F.dense_rank}[kind]().over(w).cast("long") + F.coalesce(before, F.lit(0)))
    return rows.select(*df.columns, *[c.alias(name) for name, c in zip(columns, found, strict=True)])


@query("""
SELECT o_orderkey, row_number() OVER w AS rn, CAST(sum(CAST(round(o_totalprice * 100) AS BIGINT)) OVER w AS BIGINT) AS cents
FROM orders WINDOW w AS (ORDER BY o_totalprice DESC, o_orderkey)""")
def global_order(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Row numbers and running sums of a whole table."""
    orders = table(spark, sf_dir, "orders").select("o_orderkey", "o_totalprice", F.round(F.col("o_totalprice") * 100).cast("long").alias("c"))
    return running(orders, [], ["-o_totalprice", "o_orderkey"], rn=("row_number",), cents=("sum", "c")).select("o_orderkey", "rn", "cents")


@query("""
SELECT l_orderkey, l_partkey, l_suppkey, l_linenumber, l_returnflag, rank() OVER w AS rk, dense_rank() OVER w AS dr, CAST(sum(CAST(l_quantity AS BIGINT)) OVER w AS BIGINT) AS quantity, count(*) OVER w AS n
FROM lineitem WINDOW w AS (PARTITION BY l_returnflag ORDER BY l_shipdate)""")
def hot_key_ranks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Three keys hold the table; each spreads over ranges."""
    lines = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_partkey", "l_suppkey", "l_linenumber", "l_returnflag", "l_shipdate", F.col("l_quantity").cast("long").alias("q"))
    return running(lines, ["l_returnflag"], ["l_shipdate"], rk=("rank",), dr=("dense_rank",), quantity=("sum", "q"), n=("count", "l_orderkey")).drop("l_shipdate", "q")
