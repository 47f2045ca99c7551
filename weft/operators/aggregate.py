"""Aggregations; all combine on the map side before they shuffle."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from weft.operators.ranges import running
from weft.plans.catalog import query
from weft.sources.tables import settled, sql, table


@query("""
SELECT l_returnflag, l_linestatus, round(sum(l_quantity), 2) AS sum_qty, round(sum(l_extendedprice * (1 - l_discount)), 2) AS revenue,
       round(avg(l_discount), 8) AS avg_discount, min(l_shipdate) AS first_ship, max(l_shipdate) AS last_ship, count(*) AS n_lines
FROM lineitem WHERE l_shipdate <= TIMESTAMP '2000-09-02' GROUP BY l_returnflag, l_linestatus""")
def pricing_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    lines = table(spark, sf_dir, "lineitem").where(F.col("l_shipdate") <= F.lit("2000-09-02").cast("timestamp_ntz"))
    return lines.groupBy("l_returnflag", "l_linestatus").agg(
        F.round(F.sum("l_quantity"), 2).alias("sum_qty"), F.round(F.sum(F.col("l_extendedprice") * (1 - F.col("l_discount"))), 2).alias("revenue"), F.round(F.avg("l_discount"), 8).alias("avg_discount"),
        F.min("l_shipdate").alias("first_ship"), F.max("l_shipdate").alias("last_ship"), F.count("*").alias("n_lines"),
    )


@query("SELECT l_returnflag, count(DISTINCT l_partkey) AS n_parts, count(DISTINCT (l_partkey, l_suppkey)) AS n_pairs FROM lineitem GROUP BY l_returnflag")
def count_distinct(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "lineitem").groupBy("l_returnflag").agg(F.countDistinct("l_partkey").alias("n_parts"), F.countDistinct("l_partkey", "l_suppkey").alias("n_pairs"))


CONDITIONAL = """
SELECT l_suppkey, count(*) FILTER (WHERE l_returnflag = 'R') AS returned, round(sum(l_quantity) FILTER (WHERE l_discount > 0.05), 2) AS discounted_qty FROM lineitem GROUP BY l_suppkey"""


@query(CONDITIONAL)
def conditional_aggregate(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sql(spark, sf_dir, CONDITIONAL, "lineitem")


def _grouped(by: str) -> str:
    return f"SELECT l_returnflag, l_linestatus, CAST(grouping(l_returnflag) * 2 + grouping(l_linestatus) AS BIGINT) AS level, count(*) AS n_lines FROM lineitem GROUP BY {by}"


@query(_grouped("GROUPING SETS ((l_returnflag), (l_linestatus), ())"))
def grouping_sets(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sql(spark, sf_dir, _grouped("GROUPING SETS ((l_returnflag), (l_linestatus), ())"), "lineitem")


@query(_grouped("CUBE (l_returnflag, l_linestatus)"))
def cube(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "lineitem").cube("l_returnflag", "l_linestatus").agg(F.grouping_id().cast("long").alias("level"), F.count("*").alias("n_lines"))


@query(_grouped("ROLLUP (l_returnflag, l_linestatus)"))
def rollup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "lineitem").rollup("l_returnflag", "l_linestatus").agg(F.grouping_id().cast("long").alias("level"), F.count("*").alias("n_lines"))


@query("SELECT l_linestatus, round(stddev_samp(l_quantity), 6) AS sd, round(stddev_pop(l_quantity), 6) AS sd_pop, round(var_samp(l_quantity), 6) AS var, round(corr(l_quantity, l_extendedprice), 6) AS corr FROM lineitem GROUP BY l_linestatus")
def spread(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "lineitem").groupBy("l_linestatus").agg(
        F.round(F.stddev("l_quantity"), 6).alias("sd"), F.round(F.stddev_pop("l_quantity"), 6).alias("sd_pop"), F.round(F.variance("l_quantity"), 6).alias("var"), F.round(F.corr("l_quantity", "l_extendedprice"), 6).alias("corr")
    )


def quantiles(df: DataFrame, by: list[str], value: str, continuous: dict[str, float], discrete: dict[str, float]) -> DataFrame:
    """Exact quantiles of each key, by name: continuous ones interpolate, discrete ones are values of the column; nulls don't count."""
    return quantiles_of(df, by, {value: (continuous, discrete)})


def quantiles_of(df: DataFrame, by: list[str], asked: dict[str, tuple[dict[str, float], dict[str, float]]]) -> DataFrame:
    """Exact quantiles of several columns of one type: {column: ({name: continuous}, {name: discrete})}. A key without values has nulls.

    One pass over the rows: equal values of key and column are counted, and
    running counts over ranges of them tell which value holds a rank. No task
    holds a key's values, and only the values asked for go on.
    """
    each = F.explode(F.array(*[F.struct(F.lit(i).alias("_of"), F.col(c).alias("_value")) for i, c in enumerate(asked)])).alias("_x")
    counts = df.select(*by, each).select(*by, "_x.*").groupBy(*by, "_of", "_value").agg(F.count("_value").alias("_n"))
    ran = running(counts, [*by, "_of"], ["_value"], _upto=("sum", "_n"))
    total = ran.groupBy(*by, "_of").agg(F.max("_upto").alias("_total"))
    ranks = []
    for i, (continuous, discrete) in enumerate(asked.values()):
        here = F.col("b._of") == i
        ranks += [(name, end, here, rounded((F.col("_total") - 1) * q)) for name, q in continuous.items() for end, rounded in (("low", F.floor), ("high", F.ceil))]
        ranks += [(name, "low", here, F.greatest(F.lit(0).cast("long"), F.ceil(F.col("_total") * q) - 1)) for name, q in discrete.items()]
    same = [F.col(f"a.{c}").eqNullSafe(F.col(f"b.{c}")) for c in [*by, "_of"]]
    held = ran.alias("a").join(total.alias("b"), same)
    holds = lambda here, rank: here & (rank >= F.col("_upto") - F.col("_n")) & (rank < F.col("_upto"))
    wanted = held.where(reduce(lambda x, y: x | y, [holds(here, rank) for _, _, here, rank in ranks]))
    ends = wanted.groupBy(*[f"a.{c}" for c in by]).agg(*[F.max(F.when(holds(here, rank), F.col("_value"))).alias(f"_{name}_{end}") for name, end, here, rank in ranks])
    parts = total.groupBy(*by).agg(*[F.max(F.when(F.col("_of") == i, F.col("_total"))).alias(f"_total_{i}") for i in range(len(asked))])
    found = []
    for i, (continuous, discrete) in enumerate(asked.values()):
        last = F.col(f"_total_{i}") - 1
        found += [(F.col(f"_{name}_low") + (F.col(f"_{name}_high") - F.col(f"_{name}_low")) * (last * q - F.floor(last * q))).alias(name) for name, q in continuous.items()]
        found += [F.col(f"_{name}_low").alias(name) for name in discrete]
    return parts.alias("a").join(ends.alias("b"), [F.col(f"a.{c}").eqNullSafe(F.col(f"b.{c}")) for c in by], "left").select(*[f"a.{c}" for c in by], *found)


@query("SELECT l_returnflag, round(median(l_extendedprice), 4) AS med, round(quantile_cont(l_extendedprice, 0.9), 4) AS p90, quantile_disc(l_quantity, 0.25) AS q25 FROM lineitem GROUP BY l_returnflag")
def percentiles(spark: SparkSession, sf_dir: str) -> DataFrame:
    lines = table(spark, sf_dir, "lineitem")
    found = quantiles_of(lines, ["l_returnflag"], {"l_extendedprice": ({"med": 0.5, "p90": 0.9}, {}), "l_quantity": ({}, {"q25": 0.25})})
    return found.select("l_returnflag", F.round("med", 4).alias("med"), F.round("p90", 4).alias("p90"), "q25")


@query()
def approximate(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "lineitem").groupBy("l_returnflag").agg(F.approx_count_distinct("l_partkey").alias("parts"), F.hll_sketch_estimate(F.hll_sketch_agg("l_partkey")).alias("parts_hll"), F.percentile_approx("l_extendedprice", 0.5).alias("med"))


#: Errors that the sketches below may have: of a number of distinct values (12 bits of registers: 1.6 % is one standard deviation), and of a rank.
DISTINCT_ERROR, RANK_ERROR = 0.08, 0.02


@query("SELECT l_returnflag, count(DISTINCT l_partkey) AS parts, count(DISTINCT l_orderkey) AS orders, TRUE AS close FROM lineitem GROUP BY l_returnflag")
def distinct_sketches(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sketches kept by month, as a warehouse would, and merged by flag; beside the exact numbers, whether they are close."""
    lines = table(spark, sf_dir, "lineitem")
    kept = settled(lines.groupBy("l_returnflag", F.date_trunc("month", "l_shipdate").alias("month")).agg(F.hll_sketch_agg("l_partkey", 12).alias("p"), F.hll_sketch_agg("l_orderkey", 12).alias("o")))
    merged = kept.groupBy("l_returnflag").agg(F.hll_sketch_estimate(F.hll_union_agg("p")).alias("p"), F.hll_sketch_estimate(F.hll_union_agg("o")).alias("o"))
    exact = lines.groupBy("l_returnflag").agg(F.countDistinct("l_partkey").alias("parts"), F.countDistinct("l_orderkey").alias("orders"))
    near = lambda a, b: F.abs(F.col(a) - F.col(b)) <= DISTINCT_ERROR * F.col(b)
    return exact.join(merged, "l_returnflag").select("l_returnflag", "parts", "orders", (near("p", "parts") & near("o", "orders")).alias("close"))


@query("SELECT l_returnflag, count(*) AS n, TRUE AS close FROM lineitem GROUP BY l_returnflag")
def quantile_sketches(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Quantile sketches kept by month and merged by flag; whether the true ranks of their quartiles, counted in a second pass, are close to what was asked."""
    lines = table(spark, sf_dir, "lineitem").select("l_returnflag", "l_shipdate", "l_extendedprice")
    kept = settled(lines.groupBy("l_returnflag", F.date_trunc("month", "l_shipdate").alias("month")).agg(F.kll_sketch_agg_double("l_extendedprice", 400).alias("s")))
    asked = [0.25, 0.5, 0.75]
    cuts = kept.groupBy("l_returnflag").agg(F.kll_merge_agg_double("s").alias("s")).select("l_returnflag", *[F.kll_sketch_get_quantile_double("s", F.lit(q)).alias(f"q{i}") for i, q in enumerate(asked)])
    below = lines.join(cuts, "l_returnflag").groupBy("l_returnflag").agg(F.count("*").alias("n"), *[F.count_if(F.col("l_extendedprice") <= F.col(f"q{i}")).alias(f"n{i}") for i in range(len(asked))])
    return below.select("l_returnflag", "n", reduce(lambda a, b: a & b, [F.abs(F.col(f"n{i}") / F.col("n") - q) <= RANK_ERROR for i, q in enumerate(asked)]).alias("close"))


@query("SELECT n_regionkey, string_agg(n_name, ',' ORDER BY n_name) AS nations FROM nation GROUP BY n_regionkey")
def ordered_strings(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sql(spark, sf_dir, "SELECT n_regionkey, listagg(n_name, ',') WITHIN GROUP (ORDER BY n_name) AS nations FROM nation GROUP BY n_regionkey", "nation")


@query("""
SELECT o_orderstatus, o_orderpriority AS mode FROM (SELECT o_orderstatus, o_orderpriority, row_number() OVER (PARTITION BY o_orderstatus ORDER BY count(*) DESC, o_orderpriority) AS k
FROM orders GROUP BY o_orderstatus, o_orderpriority) WHERE k = 1""")
def most_frequent(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The most frequent value, of ties the first: counts first, then the least of their pairs."""
    counts = table(spark, sf_dir, "orders").groupBy("o_orderstatus", "o_orderpriority").agg((-F.count("*")).alias("n"))
    return counts.groupBy("o_orderstatus").agg(F.min(F.struct("n", "o_orderpriority")).alias("x")).select("o_orderstatus", F.col("x.o_orderpriority").alias("mode"))
