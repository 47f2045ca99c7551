"""User functions: Arrow batches where a built-in function can't say it, never a row at a time."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from weft.plans.catalog import query
from weft.sources.tables import sql, table


@F.pandas_udf(T.DoubleType())
def scaled(value: pd.Series) -> pd.Series:
    return (value * 2 + 1).round(6)


@query("SELECT event_id, round(value * 2 + 1, 6) AS scaled FROM events")
def udf_pandas(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "events").select("event_id", scaled("value").alias("scaled"))


def _big(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        yield batch.filter(pc.greater(batch.column("value"), 50.0))


@query("SELECT event_id, value FROM events WHERE value > 50")
def map_in_arrow(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "events").select("event_id", "value").mapInArrow(_big, "event_id long, value double")


def _sessions(pdf: pd.DataFrame) -> pd.DataFrame:
    pdf = pdf.sort_values(["ts", "event_id"])
    start = pdf.ts.diff() > pd.Timedelta(hours=6)
    return pd.DataFrame({"user_id": [pdf.user_id.iloc[0]], "sessions": [int(start.sum()) + 1]})


@query("SELECT user_id, count(*) FILTER (gap IS NULL OR gap > INTERVAL 6 HOUR) AS sessions FROM (SELECT user_id, ts - lag(ts) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS gap FROM events) GROUP BY user_id")
def apply_in_pandas(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A user's events are one group in a task; the built-in form is batch.session_windows."""
    return table(spark, sf_dir, "events").select("user_id", "event_id", "ts").groupBy("user_id").applyInPandas(_sessions, "user_id long, sessions long")


@F.pandas_udf(T.DoubleType())
def spread_of(value: pd.Series) -> float:
    return float(value.max() - value.min())


@query("SELECT event_type, max(value) - min(value) AS spread FROM events GROUP BY event_type")
def udaf_pandas(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "events").groupBy("event_type").agg(spread_of("value").alias("spread"))


@F.udtf(returnType=T.StructType([T.StructField("position", T.IntegerType()), T.StructField("word", T.StringType())]))
class Words:
    def eval(self, text: str) -> Iterator[tuple[int, str]]:
        yield from enumerate(text.split(" ")) if text is not None else ()


@query("SELECT p_partkey, CAST(generate_subscripts(w, 1) - 1 AS INTEGER) AS position, unnest(w) AS word FROM (SELECT p_partkey, string_split(p_name, ' ') AS w FROM part)")
def udtf_words(spark: SparkSession, sf_dir: str) -> DataFrame:
    spark.udtf.register("weft_words", Words)
    return sql(spark, sf_dir, "SELECT p_partkey, position, word FROM part, LATERAL weft_words(p_name)", "part")


@query("SELECT s_suppkey, round(s_acctbal * 2 + 1, 2) AS raised FROM supplier")
def sql_function(spark: SparkSession, sf_dir: str) -> DataFrame:
    spark.sql("CREATE OR REPLACE TEMPORARY FUNCTION weft_raised(x DOUBLE) RETURNS DOUBLE RETURN round(x * 2 + 1, 2)")
    return sql(spark, sf_dir, "SELECT s_suppkey, weft_raised(s_acctbal) AS raised FROM supplier", "supplier")


@F.arrow_udf(T.DoubleType())
def lifted(value: pa.Array) -> pa.Array:
    return pc.add(pc.multiply(value, 3.0), 1.0)


@query("SELECT event_id, value * 3 + 1 AS lifted FROM events")
def udf_arrow(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "events").select("event_id", lifted("value").alias("lifted"))


def _small(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for frame in frames:
        yield frame[frame.value <= 50]


@query("SELECT event_id, value FROM events WHERE value <= 50")
def map_in_pandas(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "events").select("event_id", "value").mapInPandas(_small, "event_id long, value double")


def _range(group: pa.Table) -> pa.Table:
    ends = pc.min_max(group.column("value"))
    return pa.table({"user_id": group.column("user_id").slice(0, 1), "low": pa.array([ends["min"].as_py()], pa.float64()), "high": pa.array([ends["max"].as_py()], pa.float64())})


@query("SELECT user_id, min(value) AS low, max(value) AS high FROM events GROUP BY user_id")
def apply_in_arrow(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A user's events are one group in a task."""
    return table(spark, sf_dir, "events").select("user_id", "value").groupBy("user_id").applyInArrow(_range, "user_id long, low double, high double")


def _both(orders: pa.Table, events: pa.Table) -> pa.Table:
    key = (orders if orders.num_rows else events).column("k").slice(0, 1)
    return pa.table({"k": key, "orders": pa.array([orders.num_rows], pa.int64()), "events": pa.array([events.num_rows], pa.int64())})


@query("SELECT k, coalesce(o, 0) AS orders, coalesce(e, 0) AS events FROM (SELECT o_custkey AS k, count(*) AS o FROM orders GROUP BY k) FULL JOIN (SELECT user_id AS k, count(*) AS e FROM events GROUP BY k) USING (k)")
def cogroup_in_arrow(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Both sides' rows of a key in one task, also where one side has none."""
    orders = table(spark, sf_dir, "orders").select(F.col("o_custkey").alias("k"))
    events = table(spark, sf_dir, "events").select(F.col("user_id").alias("k"))
    return orders.groupBy("k").cogroup(events.groupBy("k")).applyInArrow(_both, "k long, orders long, events long")


def _partial_spread(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        part = pa.table(batch).group_by("event_type").aggregate([("value", "min"), ("value", "max")])
        yield from part.select(["event_type", "value_min", "value_max"]).to_batches()


@query("SELECT event_type, max(value) - min(value) AS spread FROM events GROUP BY event_type")
def udaf_partial(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A user's aggregate with partial results: a row for each batch and key leaves the first stage, so a hot key isn't one task's."""
    parts = table(spark, sf_dir, "events").select("event_type", "value").mapInArrow(_partial_spread, "event_type string, low double, high double")
    return parts.groupBy("event_type").agg((F.max("high") - F.min("low")).alias("spread"))


@F.arrow_udtf(returnType="p_partkey long, size int, doubled int")
class Doubled:
    """Over a whole table, a batch at a time."""

    def eval(self, batch: pa.RecordBatch) -> Iterator[pa.Table]:
        size = batch.column("p_size")
        yield pa.table({"p_partkey": batch.column("p_partkey"), "size": size, "doubled": pc.multiply(size, pa.scalar(2, pa.int32()))})


@query("SELECT p_partkey, p_size AS size, CAST(p_size * 2 AS INTEGER) AS doubled FROM part")
def udtf_arrow(spark: SparkSession, sf_dir: str) -> DataFrame:
    spark.udtf.register("weft_doubled", Doubled)
    return sql(spark, sf_dir, "SELECT p_partkey, size, doubled FROM weft_doubled(TABLE(part))", "part")
