"""Sources and sinks as queries: what is written is read again."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from weft.plans.catalog import query
from weft.session import setting
from weft.sources.row_groups import RowGroups
from weft.sources.tables import read, scratch, settled, stream, table, write
from weft.streaming.events import to_parquet


@query("SELECT o_orderkey, o_custkey, o_orderstatus FROM orders WHERE o_orderstatus = 'F'")
def partitioned_write(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One folder a status; the read opens one of them."""
    path = scratch(spark)
    write(table(spark, sf_dir, "orders").select("o_orderkey", "o_custkey", "o_orderstatus"), path, partition_by=["o_orderstatus"])
    return spark.read.parquet(path).where("o_orderstatus = 'F'").select("o_orderkey", "o_custkey", "o_orderstatus")


def _again(spark: SparkSession, sf_dir: str, kind: str) -> DataFrame:
    orders, path = table(spark, sf_dir, "orders"), scratch(spark)
    write(orders, path, kind)
    return read(spark, path, kind, orders.schema)


ORDERS = "SELECT o_orderkey, o_custkey, o_orderstatus, o_totalprice, o_orderdate, o_orderpriority FROM orders"


@query(ORDERS)
def format_csv(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _again(spark, sf_dir, "csv")


@query(ORDERS)
def format_json(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _again(spark, sf_dir, "json")


@query(ORDERS)
def format_orc(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _again(spark, sf_dir, "orc")


@query("SELECT event_id, ts, user_id, event_type, value FROM events")
def file_stream(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All files of a folder as a stream, written in append mode."""
    events = stream(spark, sf_dir, table(spark, sf_dir, "events").schema, "events.parquet")
    return to_parquet(events.select("event_id", F.col("ts").cast("timestamp_ntz").alias("ts"), "user_id", "event_type", "value"), spark)


@query("SELECT o_orderkey, o_custkey, o_totalprice FROM orders WHERE o_totalprice > 400000 AND o_orderstatus IN ('F', 'O')")
def custom_source(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The orders by a source written in Python, which gets the filters and reads the parts of the file that can hold a row; what it reads is settled, as the filters are pushed only while the setting holds."""
    spark.dataSource.register(RowGroups)
    with setting(spark, "spark.sql.python.filterPushdown.enabled", "true"):
        orders = spark.read.format("weft_row_groups").option("path", f"{sf_dir}/orders.parquet").load()
        return settled(orders.where("o_totalprice > 400000 AND o_orderstatus IN ('F', 'O')").select("o_orderkey", "o_custkey", "o_totalprice"))


@query("SELECT event_type, count(*) AS n, round(sum(value), 4) AS total FROM events GROUP BY event_type")
def custom_stream(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The events as a stream of that source, whose offsets are numbers of row groups; totals of what the stream wrote."""
    spark.dataSource.register(RowGroups)
    events = spark.readStream.format("weft_row_groups").option("path", f"{sf_dir}/events.parquet").load()
    return to_parquet(events.select("event_id", "event_type", "value"), spark).groupBy("event_type").agg(F.count("*").alias("n"), F.round(F.sum("value"), 4).alias("total"))
