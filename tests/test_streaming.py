import time

import pytest
from pyspark.sql import functions as F

from weft.sources.tables import stream, table
from weft.streaming import events as on

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def batch(spark):
    return table(spark, SF, "events").withColumn("ts", F.col("ts").cast("timestamp"))


@pytest.fixture
def streamed(spark):
    return stream(spark, SF, table(spark, SF, "events").schema, "events.parquet")


def rows(df):
    return sorted(map(str, df.collect()))


@pytest.mark.parametrize(("name", "f"), [("tumbling", on.tumbling), ("sliding", on.sliding), ("sessions", on.sessions)])
def test_complete_mode_equals_the_batch(spark, batch, streamed, tmp_path, name, f):
    mode = "complete"
    on.to_memory(f(streamed), f"t_{name}", mode, str(tmp_path / "c"))
    assert rows(spark.table(f"t_{name}")) == rows(f(batch))


def test_append_mode_holds_open_windows_back(spark, batch, streamed, tmp_path):
    on.to_memory(on.tumbling(streamed, late="1 hour"), "t_append", "append", str(tmp_path / "c"))
    got, whole = rows(spark.table("t_append")), rows(on.tumbling(batch))
    assert set(got) < set(whole) and len(whole) - len(got) < 30


def test_late_rows_are_dropped(spark, tmp_path):
    schema = "event_id long, ts timestamp, user_id long, event_type string, value double"
    source = str(tmp_path / "in")
    put = lambda data: spark.createDataFrame(data, schema.replace("ts timestamp", "ts string")).withColumn("ts", F.col("ts").cast("timestamp")).coalesce(1).write.mode("append").parquet(source)
    for data in ([(1, "2024-01-01 10:00:00", 1, "view", 1.0)], [(2, "2024-01-01 15:00:00", 1, "view", 1.0)], [(5, "2024-01-01 15:05:00", 1, "view", 1.0)], [(3, "2024-01-01 10:30:00", 1, "view", 1.0), (4, "2024-01-01 15:10:00", 1, "view", 1.0)]):
        put(data)
        time.sleep(1.1)  # files are taken in the order of their times
    arriving = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(source)
    on.to_memory(on.tumbling(arriving, late="10 minutes"), "t_late", "update", str(tmp_path / "c"))
    assert {(str(r["start"])[11:13], r["n"]) for r in spark.table("t_late").collect()} == {("10", 1), ("15", 1), ("15", 2), ("15", 3)}  # rows are late by the watermark of the batch before


def test_distinct_within(spark, batch, tmp_path):
    source = str(tmp_path / "in")
    batch.union(batch).repartition(2).write.parquet(source)
    on.to_memory(on.distinct_within(spark.readStream.schema(batch.schema).parquet(source)), "t_distinct", "append", str(tmp_path / "c"))
    assert spark.table("t_distinct").count() == batch.count()


def test_stream_stream_join(spark, batch, streamed):
    got = on.to_parquet(on.clicks_to_purchases(streamed, 6), spark)
    want = batch.alias("c").join(batch.alias("p"), F.expr("c.user_id = p.user_id AND c.event_type = 'click' AND p.event_type = 'purchase' AND p.ts BETWEEN c.ts AND c.ts + INTERVAL 6 HOURS")).select(F.col("c.event_id").alias("click_id"), F.col("p.event_id").alias("buy_id"))
    assert rows(got) == rows(want) and got.count()


def test_idle_state_is_dropped(spark, tmp_path):
    """A user who comes back after its state's time starts anew."""
    source, schema = str(tmp_path / "in"), "user_id long, ts timestamp, value double"
    for user, ts in ((1, "2024-01-01 10:00:00"), (2, "2024-01-02 10:00:00"), (2, "2024-01-02 10:05:00"), (1, "2024-01-02 10:10:00")):
        spark.createDataFrame([(user, ts, 1.0)], "user_id long, ts string, value double").withColumn("ts", F.col("ts").cast("timestamp")).coalesce(1).write.mode("append").parquet(source)
        time.sleep(1.1)  # files are taken in the order of their times
    arriving = lambda: spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(source)
    counts = lambda df: sorted((r["user_id"], r["n"]) for r in on.updates_to_parquet(df, spark).collect())
    assert counts(on.running_totals(arriving())) == [(1, 1), (1, 2), (2, 1), (2, 2)]
    assert counts(on.running_totals(arriving(), idle=3600)) == [(1, 1), (1, 1), (2, 1), (2, 2)]


def test_custom_state(spark, batch, streamed, tmp_path):
    on.to_memory(on.running_totals(streamed), "t_state", "update", str(tmp_path / "c"))
    want = batch.groupBy("user_id").agg(F.count("*").alias("n"), F.max("value").alias("top"))
    assert rows(spark.table("t_state")) == rows(want)


def parts_of(spark, *parts):
    schema = "event_id long, ts timestamp, user_id long, event_type string, value double"
    return [spark.createDataFrame(p, schema.replace("ts timestamp", "ts string")).withColumn("ts", F.col("ts").cast("timestamp_ntz")).coalesce(1) for p in parts]


def test_journeys_over_parts(spark):
    """State is read in a later part than it was written in; a timer closes a journey; a user who comes back starts anew; a late row counts nowhere."""
    parts = parts_of(
        spark,
        [(1, "2024-01-01 10:00:00", 1, "view", 5.0), (2, "2024-01-01 10:30:00", 1, "click", 1.0), (3, "2024-01-01 10:10:00", 2, "view", 2.0)],
        [(4, "2024-01-01 11:00:00", 1, "view", 9.0), (5, "2024-01-01 11:30:00", 3, "view", 1.0), (6, "2024-01-01 11:05:00", 1, "view", 7.0)],
        [(7, "2024-01-02 10:00:00", 3, "view", 1.0), (8, "2024-01-01 09:00:00", 2, "click", 1.0)],
        [(9, "2024-01-02 10:30:00", 1, "click", 3.0), (10, "2024-01-05 10:00:00", 4, "view", 1.0)],
    )
    got = on.replay(spark, parts, lambda events: on.journeys(events, 2 * 3600, "1 hour"), **on.ROCKSDB).collect()
    plain = sorted((r["user_id"], str(r["start"])[8:16], str(r["finish"])[8:16], r["n"], r["batches"], r["kinds"], r["highest"]) for r in got)
    assert plain == [
        (1, "01 10:00", "01 11:05", 4, 2, "click:1,view:3", [9.0, 7.0, 5.0]), (1, "02 10:30", "02 10:30", 1, 1, "click:1", [3.0]), (2, "01 10:10", "01 10:10", 1, 1, "view:1", [2.0]),
        (3, "01 11:30", "02 10:00", 2, 2, "view:2", [1.0, 1.0]),  # the watermark had not closed it
    ]


def test_state_that_outlives_its_time_is_gone(spark):
    parts = parts_of(spark, *[[(i, "2024-01-01 10:00:00", 1, "view", 1.0)] for i in range(2)])
    kept = on.replay(spark, parts, lambda events: on.forgetting_totals(events, 3600), **on.ROCKSDB_TTL)
    assert sorted(r["n"] for r in kept.collect()) == [1, 2]

    def slowly():
        yield parts[0]
        time.sleep(1.5)
        yield parts[1]

    gone = on.replay(spark, slowly(), lambda events: on.forgetting_totals(events, 1), **on.ROCKSDB_TTL)
    assert sorted(r["n"] for r in gone.collect()) == [1, 1]


def test_partners_in_different_parts(spark):
    """A click waits for its purchase over a part; one whose time has passed finds none; so do late rows."""
    parts = parts_of(
        spark,
        [(1, "2024-01-01 10:00:00", 1, "click", 1.0), (2, "2024-01-01 10:00:00", 2, "purchase", 1.0), (3, "2024-01-01 09:59:00", 2, "click", 1.0)],
        [(4, "2024-01-01 10:20:00", 1, "purchase", 1.0), (5, "2024-01-02 10:00:00", 1, "click", 1.0), (6, "2024-01-02 10:00:00", 2, "purchase", 1.0)],
        [(7, "2024-01-01 10:40:00", 1, "purchase", 1.0), (8, "2024-01-02 10:30:00", 1, "purchase", 1.0)],
    )
    got = on.replay(spark, parts, lambda events: on.clicks_to_purchases(events, 1, "1 hour"))
    assert sorted(map(tuple, got.collect())) == [(1, 4), (3, 2), (5, 8)]


def test_first_ones_are_remembered_over_parts(spark):
    parts = parts_of(
        spark,
        [(1, "2024-01-01 10:00:00", 1, "view", 1.0), (2, "2024-01-01 10:10:00", 1, "view", 2.0)],
        [(1, "2024-01-01 10:00:00", 1, "view", 1.0), (3, "2024-01-02 10:00:00", 1, "view", 3.0)],
        [(1, "2024-01-02 10:00:00", 1, "view", 4.0), (2, "2024-01-01 10:10:00", 1, "view", 2.0)],
    )
    got = on.replay(spark, parts, lambda events: on.distinct_within(events, "1 hour"))
    assert sorted((r["event_id"], r["value"]) for r in got.collect()) == [(1, 1.0), (1, 4.0), (2, 2.0), (3, 3.0)]
