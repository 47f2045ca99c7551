"""The streaming operators as streams over the events file: each is run to its end, and what it wrote is read."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from weft.plans.catalog import query
from weft.sources.tables import stream, table
from weft.streaming import events as on


def _stream(spark: SparkSession, sf_dir: str) -> DataFrame:
    return stream(spark, sf_dir, table(spark, sf_dir, "events").schema, "events.parquet")


@query("""
SELECT * FROM (SELECT time_bucket(INTERVAL 1 HOUR, ts) AS start, event_type, count(*) AS n, round(sum(value), 4) AS total FROM events GROUP BY ALL)
WHERE start + INTERVAL 1 HOUR <= (SELECT max(ts) - INTERVAL 1 HOUR FROM events)""")
def stream_watermark(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Append mode: a window is written once the watermark has passed its end; the last ones stay open."""
    windows = on.tumbling(_stream(spark, sf_dir), late="1 hour")
    return on.to_parquet(windows.withColumn("start", F.col("start").cast("timestamp_ntz")), spark)


@query("SELECT event_id, user_id, value FROM events")
def stream_distinct(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every event arrives twice and stays once."""
    events = _stream(spark, sf_dir)
    return on.to_parquet(on.distinct_within(events.union(events)).select("event_id", "user_id", "value"), spark)


@query("""
SELECT c.event_id AS click_id, p.event_id AS buy_id FROM events c JOIN events p ON c.user_id = p.user_id AND p.ts BETWEEN c.ts AND c.ts + INTERVAL 6 HOUR
WHERE c.event_type = 'click' AND p.event_type = 'purchase'""")
def stream_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return on.to_parquet(on.clicks_to_purchases(_stream(spark, sf_dir), 6), spark)


@query("SELECT user_id, count(*) AS n, max(value) AS top FROM events GROUP BY user_id")
def stream_state(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Update mode: a user has a row in each batch that it occurs in; the last one holds."""
    updates = on.updates_to_parquet(on.running_totals(_stream(spark, sf_dir)), spark)
    last = F.row_number().over(W.partitionBy("user_id").orderBy(F.desc("batch")))
    return updates.withColumn("rank", last).where("rank = 1").select("user_id", "n", "top")


#: Days that a part of the events holds, and every how many events one comes a part late or is sent twice.
PART_DAYS, LATE_EVERY, AGAIN_EVERY = 10, 7, 5
#: How the rows of the table arrive: in parts by their day, some a part later.
ARRIVAL = f"CAST(floor((day(ts) - 1) / {PART_DAYS}) AS INT) + CASE WHEN event_id % {LATE_EVERY} = 3 THEN 1 ELSE 0 END"


def _arriving(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "events").withColumn("part", F.expr(ARRIVAL))


def _parts(rows: DataFrame) -> list[DataFrame]:
    """The parts in their order (a month has few)."""
    last = rows.agg(F.max("part")).first()[0]
    return [rows.where(F.col("part") == k).drop("part") for k in range((-1 if last is None else last) + 1)]


def _marks(late: str) -> str:
    """CTE marks(part, mark): the watermark that a part meets, which is that of all parts before it; marks has one part more, the end."""
    return f"""
tops AS (SELECT part, max(ts) AS top FROM e GROUP BY part),
marks AS (SELECT p.part, date_trunc('milliseconds', max(t.top)) - INTERVAL {late} AS mark FROM (SELECT part FROM tops UNION ALL SELECT max(part) + 1 FROM tops) p LEFT JOIN tops t ON t.part < p.part GROUP BY p.part)"""


@query(f"""
WITH e AS (SELECT *, {ARRIVAL} AS part FROM events), {_marks("2 DAY")},
kept AS (SELECT time_bucket(INTERVAL 1 HOUR, ts) AS start, event_type, value FROM e JOIN marks USING (part) WHERE mark IS NULL OR time_bucket(INTERVAL 1 HOUR, ts) + INTERVAL 1 HOUR > mark)
SELECT start, event_type, count(*) AS n, round(sum(value), 4) AS total FROM kept GROUP BY ALL HAVING start + INTERVAL 1 HOUR <= (SELECT max(mark) FROM marks)""")
def stream_late_windows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rows a part late: those whose window the watermark has passed are dropped, the others still count in it."""
    windows = on.replay(spark, _parts(_arriving(spark, sf_dir)), lambda events: on.tumbling(events, late="2 days"))
    return windows.withColumn("start", F.col("start").cast("timestamp_ntz"))


@query(f"""
WITH f AS (SELECT *, {ARRIVAL} AS part FROM events),
e AS (SELECT event_id, 1 AS attempt, ts, part FROM f UNION ALL SELECT event_id, 2, ts + INTERVAL 3 DAY, part + 1 FROM f WHERE event_id % {AGAIN_EVERY} = 0), {_marks("2 DAY")},
kept AS (SELECT e.*, mark FROM e JOIN marks USING (part) WHERE mark IS NULL OR ts > mark)
SELECT event_id, attempt, ts FROM kept WHERE attempt = 1 OR NOT EXISTS (SELECT 1 FROM kept k WHERE k.event_id = kept.event_id AND k.attempt = 1 AND k.ts + INTERVAL 2 DAY > kept.mark)""")
def stream_late_distinct(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events sent again a part and three days later: as long as the first one is remembered the second is dropped, after that it counts as new."""
    first = _arriving(spark, sf_dir).select("event_id", F.lit(1).alias("attempt"), "ts", "part")
    again = first.where(F.col("event_id") % AGAIN_EVERY == 0).select("event_id", F.lit(2).alias("attempt"), (F.col("ts") + F.expr("INTERVAL '3' DAY")).alias("ts"), F.col("part") + 1)
    rows = on.replay(spark, _parts(first.union(again)), lambda events: on.distinct_within(events, "2 days"))
    return rows.withColumn("ts", F.col("ts").cast("timestamp_ntz"))


@query(f"""
WITH e AS (SELECT *, {ARRIVAL} AS part FROM events WHERE event_type IN ('click', 'purchase')),
sides AS (SELECT DISTINCT p.part, max(e.ts) FILTER (e.event_type = 'click') OVER w AS click_top, max(e.ts) FILTER (e.event_type = 'purchase') OVER w AS buy_top FROM e p JOIN e ON e.part < p.part WINDOW w AS (PARTITION BY p.part)),
kept AS (SELECT e.* FROM e LEFT JOIN sides USING (part) WHERE click_top IS NULL OR buy_top IS NULL OR ts > date_trunc('milliseconds', least(click_top, buy_top)) - INTERVAL 1 DAY)
SELECT c.event_id AS click_id, p.event_id AS buy_id FROM kept c JOIN kept p ON c.user_id = p.user_id AND p.ts BETWEEN c.ts AND c.ts + INTERVAL 6 HOUR WHERE c.event_type = 'click' AND p.event_type = 'purchase'""")
def stream_late_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A click and its purchase may come in different parts: each waits in the state until the watermark says that no partner can come. The watermark is the lesser of the two sides'."""
    return on.replay(spark, _parts(_arriving(spark, sf_dir).where("event_type IN ('click', 'purchase')")), lambda events: on.clicks_to_purchases(events, 6, "1 day"))


IDLE_HOURS = 6


@query(f"""
WITH e AS (SELECT *, {ARRIVAL} AS part FROM events), {_marks("6 HOUR")},
kept AS (SELECT e.*, mark FROM e JOIN marks USING (part) WHERE mark IS NULL OR ts > mark),
steps AS (SELECT user_id, part, any_value(mark) AS mark, max(ts) AS top FROM kept GROUP BY user_id, part),
breaks AS (SELECT *, max(top) OVER (PARTITION BY user_id ORDER BY part ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS before FROM steps),
runs AS (SELECT user_id, part, sum(CASE WHEN date_trunc('milliseconds', before) + INTERVAL {IDLE_HOURS} HOUR > mark THEN 0 ELSE 1 END) OVER (PARTITION BY user_id ORDER BY part) AS run FROM breaks),
rows_ AS (SELECT user_id, run, part, ts, event_type, value FROM kept JOIN runs USING (user_id, part)),
kinds AS (SELECT user_id, run, string_agg(event_type || ':' || n, ',' ORDER BY event_type) AS kinds FROM (SELECT user_id, run, event_type, count(*) AS n FROM rows_ GROUP BY ALL) GROUP BY user_id, run)
SELECT user_id, min(ts) AS start, max(ts) AS finish, count(*) AS n, count(DISTINCT part) AS batches, any_value(kinds) AS kinds, list_sort(list(value), 'DESC')[3] AS third
FROM rows_ JOIN kinds USING (user_id, run) GROUP BY user_id, run HAVING date_trunc('milliseconds', max(ts)) + INTERVAL {IDLE_HOURS} HOUR <= (SELECT max(mark) FROM marks)""")
def stream_journeys(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Custom state in several variables with timers: a journey goes on over parts and is written when its timer passes."""
    closed = on.replay(spark, _parts(_arriving(spark, sf_dir)), lambda events: on.journeys(events, IDLE_HOURS * 3600, "6 hours"), **on.ROCKSDB)
    return closed.select("user_id", *[F.col(c).cast("timestamp_ntz").alias(c) for c in ("start", "finish")], "n", "batches", "kinds", F.get("highest", F.lit(2)).alias("third"))
