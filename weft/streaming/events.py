"""Structured Streaming over an event stream: the same transformations run on a batch."""

from __future__ import annotations

from collections.abc import Callable, Iterable, Iterator
from contextlib import ExitStack

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle, StreamingQuery
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from weft.session import setting
from weft.sources.tables import plain_times, scratch


def tumbling(events: DataFrame, width: str = "1 hour", late: str | None = None) -> DataFrame:
    """Counts and sums by event type and window. late: how long a watermark waits; older rows are dropped."""
    events = events.withWatermark("ts", late) if late else events
    return events.groupBy(F.window("ts", width).alias("w"), "event_type").agg(F.count("*").alias("n"), F.round(F.sum("value"), 4).alias("total")).select(F.col("w.start").alias("start"), "event_type", "n", "total")


def sliding(events: DataFrame, width: str = "1 hour", slide: str = "30 minutes", late: str | None = None) -> DataFrame:
    events = events.withWatermark("ts", late) if late else events
    return events.groupBy(F.window("ts", width, slide).alias("w")).agg(F.count("*").alias("n")).select(F.col("w.start").alias("start"), "n")


def sessions(events: DataFrame, gap: str = "30 minutes", late: str | None = None) -> DataFrame:
    events = events.withWatermark("ts", late) if late else events
    return events.groupBy(F.session_window("ts", gap).alias("w"), "user_id").agg(F.count("*").alias("n")).select("user_id", F.col("w.start").alias("start"), F.col("w.end").alias("end"), "n")


def distinct_within(events: DataFrame, late: str = "1 hour") -> DataFrame:
    """Rows with new event ids; a watermark bounds the ids that are remembered."""
    return events.withWatermark("ts", late).dropDuplicatesWithinWatermark(["event_id"])


def clicks_to_purchases(events: DataFrame, hours: int = 1, late: str = "2 hours") -> DataFrame:
    """Stream-stream join: purchases of a user within some hours after a click; both sides' state is bounded by the watermark."""
    side = lambda kind, name: events.where(F.col("event_type") == kind).select(F.col("event_id").alias(f"{name}_id"), F.col("user_id").alias(f"{name}_user"), F.col("ts").alias(f"{name}_at")).withWatermark(f"{name}_at", late)
    near = (F.col("click_user") == F.col("buy_user")) & (F.col("buy_at") >= F.col("click_at")) & (F.col("buy_at") <= F.col("click_at") + F.make_dt_interval(hours=F.lit(hours)))
    return side("click", "click").join(side("purchase", "buy"), near).select("click_id", "buy_id")


def running_totals(events: DataFrame, idle: int | None = None, late: str = "1 hour") -> DataFrame:
    """Custom state: each user's number of events and highest value so far, updated with every batch.

    idle: seconds of event time after a user's last event at which the state is
    dropped, once the watermark has passed them; without it, state is kept for
    good, so it grows with the number of users.
    """

    def update(key: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        if state.hasTimedOut:
            state.remove()
            return
        n, top, last = state.get if state.exists else (0, float("-inf"), 0)
        for frame in frames:
            n, top, last = n + len(frame), max(top, float(frame["value"].max())), max(last, int(frame["ms"].max()))
        state.update((n, top, last))
        if idle is not None:
            state.setTimeoutTimestamp(max(last, state.getCurrentWatermarkMs()) + idle * 1000)
        yield pd.DataFrame({"user_id": [key[0]], "n": [n], "top": [top]})

    timeout = GroupStateTimeout.NoTimeout if idle is None else GroupStateTimeout.EventTimeTimeout
    timed = events if idle is None else events.withWatermark("ts", late)
    grouped = timed.select("user_id", "value", "ts", F.unix_millis("ts").alias("ms")).groupBy("user_id")
    return grouped.applyInPandasWithState(update, "user_id long, n long, top double", "n long, top double, last long", "update", timeout)


# The processors' classes are made within functions, so that they travel whole: the stream's own worker need not find this package.


def journey_processor(idle: int, keep: int = 3) -> StatefulProcessor:

    class Journeys(StatefulProcessor):
        """A user's events until the watermark is `idle` seconds past the last one; one that it hasn't closed yet goes on, however long the gap.

        Three state variables hold what a journey needs: its span, a count of each
        kind, and the highest values. A timer at the last event plus `idle` closes
        it: its row is written and all state goes. With ttl, the counts of kinds
        also go that many seconds of processing time after they were last written,
        whatever the watermark does.
        """

        def __init__(self, idle: int, keep: int = 3, ttl: int | None = None) -> None:
            self.idle, self.keep, self.ttl = idle * 1000, keep, ttl and ttl * 1000

        def init(self, handle: StatefulProcessorHandle) -> None:
            self.handle = handle
            self.span = handle.getValueState("span", "n long, batches long, start long, finish long")
            self.kinds = handle.getMapState("kinds", "kind string", "n long")
            self.highest = handle.getListState("highest", "value double")

        def handleInputRows(self, key: tuple, rows: Iterator[pd.DataFrame], timerValues: object) -> Iterator[pd.DataFrame]:
            n, batches, start, finish = self.span.get() if self.span.exists() else (0, 0, None, None)
            if finish is not None:
                self.handle.deleteTimer(finish // 1000 + self.idle)
            kinds, highest = pd.Series(dtype="int64"), pd.Series([v for (v,) in self.highest.get()], dtype="float64")
            for frame in rows:
                low, high = int(frame["at"].min()), int(frame["at"].max())
                n, start, finish = n + len(frame), low if start is None else min(start, low), high if finish is None else max(finish, high)
                kinds = kinds.add(frame["event_type"].value_counts(), fill_value=0)
                highest = pd.concat([highest, frame["value"]]).nlargest(self.keep)
            for kind, more in kinds.items():
                before = self.kinds.getValue((kind,))[0] if self.kinds.containsKey((kind,)) else 0
                self.kinds.updateValue((kind,), (before + int(more),))
            self.highest.put([(float(v),) for v in highest])
            self.span.update((n, batches + 1, start, finish))
            self.handle.registerTimer(finish // 1000 + self.idle)
            yield from ()

        def handleExpiredTimer(self, key: tuple, timerValues: object, expiredTimerInfo: object) -> Iterator[pd.DataFrame]:
            n, batches, start, finish = self.span.get()
            kinds = ",".join(f"{kind}:{count}" for (kind,), (count,) in sorted(self.kinds.iterator()))
            highest = sorted((v for (v,) in self.highest.get()), reverse=True)
            self.span.clear()
            self.kinds.clear()
            self.highest.clear()
            yield pd.DataFrame({"user_id": [key[0]], "start": [start], "finish": [finish], "n": [n], "batches": [batches], "kinds": [kinds], "highest": [highest]})

        def close(self) -> None:
            pass

    return Journeys(idle, keep)


#: Settings of streams with states in several variables; with times to live by the clock, empty batches would never end.
ROCKSDB = {"spark.sql.streaming.stateStore.providerClass": "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"}
ROCKSDB_TTL = ROCKSDB | {"spark.sql.streaming.noDataMicroBatches.enabled": "false"}


def journeys(events: DataFrame, idle: int, late: str = "1 day") -> DataFrame:
    """Closed journeys (user_id, start, finish, n, batches, kinds, highest). The stream must run with the RocksDB state store; a user without events for `idle` seconds leaves no state."""
    rows = events.withWatermark("ts", late).select("user_id", "event_type", "value", "ts", F.unix_micros("ts").alias("at"))
    schema = "user_id long, start long, finish long, n long, batches long, kinds string, highest array<double>"
    found = rows.groupBy("user_id").transformWithStateInPandas(journey_processor(idle), schema, "append", "eventtime")
    return found.withColumns({name: F.timestamp_micros(name) for name in ("start", "finish")})


def forgetful_processor(seconds: int) -> StatefulProcessor:
    class Totals(StatefulProcessor):
        """A user's number of events, as far as it was written within the last `seconds` of processing time: the store drops older state by itself."""

        def __init__(self, seconds: int) -> None:
            self.ttl = seconds * 1000

        def init(self, handle: StatefulProcessorHandle) -> None:
            self.count = handle.getValueState("count", "n long", self.ttl)

        def handleInputRows(self, key: tuple, rows: Iterator[pd.DataFrame], timerValues: object) -> Iterator[pd.DataFrame]:
            n = (self.count.get()[0] if self.count.exists() else 0) + sum(len(frame) for frame in rows)
            self.count.update((n,))
            yield pd.DataFrame({"user_id": [key[0]], "n": [n]})

        def close(self) -> None:
            pass

    return Totals(seconds)


def forgetting_totals(events: DataFrame, seconds: int) -> DataFrame:
    """(user_id, n) with every batch that a user occurs in; state lives for a time of the clock, not of the events. The stream must run with the RocksDB state store."""
    return events.select("user_id").groupBy("user_id").transformWithStateInPandas(forgetful_processor(seconds), "user_id long, n long", "append", "processingtime")


def replay(spark: SparkSession, parts: Iterable[DataFrame], operator: Callable[[DataFrame], DataFrame], **settings: str) -> DataFrame:
    """What a stream writes whose rows arrive in parts: each part's files are added to the source's folder, and the stream goes on from its checkpoint until it has read them all. So what a part leaves in the state is read again by the next one, from the shared folder. settings: of the session, by name, while it runs."""
    place = scratch(spark)
    for part in parts:
        part.write.mode("append").parquet(f"{place}/in")
        source = plain_times(spark.readStream.schema(part.schema).parquet(f"{place}/in"))
        with ExitStack() as held:
            for name, value in settings.items():
                held.enter_context(setting(spark, name, value))
            out = operator(source)
            out.writeStream.format("parquet").option("path", f"{place}/out").option("checkpointLocation", f"{place}/state").outputMode("append").trigger(availableNow=True).start().awaitTermination()
    return spark.read.schema(out.schema).parquet(f"{place}/out")


def to_memory(df: DataFrame, name: str, mode: str, checkpoint: str) -> StreamingQuery:
    """All that is there now, into a table in memory (for tests and small results)."""
    query = df.writeStream.format("memory").queryName(name).outputMode(mode).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    query.awaitTermination()
    return query


def to_parquet(df: DataFrame, spark: SparkSession) -> DataFrame:
    """Append-only results of all that is there now, as files in the shared folder; the checkpoint makes each batch count once."""
    place = scratch(spark)
    df.writeStream.format("parquet").option("path", f"{place}/out").option("checkpointLocation", f"{place}/state").outputMode("append").trigger(availableNow=True).start().awaitTermination()
    return spark.read.schema(df.schema).parquet(f"{place}/out")


def updates_to_parquet(df: DataFrame, spark: SparkSession) -> DataFrame:
    """The changed rows of each batch as files, with the batch's number; a batch that is run again replaces its own folder."""
    place = scratch(spark)
    put = lambda rows, batch: rows.write.mode("overwrite").parquet(f"{place}/out/batch={batch}")
    df.writeStream.foreachBatch(put).option("checkpointLocation", f"{place}/state").outputMode("update").trigger(availableNow=True).start().awaitTermination()
    return spark.read.parquet(f"{place}/out")
