"""Joins. Catalyst picks the strategy by sizes; a hint stands only where the query is about one."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from weft.plans.catalog import query
from weft.sources.tables import settled, table


def as_of(left: DataFrame, right: DataFrame, by: list[str], at: str, values: list[str], seconds: int = 7 * 86400) -> DataFrame:
    """Each left row with `values` of the last right row of the same key at or before it, nulls where there is none.

    No join: both sides are one stream, read once and settled, and a window
    carries the last right row forward. It is cut into time bins of `seconds`,
    so that one key's history spreads over tasks; a bin starts with the last
    right row of the bins before it, found among one row a key and bin. Of right
    rows with one time, the greatest values hold. A null key is a key like
    others; a null time matches nothing.
    """
    row = F.struct(*values)
    whole = F.struct(*left.columns)
    bin_of = F.floor(F.unix_micros(F.col(at).cast("timestamp")) / (seconds * 1_000_000)).alias("_bin")
    kind = {name: side.select(c.alias("x")).schema["x"].dataType for name, side, c in (("left", left, whole), ("right", right, row))}
    nothing = {name: F.lit(None).cast(t).alias(f"_{name}") for name, t in kind.items()}
    one = left.select(F.lit(2).alias("_side"), *by, at, bin_of, whole.alias("_left"), nothing["right"])
    two = right.where(F.col(at).isNotNull()).select(F.lit(1).alias("_side"), *by, at, bin_of, nothing["left"], row.alias("_right"))
    both = settled(one.unionByName(two))
    bins = both.groupBy(*by, "_bin").agg(F.max(F.when(F.col("_side") == 1, F.struct(at, "_right"))).alias("_end"))
    before = W.partitionBy(*by).orderBy("_bin").rangeBetween(W.unboundedPreceding, -1)
    carried = bins.withColumn("_before", F.last("_end", ignorenulls=True).over(before)).where("_before IS NOT NULL")
    zero = carried.select(F.lit(0).alias("_side"), *by, F.col(f"_before.{at}").alias(at), "_bin", nothing["left"], F.col("_before._right").alias("_right"))
    order = W.partitionBy(*by, "_bin").orderBy(at, "_side", "_right").rowsBetween(W.unboundedPreceding, 0)
    stream = both.unionByName(zero).withColumn("_last", F.last("_right", ignorenulls=True).over(order))
    return stream.where("_side = 2").select("_left.*", *[F.col("_last")[v].alias(v) for v in values])


def not_in(left: DataFrame, column: str, values: DataFrame) -> DataFrame:
    """SQL's NOT IN with the one column of `values`, whose size may be any: one pass tells whether it holds a null (then no row is left) or nothing (then all are); else an anti join, which shuffles unless a side is small. A null on the left is left only if there are no values."""
    (name,) = values.columns
    seen = values.agg(F.count("*").alias("rows"), F.count(name).alias("known")).first()
    if not seen["rows"]:
        return left
    if seen["known"] < seen["rows"]:
        return left.limit(0)
    return left.where(F.col(column).isNotNull()).join(values.select(F.col(name).alias("_value")), F.col(column) == F.col("_value"), "left_anti")


#: Quantiles of the starts that cut the axis into cells, a power of two; equal parts of a cell, as a power of two. Neighbouring leaves are merged to COARSEST at least, so that the work spreads.
LEAVES, FAN, COARSEST = 1 << 10, 5, 1 << 6


def overlaps(left: DataFrame, right: DataFrame, start: str, end: str) -> DataFrame:
    """Pairs of a left and a right row whose intervals [start, end] share a point, each once, as (left.*, right.*): columns of the two sides must differ but for start and end, which are dropped.

    The axis is cut into leaves by quantiles of the starts. A row goes to the leaf
    that it starts in and, as a guest without its start, to the further leaves that
    it reaches into. The pair is found where the later of the two starts: there one
    of them is at home and the other at home or a guest; two guests are no pair. So
    an equal key joins them, each side is shuffled once, and nothing is met twice.
    Narrow leaves have many guests, wide ones many rows that meet in vain: the
    leaves are the narrowest with at most one guest for two rows, parts of a cell or
    several cells. Where even the coarsest have more, guests are kept apart by the
    key, so that those of the two sides don't meet in vain in leaf after leaf.
    Intervals with a null or with end before start meet nothing. start and end are
    numbers, dates or timestamps.
    """
    number = {"timestamp": lambda c: F.unix_micros(c.cast("timestamp")), "date": F.unix_date}.get(dict(left.dtypes)[start].partition("_")[0], lambda c: c)
    sides = []
    for side in (left, right):
        rest = [c for c in side.columns if c not in (start, end)]
        sides.append(side.where(F.col(start) <= F.col(end)).select(number(F.col(start)).alias("_from"), number(F.col(end)).alias("_to"), *rest))
    both = sides[0].select("_from", "_to").unionByName(sides[1].select("_from", "_to"))
    listed = lambda values, kind: F.split(F.lit(",".join(map(str, values))), ",").cast(f"array<{kind}>")  # noqa: E731  # one literal, where F.array has a node for each value
    least, cuts, most = both.agg(F.min("_from"), F.percentile_approx("_from", listed([i / LEAVES for i in range(1, LEAVES)], "double"), 10 * LEAVES), F.max("_from")).first()
    cuts = sorted(set(cuts or []))
    edges = listed([0, 0] if least is None else [least, *cuts, most], both.schema["_from"].dataType.simpleString())
    halves = F.array(*[F.lit(1 << k) for k in reversed(range(LEAVES.bit_length()))])

    def leaf(c: str) -> Column:
        """The finest leaf of the value, never falling as it rises: the number of cuts below it, found by halving, and its place between the two beside it."""
        cell = F.aggregate(halves, F.lit(0), lambda n, h: n + F.when((n + h <= len(cuts)) & (F.get(edges, n + h) < F.col(c)), h).otherwise(0))

        def part(n: Column) -> Column:
            low, high = F.get(edges, n).cast("double"), F.get(edges, n + 1).cast("double")
            place = F.when(high > low, (F.col(c).cast("double") - low) / (high - low)).otherwise(0.0)
            return F.shiftleft(n, FAN) + F.floor(F.least(place, F.lit(1.0)) * ((1 << FAN) - 0.5)).cast("int")

        return F.transform(F.array(cell), part)[0]

    levels = range(1 + max(FAN, (((len(cuts) + 1) << FAN) // COARSEST).bit_length() - 1))
    guests = both.select(leaf("_from").alias("a"), leaf("_to").alias("b")).agg(F.count("*"), *[F.sum((F.shiftright("b", k) - F.shiftright("a", k)).cast("long")) for k in levels]).first()
    level = next((k for k in levels if 2 * (guests[k + 1] or 0) <= guests[0]), levels[-1])
    apart = 2 * (guests[level + 1] or 0) > guests[0]
    dealt = []
    for k, side in enumerate(sides):
        rest = [c for c in side.columns if c not in ("_from", "_to")]
        placed = side.select("_from", "_to", F.shiftright(leaf("_from"), level).alias("_home"), F.shiftright(leaf("_to"), level).alias("_last"), *rest)
        keys = F.transform(F.sequence("_home", "_last"), lambda x: 2 * x)
        if apart and k:
            keys = F.transform(keys, lambda x: F.when(x > 2 * F.col("_home"), x + 1).otherwise(x))
        elif apart:
            keys = F.concat(keys, F.array(2 * F.col("_home") + 1))  # where the right side's guests are
        spread = placed.select("_from", "_to", "_home", F.explode(keys).alias("_key"), *rest)
        dealt.append(spread.select("_key", F.when(F.shiftright("_key", 1) == F.col("_home"), F.col("_from")).alias(f"_from{k}"), F.col("_to").alias(f"_to{k}"), *rest))
    later = F.greatest("_from0", "_from1")  # passes over a guest's null; null for two guests
    columns = [c for side in sides for c in side.columns if c not in ("_from", "_to")]
    return dealt[0].join(dealt[1], "_key").where(later <= F.least("_to0", "_to1")).select(*columns)


def within(left: DataFrame, right: DataFrame, by: list[str], left_at: str, right_at: str, seconds: int) -> DataFrame:
    """Pairs of one key whose right time is within `seconds` after the left one: both sides meet in time bins of that width, so a key's whole history is never compared."""
    bin_of = lambda c: F.floor(F.unix_micros(F.col(c).cast("timestamp")) / (seconds * 1_000_000))
    one = left.withColumn("_bin", F.explode(F.array(bin_of(left_at), bin_of(left_at) + 1)))
    two = right.withColumn("_bin", bin_of(right_at))
    gap: Column = F.unix_micros(F.col(right_at).cast("timestamp")) - F.unix_micros(F.col(left_at).cast("timestamp"))
    return one.join(two, [*by, "_bin"]).where((gap >= 0) & (gap <= seconds * 1_000_000)).drop("_bin")


@query("SELECT c_custkey, c_name, n_name, r_name FROM customer JOIN nation ON c_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey")
def join_broadcast(spark: SparkSession, sf_dir: str) -> DataFrame:
    """nation and region are fixed tables of 25 and 5 rows."""
    nation = table(spark, sf_dir, "nation").join(F.broadcast(table(spark, sf_dir, "region")), F.col("n_regionkey") == F.col("r_regionkey"))
    return table(spark, sf_dir, "customer").join(F.broadcast(nation), F.col("c_nationkey") == F.col("n_nationkey")).select("c_custkey", "c_name", "n_name", "r_name")


ORDER_LINES = "SELECT o_orderkey, o_orderstatus, l_linenumber, l_partkey FROM orders JOIN lineitem ON o_orderkey = l_orderkey"


def _order_lines(spark: SparkSession, sf_dir: str, hint: str) -> DataFrame:
    orders = table(spark, sf_dir, "orders")
    return orders.hint(hint).join(table(spark, sf_dir, "lineitem"), F.col("o_orderkey") == F.col("l_orderkey")).select("o_orderkey", "o_orderstatus", "l_linenumber", "l_partkey")


@query(ORDER_LINES)
def join_sort_merge(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _order_lines(spark, sf_dir, "merge")


@query(ORDER_LINES)
def join_shuffled_hash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _order_lines(spark, sf_dir, "shuffle_hash")


def _outer(spark: SparkSession, sf_dir: str, kind: str) -> DataFrame:
    """Customers without events and events without a customer are in both tables."""
    users = table(spark, sf_dir, "events").select("event_id", "user_id")
    return table(spark, sf_dir, "customer").select("c_custkey", "c_name").join(users, F.col("c_custkey") == F.col("user_id"), kind)


def _outer_sql(kind: str) -> str:
    return f"SELECT c_custkey, c_name, event_id, user_id FROM customer {kind} JOIN events ON c_custkey = user_id"


@query(_outer_sql("LEFT"))
def join_left(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _outer(spark, sf_dir, "left")


@query(_outer_sql("RIGHT"))
def join_right(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _outer(spark, sf_dir, "right")


@query(_outer_sql("FULL"))
def join_full(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _outer(spark, sf_dir, "full")


@query("SELECT o_orderkey FROM orders SEMI JOIN lineitem ON o_orderkey = l_orderkey")
def join_semi(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "orders").join(table(spark, sf_dir, "lineitem"), F.col("o_orderkey") == F.col("l_orderkey"), "left_semi").select("o_orderkey")


@query("SELECT o_orderkey FROM orders ANTI JOIN lineitem ON o_orderkey = l_orderkey")
def join_anti(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "orders").join(table(spark, sf_dir, "lineitem"), F.col("o_orderkey") == F.col("l_orderkey"), "left_anti").select("o_orderkey")


NOT_IN = "SELECT o_orderkey FROM orders WHERE o_orderkey NOT IN (SELECT l_orderkey FROM lineitem WHERE l_quantity > 30)"


@query(NOT_IN)
def join_not_in(spark: SparkSession, sf_dir: str) -> DataFrame:
    return not_in(table(spark, sf_dir, "orders").select("o_orderkey"), "o_orderkey", table(spark, sf_dir, "lineitem").where("l_quantity > 30").select("l_orderkey"))


#: Width of the band and of its bins.
BAND = 25.0


@query(f"SELECT a.s_suppkey AS poorer, b.s_suppkey AS richer FROM supplier a JOIN supplier b ON a.s_acctbal < b.s_acctbal AND b.s_acctbal - a.s_acctbal <= {BAND}")
def join_theta(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A band join without an equal key: bins as wide as the band make one, and a row looks into its own bin and the next. No side is compared with the other as a whole."""
    rows = table(spark, sf_dir, "supplier").select("s_suppkey", "s_acctbal", F.floor(F.col("s_acctbal") / BAND).alias("bin"))
    poorer = rows.select(F.col("s_suppkey").alias("poorer"), F.col("s_acctbal").alias("low"), F.explode(F.array("bin", F.col("bin") + 1)).alias("bin"))
    richer = rows.select(F.col("s_suppkey").alias("richer"), F.col("s_acctbal").alias("high"), "bin")
    return poorer.join(richer, "bin").where((F.col("low") < F.col("high")) & (F.col("high") - F.col("low") <= BAND)).select("poorer", "richer")


SPAN = "ts + to_minutes(CAST(ceil(value * CASE WHEN user_id % 40 = 0 THEN 20 ELSE 1 END) AS BIGINT))"


@query(f"""
WITH e AS (SELECT event_id, event_type, ts AS a, {SPAN} AS b FROM events)
SELECT p.event_id AS purchase_id, x.event_id AS error_id FROM e p JOIN e x ON p.a <= x.b AND x.a <= p.b WHERE p.event_type = 'purchase' AND x.event_type = 'error'""")
def join_overlap(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Two inequalities and no equal key: purchases and errors whose times overlap, some of them twenty times as long as others."""
    minutes = F.ceil(F.col("value") * F.when(F.col("user_id") % 40 == 0, 20).otherwise(1))
    events = table(spark, sf_dir, "events").select("event_id", "event_type", F.col("ts").alias("a"), (F.col("ts") + F.make_dt_interval(mins=minutes.cast("int"))).alias("b"))
    side = lambda kind, name: events.where(F.col("event_type") == kind).select(F.col("event_id").alias(name), "a", "b")
    return overlaps(side("purchase", "purchase_id"), side("error", "error_id"), "a", "b")


@query("SELECT r_name, n_name FROM region, nation")
def join_cross(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Two tables of fixed size."""
    return table(spark, sf_dir, "region").crossJoin(table(spark, sf_dir, "nation")).select("r_name", "n_name")


@query("""
SELECT c.event_id AS click_id, p.event_id AS purchase_id FROM events c JOIN events p
ON c.user_id = p.user_id AND p.ts >= c.ts AND p.ts <= c.ts + INTERVAL 6 HOUR WHERE c.event_type = 'click' AND p.event_type = 'purchase'""")
def join_interval(spark: SparkSession, sf_dir: str) -> DataFrame:
    events = table(spark, sf_dir, "events")
    clicks = events.where("event_type = 'click'").select("user_id", F.col("event_id").alias("click_id"), F.col("ts").alias("click_at"))
    buys = events.where("event_type = 'purchase'").select("user_id", F.col("event_id").alias("purchase_id"), F.col("ts").alias("bought_at"))
    return within(clicks, buys, ["user_id"], "click_at", "bought_at", 6 * 3600).select("click_id", "purchase_id")


@query("""
SELECT p.event_id, p.user_id, v.event_id AS view_id FROM (SELECT * FROM events WHERE event_type = 'purchase') p
ASOF LEFT JOIN (SELECT * FROM events WHERE event_type = 'view') v ON p.user_id = v.user_id AND p.ts >= v.ts""")
def join_as_of(spark: SparkSession, sf_dir: str) -> DataFrame:
    events = table(spark, sf_dir, "events")
    buys = events.where("event_type = 'purchase'").select("event_id", "user_id", "ts")
    seen = events.where("event_type = 'view'").select("user_id", "ts", F.col("event_id").alias("view_id"))
    return as_of(buys, seen, ["user_id"], "ts", ["view_id"]).select("event_id", "user_id", "view_id")
