"""Operators that spread hot keys, read the tables through sources of their own, or repeat joins."""

import math
import random

import pyarrow as pa
import pyarrow.parquet as pq
import pytest
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from weft.operators import join, recursion
from weft.operators.aggregate import quantiles_of
from weft.operators.join import not_in, overlaps
from weft.operators.ranges import running
from weft.operators.recursion import reached
from weft.plans.registry import QUERIES
from weft.sources.row_groups import RowGroups
from weft.session import setting
from weft.streaming.events import to_parquet

SF = "/root/testdata/sf0.001"


def plan_of(df):
    return df._jdf.queryExecution().executedPlan().toString()


def plain(df):
    return sorted(str(tuple(r)) for r in df.collect())


@pytest.fixture(scope="module")
def hot(spark):
    """One key holds most rows, and one order many of them; null keys, orders and values."""
    rng = random.Random(3)
    rows = [(rng.choice(["hot"] * 8 + ["a", "b", None]), rng.choice([5, 5, 5, rng.randrange(40), None]), i, rng.choice([None, i, 1])) for i in range(3000)]
    return spark.createDataFrame(rows, "k string, t int, i long, v long").repartition(7)


@pytest.mark.parametrize("by", [[], ["k"]])
def test_running_against_the_window(spark, hot, by):
    with setting(spark, "spark.sql.shuffle.partitions", "13"), setting(spark, "spark.sql.adaptive.coalescePartitions.enabled", "false"):
        got = running(hot, by, ["t"], rk=("rank",), dr=("dense_rank",), s=("sum", "v"), n=("count", "v"))
        whole = running(hot, by, ["-t", "i"], rn=("row_number",), s=("sum", "v"))
        up = running(hot, by, ["i"], last=("last", "v"))
        w, d, u = (W.partitionBy(*by).orderBy(*o) for o in (["t"], [F.desc("t"), "i"], ["i"]))
        assert plain(got) == plain(hot.select("*", F.rank().over(w).cast("long").alias("rk"), F.dense_rank().over(w).cast("long").alias("dr"), F.sum("v").over(w).alias("s"), F.count("v").over(w).alias("n")))
        assert plain(whole) == plain(hot.select("*", F.row_number().over(d).cast("long").alias("rn"), F.sum("v").over(d).alias("s")))
        assert plain(up) == plain(hot.select("*", F.last("v", True).over(u).alias("last")))
    assert running(hot.limit(0), by, ["t"], rk=("rank",)).count() == 0


def test_a_sequence_of_all_rows_is_not_one_task(spark, hot):
    """No exchange takes all rows to one partition, and the hot key's rows lie in several ranges."""
    with setting(spark, "spark.sql.shuffle.partitions", "13"), setting(spark, "spark.sql.adaptive.coalescePartitions.enabled", "false"):
        ranked = running(hot, [], ["-i"], rn=("row_number",))
        assert "SinglePartition" not in plan_of(ranked)
        sizes = [r["count"] for r in running(hot, ["k"], ["i"], rn=("row_number",)).groupBy("k", F.spark_partition_id()).count().where("k = 'hot'").collect()]
    assert len(sizes) > 3 and max(sizes) < 0.6 * sum(sizes)


def test_quantiles_of_several_columns(spark, hot):
    asked = {"t": ({"tm": 0.5}, {"td": 0.9}), "u": ({"um": 0.25, "ux": 1.0}, {})}
    df = hot.withColumn("u", (F.col("v") % 50).cast("int"))
    want = df.groupBy("k").agg(F.median("t").alias("tm"), F.expr("percentile_disc(0.9) WITHIN GROUP (ORDER BY t)").cast("int").alias("td"), F.percentile("u", 0.25).alias("um"), F.max("u").cast("double").alias("ux"))
    assert plain(quantiles_of(df, ["k"], asked)) == plain(want)
    found = QUERIES["percentiles"](spark, SF)
    assert plan_of(found).count("lineitem") == 0  # the counts are settled: one scan made them


@pytest.mark.parametrize("values", [[1, 3, 3], [1, None, 3], [None], []])
def test_not_in_with_nulls(spark, values):
    left = spark.createDataFrame([(1, "a"), (2, "b"), (None, "c"), (3, "d"), (2, "b")], "x int, name string")
    right = spark.createDataFrame([(v,) for v in values], "y int")
    want = spark.sql("SELECT * FROM {left} WHERE x NOT IN (SELECT y FROM {right})", left=left, right=right)
    with setting(spark, "spark.sql.autoBroadcastJoinThreshold", "-1"):
        got = not_in(left, "x", right)
        assert "Broadcast" not in plan_of(got)
        assert plain(got) == plain(want)


@pytest.mark.parametrize("leaves", [2, 16, 1024])
def test_overlaps_against_loops(spark, monkeypatch, leaves):
    """Long and short intervals, one instant that holds a third of the starts, points, equal ends, repeated rows, nulls and intervals that end before they start."""
    monkeypatch.setattr(join, "LEAVES", leaves)
    rng = random.Random(leaves)

    def some(n):
        for i in range(n):
            a = rng.choice([500, rng.randrange(1000), rng.randrange(1000)])
            yield (i, None if i % 31 == 7 else a, None if i % 37 == 5 else a + rng.choice([0, 1, 5, rng.randrange(-5, 900)]))

    left, right = [*some(120), (0, 10, 20), (0, 10, 20)], [*some(90), (1, 20, 20), (2, 0, 10)]
    one = spark.createDataFrame(left, "i int, a long, b long")
    two = spark.createDataFrame(right, "j int, a long, b long")
    good = lambda rows: [(i, a, b) for i, a, b in rows if a is not None and b is not None and a <= b]
    want = sorted((i, j) for i, a, b in good(left) for j, c, d in good(right) if a <= d and c <= b)
    got = overlaps(one, two, "a", "b")
    assert got.columns == ["i", "j"] and sorted(map(tuple, got.collect())) == want
    plan = plan_of(got)
    assert "NestedLoop" not in plan and "Cartesian" not in plan
    assert overlaps(one.limit(0), two, "a", "b").count() == 0 == overlaps(one.limit(0), two.limit(0), "a", "b").count()


def test_points_are_shuffled_a_few_times(spark, monkeypatch):
    """A point goes to its leaf and one ancestor, not to each level of a deep tree; trees of other depths find the same pairs."""
    rng = random.Random(8)
    rows = [(i, a, a + rng.choice([0, 3, rng.randrange(2000)])) for i in range(150) for a in [rng.randrange(2000)]]
    one, two = (spark.createDataFrame(rows[k::2], f"{name} int, a long, b long") for k, name in enumerate("ij"))
    want = sorted((i, j) for i, a, b in rows[0::2] for j, c, d in rows[1::2] if a <= d and c <= b)
    assert overlaps(one, two, "a", "b")._jdf.queryExecution().analyzed().toString().count("shiftright(_leaf") <= 6
    for fan in (1, 2, 3, 10):
        monkeypatch.setattr(join, "FAN", fan)
        assert sorted(map(tuple, overlaps(one, two, "a", "b").collect())) == want


def test_long_intervals_take_few_nodes(spark, monkeypatch):
    """An interval over everything is met by each point once, not in each leaf."""
    points = spark.range(2000).select("id", F.col("id").alias("a"), F.col("id").alias("b"))
    wide = spark.range(3).select(F.col("id").alias("w"), F.lit(-1).cast("long").alias("a"), F.lit(5000).cast("long").alias("b"))
    got = overlaps(wide, points, "a", "b")
    assert got.count() == 6000 and got.distinct().count() == 6000


def sent(df):
    """The frame's rows, and how many each exchange of its plan has written."""
    rows, todo, found = sorted(map(tuple, df.collect())), [df._jdf.queryExecution().executedPlan()], []
    while todo:
        node = todo.pop()
        todo += [node.children().apply(i) for i in range(node.children().size())]
        if node.nodeName().startswith("Exchange"):
            found.append(node.metrics().apply("shuffleRecordsWritten").value())
    return rows, found


def test_intervals_are_shuffled_once(spark):
    """Each side by one exchange, with at most one more row for two, whatever part of the axis the intervals are as long as; pairs once, in cells cut in parts too."""
    with setting(spark, "spark.sql.adaptive.enabled", "false"), setting(spark, "spark.sql.autoBroadcastJoinThreshold", "-1"):
        for length in (0, 30, 3000):
            rng = random.Random(length)
            rows = [(i, a, a + rng.randrange(length + 1)) for i in range(3000) for a in [rng.randrange(300_000)]]
            one, two = (spark.createDataFrame(rows[k::2], f"{name} int, a long, b long") for k, name in enumerate("ij"))
            got, written = sent(overlaps(one, two, "a", "b"))
            assert got == sorted((i, j) for i, a, b in rows[0::2] for j, c, d in rows[1::2] if a <= d and c <= b)
            assert len(written) == 2 and 3000 <= sum(written) <= 4500


def test_guests_of_both_sides_stay_apart(spark):
    """Intervals over most of the axis: a pair of guests would meet in each leaf that both reach into."""
    rows = [(i, i, i + 2000) for i in range(800)]
    one, two = (spark.createDataFrame(rows[k::2], f"{name} int, a long, b long") for k, name in enumerate("ij"))
    with setting(spark, "spark.sql.adaptive.enabled", "false"), setting(spark, "spark.sql.autoBroadcastJoinThreshold", "-1"):
        got, written = sent(overlaps(one, two, "a", "b"))
        assert got == [(i, j) for i in range(0, 800, 2) for j in range(1, 800, 2)]
        assert len(written) == 2 and sum(written) <= 800 * 66


@pytest.mark.parametrize("kind", ["double", "date", "timestamp", "timestamp_ntz", "decimal(9,2)"])
def test_overlaps_of_other_kinds(spark, kind):
    rng = random.Random(9)
    rows = [(i, a, a + rng.randrange(40)) for i in range(120) for a in [rng.randrange(-500, 500)]]
    value = {"double": "x / 7D", "date": "date_add(DATE'1970-01-01', x)", "decimal(9,2)": "x / 4"}.get(kind, "timestamp_seconds(x)")
    one, two = (spark.createDataFrame(rows[k::2], f"{name} int, x int, y int").selectExpr(name, f"CAST({value} AS {kind}) AS a", f"CAST({value.replace('x', 'y')} AS {kind}) AS b") for k, name in enumerate("ij"))
    assert sorted(map(tuple, overlaps(one, two, "a", "b").collect())) == sorted((i, j) for i, a, b in rows[0::2] for j, c, d in rows[1::2] if a <= d and c <= b)


def test_reached_with_circles(spark, monkeypatch):
    monkeypatch.setattr(recursion, "MERGED", 3)
    edges = [(0, 1), (1, 2), (2, 0), (2, 3), (3, 4), (4, 5), (5, 6), (6, 7), (7, 3), (1, 2), (9, 10), (None, 11), (5, None)] + [(3, 100 + i) for i in range(50)]
    got = reached(spark.createDataFrame([(0,), (0,), (None,)], "node long"), spark.createDataFrame(edges, "source long, target long"))
    want = {0: 0, 1: 1, 2: 2, 3: 3, 4: 4, 5: 5, 6: 6, 7: 7} | {100 + i: 4 for i in range(50)}
    assert sorted(map(tuple, got.collect())) == sorted(want.items())
    assert reached(spark.createDataFrame([], "node long"), spark.createDataFrame(edges, "source long, target long")).count() == 0


@pytest.fixture
def grouped(tmp_path):
    """Two files of row groups of 100 rows, ids in order."""
    for f in range(2):
        ids = list(range(f * 500, f * 500 + 500))
        pq.write_table(pa.table({"i": ids, "s": [None if i % 10 == 3 else f"x{i % 4}" for i in ids], "f": [i / 2 for i in ids]}), tmp_path / f"part-{f}.parquet", row_group_size=100)
    return str(tmp_path)


def read_rows(df):
    """The rows that the source gave to Spark, by the scan's metric."""
    plan = df._jdf.queryExecution().executedPlan()
    df.collect()
    plan = df._jdf.queryExecution().executedPlan()
    leaves = plan.collectLeaves()
    return sum(leaves.apply(i).metrics().apply("numOutputRows").value() for i in range(leaves.size()))


def test_filters_reach_the_custom_source(spark, grouped):
    spark.dataSource.register(RowGroups)
    load = lambda: spark.read.format("weft_row_groups").option("path", grouped).load()
    asked = "i >= 250 AND i < 270 AND s IN ('x1', 'x2') AND f * 2 > 251"
    with setting(spark, "spark.sql.adaptive.enabled", "false"):
        with setting(spark, "spark.sql.python.filterPushdown.enabled", "true"):
            pushed = load().where(asked)
            assert sorted(r["i"] for r in pushed.collect()) == [i for i in range(252, 270) if i % 10 != 3 and i % 4 in (1, 2)]
            assert read_rows(pushed) == sum(i % 10 != 3 and i % 4 in (1, 2) for i in range(250, 270))
            assert read_rows(load().where("f * 2 > 251")) == 1000  # not a filter that the source takes
    with setting(spark, "spark.sql.python.filterPushdown.enabled", "true"):
        assert load().rdd.getNumPartitions() == 10
        assert load().where("s IS NULL").count() == 100 and load().where("s <=> null AND i = 3").count() == 1 and load().where("i > 5000").count() == 0


def test_row_groups_as_a_stream(spark, grouped):
    spark.dataSource.register(RowGroups)
    for most in ({}, {"most": "3"}):
        found = to_parquet(spark.readStream.format("weft_row_groups").options(path=grouped, **most).load(), spark)
        ids = [r["i"] for r in found.collect()]
        assert len(ids) == len(set(ids)) and len(ids) == (300 if most else 1000)


@pytest.mark.parametrize("name", ["distinct_sketches", "quantile_sketches"])
def test_sketches_are_merged(spark, name):
    rows = QUERIES[name](spark, SF).collect()
    assert len(rows) == 3 and all(r["close"] for r in rows)


def test_sample_by_key_is_a_tenth(spark):
    n = QUERIES["sample_by_key"](spark, SF).count()
    assert math.isclose(n, 150, rel_tol=0.3)
