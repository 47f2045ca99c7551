import random

import duckdb
import pytest
from pyspark.sql import functions as F

import __spark_entry__
from weft.operators.aggregate import quantiles
from weft.operators.join import as_of, within
from weft.sources.tables import read, table, write

SF = "/root/testdata/sf0.001"


def test_as_of_with_nulls_and_ties(spark):
    left = spark.createDataFrame([(1, 10, "a"), (1, 20, "b"), (2, 5, "c"), (None, 7, "d"), (1, 20, "b"), (3, 1, "e")], "k int, t int, name string")
    right = spark.createDataFrame([(1, 10, 100, "x"), (1, 10, 90, "x"), (1, 21, 200, "x"), (None, 6, 300, "x"), (3, 2, 400, "x")], "k int, t int, v int, name string")
    got = as_of(left, right, ["k"], "t", ["v"])
    assert got.columns == ["k", "t", "name", "v"]
    assert sorted(str((r["name"], r["v"])) for r in got.collect()) == sorted(map(str, [("a", 100), ("b", 100), ("b", 100), ("c", None), ("d", 300), ("e", None)]))
    assert "Join" not in got._jdf.queryExecution().executedPlan().toString()


def test_as_of_in_any_bins(spark):
    """The bins' width changes nothing, nor does a null time; a key's first bins have no right row, later ones take it from bins before."""
    left = spark.createDataFrame([(i % 3, (i * 37) % 500 - 100, i) for i in range(300)] + [(0, None, -1)], "k int, t int, i int")
    rows = [(j % 2, (j * 53) % 400, j) for j in range(40)]
    right = spark.createDataFrame([*rows, (0, None, 99)], "k int, t int, v int")
    last = lambda k, t: max(((at, v) for key, at, v in rows if key == k and at <= t), default=(0, None))[1]
    want = {(i, last(i % 3, (i * 37) % 500 - 100)) for i in range(300)} | {(-1, None)}
    for seconds in (1, 60, 86400):
        got = [(r["i"], r["v"]) for r in as_of(left, right, ["k"], "t", ["v"], seconds).collect()]
        assert len(got) == len(want) and set(got) == want


def test_quantiles_against_the_engine(spark):
    """Few and many values, ties, one hot key, null keys and values, a key of nulls alone; few bins and many."""
    rng = random.Random(4)
    rows = [(rng.choice([1, 1, 1, 2]), rng.choice([0.0, -1.5, rng.random() * 100, rng.expovariate(9)])) for _ in range(3000)] + [(None, float(i % 7)) for i in range(50)] + [(3, 2.0), (1, None), (4, None)]
    df = spark.createDataFrame(rows, "k int, x double")
    want = df.groupBy("k").agg(F.median("x").alias("m"), F.percentile("x", 0.9).alias("p"), F.expr("percentile_disc(0.25) WITHIN GROUP (ORDER BY x)").alias("d"), F.expr("percentile_disc(0.0) WITHIN GROUP (ORDER BY x)").alias("z"))
    plain = lambda rows: sorted(str([None if v is None else round(v, 9) for v in r]) for r in rows.collect())
    assert plain(quantiles(df, ["k"], "x", {"m": 0.5, "p": 0.9}, {"d": 0.25, "z": 0.0})) == plain(want)
    assert quantiles(df.limit(0), ["k"], "x", {"m": 0.5}, {}).count() == 0


def test_within_finds_each_pair_once(spark):
    left = spark.range(50).selectExpr("1 AS k", "timestamp_seconds(id * 37) AS a", "id AS i")
    right = spark.range(50).selectExpr("1 AS k", "timestamp_seconds(id * 23) AS b", "id AS j")
    got = within(left, right, ["k"], "a", "b", 60).select("i", "j").collect()
    want = {(i, j) for i in range(50) for j in range(50) if 0 <= j * 23 - i * 37 <= 60}
    assert len(got) == len(want) and {tuple(r) for r in got} == want


@pytest.mark.parametrize("kind", ["parquet", "orc", "csv", "json"])
def test_formats_round_trip(spark, tmp_path, kind):
    df = spark.createDataFrame([(1, 'quo"te, comma', 1.5), (2, None, None), (3, "line\\n", -0.0)], "id long, name string, x double")
    write(df, str(tmp_path / kind), kind)
    assert sorted(map(str, read(spark, str(tmp_path / kind), kind, df.schema).collect())) == sorted(map(str, df.collect()))
    with pytest.raises(ValueError, match="none of"):
        write(df, str(tmp_path / "x"), "xml")


def test_partitions_are_pruned(spark, tmp_path):
    write(table(spark, SF, "orders"), str(tmp_path / "o"), partition_by=["o_orderstatus"])
    got = spark.read.parquet(str(tmp_path / "o")).where("o_orderstatus = 'F'")
    assert "PartitionFilters: [isnotnull(o_orderstatus" in got._jdf.queryExecution().executedPlan().toString()
    assert got.count() == table(spark, SF, "orders").where("o_orderstatus = 'F'").count()


def test_filters_and_columns_reach_the_scan(spark):
    from weft.operators.filters import filter_project

    plan = filter_project(spark, SF)._jdf.queryExecution().executedPlan().toString()
    assert "GreaterThan(l_quantity,49.0)" in plan and "l_suppkey" not in plan


def test_top_per_group_limits_before_the_shuffle(spark):
    from weft.operators.window import top_per_group

    assert "WindowGroupLimit" in top_per_group(spark, SF)._jdf.queryExecution().executedPlan().toString()


def test_nulls_in_aggregates(spark):
    df = spark.createDataFrame([(None, 1.0), (None, None), ("a", None)], "k string, x double")
    got = {r["k"]: (r["n"], r["s"]) for r in df.groupBy("k").agg(F.count("*").alias("n"), F.sum("x").alias("s")).collect()}
    assert got == {None: (2, 1.0), "a": (1, None)}


def test_entry(spark):
    assert __spark_entry__.entry(spark).count() > 0
    assert set(__spark_entry__.oracle_sql()) <= set(__spark_entry__.queries())


def test_custom_source(spark):
    from weft.sources.numbers import Numbers

    spark.dataSource.register(Numbers)
    df = spark.read.format("weft_numbers").options(start=5, end=200_005, partitions=3).load()
    assert df.rdd.getNumPartitions() == 3 and df.agg(F.count("*"), F.min("n"), F.max("n"), F.countDistinct("n")).first()[:] == (200_000, 5, 200_004, 200_000)
    assert spark.read.format("weft_numbers").load().count() == 0


def test_lateral_top_orders_orders_its_window(spark, tmp_path):
    """Places hang on prices and keys, not on the order in which a shuffle deals the rows; null prices and keys come last, and a customer's repeated row repeats its orders."""
    rng = random.Random(5)
    orders = [(i, rng.randrange(40), rng.choice([None, 1.0, 2.0, float("nan"), rng.random()])) for i in range(400)] + [(None, 7, 9.0), (900, 7, 9.0), (901, 7, 9.0), (902, 50, None), (903, None, 1.0)]
    spark.createDataFrame(orders, "o_orderkey long, o_custkey long, o_totalprice double").repartition(16, "o_orderkey").write.parquet(str(tmp_path / "orders.parquet"))
    spark.createDataFrame([(c,) for c in [*range(45), 3, 50, None]], "c_custkey long").write.parquet(str(tmp_path / "customer.parquet"))
    found = __spark_entry__.queries()["lateral_top_orders"](spark, str(tmp_path))
    con = duckdb.connect()
    for name in ("orders", "customer"):
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM read_parquet('{tmp_path}/{name}.parquet/*.parquet')")
    want = con.sql(__spark_entry__.oracle_sql()["lateral_top_orders"]).fetchall()
    assert sorted(map(str, map(tuple, found.collect()))) == sorted(map(str, want)) and len(want) > 60
    assert "row_number() windowspecdefinition(o_custkey" in (plan := found._jdf.queryExecution().optimizedPlan().toString()) and "o_totalprice" in plan.split("windowspecdefinition(", 1)[1].split("specifiedwindowframe", 1)[0]
