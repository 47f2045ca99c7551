"""Scalar functions, where Spark and DuckDB agree on a result."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from weft.plans.catalog import query
from weft.sources.tables import table


@query("""
SELECT p_partkey, length(p_name) AS n, upper(p_name) AS up, substr(p_name, 2, 4) AS part, p_brand || '/' || p_type AS joined, replace(p_type, 'O', '0') AS zero,
       levenshtein(p_name, p_type) AS distance, lpad(CAST(p_size AS VARCHAR), 4, '0') AS padded, split_part(p_name, ' ', 1) AS first_word, reverse(p_type) AS back,
       concat_ws('-', p_brand, p_type) AS dashed, string_split(p_name, ' ')[2] AS second_word FROM part""")
def strings(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "part").select(
        "p_partkey", F.length("p_name").cast("long").alias("n"), F.upper("p_name").alias("up"), F.substring("p_name", 2, 4).alias("part"), F.concat("p_brand", F.lit("/"), "p_type").alias("joined"),
        F.replace("p_type", F.lit("O"), F.lit("0")).alias("zero"), F.levenshtein("p_name", "p_type").cast("long").alias("distance"), F.lpad(F.col("p_size").cast("string"), 4, "0").alias("padded"),
        F.split_part("p_name", F.lit(" "), F.lit(1)).alias("first_word"), F.reverse("p_type").alias("back"),
        F.concat_ws("-", "p_brand", "p_type").alias("dashed"), F.get(F.split("p_name", " "), F.lit(1)).alias("second_word"),
    )


@query(r"SELECT event_id, regexp_extract(props, '\d+', 0) AS digits, regexp_replace(props, '[^a-z0-9]', '', 'g') AS kept FROM events")
def patterns(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "events").select("event_id", F.regexp_extract("props", r"\d+", 0).alias("digits"), F.regexp_replace("props", "[^a-z0-9]", "").alias("kept"))


@query("""
SELECT o_orderkey, year(o_orderdate) AS y, quarter(o_orderdate) AS q, month(o_orderdate) AS m, dayofweek(o_orderdate) AS dow, weekofyear(o_orderdate) AS week,
       CAST(date_trunc('month', o_orderdate) AS TIMESTAMP) AS month_start, date_diff('day', TIMESTAMP '1995-01-01', o_orderdate) AS days FROM orders""")
def dates(spark: SparkSession, sf_dir: str) -> DataFrame:
    day = F.col("o_orderdate")
    return table(spark, sf_dir, "orders").select(
        "o_orderkey", F.year(day).cast("long").alias("y"), F.quarter(day).cast("long").alias("q"), F.month(day).cast("long").alias("m"), (F.dayofweek(day) - 1).cast("long").alias("dow"), F.weekofyear(day).cast("long").alias("week"),
        F.date_trunc("month", day).cast("timestamp_ntz").alias("month_start"), F.datediff(day, F.lit("1995-01-01").cast("date")).cast("long").alias("days"),
    )


@query("""
SELECT p_partkey, round(ln(p_retailprice), 8) AS natural, round(log10(p_retailprice), 8) AS tens, round(log2(p_retailprice), 8) AS twos, round(sqrt(p_retailprice), 8) AS root, p_partkey % 7 AS rest, p_size // 3 AS thirds,
       round(p_size / nullif(p_size % 5, 0), 8) AS guarded, abs(25 - p_size) AS gap, CAST(floor(p_retailprice) AS BIGINT) AS down, greatest(p_size, 10) AS most FROM part""")
def maths(spark: SparkSession, sf_dir: str) -> DataFrame:
    price, size = F.col("p_retailprice"), F.col("p_size")
    return table(spark, sf_dir, "part").select(
        "p_partkey", F.round(F.ln(price), 8).alias("natural"), F.round(F.log10(price), 8).alias("tens"), F.round(F.log2(price), 8).alias("twos"), F.round(F.sqrt(price), 8).alias("root"), (F.col("p_partkey") % 7).alias("rest"), F.expr("cast(p_size div 3 AS int)").alias("thirds"),
        F.round(F.try_divide(size, size % 5), 8).alias("guarded"), F.abs(25 - size).alias("gap"), F.floor(price).alias("down"), F.greatest(size, F.lit(10)).alias("most"),
    )


@query("SELECT event_id, CAST(json_extract_string(props, '$.k') AS BIGINT) AS k FROM events")
def json_field(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "events").select("event_id", F.get_json_object("props", "$.k").cast("long").alias("k"))


@query("SELECT vec_id, round(list_sum(list_transform(embedding, lambda x: CAST(x AS DOUBLE) * CAST(x AS DOUBLE))), 5) AS norm2, len(list_filter(embedding, lambda x: x > 0)) AS positive FROM embeddings")
def arrays(spark: SparkSession, sf_dir: str) -> DataFrame:
    square = F.aggregate("embedding", F.lit(0.0), lambda a, x: a + x.cast("double") * x.cast("double"))
    return table(spark, sf_dir, "embeddings").select("vec_id", F.round(square, 5).alias("norm2"), F.size(F.filter("embedding", lambda x: x > 0)).cast("long").alias("positive"))


@query("""SELECT event_id, k, k AS k_variant, '{"k":' || k || '}' AS again FROM (SELECT event_id, CAST(json_extract_string(props, '$.k') AS BIGINT) AS k FROM events)""")
def json_parsed(spark: SparkSession, sf_dir: str) -> DataFrame:
    """By schema, as a variant, and written again."""
    parsed = table(spark, sf_dir, "events").select("event_id", F.from_json("props", "k bigint").alias("json"), F.parse_json("props").alias("variant"))
    return parsed.select("event_id", F.col("json.k").alias("k"), F.variant_get("variant", "$.k", "bigint").alias("k_variant"), F.to_json("json").alias("again"))


@query("SELECT label, unnest(embedding) AS x FROM embeddings")
def explode_array(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "embeddings").select("label", F.explode("embedding").alias("x"))


@query("""
SELECT vec_id, round(list_sum(list_transform(embedding, lambda x: CAST(x AS DOUBLE) * (CAST(x AS DOUBLE) + 1))), 5) AS dotted, list_max(embedding) AS top, list_sort(embedding)[1] AS low,
       len(embedding) AS n, list_contains(embedding, list_max(embedding)) AS has_top FROM embeddings""")
def array_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    wide = F.transform("embedding", lambda x: x.cast("double"))
    products = F.zip_with(wide, F.transform(wide, lambda x: x + 1), lambda a, b: a * b)
    dotted = F.round(F.aggregate(products, F.lit(0.0), lambda a, x: a + x), 5)
    return table(spark, sf_dir, "embeddings").select(
        "vec_id", dotted.alias("dotted"), F.array_max("embedding").alias("top"), F.get(F.array_sort("embedding"), F.lit(0)).alias("low"),
        F.size("embedding").cast("long").alias("n"), F.array_contains("embedding", F.array_max("embedding")).alias("has_top"),
    )


@query("SELECT n_name, n_regionkey AS value FROM nation")
def maps(spark: SparkSession, sf_dir: str) -> DataFrame:
    pairs = table(spark, sf_dir, "nation").select(F.create_map("n_name", "n_regionkey").alias("m"))
    return pairs.select(F.explode("m").alias("n_name", "value"))


@query("""
SELECT n_regionkey, string_agg(n_name, ',' ORDER BY n_name) AS names, CAST(sum(n_nationkey) AS BIGINT) AS total, CAST(count(*) AS BIGINT) AS n FROM nation GROUP BY n_regionkey""")
def map_from_arrays(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A map of each region's nations; 25 rows in all."""
    held = table(spark, sf_dir, "nation").groupBy("n_regionkey").agg(F.collect_list(F.struct("n_name", "n_nationkey")).alias("rows"))
    mapped = held.select("n_regionkey", F.map_from_arrays("rows.n_name", "rows.n_nationkey").alias("m"))
    total = F.aggregate(F.map_values("m"), F.lit(0).cast("long"), lambda a, x: a + x)
    return mapped.select("n_regionkey", F.array_join(F.array_sort(F.map_keys("m")), ",").alias("names"), total.alias("total"), F.size("m").cast("long").alias("n"))


@query()
def checksums(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Held against zlib and xxhash in the tests, as SQL has neither."""
    return table(spark, sf_dir, "supplier").select("s_suppkey", "s_name", F.crc32("s_name").alias("crc"), F.xxhash64("s_name").alias("xx"))


@query("SELECT s_suppkey, md5(s_name) AS md5, sha256(s_name) AS sha FROM supplier")
def hashes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "supplier").select("s_suppkey", F.md5("s_name").alias("md5"), F.sha2("s_name", 256).alias("sha"))
