"""Chat formatting by perspective rotation, with DataFrame operations only.

For every participant of a conversation the dialogue is rendered with that
speaker as the assistant and the others as named users; only the assistant's
contents carry loss. The rendering of one perspective is a sequence of pieces,
one a turn, each with its place in the whole, so a conversation of any length
is never one row or one task: running lengths are summed within the ranges of a
range partitioning, and the ranges' sums are added.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from weft.llm.common import cut, numbered, table

SYSTEM = "system"
#: The rendering: a header by role, the content, the end.
HEADERS = {"system": "<|system|>\n", "assistant": "<|assistant|>\n", "user": "<|user name={}|>\n"}
END = "<|end|>\n"


def _header(role: Column, name: Column) -> Column:
    before, after = HEADERS["user"].split("{}")
    return F.when(role == "assistant", F.lit(HEADERS["assistant"])).when(role == "system", F.lit(HEADERS["system"])).otherwise(F.concat(F.lit(before), name, F.lit(after)))


def rotate(turns: DataFrame) -> DataFrame:
    """conv_id, speaker, piece, turn, role, name, rendered, start, end, trained, mask_start, mask_end.

    Participants are the distinct roles of a conversation but `system`, whose
    turns stay system turns. Places count characters (code points) from 0; the
    mask of a trained piece is its content with the end mark. A null text is
    empty; a null role speaks as `unknown`; turns are in the order of `turn`,
    nulls last, ties as they stand in the table, repeated rows stay; rows
    without conv_id are one conversation. A conversation of system turns alone
    has no perspective, an empty table no rows. Other columns are ignored. Texts
    stand as they are: marks such as `<|end|>` within one are not escaped, and the
    places, not the marks, say where a piece begins and ends.
    """
    rows = cut(numbered(turns, "conv_id", "turn", F.coalesce("role", F.lit("unknown")).alias("by"), F.coalesce("text", F.lit("")).alias("text")))
    speakers = rows.where(F.col("by") != SYSTEM).select(F.col("conv_id").alias("of"), F.col("by").alias("speaker")).distinct()
    role = F.when(F.col("by") == SYSTEM, F.lit("system")).when(F.col("by") == F.col("speaker"), F.lit("assistant")).otherwise(F.lit("user"))
    seen = rows.join(speakers, F.col("conv_id").eqNullSafe(F.col("of"))).select("conv_id", "speaker", "turn", "rid", role.alias("role"), F.col("by").alias("name"), "text")
    header = _header(F.col("role"), F.col("name"))
    pieces = seen.select("conv_id", "speaker", "turn", "rid", "role", "name", F.length(header).alias("head"), F.concat(header, "text", F.lit(END)).alias("rendered")).withColumn("n", F.length("rendered").cast("long"))

    order = [F.col("turn").asc_nulls_last(), F.col("rid")]
    ranged = cut(pieces.repartitionByRange(F.col("conv_id"), F.col("speaker"), *order).withColumn("range", F.spark_partition_id()))
    whole = W.partitionBy("conv_id", "speaker").orderBy("range").rowsBetween(W.unboundedPreceding, -1)
    sums = ranged.groupBy("conv_id", "speaker", "range").agg(F.sum("n").alias("n"), F.count("*").alias("k"))
    sums = sums.select(F.col("conv_id").alias("c"), F.col("speaker").alias("s"), F.col("range").alias("r"), F.coalesce(F.sum("n").over(whole), F.lit(0)).alias("before"), F.coalesce(F.sum("k").over(whole), F.lit(0)).alias("pieces"))
    within = W.partitionBy("conv_id", "speaker", "range").orderBy(*order)
    placed = ranged.withColumn("k", F.row_number().over(within)).withColumn("upto", F.sum("n").over(within.rowsBetween(W.unboundedPreceding, 0)))
    end = F.col("before") + F.col("upto")
    trained = F.col("role") == "assistant"
    return placed.join(sums, F.col("conv_id").eqNullSafe(F.col("c")) & (F.col("speaker") == F.col("s")) & (F.col("range") == F.col("r"))).select(
        "conv_id", "speaker", (F.col("pieces") + F.col("k") - 1).alias("piece"), "turn", "role", "name", "rendered", (end - F.col("n")).alias("start"), end.alias("end"),
        trained.alias("trained"), F.when(trained, end - F.col("n") + F.col("head")).alias("mask_start"), F.when(trained, end - 1).alias("mask_end"),
    )


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rotate(table(spark, sf_dir, "conversations"))


ORACLE_SQL = """
WITH t AS (SELECT conv_id, turn, coalesce(role, 'unknown') AS name, coalesce(text, '') AS text FROM conversations),
s AS (SELECT DISTINCT conv_id, name AS speaker FROM t WHERE name <> 'system'),
r AS (SELECT conv_id, speaker, turn, name, text, CASE WHEN name = 'system' THEN 'system' WHEN name = speaker THEN 'assistant' ELSE 'user' END AS role
      FROM t JOIN s USING (conv_id)),
h AS (SELECT *, CASE role WHEN 'system' THEN '<|system|>' || chr(10) WHEN 'assistant' THEN '<|assistant|>' || chr(10) ELSE '<|user name=' || name || '|>' || chr(10) END AS header FROM r),
p AS (SELECT *, header || text || '<|end|>' || chr(10) AS rendered FROM h),
o AS (SELECT *, row_number() OVER w - 1 AS piece, CAST(sum(length(rendered)) OVER w AS BIGINT) AS "end" FROM p WINDOW w AS (PARTITION BY conv_id, speaker ORDER BY turn ROWS UNBOUNDED PRECEDING))
SELECT conv_id, speaker, piece, turn, role, name, rendered, "end" - length(rendered) AS "start", "end", role = 'assistant' AS trained,
       CASE WHEN role = 'assistant' THEN "end" - length(rendered) + length(header) END AS mask_start,
       CASE WHEN role = 'assistant' THEN "end" - 1 END AS mask_end FROM o
"""
