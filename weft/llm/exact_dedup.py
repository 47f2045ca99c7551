"""Exact dedup by distributed MSD radix partitioning.

A document's key is its length in bytes followed by its normalised text. Each
round splits every open group by the next bytes of its members (the digit) and
closes the groups that are singletons or whose keys have ended. Digits grow
from round to round up to the last width, which repeats until no group is open;
after the first one only documents that share a length and their first bytes
are still open. Equality is that of the bytes themselves: the digests in
the result are output, never compared.

The counts of a round are aggregated before the shuffle, so a third of all rows
being copies of one text gives one row per task there; the join that brings the
counts back has one row per group on its other side, and adaptive execution
splits its large partitions.
"""

from __future__ import annotations

from itertools import chain, repeat

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from weft.llm.common import cut, numbered, picked, table, tidy

#: Bytes of each round's digit; the last width holds for all further rounds.
DIGITS = (64, 4096, 262_144, 8_388_608)


def normalised(text: Column) -> Column:
    """Each run of ASCII white space as one space; null as empty. Single spaces are left alone, as they are right already."""
    return F.regexp_replace(F.coalesce(text, F.lit("")), r"[\x09-\x0D][\x20\x09-\x0D]*|\x20[\x20\x09-\x0D]+", " ")


def exact_groups(docs: DataFrame, numbers: bool = False) -> DataFrame:
    """One row per input row: doc_id, keep_id, group_size, kept and text_sha256; with `numbers` also `rid`, the row's number in docs.

    Of rows with equal normalised texts the one with the smallest doc_id stays;
    rows without an id come last, and of rows that tie on the id (repeated
    rows) exactly one stays. Null and empty texts are equal. An empty table
    gives an empty result; other columns of the input play no part, whatever
    their names. The rows are read in more than one job, so docs must be a scan
    or another frame that gives its rows in the same order each time.
    """
    text = normalised(F.col("text"))
    rows = numbered(docs, "doc_id", text.cast("binary").alias("rest")).select(
        "rid", "doc_id", F.sha2("rest", 256).alias("text_sha256"), F.octet_length("rest").alias("size"), F.lit(-1).cast("long").alias("group"), "rest"
    )
    closed = []
    for width in chain(DIGITS, repeat(DIGITS[-1])):
        keyed = rows.withColumn("digit", F.substring("rest", 1, width))
        groups = keyed.groupBy("group", "size", "digit").agg(
            F.count("*").alias("group_size"), F.min(F.struct(F.col("doc_id").isNull(), F.col("doc_id").alias("doc_id"), F.col("rid").alias("rid"))).alias("first")
        )
        # Cut, so that the join has a shuffle of its own on either side: only then are its large partitions split.
        groups = cut(groups)
        ended = (F.col("group_size") == 1) | (F.octet_length("rest") <= width)
        split = keyed.join(groups, ["group", "size", "digit"]).select(
            "rid", "doc_id", "text_sha256", "size", F.col("first.rid").alias("group"), F.col("first.doc_id").alias("keep_id"), "group_size", F.when(~ended, F.expr(f"substring(rest, {width} + 1)")).alias("rest")
        )
        split = cut(split)
        closed.append(split.where(F.col("rest").isNull()))
        rows = split.where(F.col("rest").isNotNull()).drop("keep_id", "group_size")
        if rows.isEmpty():
            break
    result = closed[0]
    for more in closed[1:]:
        result = result.unionByName(more)
    return result.select("doc_id", "keep_id", "group_size", (F.col("rid") == F.col("group")).alias("kept"), "text_sha256", *["rid"] * numbers)


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_groups(table(spark, sf_dir, "documents"))


ORACLE_SQL = r"""
SELECT doc_id, min(doc_id) OVER g AS keep_id, count(*) OVER g AS group_size,
       doc_id = min(doc_id) OVER g AS kept, sha256(t) AS text_sha256
FROM (SELECT doc_id, regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]+', ' ', 'g') AS t FROM documents)
WINDOW g AS (PARTITION BY t)
"""


def stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The rows that stay, with all the columns of docs. The rounds carry numbers of rows, not whole rows."""
    kept = exact_groups(docs, numbers=True).where("kept")
    tidy(spark)  # the rounds' shuffles, before whole rows are shuffled
    return picked(docs, kept)
