"""Ranked lexical search: scored postings, joined with the terms of the items.

Postings are rows (row, doc_id, term, tf, n), a table dealt by term. A term that
is nearly everywhere spreads over as many buckets as blocks of documents. A
posting's score depends on its term and its document alone, so it is computed
once and dealt by document; there the items' terms join, and the sums of item
and document need no further shuffle. Each task keeps its best before an item's
rows meet.
"""

from __future__ import annotations

from collections import Counter

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from weft.llm.common import arrow_map, cut, numbered, sized, table, written

#: What lies between terms, and the letters that are lower-cased.
BETWEEN = r"[\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
#: Bytes as terms hold them; all that lies between terms is a space.
FOLDED = bytes(b if b > 0x7F or chr(b).isalnum() else 0x20 for b in range(256)).translate(bytes.maketrans(UPPER.encode(), LOWER.encode()))
#: Documents to a bucket of one term.
BLOCK_ROWS = 16_384
BEST = 50


def terms_of(text: Column) -> Column:
    """The terms of a text in their order."""
    return F.filter(F.split(F.translate(F.coalesce(text, F.lit("")), UPPER, LOWER), BETWEEN), lambda x: x != "")


def totals(docs: DataFrame) -> tuple[int, int]:
    """The number of texts with a term, and of all terms."""

    def work(batch: pa.RecordBatch) -> pa.RecordBatch:
        lengths = [len((text or b"").translate(FOLDED).split()) for text in batch.column("text").cast(pa.binary()).to_pylist()]
        return pa.RecordBatch.from_arrays([pa.array([sum(map(bool, lengths))], pa.int64()), pa.array([sum(lengths)], pa.int64())], ["texts", "terms"])

    row = arrow_map(docs.select("text"), lambda: work, "texts long, terms long").agg(F.coalesce(F.sum("texts"), F.lit(0)).alias("texts"), F.coalesce(F.sum("terms"), F.lit(0)).alias("terms")).first()
    return row["texts"], row["terms"]


def postings(docs: DataFrame) -> DataFrame:
    """(row, doc_id, term, tf, n): how often each term occurs in each row's text, and how many terms the text has. row numbers the rows of this one frame."""

    def make():
        def work(batch: pa.RecordBatch) -> pa.RecordBatch:
            terms, tf, sizes, lengths = [], [], [], []
            for text in batch.column("text").cast(pa.binary()).to_pylist():
                words = (text or b"").translate(FOLDED).split()
                counts = Counter(words)
                terms += counts
                tf += counts.values()
                sizes.append(len(counts))
                lengths.append(len(words))
            at = np.repeat(np.arange(len(sizes)), sizes)
            return pa.RecordBatch.from_arrays(
                [batch.column("rid").take(pa.array(at)), batch.column("doc_id").take(pa.array(at)), pa.array(terms, pa.binary()).cast(pa.string()), pa.array(tf, pa.int64()), pa.array(np.array(lengths, np.int64)[at])], ["row", "doc_id", "term", "tf", "n"]
            )

        return work

    return arrow_map(numbered(docs, "doc_id", "text"), make, f"row long, doc_id {docs.schema['doc_id'].dataType.simpleString()}, term string, tf long, n long")


def index(docs: DataFrame, vocabulary: DataFrame, texts: int) -> DataFrame:
    """The postings of the vocabulary's terms as a table dealt by term and, within a term, by blocks of documents, so that no bucket grows with a term's frequency."""
    found = postings(docs).join(vocabulary, "term", "left_semi")
    blocks = 1 + texts // BLOCK_ROWS
    return written(found.withColumn("block", F.pmod(F.xxhash64("row"), F.lit(blocks))).repartition("term", "block").sortWithinPartitions("term", "row").drop("block"))


def search(docs: DataFrame, items: DataFrame, best: int = BEST) -> DataFrame:
    """item_id, rank int, doc_id, score long: each item's highest-scoring rows, equal scores by ascending doc_id.

    A term's weight is floor(1000 ln((2N + 2) / (2df + 1))); a row scores the
    weight times a saturated frequency for each of the item's terms, once each.
    Only rows with a score above 0 are ranked.

    Null, empty and blank texts and items have no terms: they count nowhere and
    find nothing. Rows are ranked by themselves, repeated ids and texts too (of
    equal scores and ids in any order, nulls after other ids). Items of one id
    are one item with the terms of all; a null id is one of them. An empty table
    gives an empty result; other columns are ignored. A text's postings are held
    by one task.
    """
    texts, terms = totals(docs)
    asked = cut(items.select("item_id", F.explode(F.array_distinct(terms_of(F.col("text")))).alias("term")).distinct())
    width = F.octet_length("term") + 64
    found = index(docs, sized(asked.select("term").distinct(), width), texts)
    weight = F.floor(1000 * F.ln(F.lit(2.0 * texts + 2) / (2 * F.col("df") + 1)))
    weights = cut(found.groupBy("term").agg(F.count("*").alias("df")).select("term", weight.alias("w")))
    wide = lambda c: F.col(c).cast("decimal(20,0)")  # noqa: E731  n * N passes 64 bits for the longest texts of the largest corpora
    m = 50 + F.call_function("div", wide("n") * F.lit(50 * texts).cast("decimal(18,0)"), F.lit(max(terms, 1)).cast("decimal(20,0)"))
    score = F.col("w") * F.call_function("div", 1_000_000_000 * F.col("tf"), 1000 * F.col("tf") + 20 * m)
    scored = found.join(sized(weights, width), "term").select("row", "doc_id", "term", score.alias("score")).repartition("row")
    sums = scored.join(sized(asked, width), "term").groupBy("item_id", "row", "doc_id").agg(F.sum("score").alias("score")).where("score > 0")
    rank = F.row_number().over(W.partitionBy("item_id").orderBy(F.desc("score"), F.asc_nulls_last("doc_id"), "row"))
    return sums.withColumn("rank", rank).where(F.col("rank") <= best).select("item_id", "rank", "doc_id", "score")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return search(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


ORACLE_SQL = rf"""
WITH t AS (SELECT doc_id, unnest(regexp_extract_all(translate(text, '{UPPER}', '{LOWER}'), '{BETWEEN.replace("[", "[^", 1)}')) AS term FROM documents),
p AS (SELECT doc_id, term, count(*) AS tf FROM t GROUP BY ALL),
d AS (SELECT doc_id, CAST(sum(tf) AS BIGINT) AS n FROM p GROUP BY ALL),
c AS (SELECT count(*) AS docs, CAST(sum(n) AS BIGINT) AS terms FROM d),
w AS (SELECT term, CAST(floor(1000 * ln((2.0::DOUBLE * any_value(docs) + 2) / (2 * count(*) + 1))) AS BIGINT) AS w FROM p, c GROUP BY term),
i AS (SELECT DISTINCT item_id, unnest(regexp_extract_all(translate(text, '{UPPER}', '{LOWER}'), '{BETWEEN.replace("[", "[^", 1)}')) AS term FROM benchmark),
s AS (SELECT item_id, doc_id, CAST(sum(w * ((1000000000 * tf) // (1000 * tf + 20 * (50 + (50 * n * docs) // terms)))) AS BIGINT) AS score FROM i JOIN p USING (term) JOIN w USING (term) JOIN d USING (doc_id), c GROUP BY ALL)
SELECT item_id, CAST(row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id) AS INTEGER) AS rank, doc_id, score FROM s WHERE score > 0 QUALIFY rank <= {BEST}
"""
