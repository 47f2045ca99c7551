"""The corpus pipeline: five operators one after the other, each over what its predecessor kept."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession

from weft.llm import bpe, decontaminate, exact_dedup, language, near_dedup
from weft.llm.common import remove, shared_folder, table

#: (name, function); a function takes (spark, docs, sf_dir). All but the last return the columns of documents.
STAGES = [
    ("language_id", language.stage),
    ("exact_dedup", exact_dedup.stage),
    ("near_dedup", near_dedup.stage),
    ("decontamination", decontaminate.stage),
    ("byte_bpe", bpe.stage),
]

#: SQL can't express the fitted language model, the weighted sampling or the merges; tests hold run() against plain Python.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The stages over documents, each one's result written as Parquet in the shared folder and read again. A stage's folder goes once the next one is written; the last, which the result reads, stays."""
    docs, place = table(spark, sf_dir, "documents"), f"{shared_folder(spark)}/pipeline-{uuid.uuid4().hex}"
    last = None
    for name, stage in STAGES[:-1]:
        stage(spark, docs, sf_dir).write.parquet(f"{place}/{name}")
        docs = spark.read.parquet(f"{place}/{name}")
        if last:
            remove(spark, last)
        last = f"{place}/{name}"
    return STAGES[-1][1](spark, docs, sf_dir)
