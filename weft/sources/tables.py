"""The tables of a directory, and readers and writers of the file formats."""

from __future__ import annotations

import re
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

FORMATS = ("parquet", "orc", "csv", "json")


def table(spark: SparkSession, directory: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{directory}/{name}.parquet")


def sql(spark: SparkSession, directory: str, text: str, *names: str) -> DataFrame:
    """The text over the named tables. They are bound to this text alone: no view of the caller's session is made or replaced."""
    marked = re.sub(rf"\b({'|'.join(names)})\b", r"{\1}", text)
    return spark.sql(marked, **{name: table(spark, directory, name) for name in names})


def scratch(spark: SparkSession) -> str:
    """A new folder's name below spark.checkpoint.dir, which all machines share; only where that is unset and the master is this machine, below a temporary folder."""
    context = spark.sparkContext
    place = context.getConf().get("spark.checkpoint.dir") or context.getCheckpointDir()
    if not place:
        if not re.match(r"local(\[|$)", context.master):
            raise ValueError("set spark.checkpoint.dir to a folder that all machines share")
        place = tempfile.mkdtemp(prefix="weft-scratch-")
    return f"{place}/scratch-{uuid.uuid4().hex}"


def settled(df: DataFrame) -> DataFrame:
    """The frame as a Parquet table in the shared folder: computed once, read as often as needed, and safe when executors are lost."""
    place = scratch(df.sparkSession)
    df.write.parquet(place)
    return df.sparkSession.read.schema(df.schema).parquet(place)


def write(df: DataFrame, path: str, kind: str = "parquet", partition_by: list[str] | None = None, mode: str = "errorifexists") -> None:
    """A directory of files; with partition_by one folder a value, whose names later filters prune."""
    if kind not in FORMATS:
        raise ValueError(f"{kind} is none of {', '.join(FORMATS)}")
    writer = df.write.mode(mode).format(kind)
    if kind == "csv":
        writer = writer.options(header=True, escape='"', quoteAll=True)
    (writer.partitionBy(*partition_by) if partition_by else writer).save(path)


def read(spark: SparkSession, path: str, kind: str, schema: T.StructType) -> DataFrame:
    """Text formats are read by the schema, never by inference."""
    reader = spark.read.format(kind).schema(schema)
    return (reader.options(header=True, escape='"') if kind == "csv" else reader).load(path)


def plain_times(df: DataFrame) -> DataFrame:
    """Columns of times without a zone become timestamps, which watermarks ask for."""
    return df.select(*[F.col(f.name).cast("timestamp").alias(f.name) if isinstance(f.dataType, T.TimestampNTZType) else F.col(f.name) for f in df.schema])


def stream(spark: SparkSession, path: str, schema: T.StructType, glob: str = "*.parquet") -> DataFrame:
    """A file stream of a directory."""
    return plain_times(spark.readStream.schema(schema).option("pathGlobFilter", glob).parquet(path))
