"""What the training-data operators share: input columns, lineage cuts, Arrow slices."""

from __future__ import annotations

import ctypes
import gc
import re
import sys
import tempfile
import uuid
from collections.abc import Callable, Iterator
from contextlib import contextmanager

import pyarrow as pa
import pyarrow.compute
from pyspark.sql import Column, SparkSession
from pyspark.sql.classic.dataframe import DataFrame
from pyspark.sql import functions as F


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_folder(spark: SparkSession) -> str:
    """The session's spark.checkpoint.dir; only where that is unset and the master is this machine (tests, a laptop) one temporary folder is made."""
    context = spark.sparkContext
    if folder := context.getConf().get("spark.checkpoint.dir"):
        return folder
    if not context.getCheckpointDir():
        if not re.match(r"local(\[|$)", context.master):
            raise ValueError("set spark.checkpoint.dir to a folder that all machines share")
        context.setCheckpointDir(tempfile.mkdtemp(prefix="weft-checkpoint-"))
    return context.getCheckpointDir()


def remove(spark: SparkSession, folder: str) -> None:
    """Deletes a folder of the shared storage."""
    path = spark._jvm.org.apache.hadoop.fs.Path(folder)
    path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


def cut(df: DataFrame) -> DataFrame:
    """The frame with its lineage cut by a reliable checkpoint in the shared folder.

    The optimizer's estimates are dropped too: a checkpoint keeps those of the
    plan it came from, and over the rounds of an iteration they multiply without
    bound. Adaptive execution goes by the sizes it measures.
    """
    spark = df.sparkSession
    shared_folder(spark)
    kept = df.checkpoint()._jdf
    return DataFrame(spark._jsparkSession.internalCreateDataFrame(kept.queryExecution().toRdd(), kept.schema(), False), spark)


def tidy(spark: SparkSession) -> None:
    """Lets the driver find what nothing refers to any more, so that Spark deletes the shuffles and checkpoints behind settled frames now and not when the driver's memory runs short."""
    gc.collect()
    spark._jvm.System.gc()


def written(df: DataFrame) -> DataFrame:
    """The frame as a Parquet table in the shared folder: its lineage is cut, and it takes less disk than a checkpoint, as its columns are encoded."""
    place = f"{shared_folder(df.sparkSession)}/table-{uuid.uuid4().hex}"
    df.write.parquet(place)
    return df.sparkSession.read.schema(df.schema).parquet(place)


#: Bytes up to which a side of a join is broadcast.
BROADCAST_BYTES = 64 << 20


def sized(df: DataFrame, row_bytes: Column) -> DataFrame:
    """The frame, to be broadcast if the bytes of its rows are few enough; else the join shuffles. It is read twice, so it should be settled."""
    return F.broadcast(df) if df.agg(F.coalesce(F.sum(row_bytes.cast("long")), F.lit(0)).alias("b")).first()["b"] <= BROADCAST_BYTES else df


@contextmanager
def setting(spark: SparkSession, name: str, value: str) -> Iterator[None]:
    """The session's setting for as long as a job runs."""
    before = spark.conf.get(name)
    spark.conf.set(name, value)
    try:
        yield
    finally:
        spark.conf.set(name, before)


#: Rows to a partition of a settled frame.
SETTLED_ROWS = 20_000


def settle(df: DataFrame) -> DataFrame:
    """cut(), in as many partitions as the rows ask for: the small frames of an iteration would else cost a file for each pair of partitions in every shuffle."""
    kept = cut(df)
    return kept.coalesce(max(1, -(-kept.count() // SETTLED_ROWS)))


def numbered(docs: DataFrame, *columns: str | Column) -> DataFrame:
    """The chosen columns and `rid`, a number of the row, for tables whose ids are null or repeat."""
    return docs.select(*columns, F.monotonically_increasing_id().alias("rid"))


def picked(docs: DataFrame, numbers: DataFrame) -> DataFrame:
    """The rows of docs whose number is in the `rid` of the other frame, with all their columns. docs must give its rows in the same order as when they were numbered."""
    row, rid = "_weft_row", "_weft_rid"
    return docs.withColumn(row, F.monotonically_increasing_id()).join(numbers.select(F.col("rid").alias(rid)), F.col(row) == F.col(rid), "left_semi").select(*docs.columns)


def input_bytes(docs: DataFrame) -> int:
    """Catalyst's estimate of the input's size: enough to choose a number of buckets."""
    return int(str(docs._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()))


#: Bytes of an Arrow batch between the JVM and a worker.
BATCH_BYTES = 4 << 20


def bounded_batches(spark: SparkSession) -> None:
    """Bounds the session's Arrow batches by bytes, but for a single row's, where no smaller bound is set: by rows alone, their memory in both processes follows the texts' lengths."""
    name = "spark.sql.execution.arrow.maxBytesPerBatch"
    now = re.fullmatch(r"(\d+)b?", spark.conf.get(name))  # the default is shown as 67108864b
    if not now or int(now[1]) > BATCH_BYTES:
        spark.conf.set(name, str(BATCH_BYTES))


def column_of(batch: pa.RecordBatch, path: str) -> pa.Array:
    """A column, or a field of a struct column as `row.text`."""
    outer, _, inner = path.partition(".")
    return pa.compute.struct_field(batch.column(outer), inner) if inner else batch.column(outer)


def slices(batches: Iterator[pa.RecordBatch], column: str, most: int = 4 << 20) -> Iterator[pa.RecordBatch]:
    """The batches cut to about `most` bytes of the column, so that a worker's memory doesn't follow the rows in a batch."""
    for batch in batches:
        start = held = 0
        for i, n in enumerate(pa.compute.binary_length(column_of(batch, column)).to_pylist()):
            if held and held + (n or 0) > most:
                yield batch.slice(start, i - start)
                start, held = i, 0
            held += n or 0
        if start < batch.num_rows:
            yield batch.slice(start)


_held: dict[object, object] = {}


def hold(key: object, make: Callable[[], object]) -> object:
    """What a worker process keeps between tasks. It is one thing: the next operator's takes the place of the last one's."""
    if key not in _held:
        release()
        _held[key] = make()
    return _held[key]


def release() -> None:
    """Lets go of what the worker holds, and gives freed memory back to the system, which the allocators don't by themselves."""
    _held.clear()
    trim()


def trim() -> None:
    pa.default_memory_pool().release_unused()
    if sys.platform == "linux":
        ctypes.CDLL(None).malloc_trim(0)


def arrow_map(docs: DataFrame, make: Callable[[], Callable[[pa.RecordBatch], pa.RecordBatch]], schema: str, column: str = "text", most: int = 4 << 20) -> DataFrame:
    """mapInArrow with bounded slices. make() runs once in a task and gives the function for a slice."""

    bounded_batches(docs.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        work = make()
        for part in slices(batches, column, most):
            yield work(part)
        trim()

    return docs.mapInArrow(run, schema)
