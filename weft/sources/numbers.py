"""A custom source: consecutive numbers in partitions, as a pattern for sources that Spark can't read itself."""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import pyarrow as pa
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition


class Span(InputPartition):
    def __init__(self, start: int, end: int) -> None:
        self.start, self.end = start, end


class NumbersReader(DataSourceReader):
    def __init__(self, start: int, end: int, partitions: int) -> None:
        self.start, self.end, self.count = start, max(start, end), max(1, partitions)

    def partitions(self) -> Sequence[InputPartition]:
        edges = [self.start + (self.end - self.start) * i // self.count for i in range(self.count + 1)]
        return [Span(a, b) for a, b in zip(edges, edges[1:], strict=False)]

    def read(self, partition: Span) -> Iterator[pa.RecordBatch]:
        for at in range(partition.start, partition.end, 65_536):
            yield pa.RecordBatch.from_arrays([pa.array(range(at, min(at + 65_536, partition.end)), pa.int64())], ["n"])


class Numbers(DataSource):
    """spark.dataSource.register(Numbers); spark.read.format("weft_numbers").option("end", 100).load()"""

    @classmethod
    def name(cls) -> str:
        return "weft_numbers"

    def schema(self) -> str:
        return "n long"

    def reader(self, schema) -> DataSourceReader:
        return NumbersReader(int(self.options.get("start", 0)), int(self.options.get("end", 0)), int(self.options.get("partitions", 4)))
