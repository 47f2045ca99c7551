"""A custom source over the files of a Parquet table: a partition for each row group, filters pushed into the scan, and a stream of row groups with offsets.

It shows what a source for a format that Spark can't read has to do; plain
tables are read by Spark itself.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator, Sequence

import pyarrow as pa
import pyarrow.compute as pc
import pyarrow.fs
import pyarrow.parquet as pq
from pyspark.sql import datasource as ds
from pyspark.sql.pandas.types import from_arrow_schema
from pyspark.sql.types import StructType

BATCH_ROWS = 65_536


def _open(path: str) -> tuple[pa.fs.FileSystem, str]:
    return pa.fs.FileSystem.from_uri(path if "://" in path or path.startswith("file:") else f"file://{path}")


def files(path: str) -> list[str]:
    """The Parquet files at a path, in the order of their names; the scheme of the path is kept apart."""
    system, at = _open(path)
    if system.get_file_info(at).type == pa.fs.FileType.File:
        return [at]
    return sorted(f.path for f in system.get_file_info(pa.fs.FileSelector(at, recursive=True)) if f.is_file and f.path.endswith(".parquet") and not f.base_name.startswith(("_", ".")))


class RowGroup(ds.InputPartition):
    def __init__(self, path: str, number: int) -> None:
        self.path, self.number = path, number


def row_groups(path: str) -> list[RowGroup]:
    system, _ = _open(path)
    return [RowGroup(f, i) for f in files(path) for i in range(pq.ParquetFile(f, filesystem=system).metadata.num_row_groups)]


#: The filters that the source can answer, as functions of a column's values and the filter's value.
TESTS = {
    ds.EqualTo: pc.equal, ds.GreaterThan: pc.greater, ds.GreaterThanOrEqual: pc.greater_equal, ds.LessThan: pc.less, ds.LessThanOrEqual: pc.less_equal,
    ds.In: lambda column, values: pc.is_in(column, pa.array(values, column.type)), ds.IsNotNull: lambda column, _: pc.is_valid(column), ds.IsNull: lambda column, _: pc.is_null(column),
}


def _may_hold(found: ds.Filter, low: object, high: object) -> bool:
    """Can a row group with values from low to high hold a row that the filter leaves?"""
    value = getattr(found, "value", None)
    match found:
        case ds.EqualTo():
            return low <= value <= high
        case ds.In():
            return any(low <= v <= high for v in value)
        case ds.GreaterThan():
            return high > value
        case ds.GreaterThanOrEqual():
            return high >= value
        case ds.LessThan():
            return low < value
        case ds.LessThanOrEqual():
            return low <= value
    return True


class _Reader:
    def __init__(self, path: str, schema: StructType) -> None:
        self.path, self.names, self.filters = path, schema.names, []

    def read(self, part: RowGroup) -> Iterator[pa.RecordBatch]:
        system, _ = _open(self.path)
        file = pq.ParquetFile(part.path, filesystem=system)
        group = file.metadata.row_group(part.number)
        columns = {group.column(i).path_in_schema: group.column(i).statistics for i in range(group.num_columns)}
        for found in self.filters:
            known = columns.get(found.attribute[0])
            if known and known.has_min_max and isinstance(known.min, (int, float, str)) and not _may_hold(found, known.min, known.max):
                return
        for batch in file.iter_batches(BATCH_ROWS, [part.number], self.names):
            for found in self.filters:
                batch = batch.filter(TESTS[type(found)](batch.column(found.attribute[0]), getattr(found, "value", None)))
            if batch.num_rows:
                yield batch


class RowGroupsReader(_Reader, ds.DataSourceReader):
    def pushFilters(self, filters: list[ds.Filter]) -> Iterable[ds.Filter]:
        """Takes the filters on top-level columns by simple values; the rest stay with Spark."""
        for found in filters:
            if type(found) in TESTS and len(found.attribute) == 1:
                self.filters.append(found)
            else:
                yield found

    def partitions(self) -> Sequence[RowGroup]:
        return row_groups(self.path)


class RowGroupsStream(_Reader, ds.DataSourceStreamReader):
    """An offset is a number of row groups in the order of file names; new files must sort after old ones. `most` bounds the row groups of a batch (none: all that are there)."""

    def __init__(self, path: str, schema: StructType, most: int | None) -> None:
        super().__init__(path, schema)
        self.most, self.at = most, 0

    def initialOffset(self) -> dict:
        return {"groups": 0}

    def latestOffset(self) -> dict:
        there = len(row_groups(self.path))
        self.at = there if self.most is None else min(there, self.at + self.most)
        return {"groups": self.at}

    def partitions(self, start: dict, end: dict) -> Sequence[RowGroup]:
        self.at = max(self.at, end["groups"])
        return row_groups(self.path)[start["groups"] : end["groups"]]

    def commit(self, end: dict) -> None:
        self.at = max(self.at, end["groups"])


class RowGroups(ds.DataSource):
    """spark.dataSource.register(RowGroups); spark.read.format("weft_row_groups").option("path", folder_or_file).load()"""

    @classmethod
    def name(cls) -> str:
        return "weft_row_groups"

    def schema(self) -> StructType:
        path = self.options["path"]
        system, _ = _open(path)
        return from_arrow_schema(pq.ParquetFile(files(path)[0], filesystem=system).schema_arrow)

    def reader(self, schema: StructType) -> RowGroupsReader:
        return RowGroupsReader(self.options["path"], schema)

    def streamReader(self, schema: StructType) -> RowGroupsStream:
        most = self.options.get("most")
        return RowGroupsStream(self.options["path"], schema, int(most) if most else None)
