"""Arrow IPC (Feather) files as a Spark source.

`spark.dataSource.register(FeatherSource)`, then `spark.read.format("feather")`;
or `read_feather`. A record batch is a partition, the schema is that of the
first file's footer, and only the columns that are asked for are read.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import pyarrow as pa
from pyarrow import fs as pafs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition
from pyspark.sql.pandas.types import from_arrow_schema
from pyspark.sql.types import StructType

ENDINGS = (".feather", ".arrow", ".ipc")


def _opened(path: str) -> tuple[pafs.FileSystem, str]:
    return pafs.FileSystem.from_uri(path) if "://" in path or path.startswith("file:") else (pafs.LocalFileSystem(), path)


def files(path: str) -> list[str]:
    """The file, or all below a folder that have a known ending, in order."""
    fs, at = _opened(path)
    info = fs.get_file_info(at)
    if info.type == pafs.FileType.NotFound:
        raise FileNotFoundError(path)
    if info.type == pafs.FileType.File:
        return [at]
    return sorted(f.path for f in fs.get_file_info(pafs.FileSelector(at, recursive=True)) if f.type == pafs.FileType.File and f.path.endswith(ENDINGS))


def _reader(fs: pafs.FileSystem, at: str, columns: Sequence[str] | None) -> pa.ipc.RecordBatchFileReader:
    source = fs.open_input_file(at)
    whole = pa.ipc.open_file(source)
    if columns is None:
        return whole
    found = [i for i in (whole.schema.get_field_index(c) for c in columns) if i >= 0]
    return pa.ipc.open_file(source, options=pa.ipc.IpcReadOptions(included_fields=found))


class Batch(InputPartition):
    def __init__(self, path: str, number: int):
        self.path, self.number = path, number


class FeatherReader(DataSourceReader):
    def __init__(self, path: str, columns: Sequence[str] | None, schema: StructType):
        self.path, self.columns, self.names = path, columns, schema.names

    def partitions(self) -> Sequence[InputPartition]:
        fs, _ = _opened(self.path)
        return [Batch(f, i) for f in files(self.path) for i in range(_reader(fs, f, []).num_record_batches)]

    def read(self, partition: Batch) -> Iterator[pa.RecordBatch]:
        fs, _ = _opened(self.path)
        batch = _reader(fs, partition.path, self.names).get_batch(partition.number)
        yield pa.RecordBatch.from_arrays([batch.column(batch.schema.get_field_index(n)) for n in self.names], self.names)


class FeatherSource(DataSource):
    """Options: path, and columns, a list of names with commas between them."""

    @classmethod
    def name(cls) -> str:
        return "feather"

    def _columns(self) -> list[str] | None:
        return [c.strip() for c in self.options["columns"].split(",")] if "columns" in self.options else None

    def schema(self) -> StructType:
        fs, _ = _opened(self.options["path"])
        found = files(self.options["path"])
        if not found:
            raise FileNotFoundError(f"no Arrow files below {self.options['path']}")
        whole = from_arrow_schema(_reader(fs, found[0], None).schema)
        return whole if self._columns() is None else StructType([whole[c] for c in self._columns()])

    def reader(self, schema: StructType) -> DataSourceReader:
        return FeatherReader(self.options["path"], self._columns(), schema)


def read_feather(spark: SparkSession, path: str, columns: Sequence[str] | None = None) -> DataFrame:
    """A file or a folder of Arrow IPC files; with columns, only those are read
    from the files. Executors must reach the path."""
    spark.dataSource.register(FeatherSource)
    reader = spark.read.format("feather")
    return (reader if columns is None else reader.option("columns", ",".join(columns))).load(path)
