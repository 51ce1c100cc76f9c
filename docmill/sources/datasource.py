"""A Python data source that reads folders of saved pages: ``spark.read.format("saved_pages").load(folder)``."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
import pyarrow.fs as pafs
from pyspark.sql import SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

SCHEMA = "path string, html string"
#: Files of a partition.
TOGETHER = 64


class Files(InputPartition):
    def __init__(self, paths: list[str]):
        self.paths = paths


class SavedPages(DataSource):
    """Options: path (a folder that pyarrow.fs opens), suffix (of the files read)."""

    @classmethod
    def name(cls) -> str:
        return "saved_pages"

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema) -> DataSourceReader:
        return Reader(self.options["path"], self.options.get("suffix", ".html"))


class Reader(DataSourceReader):
    def __init__(self, folder: str, suffix: str):
        self.folder, self.suffix = folder, suffix

    def partitions(self) -> list[Files]:
        file_system, path = pafs.FileSystem.from_uri(self.folder)
        found = sorted(f.path for f in file_system.get_file_info(pafs.FileSelector(path)) if f.is_file and f.path.endswith(self.suffix))
        return [Files(found[i : i + TOGETHER]) for i in range(0, len(found), TOGETHER)] or [Files([])]

    def read(self, partition: Files) -> Iterator[pa.RecordBatch]:
        file_system, _ = pafs.FileSystem.from_uri(self.folder)
        for path in partition.paths:
            with file_system.open_input_stream(path, compression=None) as stream:
                text = stream.read().decode("utf-8", "replace")
            yield pa.RecordBatch.from_arrays([pa.array([path]), pa.array([text])], ["path", "html"])


def register(spark: SparkSession) -> None:
    spark.dataSource.register(SavedPages)
