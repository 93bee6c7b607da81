"""A data source that writes Parquet files with a `geo` footer entry, published by the driver's commit.

Spark has no hook for footer entries, so tasks write with Arrow, batch by batch, into a folder of the job that readers skip.
Every attempt has a file of its own and reports it. Only when all partitions are there are the reported files moved to
their names; the job's folder then goes, with whatever lost or repeated attempts left. An aborted job leaves nothing.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql.datasource import DataSource, DataSourceArrowWriter, WriterCommitMessage

from granulake.sources.footers import file_system

SHORT_NAME = "geo_files"


@dataclass
class Written(WriterCommitMessage):
    """File of one task's attempt, or None for a partition without rows."""

    partition: int
    file: str | None


class GeoFiles(DataSource):
    """`df.write.format("geo_files").option("geo", entry).mode("append").save(path)`."""

    @classmethod
    def name(cls) -> str:
        return SHORT_NAME

    def writer(self, schema, overwrite: bool) -> "GeoWriter":
        return GeoWriter(self.options["path"], self.options["geo"], int(self.options.get("group_rows", 100_000)), overwrite)


class GeoWriter(DataSourceArrowWriter):
    def __init__(self, path: str, geo: str, group_rows: int, overwrite: bool):
        self.path, self.geo, self.group_rows, self.overwrite = path, geo, group_rows, overwrite
        self.job = uuid.uuid4().hex

    def _place(self):
        system, folder = file_system(self.path)
        return system, folder, f"{folder}/_job-{self.job}"

    def write(self, iterator: Iterator[pa.RecordBatch]) -> Written:
        import pyarrow.parquet as pq
        from pyspark import TaskContext

        system, _, pending = self._place()
        partition = TaskContext.get().partitionId()
        file, out = f"{pending}/{uuid.uuid4().hex}", None
        for batch in iterator:
            if not batch.num_rows:
                continue
            if out is None:
                system.create_dir(pending, recursive=True)
                schema = batch.schema.with_metadata({**(batch.schema.metadata or {}), b"geo": self.geo.encode()})
                out = pq.ParquetWriter(file, schema, filesystem=system, compression="snappy")
            out.write_table(pa.Table.from_batches([batch]).cast(schema), row_group_size=self.group_rows)
        if out is None:
            return Written(partition, None)
        out.close()
        return Written(partition, file)

    def commit(self, messages) -> None:
        import pyarrow.fs as fs

        system, folder, pending = self._place()
        system.create_dir(folder, recursive=True)
        older = []
        if self.overwrite:
            listed = system.get_file_info(fs.FileSelector(folder))
            older = [f.path for f in listed if f.is_file and f.base_name.endswith(".parquet")]
        for message in messages:
            if message is not None and message.file is not None:
                system.move(message.file, f"{folder}/part-{message.partition:05d}-{self.job}.parquet")
        for file in older:
            system.delete_file(file)
        self._clear(system, pending)

    def abort(self, messages) -> None:
        system, _, pending = self._place()
        self._clear(system, pending)

    @staticmethod
    def _clear(system, pending: str) -> None:
        import pyarrow.fs as fs

        if system.get_file_info(pending).type == fs.FileType.Directory:
            system.delete_dir(pending)
