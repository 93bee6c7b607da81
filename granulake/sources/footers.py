"""Parquet footers as tables: files are listed on the driver, footers are read by tasks."""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def list_files(spark: SparkSession, paths: str | Sequence[str], pattern: str = "*.parquet") -> DataFrame:
    """(path, length) of the data files below some files, folders or globs.

    Names only: the binary reader lists files without opening them when content is not selected.
    """
    paths = [paths] if isinstance(paths, str) else list(paths)
    reader = spark.read.format("binaryFile").option("recursiveFileLookup", "true").option("pathGlobFilter", pattern)
    return reader.load(paths).select("path", "length")


def file_system(path: str):
    """(Arrow file system, path inside it) of a path or URI as Spark writes it."""
    import pyarrow.fs as fs

    if path.startswith("file:"):
        return fs.LocalFileSystem(), "/" + path.removeprefix("file:").lstrip("/")
    if "://" in path:
        return fs.FileSystem.from_uri(path.replace("s3a://", "s3://", 1).replace("s3n://", "s3://", 1))
    return fs.LocalFileSystem(), path


def _open(path: str):
    """Footer of one file."""
    import pyarrow.parquet as pq

    system, inner = file_system(path)
    return pq.ParquetFile(inner, filesystem=system)


def _text(value, geometry: bool):
    if value is None:
        return None
    if isinstance(value, bytes):
        if geometry:
            from granulake.functions.geometry_batch import read_wkb

            shape = read_wkb(value)
            if shape is not None:
                points = "; ".join(", ".join(f"{x:g} {y:g}" for x, y in ring[2]) for ring in shape[1])
                return f"{shape[0].upper()} ({points})"
        return value.hex()
    return str(value)


STATS_DDL = (
    "path string, row_group int, rows bigint, column string, min string, max string, nulls bigint, "
    "distinct bigint, values bigint, bytes bigint, group_bytes bigint, sorted_by string"
)


def column_stats(spark: SparkSession, paths: str | Sequence[str], geometry: Sequence[str] = ("geometry",)) -> DataFrame:
    """One row per file, row group and column."""
    names = tuple(geometry)

    def read(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for path in batch["path"]:
                meta = _open(path).metadata
                rows = []
                for g in range(meta.num_row_groups):
                    group = meta.row_group(g)
                    order = ",".join(
                        f"{s.column_index}{' desc' if s.descending else ''}" for s in group.sorting_columns or ()
                    )
                    for c in range(group.num_columns):
                        col = group.column(c)
                        s = col.statistics if col.is_stats_set else None
                        is_shape = col.path_in_schema in names
                        rows.append(
                            (
                                path,
                                g,
                                group.num_rows,
                                col.path_in_schema,
                                _text(s.min, is_shape) if s and s.has_min_max else None,
                                _text(s.max, is_shape) if s and s.has_min_max else None,
                                s.null_count if s and s.has_null_count else None,
                                s.distinct_count if s and s.has_distinct_count else None,
                                col.num_values,
                                col.total_compressed_size,
                                group.total_byte_size,
                                order or None,
                            )
                        )
                yield pd.DataFrame(rows, columns=[f.split()[0] for f in STATS_DDL.split(", ")])

    return list_files(spark, paths).select("path").mapInPandas(read, STATS_DDL)


SCHEMA_DDL = (
    "path string, position int, column string, physical_type string, logical_type string, "
    "metadata map<string,string>"
)


def file_schemas(spark: SparkSession, paths: str | Sequence[str]) -> DataFrame:
    """One row per file and column, with the file's key-value metadata."""

    def read(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for path in batch["path"]:
                meta = _open(path).metadata
                pairs = {k.decode("utf-8", "replace"): v.decode("utf-8", "replace") for k, v in (meta.metadata or {}).items()}
                rows = [
                    (path, i, meta.schema.column(i).path, meta.schema.column(i).physical_type, str(meta.schema.column(i).logical_type), pairs)
                    for i in range(meta.num_columns)
                ]
                yield pd.DataFrame(
                    rows, columns=["path", "position", "column", "physical_type", "logical_type", "metadata"]
                )

    return list_files(spark, paths).select("path").mapInPandas(read, SCHEMA_DDL)


GROUPS_DDL = "path string, row_group int, rows bigint, bytes bigint"


def row_groups(spark: SparkSession, paths: str | Sequence[str]) -> DataFrame:
    """(path, row_group, rows, bytes) of every row group; a file without rows has none."""

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for path in batch["path"].to_pylist():
                meta = _open(path).metadata
                groups = [meta.row_group(g) for g in range(meta.num_row_groups)]
                columns = [
                    pa.array([path] * len(groups), pa.string()),
                    pa.array(range(len(groups)), pa.int32()),
                    pa.array([g.num_rows for g in groups], pa.int64()),
                    pa.array([g.total_byte_size for g in groups], pa.int64()),
                ]
                yield pa.RecordBatch.from_arrays(columns, names=[f.split()[0] for f in GROUPS_DDL.split(", ")])

    return list_files(spark, paths).select("path").mapInArrow(read, GROUPS_DDL)


def file_rows(groups: DataFrame) -> DataFrame:
    """Per file: rows, row groups, rows of its first and largest row group."""
    return groups.groupBy("path").agg(
        F.sum("rows").alias("rows"),
        F.count(F.lit(1)).alias("row_groups"),
        F.min_by("rows", "row_group").alias("first_group_rows"),
        F.max("rows").alias("largest_group_rows"),
    )


def bin_files(spark: SparkSession, path: str, key: str = "hashbin") -> DataFrame:
    """Per bin folder: files, rows, row groups and megabytes on disk."""
    name = F.regexp_extract("path", f"{key}=([^/]*)/", 1)
    sizes = list_files(spark, path).groupBy(name.alias(key)).agg(
        F.count(F.lit(1)).alias("files"), (F.sum("length") / 1048576).alias("size_mb")
    )
    counted = row_groups(spark, path).groupBy(name.alias(key)).agg(
        F.sum("rows").alias("rows"), F.count(F.lit(1)).alias("row_groups")
    )
    return sizes.join(counted, key)
