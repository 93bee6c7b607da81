"""Parquet, stored and JDBC tables, and lists of ids."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def read_parquet(spark: SparkSession, source: str | Sequence[str], schema=None) -> DataFrame:
    """One file or folder, a list, a glob, or `base/**/pattern` (all levels below base)."""
    reader = spark.read if schema is None else spark.read.schema(schema)
    if not isinstance(source, str):
        return reader.parquet(*source)
    base, deep, pattern = source.partition("/**/")
    if deep:
        return reader.option("recursiveFileLookup", "true").option("pathGlobFilter", pattern).parquet(base)
    return reader.parquet(source)


def read_union(spark: SparkSession, paths: Sequence[str]) -> DataFrame:
    """Files of different columns as one table; a missing column is NULL."""
    return spark.read.option("mergeSchema", "true").parquet(*paths)


def with_file_stem(df: DataFrame, prefix: str, suffix: str = ".parquet", name: str = "source_name") -> DataFrame:
    """Name cut from each row's file path: without the prefix, up to the suffix."""
    path = F.col("_metadata.file_path")
    rest = F.substring_index(path, prefix.rstrip("/") + "/", -1)
    return df.withColumn(name, F.substring_index(rest, suffix, 1))


def read_stored(spark: SparkSession, name: str) -> DataFrame:
    """A stored table by its bare name."""
    return spark.table(name)


def echo10_rows(df: DataFrame, collection: str | None = None) -> DataFrame:
    """Live ECHO10 revisions, of one collection when given."""
    live = df.where((F.col("deleted") == 0) & (F.col("format") == "ECHO10"))
    return live if collection is None else live.where(F.col("collection") == collection)


def read_jdbc_granules(
    spark: SparkSession, url: str, table: str, collection: str, bounds: tuple[int, int], partitions: int, **options
) -> DataFrame:
    """The same rows over JDBC, read in id ranges; the filters are pushed to the database."""
    reader = spark.read.format("jdbc").options(
        url=url,
        dbtable=table,
        partitionColumn="id",
        lowerBound=str(bounds[0]),
        upperBound=str(bounds[1]),
        numPartitions=str(partitions),
        **options,
    )
    return echo10_rows(reader.load(), collection)


def read_id_list(spark: SparkSession, path: str, name: str = "id") -> DataFrame:
    """One id per line; blanks are skipped."""
    return spark.read.text(path).select(F.trim("value").alias(name)).where(F.length(name) > 0)
