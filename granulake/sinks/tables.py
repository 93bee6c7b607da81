"""Writing tables: row groups, covering boxes, bins, bucket trees, sized files, geo footers."""

from __future__ import annotations

import json
import math
from collections.abc import Sequence
from contextlib import contextmanager

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from granulake.functions import shapes
from granulake.operators.layout import BOX, spread_for_write, with_tree_columns
from granulake.session import cut
from granulake.sinks import geo_files
from granulake.sources.footers import file_rows, row_groups


@contextmanager
def _setting(spark, name: str, value: str):
    before = spark.conf.get(name, None)
    spark.conf.set(name, value)
    try:
        yield
    finally:
        spark.conf.unset(name) if before is None else spark.conf.set(name, before)


def write_folders(df: DataFrame, path: str, *keys: str, mode: str = "errorifexists", file_rows: int = 0) -> None:
    """One folder per key value.

    Equal keys meet in one task, heavy keys are split into several by adaptive execution. Small
    shuffle partitions are not merged: that would not save files, only tasks.
    """
    with _setting(df.sparkSession, "spark.sql.adaptive.coalescePartitions.enabled", "false"):
        writer = _writer(spread_for_write(df, *keys), mode)
        if file_rows:
            writer = writer.option("maxRecordsPerFile", file_rows)
        writer.partitionBy(*keys).parquet(path)


def _writer(df: DataFrame, mode: str = "errorifexists"):
    return df.write.mode(mode).option("compression", "snappy")


def write_row_groups(df: DataFrame, path: str, rows: int | None = None, groups: int | None = None) -> None:
    """Snappy Parquet with a fixed number of rows per row group, or `groups` groups over the table."""
    if groups is not None:
        rows = max(1, math.ceil(df.count() / groups))
    _writer(df).option("parquet.block.row.count.limit", str(rows)).parquet(path)


def with_covering_box(df: DataFrame, columns: Sequence[str] | None = BOX, rings: str | None = None) -> DataFrame:
    """Add the `bbox` struct, from four box columns or from rings; an older one is replaced."""
    if rings is not None:
        box = shapes.bbox(F.col(rings))
    else:
        xmin, ymin, xmax, ymax = columns
        box = F.struct(
            F.col(xmin).alias("xmin"), F.col(ymin).alias("ymin"), F.col(xmax).alias("xmax"), F.col(ymax).alias("ymax")
        )
    return df.withColumn("bbox", box)


def write_covering_box(df: DataFrame, path: str, rows: int = 69_390, **options) -> None:
    write_row_groups(with_covering_box(df, **options), path, rows=rows)


def write_bins(df: DataFrame, path: str, key: str = "hashbin", file_rows: int = 0) -> None:
    """One folder per bin in one pass. A heavy bin is written by several tasks."""
    write_folders(df, path, key, file_rows=file_rows)


def read_bins(spark, path: str, schema, key: str = "hashbin") -> DataFrame:
    """Read bins with the bin as text (a folder of digits would be taken for a number)."""
    return spark.read.schema(schema).parquet(path).withColumn(key, F.col(key).cast("string"))


def write_bucket_tree(
    df: DataFrame, path: str, bucket: str = "path", depth: int = 3, file_rows: int = 10_000, mode: str = "append"
) -> None:
    """Nested folders region / g1 / g2 / ..., appended to on every call."""
    levels = [f"g{i + 1}" for i in range(depth)]
    tree = with_tree_columns(df, bucket, depth)
    write_folders(tree, path, "region", *levels, mode=mode, file_rows=file_rows)


def write_sized(
    df: DataFrame,
    path: str,
    file_rows: int = 50_000,
    file_bytes: int | None = None,
    row_bytes: float | None = None,
    keys: Sequence[str] = (),
) -> None:
    """Files cut by rows, or by bytes given the mean stored bytes per row (see `row_bytes`).

    Empty input writes no data rows; the commit protocol publishes whole files only.
    """
    if file_bytes is not None:
        if not row_bytes:
            raise ValueError("cutting by bytes needs the mean bytes per row")
        file_rows = max(1, int(file_bytes / row_bytes))
    if keys:
        write_folders(df, path, *keys, file_rows=file_rows)
    else:
        _writer(df).option("maxRecordsPerFile", file_rows).parquet(path)


def row_bytes(groups: DataFrame) -> float:
    """Mean stored bytes per row from a footer table (`sources.footers.row_groups`)."""
    row = groups.agg(F.sum("bytes").alias("b"), F.sum("rows").alias("r")).first()
    return float(row.b) / row.r if row.r else 0.0


def write_compact(df: DataFrame, path: str, files: int, columns: Sequence[str] | None = None) -> None:
    """Many small files into `files` larger ones, optionally fewer columns."""
    picked = df.select(*columns) if columns else df
    _writer(picked.repartition(files)).parquet(path)


def save_table(df: DataFrame, name: str, order_by: Sequence[str] = (), path: str | None = None) -> DataFrame:
    """Create or replace a stored table, optionally sorted; returns its description."""
    ordered = df.orderBy(*[F.col(c).asc_nulls_last() for c in order_by]) if order_by else df
    writer = ordered.write.mode("overwrite").format("parquet")
    if path is not None:
        writer = writer.option("path", path)
    writer.saveAsTable(name)
    return df.sparkSession.sql(f"DESCRIBE TABLE {name}")


def save_bucketed(df: DataFrame, name: str, key: str, buckets: int, path: str | None = None) -> DataFrame:
    """Create or replace a stored table whose rows lie in `buckets` files or groups of files by `key`, sorted in each.

    Tables with the same key, type and number of buckets join and aggregate by that key without a shuffle. Rows are
    brought together by bucket before they are written, so there is one file a bucket and not one a task and bucket.
    """
    writer = df.repartition(buckets, key).write.mode("overwrite").format("parquet").bucketBy(buckets, key).sortBy(key)
    if path is not None:
        writer = writer.option("path", path)
    writer.saveAsTable(name)
    return df.sparkSession.read.table(name)


def table_name(path: str) -> str:
    """Table name from a file name."""
    stem = path.rstrip("/").rsplit("/", 1)[-1].split(".", 1)[0]
    return "".join(ch if ch.isalnum() else "_" for ch in stem).lower()


def time_path(start: Column, end: Column) -> Column:
    """Folder by time span: year, year/month, or year/month/week."""
    seconds = F.unix_timestamp(end.cast("timestamp")) - F.unix_timestamp(start.cast("timestamp"))
    two = lambda v: F.lpad(v.cast("string"), 2, "0")
    year = F.year(start).cast("string")
    month = F.concat_ws("/", year, two(F.month(start)))
    week = F.concat(month, F.lit("/week_"), two(F.weekofyear(start)))
    day = 86400
    return F.when(seconds > 30 * day, year).when(seconds > 7 * day, month).otherwise(week)


# ---- geo footer ------------------------------------------------------------------------------


#: Longitude and latitude on WGS 84 as PROJJSON.
CRS84 = {
    "$schema": "https://proj.org/schemas/v0.7/projjson.schema.json",
    "type": "GeographicCRS",
    "name": "WGS 84 (CRS84)",
    "datum": {
        "type": "GeodeticReferenceFrame",
        "name": "World Geodetic System 1984",
        "ellipsoid": {"name": "WGS 84", "semi_major_axis": 6378137, "inverse_flattening": 298.257223563},
    },
    "coordinate_system": {
        "subtype": "ellipsoidal",
        "axis": [
            {"name": "Geodetic longitude", "abbreviation": "Lon", "direction": "east", "unit": "degree"},
            {"name": "Geodetic latitude", "abbreviation": "Lat", "direction": "north", "unit": "degree"},
        ],
    },
    "id": {"authority": "OGC", "code": "CRS84"},
}


def geo_metadata(
    primary: str, kinds: Sequence[str], box: Sequence[float] | None, covering: bool = False, crs: dict | None = CRS84
) -> str:
    """The `geo` footer entry, version 1.1.0; `crs` is PROJJSON (None: not known), `box` is left out where there is none."""
    column = {"encoding": "WKB", "geometry_types": sorted(kinds), "crs": crs}
    if box is not None:
        column["bbox"] = [float(v) for v in box]
    if covering:
        column["covering"] = {"bbox": {k: ["bbox", k] for k in ("xmin", "ymin", "xmax", "ymax")}}
    return json.dumps({"version": "1.1.0", "primary_column": primary, "columns": {primary: column}})


def write_geo(
    df: DataFrame,
    path: str,
    kind: str = "kind",
    geometry: str = "geometry",
    box: Sequence[str] = BOX,
    group_rows: int = 100_000,
    crs: dict | None = CRS84,
    mode: str = "append",
) -> DataFrame:
    """Write one Parquet file per partition with the `geo` entry in its footer; returns (path, rows) of the folder's files.

    The entry holds the box of the whole table, so the rows come from a written copy whose box is known before; files
    appear together when the job is committed (`geo_files`).
    """
    spark = df.sparkSession
    xmin, ymin, xmax, ymax = box
    fixed = cut(df, "geo")
    facts = fixed.agg(
        F.min(xmin), F.min(ymin), F.max(xmax), F.max(ymax), F.collect_set(kind)
    ).first()  # one row; kinds are at most six names
    bounds = None if None in facts[:4] else facts[:4]
    entry = geo_metadata(geometry, facts[4], bounds, "bbox" in df.columns, crs)
    spark.dataSource.register(geo_files.GeoFiles)
    out = fixed.drop(kind).write.format(geo_files.SHORT_NAME).mode(mode)
    out.option("geo", entry).option("group_rows", str(group_rows)).save(path)
    return file_rows(row_groups(spark, path)).select("path", "rows")
