"""Sinks: each query writes with the sink and reads back what it wrote."""

from __future__ import annotations

from pyspark.sql import functions as F

from granulake.functions import geohash
from granulake.operators import joins, layout
from granulake.plans import inputs
from granulake.plans.inputs import using
from granulake.plans.registry import query
from granulake.session import scratch
from granulake.sinks import tables as sinks
from granulake.sources import footers, tables


@query("write_parquet_rowgroups", "select count(*) as rows, true as within from orders")
def write_parquet_rowgroups(spark, sf_dir):
    """Row groups of exactly 1000 rows but for the last of each file."""
    path = scratch(spark, "row-groups")
    sinks.write_row_groups(inputs.granules(spark, sf_dir), path, rows=1000)
    totals = footers.file_rows(footers.row_groups(spark, path))
    whole = F.col("rows") == F.least(F.col("rows"), (F.col("row_groups") - 1) * 1000 + 1000)
    fits = (F.col("largest_group_rows") <= 1000) & whole
    return totals.agg(F.sum("rows").alias("rows"), F.bool_and(fits).alias("within"))


@query(
    "write_covering_bbox",
    using("granules") + "select GranuleUR, MBRWest as xmin, MBRSouth as ymin, MBREast as xmax, MBRNorth as ymax from granules",
)
def write_covering_bbox(spark, sf_dir):
    path = scratch(spark, "bbox")
    sinks.write_covering_box(inputs.granules(spark, sf_dir), path)
    return spark.read.parquet(path).select("GranuleUR", "bbox.*")


@query(
    "write_geo_metadata",
    using("granules")
    + """select count(*) as rows, '1.1.0' as version, 'geometry' as primary_column, 'OGC:CRS84' as crs, min(MBRWest) as xmin,
           min(MBRSouth) as ymin, max(MBREast) as xmax, max(MBRNorth) as ymax, true as same from granules""",
)
def write_geo_metadata(spark, sf_dir):
    """Files with the `geo` footer entry; the entry is read back from every footer."""
    path = scratch(spark, "geo")
    boxed = sinks.with_covering_box(inputs.granule_boxes(spark, sf_dir, wkb=True)).withColumn("kind", F.lit("Polygon"))
    sinks.write_geo(boxed, path)
    column = "struct<bbox:array<double>,crs:struct<id:struct<authority:string,code:string>>>"
    entry = f"struct<version:string,primary_column:string,columns:map<string,{column}>>"
    geo = footers.file_schemas(spark, path).groupBy("path").agg(F.first(F.col("metadata")["geo"]).alias("geo"))
    parsed = geo.select(F.from_json("geo", entry).alias("g"), "geo")
    box, crs = F.col("g.columns")["geometry"]["bbox"], F.col("g.columns")["geometry"]["crs"]["id"]
    facts = parsed.agg(
        F.min("g.version").alias("version"),
        F.min("g.primary_column").alias("primary_column"),
        F.min(F.concat_ws(":", crs["authority"], crs["code"])).alias("crs"),
        *[F.min(F.get(box, F.lit(i))).alias(n) for i, n in enumerate(("xmin", "ymin", "xmax", "ymax"))],
        (F.min("geo") == F.max("geo")).alias("same"),
    )
    return facts.withColumn("rows", spark.read.parquet(path).agg(F.count("geometry")).scalar())


def flat_bins(spark, sf_dir):
    return geohash.with_box_bins(inputs.granules(spark, sf_dir), mode="flat").select("GranuleUR", "hashbin")


def corner_sql(lon: str, lat: str, precision: int) -> str:
    return geohash.geohash_sql(lon, lat, precision)


def hemisphere_sql(w: str, s: str, e: str, n: str) -> str:
    return f"""case when {w} < 0 and {e} > 0 and {s} < 0 and {n} > 0 then 'All'
      when {w} < 0 and {e} > 0 and {s} < 0 then 'SW-SE' when {w} < 0 and {e} > 0 and {n} > 0 then 'NE-NW'
      when {w} < 0 and {s} < 0 and {n} > 0 then 'SW-NW' when {e} > 0 and {s} < 0 and {n} > 0 then 'SE-NE'
      when {w} < 0 and {s} < 0 then 'SW' when {w} < 0 and {n} > 0 then 'NW'
      when {e} > 0 and {s} < 0 then 'SE' when {e} > 0 and {n} > 0 then 'NE' else 'Central' end"""


def corners_sql(precision: int, columns: str = "GranuleUR") -> str:
    return (
        f"select {columns}, {corner_sql('MBRWest', 'MBRSouth', precision)} as hash1, "
        f"{corner_sql('MBREast', 'MBRNorth', precision)} as hash2 from granules"
    )


def _decoded_sql(precision: int, columns: str = "GranuleUR") -> str:
    alon, alat = geohash.decode_sql("hash1", precision)
    blon, blat = geohash.decode_sql("hash2", precision)
    return f"select *, {alon} as a_lon, {alat} as a_lat, {blon} as b_lon, {blat} as b_lat from ({corners_sql(precision, columns)}) c"


def flat_bins_sql(columns: str = "GranuleUR") -> str:
    hemisphere = hemisphere_sql("a_lon", "a_lat", "b_lon", "b_lat")
    return f"select {columns}, hash1, hash2, case when hash1 = hash2 then hash1 else {hemisphere} end as hashbin from ({_decoded_sql(1, columns)}) d"


def nested_bins_sql(columns: str = "GranuleUR", depth: int = 3) -> str:
    cell = lambda n: "concat_ws('/', " + ", ".join(f"substr(hash1, {i}, 1)" for i in range(1, n + 1)) + ")"
    whens = " ".join(f"when substr(hash1, 1, {n}) = substr(hash2, 1, {n}) then {cell(n)}" for n in range(depth, 0, -1))
    return f"""select {columns}, hash1, hash2, case {whens}
      else {hemisphere_sql('a_lon', 'a_lat', 'b_lon', 'b_lat')} end as path from ({_decoded_sql(depth, columns)}) d"""


@query(
    "write_bins",
    using("granules", bins=flat_bins_sql()) + "select g.GranuleUR, StartTime, hashbin from granules g join bins using (GranuleUR)",
)
def write_bins(spark, sf_dir):
    """Granules joined to their bins, one folder per bin in one pass."""
    path = scratch(spark, "bins")
    granules = inputs.granules(spark, sf_dir).select("GranuleUR", "StartTime")
    sinks.write_bins(joins.join_bins(granules, flat_bins(spark, sf_dir)), path)
    return sinks.read_bins(spark, path, "GranuleUR string, StartTime string, hashbin string")


@query(
    "bin_file_stats",
    using("granules", bins=flat_bins_sql()) + "select hashbin, count(*) as rows, true as has_files from bins group by 1",
)
def bin_file_stats(spark, sf_dir):
    path = scratch(spark, "bin-files")
    sinks.write_bins(flat_bins(spark, sf_dir), path)
    stats = footers.bin_files(spark, path)
    sane = (F.col("files") > 0) & (F.col("row_groups") >= F.col("files")) & (F.col("size_mb") > 0)
    return stats.select("hashbin", "rows", sane.alias("has_files"))


BOX = ("MBRWest", "MBRSouth", "MBREast", "MBRNorth")


def nested_bins(spark, sf_dir, *columns, depth: int = 3):
    hashed = geohash.with_corner_hashes(inputs.granules(spark, sf_dir), BOX, depth)
    return geohash.with_nested_path(hashed, depth).select("GranuleUR", *columns, "hash1", "hash2", "path")


TREE_DDL = "GranuleUR string, MBRWest double, MBRSouth double, MBREast double, MBRNorth double, path string, region string, g1 string, g2 string"


def bucket_tree(spark, sf_dir, appends: int = 1):
    """A bucket tree of the granules, two cells deep, written in one or more appends; read back."""
    path = scratch(spark, "tree")
    rows = nested_bins(spark, sf_dir, *BOX, depth=2).drop("hash1", "hash2")
    for part in range(appends):
        mine = rows.where(F.pmod(F.xxhash64("GranuleUR"), F.lit(appends)) == part)
        sinks.write_bucket_tree(mine, path, depth=2)
    return spark.read.schema(TREE_DDL).parquet(path)


@query(
    "write_bucket_tree",
    using("granules", bins=nested_bins_sql(depth=2))
    + """select GranuleUR, case when length(path) > 1 and path not like '%/%' then path else '-' end as region,
           case when path like '%/%' or length(path) = 1 then split_part(path, '/', 1) else '-' end as g1,
           case when path like '%/%' then split_part(path, '/', 2) else '-' end as g2 from bins""",
)
def write_bucket_tree(spark, sf_dir):
    """Nested folders, appended to twice."""
    return bucket_tree(spark, sf_dir, appends=2).select("GranuleUR", "region", "g1", "g2")


@query(
    "curve_cell_lookup",
    using("granules")
    + "select GranuleUR from granules where MBREast >= 10 and MBRWest <= 23.5 and MBRNorth >= 20 and MBRSouth <= 31",
)
def curve_cell_lookup(spark, sf_dir):
    """A search box against the bucket tree: only folders that can hold hits are read."""
    return layout.lookup(bucket_tree(spark, sf_dir), (10.0, 20.0, 23.5, 31.0), depth=2).select("GranuleUR")


_METRES = " ".join(f"when {size} then {metres}e0" for size, metres in geohash.PREFIX_METRES.items())


@query(
    "bucket_info",
    using("granules", bins=nested_bins_sql("GranuleUR, MBRWest, MBRSouth, MBREast, MBRNorth"))
    + f"""select *, concat(hash1, '-', hash2) as hash, case case when hash1 = hash2 then 3
             when substr(hash1, 1, 2) = substr(hash2, 1, 2) then 2 when substr(hash1, 1, 1) = substr(hash2, 1, 1) then 1 else 0 end
             {_METRES} end as distance
          from (select path, count(*) as n, min(MBRWest) as xmin, min(MBRSouth) as ymin, max(MBREast) as xmax, max(MBRNorth) as ymax,
            min_by(hash1, GranuleUR) as hash1, min_by(hash2, GranuleUR) as hash2 from bins group by path) b""",
)
def bucket_info(spark, sf_dir):
    return layout.bucket_info(nested_bins(spark, sf_dir, *BOX), "path", "GranuleUR")


@query("save_table", "select o_orderkey, o_custkey from orders")
def save_table(spark, sf_dir):
    path = scratch(spark, "table")
    name = sinks.table_name(path)
    source = inputs.table(spark, sf_dir, "orders").select("o_orderkey", "o_custkey")
    sinks.save_table(source, name, ["o_custkey", "o_orderkey"], path)
    return tables.read_stored(spark, name)


@query("write_compact", "select count(*) as rows, sum(o_orderkey)::bigint as keys, true as few from orders")
def write_compact(spark, sf_dir):
    """Many small files -> two larger ones with two columns."""
    many, few = scratch(spark, "many"), scratch(spark, "few")
    inputs.granules(spark, sf_dir).repartition(12).write.parquet(many)
    sinks.write_compact(spark.read.parquet(many), few, 2, ["GranuleUR", "k"])
    files = footers.list_files(spark, few).agg(F.count(F.lit(1)) <= 2)
    rows = spark.read.parquet(few).agg(F.count(F.lit(1)).alias("rows"), F.sum("k").alias("keys"))
    return rows.withColumn("few", files.scalar())


@query(
    "write_sized_files",
    using("granules") + "select CollectionConceptId, count(*) as rows, true as within from granules group by 1",
)
def write_sized_files(spark, sf_dir):
    """Files of at most 50 rows per collection."""
    path = scratch(spark, "sized")
    sinks.write_sized(inputs.granules(spark, sf_dir), path, file_rows=50, keys=["CollectionConceptId"])
    totals = footers.file_rows(footers.row_groups(spark, path))
    name = F.regexp_extract("path", "CollectionConceptId=([^/]*)/", 1)
    return totals.groupBy(name.alias("CollectionConceptId")).agg(
        F.sum("rows").alias("rows"), (F.max("rows") <= 50).alias("within")
    )


@query("write_sized_bytes", "select count(*) as rows, true as cut from orders")
def write_sized_bytes(spark, sf_dir):
    """Files cut by bytes, from the stored bytes per row of an earlier write."""
    first, path = scratch(spark, "whole"), scratch(spark, "by-bytes")
    sinks.write_row_groups(inputs.granules(spark, sf_dir), first, groups=8)
    per_row = sinks.row_bytes(footers.row_groups(spark, first))
    sinks.write_sized(spark.read.parquet(first), path, file_bytes=20_000, row_bytes=per_row)
    totals = footers.file_rows(footers.row_groups(spark, path))
    return totals.agg(F.sum("rows").alias("rows"), (F.count(F.lit(1)) > 1).alias("cut"))


@query(
    "time_partition_path",
    using("granules")
    + """select GranuleUR, case when date_diff('second', a, b) > 30 * 86400 then strftime(a, '%Y')
           when date_diff('second', a, b) > 7 * 86400 then strftime(a, '%Y/%m')
           else strftime(a, '%Y/%m') || '/week_' || lpad(cast(weekofyear(a) as varchar), 2, '0') end as folder
         from (select GranuleUR, cast(StartTime as timestamp) as a, cast(EndTime as timestamp) as b from granules) t""",
)
def time_partition_path(spark, sf_dir):
    start, end = (F.to_timestamp_ntz(F.col(c)) for c in ("StartTime", "EndTime"))
    return inputs.granules(spark, sf_dir).select("GranuleUR", sinks.time_path(start, end).alias("folder"))
