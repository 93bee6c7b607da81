import json

import pyarrow.parquet as pq
import pytest
from pyspark.sql import functions as F

from granulake.functions import geohash, shapes
from granulake.functions.geometry_batch import encode_wkb
from granulake.operators import layout
from granulake.sinks import tables as sinks
from granulake.sources import footers, hits, tables
from granulake.streaming import streams


def boxes(spark, count=2000):
    x = (F.col("id") * 7919 % 35000).cast("double") / 100 - 180
    y = (F.col("id") * 104729 % 17000).cast("double") / 100 - 90
    df = spark.range(count).select(F.format_string("G%06d", "id").alias("GranuleUR"), x.alias("MBRWest"), y.alias("MBRSouth"))
    return df.withColumns({"MBREast": F.col("MBRWest") + 1, "MBRNorth": F.col("MBRSouth") + 1})


def test_row_groups_have_the_asked_size(spark, tmp_path):
    path = str(tmp_path / "groups")
    sinks.write_row_groups(boxes(spark).coalesce(1), path, rows=300)
    sizes = [r.rows for r in footers.row_groups(spark, path).orderBy("row_group").collect()]
    assert sizes == [300] * 6 + [200]


def test_files_without_rows_have_no_row_groups(spark, tmp_path):
    path = str(tmp_path / "groups")
    # the first task has no rows and still writes a file
    sinks.write_row_groups(boxes(spark).where("GranuleUR >= 'G001000'"), path, rows=300)
    assert min(pq.ParquetFile(f).num_row_groups for f in (tmp_path / "groups").glob("*.parquet")) == 0
    groups = footers.row_groups(spark, path)
    assert groups.agg(F.sum("rows")).first()[0] == 1000 and groups.where("rows > 300 or rows = 0").count() == 0
    assert footers.column_stats(spark, path).where("column = 'GranuleUR'").agg(F.sum("rows")).first()[0] == 1000


def test_sized_by_bytes_of_files_without_rows(spark, tmp_path):
    whole, path = str(tmp_path / "whole"), str(tmp_path / "sized")
    sinks.write_row_groups(boxes(spark).where("GranuleUR >= 'G001000'"), whole, groups=8)
    per_row = sinks.row_bytes(footers.row_groups(spark, whole))
    sinks.write_sized(spark.read.parquet(whole), path, file_bytes=2000, row_bytes=per_row)
    files = footers.file_rows(footers.row_groups(spark, path))
    assert files.agg(F.sum("rows")).first()[0] == 1000 and files.where(F.col("rows") > 2000 / per_row).count() == 0


def test_hot_bin_is_split_over_files(spark, tmp_path):
    df = boxes(spark).withColumn("hashbin", F.when(F.rand(1) < 0.4, "7").otherwise(F.substring("GranuleUR", 7, 1)))
    path = str(tmp_path / "bins")
    sinks.write_bins(df, path, file_rows=100)
    stats = footers.bin_files(spark, path).collect()
    assert sum(r.rows for r in stats) == 2000 and max(r.rows / r.files for r in stats) <= 100
    back = sinks.read_bins(spark, path, df.schema)
    assert dict(back.dtypes)["hashbin"] == "string" and back.count() == 2000


def test_bucket_tree_appends(spark, tmp_path):
    path = str(tmp_path / "tree")
    rows = geohash.with_box_bins(boxes(spark, 60), mode="nested", depth=2, name="path")
    for _ in range(2):
        sinks.write_bucket_tree(rows, path, depth=2)
    assert spark.read.parquet(path).count() == 120


def test_geo_footer(spark, tmp_path):
    path = str(tmp_path / "geo")
    df = boxes(spark, 100).repartition(3).withColumn("kind", F.lit("Polygon"))
    rings = shapes.box_rings(*[F.col(c) for c in layout.BOX])
    written = sinks.write_geo(sinks.with_covering_box(df.withColumn("geometry", encode_wkb(F.col("kind"), rings))), path)
    assert written.agg(F.sum("rows")).first()[0] == 100
    for row in written.collect():
        geo = json.loads(pq.ParquetFile(row.path).schema_arrow.metadata[b"geo"])
        assert geo["version"] == "1.1.0" and geo["columns"]["geometry"]["covering"]["bbox"]["xmin"] == ["bbox", "xmin"]


def test_curve_order_keeps_neighbours_together(spark):
    placed = layout.spatial_shuffle(boxes(spark), 8, tie=["GranuleUR"])
    area = F.expr("(xmax - xmin) * (ymax - ymin)")
    ordered = layout.partition_extents(placed).agg(F.avg(area)).first()[0]
    scattered = layout.partition_extents(boxes(spark).repartition(8)).agg(F.avg(area)).first()[0]
    assert ordered < scattered / 2


def test_recursive_globs_and_missing_columns(spark, tmp_path):
    spark.range(3).write.parquet(str(tmp_path / "a" / "b"))
    spark.range(2).withColumn("more", F.lit("x")).write.parquet(str(tmp_path / "a" / "c"))
    assert tables.read_parquet(spark, f"{tmp_path}/**/*.parquet").count() == 5
    both = tables.read_union(spark, [f"{tmp_path}/a/b", f"{tmp_path}/a/c"])
    assert both.where("more is null").count() == 3


def test_time_folders(spark):
    rows = [("2024-01-01", "2024-03-01", "2024"), ("2024-01-03", "2024-01-20", "2024/01"), ("2024-12-30", "2024-12-31", "2024/12/week_01")]
    df = spark.createDataFrame(rows, "a string, b string, want string")
    path = sinks.time_path(F.to_timestamp_ntz("a"), F.to_timestamp_ntz("b"))
    assert all(r.want == r.got for r in df.select("want", path.alias("got")).collect())


@pytest.mark.parametrize(
    "ords,info,kinds",
    [
        ([0, 0, 10000000, 0, 10000000, 10000000], [1, 6], ["Polygon"]),
        ([0, 0, 10000000, 20000000], [3, 4], ["Rectangle"]),
        ([0, 0, 1, 1, 2, 2], [4, 2, 5, 4], ["Point", "LineString"]),
        ([0, 0, 1, 1], [1, 4], []),
        ([0, 0, 1], [5, 3], []),
        ([0, 0], [9, 2], []),
        ([0, 0], [4], []),
        ([0, 0, 1, 1], [4, 4], []),
    ],
)
def test_shape_codes(spark, ords, info, kinds):
    df = spark.createDataFrame([(ords, info)], "o array<bigint>, i array<int>")
    found = df.select(hits.decode_ords(F.col("o"), F.col("i")).alias("s")).first().s
    assert [s.kind for s in found] == kinds
    if kinds == ["Polygon"]:
        assert found[0].xs == [0.0, 1.0, 1.0, 0.0]
    if kinds == ["Rectangle"]:
        assert found[0].ys == [0.0, 2.0, 2.0, 0.0, 0.0]


def _stream(spark, path, *batches):
    for i, rows in enumerate(batches):
        spark.createDataFrame([(r,) for r in rows], "StartTime string").coalesce(1).write.mode("append").parquet(f"{path}/in")
        frames = spark.readStream.schema("StartTime string").parquet(f"{path}/in")
        streams.daily_counts(frames, "StartTime", f"{path}/out", f"{path}/state", late="1 day").awaitTermination()
    return {str(r.start)[:10]: r.n for r in streams.newest_states(spark, f"{path}/out").collect()}


def test_late_rows_are_dropped_and_restarts_continue(spark, tmp_path):
    got = _stream(
        spark, str(tmp_path), ["2024-01-01T01:00:00", "2024-01-10T00:00:00"], ["2024-01-10T05:00:00", "2024-01-01T02:00:00"], ["2024-01-11T00:00:00"]
    )
    assert got == {"2024-01-01": 1, "2024-01-10": 2, "2024-01-11": 1}


def test_dedup_over_batches(spark, tmp_path):
    path = str(tmp_path)
    for _ in range(2):
        spark.createDataFrame([("a", "2024-01-01T00:00:00"), ("b", "2024-01-01T00:00:00"), ("a", "2024-01-01T00:00:00")], "GranuleUR string, StartTime string").write.mode("append").parquet(f"{path}/in")
        frames = spark.readStream.schema("GranuleUR string, StartTime string").parquet(f"{path}/in")
        streams.dedup_granules(frames, "GranuleUR", "StartTime", f"{path}/out", f"{path}/state").awaitTermination()
    assert sorted(r.GranuleUR for r in spark.read.parquet(f"{path}/out").collect()) == ["a", "b"]


def test_largest_shapes_across_batches(spark, tmp_path):
    path = str(tmp_path)
    rows = [("a", 1, 5.0, "2024-01-01T00:00:00"), ("b", 1, None, "2024-01-01T00:00:00"), ("a", 2, 9.0, "2024-01-02T00:00:00"),
            ("a", 3, 9.0, "2024-01-03T00:00:00"), ("c", 7, 1.0, "2024-06-01T00:00:00"), ("a", 4, 2.0, "2024-06-02T00:00:00"),
            ("c", 8, 50.0, "2024-01-01T00:00:00")]
    df = spark.createDataFrame([(*r, i) for i, r in enumerate(rows)], "g string, no bigint, area double, at string, i int")
    frames = streams.replay(spark, df, F.col("i"), len(rows), f"{path}/in")
    streams.largest_shapes(frames, "g", "at", "area", "no", f"{path}/out", f"{path}/state", keep="10 days").awaitTermination()
    got = {r.g: (r.no, r.area) for r in streams.largest_of(spark, f"{path}/out", "g", "area", "no").collect()}
    assert got == {"a": (2, 9.0), "b": (1, None), "c": (7, 1.0)}  # the last shape came after its period was over
