"""Searches: projections, predicates on time, box, shape and attributes, and whole specifications."""

from __future__ import annotations

from functools import lru_cache

import numpy as np
from pyspark.sql import functions as F

from granulake.functions import geometry_batch as gb
from granulake.functions import shapes
from granulake.operators import joins, search
from granulake.plans import inputs
from granulake.plans.inputs import (
    INTERIOR_BOX,
    QUERY_BOX,
    QUERY_MULTIPOLYGON,
    QUERY_POLYGON,
    QUERY_RING,
    SECOND_RING,
    SINCE,
    box_meets_edges_sql,
    edges_sql,
    point_in_edges_sql,
    using,
)
from granulake.plans.registry import query
from granulake.session import scratch
from granulake.sinks import tables as sinks
from granulake.sources import zones
from granulake.sources.spec import Operation, Predicate, Search

BOX_SQL = "(MBREast >= -30 and MBRWest <= 60 and MBRNorth >= -35 and MBRSouth <= 45)"


@lru_cache
def shape_wkb(*rings) -> bytes:
    points = [(i, False, np.array(ring, dtype=float)) for i, ring in enumerate(rings)]
    return gb.write_wkb("Polygon" if len(rings) == 1 else "MultiPolygon", points)


HOLE_RING = ((0, -5), (20, -5), (20, 12), (0, 12), (0, -5))
HOLED_SHAPE = gb.write_wkb(
    "MultiPolygon",
    [(part, hole, np.array(r, dtype=float)) for part, hole, r in ((0, False, QUERY_RING), (0, True, HOLE_RING), (1, False, SECOND_RING))],
)


@query("project_columns", using("granules") + "select GranuleUR, StartTime, MBRWest from granules")
def project_columns(spark, sf_dir):
    return inputs.granules(spark, sf_dir).select("GranuleUR", "StartTime", "MBRWest")


@query(
    "computed_column",
    using("granules") + f"select GranuleUR, StartTime, {BOX_SQL} as found from granules where StartTime > '1998-01-01'",
)
def computed_column(spark, sf_dir):
    g = inputs.granules(spark, sf_dir).withColumn("found", search.box_columns(QUERY_BOX))
    return g.where(F.col("StartTime") > "1998-01-01").select("GranuleUR", "StartTime", "found")


@query("filter_time_ge", using("granules") + f"select GranuleUR from granules where StartTime >= '{SINCE}'")
def filter_time_ge(spark, sf_dir):
    return inputs.granules(spark, sf_dir).where(search.time_at_least(SINCE)).select("GranuleUR")


@query("filter_time_le", using("granules") + f"select GranuleUR from granules where StartTime <= '{SINCE}'")
def filter_time_le(spark, sf_dir):
    return inputs.granules(spark, sf_dir).where(search.time_at_most(SINCE)).select("GranuleUR")


_RANGE = "1998-05-01T00:00:00/1998-05-12T00:00:00"


@query(
    "filter_time_range",
    using("granules")
    + "select GranuleUR from granules where StartTime <= '1998-05-01T00:00:00' and '1998-05-12T00:00:00' <= EndTime",
)
def filter_time_range(spark, sf_dir):
    """The granule's time span covers the range."""
    return inputs.granules(spark, sf_dir).where(search.time_range(_RANGE)).select("GranuleUR")


@query(
    "filter_time_range_overlaps",
    using("granules")
    + "select GranuleUR from granules where EndTime >= '1998-05-01T00:00:00' and StartTime <= '1998-05-12T00:00:00'",
)
def filter_time_range_overlaps(spark, sf_dir):
    return inputs.granules(spark, sf_dir).where(search.time_range(_RANGE, "overlaps")).select("GranuleUR")


@query(
    "filter_time_between",
    using("granules") + "select GranuleUR from granules where StartTime > '1996-01-01' and StartTime < '1997-01-01'",
)
def filter_time_between(spark, sf_dir):
    return inputs.granules(spark, sf_dir).where(search.time_between("1996-01-01", "1997-01-01")).select("GranuleUR")


@query("filter_bbox_struct", using("granules") + f"select GranuleUR from granules where {BOX_SQL}")
def filter_bbox_struct(spark, sf_dir):
    """Box test on the struct column of a written table."""
    path = scratch(spark, "boxed")
    sinks.write_covering_box(inputs.granules(spark, sf_dir).select("GranuleUR", *search.BOX), path)
    return spark.read.parquet(path).where(search.box_struct(*QUERY_BOX)).select("GranuleUR")


@query("filter_bbox_mbr", using("granules") + f"select GranuleUR from granules where {BOX_SQL}")
def filter_bbox_mbr(spark, sf_dir):
    return inputs.granules(spark, sf_dir).where(search.box_columns(QUERY_BOX)).select("GranuleUR")


_EXACT = f"""select GranuleUR from granules, edges where {BOX_SQL}
  group by GranuleUR, MBRWest, MBRSouth, MBREast, MBRNorth having {box_meets_edges_sql()}"""


@query(
    "filter_lir_or_exact",
    using("granules", edges=edges_sql(QUERY_RING))
    + f"""select GranuleUR from ({_EXACT}) e union
          select GranuleUR from granules where LREast >= -10 and LRWest <= 30 and LRNorth >= -10 and LRSouth <= 15""",
)
def filter_lir_or_exact(spark, sf_dir):
    """Interior rectangles accept; only undecided rows take the exact test."""
    boxes = inputs.granule_boxes(spark, sf_dir)
    return search.interior_or_exact(boxes, shape_wkb(QUERY_RING), INTERIOR_BOX).select("GranuleUR")


@query("st_intersects", using("granules", edges=edges_sql(QUERY_RING)) + _EXACT)
def st_intersects(spark, sf_dir):
    boxes = inputs.granule_boxes(spark, sf_dir)
    return search.intersects(boxes, shape_wkb(QUERY_RING)).select("GranuleUR")


@query(
    "st_intersects_holes",
    using("granules", edges=edges_sql(QUERY_RING, HOLE_RING, SECOND_RING))
    + f"""select GranuleUR, MBRWest, MBRNorth from granules, edges
          group by GranuleUR, MBRWest, MBRSouth, MBREast, MBRNorth having {box_meets_edges_sql()}""",
)
def st_intersects_holes(spark, sf_dir):
    """A two-part shape whose first part has a hole."""
    boxes = inputs.granule_boxes(spark, sf_dir)
    return search.intersects(boxes, HOLED_SHAPE).select("GranuleUR", "MBRWest", "MBRNorth")


_MEETS = f"""select GranuleUR, {box_meets_edges_sql()} as meets
  from granules, edges where MBREast >= -30 and MBRWest <= 120 and MBRNorth >= -35 and MBRSouth <= 45
  group by GranuleUR, MBRWest, MBRSouth, MBREast, MBRNorth"""


@query(
    "raster_decides",
    using("granules", edges=edges_sql(QUERY_RING, HOLE_RING, SECOND_RING))
    + f"select meets, count(*) as rows, 0::bigint as wrong from ({_MEETS}) g group by meets",
)
def raster_decides(spark, sf_dir):
    """Granules near the shape by the exact result, with the number that the raster decided otherwise (none)."""
    boxes = inputs.granule_boxes(spark, sf_dir)
    marked = search.raster_marks(boxes, HOLED_SHAPE)
    meets = gb.st_intersects(F.col("geometry"), HOLED_SHAPE)
    tested = marked.select("mark", meets.alias("meets"))
    wrong = (F.col("mark") == "inside") & ~F.col("meets") | (F.col("mark") == "outside") & F.col("meets")
    return tested.groupBy("meets").agg(F.count("*").alias("rows"), F.count_if(wrong).alias("wrong"))


@query(
    "st_intersects_points",
    using("points", edges=edges_sql(QUERY_RING, SECOND_RING))
    + f"select id from points, edges group by id, lon, lat having {point_in_edges_sql()}",
)
def st_intersects_points(spark, sf_dir):
    """Points in a two-part shape."""
    p = inputs.points(spark, sf_dir)
    rings = shapes.point_rings(F.col("lon"), F.col("lat"))
    p = p.withColumn("geometry", F.struct(F.lit("Point").alias("kind"), rings.alias("rings")))
    return search.intersects(p, shape_wkb(QUERY_RING, SECOND_RING), columns=("lon", "lat", "lon", "lat")).select("id")


@query(
    "st_contains",
    using("granules")
    + "select GranuleUR from granules where MBRWest < 12.5 and MBREast > 12.5 and MBRSouth < -3.25 and MBRNorth > -3.25",
)
def st_contains(spark, sf_dir):
    """Granules that hold a point; a point on their edge does not count."""
    point = gb.write_wkb("Point", [(0, False, np.array([[12.5, -3.25]]))])
    return search.contains(inputs.granule_boxes(spark, sf_dir), point).select("GranuleUR")


@query(
    "filter_attribute_raw",
    using("granules") + "select GranuleUR from granules where priority like '1%' and MBRSouth > 20",
)
def filter_attribute_raw(spark, sf_dir):
    step = Predicate("attribute_raw", statement="priority like '1%' and MBRSouth > 20")
    return search.filter_operations(inputs.granules(spark, sf_dir), [Operation(ands=(step,))]).select("GranuleUR")


_AFTER = Predicate("time", option="greater-then", value=SINCE)
_HIGH = Predicate("attribute_raw", statement="MBRSouth > 30")
_URGENT = Predicate("attribute_raw", statement="priority = '1-URGENT'")


@query(
    "and_all",
    using("granules") + f"select GranuleUR from granules where StartTime >= '{SINCE}' and MBRSouth > 30 and priority = '1-URGENT'",
)
def and_all(spark, sf_dir):
    """Predicates of two operations, all joined by AND."""
    operations = [Operation(ands=(_AFTER, _HIGH)), Operation(ands=(_URGENT,))]
    return search.filter_operations(inputs.granules(spark, sf_dir), operations).select("GranuleUR")


@query(
    "or_any",
    using("granules") + f"select GranuleUR from granules where StartTime >= '{SINCE}' and (MBRSouth > 30 or priority = '1-URGENT')",
)
def or_any(spark, sf_dir):
    operations = [Operation(ands=(_AFTER,), ors=(_HIGH, _URGENT))]
    return search.filter_operations(inputs.granules(spark, sf_dir), operations).select("GranuleUR")


@query(
    "not_any",
    using("granules") + f"select GranuleUR from granules where StartTime >= '{SINCE}' and not MBRSouth > 30 and priority <> '1-URGENT'",
)
def not_any(spark, sf_dir):
    operations = [Operation(ands=(_AFTER,), nots=(_HIGH, _URGENT))]
    return search.filter_operations(inputs.granules(spark, sf_dir), operations).select("GranuleUR")


@query(
    "raw_query",
    using("granules") + "select CollectionConceptId, count(*) as n from granules where MBRNorth > 0 group by 1",
)
def raw_query(spark, sf_dir):
    statement = "SELECT CollectionConceptId, count(*) AS n FROM {data} WHERE MBRNorth > 0 GROUP BY CollectionConceptId"
    return search.raw(spark, statement, inputs.granules(spark, sf_dir))


@query(
    "search",
    using("granules") + f"select GranuleUR from granules where {BOX_SQL} and StartTime >= '{SINCE}' order by GranuleUR limit 2000",
)
def search_box_time(spark, sf_dir):
    """The benchmark search: box and time, first 2000 ids in order."""
    xmin, ymin, xmax, ymax = QUERY_BOX
    near = Predicate(
        "attribute_raw",
        statement=f"{xmin} <= MBREast and {xmax} >= MBRWest and {ymin} <= MBRNorth and {ymax} >= MBRSouth",
    )
    spec = Search(name="box-time", columns=("GranuleUR",), sortby="GranuleUR", operations=(Operation(ands=(near, _AFTER)),))
    return search.search(inputs.granules(spark, sf_dir), spec)


@query(
    "search_shape",
    using("granules", edges=edges_sql(QUERY_RING, SECOND_RING))
    + f"""select GranuleUR, StartTime from granules, edges where StartTime >= '{SINCE}'
          and MBREast >= -30 and MBRWest <= 120 and MBRNorth >= -35 and MBRSouth <= 45
          group by GranuleUR, StartTime, MBRWest, MBRSouth, MBREast, MBRNorth having {box_meets_edges_sql()}
          order by GranuleUR limit 500""",
)
def search_shape(spark, sf_dir):
    """Shape and time from a specification; the box of the shape is derived and tested first."""
    near = Predicate("geometry", option="intersects", value=QUERY_MULTIPOLYGON)
    spec = Search(columns=("GranuleUR", "StartTime"), sortby="GranuleUR", limit=500, operations=(Operation(ands=(near, _AFTER)),))
    return search.search(inputs.granule_boxes(spark, sf_dir), spec)


@query(
    "search_binned",
    using("granules", edges=edges_sql(QUERY_RING))
    + f"""select GranuleUR from granules, edges where year >= 1998 and StartTime >= '{SINCE}' and {BOX_SQL}
          group by GranuleUR, MBRWest, MBRSouth, MBREast, MBRNorth having {box_meets_edges_sql()} order by GranuleUR limit 2000""",
)
def search_binned(spark, sf_dir):
    """The same search on a table laid out by bin and year: folders are pruned before the scan."""
    from granulake.functions import geohash

    path = scratch(spark, "binned")
    binned = geohash.with_box_bins(inputs.granules(spark, sf_dir).select("GranuleUR", "StartTime", "year", *search.BOX))
    sinks.write_folders(binned, path, "hashbin", "year")
    ddl = "GranuleUR string, StartTime string, MBRWest double, MBRSouth double, MBREast double, MBRNorth double, hashbin string, year int"
    table = spark.read.schema(ddl).parquet(path)
    rings = shapes.box_rings(*[F.col(c) for c in search.BOX])
    table = table.withColumn("geometry", F.struct(F.lit("Polygon").alias("kind"), rings.alias("rings")))
    near = Predicate("geometry", option="intersects", value=QUERY_POLYGON)
    spec = Search(columns=("GranuleUR",), sortby="GranuleUR", operations=(Operation(ands=(near, _AFTER)),))
    return search.search(table, spec)


# ---- zone maps -----------------------------------------------------------------------------------

ZONED = ("StartTime", "EndTime", *search.BOX)
_NEAR = Predicate("geometry", option="intersects", value=QUERY_POLYGON)
_LATE = Predicate("time", option="greater-then", value="1998-03-01T00:00")


def _banded(spark, sf_dir):
    """Granules in files by bands of latitude and years, neither known to the reader of the files."""
    path = scratch(spark, "banded")
    g = inputs.granules(spark, sf_dir).withColumn("cell", F.expr(CELL_SQL["spark"]))
    g.repartition("cell").write.partitionBy("cell").parquet(path)
    zones.write_zone_map(spark, path, ZONED)
    return path


def _as_geometry(df):
    rings = shapes.box_rings(*[F.col(c) for c in search.BOX])
    return df.withColumn("geometry", F.struct(F.lit("Polygon").alias("kind"), rings.alias("rings")))


# The cell of a granule: a band of ten degrees and a year, boxes of the globe apart.
CELL_SQL = {
    "spark": "case when k % 101 = 0 or k % 97 = 0 then -1 else cast(floor((MBRSouth + 90) / 10) as int) * 100 + year % 100 end",
    "duckdb": "case when k % 101 = 0 or k % 97 = 0 then -1 else cast(floor((MBRSouth + 90) / 10) as int) * 100 + year % 100 end",
}


@query(
    "search_zoned",
    using("granules", edges=edges_sql(QUERY_RING))
    + f"""select GranuleUR, StartTime from granules, edges where StartTime >= '1998-03-01T00:00' and {BOX_SQL}
          group by GranuleUR, StartTime, MBRWest, MBRSouth, MBREast, MBRNorth having {box_meets_edges_sql()}
          order by GranuleUR limit 2000""",
)
def search_zoned(spark, sf_dir):
    """Shape and time over stored granules; a zone map names the files that the scan opens."""
    spec = Search(columns=("GranuleUR", "StartTime"), sortby="GranuleUR", operations=(Operation(ands=(_NEAR, _LATE)),))
    return zones.search_zoned(spark, _banded(spark, sf_dir), spec, prepare=_as_geometry)


@query(
    "zone_choice",
    using("granules")
    + f"""select cell, count(*) as rows, max(StartTime) >= '1998-03-01T00:00' and max(MBREast) >= -30 and min(MBRWest) <= 60
            and max(MBRNorth) >= -35 and min(MBRSouth) <= 45 as opened
          from (select *, {CELL_SQL["duckdb"]} as cell from granules) c group by cell""",
)
def zone_choice(spark, sf_dir):
    """Which files that search opens, and the rows they hold."""
    spec = Search(operations=(Operation(ands=(_NEAR, _LATE)),))
    files = zones.choice(spark, _banded(spark, sf_dir), spec)
    cell = F.regexp_extract("path", "/cell=([^/]*)/", 1).cast("int")
    return files.groupBy(cell.alias("cell")).agg(F.sum("rows").alias("rows"), F.bool_or("opened").alias("opened"))


@query(
    "drop_global_bounds",
    using("granules")
    + """select GranuleUR from granules where not (MBRWest in (-180, -90, 90, 180) and MBREast in (-180, -90, 90, 180)
           and MBRSouth in (-180, -90, 90, 180) and MBRNorth in (-180, -90, 90, 180))""",
)
def drop_global_bounds(spark, sf_dir):
    return search.drop_global(inputs.granules(spark, sf_dir)).select("GranuleUR")


@query(
    "count_global_bounds",
    using("granules") + "select count(*) as n, count(*) filter (where k % 101 <> 0) as others from granules where MBRWest in (-180, -90, 90, 180) and MBREast in (-180, -90, 90, 180) and MBRSouth in (-180, -90, 90, 180) and MBRNorth in (-180, -90, 90, 180)",
)
def count_global_bounds(spark, sf_dir):
    """The dropped rows, counted."""
    rows = inputs.granules(spark, sf_dir).where(search.global_bounds())
    return rows.agg(F.count(F.lit(1)).alias("n"), F.count_if(F.col("k") % 101 != 0).alias("others"))


@query("drop_equal_geometry", using("granules") + "select GranuleUR from granules where k % 101 <> 0")
def drop_equal_geometry(spark, sf_dir):
    """Rows whose WKB is not the whole globe."""
    globe = gb.write_wkb("Polygon", [(0, False, np.array([(-180, -90), (180, -90), (180, 90), (-180, 90), (-180, -90)], dtype=float))])
    return search.drop_equal(inputs.granule_boxes(spark, sf_dir, wkb=True), bytearray(globe)).select("GranuleUR")


@query(
    "clip_window",
    using("points") + "select id, lon, lat from points where lon >= -100 and lon <= -60 and lat >= 20 and lat <= 50",
)
def clip_window(spark, sf_dir):
    window = search.box_columns((-100, 20, -60, 50), ("lon", "lat", "lon", "lat"))
    return inputs.points(spark, sf_dir).where(window).select("id", "lon", "lat")


@query(
    "filter_terms_range",
    using("granules")
    + """select GranuleUR from granules where StartTime >= '1997-01-01T00:00:00' and StartTime < '1998-01-01T00:00:00'
         and CollectionConceptId in (select concat('C', cast(n_nationkey as varchar)) from nation where n_regionkey = 1)""",
)
def filter_terms_range(spark, sf_dir):
    ids = inputs.table(spark, sf_dir, "nation").where("n_regionkey = 1").select(
        F.concat(F.lit("C"), F.col("n_nationkey").cast("string")).alias("CollectionConceptId")
    )
    g = inputs.granules(spark, sf_dir)
    return search.terms_range(g, "StartTime", "1997-01-01T00:00:00", "1998-01-01T00:00:00", ids).select("GranuleUR")


@query("attr_equals_rename", "select c_name as feature_name, c_acctbal from customer where c_mktsegment = 'BUILDING'")
def attr_equals_rename(spark, sf_dir):
    customers = inputs.table(spark, sf_dir, "customer").where(F.col("c_mktsegment") == "BUILDING")
    return customers.select("c_name", "c_acctbal").withColumnRenamed("c_name", "feature_name")


@query("year_partition_filter", using("granules") + "select GranuleUR, year from granules where year >= 1999 order by GranuleUR limit 2000")
def year_partition_filter(spark, sf_dir):
    """A table in year folders; the year test reads only the folders it needs."""
    path = scratch(spark, "years")
    rows = inputs.granules(spark, sf_dir).select("GranuleUR", "year")
    sinks.write_folders(rows, path, "year")
    found = spark.read.schema("GranuleUR string, year int").parquet(path).where(F.col("year") >= 1999)
    return search.sort_limit(found, "GranuleUR").withColumn("year", F.col("year").cast("bigint"))


_SHAPES_SQL = """select concat('S', cast(s_suppkey as varchar)) as feature_name, cast((s_suppkey * 3571) % 33000 as double) / 100 - 180 as xmin,
  cast((s_suppkey * 7907) % 16000 as double) / 100 - 90 as ymin, cast(s_nationkey % 12 + 1 as double) as dx,
  cast(s_suppkey % 9 + 1 as double) as dy from supplier"""


def query_shapes(spark, sf_dir):
    key = F.col("s_suppkey")
    xmin, ymin = ((key * 3571) % 33000).cast("double") / 100 - 180, ((key * 7907) % 16000).cast("double") / 100 - 90
    return inputs.table(spark, sf_dir, "supplier").select(
        F.concat(F.lit("S"), key.cast("string")).alias("feature_name"),
        xmin.alias("xmin"),
        ymin.alias("ymin"),
        (xmin + (F.col("s_nationkey") % 12 + 1).cast("double")).alias("xmax"),
        (ymin + (key % 9 + 1).cast("double")).alias("ymax"),
    )


_PAIRS_SQL = """select feature_name, GranuleUR from granules join shapes
  on MBREast >= xmin and MBRWest <= xmin + dx and MBRNorth >= ymin and MBRSouth <= ymin + dy"""


@query("shape_join_search", using("granules", shapes=_SHAPES_SQL) + _PAIRS_SQL)
def shape_join_search(spark, sf_dir):
    """A table of search boxes against all granules in one grid join."""
    g = inputs.granules(spark, sf_dir).select("GranuleUR", *search.BOX)
    return joins.shape_join(g, query_shapes(spark, sf_dir)).select("feature_name", "GranuleUR")


@query(
    "shape_join_exact",
    using("granules", shapes=_SHAPES_SQL)
    + """select feature_name, GranuleUR from granules join shapes
         on MBREast >= xmin and MBRWest <= xmin + dx and MBRNorth >= ymin and MBRSouth <= ymin + dy
         where greatest(MBRWest - xmin, 0) * dy + greatest(MBRSouth - ymin, 0) * dx <= dx * dy""",
)
def shape_join_exact(spark, sf_dir):
    """Right-angled triangles instead of boxes: the grid join, then the exact pair test."""
    g = inputs.granule_boxes(spark, sf_dir).select("GranuleUR", "geometry", *search.BOX)
    xmin, ymin, xmax, ymax = (F.col(c) for c in ("xmin", "ymin", "xmax", "ymax"))
    rings = shapes.polygon_rings([(xmin, ymin), (xmax, ymin), (xmin, ymax)])
    shape = F.struct(F.lit("Polygon").alias("kind"), rings.alias("rings"))
    boxes = query_shapes(spark, sf_dir).withColumn("shape", shape)
    return joins.shape_join(g, boxes, exact=True).select("feature_name", "GranuleUR")
