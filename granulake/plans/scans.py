"""Sources: Parquet, stored tables, landed documents, log text, id lists and footers."""

from __future__ import annotations

import gzip

import pyarrow as pa
from pyspark.sql import functions as F

from granulake.functions import geometry_batch, shapes, table_functions
from granulake.operators import logs, ordering, search
from granulake.plans import inputs
from granulake.plans.inputs import using
from granulake.plans.registry import query
from granulake.session import scratch
from granulake.sinks import tables as sinks
from granulake.sources import documents, echo10, footers, hits, spec, tables

# ---- tables ----------------------------------------------------------------------------------


@query("scan_parquet", "select o_orderkey, o_orderpriority from orders")
def scan_parquet(spark, sf_dir):
    return tables.read_parquet(spark, f"{sf_dir}/order*.parquet").select("o_orderkey", "o_orderpriority")


@query(
    "scan_union_by_name",
    """select row_number() over (order by kind, key) as id, * from (
         select 'customer' as kind, c_custkey as key, c_name as name, c_mktsegment as segment,
           cast(null as integer) as nation from customer
         union all select 'supplier', s_suppkey, s_name, null, s_nationkey from supplier) u""",
)
def scan_union_by_name(spark, sf_dir):
    path = scratch(spark, "union")
    inputs.table(spark, sf_dir, "customer").select(
        F.lit("customer").alias("kind"),
        F.col("c_custkey").alias("key"),
        F.col("c_name").alias("name"),
        F.col("c_mktsegment").alias("segment"),
    ).write.parquet(f"{path}/customer")
    inputs.table(spark, sf_dir, "supplier").select(
        F.lit("supplier").alias("kind"),
        F.col("s_suppkey").alias("key"),
        F.col("s_name").alias("name"),
        F.col("s_nationkey").alias("nation"),
    ).write.parquet(f"{path}/supplier")
    both = tables.read_union(spark, [f"{path}/customer", f"{path}/supplier"])
    return ordering.row_positions(both, ["kind", "key"], "id")


@query(
    "scan_with_filename",
    """select 'customer' as source_name, count(*) as n from customer
       union all select 'orders', count(*) from orders""",
)
def scan_with_filename(spark, sf_dir):
    parts = []
    for name, key in (("customer", "c_custkey"), ("orders", "o_orderkey")):
        rows = tables.with_file_stem(tables.read_parquet(spark, f"{sf_dir}/{name}.parquet"), sf_dir)
        parts.append(rows.select("source_name", F.col(key).alias("key")))
    return parts[0].unionByName(parts[1]).groupBy("source_name").agg(F.count("key").alias("n"))


@query("scan_table", "select c_custkey, c_name, c_acctbal from customer")
def scan_table(spark, sf_dir):
    path = scratch(spark, "stored")
    name = sinks.table_name(path)
    source = inputs.table(spark, sf_dir, "customer").select("c_custkey", "c_name", "c_acctbal")
    sinks.save_table(source, name, path=path)
    return tables.read_stored(spark, name)


@query(
    "scan_jdbc_granules",
    """select o_orderkey as id, concat('C', cast(o_custkey % 20 as varchar(20))) as collection, o_orderkey % 7 as revision
       from orders where o_orderkey % 10 <> 0 and o_orderpriority <> '5-LOW' and o_custkey % 20 = 3
       order by o_orderkey % 7 desc, o_orderkey limit 200""",
)
def scan_jdbc_granules(spark, sf_dir):
    """The row choice of the JDBC source on a given table: newest revisions first, one page."""
    rows = inputs.table(spark, sf_dir, "orders").select(
        F.col("o_orderkey").alias("id"),
        F.concat(F.lit("C"), (F.col("o_custkey") % 20).cast("string")).alias("collection"),
        F.when(F.col("o_orderkey") % 10 == 0, 1).otherwise(0).alias("deleted"),
        F.when(F.col("o_orderpriority") == "5-LOW", "UMM").otherwise("ECHO10").alias("format"),
        (F.col("o_orderkey") % 7).alias("revision"),
    )
    live = tables.echo10_rows(rows, "C3").select("id", "collection", "revision")
    return ordering.offset_page(live, [F.desc("revision"), "id"], 0, 200)


@query("scan_id_list", "select c_name as id from customer")
def scan_id_list(spark, sf_dir):
    path = scratch(spark, "ids")
    padded = F.when(F.col("c_custkey") % 3 == 0, F.concat(F.lit("  "), F.col("c_name"), F.lit(" "))).otherwise(F.col("c_name"))
    blank = F.when(F.col("c_custkey") % 5 == 0, F.array(padded, F.lit("  "), F.lit(""))).otherwise(F.array(padded))
    inputs.table(spark, sf_dir, "customer").select(F.explode(blank).alias("value")).write.text(path)
    return tables.read_id_list(spark, path)


# ---- documents ---------------------------------------------------------------------------------


@query(
    "scan_geojson",
    using("points")
    + """select concat('point ', cast(id as varchar(20))) as name, 'Point' as kind, lon as x, lat as y from points
         where id % 2 = 0
         union all select concat('box ', cast(id as varchar(20))), 'Polygon', lon + 1, lat + 1 from points where id % 2 = 1""",
)
def scan_geojson(spark, sf_dir):
    """FeatureCollections of at most 100 features each, landed as JSON and read as rows."""
    p = inputs.points(spark, sf_dir)
    lon, lat = F.col("lon"), F.col("lat")
    ring = F.array(*[F.array(lon + dx, lat + dy) for dx, dy in ((0, 0), (1, 0), (1, 1), (0, 0))])
    text = F.when(F.col("id") % 2 == 0, F.to_json(F.array(lon, lat))).otherwise(F.to_json(F.array(ring)))
    is_point = F.col("id") % 2 == 0
    feature = F.concat(
        F.lit('{"type":"Feature","properties":{"name":"'),
        F.when(is_point, "point ").otherwise("box "),
        F.col("id").cast("string"),
        F.lit('"},"geometry":{"type":"'),
        F.when(is_point, "Point").otherwise("Polygon"),
        F.lit('","coordinates":'),
        text,
        F.lit("}}"),
    )
    path = scratch(spark, "geojson")
    # one document per hundred ids, so a document is never large
    p.groupBy(F.floor(F.col("id") / 100)).agg(F.array_join(F.collect_list(feature), ",").alias("all")).select(
        F.concat(F.lit('{"type":"FeatureCollection","features":['), F.col("all"), F.lit("]}")).alias("value")
    ).write.text(path)
    read = documents.read_geojson(spark, path, "name:string")
    return read.select(
        "name", "kind", shapes.xmax(F.col("rings")).alias("x"), shapes.ymax(F.col("rings")).alias("y")
    )


_STAC_PROPERTIES = "datetime:string,start_datetime:string,end_datetime:string,platform:string,cloud_cover:double"


def _stac_items():
    """JSON text of one STAC item per granule; the property keys differ between items."""
    properties = F.when(
        F.col("k") % 2 == 0,
        F.to_json(
            F.struct(
                F.col("StartTime").alias("datetime"),
                F.col("StartTime").alias("start_datetime"),
                F.col("EndTime").alias("end_datetime"),
            )
        ),
    ).otherwise(
        F.to_json(
            F.struct(
                F.col("StartTime").alias("datetime"),
                F.col("CollectionConceptId").alias("platform"),
                (F.col("k") % 100).cast("double").alias("cloud_cover"),
            )
        )
    )
    w, s, e, n = (F.col(c) for c in ("MBRWest", "MBRSouth", "MBREast", "MBRNorth"))
    ring = F.to_json(F.array(F.array(*[F.array(x, y) for x, y in ((w, s), (e, s), (e, n), (w, n), (w, s))])))
    return F.concat(
        F.lit('{"type":"Feature","stac_version":"1.0.0","id":"'),
        F.col("GranuleUR"),
        F.lit('","properties":'),
        properties,
        F.lit(',"geometry":{"type":"Polygon","coordinates":'),
        ring,
        F.lit("}}"),
    )


_STAC_ROWS = """select GranuleUR as id, StartTime as datetime,
    case when k % 2 = 0 then StartTime end as start_datetime, case when k % 2 = 0 then EndTime end as end_datetime,
    case when k % 2 = 1 then CollectionConceptId end as platform,
    case when k % 2 = 1 then cast(k % 100 as double) end as cloud_cover,
    'Polygon' as kind, MBRWest as xmin, MBRNorth as ymax from granules"""


def _stac_columns(df):
    return df.withColumns({"xmin": shapes.xmin(F.col("rings")), "ymax": shapes.ymax(F.col("rings"))}).drop("rings")


@query("scan_stac", using("granules") + _STAC_ROWS)
def scan_stac(spark, sf_dir):
    """Items as NDJSON -> flat rows with every property."""
    path = scratch(spark, "stac")
    inputs.granules(spark, sf_dir).select(_stac_items().alias("value")).write.text(path)
    return _stac_columns(documents.read_stac(spark, path, _STAC_PROPERTIES))


@query(
    "scan_stac_pages",
    using("granules", rows=_STAC_ROWS) + "select * exclude (id) from rows",
)
def scan_stac_pages(spark, sf_dir):
    """Pages of items -> the narrow form: properties and geometry only."""
    path = scratch(spark, "stac-pages")
    items = inputs.granules(spark, sf_dir).select(F.floor(F.col("k") / 100).alias("page"), _stac_items().alias("item"))
    items.groupBy("page").agg(F.array_join(F.collect_list("item"), ",").alias("all")).select(
        F.concat(F.lit('{"type":"FeatureCollection","features":['), F.col("all"), F.lit("]}")).alias("value")
    ).write.text(path)
    return _stac_columns(documents.read_stac(spark, path, _STAC_PROPERTIES, mode="geojson", pages=True))


def landed_hits(spark, sf_dir):
    """Search hits of all shape codes as landed NDJSON, some unusable; returns the folder."""
    path = scratch(spark, "hits")
    g = inputs.granules(spark, sf_dir)
    w, s, e, n = (
        F.round(F.col(c) * 1e7).cast("bigint") for c in ("MBRWest", "MBRSouth", "MBREast", "MBRNorth")
    )
    code = (F.col("k") % 9).cast("int")
    corners = F.array(w, s, e, s, e, n, w, n)
    lists = {
        1: (corners, F.array(F.lit(1), F.lit(8))),
        2: (corners, F.array(F.lit(2), F.lit(8))),
        3: (F.array(w, s, e, n), F.array(F.lit(3), F.lit(4))),
        4: (F.array(w, s), F.array(F.lit(4), F.lit(2))),
        5: (F.array(w, s, e, n), F.array(F.lit(5), F.lit(4))),
        6: (F.array(w, s, e, s, e, n, w, s), F.array(F.lit(6), F.lit(8))),
        7: (F.array(w, s, e, s, w, n), F.array(F.lit(7), F.lit(6))),
        8: (F.array(w, s, e, n, w, n), F.array(F.lit(8), F.lit(6))),
        0: (F.concat(corners, F.array(e, n)), F.array(F.lit(1), F.lit(8), F.lit(4), F.lit(2))),
    }
    ords, info = F.lit(None), F.lit(None)
    for value, (o, i) in lists.items():
        ords, info = F.when(code == value, o).otherwise(ords), F.when(code == value, i).otherwise(info)
    # a polygon of two pairs, and an unknown code, spoil the whole granule
    ords = F.when(F.col("k") % 13 == 0, F.array(w, s, e, n)).otherwise(ords)
    info = F.when(F.col("k") % 13 == 0, F.array(F.lit(1), F.lit(4))).otherwise(info)
    info = F.when(F.col("k") % 37 == 0, F.array(F.lit(9), F.lit(8))).otherwise(info)
    source = F.struct(
        F.col("GranuleUR").alias("granule-ur-lowercase"),
        F.col("StartTime").alias("start-date"),
        F.when(F.col("k") % 17 != 0, F.col("EndTime")).alias("end-date"),
        F.col("CollectionConceptId").alias("collection-concept-id"),
        (F.col("k") % 5).cast("int").alias("revision-id"),
        F.col("MBRWest").alias("mbr-west"),
        F.lit(False).alias("mbr-crosses-antimeridian"),
        F.when(F.col("k") % 53 != 0, ords).alias("ords"),
        F.when(F.col("k") % 59 != 0, info).alias("ords-info"),
    )
    g.select(F.to_json(F.struct(F.lit("1_c").alias("_index"), F.col("GranuleUR").alias("_id"), source.alias("_source"))).alias("value")).write.text(path)
    return path


HIT_ROWS = "k % 53 <> 0 and k % 59 <> 0"
SHAPED_ROWS = f"{HIT_ROWS} and k % 13 <> 0 and k % 37 <> 0"


@query(
    "scan_hits",
    using("granules")
    + f"""select GranuleUR, StartTime, case when k % 17 <> 0 then EndTime end as EndTime, CollectionConceptId,
          cast(k % 5 as integer) as RevisionId, MBRWest, false as MBRCrossesAntimeridian,
          cast(null as varchar) as EntryTitle from granules where {HIT_ROWS}""",
)
def scan_hits(spark, sf_dir):
    return hits.read_hits(spark, landed_hits(spark, sf_dir)).select(
        "GranuleUR", "StartTime", "EndTime", "CollectionConceptId", "RevisionId", "MBRWest", "MBRCrossesAntimeridian", "EntryTitle"
    )


def landed_echo10(spark, sf_dir):
    """ECHO10 granules as gzip blobs in a table; returns the folder.

    By k % 6: point; line and rectangle; open polygon with a centre; two polygons; nothing; all.
    """
    path = scratch(spark, "echo10")
    t = lambda c: F.col(c).cast("string")
    w, s, e, n = t("MBRWest"), t("MBRSouth"), t("MBREast"), t("MBRNorth")
    pt = lambda x, y: F.concat(F.lit("<Point><PointLongitude>"), x, F.lit("</PointLongitude><PointLatitude>"), y, F.lit("</PointLatitude></Point>"))
    point = F.concat(F.lit("<Point><Longitude>"), w, F.lit("</Longitude><Latitude>"), s, F.lit("</Latitude></Point>"))
    line = F.concat(F.lit("<Line>"), pt(w, s), pt(e, n), F.lit("</Line>"))
    box = F.concat(
        F.lit("<BoundingRectangle><WestBoundingCoordinate>"), w, F.lit("</WestBoundingCoordinate><NorthBoundingCoordinate>"), n,
        F.lit("</NorthBoundingCoordinate><EastBoundingCoordinate>"), e, F.lit("</EastBoundingCoordinate><SouthBoundingCoordinate>"), s,
        F.lit("</SouthBoundingCoordinate></BoundingRectangle>"),
    )
    open_ring = F.concat(
        F.lit("<GPolygon><Boundary>"), pt(w, s), pt(e, s), pt(e, n), F.lit("</Boundary><CenterPoint><PointLongitude>"), e,
        F.lit("</PointLongitude><PointLatitude>"), n, F.lit("</PointLatitude></CenterPoint></GPolygon>"),
    )
    closed_ring = F.concat(F.lit("<GPolygon><Boundary>"), pt(w, s), pt(e, s), pt(e, n), pt(w, n), pt(w, s), F.lit("</Boundary></GPolygon>"))
    kind = F.col("k") % 6
    geometry = (
        F.when(kind == 0, point)
        .when(kind == 1, F.concat(line, box))
        .when(kind == 2, open_ring)
        .when(kind == 3, F.concat(closed_ring, open_ring))
        .when(kind == 4, F.lit(""))
        .otherwise(F.concat(point, line, box, open_ring))
    )
    xml = F.concat(
        F.lit("<Granule><GranuleUR>"), F.col("GranuleUR"), F.lit("</GranuleUR><Temporal><RangeDateTime><BeginningDateTime>"),
        F.col("StartTime"), F.lit("</BeginningDateTime><EndingDateTime>"), F.col("EndTime"),
        F.lit("</EndingDateTime></RangeDateTime></Temporal><SpatialExtent><HorizontalSpatialDomain><Geometry>"), geometry,
        F.lit("</Geometry></HorizontalSpatialDomain></SpatialExtent></Granule>"),
    )

    @F.arrow_udf("binary")
    def deflate(v: pa.Array) -> pa.Array:
        return pa.array([gzip.compress(x.encode()) for x in v.to_pylist()], pa.binary())

    rows = inputs.granules(spark, sf_dir).select(
        F.col("GranuleUR").alias("native_id"), F.lit("ECHO10").alias("format"), deflate(xml).alias("metadata")
    )
    rows.write.parquet(path)
    return path


# ---- logs --------------------------------------------------------------------------------------


@query(
    "scan_log_lines",
    using("log_lines")
    + r"""select json_extract_string(j, '$.now') as now, json_extract_string(j, '$.uri') as uri,
            cast(json_extract_string(j, '$.duration') as double) as duration
          from (select regexp_extract(line, '\{.*\}', 0) as j from log_lines where line like '%REPORT%') x
          where json_valid(j)""",
)
def scan_log_lines(spark, sf_dir):
    """Gzip log text with other lines mixed in -> the events that parse."""
    path = scratch(spark, "logs")
    line = F.col("line")
    noisy = F.when(F.col("event_id") % 4 == 0, F.array(line, F.lit("INFO heartbeat {}"), F.lit("REPORT none"))).otherwise(F.array(line))
    inputs.log_lines(spark, sf_dir).select(F.explode(noisy).alias("value")).write.option("compression", "gzip").text(path)
    return logs.with_fields(logs.events(logs.read_lines(spark, path))).select("now", "uri", "duration")


# ---- specifications ------------------------------------------------------------------------------

SUITE_JSON = """{"name": "granule searches", "inputs": ["granules"], "tests": [
  {"name": "box-time-sorted", "sortby": "GranuleUR", "columns": ["GranuleUR"], "operations": [{"ands": [
    {"type_of": "attribute_raw", "statement": "-30.0 <= MBREast and 60.0 >= MBRWest and -35.0 <= MBRNorth and 45.0 >= MBRSouth"},
    {"type_of": "time", "option": "greater-then", "value": "1998-01-01T00:00"}]}],
   "expected": {"action": "greater-then", "value": 10}},
  {"name": "shape-time-sorted", "sortby": "GranuleUR", "columns": ["GranuleUR"], "operations": [{"ands": [
    {"type_of": "geometry", "option": "intersects", "value": "POLYGON ((-30 -35, 60 -35, 60 45, -30 45, -30 -35))"},
    {"type_of": "time", "option": "greater-then", "value": "1998-01-01T00:00"}]}]},
  {"name": "time-sorted", "sortby": "GranuleUR", "columns": ["GranuleUR"], "operations": [{"ands": [
    {"type_of": "time", "option": "greater-then", "value": "1998-01-01T00:00"}]}],
   "expected": {"action": "less-then", "value": 5}},
  {"name": "box-time", "columns": ["GranuleUR"], "operations": [{"ands": [
    {"type_of": "attribute_raw", "statement": "-30.0 <= MBREast and 60.0 >= MBRWest and -35.0 <= MBRNorth and 45.0 >= MBRSouth"}]},
    {"ands": [{"type_of": "time", "option": "greater-then", "value": "1998-01-01T00:00"}]}]},
  {"name": "span", "limit": 50, "sortby": "GranuleUR", "columns": ["GranuleUR"], "operations": [{"ands": [
    {"type_of": "time", "option": "range", "value": "1999-01-01T00:00:00/1999-01-10T00:00:00"}]}]},
  {"name": "time", "columns": ["GranuleUR"], "operations": [{"ands": [
    {"type_of": "time", "option": "less-then", "value": "1997-06-01T00:00"}]}]}
]}"""

_BOX = "(-30.0 <= MBREast and 60.0 >= MBRWest and -35.0 <= MBRNorth and 45.0 >= MBRSouth)"
_SINCE = "StartTime >= '1998-01-01T00:00'"
SUITE_SQL = {
    "box-time-sorted": f"{_BOX} and {_SINCE}",
    "shape-time-sorted": f"{_BOX} and {_SINCE}",
    "time-sorted": _SINCE,
    "box-time": f"{_BOX} and {_SINCE}",
    "span": "StartTime <= '1999-01-01T00:00:00' and '1999-01-10T00:00:00' <= EndTime",
    "time": "StartTime <= '1997-06-01T00:00'",
}
SUITE_COUNTS_SQL = " union all ".join(
    f"select '{name}' as name, count(*) filter (where {test}) as found from granules" for name, test in SUITE_SQL.items()
)


@query("scan_spec", using("granules") + SUITE_COUNTS_SQL)
def scan_spec(spark, sf_dir):
    """A suite read from JSON and checked, then answered over the granules."""
    return search.suite_counts(inputs.granule_boxes(spark, sf_dir), spec.from_json(SUITE_JSON))


# ---- footers -------------------------------------------------------------------------------------


@query(
    "footer_stats",
    """select 'o_orderkey' as column, count(*) as values, count(*) - count(o_orderkey) as nulls,
         min(o_orderkey)::double as min, max(o_orderkey)::double as max from orders
       union all select 'o_custkey', count(*), count(*) - count(o_custkey), min(o_custkey), max(o_custkey) from orders
       union all select 'o_totalprice', count(*), count(*) - count(o_totalprice), min(o_totalprice), max(o_totalprice) from orders""",
)
def footer_stats(spark, sf_dir):
    """Row-group statistics of the numeric columns, put together over all files."""
    stats = footers.column_stats(spark, f"{sf_dir}/orders.parquet")
    numeric = stats.where(F.col("column").isin("o_orderkey", "o_custkey", "o_totalprice"))
    return numeric.groupBy("column").agg(
        F.sum("values").alias("values"),
        F.sum("nulls").alias("nulls"),
        F.min(F.col("min").cast("double")).alias("min"),
        F.max(F.col("max").cast("double")).alias("max"),
    )


@query("footer_schema", "select column_name as column from (describe orders)")
def footer_schema(spark, sf_dir):
    return footers.file_schemas(spark, f"{sf_dir}/orders.parquet").select("column").distinct()


@query(
    "row_group_rows",
    "select 'customer' as name, count(*) as rows from customer union all select 'lineitem', count(*) from lineitem",
)
def row_group_rows(spark, sf_dir):
    groups = footers.row_groups(spark, [f"{sf_dir}/customer.parquet", f"{sf_dir}/lineitem.parquet"])
    totals = footers.file_rows(groups)
    name = F.regexp_extract("path", r"/(customer|lineitem)\.parquet", 1)
    return totals.groupBy(name.alias("name")).agg(F.sum("rows").alias("rows"))


# ---- decoded documents -----------------------------------------------------------------------------

# Per k % 6: the shapes of a landed ECHO10 granule as (shape name, vertices).
_ECHO10_SHAPES = """select * from (values (0, 'Point', 1), (1, 'LineString', 2), (1, 'Polygon', 5), (2, 'Polygon', 4),
  (3, 'Polygon', 5), (3, 'Polygon', 4), (5, 'Point', 1), (5, 'LineString', 2), (5, 'Polygon', 5), (5, 'Polygon', 4)
  ) t(kind6, kind, vertices)"""


@query(
    "echo10_to_shapes",
    using("granules", forms=_ECHO10_SHAPES)
    + """select GranuleUR as GranuleID, StartTime, EndTime, kind, vertices, MBRWest as minx, MBRSouth as miny,
           case when kind = 'Point' then MBRWest else MBREast end as maxx,
           case when kind = 'Point' then MBRSouth else MBRNorth end as maxy
         from granules join forms on k % 6 = kind6""",
)
def echo10_to_shapes(spark, sf_dir):
    rows = echo10.to_shapes(spark.read.parquet(landed_echo10(spark, sf_dir)))
    return shapes.with_bounds(rows).withColumn("vertices", shapes.vertex_count(F.col("rings"))).drop("rings")


@query(
    "xml_to_rows",
    using("granules", forms=_ECHO10_SHAPES)
    + "select GranuleUR as GranuleID, count(*) as shapes from granules join forms on k % 6 = kind6 group by 1",
)
def xml_to_rows(spark, sf_dir):
    """One document -> many rows, written with WKB geometry and counted per document."""
    rows = echo10.with_wkb(echo10.to_shapes(spark.read.parquet(landed_echo10(spark, sf_dir))))
    return rows.where(F.col("geometry").isNotNull()).groupBy("GranuleID").agg(F.count(F.lit(1)).alias("shapes"))


@query(
    "echo10_center",
    using("granules", forms=_ECHO10_SHAPES)
    + """select GranuleUR as GranuleID, kind, vertices,
           case when k % 6 in (2, 3, 5) then MBREast end as center_x, case when k % 6 in (2, 3, 5) then MBRNorth end as center_y,
           case when k % 6 in (1, 5) then MBRWest end as rect_west, case when k % 6 in (1, 5) then MBRNorth end as rect_north
         from granules join forms on k % 6 = kind6 where not (k % 6 in (1, 5) and vertices = 5)""",
)
def echo10_center(spark, sf_dir):
    rows = echo10.to_centers(spark.read.parquet(landed_echo10(spark, sf_dir)))
    return rows.select(
        "GranuleID",
        "kind",
        shapes.vertex_count(F.col("rings")).alias("vertices"),
        "center_x",
        "center_y",
        shapes.xmin(F.col("BoundingRectangle")).alias("rect_west"),
        shapes.ymax(F.col("BoundingRectangle")).alias("rect_north"),
    )


_ORD_SHAPES = """select * from (values (1, 1, 'Polygon', 5), (2, 2, 'Hole', 5), (3, 3, 'Rectangle', 5), (4, 4, 'Point', 1),
  (5, 5, 'LineString', 2), (6, 6, 'Polygon', 4), (7, 7, 'Hole', 4), (8, 8, 'LineString', 3), (0, 1, 'Polygon', 5),
  (0, 4, 'Point', 1)) t(kind9, code, kind, vertices)"""


def _shaped_hits(spark, sf_dir):
    found = hits.read_hits(spark, landed_hits(spark, sf_dir))
    return found.withColumn("shapes", hits.decode_ords(F.col("ords"), F.col("ords_info")))


@query(
    "ords_to_shapes",
    using("granules", forms=_ORD_SHAPES)
    + f"""select GranuleUR, count(code) as shapes, coalesce(sum(vertices), 0)::bigint as vertices from granules
          left join forms on k % 9 = kind9 and k % 13 <> 0 and k % 37 <> 0 where {HIT_ROWS} group by 1""",
)
def ords_to_shapes(spark, sf_dir):
    """Shapes and coordinate counts per hit; an unusable hit has none."""
    count = F.aggregate("shapes", F.lit(0), lambda acc, s: acc + F.size(s["xs"]))
    return _shaped_hits(spark, sf_dir).select(
        "GranuleUR", F.size("shapes").cast("bigint").alias("shapes"), count.cast("bigint").alias("vertices")
    )


@query(
    "explode_shapes",
    using("granules", forms=_ORD_SHAPES)
    + f"""select GranuleUR, StartTime, CollectionConceptId, code, kind, vertices,
            round(case when k % 9 = 0 and code = 4 then MBREast else MBRWest end, 7) as minx,
            round(case when k % 9 = 0 and code = 4 then MBRNorth when code = 4 then MBRSouth else MBRNorth end, 7) as maxy
          from granules join forms on k % 9 = kind9 where {SHAPED_ROWS}""",
)
def explode_shapes(spark, sf_dir):
    rows = hits.explode_shapes(_shaped_hits(spark, sf_dir).select("GranuleUR", "StartTime", "CollectionConceptId", "shapes"))
    return rows.select(
        "GranuleUR",
        "StartTime",
        "CollectionConceptId",
        "shape.code",
        "shape.kind",
        F.size("shape.xs").alias("vertices"),
        F.round(F.array_min("shape.xs"), 7).alias("minx"),
        F.round(F.array_max("shape.ys"), 7).alias("maxy"),
    )


@query(
    "ords_to_rows",
    using("granules", forms=_ORD_SHAPES)
    + f"""select CollectionConceptId, count(*) as rows, count(distinct GranuleUR) as granules
          from granules join forms on k % 9 = kind9 where {SHAPED_ROWS} group by 1""",
)
def ords_to_rows(spark, sf_dir):
    """The whole harvest: hits -> prepared granule table with WKB geometry, counted per collection."""
    harvested = hits.granule_table(hits.read_hits(spark, landed_hits(spark, sf_dir)))
    return harvested.where(F.col("geometry").isNotNull()).groupBy("CollectionConceptId").agg(
        F.count(F.lit(1)).alias("rows"), F.countDistinct("GranuleUR").alias("granules")
    )


# ---- table functions --------------------------------------------------------------------------------


@query(
    "xml_table_function",
    using("granules", forms=_ECHO10_SHAPES)
    + """select kind, count(*) as shapes, count(distinct GranuleUR) as granules, min(StartTime) as first_start,
           sum(vertices)::bigint as vertices from granules join forms on k % 6 = kind6 group by 1""",
)
def xml_table_function(spark, sf_dir):
    """Documents to rows in plain SQL text."""
    table_functions.register(spark)
    rows = spark.sql(
        "select GranuleID, StartTime, kind, geometry from xml_to_rows(table(select metadata from {landed}))",
        landed=spark.read.parquet(landed_echo10(spark, sf_dir)),
    )
    decoded = rows.withColumn("g", geometry_batch.decode_wkb(F.col("geometry")))
    return decoded.groupBy("kind").agg(
        F.count(F.lit(1)).alias("shapes"),
        F.countDistinct("GranuleID").alias("granules"),
        F.min("StartTime").alias("first_start"),
        F.sum(shapes.vertex_count(F.col("g.rings"))).cast("bigint").alias("vertices"),
    )


@query(
    "ords_table_function",
    using("granules", forms=_ORD_SHAPES)
    + f"""select GranuleUR, kind, vertices, round(minx, 7) as minx, round(maxy, 7) as maxy from (
            select GranuleUR, case when kind in ('Hole', 'Rectangle') then 'Polygon' else kind end as kind, vertices,
              case when k % 9 = 0 and code = 4 then MBREast else MBRWest end as minx,
              case when k % 9 = 0 and code = 4 then MBRNorth when code = 4 then MBRSouth else MBRNorth end as maxy
            from granules join forms on k % 9 = kind9 where {SHAPED_ROWS}) t""",
)
def ords_table_function(spark, sf_dir):
    """Coordinate lists to rows in plain SQL text, with vertices and bounds of the geometries."""
    table_functions.register(spark)
    rows = spark.sql(
        "select GranuleUR, kind, geometry from ords_to_rows(table(select GranuleUR, ords, ords_info from {hits}))",
        hits=hits.read_hits(spark, landed_hits(spark, sf_dir)),
    )
    rings = F.col("g.rings")
    return rows.withColumn("g", geometry_batch.decode_wkb(F.col("geometry"))).select(
        "GranuleUR",
        "kind",
        shapes.vertex_count(rings).cast("int").alias("vertices"),
        F.round(shapes.xmin(rings), 7).alias("minx"),
        F.round(shapes.ymax(rings), 7).alias("maxy"),
    )
