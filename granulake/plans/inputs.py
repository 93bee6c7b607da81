"""Search-domain views over the given tables, in Spark and as SQL for the twins.

`granules` and `granule_shapes` have the shape of prepared granule tables, `points` are located
ids, `log_lines` are service log lines. Each view is one SELECT over one given table.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from granulake.functions import shapes
from granulake.functions.geometry_batch import encode_wkb

ISO = {
    "spark": lambda x: f"date_format({x}, \"yyyy-MM-dd'T'HH:mm:ss\")",
    "duckdb": lambda x: f"strftime({x}, '%Y-%m-%dT%H:%M:%S')",
}
DAYS_LATER = {
    "spark": lambda x, n: f"timestampadd(DAY, cast({n} as int), {x})",
    "duckdb": lambda x, n: f"({x} + to_days(cast({n} as integer)))",
}

SOURCE_OF = {"granules": "orders", "granule_shapes": "lineitem", "points": "customer", "log_lines": "events"}


def granules_sql(dialect: str, source: str = "orders") -> str:
    iso, later = ISO[dialect], DAYS_LATER[dialect]
    return f"""
select concat('G', lpad(cast(k as varchar(20)), 10, '0')) as GranuleUR, k,
  concat('C', cast(k % 25 as varchar(20))) as CollectionConceptId,
  {iso('o_orderdate')} as StartTime, {iso(later('o_orderdate', 'k % 40'))} as EndTime,
  year(o_orderdate) as year, o_orderpriority as priority, o_custkey as custkey,
  w as MBRWest, least(w + dx, 180e0) as MBREast, s as MBRSouth, least(s + dy, 90e0) as MBRNorth,
  w + (least(w + dx, 180e0) - w) / 4 as LRWest, w + (least(w + dx, 180e0) - w) * 3 / 4 as LREast,
  s + (least(s + dy, 90e0) - s) / 4 as LRSouth, s + (least(s + dy, 90e0) - s) * 3 / 4 as LRNorth
from (
  select o_orderkey as k, o_orderdate, o_orderpriority, o_custkey,
    case when o_orderkey % 101 = 0 then -180e0 else cast((o_orderkey * 7919) % 35000 as double) / 100 - 180 end as w,
    case when o_orderkey % 101 = 0 then -90e0 else cast((o_orderkey * 104729) % 17000 as double) / 100 - 90 end as s,
    case when o_orderkey % 101 = 0 then 360e0 when o_orderkey % 97 = 0 then 200e0
         when o_orderkey % 11 = 0 then 30e0 else cast((o_orderkey * 31) % 400 + 1 as double) / 100 end as dx,
    case when o_orderkey % 101 = 0 then 180e0 when o_orderkey % 97 = 0 then 100e0
         when o_orderkey % 11 = 0 then 20e0 else cast((o_orderkey * 17) % 300 + 1 as double) / 100 end as dy
  from {source}) b"""


def granule_shapes_sql(dialect: str, source: str = "lineitem") -> str:
    return f"""
select concat('G', lpad(cast(l_orderkey as varchar(20)), 10, '0')) as GranuleUR, l_orderkey as k,
  l_linenumber as shape_no, l_partkey as partkey, l_suppkey as suppkey,
  cast((l_orderkey * 7919) % 35000 as double) / 100 - 180 as w,
  cast((l_orderkey * 104729) % 17000 as double) / 100 - 90 as s,
  l_quantity / 10 as dx, (l_tax * 100 + 1) / 2 as dy,
  round(l_quantity / 10 * ((l_tax * 100 + 1) / 2), 6) as area
from {source}"""


def points_sql(dialect: str, source: str = "customer") -> str:
    return f"""
select c_custkey as id, c_nationkey as nation, cast((c_custkey * 7919) % 36000 as double) / 100 - 180 as lon,
  cast((c_custkey * 104729) % 18000 as double) / 100 - 90 as lat
from {source}"""


def log_lines_sql(dialect: str, source: str = "events") -> str:
    iso = ISO[dialect]
    return f"""
select event_id, concat('2024 INFO REPORT {{"now":"', {iso('ts')}, '","status":',
  case when event_type = 'error' then '400' else '200' end,
  ',"method":"', case when event_id % 5 = 0 then 'POST' else 'GET' end,
  '","request-id":"r-', cast(user_id as varchar(20)), '","uri":"',
  case event_type when 'click' then '/search/granules.json' when 'view' then '/search/collections.umm_json'
    when 'purchase' then '/search/granules/timeline' when 'signup' then '/search/concepts/C1-P.iso19115'
    else '/search/x.php' end,
  '","user-agent":"', case event_id % 4 when 0 then 'python-requests/2.31' when 1 then 'Mozilla/5.0 (X11)'
    when 2 then 'Googlebot/2.1' else 'curl/8.0' end,
  '","client-id":', case when event_id % 3 = 0 then 'null' when event_id % 3 = 1 then '"eed-edsc-prod"' else '"other"' end,
  case when event_id % 9 = 0 then ',"cmr-search-after":"[1,2]"' else '' end,
  ',"duration":', cast(cast(round(value * 100) as bigint) as varchar(20)), ',"query-params":{{',
  case when event_id % 7 = 0 then concat('"polygon":"', cast(event_id % 100 as varchar(9)), ',0,',
      cast(event_id % 100 + 5 as varchar(9)), ',0,', cast(event_id % 100 + 5 as varchar(9)), ',',
      cast(event_id % 13 + 1 as varchar(9)), ',', case when event_id % 3 = 0 then concat(cast(event_id % 100 as varchar(9)), ',5,') else '' end,
      cast(event_id % 100 as varchar(9)), ',0"')
    when event_id % 7 = 1 then '"bounding_box":["-10,-10,10,10","20,20,30,30"]'
    when event_id % 7 = 2 then '"circle":"-83,40,2000"' when event_id % 7 = 3 then '"point":"12,34,5"'
    when event_id % 7 = 4 then concat('"bounding_box":"', cast(event_id % 30 as varchar(9)), ',0,',
      cast(event_id % 30 + event_id % 17 + 1 as varchar(9)), ',10"')
    else concat('"page_size":"', cast(event_id % 5 * 600 as varchar(9)), '"') end,
  case when event_id % 6 = 0 then ',"temporal":"2020-01-01T00:00:00Z,"' else '' end,
  case when event_id % 6 = 1 then ',"temporal_facet":{{"0":{{"year":"2011","month":"5"}}}}' else '' end,
  case when event_id % 6 = 2 then ',"updated_since":"2021-02-03"' else '' end,
  case when event_id % 10 = 0 then ',"sort_key":"-start_date,short_name"'
    when event_id % 10 = 1 then ',"sort_key[]":["-start_date","provider","short_name"]' else '' end,
  case when event_id % 8 = 0 then ',"provider":"PROV_A"' when event_id % 8 = 1 then ',"provider[]":["P1","P2"]'
    when event_id % 8 = 2 then ',"provider_id":"P3 x"' else '' end,
  case when event_id % 4 = 0 then concat(',"version":"', case when event_id % 16 = 0 then '6 Near-Real-Time'
    when event_id % 16 = 4 then '6;1' else '006' end, '"') else '' end,
  '}}',
  case when event_id % 4 < 2 then concat(',"form-params":{{"short_name":"MOD', cast(event_id % 3 as varchar(9)),
    '","page_num":"', cast(event_id % 12 as varchar(9)), '","collection_concept_id":"C', cast(event_id % 21 as varchar(9)),
    '-P","instrument":"MODIS"}}') else '' end,
  case when event_id % 50 = 49 then '' else '}}' end) as line
from {source}"""


VIEWS = {
    "granules": granules_sql,
    "granule_shapes": granule_shapes_sql,
    "points": points_sql,
    "log_lines": log_lines_sql,
}


def using(*names: str, **more: str) -> str:
    """WITH clause of the named views, and of further `name=select` views, for a SQL twin."""
    parts = [f"{n} as ({VIEWS[n]('duckdb')})" for n in names]
    parts += [f"{n} as ({text})" for n, text in more.items()]
    return "with " + ",\n".join(parts) + "\n"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def view(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    source = SOURCE_OF[name]
    # spark.sql formats its text: double the literal braces, bind only the source table
    text = VIEWS[name]("spark", "\0").replace("{", "{{").replace("}", "}}").replace("\0", "{source}")
    return spark.sql(text, source=table(spark, sf_dir, source))


def granules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return view(spark, sf_dir, "granules")


def granule_shapes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return view(spark, sf_dir, "granule_shapes")


def points(spark: SparkSession, sf_dir: str) -> DataFrame:
    return view(spark, sf_dir, "points")


def log_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    return view(spark, sf_dir, "log_lines")


def granule_boxes(spark: SparkSession, sf_dir: str, wkb: bool = False) -> DataFrame:
    """Granules with their rectangle as a geometry (kind, rings) or as WKB."""
    kind = F.lit("Polygon")
    rings = shapes.box_rings(*[F.col(c) for c in ("MBRWest", "MBRSouth", "MBREast", "MBRNorth")])
    value = encode_wkb(kind, rings) if wkb else F.struct(kind.alias("kind"), rings.alias("rings"))
    return granules(spark, sf_dir).withColumn("geometry", value)


# A triangle with right angle at (w, s) and, for every third shape, a half-size triangular hole.
def triangles(spark: SparkSession, sf_dir: str) -> DataFrame:
    """`granule_shapes` with polygon rings whose measures have closed forms."""
    df = granule_shapes(spark, sf_dir)
    w, s, dx, dy = (F.col(c) for c in ("w", "s", "dx", "dy"))
    shell = shapes.polygon_rings([(w, s), (w + dx, s), (w, s + dy)])
    hole_x, hole_y = w + dx / 8, s + dy / 8
    hole = F.array(
        shapes.ring(
            F.array(hole_x, hole_x, hole_x + dx / 2, hole_x), F.array(hole_y, hole_y + dy / 2, hole_y, hole_y), hole=True
        )
    )
    rings = F.when(F.col("partkey") % 3 == 0, F.concat(shell, hole)).otherwise(shell)
    return df.withColumns({"kind": F.lit("Polygon"), "rings": rings})


def rounded(df: DataFrame, *names: str, digits: int = 6) -> DataFrame:
    return reduce(lambda d, n: d.withColumn(n, F.round(F.col(n), digits)), names, df)


# ---- query shapes ------------------------------------------------------------------------------

QUERY_BOX = (-30.0, -35.0, 60.0, 45.0)
QUERY_RING = ((-30, -20), (40, -35), (60, 10), (20, 45), (-25, 30), (-30, -20))
SECOND_RING = ((100, -10), (120, -10), (120, 10), (100, 10), (100, -10))
INTERIOR_BOX = (-10.0, -10.0, 30.0, 15.0)
SINCE = "1998-01-01T00:00"


def wkt_ring(ring) -> str:
    return "(" + ", ".join(f"{x} {y}" for x, y in ring) + ")"


QUERY_POLYGON = f"POLYGON ({wkt_ring(QUERY_RING)})"
QUERY_MULTIPOLYGON = f"MULTIPOLYGON (({wkt_ring(QUERY_RING)}), ({wkt_ring(SECOND_RING)}))"


def edges_sql(*rings) -> str:
    """VALUES list of the edges of literal rings, for exact tests in SQL."""
    rows = []
    for ring in rings:
        rows += [f"({a[0]}e0, {a[1]}e0, {b[0]}e0, {b[1]}e0)" for a, b in zip(ring, ring[1:])]
    return f"select * from (values {', '.join(rows)}) e(x1, y1, x2, y2)"


def box_meets_edges_sql(w="MBRWest", s="MBRSouth", e="MBREast", n="MBRNorth") -> str:
    """SQL over a box joined to the query's edges, per box: it intersects the query polygon.

    A segment meets a box when their boxes overlap and the box corners are not all strictly on one
    side of its line. Otherwise the box lies inside the polygon (one corner decides) or holds it.
    """
    side = lambda x, y: f"((x2 - x1) * ({y} - y1) - (y2 - y1) * ({x} - x1))"
    corners = [side(w, s), side(e, s), side(e, n), side(w, n)]
    above = " and ".join(f"{c} > 0" for c in corners)
    below = " and ".join(f"{c} < 0" for c in corners)
    meets = (
        f"(least(x1, x2) <= {e} and greatest(x1, x2) >= {w} and least(y1, y2) <= {n} and greatest(y1, y2) >= {s}"
        f" and not ({above}) and not ({below}))"
    )
    ray = f"(((y1 > {s}) <> (y2 > {s})) and {w} < x1 + ({s} - y1) * (x2 - x1) / nullif(y2 - y1, 0))"
    return f"(bool_or({meets}) or sum(case when {ray} then 1 else 0 end) % 2 = 1)"


def point_in_edges_sql(x="lon", y="lat") -> str:
    """SQL per point joined to the query's edges: inside or on the edge."""
    on = (
        f"((x2 - x1) * ({y} - y1) - (y2 - y1) * ({x} - x1) = 0 and {x} between least(x1, x2) and greatest(x1, x2)"
        f" and {y} between least(y1, y2) and greatest(y1, y2))"
    )
    ray = f"(((y1 > {y}) <> (y2 > {y})) and {x} < x1 + ({y} - y1) * (x2 - x1) / nullif(y2 - y1, 0))"
    return f"(bool_or({on}) or sum(case when {ray} then 1 else 0 end) % 2 = 1)"
