"""Geometry, geohash and curve jobs: table in, table with more columns (or rows) out."""

from __future__ import annotations

from pyspark.sql import functions as F

from granulake.functions import curves, geohash, geometry_batch, meridian, shapes, wkt
from granulake.functions.staging import once
from granulake.operators import layout
from granulake.plans import inputs
from granulake.plans.inputs import rounded, using
from granulake.plans.registry import query
from granulake.plans.sinks import BOX, corner_sql, corners_sql, flat_bins_sql, nested_bins_sql
from granulake.session import scratch

# ---- reading shapes ------------------------------------------------------------------------------

_BOX_WKT = """concat('POLYGON ((', x1, ' ', y1, ', ', x2, ' ', y1, ', ', x2, ' ', y2, ', ', x1, ' ', y2, ', ', x1, ' ', y1, '))')"""


def _num(x: str) -> str:
    return f"case when {x} = floor({x}) then cast(cast({x} as bigint) as varchar) else cast({x} as varchar) end"


def _encoded(spark, sf_dir):
    """Granule boxes as WKB with every 29th value cut short."""
    g = inputs.granule_boxes(spark, sf_dir, wkb=True)
    whole = F.col("geometry")
    return g.withColumn("geometry", F.when(F.col("k") % 29 == 0, F.substring(whole, 1, 40)).otherwise(whole))


@query(
    "decode_geometry_table",
    using("granules")
    + f"""select GranuleUR, 'Polygon' as kind, round(MBRWest, 6) as xmin, round(MBRNorth, 6) as ymax, {_BOX_WKT} as wkt
          from (select *, {_num('MBRWest')} as x1, {_num('MBREast')} as x2, {_num('MBRSouth')} as y1, {_num('MBRNorth')} as y2
            from granules where k % 29 <> 0 and k % 101 <> 0) t
          union all select GranuleUR, 'Polygon', -180, 90, 'POLYGON ((-180 -90, 180 -90, 180 90, -180 90, -180 -90))'
            from granules where k % 101 = 0 and k % 29 <> 0""",
)
def decode_geometry_table(spark, sf_dir):
    """WKB and hex WKB -> kind, rings, box and text; values that cannot be read are left out."""
    table = _encoded(spark, sf_dir).withColumn("hex", F.hex("geometry"))
    blob = F.when(F.col("k") % 2 == 0, F.col("geometry")).otherwise(F.unhex("hex"))
    decoded = once(table, "g", geometry_batch.decode_wkb(blob), keep_null=False)
    box = shapes.bbox(F.col("g.rings"))
    return decoded.select(
        "GranuleUR",
        "g.kind",
        F.round(box["xmin"], 6).alias("xmin"),
        F.round(box["ymax"], 6).alias("ymax"),
        shapes.wkt(F.col("g.kind"), F.col("g.rings")).alias("wkt"),
    )


@query("decode_geometry_rejects", using("granules") + "select GranuleUR from granules where k % 29 = 0")
def decode_geometry_rejects(spark, sf_dir):
    """The reject table: values that are present but cannot be read."""
    table = _encoded(spark, sf_dir).withColumn("g", geometry_batch.decode_wkb(F.col("geometry")))
    return table.where(F.col("geometry").isNotNull() & F.col("g").isNull()).select("GranuleUR")


@query(
    "safe_wkt",
    using("granules")
    + """select GranuleUR, case k % 8 when 0 then 'Point' when 1 then 'LineString' when 2 then 'Polygon' when 3 then 'MultiPolygon'
             when 7 then 'MultiPoint' end as kind,
           case k % 8 when 0 then 1 when 1 then 2 when 2 then 4 when 3 then 8 when 7 then 2 end as vertices,
           case when k % 8 in (0, 1, 2, 3, 7) then MBRWest end as xmin from granules""",
)
def safe_wkt(spark, sf_dir):
    """Texts of several kinds, some broken: broken ones give NULL."""
    t = lambda c: F.col(c).cast("string")
    w, s, e, n = (t(c) for c in BOX)
    at = lambda x, y: F.concat(x, F.lit(" "), y)
    ring = F.concat(F.lit("("), F.concat_ws(", ", at(w, s), at(e, s), at(e, n), at(w, s)), F.lit(")"))
    texts = {
        0: F.concat(F.lit("POINT ("), at(w, s), F.lit(")")),
        1: F.concat(F.lit("linestring("), at(w, s), F.lit(" , "), at(e, n), F.lit(")")),
        2: F.concat(F.lit("POLYGON ("), ring, F.lit(")")),
        3: F.concat(F.lit("MULTIPOLYGON (("), ring, F.lit("), ("), ring, F.lit("))")),
        4: F.concat(F.lit("POLYGON (("), at(w, s), F.lit(", "), at(e, s), F.lit("))")),
        5: F.concat(F.lit("POINT ("), w, F.lit(")")),
        6: F.lit(""),
        7: F.concat(F.lit("MULTIPOINT (("), at(w, s), F.lit("), ("), at(e, n), F.lit("))")),
    }
    text = F.lit(None).cast("string")
    for value, column in texts.items():
        text = F.when(F.col("k") % 8 == value, column).otherwise(text)
    parsed = inputs.granules(spark, sf_dir).withColumn("g", wkt.parse(text))
    return parsed.select(
        "GranuleUR",
        "g.kind",
        shapes.vertex_count(F.col("g.rings")).alias("vertices"),
        shapes.xmin(F.col("g.rings")).alias("xmin"),
    )


# ---- measures --------------------------------------------------------------------------------------


@query(
    "geom_bounds",
    using("granule_shapes")
    + "select GranuleUR, shape_no, round(w, 6) as minx, round(s, 6) as miny, round(w + dx, 6) as maxx, round(s + dy, 6) as maxy from granule_shapes",
)
def geom_bounds(spark, sf_dir):
    bounds = shapes.with_bounds(inputs.triangles(spark, sf_dir)).select("GranuleUR", "shape_no", "minx", "miny", "maxx", "maxy")
    return rounded(bounds, "minx", "miny", "maxx", "maxy")


# The hole is a quarter of the triangle, its centroid at (1/8 + 1/6) of the legs.
_CENTER = "case when partkey % 3 = 0 then (1e0 / 3 - (1e0 / 8 + 1e0 / 6) / 4) / 0.75e0 else 1e0 / 3 end"


@query(
    "geom_centroid",
    using("granule_shapes")
    + f"select GranuleUR, shape_no, round(w + dx * {_CENTER}, 5) as cx, round(s + dy * {_CENTER}, 5) as cy from granule_shapes",
)
def geom_centroid(spark, sf_dir):
    t = inputs.triangles(spark, sf_dir).withColumn("c", shapes.centroid(F.col("kind"), F.col("rings")))
    return t.select("GranuleUR", "shape_no", F.round("c.x", 5).alias("cx"), F.round("c.y", 5).alias("cy"))


@query(
    "geom_area",
    using("granule_shapes")
    + """select GranuleUR, shape_no, round(dx * dy / 2 * case when partkey % 3 = 0 then 0.75e0 else 1e0 end, 5) as area
         from granule_shapes""",
)
def geom_area(spark, sf_dir):
    t = inputs.triangles(spark, sf_dir)
    return t.select("GranuleUR", "shape_no", F.round(shapes.area(F.col("kind"), F.col("rings")), 5).alias("area"))


@query(
    "vertex_count",
    using("granule_shapes")
    + """select GranuleUR, shape_no, case when partkey % 3 = 0 then 8 else 4 end as vertices,
           case when partkey % 3 = 0 then 8 else 4 end as by_text from granule_shapes""",
)
def vertex_count(spark, sf_dir):
    t = inputs.triangles(spark, sf_dir)
    text = shapes.wkt(F.col("kind"), F.col("rings"))
    return t.select(
        "GranuleUR",
        "shape_no",
        shapes.vertex_count(F.col("rings")).alias("vertices"),
        shapes.vertex_count_of_text(text).alias("by_text"),
    )


@query(
    "geom_envelope",
    using("granule_shapes")
    + """select GranuleUR, shape_no, corner, round(x, 6) as x, round(y, 6) as y from (
           select GranuleUR, shape_no, unnest(['LL', 'LR', 'UR', 'UL']) as corner, unnest([w, w + dx, w + dx, w]) as x,
             unnest([s, s, s + dy, s + dy]) as y from granule_shapes) t""",
)
def geom_envelope(spark, sf_dir):
    """Corner points of every envelope."""
    t = inputs.triangles(spark, sf_dir)
    box = t.withColumn("rings", shapes.envelope(F.col("rings")))
    rows = box.select("GranuleUR", "shape_no", F.explode(shapes.corners(F.col("rings"))).alias("c"))
    return rounded(rows.select("GranuleUR", "shape_no", "c.*"), "x", "y")


@query(
    "geom_simplify",
    using("granules")
    + """select GranuleUR, 6 as before, case when k % 2 = 0 then 5 else 6 end as after,
           case when k % 2 = 0 then 83 else 100 end as kept_pct from granules where k % 101 <> 0""",
)
def geom_simplify(spark, sf_dir):
    """Boxes with one more vertex near (dropped) or away from (kept) their lower edge."""
    w, s, e, n = (F.col(c) for c in BOX)
    bump = F.when(F.col("k") % 2 == 0, 0.004).otherwise(0.5)
    points = [(w, s), ((w + e) / 2, s - bump), (e, s), (e, n), (w, n), (w, s)]
    rings = shapes.polygon_rings(points)
    wide = inputs.granules(spark, sf_dir).where(F.col("k") % 101 != 0).select(
        "GranuleUR", F.lit("Polygon").alias("kind"), rings.alias("rings")
    )
    # widen every box so that only the extra vertex can fall below the tolerance
    big = wide.withColumn(
        "rings",
        F.transform(
            "rings",
            lambda r: F.struct(
                r["part"].alias("part"),
                r["hole"].alias("hole"),
                F.transform(r["xs"], lambda x: x * 100).alias("xs"),
                F.transform(r["ys"], lambda y, i: F.when(i == 1, y).otherwise(F.get(r["ys"], i) + F.when(i.isin(3, 4), 100.0).otherwise(0.0))).alias("ys"),
            ),
        ),
    )
    slim = big.withColumn("slim", geometry_batch.simplify(F.col("kind"), F.col("rings"), 0.01))
    before, after = shapes.vertex_count(F.col("rings")), shapes.vertex_count(F.col("slim"))
    return slim.select(
        "GranuleUR", before.alias("before"), after.alias("after"), F.floor(after * 100 / before).cast("int").alias("kept_pct")
    )


@query(
    "geom_simplify_topology",
    using("granules")
    + """select GranuleUR, case when k % 2 = 0 then 10 else 6 end as before, case when k % 2 = 0 then 10 else 5 end as after,
           5 as plain_shell from granules""",
)
def geom_simplify_topology(spark, sf_dir):
    """Boxes with a flat bulge below; a hole inside every second bulge keeps it, which plain reduction takes away."""
    x = F.col("MBRWest")
    shell = shapes.polygon_rings([(x, 0), (x + 5, -0.008), (x + 10, 0), (x + 10, 10), (x, 10), (x, 0)])
    hole_x, hole_y = F.array(x + 4.9, x + 5, x + 5.1, x + 4.9), F.array(*[F.lit(y) for y in (-0.002, -0.004, -0.002, -0.002)])
    rings = F.when(F.col("k") % 2 == 0, F.concat(shell, F.array(shapes.ring(hole_x, hole_y, hole=True)))).otherwise(shell)
    g = layout.spread_small(inputs.granules(spark, sf_dir)).select("GranuleUR", F.lit("Polygon").alias("kind"), rings.alias("rings"))
    slim = g.withColumns(
        {
            "slim": geometry_batch.simplify(F.col("kind"), F.col("rings"), 0.01),
            "plain": geometry_batch.simplify(F.col("kind"), F.col("rings"), 0.01, topology=False),
        }
    )
    return slim.select(
        "GranuleUR",
        shapes.vertex_count(F.col("rings")).alias("before"),
        shapes.vertex_count(F.col("slim")).alias("after"),
        F.size(F.get("plain", 0)["xs"]).alias("plain_shell"),
    )


_INSET = "(0.5e0 * sqrt(dx * dx / 9 + dy * dy / 9))"


@query(
    "box_shrink",
    using("granule_shapes")
    + f"""select GranuleUR, shape_no, case when alive then round(w + {_INSET}, 5) end as xmin,
            case when alive then round(s + dy - {_INSET}, 5) end as ymax, not alive as gone
          from (select *, 2 * {_INSET} < dx and 2 * {_INSET} < dy as alive from granule_shapes where partkey % 3 <> 0) t""",
)
def box_shrink(spark, sf_dir):
    """Triangle envelopes inset by half the way from the centroid to the lower-left corner."""
    t = inputs.triangles(spark, sf_dir).where(F.col("partkey") % 3 != 0)
    small = t.withColumn("small", shapes.shrink_box(F.col("kind"), F.col("rings")))
    return small.select(
        "GranuleUR",
        "shape_no",
        F.round(shapes.xmin(F.col("small")), 5).alias("xmin"),
        F.round(shapes.ymax(F.col("small")), 5).alias("ymax"),
        (F.size("small") == 0).alias("gone"),
    )


# ---- search texts --------------------------------------------------------------------------------


@query(
    "geom_from_query_text",
    using("points")
    + """select id, case when id % 5 = 0 then concat('POLYGON ((', a, ' 0, ', b, ' 0, ', b, ' 5, ', a, ' 0))')
           when id % 5 = 1 then concat('LINESTRING (', a, ' 1, ', b, ' 2)') when id % 5 = 2 then 'POINT ERROR: Odd Coordinate Count'
           when id % 5 = 3 then concat('MULTIPOINT ((', a, ' 1), (', b, ' 2))')
           else 'POLYGON ERROR: Blank coordinate' end as wkt
         from (select id, cast(id % 100 as varchar) as a, cast(id % 100 + 5 as varchar) as b from points) t""",
)
def geom_from_query_text(spark, sf_dir):
    p = inputs.points(spark, sf_dir)
    a, b = (F.col("id") % 100).cast("string"), (F.col("id") % 100 + 5).cast("string")
    ring = F.concat(a, F.lit(",0,"), b, F.lit(",0,"), b, F.lit(",5,"), a, F.lit(",0"))
    line = F.concat(a, F.lit(",1,"), b, F.lit(",2"))
    text = (
        F.when(F.col("id") % 5 == 0, wkt.scalar_text_to_wkt(ring, "POLYGON"))
        .when(F.col("id") % 5 == 1, wkt.scalar_text_to_wkt(line, "LINESTRING"))
        .when(F.col("id") % 5 == 2, wkt.scalar_text_to_wkt(F.concat(a, F.lit(",34,5")), "POINT"))
        .when(F.col("id") % 5 == 3, wkt.list_text_to_wkt(F.array(F.concat(a, F.lit(",1")), F.concat(b, F.lit(",2"))), "POINT"))
        .otherwise(wkt.scalar_text_to_wkt(F.concat(a, F.lit(",,"), b, F.lit(",1")), "POLYGON"))
    )
    return p.select("id", text.alias("wkt"))


_RING = "concat('((', a, ' 0, ', b, ' 0, ', b, ' 2.5, ', a, ' 2.5, ', a, ' 0))')"


@query(
    "bbox_text_to_polygon",
    using("points")
    + f"""select id, case when id % 4 = 0 then concat('POLYGON ', {_RING})
            when id % 4 = 1 then concat('MULTIPOLYGON (', {_RING}, ', ((-10 -10, 10 -10, 10 10, -10 10, -10 -10)))')
            else 'ERROR: failed to parse bbox coordinates' end as wkt
          from (select id, cast(id % 100 as varchar) as a, cast(id % 100 + 5 as varchar) as b from points) t""",
)
def bbox_text_to_polygon(spark, sf_dir):
    p = inputs.points(spark, sf_dir)
    a, b = (F.col("id") % 100).cast("string"), (F.col("id") % 100 + 5).cast("string")
    good = F.concat(a, F.lit(",0, "), b, F.lit(",2.50"))
    texts = (
        F.when(F.col("id") % 4 == 0, F.array(good))
        .when(F.col("id") % 4 == 1, F.array(good, F.lit("-10,-10,10,10")))
        .when(F.col("id") % 4 == 2, F.array(good, F.lit("1,2,x,4")))
        .otherwise(F.array(F.concat(a, F.lit(",1,2"))))
    )
    return p.select("id", wkt.boxes_to_wkt(texts).alias("wkt"))


@query(
    "circle_parse",
    using("points")
    + """select id, case when id % 3 = 0 then concat('POINT (', a, ' 40)') when id % 3 = 1 then concat('MULTIPOINT ((', a, ' 40), (1 2))')
           else 'POINT ERROR: got 2 split values instead of expected 3' end as wkt,
           case when id % 3 = 0 then cast(id % 500 as integer) when id % 3 = 1 then cast(floor((id % 500 + 100) / 2e0) as integer) end as radius
         from (select id, cast(id % 100 as varchar) as a from points) t""",
)
def circle_parse(spark, sf_dir):
    a = (F.col("id") % 100).cast("string")
    one = F.concat(a, F.lit(",40,"), (F.col("id") % 500).cast("string"))
    texts = (
        F.when(F.col("id") % 3 == 0, F.array(one))
        .when(F.col("id") % 3 == 1, F.array(one, F.lit("1,2,100")))
        .otherwise(F.array(F.concat(a, F.lit(",40"))))
    )
    parsed = inputs.points(spark, sf_dir).select("id", wkt.circles(texts).alias("c"))
    return parsed.select("id", "c.wkt", "c.radius")


# ---- extents -------------------------------------------------------------------------------------


@query(
    "partition_extents",
    using("granules")
    + """select CollectionConceptId as part, count(*) as n, min(MBRWest) as xmin, min(MBRSouth) as ymin, max(MBREast) as xmax,
           max(MBRNorth) as ymax from granules group by 1""",
)
def partition_extents(spark, sf_dir):
    """Extents of a table partitioned by collection."""
    return layout.extents(inputs.granules(spark, sf_dir), "CollectionConceptId")


@query(
    "partition_extents_by_id",
    using("granules") + "select count(*)::bigint as n, min(MBRWest) as xmin, max(MBRNorth) as ymax from granules",
)
def partition_extents_by_id(spark, sf_dir):
    """Extents of the curve-ordered partitions, put together again."""
    placed = layout.spatial_shuffle(inputs.granules(spark, sf_dir), 8, tie=["GranuleUR"])
    return layout.partition_extents(placed).agg(
        F.sum("n").alias("n"), F.min("xmin").alias("xmin"), F.max("ymax").alias("ymax")
    )


@query("partition_hulls", using("points") + """select p.nation, round(p.lon, 6) as x, round(p.lat, 6) as y from points p
  join (select nation, min(lon) as least_lon from points group by 1) m on p.nation = m.nation and p.lon = m.least_lon""")
def partition_hulls(spark, sf_dir):
    """Convex hull per group of points; shown are the leftmost hull vertices."""
    hull = layout.hulls(inputs.points(spark, sf_dir), "nation", "lon", "lat")
    left = hull.groupBy("nation").agg(F.min_by(F.struct("x", "y"), F.struct("x", "y")).alias("p"))
    return left.select("nation", F.round("p.x", 6).alias("x"), F.round("p.y", 6).alias("y"))


# ---- geohash -------------------------------------------------------------------------------------


@query(
    "geohash_encode",
    using("points")
    + f"select id, {corner_sql('lon', 'lat', 5)} as clamped, {geohash.geohash_sql('lon + 0.01e0', 'lat + 0.01e0', 5, 'wrap')} as wrapped from points",
)
def geohash_encode(spark, sf_dir):
    p = inputs.points(spark, sf_dir).withColumns({"lon2": F.col("lon") + 0.01, "lat2": F.col("lat") + 0.01})
    p = geohash.with_geohash(p, "lon", "lat", 5, "clamped")
    return geohash.with_geohash(p, "lon2", "lat2", 5, "wrapped", "wrap").select("id", "clamped", "wrapped")


# Cell centre straight from the cell numbers, without reading the letters.
_X7, _Y7 = geohash.cell_sql("lon", "lat", 7)


@query(
    "geohash_decode",
    using("points")
    + f"""select id, round(({_X7} + 0.5e0) / {2**18} * 360 - 180, 6) as lon, round(({_Y7} + 0.5e0) / {2**17} * 180 - 90, 6) as lat
          from points""",
)
def geohash_decode(spark, sf_dir):
    hashed = geohash.with_geohash(inputs.points(spark, sf_dir), "lon", "lat", 7, "code")
    return rounded(geohash.with_decoded(hashed.select("id", "code"), "code").drop("code"), "lon", "lat")


def _prefix_size_sql(depth: int) -> str:
    return (
        "case "
        + " ".join(f"when substr(hash1, 1, {i}) = substr(hash2, 1, {i}) then {i}" for i in range(depth, 0, -1))
        + " else 0 end"
    )


_METRES = " ".join(f"when {size} then {metres}e0" for size, metres in geohash.PREFIX_METRES.items())


@query(
    "geohash_distance",
    using("granules", c=corners_sql(6)) + f"select GranuleUR, case {_prefix_size_sql(6)} {_METRES} end as metres from c",
)
def geohash_distance(spark, sf_dir):
    hashed = geohash.with_corner_hashes(inputs.granules(spark, sf_dir), BOX, 6)
    return hashed.select("GranuleUR", geohash.approximate_metres("hash1", "hash2", 6).alias("metres"))


@query(
    "common_prefix",
    using("granules", c=corners_sql(6)) + f"select GranuleUR, substr(hash1, 1, {_prefix_size_sql(6)}) as prefix from c",
)
def common_prefix(spark, sf_dir):
    hashed = geohash.with_corner_hashes(inputs.granules(spark, sf_dir), BOX, 6)
    upper = hashed.withColumn("hash2", F.upper("hash2"))
    return upper.select("GranuleUR", geohash.shared_prefix("hash1", "hash2", 6).alias("prefix"))


_QUADRANT_OF = "case when lat_up then case when lon_up then 'NE' else 'NW' end else case when lon_up then 'SE' else 'SW' end end"


@query(
    "hash_region",
    using("points") + f"select id, {_QUADRANT_OF} as region from (select id, lon >= 0 as lon_up, lat >= 0 as lat_up from points) t",
)
def hash_region(spark, sf_dir):
    hashed = geohash.with_geohash(inputs.points(spark, sf_dir), "lon", "lat", 4, "code")
    return hashed.select("id", geohash.quadrant(F.col("code")).alias("region"))


_SIDE = """case when hash1 = hash2 then hash1 when hash1 = '0' and hash2 = 'z' then 'Global'
  when aw and ah then case when bw and bh then 'All' when bw then 'South' when bh then 'West' else 'SW' end
  when ah then case when bh and bw then 'East' else 'SE' end when aw then case when bw and bh then 'North' else 'NW' end
  else 'NE' end"""
_SIDE_ROWS = f"""select GranuleUR, {_SIDE} as region from (select *, MBRWest < 0 as aw, MBRSouth < 0 as ah, MBREast >= 0 as bw,
  MBRNorth >= 0 as bh from ({corners_sql(1, 'GranuleUR, MBRWest, MBRSouth, MBREast, MBRNorth')}) c) t"""


@query("box_region", using("granules") + _SIDE_ROWS)
def box_region(spark, sf_dir):
    hashed = geohash.with_corner_hashes(inputs.granules(spark, sf_dir), BOX, 1)
    return hashed.select("GranuleUR", geohash.corner_region(F.col("hash1"), F.col("hash2")).alias("region"))


@query(
    "hemispheres",
    using("granules")
    + """select GranuleUR, case when w and e and s and n then 'All' when w and e and (s or n) then case when s then 'SW-SE' else 'NE-NW' end
           when s and n and (w or e) then case when w then 'SW-NW' else 'SE-NE' end
           when (w or e) and (s or n) then concat(case when s then 'S' else 'N' end, case when w then 'W' else 'E' end)
           else 'Central' end as region
         from (select GranuleUR, MBRWest < 0 as w, MBREast > 0 as e, MBRSouth < 0 as s, MBRNorth > 0 as n from granules) t""",
)
def hemispheres(spark, sf_dir):
    return inputs.granules(spark, sf_dir).select("GranuleUR", geohash.hemispheres(*[F.col(c) for c in BOX]).alias("region"))


@query(
    "is_global",
    using("granules")
    + "select GranuleUR, MBRWest - 1 < -180 or MBREast + 1 > 180 or MBRSouth < -90 or MBRNorth + 1 > 90 as beyond from granules",
)
def is_global(spark, sf_dir):
    """Boxes grown by a degree that reach over the limits of the globe."""
    g = inputs.granules(spark, sf_dir)
    beyond = geohash.is_beyond_globe(F.col("MBRWest") - 1, F.col("MBRSouth"), F.col("MBREast") + 1, F.col("MBRNorth") + 1)
    return g.select("GranuleUR", beyond.alias("beyond"))


@query("hash_path_flat", using("granules", bins=flat_bins_sql()) + "select GranuleUR, hashbin as path from bins")
def hash_path_flat(spark, sf_dir):
    hashed = geohash.with_corner_hashes(inputs.granules(spark, sf_dir), BOX, 1)
    return geohash.flat_path(hashed).select("GranuleUR", "path")


@query("hash_path_nested", using("granules", bins=nested_bins_sql()) + "select GranuleUR, path from bins")
def hash_path_nested(spark, sf_dir):
    hashed = geohash.with_corner_hashes(inputs.granules(spark, sf_dir), BOX, 3)
    return geohash.with_nested_path(hashed, 3).select("GranuleUR", "path")


def prefix_rows_sql(depth: int) -> str:
    letters = ", ".join(f"nullif(substr(prefix, {i}, 1), '')" for i in range(1, depth + 1))
    return f"""select r.GranuleUR, case when length(region) = 1 then concat_ws('/', {letters}) else region end as path
      from ({_SIDE_ROWS}) r join (select GranuleUR, substr(hash1, 1, {_prefix_size_sql(depth)}) as prefix from ({corners_sql(depth)}) c) p
      using (GranuleUR)"""


def kinded(spark, sf_dir):
    """Granules as shapes of several kinds by k % 5: point, line, polygon, multipolygon, none."""
    w, s, e, n = (F.col(c) for c in BOX)
    box = shapes.box_rings(w, s, e, n)
    line = F.array(shapes.ring(F.array(w, e), F.array(s, n)))
    kind = F.get(F.array(*[F.lit(x) for x in ("Point", "LineString", "Polygon", "MultiPolygon", None)]), (F.col("k") % 5).cast("int"))
    rings = F.when(kind == "Point", shapes.point_rings(w, s)).when(kind == "LineString", line).when(kind.isNotNull(), box)
    return inputs.granules(spark, sf_dir).withColumns({"kind": kind, "rings": rings})


@query(
    "hash_path_prefix",
    using("granules", paths=prefix_rows_sql(4))
    + f"""select GranuleUR, path from paths join granules using (GranuleUR) where k % 5 in (1, 2)
          union all select GranuleUR, concat_ws('/', {', '.join(f"substr(code, {i}, 1)" for i in range(1, 5))})
          from (select GranuleUR, {corner_sql('MBRWest', 'MBRSouth', 4)} as code from granules where k % 5 = 0) p""",
)
def hash_path_prefix(spark, sf_dir):
    """Points, lines and polygons by shared prefix; other kinds are not placed."""
    table = kinded(spark, sf_dir).where(F.col("kind").isin("Point", "LineString", "Polygon"))
    table = shapes.with_bounds(table)
    hashed = geohash.with_corner_hashes(table, ("minx", "miny", "maxx", "maxy"), 4)
    return geohash.with_prefix_path(hashed, 4).select("GranuleUR", "path")


@query("pair_bucket", using("granules", c=corners_sql(1)) + "select GranuleUR, concat(hash1, '-', hash2) as bucket from c")
def pair_bucket(spark, sf_dir):
    hashed = geohash.with_corner_hashes(inputs.granules(spark, sf_dir), BOX, 1)
    return hashed.select("GranuleUR", F.concat_ws("-", "hash1", "hash2").alias("bucket"))


# ---- curves and maps ---------------------------------------------------------------------------------


def _grid_sql(bits: int) -> str:
    grid = lambda v, low, span: f"greatest(least(cast(floor(({v} - ({low}e0)) / {span}e0 * {2**bits}e0) as bigint), {2**bits - 1}), 0)"
    return (
        f"select GranuleUR, {grid('(MBRWest + MBREast) / 2', -180, 360)} as x, {grid('(MBRSouth + MBRNorth) / 2', -90, 180)} as y "
        "from granules"
    )


@query(
    "curve_key",
    using("granules", cells=_grid_sql(16))
    + f"""select GranuleUR, {curves.morton_sql('x', 'y', 16)} as morton,
            {geohash.geohash_sql('(MBRWest + MBREast) / 2', '(MBRSouth + MBRNorth) / 2', 6)} as code
          from cells join granules using (GranuleUR)""",
)
def curve_key(spark, sf_dir):
    g = inputs.granules(spark, sf_dir)
    g = curves.with_curve_key(g, curve="morton", name="morton")
    return curves.with_curve_key(g, curve="geohash", name="code").select("GranuleUR", "morton", "code")


@query(
    "curve_key_hilbert",
    "with recursive "
    + using("granules", cells=_grid_sql(10))[5:].rstrip()
    + """, walk as (
      select GranuleUR, x, y, 512::bigint as side, 0::bigint as d from cells
      union all
      select GranuleUR,
        case when (y & side) = 0 then case when (x & side) > 0 then 1023 - y else y end else x end,
        case when (y & side) = 0 then case when (x & side) > 0 then 1023 - x else x end else y end,
        side >> 1, d + side * side * xor(3 * ((x & side) > 0)::bigint, ((y & side) > 0)::bigint)
      from walk where side > 0)
    select GranuleUR, d as hilbert from walk where side = 0""",
)
def curve_key_hilbert(spark, sf_dir):
    return curves.with_curve_key(inputs.granules(spark, sf_dir), bits=10, name="hilbert").select("GranuleUR", "hilbert")


@query(
    "reproject_mercator",
    using("points")
    + """select id, case when abs(lat) < 90 then round(6378137e0 * radians(lon), 3) end as x,
           case when abs(lat) < 90 then round(6378137e0 * ln(tan(0.7853981633974483e0 + radians(lat) / 2)), 2) end as y from points""",
)
def reproject_mercator(spark, sf_dir):
    p = inputs.points(spark, sf_dir).withColumn("m", shapes.mercator(F.col("lon"), F.col("lat")))
    return p.select("id", F.round("m.x", 3).alias("x"), F.round("m.y", 2).alias("y"))


@query(
    "antimeridian_split",
    using("granules")
    + """select GranuleUR, 1 as part, MBRWest + 0e0 as w, case when k % 7 = 0 then 180e0 else MBREast end as e from granules
         union all select GranuleUR, 2, -180e0, MBRWest - 1 from granules where k % 7 = 0""",
)
def antimeridian_split(spark, sf_dir):
    """Every seventh box runs from its west edge over 180 to one degree before it."""
    east = F.when(F.col("k") % 7 == 0, F.col("MBRWest") - 1).otherwise(F.col("MBREast"))
    crossing = inputs.granules(spark, sf_dir).select("GranuleUR", F.col("MBRWest").alias("w"), east.alias("e"), (F.col("k") % 7 == 0).alias("over"))
    return shapes.split_antimeridian(crossing, "w", "e", F.col("over")).drop("over")


@query(
    "antimeridian_rings",
    using("granule_shapes")
    + """select GranuleUR, shape_no, case when k % 2 = 0 then 'Polygon' else 'MultiPolygon' end as kind,
           (case when k % 2 = 0 then 4 else 9 end + case when partkey % 3 <> 0 then 0 when k % 2 = 0 then 4 else 7 end)::bigint as vertices,
           round(dx * dy / 2 * case when partkey % 3 = 0 then 0.75e0 else 1e0 end, 9) as area,
           case when k % 2 = 0 then 0e0 else round(dx * dy / 2 * case when partkey % 3 = 0 then 0.75e0 else 1e0 end
             * power((3 - partkey % 3) / 4e0, 2), 9) end as east_area
         from granule_shapes""",
)
def antimeridian_rings(spark, sf_dir):
    """Triangles with holes: every second one is moved so that a quarter, half or three quarters lie before 180.

    The cut runs through the hole too, so its border becomes part of both shells.
    """
    t = inputs.triangles(spark, sf_dir)
    shift = F.when(F.col("k") % 2 == 1, 180 - F.col("dx") * (1 + F.col("partkey") % 3) / 4 - F.col("w")).otherwise(F.lit(0.0))

    def moved(r):
        xs = F.transform(r["xs"], lambda x: F.when(x + F.col("shift") > 180, x + F.col("shift") - 360).otherwise(x + F.col("shift")))
        return F.struct(r["part"].alias("part"), r["hole"].alias("hole"), xs.alias("xs"), r["ys"].alias("ys"))

    t = t.withColumn("shift", shift).withColumn("rings", F.transform("rings", moved))
    t = t.withColumn("g", meridian.split(F.col("kind"), F.col("rings")))
    rings = F.col("g.rings")
    east = F.when(F.col("k") % 2 == 1, F.filter(rings, lambda r: F.array_max(r["xs"]) < 0)).otherwise(F.array().cast(shapes.RINGS_DDL))
    cut = t.select(
        "GranuleUR",
        "shape_no",
        F.col("g.kind").alias("kind"),
        shapes.vertex_count(rings).cast("bigint").alias("vertices"),
        shapes.area(F.col("g.kind"), rings).alias("area"),
        shapes.area(F.col("g.kind"), east).alias("east_area"),
    )
    return inputs.rounded(cut, "area", "east_area", digits=9)


@query(
    "geom_normalize",
    using("granule_shapes")
    + """select count(*) as shapes, sum(n)::bigint as rows from (
           select count(*) as n from granule_shapes group by w, s, w + dx, s + dy, partkey % 3 = 0, dx, dy) t""",
)
def geom_normalize(spark, sf_dir):
    """Triangles written in three vertex orders; equal shapes fall into one group."""
    t = inputs.triangles(spark, sf_dir)

    def turned(r):
        body_x, body_y = F.slice(r["xs"], 1, 3), F.slice(r["ys"], 1, 3)
        spin = lambda a: F.concat(F.slice(a, 2, 2), F.slice(a, 1, 2))
        how = F.col("suppkey") % 3
        xs = F.when(how == 0, r["xs"]).when(how == 1, F.reverse(r["xs"])).otherwise(spin(body_x))
        ys = F.when(how == 0, r["ys"]).when(how == 1, F.reverse(r["ys"])).otherwise(spin(body_y))
        return F.struct(r["part"].alias("part"), r["hole"].alias("hole"), xs.alias("xs"), ys.alias("ys"))

    key = shapes.normalize(F.transform("rings", turned))
    groups = t.groupBy(key.alias("key")).agg(F.count(F.lit(1)).alias("n"))
    return groups.agg(F.count(F.lit(1)).alias("shapes"), F.sum("n").alias("rows"))


# ---- SQL function -----------------------------------------------------------------------------------


@query(
    "register_hashbin",
    using("granules", bins=flat_bins_sql()) + "select hashbin, count(*) as n from bins group by 1",
)
def register_hashbin(spark, sf_dir):
    """The bin of a WKB value as a named SQL function."""
    from granulake.functions.udfs import register_hashbin

    register_hashbin(spark)
    path = scratch(spark, "wkb")
    inputs.granule_boxes(spark, sf_dir, wkb=True).select("GranuleUR", "geometry").write.parquet(path)
    boxes = spark.read.parquet(path)
    return spark.sql("select hashbin_wkb(geometry, 1) as hashbin, count(*) as n from {boxes} group by 1", boxes=boxes)
