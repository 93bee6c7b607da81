"""ECHO10 XML granules (gzip blobs) -> one row per shape."""

from __future__ import annotations

import gzip
import zlib

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from granulake.functions import geometry_batch, shapes
from granulake.schemas import ECHO10_DDL


def inflate(blob: Column) -> Column:
    """Gzip bytes -> text; NULL when the bytes are not gzip."""

    @F.arrow_udf("string")
    def run(v: pa.Array) -> pa.Array:
        out = []
        for value in v.to_pylist():
            try:
                out.append(None if value is None else gzip.decompress(value).decode("utf-8"))
            except (OSError, EOFError, zlib.error, UnicodeDecodeError):
                out.append(None)
        return pa.array(out, pa.string())

    return run(blob)


def _entry(kind: str, rings: Column) -> Column:
    return F.struct(F.lit(kind).alias("kind"), rings.alias("rings"))


def _line_rings(points: Column, closed: bool = False) -> Column:
    xs = F.transform(points, lambda p: p["PointLongitude"])
    ys = F.transform(points, lambda p: p["PointLatitude"])
    if closed:
        first = F.element_at(points, 1)
        last = F.element_at(points, -1)
        is_open = first != last
        xs = F.when(is_open, F.concat(xs, F.slice(xs, 1, 1))).otherwise(xs)
        ys = F.when(is_open, F.concat(ys, F.slice(ys, 1, 1))).otherwise(ys)
    return F.array(shapes.ring(xs, ys))


def _maybe(condition: Column, value: Column) -> Column:
    """One-element array, or an empty one."""
    return F.when(F.coalesce(condition, F.lit(False)), F.array(value)).otherwise(F.filter(F.array(value), lambda _: F.lit(False)))


def parse(df: DataFrame, xml: Column) -> DataFrame:
    """Add `granule`, the parsed document, from XML text."""
    return df.withColumn("granule", F.from_xml(xml, ECHO10_DDL))


def _geometry() -> Column:
    place = "HorizontalSpatialDomain.Geometry"
    return F.coalesce(F.col(f"granule.SpatialExtent.{place}"), F.col(f"granule.Spatial.{place}"))


def rectangle() -> Column:
    """First bounding rectangle with all four edges, as rings; NULL when there is none."""
    r = F.get(_geometry()["BoundingRectangle"], F.lit(0))
    w, e = r["WestBoundingCoordinate"], r["EastBoundingCoordinate"]
    n, s = r["NorthBoundingCoordinate"], r["SouthBoundingCoordinate"]
    complete = w.isNotNull() & e.isNotNull() & n.isNotNull() & s.isNotNull()
    return F.when(complete, shapes.box_rings(w, s, e, n))


def shape_list(with_rectangle: bool = True) -> Column:
    """Point, Line, BoundingRectangle, GPolygon in this order, one entry per shape."""
    g = _geometry()
    point = F.get(g["Point"], F.lit(0))
    has_point = point["Longitude"].isNotNull() & point["Latitude"].isNotNull()
    points = _maybe(has_point, _entry("Point", shapes.point_rings(point["Longitude"], point["Latitude"])))
    lines = F.transform(
        F.filter(F.coalesce(g["Line"], F.array()), lambda ln: F.size(ln["Point"]) > 1),
        lambda ln: _entry("LineString", _line_rings(ln["Point"])),
    )
    polygons = F.transform(
        F.filter(F.coalesce(g["GPolygon"], F.array()), lambda p: F.size(p["Boundary"]["Point"]) > 2),
        lambda p: _entry("Polygon", _line_rings(p["Boundary"]["Point"], closed=True)),
    )
    parts = [points, lines]
    if with_rectangle:
        box = rectangle()
        parts.append(_maybe(box.isNotNull(), _entry("Polygon", box)))
    return F.concat(*parts, polygons)


def _scalars() -> list[Column]:
    time = F.col("granule.Temporal.RangeDateTime")
    return [
        F.col("granule.GranuleUR").alias("GranuleID"),
        time["BeginningDateTime"].alias("StartTime"),
        time["EndingDateTime"].alias("EndTime"),
    ]


def to_shapes(df: DataFrame, blob: str = "metadata") -> DataFrame:
    """GranuleID, StartTime, EndTime, kind, rings: one row per shape; no shape, no row."""
    parsed = parse(df, inflate(F.col(blob)))
    return parsed.select(*_scalars(), F.explode(shape_list()).alias("s")).select(
        "GranuleID", "StartTime", "EndTime", "s.kind", "s.rings"
    )


def to_centers(df: DataFrame, blob: str = "metadata") -> DataFrame:
    """As `to_shapes`, with the rectangle and the centre point as columns, sorted by centre inside
    each partition."""
    parsed = parse(df, inflate(F.col(blob)))
    centers = F.transform(F.coalesce(_geometry()["GPolygon"], F.array()), lambda p: p["CenterPoint"])
    center = F.get(F.filter(centers, lambda c: c["PointLongitude"].isNotNull() & c["PointLatitude"].isNotNull()), F.lit(0))
    return (
        parsed.select(
            *_scalars(),
            rectangle().alias("BoundingRectangle"),
            center["PointLongitude"].alias("center_x"),
            center["PointLatitude"].alias("center_y"),
            F.explode(shape_list(with_rectangle=False)).alias("s"),
        )
        .select(
            "GranuleID", "StartTime", "EndTime", "s.kind", "s.rings", "BoundingRectangle", "center_x", "center_y"
        )
        .sortWithinPartitions("center_x", "center_y")
    )


def with_wkb(df: DataFrame) -> DataFrame:
    """The written form: the WKB geometry in place of kind and rings."""
    return df.withColumn("geometry", geometry_batch.encode_wkb(F.col("kind"), F.col("rings"))).drop("kind", "rings")
