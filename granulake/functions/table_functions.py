"""Table functions for SQL text: one document in, one row per shape out.

    SELECT * FROM xml_to_rows(TABLE(SELECT metadata FROM landed))
    SELECT * FROM ords_to_rows(TABLE(SELECT GranuleUR, ords, ords_info FROM hits))

They take the rows of a table in Arrow batches, wherever these are, so nothing is shuffled. Spark offers such functions
neither beside the columns of a LATERAL join nor as SQL bodies without a join on whole documents, so a function carries
the names of its rows itself. Geometries are WKB. Unreadable documents and unusable hits give no row.
"""

from __future__ import annotations

import gzip
import zlib
from collections.abc import Iterator
from xml.etree import ElementTree

import numpy as np
import pyarrow as pa
from pyspark.sql import SparkSession
from pyspark.sql import functions as F

from granulake.functions.geometry_batch import Batch
from granulake.sources.hits import ORD_SCALE, SHAPE_CODES

XML_DDL = "GranuleID string, StartTime string, EndTime string, kind string, geometry binary"
ORDS_DDL = "GranuleUR string, shape_no int, kind string, geometry binary"


def _numbers(node, *names: str) -> tuple[float, ...] | None:
    """The children's values; None unless all are numbers."""
    try:
        return tuple(float(node.findtext(n)) for n in names)
    except (TypeError, ValueError):
        return None


def _path(node) -> np.ndarray | None:
    points = [_numbers(p, "PointLongitude", "PointLatitude") for p in node.findall("Point")] if node is not None else []
    return None if None in points else np.array(points, dtype=float).reshape(-1, 2)


def document_shapes(root) -> list[tuple[str, np.ndarray]]:
    """Kind and vertices of a granule's point, lines, rectangle and polygons, in this order."""
    place = "HorizontalSpatialDomain/Geometry"
    geometry = root.find(f"SpatialExtent/{place}")
    geometry = root.find(f"Spatial/{place}") if geometry is None else geometry
    if geometry is None:
        return []
    out = []
    point, box = geometry.find("Point"), geometry.find("BoundingRectangle")
    at = _numbers(point, "Longitude", "Latitude") if point is not None else None
    if at is not None:
        out.append(("Point", np.array([at])))
    for line in map(_path, geometry.findall("Line")):
        if line is not None and len(line) > 1:
            out.append(("LineString", line))
    sides = [f"{s}BoundingCoordinate" for s in ("West", "South", "East", "North")]
    edges = _numbers(box, *sides) if box is not None else None
    if edges is not None:
        w, s, e, n = edges
        out.append(("Polygon", np.array([(w, s), (e, s), (e, n), (w, n), (w, s)])))
    for ring in (_path(p.find("Boundary")) for p in geometry.findall("GPolygon")):
        if ring is not None and len(ring) > 2:
            closed = (ring[0] == ring[-1]).all()
            out.append(("Polygon", ring if closed else np.vstack([ring, ring[:1]])))
    return out


def _rows(names: dict[str, list], shapes: list[tuple[str, np.ndarray]], ddl: str) -> pa.Table:
    n = np.arange(len(shapes))
    batch = Batch._pack([k for k, _ in shapes], [p for _, p in shapes], n, np.zeros_like(n), np.zeros_like(n), len(shapes))
    columns = {**names, "kind": batch.kinds, "geometry": batch.to_wkb()}
    kinds = {"string": pa.string(), "int": pa.int32(), "binary": pa.binary()}
    fields = pa.schema([(name, kinds[kind]) for name, kind in (f.split() for f in ddl.split(", "))])
    return pa.table([pa.array(columns[f.name], f.type) for f in fields], schema=fields)


class XmlRows:
    """xml_to_rows(TABLE(one column of gzip XML granules))."""

    def eval(self, documents: pa.RecordBatch) -> Iterator[pa.Table]:
        names, shapes = {"GranuleID": [], "StartTime": [], "EndTime": []}, []
        for blob in documents.column(0):
            try:
                root = ElementTree.fromstring(gzip.decompress(blob.as_py() or b""))
            except (OSError, EOFError, zlib.error, ElementTree.ParseError):
                continue
            found = document_shapes(root)
            time = "Temporal/RangeDateTime"
            texts = root.findtext("GranuleUR"), root.findtext(f"{time}/BeginningDateTime"), root.findtext(f"{time}/EndingDateTime")
            for column, text in zip(names.values(), texts):
                column.extend([text] * len(found))
            shapes.extend(found)
        yield _rows(names, shapes, XML_DDL)


def _lists(column: pa.ListArray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Values, starts and sizes of lists; a NULL list is empty, a NULL value is NaN."""
    sizes = np.asarray(column.value_lengths().fill_null(0), dtype=np.int64)
    values = column.flatten().cast(pa.float64(), safe=False).to_numpy(zero_copy_only=False)
    return values, np.cumsum(sizes) - sizes, sizes


class OrdsRows:
    """ords_to_rows(TABLE(name, coordinates, pairs of shape code and number of coordinates)), by offset arithmetic."""

    def eval(self, hits: pa.RecordBatch) -> Iterator[pa.Table]:
        ords, ord_at, ord_n = _lists(hits.column(1))
        info, info_at, info_n = _lists(hits.column(2))
        row = np.repeat(np.arange(hits.num_rows), np.where(info_n % 2 == 0, info_n // 2, 0))
        number = np.arange(len(row)) - np.searchsorted(row, row)
        code, size = info[info_at[row] + 2 * number], info[info_at[row] + 2 * number + 1]
        whole = np.isfinite(code) & np.isfinite(size)
        code, size = np.where(whole, code, 0).astype(np.int64), np.where(whole, size, 0).astype(np.int64)
        before = np.cumsum(size) - size
        begin = before - before[np.searchsorted(row, row)]
        held = np.clip(np.minimum(size, ord_n[row] - begin), 0, None)  # a size beyond the list takes what is left
        n = held // 2
        known = max(SHAPE_CODES) + 1
        fewest, most, kinds = np.full(known, 1), np.zeros(known, np.int64), np.full(known, "", object)
        for c, (kind, low, high) in SHAPE_CODES.items():
            fewest[c], most[c], kinds[c] = low, high or 2**31 - 1, kind
        code = np.where((code > 0) & (code < known), code, 0)
        good = whole & (size >= 0) & (begin >= 0) & (held % 2 == 0) & (n >= fewest[code]) & (n <= most[code])
        good &= np.bincount(row[~good], minlength=hits.num_rows)[row] == 0  # one bad shape spoils its hit
        row, number, n, kind = row[good], number[good], n[good], kinds[code[good]]
        first = ord_at[row] + begin[good]
        x, y = first, first + 1
        last = first + 2 * (n - 1)
        box = kind == "Rectangle"
        ring = np.isin(kind, ("Polygon", "Hole"))
        ends = np.flatnonzero(ring)
        open_ring = np.zeros(len(row), bool)
        open_ring[ends] = (ords[x[ends]] != ords[last[ends]]) | (ords[y[ends]] != ords[last[ends] + 1])
        out = np.where(box, 5, n + open_ring)
        at = np.repeat(np.arange(len(row)), out)
        place = np.arange(len(at)) - np.repeat(np.cumsum(out) - out, out)
        step = np.where(place == n[at], 0, place)
        corner_x, corner_y = np.array([0, 0, 1, 1, 0]), np.array([0, 1, 1, 0, 0])
        boxed, corner = box[at], np.minimum(place, 4)
        xs = ords[x[at] + 2 * np.where(boxed, corner_x[corner], step)] / ORD_SCALE
        ys = ords[y[at] + 2 * np.where(boxed, corner_y[corner], step)] / ORD_SCALE
        kind = np.where(np.isin(kind, ("Hole", "Rectangle")), "Polygon", kind)
        pieces = np.split(np.column_stack([xs, ys]), np.cumsum(out)[:-1]) if len(row) else []
        names = {"GranuleUR": hits.column(0).take(pa.array(row)).to_pylist(), "shape_no": number}
        yield _rows(names, list(zip(kind.tolist(), pieces)), ORDS_DDL)


def register(spark: SparkSession) -> None:
    """Make `xml_to_rows` and `ords_to_rows` known to SQL."""
    spark.udtf.register("xml_to_rows", F.arrow_udtf(XmlRows, returnType=XML_DDL))
    spark.udtf.register("ords_to_rows", F.arrow_udtf(OrdsRows, returnType=ORDS_DDL))
