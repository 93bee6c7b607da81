import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from granulake.functions import geometry_batch as gb
from granulake.functions import shapes, wkt
from granulake.functions.geometry_batch import Batch

random.seed(7)


def polygon(points):
    ring = [*points, points[0]]
    return gb.write_wkb("Polygon", [(0, False, np.array(ring, dtype=float))])


def star(cx, cy, size, vertices):
    angles = sorted(random.uniform(0, 2 * math.pi) for _ in range(vertices))
    return [(cx + math.cos(a) * size * random.uniform(0.3, 1), cy + math.sin(a) * size * random.uniform(0.3, 1)) for a in angles]


def batch(*blobs):
    import pyarrow as pa

    return Batch.from_wkb(pa.array(list(blobs), pa.binary()))


def _inside(p, ring):
    hit = False
    for (x1, y1), (x2, y2) in zip(ring, ring[1:] + ring[:1]):
        if (y1 > p[1]) != (y2 > p[1]) and p[0] < x1 + (p[1] - y1) * (x2 - x1) / (y2 - y1):
            hit = not hit
    return hit


def _cross(a, b, c, d):
    side = lambda p, q, r: (q[0] - p[0]) * (r[1] - p[1]) - (q[1] - p[1]) * (r[0] - p[0])
    return (side(a, b, c) > 0) != (side(a, b, d) > 0) and (side(c, d, a) > 0) != (side(c, d, b) > 0)


def _brute(a, b):
    ea, eb = list(zip(a, a[1:] + a[:1])), list(zip(b, b[1:] + b[:1]))
    return any(_cross(*x, *y) for x in ea for y in eb) or _inside(a[0], b) or _inside(b[0], a)


def test_intersects_against_brute_force():
    shapes_ = [star(random.uniform(-10, 10), random.uniform(-10, 10), random.uniform(0.5, 6), random.randint(3, 12)) for _ in range(300)]
    query = star(0, 0, 5, 60)
    got = gb.intersects(batch(*[polygon(s) for s in shapes_]), batch(polygon(query)))
    want = [_brute(s, query) for s in shapes_]
    assert got.tolist() == want and 20 < sum(want) < 280


def test_touching_edges_count():
    square = polygon([(0, 0), (1, 0), (1, 1), (0, 1)])
    beside = polygon([(1, 0), (2, 0), (2, 1), (1, 1)])
    corner = polygon([(1, 1), (2, 1), (2, 2), (1, 2)])
    apart = polygon([(1.01, 0), (2, 0), (2, 1), (1.01, 1)])
    point = gb.write_wkb("Point", [(0, False, np.array([[0.5, 1.0]]))])
    assert gb.intersects(batch(beside, corner, apart, point), batch(square)).tolist() == [True, True, False, True]


def test_hole_is_outside():
    shell = np.array([(0, 0), (10, 0), (10, 10), (0, 10), (0, 0)], dtype=float)
    hole = np.array([(3, 3), (3, 7), (7, 7), (7, 3), (3, 3)], dtype=float)
    ring = gb.write_wkb("Polygon", [(0, False, shell), (0, True, hole)])
    inner, outer = polygon([(4, 4), (6, 4), (6, 6), (4, 6)]), polygon([(1, 1), (2, 1), (2, 2), (1, 2)])
    assert gb.intersects(batch(inner, outer), batch(ring)).tolist() == [False, True]
    assert gb.intersects(batch(ring), batch(inner)).tolist() == [False]
    assert gb.contains(batch(ring), batch(outer)).tolist() == [True]
    around = polygon([(2, 2), (8, 2), (8, 8), (2, 8)])
    assert gb.contains(batch(ring), batch(around)).tolist() == [False]


def test_contains_of_points_and_shapes():
    square = polygon([(0, 0), (4, 0), (4, 4), (0, 4)])
    point = lambda x, y: gb.write_wkb("Point", [(0, False, np.array([[x, y]], dtype=float))])
    for p, want in ((point(1, 1), True), (point(0, 1), False), (point(5, 1), False)):
        assert gb.contains(batch(square), batch(p)).tolist() == [want]
    assert gb.contains(batch(square), batch(polygon([(0, 0), (2, 0), (2, 2), (0, 2)]))).tolist() == [True]
    notch = polygon([(0, 0), (4, 0), (4, 4), (2, 1), (0, 4)])
    assert gb.contains(batch(notch), batch(polygon([(0.5, 0.5), (3.5, 0.5), (3.9, 3), (0.1, 3)]))).tolist() == [False]


def test_wkb_round_trip_and_broken_values(spark):
    texts = [
        "POINT (1 2)",
        "LINESTRING (0 0, 1 1.5)",
        "POLYGON ((0 0, 4 0, 4 4, 0 0), (1 0.5, 2 0.5, 2 1, 1 0.5))",
        "MULTIPOINT ((1 2), (3 4))",
        "MULTILINESTRING ((0 0, 1 1), (2 2, 3 3))",
        "MULTIPOLYGON (((0 0, 1 0, 1 1, 0 0)), ((5 5, 6 5, 6 6, 5 5), (5.2 5.1, 5.4 5.1, 5.4 5.2, 5.2 5.1)))",
    ]
    df = spark.createDataFrame([(t,) for t in texts], "t string").withColumn("g", wkt.parse(F.col("t")))
    df = df.withColumn("b", gb.encode_wkb(F.col("g.kind"), F.col("g.rings")))
    back = df.withColumn("d", gb.decode_wkb(F.col("b"))).select("t", shapes.wkt(F.col("d.kind"), F.col("d.rings")).alias("u"))
    rows = {r.t: r.u for r in back.collect()}
    assert rows["POLYGON ((0 0, 4 0, 4 4, 0 0), (1 0.5, 2 0.5, 2 1, 1 0.5))"].startswith("POLYGON ((0 0, 4 0")
    assert rows == {**{t: t for t in texts}, "MULTIPOINT ((1 2), (3 4))": "MULTIPOINT ((1 2), (3 4))"}
    for blob in (b"", b"\x01", b"\x01\x09\x00\x00\x00", gb.write_wkb("Point", [(0, False, np.zeros((1, 2)))])[:-1]):
        assert gb.read_wkb(blob) is None


@pytest.mark.parametrize("text", ["", "POLYGON", "POLYGON ((0 0, 1 1))", "POLYGON ((0 0, 1 0, 1 1, 0 1))", "POINT (1)", "POINT (a b)", "CIRCLE (1 2)", "POINT (1 2", "LINESTRING (1 2)", None])
def test_bad_wkt_is_null(spark, text):
    assert spark.createDataFrame([(text,)], "t string").select(wkt.parse(F.col("t")).alias("g")).first().g is None
    if text is not None:
        assert wkt.read_literal(text) is None


def test_literal_reader_agrees_with_column_reader(spark):
    text = "MULTIPOLYGON (((0 0, 1e0 0, 1 1, 0 0)), ((5 5,6 5 ,6 6, 5 5), (5.2 5.1, 5.4 5.1, 5.4 5.2, 5.2 5.1)))"
    row = spark.range(1).select(wkt.parse(F.lit(text)).alias("g")).first().g
    kind, rings = wkt.read_literal(text)
    assert kind == row.kind
    assert [(p, h, r.tolist()) for p, h, r in rings] == [(r.part, r.hole, [list(p) for p in zip(r.xs, r.ys)]) for r in row.rings]


def test_very_long_wkt(spark):
    points = [(math.cos(i / 5000), math.sin(i / 5000)) for i in range(31000)]
    text = "POLYGON ((" + ", ".join(f"{x} {y}" for x, y in points + points[:1]) + "))"
    g = spark.createDataFrame([(text,)], "t string").select(wkt.parse(F.col("t")).alias("g"))
    assert g.select(shapes.vertex_count(F.col("g.rings"))).first()[0] == 31001


def test_area_and_centroid_of_holes_and_lines(spark):
    texts = ["POLYGON ((0 0, 4 0, 4 4, 0 4, 0 0), (0 0, 0 2, 2 2, 2 0, 0 0))", "LINESTRING (0 0, 2 0, 2 2)", "MULTIPOINT ((0 0), (2 4))", "POLYGON ((0 0, 2 0, 0 0, 0 0))"]
    df = spark.createDataFrame([(t,) for t in texts], "t string").withColumn("g", wkt.parse(F.col("t")))
    rows = df.select(shapes.area(F.col("g.kind"), F.col("g.rings")).alias("a"), shapes.centroid(F.col("g.kind"), F.col("g.rings")).alias("c")).collect()
    assert [r.a for r in rows] == [12.0, 0.0, 0.0, 0.0]
    assert tuple(rows[0].c) == pytest.approx((7 / 3, 7 / 3))
    assert tuple(rows[1].c) == (1.5, 0.5) and tuple(rows[2].c) == (1.0, 2.0) and tuple(rows[3].c) == (1.0, 0.0)


def test_simplify_keeps_ends_and_far_vertices():
    line = np.array([(0, 0), (1, 0.005), (2, 0), (3, 5), (4, 0)], dtype=float)
    assert gb.simplify_points(line, 0.01, 2).tolist() == [[0, 0], [2, 0], [3, 5], [4, 0]]


def test_normalized_rings_are_equal(spark):
    texts = ["POLYGON ((0 0, 4 0, 4 4, 0 0))", "POLYGON ((4 4, 4 0, 0 0, 4 4))", "POLYGON ((4 0, 4 4, 0 0, 4 0))"]
    df = spark.createDataFrame([(t,) for t in texts], "t string").withColumn("g", wkt.parse(F.col("t")))
    assert df.select(shapes.normalize(F.col("g.rings")).alias("k")).distinct().count() == 1


def test_search_texts(spark):
    one = lambda c: spark.range(1).select(c.alias("v")).first().v
    assert one(wkt.scalar_text_to_wkt(F.lit("1,2,3"), "POINT")) == "POINT ERROR: Odd Coordinate Count"
    assert one(wkt.scalar_text_to_wkt(F.lit("1,,3,4"), "POINT")) == "POINT ERROR: Blank coordinate"
    assert one(wkt.list_text_to_wkt(F.array(F.lit("0,0,1,0,1,1,0,0")), "POLYGON")) == "MULTIPOLYGON (((0 0, 1 0, 1 1, 0 0)))"
    assert one(wkt.boxes_to_wkt(F.array(F.lit("-180,-90,180,90")))) == "POLYGON ((-180 -90, 180 -90, 180 90, -180 90, -180 -90))"
    assert one(wkt.boxes_to_wkt(F.array(F.lit("1,2,3")))) == wkt.BAD_BOX
    circle = one(wkt.circles(F.array(F.lit("-83,40,2000"))))
    assert (circle.wkt, circle.radius) == ("POINT (-83 40)", 2000)
