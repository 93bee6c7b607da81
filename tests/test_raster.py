"""Raster of a query shape, prepared edges and pair tests against plain tests."""

import math
import random

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from granulake.functions import geometry_batch as gb
from granulake.functions import raster, shapes
from granulake.operators import search

rng = random.Random(11)


def ring(points):
    return np.array([*points, points[0]], dtype=float)


def star(cx, cy, size, n):
    angles = sorted(rng.uniform(0, 2 * math.pi) for _ in range(n))
    return [(cx + math.cos(a) * size * rng.uniform(0.3, 1), cy + math.sin(a) * size * rng.uniform(0.3, 1)) for a in angles]


def square(w, s, e, n):
    return ring([(w, s), (e, s), (e, n), (w, n)])


#: Two parts; the first has a hole with an island's worth of room.
HOLED = gb.write_wkb(
    "MultiPolygon",
    [(0, False, ring(star(0, 0, 30, 120))), (0, True, square(-4, -4, 4, 4)), (1, False, square(40, -8, 52, 10))],
)


def boxes(n=4000):
    out = []
    for _ in range(n):
        w, s, size = rng.uniform(-40, 60), rng.uniform(-40, 40), 10 ** rng.uniform(-3, 1.7)
        out.append((w, s, w + size * rng.random(), s + size * rng.random()))
    # boxes on cell edges, points, and boxes in the hole
    return [*out, (-3.0, -3.0, 3.0, 3.0), (0.0, 0.0, 0.0, 0.0), (40.0, -8.0, 52.0, 10.0), (52.0, 0.0, 53.0, 1.0), (-100.0, -80.0, 100.0, 80.0)]


def table(spark, rows):
    df = spark.createDataFrame([(i, *map(float, b)) for i, b in enumerate(rows)], "id long, w double, s double, e double, n double")
    rings = shapes.box_rings(*[F.col(c) for c in "wsen"])
    return df.withColumn("geometry", F.struct(F.lit("Polygon").alias("kind"), rings.alias("rings")))


def exact(rows, wkb):
    blobs = [gb.write_wkb("Polygon", [(0, False, square(*b))]) for b in rows]
    return gb.intersects(gb.Batch.from_wkb(pa.array(blobs, pa.binary())), gb.literal(wkb))


SHAPES = {
    "holed": HOLED,
    "many": gb.write_wkb("Polygon", [(0, False, ring(star(5, 5, 28, 900)))]),
    "line": gb.write_wkb("LineString", [(0, False, np.array([(-30.0, -30.0), (0.0, 5.0), (50.0, 5.0)]))]),
    "box": gb.write_wkb("Polygon", [(0, False, square(-20, -10, 30, 20))]),
}


@pytest.mark.parametrize("name", SHAPES)
def test_marks_decide_right(spark, name):
    rows, wkb = boxes(), SHAPES[name]
    df = table(spark, rows).withColumn("mark", raster.label(raster.Raster(wkb).mark(tuple("wsen"))))
    marks = {r.id: r.mark for r in df.select("id", "mark").collect()}
    truth = exact(rows, wkb)
    assert not [i for i, m in marks.items() if m == "outside" and truth[i]]
    assert not [i for i, m in marks.items() if m == "inside" and not truth[i]]
    found = {r.id for r in search.intersects(table(spark, rows), wkb, columns=tuple("wsen")).select("id").collect()}
    assert found == set(np.flatnonzero(truth).tolist())
    if name == "holed":
        counts = {m: sum(x == m for x in marks.values()) for m in ("inside", "border", "outside")}
        assert counts["border"] < counts["inside"] + counts["outside"]


def test_only_border_geometries_reach_the_exact_test(spark):
    rows = boxes(1500)
    df = table(spark, rows)
    marks = search.raster_marks(df, HOLED, tuple("wsen")).groupBy("mark").count().collect()
    border = next(r["count"] for r in marks if r.mark == "border")
    seen = spark.sparkContext.accumulator(0)
    plain = gb._predicate

    def counting(test, query):
        def counted(batch, q):
            seen.add(sum(k is not None for k in batch.kinds))
            return test(batch, q)

        return plain(counted, query)

    gb._predicate = counting
    try:
        search.intersects(df, HOLED, columns=tuple("wsen")).select("id").collect()
    finally:
        gb._predicate = plain
    assert seen.value == border


def test_null_boxes_and_geometries(spark):
    df = table(spark, boxes(20)).withColumn("w", F.when(F.col("id") % 3 > 0, F.col("w")))
    df = df.withColumn("geometry", F.when(F.col("id") % 2 > 0, F.col("geometry")))
    got = search.intersects(df, HOLED, columns=tuple("wsen")).select("id").collect()
    assert all(r.id % 3 and r.id % 2 for r in got)


def test_pairs_and_prepared_edges():
    left = [gb.write_wkb("Polygon", [(0, False, ring(star(rng.uniform(-6, 6), rng.uniform(-6, 6), rng.uniform(0.5, 5), rng.randint(3, 9))))]) for _ in range(400)]
    right = [gb.write_wkb("Polygon", [(0, False, ring(star(0, 0, 4, rng.randint(3, 40)))), (0, True, square(-0.2, -0.2, 0.2, 0.2))]) for _ in range(398)]
    right += [None, gb.write_wkb("Point", [(0, False, np.array([[0.0, 0.0]]))])]
    read = lambda blobs: gb.Batch.from_wkb(pa.array(blobs, pa.binary()))
    a, b = read(left), read(right)
    got = gb.intersects_pairs(a, b)
    want = [False if right[i] is None else bool(gb.intersects(a.single(i), b.single(i))[0]) for i in range(400)]
    assert got.tolist() == want and 50 < sum(want) < 390
    edges, _ = a.edges()
    shape = gb.Prepared(gb.literal(SHAPES["many"]))
    assert (shape.touched(edges) == gb._touching(edges, shape.edges).any(axis=1)).all()
    points = edges[:, :2] * 5
    assert (shape.inside(points) == (gb._crosses_ray(points, shape.edges).sum(axis=1) % 2 == 1)).all()
