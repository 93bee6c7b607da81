"""Polygons over the antimeridian: areas, parts, holes, poles, and rows that need no cut."""

import numpy as np
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from granulake.functions import meridian, shapes
from granulake.functions.geometry_batch import Batch


def area(polygons):
    return sum(abs(meridian._twice_area(r)) * (-1 if i else 1) for p in polygons for i, r in enumerate(p)) / 2


def closed(*points):
    return np.array([*points, points[0]], dtype=float)


def box(w, s, e, n):
    return closed((w, s), (e, s), (e, n), (w, n))


def test_box_becomes_two():
    got = meridian.split_polygon([box(170, 0, -160, 10)])
    assert len(got) == 2 and all(len(p) == 1 and len(p[0]) == 5 for p in got)
    assert [(p[0][:, 0].min(), p[0][:, 0].max()) for p in got] == [(170, 180), (-180, -160)] and area(got) == 300


def test_concave_ring_falls_into_three_parts():
    """A letter U on its side: two arms over the line, its back on one side."""
    ring = closed((170, 0), (190, 0), (190, 2), (175, 2), (175, 8), (190, 8), (190, 10), (170, 10))
    for turned in (ring, ring[::-1], np.column_stack([(ring[:, 0] + 180) % 360 - 180, ring[:, 1]])):
        got = meridian.split_polygon([turned])
        assert len(got) == 3 and abs(area(got) - 110) < 1e-9
        assert sorted(abs(meridian._twice_area(p[0])) / 2 for p in got) == [20, 20, 70]


def test_holes_go_with_their_part():
    shell = box(170, 0, 190, 20)
    left, right, across = box(172, 2, 174, 4), box(-178, 2, -176, 4), box(178, 10, 182, 14)
    got = meridian.split_polygon([shell, left, right, across])
    assert [len(p) for p in got] == [2, 2] and abs(area(got) - (400 - 4 - 4 - 16)) < 1e-9
    assert got[0][1][:, 0].min() == 172 and got[1][1][:, 0].min() == -178


def test_hole_from_edge_to_edge_cuts_the_line_twice():
    got = meridian.split_polygon([box(170, 0, 190, 20), box(175, 5, 185, 15)])
    assert [len(p) for p in got] == [1, 1] and abs(area(got) - 300) < 1e-9


def test_ring_round_a_pole_is_closed_over_it():
    ring = closed(*[(x, 60) for x in (-135, -45, 45, 135)])
    got = meridian.split_polygon([ring])
    assert abs(area(got) - 360 * 30) < 1e-6 and max(p[0][:, 1].max() for p in got) == 90
    assert min(p[0][:, 0].min() for p in got) == -180 and max(p[0][:, 0].max() for p in got) == 180


def test_vertices_on_the_line():
    touching = closed((170, 0), (180, 5), (170, 10))
    assert len(meridian.split_polygon([touching])) == 1
    got = meridian.split_polygon([closed((175, 0), (180, -5), (185, 0), (180, 5))])
    assert len(got) == 2 and abs(area(got) - 50) < 1e-9 and [len(p[0]) for p in got] == [4, 4]


@settings(max_examples=150, deadline=None)
@given(st.lists(st.floats(0.5, 30), min_size=3, max_size=24), st.floats(-200, 200), st.booleans())
def test_stars_keep_their_area(radii, x, turned):
    angle = np.arange(len(radii)) * 2 * np.pi / len(radii)
    ring = closed(*np.column_stack([x + np.array(radii) * np.cos(angle), np.array(radii) * np.sin(angle)]))
    ring = ring[::-1] if turned else ring
    folded = np.column_stack([(ring[:, 0] + 180) % 360 - 180, ring[:, 1]])
    got = meridian.split_polygon([folded])
    assert abs(area(got) - abs(meridian._twice_area(ring)) / 2) < 1e-6
    assert all((np.abs(r[:, 0]) <= 180 + 1e-9).all() and (r[0] == r[-1]).all() for p in got for r in p)


def test_columns(spark):
    rows = [
        ("Polygon", [(0, False, [170.0, -170.0, -170.0, 170.0, 170.0], [0.0, 0.0, 5.0, 5.0, 0.0])]),
        ("Polygon", [(0, False, [1.0, 2.0, 2.0, 1.0], [0.0, 0.0, 5.0, 0.0])]),
        ("LineString", [(0, False, [170.0, -170.0], [0.0, 1.0])]),
        ("Point", [(0, False, [170.0], [0.0])]),
        ("Polygon", []),
        (None, None),
    ]
    df = spark.createDataFrame(rows, f"kind string, rings {shapes.RINGS_DDL}")
    got = df.select(meridian.split(F.col("kind"), F.col("rings")).alias("g")).collect()
    assert got[0].g.kind == "MultiPolygon" and [r.part for r in got[0].g.rings] == [0, 1]
    for (kind, rings), r in list(zip(rows, got))[1:5]:
        assert (r.g.kind, [tuple(x) for x in r.g.rings]) == (kind, rings)
    assert got[5].g is None


def packed(rows):
    """Rows of polygons (shell, then holes) as a batch."""
    rings = [(i, n, k > 0, ring) for i, polygons in enumerate(rows) for n, p in enumerate(polygons) for k, ring in enumerate(p)]
    kinds = ["Polygon" if len(p) == 1 else "MultiPolygon" for p in rows]
    return Batch._pack(kinds, [r for *_, r in rings], *[[x[k] for x in rings] for k in range(3)], len(rows))


def one_by_one(rows):
    cut = [[q for p in polygons for q in meridian.split_polygon(p)] for polygons in rows]
    out = packed(cut)
    out.kinds = [k if len(q) < 2 else "MultiPolygon" for k, q in zip(packed(rows).kinds, cut)]
    return out


def test_a_batch_is_cut_like_its_polygons():
    rng = np.random.default_rng(3)

    def star(x, n, size, grid):
        angle = np.sort(rng.uniform(0, 2 * np.pi, n))
        points = np.column_stack([x, 0]) + size * rng.uniform(0.4, 1, (n, 1)) * np.column_stack([np.cos(angle), np.sin(angle)])
        points = np.round(points / 5) * 5 if grid else points  # vertices on the line, areas of 0, rings that touch
        return closed(*points[:: rng.choice([-1, 1])])

    rows = []
    for i in range(1500):
        polygons = []
        for _ in range(1 + (rng.random() < 0.2)):
            x = 180 + rng.uniform(-12, 12)
            rings = [star(x, rng.integers(3, 9), 15, i % 3 == 0), *[star(x + rng.uniform(-4, 4), 4, 3, i % 3 == 0) for _ in range(rng.integers(0, 3))]]
            polygons.append([np.column_stack([(r[:, 0] + 180) % 360 - 180 if i % 2 else r[:, 0], r[:, 1]]) for r in rings])
        rows.append(polygons)
    rows += [[[closed(*[(x, 60) for x in (-135, -45, 45, 135)])]], [], [[box(170, 0, 550, 9)]]]
    got, expected = meridian.split_batch(packed(rows)), one_by_one(rows)
    assert got.kinds == expected.kinds
    for name in ("xy", "ring_at", "ring_row", "ring_part", "ring_hole"):
        assert np.array_equal(getattr(got, name), getattr(expected, name))


def test_plain_polygons_do_not_go_one_by_one(monkeypatch):
    def triangle(x, y, d, turn):
        return closed((x, y), (x + d, y), (x, y + d))[::turn]

    rows = [[[triangle(180 - d * q / 4, 3 * q, d, 1), triangle(180 - d * q / 4 + d / 8, 3 * q + d / 8, d / 2, -1)][: 1 + (q == 1)]] for d in range(2, 9) for q in (1, 2, 3)]
    expected, single, asked = one_by_one(rows), meridian.split_polygon, []
    monkeypatch.setattr(meridian, "split_polygon", lambda rings: asked.append(1) or single(rings))
    got = meridian.split_batch(packed(rows))
    assert np.array_equal(got.xy, expected.xy) and not asked  # before: every polygon
