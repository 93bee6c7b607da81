"""Simplification that keeps topology: valid rings stay valid and every lost vertex is near what stays."""

import time

import numpy as np
from hypothesis import given, settings
from hypothesis import strategies as st

from granulake.functions.geometry_batch import Batch, Obstacles, simplified, simplify_points


def closed(points):
    points = np.asarray(points, dtype=float)
    return np.vstack([points, points[:1]])


def crossings(*rings):
    """Pairs of edges that share a point and are not neighbours in a ring, by a plain loop."""
    edges = [(r, i, ring[i], ring[i + 1], len(ring) - 1) for r, ring in enumerate(rings) for i in range(len(ring) - 1)]
    turn = lambda a, b, c: np.sign((b[0] - a[0]) * (c[1] - a[1]) - (b[1] - a[1]) * (c[0] - a[0]))
    found = 0
    for n, (r, i, a, b, size) in enumerate(edges):
        for q, j, c, d, _ in edges[n + 1 :]:
            if r == q and (j - i in (1, size - 1)):
                continue
            found += turn(a, b, c) * turn(a, b, d) < 0 and turn(c, d, a) * turn(c, d, b) < 0
    return found


def slim(rings, tolerance):
    obstacles = Obstacles(np.vstack(rings))
    return [simplify_points(r, tolerance, 4, obstacles) for r in rings]


def distance(points, ring):
    a, d = ring[:-1], np.diff(ring, axis=0)
    t = np.clip(((points[:, None] - a) * d).sum(2) / np.maximum((d * d).sum(1), 1e-300), 0, 1)
    return np.hypot(*np.moveaxis(points[:, None] - a - t[..., None] * d, 2, 0)).min(axis=1)


# a deep dent whose rim is flat within the tolerance, and a finger from the other side that reaches through the rim
RIM = closed([(0, 0), (4, 0.0), (5, -0.9), (6, 0.0), (10, 0), (10, 10), (5.4, 10), (5, -0.5), (4.6, 10), (0, 10)])


def test_plain_reduction_crosses_itself_and_this_one_does_not():
    assert crossings(RIM) == 0
    assert crossings(simplify_points(RIM, 1.0, 4)) > 0
    got = slim([RIM], 1.0)[0]
    assert crossings(got) == 0 and len(got) < len(RIM)


def test_without_obstacles_near_the_distance_alone_counts():
    ring = closed([(0, 0), (5, -0.5), (10, 0), (10, 10), (0, 10)])
    assert len(slim([ring], 1.0)[0]) == 5 and len(slim([ring], 0.1)[0]) == 6


def test_hole_in_a_bulge_stays_inside():
    shell, hole = closed([(0, 0), (5, -0.9), (10, 0), (10, 10), (0, 10)]), closed([(4.8, -0.2), (5.2, -0.2), (5, -0.5)])
    assert len(slim([shell, hole], 1.0)[0]) == 6 and len(simplify_points(shell, 1.0, 4)) == 5


def test_hole_that_touches_the_chord_counts():
    shell, hole = closed([(0, 0), (5, -0.9), (10, 0), (10, 10), (0, 10)]), closed([(4.8, 1), (5.2, 1), (5, 0)])
    assert len(slim([shell, hole], 1.0)[0]) == 6


def test_vertices_beside_the_bulge_do_not_hold_it():
    shell, island = closed([(0, 0), (5, -0.9), (10, 0), (10, 10), (0, 10)]), closed([(0.5, -0.8), (0.9, -0.8), (0.7, -0.7)])
    assert len(slim([shell, island], 1.0)[0]) == 5


@settings(max_examples=200, deadline=None)
@given(st.lists(st.floats(1, 10), min_size=5, max_size=40), st.floats(0.01, 6))
def test_stars_stay_valid(radii, tolerance):
    angle = np.arange(len(radii)) * 2 * np.pi / len(radii)
    shell = closed(np.column_stack([np.array(radii) * np.cos(angle), np.array(radii) * np.sin(angle)]))
    hole = shell * 0.8
    got = slim([shell, hole], tolerance)
    assert crossings(*got) == 0
    for before, after in zip((shell, hole), got):
        assert (distance(before, after) <= tolerance + 1e-9).all() and len(after) >= 4


def packed(rows, kinds):
    pieces = [ring for rings in rows for ring in rings]
    of_row = [i for i, rings in enumerate(rows) for _ in rings]
    return Batch._pack(kinds, pieces, of_row, [0] * len(pieces), [False] * len(pieces), len(rows))


def test_a_batch_is_simplified_like_its_rings():
    rng = np.random.default_rng(4)
    rows, kinds = [], []
    for i in range(900):
        n = rng.integers(1, 30, rng.integers(0, 4))
        # every third row on a coarse grid: equal distances, repeated vertices, points on edges
        points = [rng.integers(0, 4, (k, 2)).astype(float) if i % 3 == 0 else rng.normal(size=(k, 2)).cumsum(axis=0) for k in n]
        rows.append([closed(p) if i % 2 else p for p in points])
        kinds.append("Polygon" if i % 2 else "MultiLineString" if rng.random() < 0.9 else None)
    batch = packed(rows, kinds)
    for tolerance in (0.0, 0.3, 1.0, 5.0):
        for topology in (False, True):
            keep = simplified(batch, tolerance, topology)
            at = iter(range(len(batch.ring_row)))
            for rings, kind in zip(rows, kinds):
                obstacles = Obstacles(np.vstack(rings)) if topology and rings else None
                for ring in rings:
                    i = next(at)
                    here = slice(batch.ring_at[i], batch.ring_at[i + 1])
                    expected = simplify_points(ring, tolerance, 4 if kind == "Polygon" else 2, obstacles)
                    assert np.array_equal(batch.xy[here][keep[here]], expected)


def test_many_small_rows_are_simplified_together():
    rows = [[closed([(x, 0), (x + 5, -0.008), (x + 10, 0), (x + 10, 10), (x, 10)])] for x in range(4000)]
    batch = packed(rows, ["Polygon"] * 4000)
    began = time.thread_time()
    keep = simplified(batch, 0.01, True)
    took = time.thread_time() - began
    began = time.thread_time()
    one_by_one = [slim(rings, 0.01)[0] for rings in rows]
    assert np.array_equal(batch.xy[keep], np.vstack(one_by_one)) and took < (time.thread_time() - began) / 3
