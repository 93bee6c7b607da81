"""Polygons over the antimeridian, cut into parts that stay within -180 to 180.

An edge longer than half the globe is taken to go the other way round, so a ring is unwrapped first: every longitude
moves by whole turns until it lies within 180 degrees of the one before. Holes move to the turn of their shell. The
unwrapped polygon is cut at 180 + 360 k, and each strip moves back by its turns. A cut works on all rings of a part at
once: the pieces of rings on one side of the line are joined along it, from where one leaves to where the next one
enters, so a concave polygon falls into several parts instead of parts bridged along the line; holes that the line does
not touch go to the part that holds them.

A ring that goes round a pole does not close when unwrapped; it is closed over the pole that its mean latitude is nearer to.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F

from granulake.functions import shapes
from granulake.functions.geometry_batch import Batch, _spread

TURN = 360.0


def unwrap(ring: np.ndarray) -> np.ndarray:
    """The ring with continuous longitudes; closed over a pole if it goes round one."""
    steps = np.diff(ring[:, 0])
    turns = np.concatenate([[0], np.cumsum(np.where(steps > TURN / 2, -1, np.where(steps < -TURN / 2, 1, 0)))])
    out = np.column_stack([ring[:, 0] + TURN * turns, ring[:, 1]])
    if out[0, 0] != out[-1, 0]:
        pole = 90.0 if ring[:-1, 1].mean() >= 0 else -90.0
        out = np.vstack([out, [out[-1, 0], pole], [out[0, 0], pole], out[0]])
    return out


def _twice_area(ring: np.ndarray) -> float:
    x, y = (ring - ring[0]).T
    return float(x[:-1] @ y[1:] - x[1:] @ y[:-1])


def _holds(shell: np.ndarray, point: np.ndarray) -> bool:
    (x1, y1), (x2, y2) = shell[:-1].T, shell[1:].T
    up = (y1 > point[1]) != (y2 > point[1])
    with np.errstate(divide="ignore", invalid="ignore"):
        at = x1 + (point[1] - y1) * (x2 - x1) / (y2 - y1)
    return bool((up & (point[0] < at)).sum() % 2)


def _chains(ring: np.ndarray, line: float, sign: float):
    """The stretches of a ring strictly on one side of the line, each from its entry to its exit on the line.

    None for a ring wholly on that side; it has no stretches.
    """
    here = sign * (ring[:-1, 0] - line) > 0
    if here.all():
        return None
    if not here.any():
        return []
    start = int(np.flatnonzero(here & ~np.roll(here, 1))[0])
    points, here = np.roll(ring[:-1], -start, axis=0), np.roll(here, -start)
    edges = np.flatnonzero(np.diff(here.astype(int)))
    begins, ends = np.concatenate([[0], edges[1::2] + 1]), edges[::2] + 1  # the last point is not on this side

    def on_line(a, b):
        share = (line - a[0]) / (b[0] - a[0])
        return np.array([line, a[1] + share * (b[1] - a[1])])

    out = []
    for begin, end in zip(begins, ends):
        body = points[begin:end]
        enter = on_line(points[begin - 1], body[0])
        leave = on_line(body[-1], points[end % len(points)])
        out.append(np.vstack([enter, body, leave]))
    return out


def _pairs(chains: list[np.ndarray]) -> dict[int, int]:
    """For each chain the one that begins where its own end is joined to along the line."""
    marks = sorted([(c[0, 1], 0, i) for i, c in enumerate(chains)] + [(c[-1, 1], 1, i) for i, c in enumerate(chains)])
    after, open_ = {}, []
    for _, is_exit, chain in marks:
        if open_ and open_[-1][0] != is_exit:
            other = open_.pop()[1]
            after[chain if is_exit else other] = other if is_exit else chain
        else:
            open_.append((is_exit, chain))
    return after


def half(rings: list[np.ndarray], line: float, sign: float) -> list[list[np.ndarray]]:
    """Polygons (shell, then holes) of one polygon on one side of a vertical line."""
    whole, chains = [], []
    for number, ring in enumerate(rings):
        # shells run left, holes right round, so that every exit has an entry beside it
        ring = ring if (_twice_area(ring) > 0) == (number == 0) else ring[::-1]
        found = _chains(ring, line, sign)
        if found is None:
            whole.append((number, ring))
        else:
            chains += found
    if not chains:
        return [[ring for _, ring in whole]] if whole and whole[0][0] == 0 else []
    after, left, shells = _pairs(chains), set(range(len(chains))), []
    while left:
        first = at = min(left)
        way = []
        while at in left:
            left.remove(at)
            way.append(chains[at])
            at = after[at]
        ring = np.vstack([*way, chains[first][:1]])
        shells.append(ring[np.concatenate([[True], (np.diff(ring, axis=0) != 0).any(axis=1)])])
    shells = [[s] for s in shells if len(s) > 3]
    for _, hole in whole:
        home = next((s for s in shells if _holds(s[0], hole[:-1].mean(axis=0)) or _holds(s[0], hole[0])), None)
        if home is not None:
            home.append(hole)
    return shells


def split_polygon(rings: list[np.ndarray]) -> list[list[np.ndarray]]:
    """Polygons within -180 to 180 of one polygon (shell, then holes, each closed)."""
    rings = [unwrap(r) for r in rings]
    shell = rings[0]
    middle = (shell[:, 0].min() + shell[:, 0].max()) / 2
    for i, hole in enumerate(rings[1:], 1):
        turns = np.round((middle - (hole[:, 0].min() + hole[:, 0].max()) / 2) / TURN)
        rings[i] = hole + [TURN * turns, 0.0]
    first = int(np.floor((shell[:, 0].min() + TURN / 2) / TURN))
    last = int(np.ceil((shell[:, 0].max() - TURN / 2) / TURN))
    out = []
    for k in range(first, last + 1):
        strips = [rings]
        if k > first:
            strips = [p for s in strips for p in half(s, TURN * k - TURN / 2, 1.0)]
        if k < last:
            strips = [p for s in strips for p in half(s, TURN * k + TURN / 2, -1.0)]
        out += [[ring - [TURN * k, 0.0] for ring in polygon] for polygon in strips]
    return out


# ---- many polygons at once -------------------------------------------------------------------


def _per_ring(values: np.ndarray, at: np.ndarray, how: np.ufunc) -> np.ndarray:
    return how.reduceat(values, at) if len(at) else values[:0]


def split_plain(batch: Batch, units: np.ndarray) -> tuple[np.ndarray, ...]:
    """`split_polygon` of the polygons that one line cuts, each ring into a stretch on either side at most: arrays for all.

    `units` is the first ring of each polygon and the number of rings; a shell stands before its holes. Returns which
    polygons are done, and for each ring made of them its polygon, its points and their number; every such ring is a
    shell. Polygons with other lines, poles, more stretches, holes wholly on one side or areas near 0 are left.
    """
    begin, count = units
    unit, number = _spread(count)
    ring = begin[unit] + number
    size = np.diff(batch.ring_at)[ring]
    left = np.bincount(unit[size < 4], minlength=len(count)) > 0  # polygons that are left to `split_polygon`
    some = ~left[unit]
    unit, number, ring, size = unit[some], number[some], ring[some], size[some]
    at = np.cumsum(size) - size
    of, place = _spread(size)
    xy = batch.xy[batch.ring_at[ring][of] + place]
    # unwrap
    steps = np.diff(xy[:, 0], prepend=0.0)
    turn = np.where(place == 0, 0, np.where(steps > TURN / 2, -1, np.where(steps < -TURN / 2, 1, 0)))
    turns = np.cumsum(turn)
    x, y = xy[:, 0] + TURN * (turns - turns[at][of]), xy[:, 1]
    np.logical_or.at(left, unit, (x[at] != x[at + size - 1]) | ~np.isfinite(_per_ring(x + y, at, np.add)))
    low, high = _per_ring(x, at, np.minimum), _per_ring(x, at, np.maximum)
    shell = np.zeros(len(count), np.int64)
    shell[unit[number == 0]] = np.flatnonzero(number == 0)
    middle = ((low + high) / 2)[shell[unit]]
    x = x + (TURN * np.where(number > 0, np.round((middle - (low + high) / 2) / TURN), 0.0))[of]
    first = np.floor((low[shell] + TURN / 2) / TURN)
    left |= np.ceil((high[shell] - TURN / 2) / TURN) != first + 1
    line = (TURN * first + TURN / 2)[unit][of]
    # shells run left, holes right round
    ahead = np.minimum(np.arange(len(x)) + 1, len(x) - 1)
    u, v = x - x[at][of], y - y[at][of]
    inner = place < size[of] - 1
    terms = np.where(inner, u * v[ahead] - u[ahead] * v, 0.0)
    twice = _per_ring(terms, at, np.add)
    np.logical_or.at(left, unit, np.abs(twice) <= 1e-9 * _per_ring(np.abs(terms), at, np.add))
    turned = ((twice > 0) != (number == 0))[of]
    source = at[of] + np.where(turned, size[of] - 1 - place, place)
    x, y = x[source], y[source]
    back = np.where(place == 0, at[of] + size[of] - 2, np.arange(len(x)) - 1)  # the vertex before, in a ring without its end
    sides = []
    for sign in (-1.0, 1.0):
        here = (sign * (x - line) > 0) & inner
        entry = here & ~here[back]
        stretches, inside = _per_ring(entry.astype(np.int64), at, np.add), _per_ring(here.astype(np.int64), at, np.add)
        # a ring on the other side has none; one wholly on this side has no entry
        np.logical_or.at(left, unit, (stretches > 1) | ((stretches == 0) & (inside > 0)))
        cut = np.flatnonzero(stretches == 1)
        left |= np.bincount(unit[cut], minlength=len(count)) > 2
        sides.append((cut, np.flatnonzero(entry), inside))
    out = []
    for side, (cut, entries, inside) in enumerate(sides):
        entries = entries[stretch_is_one(entries, of, cut, len(size))]
        some = ~left[unit[cut]]
        cut, entries = cut[some], entries[some]
        own, body, start, m = unit[cut], inside[cut], entries - at[cut], size[cut] - 1
        vertex = lambda n, c=cut, m=m: at[c] + n % m
        border = line[at[cut]]

        def on_line(a, b, border=border):
            share = (border - x[a]) / (x[b] - x[a])
            return y[a] + share * (y[b] - y[a])

        enter = on_line(vertex(start - 1), vertex(start))
        leave = on_line(vertex(start + body - 1), vertex(start + body))
        # of two stretches: each alone, or joined along the line; marks in order of place must be one entry, one exit
        one = np.flatnonzero(np.r_[True, own[1:] != own[:-1]]) if len(own) else own
        two = one[np.r_[np.diff(one), len(own) - one[-1]] == 2] if len(one) else one
        marks = np.column_stack([enter[two], enter[two + 1], leave[two], leave[two + 1]])
        order = np.lexsort((np.tile([0, 1, 0, 1], (len(two), 1)), np.tile([0, 0, 1, 1], (len(two), 1)), marks), axis=1) if len(two) else np.zeros((0, 4), int)
        exits, chain = order >= 2, order % 2
        odd = (exits[:, 0] == exits[:, 1]) | (exits[:, 2] == exits[:, 3])
        left[own[two[odd]]] = True
        joined = np.zeros(len(own), bool)
        joined[two] = chain[:, 0] != chain[:, 1]
        out.append((own, body, start, m, cut, border, enter, leave, joined))
    made = []
    for side, (own, body, start, m, cut, border, enter, leave, joined) in enumerate(out):
        second = np.r_[False, joined[:-1]] if len(joined) else joined
        head = np.arange(len(own)) - second  # the stretch that the ring begins with
        closes = ~joined
        # every ring: its stretches, then its first point again
        pieces = np.repeat(np.arange(len(own)), 1 + closes)
        end = np.r_[pieces[1:] != pieces[:-1], True] & closes[pieces] if len(pieces) else closes
        pieces = np.where(end, head[pieces], pieces)
        lengths = np.where(end, 1, body[pieces] + 2)
        ringno = np.cumsum(np.r_[0, end[:-1]]) if len(end) else pieces
        piece, place = _spread(lengths)
        c = pieces[piece]
        at_line = (place == 0) | (place == body[c] + 1)
        source = at[cut[c]] + (start[c] + place - 1) % m[c]
        k = first[own[c]] + side
        px = np.where(at_line, border[c], x[source]) - TURN * k
        py = np.where(place == 0, enter[c], np.where(at_line, leave[c], y[source]))
        of_ring = ringno[piece]
        new = np.r_[True, (of_ring[1:] != of_ring[:-1]) | (px[1:] != px[:-1]) | (py[1:] != py[:-1])] if len(px) else np.zeros(0, bool)
        px, py, of_ring = px[new], py[new], of_ring[new]
        points = np.bincount(of_ring, minlength=int(end.sum()))
        owner = own[pieces[end]]
        good = (points > 3) & ~left[owner]
        kept = good[of_ring]
        made.append((owner[good], np.column_stack([px, py])[kept], points[good]))
    owner, xy, points = (np.concatenate(v) for v in zip(*made))
    order = np.argsort(owner, kind="stable")
    starts = np.cumsum(points) - points
    item, place = _spread(points[order])
    return ~left, owner[order], xy[starts[order][item] + place], points[order]


def split_batch(batch: Batch) -> Batch:
    """Every polygon cut; most of them together (`split_plain`), the others one by one."""
    kinds = list(batch.kinds)
    # rings stand in order of row and part; a shell goes before its holes
    fresh = np.r_[True, (np.diff(batch.ring_row) != 0) | (np.diff(batch.ring_part) != 0)] if len(batch.ring_row) else np.zeros(0, bool)
    begin = np.flatnonzero(fresh)
    count = np.diff(np.r_[begin, len(fresh)])
    group = np.cumsum(fresh) - 1
    order = np.lexsort((batch.ring_hole, group))
    item, place = _spread(np.diff(batch.ring_at)[order])
    at = np.concatenate([[0], np.cumsum(np.diff(batch.ring_at)[order])])
    xy = batch.xy[batch.ring_at[order][item] + place]
    batch = Batch(kinds, xy, at, batch.ring_row[order], batch.ring_part[order], batch.ring_hole[order], batch.rows)
    done, unit, xy, points = split_plain(batch, (begin, count)) if len(begin) else (np.zeros(0, bool), begin, batch.xy, begin)
    polygon, hole = np.arange(len(unit)), np.zeros(len(unit), bool)
    rest = []
    for u in np.flatnonzero(~done):
        rings = range(begin[u], begin[u] + count[u])
        rest += [(u, n, i > 0, r) for n, p in enumerate(split_polygon([batch.xy[at[i] : at[i + 1]] for i in rings])) for i, r in enumerate(p)]
    if rest:
        xy = np.vstack([xy, *[r for *_, r in rest]])
        unit, polygon = np.r_[unit, [u for u, *_ in rest]], np.r_[polygon, [n for _, n, *_ in rest]]
        hole, points = np.r_[hole, [h for _, _, h, _ in rest]], np.r_[points, [len(r) for *_, r in rest]]
    # back into the order of polygons; parts of a row are numbered from 0
    starts = np.cumsum(points) - points
    order = np.argsort(unit, kind="stable")
    unit, polygon, hole, points, starts = (v[order] for v in (unit, polygon, hole, points, starts))
    row = batch.ring_row[begin[unit]]
    shells = np.cumsum(~hole)
    before = np.searchsorted(row, row)  # the row's first ring
    part = shells - shells[before] if len(row) else row
    parts = np.bincount(row[~hole], minlength=batch.rows)
    for r in np.flatnonzero(parts > 1):
        kinds[r] = "MultiPolygon"
    item, place = _spread(points)
    return Batch(kinds, xy[starts[item] + place], np.concatenate([[0], np.cumsum(points)]), row, part, hole, batch.rows)


def stretch_is_one(entries: np.ndarray, of: np.ndarray, cut: np.ndarray, rings: int) -> np.ndarray:
    """Which entries are of rings with one stretch."""
    single = np.zeros(rings, bool)
    single[cut] = True
    return single[of[entries]]


def crosses(rings: Column) -> Column:
    """Some edge is longer than half the globe, or some vertex lies beyond it."""
    far = lambda xs: F.exists(xs, lambda x: F.abs(x) > TURN / 2)
    steps = lambda xs: F.zip_with(F.slice(xs, 2, F.greatest(F.size(xs) - 1, F.lit(0))), xs, lambda a, b: F.abs(a - b))
    return F.exists(rings, lambda r: far(r["xs"]) | F.exists(steps(r["xs"]), lambda d: d > TURN / 2))


def split(kind: Column, rings: Column) -> Column:
    """struct (kind, rings) with every polygon over the antimeridian cut there.

    Columns decide which rows cross; the others never leave the JVM. Points and lines stay as they are.
    """
    over = kind.isin(*shapes.AREAL) & F.coalesce(crosses(rings), F.lit(False))
    whole = F.when(kind.isNotNull() & rings.isNotNull(), F.struct(kind.alias("kind"), rings.alias("rings")))

    @F.arrow_udf(shapes.GEOMETRY_DDL)
    def run(v: pa.Array) -> pa.Array:
        batch = Batch.from_rings(v)
        return split_batch(batch).to_arrow()

    return F.when(over, run(F.when(over, whole))).otherwise(whole)
