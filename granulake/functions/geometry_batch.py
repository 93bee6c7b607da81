"""Arrow-batched geometry work: WKB in and out, exact predicates, simplification.

A batch keeps the coordinates of all its rows in flat arrays with ring and row offsets, so the
predicates run over all edges of a batch at once. Only these steps leave the JVM.
"""

from __future__ import annotations

import struct

import numpy as np
import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F

from granulake.functions import shapes

# WKB type codes.
WKB_KINDS = {
    1: "Point",
    2: "LineString",
    3: "Polygon",
    4: "MultiPoint",
    5: "MultiLineString",
    6: "MultiPolygon",
}
WKB_CODES = {kind: code for code, kind in WKB_KINDS.items()}
MEMBER = {4: 1, 5: 2, 6: 3}

RING_TYPE = pa.struct(
    [
        ("part", pa.int32()),
        ("hole", pa.bool_()),
        ("xs", pa.list_(pa.float64())),
        ("ys", pa.list_(pa.float64())),
    ]
)
GEOMETRY_TYPE = pa.struct([("kind", pa.string()), ("rings", pa.list_(RING_TYPE))])

# Edge-pair tests held in memory at a time.
PAIR_BLOCK = 4_000_000


class Batch:
    """Flat coordinates: `xy` (n, 2); ring i covers xy[ring_at[i]:ring_at[i+1]]."""

    def __init__(self, kinds, xy, ring_at, ring_row, ring_part, ring_hole, rows):
        self.kinds = kinds
        self.xy = xy
        self.ring_at = ring_at
        self.ring_row = ring_row
        self.ring_part = ring_part
        self.ring_hole = ring_hole
        self.rows = rows

    # -- from and to Arrow ---------------------------------------------------------------

    @classmethod
    def from_wkb(cls, blobs: pa.Array) -> "Batch":
        """Plain points, lines and polygons are read by offsets into the column's buffer, other values one by one."""
        batch, plain = _read_plain(blobs)
        rest = np.flatnonzero(~plain & np.asarray(blobs.is_valid()))
        if not len(rest):
            return batch
        kinds, pieces, ring_row, ring_part, ring_hole = batch.kinds, [], [], [], []
        for row, blob in zip(rest.tolist(), blobs.take(pa.array(rest)).to_pylist()):
            shape = read_wkb(blob)
            kinds[row] = shape[0] if shape else None
            for part, hole, points in shape[1] if shape else ():
                pieces.append(points)
                ring_row.append(row)
                ring_part.append(part)
                ring_hole.append(hole)
        other = cls._pack(kinds, pieces, ring_row, ring_part, ring_hole, len(blobs))
        both = [np.concatenate(x) for x in zip(batch._rings(), other._rings())]
        order = np.argsort(both[1], kind="stable")
        sizes, ring_row, ring_part, ring_hole = (x[order] for x in both)
        begin = (np.cumsum(both[0]) - both[0])[order]
        at = np.concatenate([[0], np.cumsum(sizes)])
        xy = np.concatenate([batch.xy, other.xy])[np.repeat(begin - at[:-1], sizes) + np.arange(at[-1])]
        return cls(kinds, xy, at, ring_row, ring_part, ring_hole, len(blobs))

    def _rings(self):
        return np.diff(self.ring_at), self.ring_row, self.ring_part, self.ring_hole

    def to_wkb(self) -> pa.Array:
        """Little-endian WKB; points, lines and polygons are laid out by offsets, other kinds one by one."""
        sizes, counts = np.diff(self.ring_at), np.bincount(self.ring_row, minlength=self.rows)
        codes = np.array([WKB_CODES.get(k, 0) for k in self.kinds], dtype=np.int64)
        lone = np.bincount(self.ring_row, sizes, minlength=self.rows)
        plain = ((codes == 1) & (counts == 1) & (lone == 1)) | ((codes == 2) & (counts == 1)) | (codes == 3)
        others = np.flatnonzero(~plain & (codes > 0))
        written = {}
        if len(others):
            ends = np.searchsorted(self.ring_row, [others, others + 1])
            for row, first, last in zip(others.tolist(), *ends.tolist()):
                rings = [(self.ring_part[i], self.ring_hole[i], self.xy[self.ring_at[i] : self.ring_at[i + 1]]) for i in range(first, last)]
                written[row] = write_wkb(self.kinds[row], rings)
        areal, pointed = codes == 3, codes == 1
        length = np.where(plain, np.where(pointed, 5, 9), 0)
        length += np.where(plain, np.bincount(self.ring_row, 16 * sizes + 4 * areal[self.ring_row], self.rows), 0).astype(np.int64)
        for row, value in written.items():
            length[row] = len(value)
        at = np.concatenate([[0], np.cumsum(length)])
        out = np.zeros(at[-1], np.uint8)

        def put(places, values, dtype):
            if len(places):
                raw = np.ascontiguousarray(values, dtype=dtype).view(np.uint8).reshape(len(places), -1)
                out[places[:, None] + np.arange(raw.shape[1])] = raw

        rows = np.flatnonzero(plain)
        out[at[:-1][rows]] = 1
        put(at[:-1][rows] + 1, codes[rows], "<u4")
        counted = rows[~pointed[rows]]
        put(at[:-1][counted] + 5, np.where(areal, counts, lone)[counted], "<u4")
        ring = np.flatnonzero(plain[self.ring_row])
        row, size = self.ring_row[ring], sizes[ring]
        took = 16 * size + 4 * areal[row]
        before = np.cumsum(took) - took
        begin = before - before[np.searchsorted(row, row)] + at[:-1][row] + np.where(pointed[row], 5, 9) + 4 * areal[row]
        put(begin[areal[row]] - 4, size[areal[row]], "<u4")
        point = np.repeat(self.ring_at[:-1][ring] - (np.cumsum(size) - size), size) + np.arange(size.sum())
        place = np.repeat(begin - 16 * (np.cumsum(size) - size), size) + 16 * np.arange(size.sum())
        put(place, self.xy[point], "<f8")
        for row, value in written.items():
            out[at[row] : at[row + 1]] = np.frombuffer(value, np.uint8)
        if at[-1] > 2**31 - 1:
            raise ValueError("a batch of geometries exceeds 2 GB")
        return pa.Array.from_buffers(
            pa.binary(), self.rows, [_validity(codes > 0), pa.py_buffer(at.astype(np.int32)), pa.py_buffer(out)]
        )

    @classmethod
    def from_rings(cls, column: pa.StructArray) -> "Batch":
        kinds = column.field("kind").to_pylist()
        valid = np.asarray(column.is_valid())
        lists = column.field("rings")
        rings = lists.flatten()
        sizes = np.asarray(lists.value_lengths().fill_null(0), dtype=np.int64)
        ring_row = np.repeat(np.arange(len(column)), sizes)
        xs = rings.field("xs")
        at = np.concatenate([[0], np.cumsum(np.asarray(xs.value_lengths().fill_null(0), dtype=np.int64))])
        x = np.asarray(xs.flatten(), dtype=float)
        y = np.asarray(rings.field("ys").flatten(), dtype=float)
        kinds = [k if ok else None for k, ok in zip(kinds, valid)]
        return cls(
            kinds,
            np.column_stack([x, y]) if len(x) else np.empty((0, 2)),
            at,
            ring_row,
            np.asarray(rings.field("part"), dtype=np.int64),
            np.asarray(rings.field("hole")).astype(bool),
            len(column),
        )

    @classmethod
    def _pack(cls, kinds, pieces, ring_row, ring_part, ring_hole, rows) -> "Batch":
        sizes = [len(p) for p in pieces]
        return cls(
            kinds,
            np.concatenate(pieces) if pieces else np.empty((0, 2)),
            np.concatenate([[0], np.cumsum(sizes, dtype=np.int64)]),
            np.asarray(ring_row, dtype=np.int64),
            np.asarray(ring_part, dtype=np.int64),
            np.asarray(ring_hole, dtype=bool),
            rows,
        )

    def to_arrow(self) -> pa.StructArray:
        at = pa.array(self.ring_at, pa.int32())
        xs = pa.ListArray.from_arrays(at, pa.array(self.xy[:, 0]))
        ys = pa.ListArray.from_arrays(at, pa.array(self.xy[:, 1]))
        ring = pa.StructArray.from_arrays(
            [pa.array(self.ring_part, pa.int32()), pa.array(self.ring_hole, pa.bool_()), xs, ys], fields=list(RING_TYPE)
        )
        counts = np.bincount(self.ring_row, minlength=self.rows) if self.rows else np.zeros(0, dtype=np.int64)
        offsets = pa.array(np.concatenate([[0], np.cumsum(counts)]), pa.int32())
        missing = pa.array([k is None for k in self.kinds], pa.bool_())
        return pa.StructArray.from_arrays(
            [pa.array(self.kinds, pa.string()), pa.ListArray.from_arrays(offsets, ring)],
            fields=list(GEOMETRY_TYPE),
            mask=missing,
        )

    # -- edges ---------------------------------------------------------------------------

    def edges(self):
        """Segments (x1, y1, x2, y2) and their rows; a lone vertex is a segment of length 0."""
        sizes = np.diff(self.ring_at)
        starts = np.ones(len(self.xy), dtype=bool)
        last = self.ring_at[1:][sizes > 0] - 1
        starts[last] = False
        first = np.flatnonzero(starts)
        segments = np.hstack([self.xy[first], self.xy[first + 1]]) if len(first) else np.empty((0, 4))
        vertex_row = np.repeat(self.ring_row, sizes)
        rows = vertex_row[first]
        lone = self.ring_at[:-1][sizes == 1]
        points = self.xy[lone]
        return np.vstack([segments, np.hstack([points, points])]), np.concatenate([rows, vertex_row[lone]])

    def first_vertices(self):
        filled = np.diff(self.ring_at) > 0
        return self.xy[self.ring_at[:-1][filled]], self.ring_row[filled]

    def areal(self) -> np.ndarray:
        return np.array([k in shapes.AREAL for k in self.kinds], dtype=bool)

    def single(self, row: int) -> "Batch":
        keep = np.arange(*np.searchsorted(self.ring_row, [row, row + 1]))
        pieces = [self.xy[self.ring_at[i] : self.ring_at[i + 1]] for i in keep]
        return Batch._pack(
            [self.kinds[row]], pieces, [0] * len(keep), self.ring_part[keep], self.ring_hole[keep], 1
        )


# ---- WKB -----------------------------------------------------------------------------------


def _validity(known: np.ndarray):
    return pa.py_buffer(np.packbits(known, bitorder="little"))


def _read_plain(blobs: pa.Array) -> tuple[Batch, np.ndarray]:
    """Rows that are little-endian points, lines or polygons of two dimensions, and which they are; the rest is left empty.

    Polygons are walked ring by ring, all rows at once, so the rounds are as many as the rings of the row with most.
    """
    blobs = blobs.cast(pa.large_binary())
    rows = len(blobs)
    _, offsets, data = blobs.buffers()
    at = np.frombuffer(offsets, np.int64, rows + 1, 8 * blobs.offset) if rows else np.zeros(1, np.int64)
    raw = np.frombuffer(data, np.uint8) if data is not None and data.size else np.zeros(0, np.uint8)
    begin, end = at[:-1], at[1:]

    def numbers(places):
        return raw[places[:, None] + np.arange(4)].view("<u4")[:, 0].astype(np.int64)

    some = np.flatnonzero(np.asarray(blobs.is_valid()) & (end - begin >= 9))
    some = some[raw[begin[some]] == 1]
    code = np.zeros(rows, np.int64)
    code[some] = numbers(begin[some] + 1)
    plain = (code == 1) & (end - begin == 21)
    ring_row, ring_at, ring_size, ring_no = [np.flatnonzero(plain)], [begin[plain] + 5], [np.ones(plain.sum(), np.int64)], []
    ring_no.append(np.zeros(plain.sum(), np.int64))
    lines = np.flatnonzero(code == 2)
    count = numbers(begin[lines] + 5)
    whole = (end - begin)[lines] == 9 + 16 * count
    plain[lines[whole]] = True
    filled = whole & (count > 0)
    for parts, values in zip((ring_row, ring_at, ring_size, ring_no), (lines, begin[lines] + 9, count, 0 * count)):
        parts.append(values[filled])
    left = np.flatnonzero(code == 3)
    rings, place, number = numbers(begin[left] + 5), begin[left] + 9, 0
    while len(left):
        done = rings == number
        plain[left[done & (place == end[left])]] = True
        going = ~done & (place + 4 <= end[left])
        left, rings, place = left[going], rings[going], place[going]
        size = numbers(place)
        fits = place + 4 + 16 * size <= end[left]
        left, rings, place, size = left[fits], rings[fits], place[fits], size[fits]
        for parts, values in zip((ring_row, ring_at, ring_size, ring_no), (left, place + 4, size, np.full(len(left), number))):
            parts.append(values)
        place, number = place + 4 + 16 * size, number + 1
    row, start, size, number = (np.concatenate(x) for x in (ring_row, ring_at, ring_size, ring_no))
    keep = plain[row]
    # a point of NaN is empty
    order = np.flatnonzero(keep)[np.lexsort((number[keep], row[keep]))]
    row, start, size, number = row[order], start[order], size[order], number[order]
    places = np.repeat(start - 16 * (np.cumsum(size) - size), size) + 16 * np.arange(size.sum())
    xy = raw[places[:, None] + np.arange(16)].view("<f8").astype(float) if len(places) else np.empty((0, 2))
    ring_at = np.concatenate([[0], np.cumsum(size)])
    empty = np.zeros(len(row), bool)
    single = np.flatnonzero(code[row] == 1)
    empty[single] = np.isnan(xy[ring_at[:-1][single]]).all(axis=1)
    if empty.any():
        xy = xy[~np.repeat(empty, size)]
        row, size, number = row[~empty], size[~empty], number[~empty]
        ring_at = np.concatenate([[0], np.cumsum(size)])
    names = np.array([None, "Point", "LineString", "Polygon"], object)
    kinds = names[np.where(plain, code, 0)].tolist()
    return Batch(kinds, xy, ring_at, row, np.zeros_like(row), number > 0, rows), plain


def read_wkb(blob):
    """(kind, [(part, hole, points)]) of one WKB or EWKB value; None when it cannot be read."""
    if blob is None:
        return None
    try:
        kind, rings, end = _read_geometry(bytes(blob), 0, 0)
    except (struct.error, ValueError, KeyError, IndexError):
        return None
    return (kind, rings) if end == len(blob) else None


def _read_geometry(blob, pos, part):
    order = "<" if blob[pos] == 1 else ">"
    (code,) = struct.unpack_from(order + "I", blob, pos + 1)
    pos += 5
    if code & 0x20000000:  # EWKB spatial reference id
        pos += 4
    width = 2 + bool(code & 0x80000000) + bool(code & 0x40000000)
    code &= 0x0FFFFFFF
    width = max(width, {0: 2, 1: 3, 2: 3, 3: 4}[code // 1000])
    code %= 1000
    kind = WKB_KINDS[code]
    if code in MEMBER:
        (count,) = struct.unpack_from(order + "I", blob, pos)
        pos += 4
        rings = []
        for index in range(count):
            member, inner, pos = _read_geometry(blob, pos, index)
            if WKB_CODES[member] != MEMBER[code]:
                raise ValueError("member of another kind")
            rings.extend(inner)
        return kind, rings, pos
    if code == 1:
        points, pos = _read_points(blob, pos, order, 1, width)
        return kind, ([] if np.isnan(points).all() else [(part, False, points)]), pos
    if code == 2:
        (count,) = struct.unpack_from(order + "I", blob, pos)
        points, pos = _read_points(blob, pos + 4, order, count, width)
        return kind, ([(part, False, points)] if count else []), pos
    (count,) = struct.unpack_from(order + "I", blob, pos)
    pos += 4
    rings = []
    for index in range(count):
        (size,) = struct.unpack_from(order + "I", blob, pos)
        points, pos = _read_points(blob, pos + 4, order, size, width)
        rings.append((part, index > 0, points))
    return kind, rings, pos


def _read_points(blob, pos, order, count, width):
    flat = np.frombuffer(blob, dtype=order + "f8", count=count * width, offset=pos)
    return flat.reshape(count, width)[:, :2].astype(float), pos + 8 * count * width


def write_wkb(kind, rings) -> bytes | None:
    """Little-endian WKB of (kind, [(part, hole, points)])."""
    if kind is None:
        return None
    code = WKB_CODES[kind]
    if code in MEMBER:
        parts = {}
        for ring in rings:
            parts.setdefault(ring[0], []).append(ring)
        member = WKB_KINDS[MEMBER[code]]
        body = b"".join(write_wkb(member, parts[p]) for p in sorted(parts))
        return struct.pack("<BII", 1, code, len(parts)) + body
    head = struct.pack("<BI", 1, code)
    data = [np.ascontiguousarray(points, dtype="<f8") for _, _, points in rings]
    if code == 1:
        return head + (data[0].tobytes() if data else struct.pack("<2d", np.nan, np.nan))
    if code == 2:
        points = data[0] if data else np.empty((0, 2))
        return head + struct.pack("<I", len(points)) + points.tobytes()
    return head + struct.pack("<I", len(data)) + b"".join(struct.pack("<I", len(d)) + d.tobytes() for d in data)


# ---- predicates ----------------------------------------------------------------------------


def _orient(ax, ay, bx, by, cx, cy):
    return (bx - ax) * (cy - ay) - (by - ay) * (cx - ax)


def _blocks(count, width):
    step = max(1, PAIR_BLOCK // max(1, width))
    for low in range(0, count, step):
        yield slice(low, min(count, low + step))


def _touching(a, b):
    """Matrix: closed segments a[i], b[j] share a point. Handles collinear and zero-length ones."""
    ax, ay, bx, by = (a[:, i, None] for i in range(4))
    cx, cy, dx, dy = (b[None, :, i] for i in range(4))
    near = (
        (np.minimum(ax, bx) <= np.maximum(cx, dx))
        & (np.minimum(cx, dx) <= np.maximum(ax, bx))
        & (np.minimum(ay, by) <= np.maximum(cy, dy))
        & (np.minimum(cy, dy) <= np.maximum(ay, by))
    )
    astride_b = np.sign(_orient(cx, cy, dx, dy, ax, ay)) * np.sign(_orient(cx, cy, dx, dy, bx, by)) <= 0
    astride_a = np.sign(_orient(ax, ay, bx, by, cx, cy)) * np.sign(_orient(ax, ay, bx, by, dx, dy)) <= 0
    return near & astride_a & astride_b


def _crosses_ray(points, edges):
    """Matrix: the ray from points[i] to +x crosses edges[j] (half-open in y)."""
    px, py = points[:, 0, None], points[:, 1, None]
    x1, y1, x2, y2 = (edges[None, :, i] for i in range(4))
    spans = (y1 > py) != (y2 > py)
    with np.errstate(divide="ignore", invalid="ignore"):
        at = x1 + (py - y1) * (x2 - x1) / (y2 - y1)
    return spans & (px < at)


def _on_edge(points, edges):
    segments = np.hstack([points, points])
    return _touching(segments, edges)


def _spread(counts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For items with these counts: the item of each place, and the place's number inside its item."""
    item = np.repeat(np.arange(len(counts)), counts)
    return item, np.arange(len(item)) - np.repeat(np.cumsum(counts) - counts, counts)


def _portions(counts: np.ndarray):
    """Slices of the items with some PAIR_BLOCK places each."""
    ends = np.cumsum(counts)
    at = 0
    while at < len(counts):
        before = ends[at - 1] if at else 0
        upto = max(at + 1, int(np.searchsorted(ends, before + PAIR_BLOCK, "right")))
        yield slice(at, upto)
        at = upto


def _touch(a, b):
    """Per pair: the closed segments a[i] and b[i] share a point."""
    ax, ay, bx, by = a.T
    cx, cy, dx, dy = b.T
    near = (
        (np.minimum(ax, bx) <= np.maximum(cx, dx))
        & (np.minimum(cx, dx) <= np.maximum(ax, bx))
        & (np.minimum(ay, by) <= np.maximum(cy, dy))
        & (np.minimum(cy, dy) <= np.maximum(ay, by))
    )
    astride_b = np.sign(_orient(cx, cy, dx, dy, ax, ay)) * np.sign(_orient(cx, cy, dx, dy, bx, by)) <= 0
    astride_a = np.sign(_orient(ax, ay, bx, by, cx, cy)) * np.sign(_orient(ax, ay, bx, by, dx, dy)) <= 0
    return near & astride_a & astride_b


def _crosses(points, edges):
    """Per pair: the ray from points[i] to +x crosses edges[i] (half-open in y)."""
    px, py = points.T
    x1, y1, x2, y2 = edges.T
    with np.errstate(divide="ignore", invalid="ignore"):
        at = x1 + (py - y1) * (x2 - x1) / (y2 - y1)
    return ((y1 > py) != (y2 > py)) & (px < at)


class Prepared:
    """One shape's edges in horizontal slabs, made once and asked for by every batch."""

    def __init__(self, shape: Batch):
        self.shape = shape
        self.edges, _ = shape.edges()
        self.areal = bool(len(self.edges)) and bool(shape.areal()[0])
        low, high = np.minimum(self.edges[:, 1], self.edges[:, 3]), np.maximum(self.edges[:, 1], self.edges[:, 3])
        self.count = int(np.clip(len(self.edges) // 2, 1, 4096))
        self.base = low.min() if len(low) else 0.0
        self.height = max((high.max() - self.base) / self.count, 1e-300) if len(low) else 1.0
        first, last = self.slab(low), self.slab(high)
        edge, step = _spread(last - first + 1)
        slab = first[edge] + step
        order = np.argsort(slab, kind="stable")
        self.members = edge[order]
        self.begin = np.searchsorted(slab[order], np.arange(self.count + 1))
        x = np.concatenate([self.edges[:, [0, 1]], self.edges[:, [2, 3]]])
        self.box = (*x.min(axis=0), *x.max(axis=0)) if len(x) else (np.inf, np.inf, -np.inf, -np.inf)

    def slab(self, y: np.ndarray) -> np.ndarray:
        return np.clip(np.floor((y - self.base) / self.height), 0, self.count - 1).astype(np.int64)

    def _near(self, low: np.ndarray, high: np.ndarray):
        """Portions of (item, edge) for items that reach from y = low to high; an edge may come up once a slab."""
        first, last = self.slab(low), self.slab(high)
        item, step = _spread(last - first + 1)
        slab = first[item] + step
        counts = self.begin[slab + 1] - self.begin[slab]
        for part in _portions(counts):
            which, at = _spread(counts[part])
            yield item[part][which], self.members[self.begin[slab[part]][which] + at]

    def touched(self, edges: np.ndarray) -> np.ndarray:
        """Per edge: it shares a point with an edge of the shape."""
        found = np.zeros(len(edges), bool)
        for item, mine in self._near(np.minimum(edges[:, 1], edges[:, 3]), np.maximum(edges[:, 1], edges[:, 3])):
            found[item[_touch(edges[item], self.edges[mine])]] = True
        return found

    def inside(self, points: np.ndarray) -> np.ndarray:
        """Per point: it is inside the shape (even-odd rule)."""
        odd = np.zeros(len(points), np.int64)
        for item, mine in self._near(points[:, 1], points[:, 1]):
            odd += np.bincount(item[_crosses(points[item], self.edges[mine])], minlength=len(points))
        return odd % 2 == 1


def intersects(batch: Batch, query: Batch | Prepared) -> np.ndarray:
    """Per row: shares at least one point with the one geometry in `query` (edges included)."""
    query = query if isinstance(query, Prepared) else Prepared(query)
    found = np.zeros(batch.rows, dtype=bool)
    edges, rows = batch.edges()
    if not len(edges) or not len(query.edges):
        return found
    low, high = np.array(query.box[:2]), np.array(query.box[2:])
    near = (
        (np.minimum(edges[:, :2], edges[:, 2:]) <= high) & (np.maximum(edges[:, :2], edges[:, 2:]) >= low)
    ).all(axis=1)
    found[rows[near][query.touched(edges[near])]] = True
    if query.areal:
        points, point_rows = batch.first_vertices()
        open_points = np.flatnonzero(~found[point_rows])
        found[point_rows[open_points[query.inside(points[open_points])]]] = True
    q_points, _ = query.shape.first_vertices()
    open_edges = np.flatnonzero(~found[rows] & batch.areal()[rows])
    if len(open_edges):
        for point in q_points:
            crossed = _crosses_ray(point[None, :], edges[open_edges])[0]
            counts = np.bincount(rows[open_edges][crossed], minlength=batch.rows)
            found |= counts % 2 == 1
    return found


class _ByRow:
    """The edges of a batch, those of a row together."""

    def __init__(self, batch: Batch):
        edges, rows = batch.edges()
        order = np.argsort(rows, kind="stable")
        self.edges, self.rows = edges[order], rows[order]
        self.begin = np.searchsorted(self.rows, np.arange(batch.rows + 1))
        self.low, self.high = np.full((batch.rows, 2), np.inf), np.full((batch.rows, 2), -np.inf)
        np.minimum.at(self.low, rows, np.minimum(edges[:, :2], edges[:, 2:]))
        np.maximum.at(self.high, rows, np.maximum(edges[:, :2], edges[:, 2:]))

    def reaching(self, other: "_ByRow") -> "_ByRow":
        """Without the edges that lie beside the box of the other side's row."""
        low, high = np.minimum(self.edges[:, :2], self.edges[:, 2:]), np.maximum(self.edges[:, :2], self.edges[:, 2:])
        near = ((low <= other.high[self.rows]) & (high >= other.low[self.rows])).all(axis=1)
        out = object.__new__(_ByRow)
        out.edges, out.rows, out.low, out.high = self.edges[near], self.rows[near], self.low, self.high
        out.begin = np.searchsorted(out.rows, np.arange(len(self.begin)))
        return out

    def meeting(self, rows: np.ndarray):
        """Portions of (item, edge): every item with the edges of its row."""
        counts = self.begin[rows + 1] - self.begin[rows]
        for part in _portions(counts):
            which, at = _spread(counts[part])
            yield part.start + which, self.begin[rows[part]][which] + at

    def inside(self, points: np.ndarray, rows: np.ndarray) -> np.ndarray:
        """Per point: it is inside the shape of its row (even-odd rule)."""
        odd = np.zeros(len(points), np.int64)
        for item, edge in self.meeting(rows):
            odd += np.bincount(item[_crosses(points[item], self.edges[edge])], minlength=len(points))
        return odd % 2 == 1


def intersects_pairs(left: Batch, right: Batch) -> np.ndarray:
    """Per row: the left and the right geometry share a point (edges included); all rows at once."""
    found = np.zeros(left.rows, dtype=bool)
    a, b = _ByRow(left), _ByRow(right)
    near_a, near_b = a.reaching(b), b.reaching(a)
    for item, edge in near_b.meeting(near_a.rows):
        found[near_a.rows[item[_touch(near_a.edges[item], near_b.edges[edge])]]] = True
    for batch, other, areal in ((left, b, right.areal()), (right, a, left.areal())):
        points, rows = batch.first_vertices()
        some = np.flatnonzero(~found[rows] & areal[rows])
        found[rows[some[other.inside(points[some], rows[some])]]] = True
    return found


def _where_points(edges, rows, count, areal, points):
    """(inside, on_edge) matrices (rows x points) of points against the rows' own rings."""
    inside = np.zeros((count, len(points)), dtype=bool)
    on_edge = np.zeros((count, len(points)), dtype=bool)
    for j, point in enumerate(points):
        crossed = _crosses_ray(point[None, :], edges)[0]
        inside[:, j] = (np.bincount(rows[crossed], minlength=count) % 2 == 1) & areal
        touched = _on_edge(point[None, :], edges)[0]
        on_edge[:, j] = np.bincount(rows[touched], minlength=count) > 0
    return inside & ~on_edge, on_edge


def contains(batch: Batch, query: Batch) -> np.ndarray:
    """Per row: the row's geometry contains the one geometry in `query`.

    Nothing of the query lies outside, and something of it lies in the interior; a point on the
    edge is therefore not contained.
    """
    edges, rows = batch.edges()
    areal = batch.areal()
    q_points = query.xy
    if not len(edges) or not len(q_points):
        return np.zeros(batch.rows, dtype=bool)
    inside, on_edge = _where_points(edges, rows, batch.rows, areal, q_points)
    covered = (inside | on_edge).all(axis=1)
    if query.kinds[0] in ("Point", "MultiPoint"):
        lonely = np.array([k in ("Point", "MultiPoint") for k in batch.kinds], dtype=bool)
        return covered & (inside.any(axis=1) | (lonely & on_edge.any(axis=1)))
    found = np.zeros(batch.rows, dtype=bool)
    for row in np.flatnonzero(covered & areal):
        found[row] = _covers(batch.single(row), query)
    return found


def _covers(shape: Batch, query: Batch) -> bool:
    """Exact test of one areal shape against one line or polygon whose vertices it all covers."""
    edges, rows = shape.edges()
    q_edges, _ = query.edges()
    middles = []
    for segment in q_edges:
        cuts = [0.0, 1.0]
        start, delta = segment[:2], segment[2:] - segment[:2]
        size = float(delta @ delta)
        for edge in edges[_touching(segment[None, :], edges)[0]]:
            along = edge[2:] - edge[:2]
            cross = delta[0] * along[1] - delta[1] * along[0]
            if cross:
                gap = edge[:2] - start
                cuts.append((gap[0] * along[1] - gap[1] * along[0]) / cross)
            elif size:
                cuts.extend(float((end - start) @ delta) / size for end in (edge[:2], edge[2:]))
        cuts = np.unique(np.clip(cuts, 0.0, 1.0))
        middles.extend(start + delta * t for t in (cuts[:-1] + cuts[1:]) / 2)
    middles = np.array(middles)
    areal = np.array([True])
    inside, on_edge = _where_points(edges, rows, 1, areal, middles)
    touching = on_edge | _nearly_on(middles, edges)
    if not (inside | touching).all():
        return False
    if not query.areal()[0]:
        return bool((inside & ~touching).any())
    # a hole (or a notch) of the shape must not reach into the query's interior
    q_all, q_rows = query.edges()
    strict, _ = _where_points(q_all, q_rows, 1, np.array([True]), shape.xy)
    return not strict.any()


def _nearly_on(points, edges, tolerance=1e-12):
    """Points whose distance to an edge is rounding noise (midpoints of collinear pieces)."""
    out = np.zeros((1, len(points)), dtype=bool)
    start, delta = edges[:, :2], edges[:, 2:] - edges[:, :2]
    size = np.maximum((delta * delta).sum(axis=1), 1e-300)
    for j, point in enumerate(points):
        t = np.clip(((point - start) * delta).sum(axis=1) / size, 0, 1)
        gap = np.abs(start + delta * t[:, None] - point).max(axis=1)
        out[0, j] = bool((gap <= tolerance * np.maximum(1, np.abs(point).max())).any())
    return out


# ---- simplification ------------------------------------------------------------------------


class Obstacles:
    """Vertices of one geometry, which its simplified edges must not sweep over."""

    def __init__(self, points: np.ndarray):
        self.points = points[np.argsort(points[:, 0], kind="stable")]

    def swept(self, chain: np.ndarray) -> bool:
        """Some vertex that is not of the chain lies on or between the chain and its chord."""
        low, high = chain.min(axis=0), chain.max(axis=0)
        first, last = np.searchsorted(self.points[:, 0], [low[0], np.nextafter(high[0], np.inf)])
        near = self.points[first:last]
        near = near[(near[:, 1] >= low[1]) & (near[:, 1] <= high[1])]
        near = near[~np.isin(near @ [1, 1j], chain @ [1, 1j])]
        edges = np.column_stack([chain, np.roll(chain, -1, axis=0)])
        for some in _blocks(len(near), len(edges)):
            inside = _crosses_ray(near[some], edges).sum(axis=1) % 2 == 1
            if (inside | _on_edge(near[some], edges).any(axis=1)).any():
                return True
        return False


def simplify_points(points: np.ndarray, tolerance: float, fewest: int, obstacles: Obstacles | None = None) -> np.ndarray:
    """Keep the vertices that lie further than `tolerance` from the line through kept ones.

    With `obstacles`, a stretch also keeps its furthest vertex where its removal would sweep over one of them.
    """
    count = len(points)
    if count <= fewest:
        return points
    keep = np.zeros(count, dtype=bool)
    keep[[0, -1]] = True
    spans = [(0, count - 1)]
    while spans:
        low, high = spans.pop()
        if high - low < 2:
            continue
        between = points[low + 1 : high]
        chord = points[high] - points[low]
        size = float(chord @ chord)
        offset = between - points[low]
        t = np.clip(offset @ chord / size, 0, 1) if size else np.zeros(len(between))
        gap = np.hypot(*(offset - t[:, None] * chord).T)
        far = int(gap.argmax())
        if gap[far] > tolerance or (obstacles is not None and obstacles.swept(points[low : high + 1])):
            keep[low + 1 + far] = True
            spans += [(low, low + 1 + far), (low + 1 + far, high)]
    out = points[keep]
    return out if len(out) >= fewest else points


class _ObstaclesByRow:
    """`Obstacles` of every row of a batch, asked for many chains at once."""

    def __init__(self, batch: Batch):
        self.xy = batch.xy
        row = np.repeat(batch.ring_row, np.diff(batch.ring_at))
        self.order = np.lexsort((self.xy[:, 0], row))
        self.row, self.x = row[self.order], self.xy[self.order, 0]

    def _place(self, rows: np.ndarray, xs: np.ndarray, after: bool) -> np.ndarray:
        """Number of vertices before (row, x), or up to it."""
        count = len(self.row)
        tie = np.concatenate([np.zeros(count), np.full(len(rows), 1 if after else -1)])
        order = np.lexsort((tie, np.concatenate([self.x, xs]), np.concatenate([self.row, rows])))
        asked = order >= count
        out = np.empty(len(rows), np.int64)
        out[order[asked] - count] = np.cumsum(~asked)[asked]
        return out

    def swept(self, low: np.ndarray, high: np.ndarray, rows: np.ndarray) -> np.ndarray:
        """`Obstacles.swept` of the chains xy[low[i] : high[i] + 1]."""
        found = np.zeros(len(low), dtype=bool)
        if not len(low):
            return found
        size = high - low + 1
        item, place = _spread(size)
        chains, begins = self.xy[low[item] + place], np.cumsum(size) - size
        least, most = np.minimum.reduceat(chains, begins), np.maximum.reduceat(chains, begins)
        first, last = self._place(rows, least[:, 0], False), self._place(rows, most[:, 0], True)
        for some in _portions(last - first):
            chain, place = _spread((last - first)[some])
            chain += some.start
            vertex = self.order[first[chain] + place]
            y = self.xy[vertex, 1]
            near = (y >= least[chain, 1]) & (y <= most[chain, 1]) & ((vertex < low[chain]) | (vertex > high[chain]))
            chain, vertex = chain[near], vertex[near]
            for few in _portions(size[chain]):
                pair, place = _spread(size[chain[few]])
                own = chain[few][pair]
                point, a = self.xy[vertex[few][pair]], self.xy[low[own] + place]
                edges = np.hstack([a, self.xy[np.where(place + 1 < size[own], low[own] + place + 1, low[own])]])
                counted = lambda what: np.bincount(pair[what], minlength=few.stop - few.start)  # noqa: E731, B023
                inside = counted(_crosses(point, edges)) % 2 == 1
                met = (inside | (counted(_touch(np.hstack([point, point]), edges)) > 0)) & (counted((a == point).all(axis=1)) == 0)
                found[chain[few][met]] = True
        return found


def simplified(batch: Batch, tolerance: float, topology: bool) -> np.ndarray:
    """Which vertices `simplify_points` keeps of every ring; all stretches of the batch are halved together, level by level."""
    xy, sizes = batch.xy, np.diff(batch.ring_at)
    fewest = np.where(batch.areal()[batch.ring_row], 4, 2)
    keep = np.repeat(sizes <= fewest, sizes)
    some = np.flatnonzero(sizes > fewest)
    low, high, rows = batch.ring_at[some], batch.ring_at[some + 1] - 1, batch.ring_row[some]
    keep[low] = keep[high] = True
    obstacles = _ObstaclesByRow(batch) if topology else None
    while len(low):
        some = high - low >= 2
        low, high, rows = low[some], high[some], rows[some]
        between = high - low - 1
        far, split = np.empty(len(low), np.int64), np.empty(len(low), bool)
        for part in _portions(between):
            item, place = _spread(between[part])
            start = xy[low[part]]
            chord = xy[high[part]] - start
            size = (chord * chord).sum(axis=1)[item]
            offset, chord = xy[low[part][item] + 1 + place] - start[item], chord[item]
            with np.errstate(divide="ignore", invalid="ignore"):
                t = np.where(size != 0, np.clip((offset * chord).sum(axis=1) / size, 0, 1), 0.0)
            gap = np.hypot(*(offset - t[:, None] * chord).T)
            most = np.maximum.reduceat(gap, np.cumsum(between[part]) - between[part])
            hit = np.flatnonzero((gap == most[item]) | np.isnan(gap))
            far[part] = low[part] + 1 + place[hit[np.unique(item[hit], return_index=True)[1]]]
            split[part] = most > tolerance
        if topology:
            flat = np.flatnonzero(~split)
            split[flat] = obstacles.swept(low[flat], high[flat], rows[flat])
        keep[far[split]] = True
        low, high, rows = np.concatenate([low[split], far[split]]), np.concatenate([far[split], high[split]]), np.tile(rows[split], 2)
    kept = np.diff(np.concatenate([[0], np.cumsum(keep)])[batch.ring_at])
    return keep | np.repeat(kept < fewest, sizes)


# ---- columns -------------------------------------------------------------------------------


def _geometry_struct(kind: Column, rings: Column) -> Column:
    return F.when(kind.isNotNull() & rings.isNotNull(), F.struct(kind.alias("kind"), rings.alias("rings")))


def decode_wkb(blob: Column) -> Column:
    """WKB -> struct (kind, rings); NULL when it cannot be read."""

    @F.arrow_udf(shapes.GEOMETRY_DDL)
    def decode(v: pa.Array) -> pa.Array:
        return Batch.from_wkb(v).to_arrow()

    return decode(blob)


def encode_wkb(kind: Column, rings: Column) -> Column:
    @F.arrow_udf("binary")
    def encode(v: pa.Array) -> pa.Array:
        return Batch.from_rings(v).to_wkb()

    return encode(_geometry_struct(kind, rings))


def literal(wkb: bytes) -> Batch:
    """A batch of one literal shape."""
    shape = read_wkb(wkb)
    if shape is None:
        raise ValueError("the query shape cannot be read")
    kind, rings = shape
    return Batch._pack([kind], [r[2] for r in rings], [0] * len(rings), [r[0] for r in rings], [r[1] for r in rings], 1)


def _predicate(test, query):
    @F.arrow_udf("boolean")
    def run(v: pa.Array) -> pa.Array:
        is_binary = pa.types.is_binary(v.type) or pa.types.is_large_binary(v.type)
        batch = Batch.from_wkb(v) if is_binary else Batch.from_rings(v)
        found = test(batch, query)
        missing = np.array([k is None for k in batch.kinds], dtype=bool)
        return pa.array(found, pa.bool_(), mask=missing)

    return run


def st_intersects(geometry: Column, query_wkb: bytes) -> Column:
    """Closed intersects of a WKB or (kind, rings) column with one literal shape; NULL for NULL."""
    return _predicate(intersects, Prepared(literal(query_wkb)))(geometry)


def st_contains(geometry: Column, query_wkb: bytes) -> Column:
    """The column's geometry contains the literal shape."""
    return _predicate(contains, literal(query_wkb))(geometry)


def pair_intersects(left: Column, right: Column) -> Column:
    """Closed intersects of two (kind, rings) columns, row by row."""

    @F.arrow_udf("boolean")
    def run(a: pa.Array, b: pa.Array) -> pa.Array:
        lefts, rights = Batch.from_rings(a), Batch.from_rings(b)
        missing = np.array([x is None or y is None for x, y in zip(lefts.kinds, rights.kinds)], dtype=bool)
        return pa.array(intersects_pairs(lefts, rights), pa.bool_(), mask=missing)

    return run(left, right)


def simplify(kind: Column, rings: Column, tolerance: float = 0.01, topology: bool = True) -> Column:
    """Rings with fewer vertices; a ring never falls below four, a line below two.

    With `topology` no removed stretch sweeps over another vertex of the geometry, so valid shapes stay valid: rings
    do not cross themselves or each other, and holes stay inside. Without it only the distance counts.
    """

    @F.arrow_udf(shapes.GEOMETRY_DDL)
    def run(v: pa.Array) -> pa.Array:
        batch = Batch.from_rings(v)
        keep = simplified(batch, tolerance, topology)
        at = np.concatenate([[0], np.cumsum(keep)])[batch.ring_at]
        return Batch(batch.kinds, batch.xy[keep], at, batch.ring_row, batch.ring_part, batch.ring_hole, batch.rows).to_arrow()

    return run(_geometry_struct(kind, rings))["rings"]


def bounds_of_wkb(blob: Column) -> Column:
    """Covering box struct straight from WKB."""

    @F.arrow_udf("struct<xmin:double,ymin:double,xmax:double,ymax:double>")
    def run(v: pa.Array) -> pa.Array:
        batch = Batch.from_wkb(v)
        rows = np.repeat(batch.ring_row, np.diff(batch.ring_at))
        low = np.full((batch.rows, 2), np.inf)
        high = np.full((batch.rows, 2), -np.inf)
        np.minimum.at(low, rows, batch.xy)
        np.maximum.at(high, rows, batch.xy)
        empty = ~np.isfinite(low).all(axis=1)
        columns = [low[:, 0], low[:, 1], high[:, 0], high[:, 1]]
        return pa.StructArray.from_arrays(
            [pa.array(c) for c in columns], names=["xmin", "ymin", "xmax", "ymax"], mask=pa.array(empty)
        )

    return run(blob)
