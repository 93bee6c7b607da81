"""The columnar WKB codec against the reader and writer of single values."""

import random
import struct

import numpy as np
import pyarrow as pa
import pytest

from granulake.functions import geometry_batch as gb
from granulake.functions.geometry_batch import Batch


def shape(rng):
    points = lambda n: np.array([(rng.uniform(-180, 180), rng.uniform(-90, 90)) for _ in range(n)]).reshape(-1, 2)
    kind = rng.choice(list(gb.WKB_CODES))
    if kind == "Point":
        return kind, [(0, False, points(1))] * rng.randint(0, 1)
    if kind == "LineString":
        return kind, [(0, False, points(rng.randint(1, 5)))] * rng.randint(0, 1)
    if kind == "Polygon":
        return kind, [(0, i > 0, points(rng.randint(0, 6))) for i in range(rng.randint(0, 4))]
    parts = range(rng.randint(0, 3))
    if kind == "MultiPolygon":
        return kind, [(p, i > 0, points(4)) for p in parts for i in range(rng.randint(1, 3))]
    return kind, [(p, False, points(1 if kind == "MultiPoint" else 3)) for p in parts]


def blobs(seed, n=300):
    rng = random.Random(seed)
    out = [gb.write_wkb(*shape(rng)) for _ in range(n)]
    for i in range(0, n, 7):
        out[i] = None
    for i in range(3, n, 11):  # cut, lengthened, or with a broken byte
        value = bytearray(out[i] or b"")
        how = rng.randrange(3)
        if how == 0:
            value = value[: rng.randrange(len(value) + 1)]
        elif how == 1:
            value += b"\0"
        elif value:
            value[rng.randrange(min(len(value), 9))] ^= 1 << rng.randrange(8)
        out[i] = bytes(value)
    return out


def rows_of(batch):
    out = [[] for _ in range(batch.rows)]
    for i, row in enumerate(batch.ring_row):
        points = batch.xy[batch.ring_at[i] : batch.ring_at[i + 1]].tolist()
        out[row].append((int(batch.ring_part[i]), bool(batch.ring_hole[i]), repr(points)))
    return list(zip(batch.kinds, out))


@pytest.mark.parametrize("seed", range(6))
@pytest.mark.parametrize("kind", [pa.binary(), pa.large_binary()])
def test_same_rows_and_rejects_as_one_by_one(seed, kind):
    values = blobs(seed)
    want = []
    for blob in values:
        read = gb.read_wkb(blob)
        want.append((read[0], [(p, h, repr(x.tolist())) for p, h, x in read[1]]) if read else (None, []))
    column = pa.array([None, b"x", *values], kind)[2:]  # a slice with an offset
    assert rows_of(Batch.from_wkb(column)) == want


@pytest.mark.parametrize("seed", range(6))
def test_written_bytes_are_those_of_single_values(seed):
    read = [gb.read_wkb(b) for b in blobs(seed + 50)]
    batch = Batch.from_wkb(pa.array([gb.write_wkb(*r) if r else None for r in read], pa.binary()))
    assert batch.to_wkb().to_pylist() == [gb.write_wkb(*r) if r else None for r in read]


def test_no_rows_and_other_byte_order():
    assert Batch.from_wkb(pa.array([], pa.binary())).to_wkb().to_pylist() == []
    assert Batch.from_wkb(pa.array([None, None], pa.binary())).kinds == [None, None]
    big = struct.pack(">BIdd", 0, 1, 3.0, 4.0)
    spatial = struct.pack("<BII2d", 1, 1 | 0x20000000, 4326, 5.0, 6.0)
    assert Batch.from_wkb(pa.array([big, spatial])).xy.tolist() == [[3.0, 4.0], [5.0, 6.0]]
