"""Functions registered under a name for use from SQL."""

from __future__ import annotations

import itertools

import numpy as np
import pyarrow as pa
from pyspark.sql import SparkSession
from pyspark.sql import functions as F

from granulake.functions.geohash import CHUNK_LETTERS
from granulake.functions.geometry_batch import Batch


def _cells(values: np.ndarray, low: float, span: float, bits: int) -> np.ndarray:
    cells = np.floor((values - low) / span * 2**bits)
    return np.clip(np.nan_to_num(cells), 0, 2**bits - 1).astype(np.int64)


def _region(w: float, s: float, e: float, n: float) -> str:
    sides = [a + b for a, b in (("S", "W"), ("N", "W"), ("S", "E"), ("N", "E")) if (w < 0 if b == "W" else e > 0) and (s < 0 if a == "S" else n > 0)]
    names = {("SW", "SE"): "SW-SE", ("NW", "NE"): "NE-NW", ("SW", "NW"): "SW-NW", ("SE", "NE"): "SE-NE"}
    if not sides or len(sides) == 4:
        return "All" if sides else "Central"
    return sides[0] if len(sides) == 1 else names[tuple(sides)]


#: Region by the bits west, south, east, north of the sides that are reached.
_REGIONS = [_region(-b[0], -b[1], b[2], b[3]) for b in itertools.product((0, 1), repeat=4)]


def register_hashbin(spark: SparkSession, name: str = "hashbin_wkb") -> None:
    """`hashbin_wkb(BINARY, BIGINT) -> STRING`: the flat bin of a WKB value.

    The second argument is the hash length, which a flat bin fixes at one.
    """

    @F.arrow_udf("string")
    def hashbin(blob: pa.Array, length: pa.Array) -> pa.Array:
        if any(v != 1 for v in length.unique().to_pylist()):
            raise ValueError("a flat bin has hashes of length 1")
        batch = Batch.from_wkb(blob)
        rows = np.repeat(batch.ring_row, np.diff(batch.ring_at))
        low, high = np.full((batch.rows, 2), np.inf), np.full((batch.rows, 2), -np.inf)
        np.minimum.at(low, rows, batch.xy)
        np.maximum.at(high, rows, batch.xy)
        x1, x2 = _cells(low[:, 0], -180, 360, 3), _cells(high[:, 0], -180, 360, 3)
        y1, y2 = _cells(low[:, 1], -90, 180, 2), _cells(high[:, 1], -90, 180, 2)
        some = np.isfinite(low).all(axis=1) & np.isfinite(high).all(axis=1)
        # centres of the corner cells, whose sides of the axes name the region
        w, e = (x1 + 0.5) * 45 - 180 < 0, (x2 + 0.5) * 45 - 180 > 0
        s, n = (y1 + 0.5) * 45 - 90 < 0, (y2 + 0.5) * 45 - 90 > 0
        letters, regions = np.array(list(CHUNK_LETTERS)), np.array(_REGIONS)
        region = regions[w * 8 + s * 4 + e * 2 + n * 1]
        found = np.where((x1 == x2) & (y1 == y2), letters[x1 * 4 + y1], region)
        return pa.array(found.astype(object), pa.string(), mask=~some)

    spark.udf.register(name, hashbin)
