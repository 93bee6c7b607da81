"""Raster approximation of a query shape: rows are decided by their box, in the JVM, wherever the box allows it.

The shape's box is cut into 2^depth x 2^depth cells, and these are merged by fours into coarser levels. A cell is
inside the shape, outside, or on its border (also where it is not certain). A row looks itself up at the finest level
whose cells are at least as large as its box, so it touches at most 2 x 2 cells there; for each such group of cells one
byte says whether all are inside, all outside, or neither. The bytes of all levels, some 24 kB at depth 6, whatever
the shape, are one literal, and the lookup is arithmetic on the box columns: no join, and any AND, OR or NOT can hold it.

A box inside means that what it holds intersects the shape; a box outside, that it does not; only rows on
the border need their geometry.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from granulake.functions import geometry_batch as gb
from granulake.functions.staging import let, once

OUTSIDE, BORDER, INSIDE = 0, 1, 2
DEPTH = 6
_SLACK = 1e-9  # of a cell: what is this near to a cell counts as touching it


def _border(edges: np.ndarray, n: int) -> np.ndarray:
    """Cells of an n x n grid that edges (in cells) touch."""
    out = np.zeros((n, n), bool)
    for x1, y1, x2, y2 in edges:
        if x1 > x2:
            x1, y1, x2, y2 = x2, y2, x1, y1
        columns = np.arange(max(0, int(np.floor(x1 - _SLACK))), min(n - 1, int(np.floor(x2 + _SLACK))) + 1)
        if x2 - x1 > _SLACK:
            slope = (y2 - y1) / (x2 - x1)
            left = y1 + (np.clip(columns - _SLACK, x1, x2) - x1) * slope
            right = y1 + (np.clip(columns + 1 + _SLACK, x1, x2) - x1) * slope
        else:
            left, right = np.full(len(columns), y1), np.full(len(columns), y2)
        low = np.floor(np.minimum(left, right) - _SLACK).astype(int).clip(0, n)
        high = np.floor(np.maximum(left, right) + _SLACK).astype(int).clip(-1, n - 1)
        for c, a, b in zip(columns, low, high):
            out[c, a : b + 1] = True
    return out


def _middles_inside(edges: np.ndarray, n: int) -> np.ndarray:
    """Cells whose middle is inside, by the even-odd rule along each row of cells."""
    out = np.zeros((n, n), bool)
    x1, y1, x2, y2 = edges.T
    for row in range(n):
        y = row + 0.5
        cross = np.flatnonzero((y1 > y) != (y2 > y))
        at = x1[cross] + (y - y1[cross]) * (x2[cross] - x1[cross]) / (y2[cross] - y1[cross])
        out[:, row] = (len(at) - np.searchsorted(np.sort(at), np.arange(n) + 0.5, "right")) % 2 == 1
    return out


class Raster:
    """Marks of a literal shape (WKB) at all levels; `levels[0]` is the finest."""

    def __init__(self, wkb: bytes, depth: int = DEPTH):
        batch = gb.literal(wkb)
        edges, _ = batch.edges()
        self.low, high = batch.xy.min(axis=0), batch.xy.max(axis=0)
        n = 1 << depth
        self.size = np.maximum((high - self.low) / n, 1e-12)
        scaled = (edges - np.tile(self.low, 2)) / np.tile(self.size, 2)
        marks = np.where(_middles_inside(scaled, n), INSIDE, OUTSIDE) if batch.areal()[0] else np.zeros((n, n), int)
        marks[_border(scaled, n)] = BORDER
        self.levels = [marks]
        while len(marks) > 1:
            marks = _merged([marks[i::2, j::2] for i in (0, 1) for j in (0, 1)])
            self.levels.append(marks)

    def bytes(self) -> bytes:
        """Marks of all groups of cells: by level, lower left cell (from -1 on), and whether it spans two cells."""
        out = []
        for marks in self.levels:
            k = len(marks) + 2
            around = np.pad(marks, 1, mode="edge")  # the cells around touch the shape where it touches its box
            around[1:-1, 1:-1] = OUTSIDE
            wide = np.pad(np.where(around > OUTSIDE, BORDER, OUTSIDE), (0, 1))
            wide[1:-2, 1:-2] = marks
            part = lambda i, j: wide[i : i + k, j : j + k]
            groups = [[part(0, 0)], [part(0, 0), part(0, 1)], [part(0, 0), part(1, 0)], [part(i, j) for i in (0, 1) for j in (0, 1)]]
            out.append(np.stack([_merged(g) for g in groups], axis=-1).ravel())
        return np.concatenate(out).astype(np.uint8).tobytes()

    def _level(self, w: Column, s: Column, e: Column, n: Column) -> Column:
        """The level whose cells are as large as the box."""
        dx, dy = map(float, self.size)
        return F.ceil(F.log2(F.greatest((e - w) / dx, (n - s) / dy, F.lit(1.0)))).cast("int")

    def _looked_up(self, w: Column, s: Column, e: Column, n: Column, level: Column) -> Column:
        (x0, y0), (dx, dy) = map(float, self.low), map(float, self.size)
        finest = len(self.levels[0])
        sizes = [(len(marks) + 2) ** 2 * 4 for marks in self.levels]
        offsets = F.lit([sum(sizes[:k]) for k in range(len(sizes))])
        most = F.call_function("shiftright", F.lit(finest), level)
        scale = F.call_function("shiftleft", F.lit(1), level)

        def cell(value: Column, low: float, step: float) -> Column:
            at = F.floor((value - F.lit(low)) / (F.lit(step) * scale))
            return F.greatest(F.lit(-1), F.least(most, at))

        x, y = cell(w, x0, dx), cell(s, y0, dy)
        wide, high = cell(e, x0, dx) - x, cell(n, y0, dy) - y
        at = ((x + 1) * (most + 2) + y + 1) * 4 + wide * 2 + high + F.get(offsets, level)
        # not where the level is too fine by rounding, or the box turns around
        where = F.when(wide.between(0, 1) & high.between(0, 1), at.cast("int"))
        known = F.substring(F.lit(bytearray(self.bytes())), where + 1, F.lit(1))
        boxed = w.isNotNull() & s.isNotNull() & e.isNotNull() & n.isNotNull()
        return F.when(boxed, F.coalesce(known, _byte(BORDER)))

    def _box(self, columns: tuple[str, str, str, str]) -> Column:
        box = [F.col(c) for c in columns]
        return F.struct(*[v.alias(k) for k, v in zip("wsen", box)], self._level(*box).alias("level"))

    def mark(self, columns: tuple[str, str, str, str]) -> Column:
        """Mark of a row by its box columns (west, south, east, north), as one byte; NULL for a NULL box."""
        return let(self._box(columns), lambda b: self._looked_up(*(b[k] for k in (*"wsen", "level"))))

    def with_mark(self, df: DataFrame, columns: tuple[str, str, str, str], name: str) -> DataFrame:
        """The mark as a column: computed once a row and inside generated code, which `mark` is not."""
        boxed = once(df, f"{name}_box", self._box(columns))
        value = self._looked_up(*(F.col(f"{name}_box.{k}") for k in (*"wsen", "level")))
        return once(boxed, name, value).drop(f"{name}_box")


def _merged(parts: list[np.ndarray]) -> np.ndarray:
    """The common mark of cells, or border."""
    low, high = np.minimum.reduce(parts), np.maximum.reduce(parts)
    return np.where(low == high, low, BORDER)


def _byte(mark: int) -> Column:
    return F.lit(bytearray([mark]))


def may_intersect(mark: Column) -> Column:
    """Native: the row is not decided to lie outside."""
    return mark != _byte(OUTSIDE)


def intersects(mark: Column, geometry: Column, wkb: bytes) -> Column:
    """The row's geometry shares a point with the shape; only geometries on the border are handed to the exact test.
    NULL where the box or the geometry is NULL."""
    exact = gb.st_intersects(F.when(mark == _byte(BORDER), geometry), wkb)
    return F.when(mark.isNotNull() & geometry.isNotNull(), (mark == _byte(INSIDE)) | F.coalesce(exact, F.lit(False)))


def label(mark: Column) -> Column:
    """`inside`, `border` or `outside`."""
    return F.when(mark == _byte(INSIDE), "inside").when(mark == _byte(BORDER), "border").when(mark == _byte(OUTSIDE), "outside")
