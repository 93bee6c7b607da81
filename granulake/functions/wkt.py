"""WKT text: reading it into rings, and writing it from search parameters.

Reading never raises: text that is not a valid shape gives NULL. All steps are split / try_cast
on arrays, so a text of any length stays out of regex recursion.
"""

from __future__ import annotations

import json
import re

import numpy as np
from pyspark.sql import Column
from pyspark.sql import functions as F

from granulake.functions import shapes
from granulake.functions.staging import chain, let

# WKT keyword -> geometry kind.
KINDS = {
    "POINT": "Point",
    "LINESTRING": "LineString",
    "POLYGON": "Polygon",
    "MULTIPOINT": "MultiPoint",
    "MULTILINESTRING": "MultiLineString",
    "MULTIPOLYGON": "MultiPolygon",
}

# Error texts of unusable search parameters.
ODD_COUNT = "ERROR: Odd Coordinate Count"
BLANK = "ERROR: Blank coordinate"
BAD_BOX = "ERROR: failed to parse bbox coordinates"


# ---- reading -------------------------------------------------------------------------------


def _strip(text: Column, depth: int) -> Column:
    """Text inside `depth` leading and trailing brackets; NULL when they are not there."""
    opening = r"^\s*" + r"\(\s*" * depth
    closing = r"\s*\)" * depth + r"\s*$"
    wrapped = text.rlike(opening) & text.rlike(closing)
    return F.when(wrapped, F.regexp_replace(F.regexp_replace(text, opening, ""), closing, ""))


def _ring(text: Column, part: Column, hole: Column) -> Column:
    split = F.transform(F.split(text, ","), lambda p: F.split(F.trim(p), r"\s+"))
    pairs = F.when(~text.rlike(r"[()]"), split)

    def build(pairs):
        whole = F.forall(pairs, lambda p: F.size(p) == 2)
        number = lambda i: F.when(whole, F.transform(pairs, lambda p: F.get(p, F.lit(i)).try_cast("double")))
        return F.struct(
            part.cast("int").alias("part"), hole.alias("hole"), number(0).alias("xs"), number(1).alias("ys")
        )

    return let(pairs, build)


def _finite(values: Column) -> Column:
    return F.forall(values, lambda v: v.isNotNull() & ~F.isnan(v))


def _rings_ok(rings: Column, fewest: Column, closed: Column) -> Column:
    """Every ring has only numbers, enough vertices and, where asked, equal ends."""

    def ok(r):
        good = r["xs"].isNotNull() & _finite(r["xs"]) & _finite(r["ys"]) & (F.size(r["xs"]) >= fewest)
        ends = (F.element_at(r["xs"], 1) == F.element_at(r["xs"], -1)) & (
            F.element_at(r["ys"], 1) == F.element_at(r["ys"], -1)
        )
        return F.coalesce(good & (~closed | ends), F.lit(False))

    return F.forall(rings, ok)


def parse(text: Column) -> Column:
    """Struct (kind, rings) of a WKT text, NULL when empty or invalid."""
    no_hole = F.lit(False)

    def split_rings(inner: Column, part: Column) -> Column:
        return F.transform(F.split(inner, r"\)\s*,\s*\("), lambda t, i: _ring(t, part, i > 0))

    def lines(inner: Column) -> Column:
        return F.transform(F.split(inner, r"\)\s*,\s*\("), lambda t, i: _ring(t, i, no_hole))

    def points(inner: Column) -> Column:
        return F.transform(F.split(inner, ","), lambda t, i: _ring(F.regexp_replace(t, r"^\s*\(|\)\s*$", ""), i, no_hole))

    def parts(inner: Column) -> Column:
        return F.flatten(
            F.transform(F.split(inner, r"\)\s*\)\s*,\s*\(\s*\("), lambda t, i: split_rings(t, i))
        )

    def cut(t):
        word = F.upper(F.regexp_extract(t, r"^\s*([A-Za-z]+)", 1))
        return F.struct(word.alias("word"), F.regexp_replace(t, r"^\s*[A-Za-z]+\s*", "").alias("body"))

    def read(v):
        word, body = v["word"], v["body"]
        rings = (
            F.when(word.isin("POINT", "LINESTRING"), F.array(_ring(_strip(body, 1), F.lit(0), no_hole)))
            .when(word == "POLYGON", split_rings(_strip(body, 2), F.lit(0)))
            .when(word == "MULTILINESTRING", lines(_strip(body, 2)))
            .when(word == "MULTIPOINT", points(_strip(body, 1)))
            .when(word == "MULTIPOLYGON", parts(_strip(body, 3)))
        )
        kind = F.create_map(*[F.lit(x) for pair in KINDS.items() for x in pair])[word]
        empty = F.upper(F.trim(body)) == "EMPTY"
        none = F.array().cast(shapes.RINGS_DDL)
        return F.struct(kind.alias("kind"), F.when(empty, none).otherwise(rings).alias("rings"))

    def check(g):
        rings = g["rings"]
        areal = g["kind"].isin(*shapes.AREAL)
        fewest = F.when(areal, 4).when(g["kind"].isin(*shapes.LINEAR), 2).otherwise(1)
        single = (g["kind"] != "Point") | (F.size(rings) == 0) | (F.size(F.get(rings, F.lit(0))["xs"]) == 1)
        valid = g["kind"].isNotNull() & _rings_ok(rings, fewest, areal) & single
        return F.when(F.coalesce(valid, F.lit(False)), g)

    return F.when(text.isNotNull(), chain(text, cut, read, check))


def read_literal(text: str):
    """(kind, [(part, hole, points)]) of one WKT literal, for query shapes; None when invalid."""
    found = re.fullmatch(r"\s*([A-Za-z]+)\s*(\(.*\))\s*", text, re.DOTALL)
    kind = KINDS.get(found.group(1).upper()) if found else None
    if kind is None:
        return None
    # brackets and points as nested lists
    points = re.sub(r"([^(),]+)", lambda m: "[" + ",".join(m.group(1).split()) + "]" if m.group(1).strip() else "", found.group(2))
    try:
        nested = json.loads(points.replace("(", "[").replace(")", "]"))
        if kind in ("Point", "LineString"):
            parts = [[nested]]
        elif kind == "Polygon":
            parts = [nested]
        elif kind == "MultiPoint":
            parts = [[[p[0] if isinstance(p[0], list) else p]] for p in nested]
        elif kind == "MultiLineString":
            parts = [[line] for line in nested]
        else:
            parts = nested
        rings = [(i, j > 0, np.array(r, dtype=float).reshape(-1, 2)) for i, part in enumerate(parts) for j, r in enumerate(part)]
    except (ValueError, TypeError, IndexError):
        return None
    areal = kind in shapes.AREAL
    fewest = 4 if areal else 2 if kind in shapes.LINEAR else 1
    if any(len(r) < fewest or (areal and (r[0] != r[-1]).any()) for _, _, r in rings):
        return None
    if not rings or (kind == "Point" and len(rings[0][2]) != 1):
        return None
    return kind, rings


# ---- writing from search parameters ---------------------------------------------------------


def _pairs(items: Column) -> Column:
    """x, y, x, y -> 'x y, x y'."""
    idx = F.filter(F.sequence(F.lit(0), F.size(items) - 1), lambda i: i % 2 == 0)
    return F.array_join(F.transform(idx, lambda i: F.concat_ws(" ", F.get(items, i), F.get(items, i + 1))), ", ")


def one_shape(text: Column, geo_type: str) -> Column:
    """Bracketed coordinates of one list, or an error text."""
    opening, closing = ("((", "))") if geo_type == "POLYGON" else ("(", ")")

    def build(items):
        return (
            F.when(F.size(items) % 2 == 1, ODD_COUNT)
            .when(F.array_contains(items, ""), BLANK)
            .otherwise(F.concat(F.lit(opening), _pairs(items), F.lit(closing)))
        )

    return F.when(text.isNotNull(), let(F.split(text, ","), build))


def scalar_text_to_wkt(text: Column, geo_type: str) -> Column:
    return F.when(text.isNotNull(), F.concat(F.lit(geo_type + " "), one_shape(text, geo_type)))


def list_text_to_wkt(texts: Column, geo_type: str) -> Column:
    joined = F.array_join(F.transform(texts, lambda t: one_shape(t, geo_type)), ", ")
    return F.when(F.size(texts) > 0, F.concat(F.lit(f"MULTI{geo_type} ("), joined, F.lit(")")))


def _box_numbers(text: Column) -> Column:
    return F.transform(F.split(text, ","), lambda p: F.trim(p).try_cast("double"))


def _box_ok(numbers: Column) -> Column:
    return (F.size(numbers) == 4) & _finite(numbers)


def _box_ring(n: Column) -> Column:
    w, s, e, north = (F.get(n, F.lit(i)) for i in range(4))
    t = shapes.number_text
    pair = lambda x, y: F.concat(t(x), F.lit(" "), t(y))
    ring = F.concat_ws(", ", pair(w, s), pair(e, s), pair(e, north), pair(w, north), pair(w, s))
    return F.concat(F.lit("(("), ring, F.lit("))"))


def boxes_to_wkt(texts: Column) -> Column:
    """A list of 'w,s,e,n' -> POLYGON, MULTIPOLYGON, or an error text when any is unusable."""

    def build(numbers):
        good = F.forall(numbers, lambda n: F.coalesce(_box_ok(n), F.lit(False)))
        rings = F.transform(numbers, _box_ring)
        return (
            F.when(~good, BAD_BOX)
            .when(F.size(numbers) == 1, F.concat(F.lit("POLYGON "), F.array_join(rings, ", ")))
            .otherwise(F.concat(F.lit("MULTIPOLYGON ("), F.array_join(rings, ", "), F.lit(")")))
        )

    return F.when(F.size(texts) > 0, let(F.transform(texts, _box_numbers), build))


def circles(texts: Column) -> Column:
    """A list of 'lon,lat,radius' -> struct (wkt, radius); several give the mean radius."""

    def one(text):
        def build(items):
            right = F.size(items) == 3
            count = F.size(items).cast("string")
            wrong = F.concat(F.lit("ERROR: got "), count, F.lit(" split values instead of expected 3"))
            x, y, radius = (F.get(items, F.lit(i)) for i in range(3))
            point = F.concat(F.lit("("), x, F.lit(" "), y, F.lit(")"))
            return F.struct(
                F.when(right, point).otherwise(wrong).alias("point"),
                F.when(right, radius.try_cast("double")).alias("radius"),
            )

        return let(F.split(text, ","), build)

    def together(parsed):
        count = F.size(parsed)
        points = F.array_join(F.transform(parsed, lambda c: c["point"]), ", ")
        total = F.aggregate(parsed, F.lit(0.0), lambda acc, c: acc + c["radius"])
        text = F.when(count == 1, F.concat(F.lit("POINT "), points)).otherwise(
            F.concat(F.lit("MULTIPOINT ("), points, F.lit(")"))
        )
        return F.struct(text.alias("wkt"), (total / count).cast("int").alias("radius"))

    return F.when(F.size(texts) > 0, let(F.transform(texts, one), together))
