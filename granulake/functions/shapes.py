"""Geometry columns as rings, measured and reshaped with array functions.

A geometry is a `kind` string and `rings`: one entry per ring, line or point with its part number,
a hole flag and its coordinates as two arrays. Polygon rings are closed. All maths is planar,
x = longitude, y = latitude.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from granulake.functions.staging import let

RINGS_DDL = "array<struct<part:int,hole:boolean,xs:array<double>,ys:array<double>>>"
GEOMETRY_DDL = f"struct<kind:string,rings:{RINGS_DDL}>"

AREAL = ("Polygon", "MultiPolygon")
LINEAR = ("LineString", "MultiLineString")


# ---- building ------------------------------------------------------------------------------


def _doubles(values) -> Column:
    return F.array(*[(v if isinstance(v, Column) else F.lit(float(v))).cast("double") for v in values])


def ring(xs: Column, ys: Column, hole: bool = False, part: int = 0) -> Column:
    return F.struct(
        F.lit(part).cast("int").alias("part"),
        F.lit(hole).alias("hole"),
        xs.cast("array<double>").alias("xs"),
        ys.cast("array<double>").alias("ys"),
    )


def polygon_rings(points) -> Column:
    """Rings of one polygon from (x, y) pairs of columns or numbers; closed if left open."""
    points = list(points)
    # columns are compared by identity: `!=` on them builds an expression
    same = [a is b or (not isinstance(a, Column) and not isinstance(b, Column) and a == b) for a, b in zip(points[0], points[-1])]
    if not all(same):
        points.append(points[0])
    return F.array(ring(_doubles([p[0] for p in points]), _doubles([p[1] for p in points])))


def box_rings(xmin: Column, ymin: Column, xmax: Column, ymax: Column) -> Column:
    corners = [(xmin, ymin), (xmax, ymin), (xmax, ymax), (xmin, ymax), (xmin, ymin)]
    return F.array(ring(_doubles([c[0] for c in corners]), _doubles([c[1] for c in corners])))


def point_rings(x: Column, y: Column) -> Column:
    return F.array(ring(F.array(x), F.array(y)))


# ---- bounds --------------------------------------------------------------------------------


def _extreme(rings: Column, axis: str, pick) -> Column:
    return pick(F.transform(rings, lambda r: pick(r[axis])))


def xmin(rings: Column) -> Column:
    return _extreme(rings, "xs", F.array_min)


def xmax(rings: Column) -> Column:
    return _extreme(rings, "xs", F.array_max)


def ymin(rings: Column) -> Column:
    return _extreme(rings, "ys", F.array_min)


def ymax(rings: Column) -> Column:
    return _extreme(rings, "ys", F.array_max)


def bbox(rings: Column) -> Column:
    """Covering box struct."""
    return F.struct(
        xmin(rings).alias("xmin"), ymin(rings).alias("ymin"), xmax(rings).alias("xmax"), ymax(rings).alias("ymax")
    )


def with_bounds(df: DataFrame, rings: str = "rings") -> DataFrame:
    """Add minx, miny, maxx, maxy beside the row."""
    r = F.col(rings)
    return df.withColumns({"minx": xmin(r), "miny": ymin(r), "maxx": xmax(r), "maxy": ymax(r)})


# ---- measures ------------------------------------------------------------------------------


def _steps(xs: Column) -> Column:
    """Indexes of the segments of a coordinate array; empty for a single point."""
    return F.when(F.size(xs) > 1, F.sequence(F.lit(1), F.size(xs) - 1)).otherwise(F.array().cast("array<int>"))


def _ring_sums(r: Column) -> Column:
    """Signed double area, its first moments, length and length moments of one ring.

    Moments are taken about the first vertex, which keeps the digits of small far-away shapes.
    """
    xs, ys = r["xs"], r["ys"]
    x0, y0 = F.get(xs, F.lit(0)), F.get(ys, F.lit(0))
    zero = F.struct(*[F.lit(0.0).alias(n) for n in ("a", "ax", "ay", "len", "lx", "ly")])

    def add(acc, i):
        ux, uy = F.get(xs, i - 1) - x0, F.get(ys, i - 1) - y0
        vx, vy = F.get(xs, i) - x0, F.get(ys, i) - y0
        cross = ux * vy - vx * uy
        length = F.sqrt((vx - ux) * (vx - ux) + (vy - uy) * (vy - uy))
        return F.struct(
            (acc["a"] + cross).alias("a"),
            (acc["ax"] + (ux + vx) * cross).alias("ax"),
            (acc["ay"] + (uy + vy) * cross).alias("ay"),
            (acc["len"] + length).alias("len"),
            (acc["lx"] + length * (ux + vx) / 2).alias("lx"),
            (acc["ly"] + length * (uy + vy) / 2).alias("ly"),
        )

    return F.aggregate(_steps(xs), zero, add)


def _signed(r: Column, value: Column) -> Column:
    return F.when(r["hole"], -F.abs(value)).otherwise(F.abs(value))


def area(kind: Column, rings: Column) -> Column:
    """Planar area, holes subtracted; 0 for points and lines."""

    def ring_area(r):
        xs, ys = r["xs"], r["ys"]
        x0, y0 = F.get(xs, F.lit(0)), F.get(ys, F.lit(0))
        twice = F.aggregate(
            _steps(xs),
            F.lit(0.0),
            lambda acc, i: acc
            + (F.get(xs, i - 1) - x0) * (F.get(ys, i) - y0)
            - (F.get(xs, i) - x0) * (F.get(ys, i - 1) - y0),
        )
        return _signed(r, twice / 2)

    total = F.aggregate(rings, F.lit(0.0), lambda acc, r: acc + ring_area(r))
    return F.when(rings.isNull(), F.lit(None)).when(kind.isin(*AREAL), total).otherwise(F.lit(0.0))


def centroid(kind: Column, rings: Column) -> Column:
    """Struct (x, y): by area, else by length, else the mean of the vertices."""

    def ring_part(r):
        s = _ring_sums(r)
        return F.struct(r.alias("r"), s.alias("s"))

    start = F.struct(*[F.lit(0.0).alias(n) for n in ("w", "wx", "wy", "len", "lx", "ly", "n", "sx", "sy")])

    def add(acc, part):
        r, s = part["r"], part["s"]
        x0, y0 = F.get(r["xs"], F.lit(0)), F.get(r["ys"], F.lit(0))
        sign = F.when(r["hole"], -1.0).otherwise(1.0) * F.signum(s["a"])
        weight = sign * s["a"] / 2
        count = F.size(r["xs"]).cast("double")
        total = lambda values: F.aggregate(values, F.lit(0.0), lambda a, v: a + v)
        return F.struct(
            (acc["w"] + weight).alias("w"),
            (acc["wx"] + weight * x0 + sign * s["ax"] / 6).alias("wx"),
            (acc["wy"] + weight * y0 + sign * s["ay"] / 6).alias("wy"),
            (acc["len"] + s["len"]).alias("len"),
            (acc["lx"] + s["len"] * x0 + s["lx"]).alias("lx"),
            (acc["ly"] + s["len"] * y0 + s["ly"]).alias("ly"),
            (acc["n"] + count).alias("n"),
            (acc["sx"] + total(r["xs"])).alias("sx"),
            (acc["sy"] + total(r["ys"])).alias("sy"),
        )

    def finish(acc):
        by_area = kind.isin(*AREAL) & (acc["w"] != 0)
        by_length = ~kind.isin("Point", "MultiPoint") & (acc["len"] != 0)
        return F.when(by_area, F.struct((acc["wx"] / acc["w"]).alias("x"), (acc["wy"] / acc["w"]).alias("y"))).when(
            by_length, F.struct((acc["lx"] / acc["len"]).alias("x"), (acc["ly"] / acc["len"]).alias("y"))
        ).when(acc["n"] > 0, F.struct((acc["sx"] / acc["n"]).alias("x"), (acc["sy"] / acc["n"]).alias("y")))

    return F.aggregate(F.transform(rings, ring_part), start, add, finish)


def vertex_count(rings: Column) -> Column:
    """Coordinate count over all rings."""
    return F.aggregate(rings, F.lit(0), lambda acc, r: acc + F.size(r["xs"]))


def vertex_count_of_text(wkt: Column) -> Column:
    """Commas + 1, the count used on query texts."""
    return F.regexp_count(wkt, F.lit(",")) + 1


# ---- derived shapes ------------------------------------------------------------------------


def envelope(rings: Column) -> Column:
    return let(bbox(rings), lambda b: box_rings(b["xmin"], b["ymin"], b["xmax"], b["ymax"]))


def corners(rings: Column) -> Column:
    """Corner points of the envelope: lower left, lower right, upper right, upper left."""

    def named(b):
        w, s, e, n = b["xmin"], b["ymin"], b["xmax"], b["ymax"]
        points = [("LL", w, s), ("LR", e, s), ("UR", e, n), ("UL", w, n)]
        return F.array(*[F.struct(F.lit(k).alias("corner"), x.alias("x"), y.alias("y")) for k, x, y in points])

    return let(bbox(rings), named)


def corner_multipoint(rings: Column) -> Column:
    """Rings of the MultiPoint of the four envelope corners."""
    return F.transform(
        corners(rings),
        lambda c, i: F.struct(
            i.cast("int").alias("part"), F.lit(False).alias("hole"), F.array(c["x"]).alias("xs"), F.array(c["y"]).alias("ys")
        ),
    )


def shrink_box(kind: Column, rings: Column, factor: float = 0.5) -> Column:
    """Envelope inset by `factor` x distance(centroid, lower-left corner); empty when it vanishes."""

    def inset(v):
        b, c = v["b"], v["c"]
        dx, dy = c["x"] - b["xmin"], c["y"] - b["ymin"]
        return F.struct(b.alias("b"), (F.sqrt(dx * dx + dy * dy) * factor).alias("d"))

    def shrunk(v):
        b, d = v["b"], v["d"]
        gone = (d * 2 >= b["xmax"] - b["xmin"]) | (d * 2 >= b["ymax"] - b["ymin"])
        small = box_rings(b["xmin"] + d, b["ymin"] + d, b["xmax"] - d, b["ymax"] - d)
        return F.when(gone, F.array().cast(RINGS_DDL)).otherwise(small)

    return let(let(F.struct(bbox(rings).alias("b"), centroid(kind, rings).alias("c")), inset), shrunk)


def normalize(rings: Column) -> Column:
    """Canonical vertex order, so that equal shapes have equal values.

    Closed rings start at their smallest vertex, shells run counter-clockwise and holes clockwise;
    lines start at their smaller end. Rings are sorted, shells before their holes.
    """

    def keep(r, **more):
        return F.struct(r["part"].alias("part"), r["hole"].alias("hole"), *[v.alias(k) for k, v in more.items()])

    def with_points(r):
        points = F.zip_with(r["xs"], r["ys"], lambda x, y: F.struct(x.alias("x"), y.alias("y")))
        return keep(r, p=points, a=_ring_sums(r)["a"])

    def directed(r):
        p = r["p"]
        closed = (F.size(p) > 3) & (F.element_at(p, 1) == F.element_at(p, -1))
        backwards = F.when(closed, (r["a"] < 0) != r["hole"]).otherwise(F.element_at(p, -1) < F.element_at(p, 1))
        return keep(r, p=F.when(backwards, F.reverse(p)).otherwise(p), closed=closed)

    def opened(r):
        body = F.when(r["closed"], F.slice(r["p"], F.lit(1), F.size(r["p"]) - 1)).otherwise(r["p"])
        return keep(r, p=body, closed=r["closed"], low=F.array_position(body, F.array_min(body)).cast("int"))

    def turned(r):
        p, low = r["p"], r["low"]
        moved = F.concat(F.slice(p, low, F.size(p) - low + 1), F.slice(p, F.lit(1), low - 1), F.slice(p, low, F.lit(1)))
        return keep(r, p=F.when(r["closed"], moved).otherwise(p))

    def as_ring(r):
        return keep(r, xs=F.transform(r["p"], lambda v: v["x"]), ys=F.transform(r["p"], lambda v: v["y"]))

    out = rings
    for step in (with_points, directed, opened, turned, as_ring):
        out = F.transform(out, step)
    return F.array_sort(out)


# ---- text ----------------------------------------------------------------------------------


def number_text(value: Column) -> Column:
    """Shortest text of a coordinate: whole numbers without a decimal point."""
    whole = (value == F.floor(value)) & (F.abs(value) < 1e15)
    return F.when(whole, value.cast("bigint").cast("string")).otherwise(value.cast("string"))


def ring_text(xs: Column, ys: Column) -> Column:
    pairs = F.zip_with(xs, ys, lambda x, y: F.concat(number_text(x), F.lit(" "), number_text(y)))
    return F.concat(F.lit("("), F.array_join(pairs, ", "), F.lit(")"))


def wkt(kind: Column, rings: Column) -> Column:
    """WKT of a geometry column."""
    texts = F.transform(rings, lambda r: ring_text(r["xs"], r["ys"]))
    joined = F.array_join(texts, ", ")
    parts = F.array_distinct(F.transform(rings, lambda r: r["part"]))
    multi = F.transform(
        parts,
        lambda p: F.concat(
            F.lit("("),
            F.array_join(
                F.transform(F.filter(rings, lambda r: r["part"] == p), lambda r: ring_text(r["xs"], r["ys"])), ", "
            ),
            F.lit(")"),
        ),
    )
    name = F.upper(kind)
    return (
        F.when(kind.isNull() | rings.isNull(), F.lit(None).cast("string"))
        .when(F.size(rings) == 0, F.concat(name, F.lit(" EMPTY")))
        .when(kind.isin("Point", "LineString"), F.concat(name, F.lit(" "), joined))
        .when(kind == "MultiPolygon", F.concat(name, F.lit(" ("), F.array_join(multi, ", "), F.lit(")")))
        .otherwise(F.concat(name, F.lit(" ("), joined, F.lit(")")))
    )


# ---- maps and curves -----------------------------------------------------------------------

# Fixed value: equatorial radius of WGS 84 in metres.
EARTH_RADIUS = 6378137.0


def mercator(lon: Column, lat: Column) -> Column:
    """EPSG:4326 -> EPSG:3857 as struct (x, y); no value at the poles."""
    x = F.lit(EARTH_RADIUS) * F.radians(lon)
    y = F.lit(EARTH_RADIUS) * F.log(F.tan(F.lit(0.7853981633974483) + F.radians(lat) / 2))
    inside = F.abs(lat) < 90
    return F.struct(F.when(inside, x).alias("x"), F.when(inside, y).alias("y"))


def split_antimeridian(
    df: DataFrame,
    west: str = "MBRWest",
    east: str = "MBREast",
    crosses: Column | None = None,
    part: str = "part",
) -> DataFrame:
    """A box over +-180 becomes two rows, one on each side; other boxes stay one row."""
    crosses = (F.col(west) > F.col(east)) if crosses is None else crosses
    side = lambda n, w, e: F.struct(F.lit(n).alias("n"), w.cast("double").alias("w"), e.cast("double").alias("e"))
    sides = F.when(
        crosses, F.array(side(1, F.col(west), F.lit(180.0)), side(2, F.lit(-180.0), F.col(east)))
    ).otherwise(F.array(side(1, F.col(west), F.col(east))))
    return (
        df.withColumn("_side", F.explode(sides))
        .withColumns({west: F.col("_side.w"), east: F.col("_side.e"), part: F.col("_side.n")})
        .drop("_side")
    )
