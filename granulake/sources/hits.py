"""Landed search hits (one JSON document per line) -> granule rows, one per shape."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from granulake.functions import geometry_batch, shapes
from granulake.functions.staging import let
from granulake.schemas import GRANULE_COLUMNS, HIT_COLUMNS, HIT_DOCUMENT_DDL

# Shape code -> (kind, fewest coordinate pairs, most pairs or None).
SHAPE_CODES = {
    1: ("Polygon", 3, None),
    2: ("Hole", 3, None),
    3: ("Rectangle", 2, 2),
    4: ("Point", 1, 1),
    5: ("LineString", 2, None),
    6: ("Polygon", 3, None),
    7: ("Hole", 3, None),
    8: ("LineString", 2, None),
}

# Fixed value: coordinates are stored as degrees x 1e7.
ORD_SCALE = 1e7

SHAPE_DDL = "struct<code:int,kind:string,xs:array<double>,ys:array<double>>"


def read_hits(spark: SparkSession, path: str) -> DataFrame:
    """Hit documents as named columns plus `ords` and `ords_info`.

    A hit without either coordinate list is skipped as a whole row; any other missing key is NULL.
    """
    source = spark.read.schema(HIT_DOCUMENT_DDL).json(path).select("_source.*")
    kept = source.where(F.col("ords").isNotNull() & F.col("`ords-info`").isNotNull())
    named = [F.col(f"`{key}`").alias(name) for name, key, _ in HIT_COLUMNS]
    return kept.select(*named, "ords", F.col("`ords-info`").alias("ords_info"))


def decode_ords(ords: Column, info: Column) -> Column:
    """Array of shapes (code, kind, xs, ys) of one granule; empty when anything is wrong.

    `info` holds (code, size) pairs; each size takes the next coordinates. Polygons and holes are
    closed, a rectangle becomes its four corners.
    """
    pairs = F.transform(
        F.when(F.size(info) > 1, F.sequence(F.lit(0), F.size(info) - 2, F.lit(2))).otherwise(
            F.array().cast("array<int>")
        ),
        lambda i: F.struct(F.get(info, i).alias("code"), F.get(info, i + 1).alias("size")),
    )
    start = F.struct(F.lit(0).alias("at"), F.array().cast("array<struct<code:int,size:int,at:int>>").alias("out"))
    placed = F.aggregate(
        pairs,
        start,
        lambda acc, p: F.struct(
            (acc["at"] + p["size"]).alias("at"),
            F.concat(
                acc["out"],
                F.array(F.struct(p["code"].alias("code"), p["size"].alias("size"), acc["at"].alias("at"))),
            ).alias("out"),
        ),
        lambda acc: acc["out"],
    )
    kinds = F.create_map(*[F.lit(v) for code, (kind, _, _) in SHAPE_CODES.items() for v in (code, kind)])
    fewest = F.create_map(*[F.lit(v) for code, (_, low, _) in SHAPE_CODES.items() for v in (code, low)])
    most = F.create_map(*[F.lit(v) for code, (_, _, high) in SHAPE_CODES.items() for v in (code, high or 2**31 - 1)])

    def shape(p):
        part = F.slice(ords, p["at"] + 1, F.greatest(p["size"], F.lit(0)))
        half = F.filter(part, lambda _, i: i % 2 == 0), F.filter(part, lambda _, i: i % 2 == 1)
        xs, ys = (F.transform(h, lambda v: v / F.lit(ORD_SCALE)) for h in half)
        return F.struct(p["code"].alias("code"), kinds[p["code"]].alias("kind"), xs.alias("xs"), ys.alias("ys"))

    def usable(s):
        n = F.size(s["xs"])
        ok = (n == F.size(s["ys"])) & (n >= fewest[s["code"]]) & (n <= most[s["code"]])
        return F.coalesce(ok, F.lit(False))

    def finished(s):
        xs, ys = s["xs"], s["ys"]
        first = lambda a: F.slice(a, 1, 1)
        last = lambda a: F.slice(a, -1, 1)
        ring_kind = s["kind"].isin("Polygon", "Hole")
        is_open = ring_kind & ((first(xs) != last(xs)) | (first(ys) != last(ys)))
        box = s["kind"] == "Rectangle"
        x = lambda i: F.get(xs, F.lit(i))
        y = lambda i: F.get(ys, F.lit(i))
        new_xs = F.when(box, F.array(x(0), x(0), x(1), x(1), x(0))).when(is_open, F.concat(xs, first(xs))).otherwise(xs)
        new_ys = F.when(box, F.array(y(0), y(1), y(1), y(0), y(0))).when(is_open, F.concat(ys, first(ys))).otherwise(ys)
        return F.struct(
            s["code"].alias("code"), s["kind"].alias("kind"), new_xs.alias("xs"), new_ys.alias("ys")
        )

    def whole(found):
        good = (F.size(info) % 2 == 0) & F.forall(found, usable)
        none = F.array().cast(f"array<{SHAPE_DDL}>")
        return F.when(F.coalesce(good, F.lit(False)), F.transform(found, finished)).otherwise(none)

    return let(F.transform(placed, shape), whole)


def explode_shapes(df: DataFrame, shapes_column: str = "shapes") -> DataFrame:
    """One row per shape with its number; granules without shapes vanish."""
    scalars = [c for c in df.columns if c != shapes_column]
    return df.select(*scalars, F.posexplode(shapes_column).alias("shape_no", "shape"))


def granule_table(hits: DataFrame) -> DataFrame:
    """The prepared granule table: 32 columns and the WKB geometry last."""
    decoded = hits.withColumn("shapes", decode_ords(F.col("ords"), F.col("ords_info"))).drop("ords", "ords_info")
    rows = explode_shapes(decoded)
    kind = F.when(F.col("shape.kind").isin("Hole", "Rectangle"), "Polygon").otherwise(F.col("shape.kind"))
    rings = F.array(shapes.ring(F.col("shape.xs"), F.col("shape.ys")))
    return rows.withColumn("geometry", geometry_batch.encode_wkb(kind, rings)).select(*GRANULE_COLUMNS)
