"""GeoJSON and STAC documents -> tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from granulake.functions import shapes

GEOMETRY_DOC = "struct<type:string,coordinates:string>"

_P = "array<double>"


def geojson_rings(geometry: Column) -> Column:
    """Rings of a GeoJSON geometry whose coordinates were read as JSON text."""
    kind, text = geometry["type"], geometry["coordinates"]

    def entry(points, part, hole):
        return F.struct(
            part.cast("int").alias("part"),
            hole.alias("hole"),
            F.transform(points, lambda p: F.get(p, F.lit(0))).alias("xs"),
            F.transform(points, lambda p: F.get(p, F.lit(1))).alias("ys"),
        )

    zero, no = F.lit(0), F.lit(False)
    point = F.from_json(text, _P)
    line = F.from_json(text, f"array<{_P}>")
    polygon = F.from_json(text, f"array<array<{_P}>>")
    multi = F.from_json(text, f"array<array<array<{_P}>>>")
    return (
        F.when(kind == "Point", F.array(entry(F.array(point), zero, no)))
        .when(kind == "LineString", F.array(entry(line, zero, no)))
        .when(kind == "MultiPoint", F.transform(line, lambda p, i: entry(F.array(p), i, no)))
        .when(kind == "MultiLineString", F.transform(polygon, lambda ln, i: entry(ln, i, no)))
        .when(kind == "Polygon", F.transform(polygon, lambda r, i: entry(r, zero, i > 0)))
        .when(
            kind == "MultiPolygon",
            F.flatten(F.transform(multi, lambda rings, i: F.transform(rings, lambda r, j: entry(r, i, j > 0)))),
        )
        .cast(shapes.RINGS_DDL)
    )


def _features(spark: SparkSession, path: str, properties: str, multiline: bool) -> DataFrame:
    feature = f"struct<type:string,id:string,geometry:{GEOMETRY_DOC},properties:struct<{properties}>>"
    reader = spark.read.schema(f"type string, features array<{feature}>").option("multiLine", str(multiline).lower())
    return reader.json(path).select(F.explode("features").alias("f")).select("f.*")


def _items(spark: SparkSession, path: str, properties: str) -> DataFrame:
    schema = f"type string, id string, geometry {GEOMETRY_DOC}, properties struct<{properties}>"
    return spark.read.schema(schema).json(path)


def _shaped(features: DataFrame, *columns: str) -> DataFrame:
    return features.select(
        *columns, "properties.*", F.col("geometry.type").alias("kind"), geojson_rings(F.col("geometry")).alias("rings")
    )


def read_geojson(spark: SparkSession, path: str, properties: str, multiline: bool = False) -> DataFrame:
    """FeatureCollection documents: the properties (a DDL like `name:string`) with kind and rings.

    `multiline` is for one pretty-printed document per file; large inputs land one per line.
    """
    return _shaped(_features(spark, path, properties, multiline))


def read_stac(
    spark: SparkSession, path: str, properties: str, mode: str = "full", pages: bool = False
) -> DataFrame:
    """STAC items, one per line, or pages of items (FeatureCollections).

    'full' keeps the id and every property; 'geojson' keeps only properties and geometry.
    """
    items = _features(spark, path, properties, False) if pages else _items(spark, path, properties)
    if mode == "full":
        return _shaped(items, "id")
    if mode == "geojson":
        return _shaped(items)
    raise ValueError(f"unknown mode {mode!r}")


def infer_properties(spark: SparkSession, path: str, share: float = 0.1) -> str:
    """DDL of the item properties found in a share of the documents, for `read_stac`."""
    schema = spark.read.option("samplingRatio", share).json(path).schema["properties"].dataType
    return schema.simpleString()[len("struct<") : -1]


def field_counts(df: DataFrame, document: str) -> DataFrame:
    """(level, field, n): first- and second-level keys and the documents holding each.

    Level 2 fields are written `outer.inner`.
    """
    parsed = df.select(F.try_parse_json(document).alias("v")).where(F.col("v").isNotNull())
    top = parsed.select(
        F.explode(F.map_entries(F.try_variant_get("v", "$", "map<string,variant>"))).alias("e")
    ).select(F.col("e.key").alias("outer"), F.col("e.value").alias("inner"))
    nested = F.map_keys(F.try_variant_get("inner", "$", "map<string,variant>"))
    fields = F.concat(
        F.array(F.struct(F.lit(1).alias("level"), F.col("outer").alias("field"))),
        F.transform(
            F.coalesce(nested, F.array().cast("array<string>")),
            lambda k: F.struct(F.lit(2).alias("level"), F.concat_ws(".", F.col("outer"), k).alias("field")),
        ),
    )
    return top.select(F.explode(fields).alias("f")).groupBy("f.level", "f.field").agg(F.count(F.lit(1)).alias("n"))
