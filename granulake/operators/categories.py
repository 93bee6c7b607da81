"""Query categories of the log table: flags, percentile ranks, codes and their coverage."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from granulake.functions import shapes
from granulake.functions.staging import let, once
from granulake.functions.wkt import parse
from granulake.operators.ordering import ecdfs, exact_quantiles
from granulake.session import cut

# Categories of the benchmark searches.
SUITE_CATEGORIES = {
    "BBOX_time_sort_largeArea": "11110",
    "shape_time_sort_largeArea_largeVertex": "11111",
    "time_sort": "01100",
    "BBOX_time_largeArea": "11010",
    "shape_time_largeArea_largeVertex": "11011",
    "time": "01000",
}

# Fixed value: percentile rank above which an area or a vertex count is large.
LARGE = 0.99

TRIVIAL = "00000"
FLAG_NAMES = ("Spatial", "Temporal", "Sort", "Area99", "Vertex99")


def with_flags(log: DataFrame) -> DataFrame:
    return log.withColumns(
        {
            "spatial_bool": F.col("geo_type").isNotNull(),
            "temporal_bool": F.col("time_query").isNotNull(),
            "sort_bool": F.col("sort_key").isNotNull(),
            "sort_count": sort_count(F.col("sort_key")),
            "prov_coll": provider_or_collection(F.col("provider"), F.col("concept_id")),
        }
    )


def sort_count(sort_key: Column) -> Column:
    return shapes.vertex_count_of_text(sort_key)


def provider_or_collection(provider: Column, concept: Column) -> Column:
    return (
        F.when(provider.isNotNull() & concept.isNotNull(), "Both")
        .when(provider.isNotNull(), "Provider")
        .when(concept.isNotNull(), "Collection")
        .otherwise("")
    )


def with_measures(log: DataFrame) -> DataFrame:
    """Vertex count of every shape; planar area of polygon and box queries."""
    areal = F.col("geo_type").isin("BBOX", "POLYGON") & F.col("wkt").isNotNull()
    area = let(parse(F.col("wkt")), lambda g: shapes.area(g["kind"], g["rings"]))
    counted = log.withColumn("vertex_count", shapes.vertex_count_of_text(F.col("wkt")))
    return once(counted, "polygon_area", F.when(areal, area))


def with_ranks(log: DataFrame) -> DataFrame:
    """Percentile ranks: vertices against polygon queries only, areas against all areas.

    The measured table is read several times; it should be a stored one.
    """
    polygons = F.col("geo_type") == "POLYGON"
    return ecdfs(log, {"vertex_pctile": ("vertex_count", polygons, 6), "area_pctile": ("polygon_area", None, None)})


def category_code() -> Column:
    """Five flags as text: spatial, temporal, sort, large area, large vertex count."""
    large = lambda name: F.coalesce(F.col(name), F.lit(0.0)) > LARGE
    flags = [F.col("spatial_bool"), F.col("temporal_bool"), F.col("sort_bool"), large("area_pctile"), large("vertex_pctile")]
    return F.concat(*[f.cast("int").cast("string") for f in flags])


def categorise(log: DataFrame) -> DataFrame:
    """The granule queries of a log table with their category `test_cat`.

    The measured table is stored once: both distributions and the final pass read it.
    """
    ranked = with_ranks(cut(with_measures(with_flags(log)), "measured"))
    return ranked.where(F.col("concept") == "granules").withColumn("test_cat", category_code())


def expand(df: DataFrame, code: str = "test_cat") -> DataFrame:
    return df.withColumns({n: F.substring(code, i + 1, 1) == "1" for i, n in enumerate(FLAG_NAMES)})


def duration_percentiles(categorised: DataFrame) -> DataFrame:
    """n, p50, p95 and p99 of the duration per category. Two passes read the two columns, which are stored once."""
    timed = cut(categorised.where(F.col("duration").isNotNull()).select("test_cat", "duration"), "durations")
    return exact_quantiles(timed, "duration", [0.5, 0.95, 0.99], ["test_cat"])


def suite_table(spark) -> DataFrame:
    return spark.createDataFrame(
        [(name, code) for name, code in SUITE_CATEGORIES.items()], "test_type string, test_cat string"
    )


def suite_percentiles(percentiles: DataFrame) -> DataFrame:
    """Every suite category with its log summary, NULL when the log has none."""
    suite = suite_table(percentiles.sparkSession)
    return percentiles.join(F.broadcast(suite), "test_cat", "right")


def not_in_suite(percentiles: DataFrame) -> DataFrame:
    return percentiles.join(F.broadcast(suite_table(percentiles.sparkSession)), "test_cat", "left_anti")


def in_suite(percentiles: DataFrame) -> DataFrame:
    return percentiles.join(F.broadcast(suite_table(percentiles.sparkSession)), "test_cat", "left_semi")


def coverage(categorised: DataFrame, top: int = 7) -> DataFrame:
    """Shares of timed queries: in the suite, in the suite without the trivial category, in the
    `top` most frequent categories."""
    counts = categorised.where(F.col("duration").isNotNull()).groupBy("test_cat").agg(F.count(F.lit(1)).alias("n"))
    covered = F.col("test_cat").isin(*SUITE_CATEGORIES.values())
    shares = counts.agg(
        F.coalesce(F.sum(F.when(covered, F.col("n"))), F.lit(0)).alias("covered"),
        F.sum("n").alias("total"),
        F.sum(F.when(F.col("test_cat") != TRIVIAL, F.col("n"))).alias("non_trivial"),
    )
    leading = counts.orderBy(F.desc("n"), "test_cat").limit(top).agg(F.sum("n"))
    return shares.select(
        (F.col("covered") / F.col("total")).alias("suite_share"),
        (F.col("covered") / F.col("non_trivial")).alias("suite_share_non_trivial"),
        (leading.scalar() / F.col("total")).alias("top_share"),
    )


def upload_vs_parsed(log: DataFrame, uploads: DataFrame) -> DataFrame:
    """Total of uploaded shapes beside the number of spatial queries."""
    spatial = log.agg(F.count_if(F.col("geo_type").isNotNull()).alias("parsed"))
    uploaded = uploads.agg(F.coalesce(F.sum("n"), F.lit(0)))
    return spatial.withColumn("uploaded", uploaded.scalar())
