"""Headline queries on prepared tables: prints one JSON line with seconds per query.

The tables are prepared first and not timed: granules as a plain table, as a table in bin and year
folders, and service logs as gzip text. Every query runs twice; the second run counts.
"""

from __future__ import annotations

import json
import os
import sys
import time
from statistics import median

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

from pyspark.sql import functions as F  # noqa: E402

from granulake.functions import geohash, shapes  # noqa: E402
from granulake.functions.geometry_batch import encode_wkb  # noqa: E402
from granulake.operators import categories, joins, layout, logs, search  # noqa: E402
from granulake.plans import inputs, searches  # noqa: E402
from granulake.session import build_session, prepare, scratch  # noqa: E402
from granulake.sinks import tables as sinks  # noqa: E402
from granulake.sources.spec import Operation, Predicate, Search  # noqa: E402

SF_DIR = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
CPUS = os.environ.get("BENCH_CPUS", "8")
BOX = search.BOX


def prepared(spark):
    """Paths of the prepared tables."""
    granules, binned, lines = (scratch(spark, f"bench-{n}") for n in ("granules", "binned", "logs"))
    rings = shapes.box_rings(*[F.col(c) for c in BOX])
    table = inputs.granules(spark, SF_DIR).withColumn("geometry", encode_wkb(F.lit("Polygon"), rings))
    table = layout.spatial_shuffle(table, int(CPUS), tie=["GranuleUR"]).drop("curve_key")
    sinks.write_row_groups(sinks.with_covering_box(table), granules, rows=20_000)
    stored = spark.read.parquet(granules)
    sinks.write_folders(geohash.with_box_bins(stored), binned, "hashbin", "year")
    text = inputs.log_lines(spark, SF_DIR).select(F.col("line").alias("value"))
    text.repartition(int(CPUS)).write.option("compression", "gzip").text(lines)
    return granules, binned, lines


def run(df) -> None:
    df.write.format("noop").mode("overwrite").save()


def queries(spark, granules, binned, lines):
    stored = spark.read.parquet(granules)
    folders = spark.read.schema(stored.drop("year").schema.add("hashbin", "string").add("year", "integer")).parquet(binned)
    near = Predicate(
        "attribute_raw", statement="-30.0 <= MBREast and 60.0 >= MBRWest and -35.0 <= MBRNorth and 45.0 >= MBRSouth"
    )
    after = Predicate("time", option="greater-then", value=inputs.SINCE)
    shape = Predicate("geometry", option="intersects", value=inputs.QUERY_POLYGON)
    simple = Search(columns=("GranuleUR",), sortby="GranuleUR", operations=(Operation(ands=(near, after)),))
    exact = Search(columns=("GranuleUR",), sortby="GranuleUR", operations=(Operation(ands=(shape, after)),))
    return {
        "box_time_sorted": lambda: run(search.search(stored.drop("year"), simple)),
        "box_time_sorted_binned": lambda: run(search.search(folders, simple)),
        "shape_time_sorted": lambda: run(search.search(stored, exact)),
        "shape_time_sorted_binned": lambda: run(search.search(folders, exact)),
        "interior_or_exact": lambda: run(
            search.interior_or_exact(stored, searches.shape_wkb(inputs.QUERY_RING), inputs.INTERIOR_BOX).select("GranuleUR")
        ),
        "hash_bins_counted": lambda: run(layout.count_bins(geohash.with_box_bins(stored))),
        "hash_bins_written": lambda: sinks.write_bins(geohash.with_box_bins(stored), scratch(spark, "bench-bins")),
        "shape_table_join": lambda: run(joins.shape_join(stored.select("GranuleUR", *BOX), searches.query_shapes(spark, SF_DIR))),
        "logs_parsed": lambda: run(logs.log_table(logs.read_lines(spark, lines))),
        "log_category_percentiles": lambda: run(
            categories.duration_percentiles(categories.categorise(logs.log_table(logs.read_lines(spark, lines))))
        ),
    }


def main() -> None:
    spark = prepare(build_session("granulake-bench", CPUS))
    seconds = {}
    for name, call in queries(spark, *prepared(spark)).items():
        call()
        runs = []
        while len(runs) < 5 and sum(runs) < 15:  # the median of five, or of fewer slow ones
            start = time.perf_counter()
            call()
            runs.append(time.perf_counter() - start)
        seconds[name] = round(median(runs), 3)
    spark.stop()
    print(
        json.dumps(
            {
                "metric": "headline queries, total",
                "value": round(sum(seconds.values()), 3),
                "unit": "sec",
                "queries": seconds,
                "sf": os.path.basename(SF_DIR.rstrip("/")),
            }
        )
    )


if __name__ == "__main__":
    main()
