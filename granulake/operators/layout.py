"""Where rows go: bins, bucket trees, curve order, partition extents and bin-pruned lookup."""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from granulake.functions import curves, geohash

BOX = ("MBRWest", "MBRSouth", "MBREast", "MBRNorth")

# Longest list of cell names put into one partition filter.
MAX_NAMED_CELLS = 1024


def spatial_shuffle(
    df: DataFrame,
    partitions: int,
    box: tuple[str, str, str, str] = BOX,
    curve: str = "hilbert",
    tie: Sequence[str] = (),
    bits: int = 16,
) -> DataFrame:
    """Redistribute along a curve, sorted inside each partition. `tie` columns split a heavy cell."""
    keyed = curves.with_curve_key(df, box, curve, bits)
    keys = ["curve_key", *tie]
    return keyed.repartitionByRange(partitions, *keys).sortWithinPartitions(*keys)


def spread_for_write(df: DataFrame, *keys: str) -> DataFrame:
    """Bring equal keys together for a partitioned write; heavy keys are split into several tasks
    by adaptive execution, small ones share a task."""
    return df.hint("rebalance", *[F.col(k) for k in keys])


def spread_small(df: DataFrame) -> DataFrame:
    """Deals the rows of a table of few splits to all cores, before work that is heavy or makes many rows of one.

    Spark's estimate of the size decides, so nothing runs for it; a table with a split a core stays as it is read.
    """
    spark = df.sparkSession
    cores = spark.sparkContext.defaultParallelism
    split = spark._jsparkSession.sessionState().conf().filesMaxPartitionBytes()
    size = int(str(df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()))
    return df.repartition(cores) if size < cores * split else df


# ---- bucket trees --------------------------------------------------------------------------


def with_tree_columns(df: DataFrame, path: str = "path", depth: int = 3) -> DataFrame:
    """Split a bin path into one partition column per level: `region` or `g1`..`gN` ('-' when unused)."""
    in_cell = F.lower(F.substring(F.col(path), 1, 1)) == F.col(path)
    in_cell = in_cell | F.col(path).contains("/")
    parts = F.split(F.col(path), "/")
    columns = {"region": F.when(in_cell, F.lit("-")).otherwise(F.col(path))}
    for level in range(depth):
        letter = F.get(parts, F.lit(level))
        columns[f"g{level + 1}"] = F.when(in_cell & letter.isNotNull(), letter).otherwise(F.lit("-"))
    return df.withColumns(columns)


def bucket_filter(box: tuple[float, float, float, float], depth: int = 3) -> Column:
    """Partition filter of the buckets that can hold rows overlapping a box.

    Rows live in their deepest enclosing cell, so the filter keeps, per level, the cells the box
    touches, together with the shallower buckets above them, and every region bucket.
    """
    keep = F.col("region") != "-"
    cells, known = [""], 0
    for level in range(1, depth + 1):
        # a very wide box names its cells only down to the level where the list stays short
        if known == level - 1 and _cell_count(box, level) <= MAX_NAMED_CELLS:
            cells, known = covering_cells(*box, level), level
        letters = F.concat(*[F.col(f"g{i + 1}") for i in range(known)]) if known else F.lit("")
        here = F.col(f"g{level}") != "-"
        deeper = F.col(f"g{level + 1}") == "-" if level < depth else F.lit(True)
        # the first letters are checked on their own so that pruning starts at the top folder
        tops = sorted({c[:1] for c in cells})
        keep = keep | (F.col("g1").isin(*tops) & letters.isin(*cells) & here & deeper)
    return keep


def covering_cells(xmin: float, ymin: float, xmax: float, ymax: float, precision: int) -> list[str]:
    """Hashes of the cells of one precision that a (literal) search box touches."""
    columns, rows = _cell_spans((xmin, ymin, xmax, ymax), precision)
    return [_cell_name(x, y, precision) for x in columns for y in rows]


def _cell_spans(box: tuple[float, float, float, float], precision: int) -> tuple[range, range]:
    lon_bits, lat_bits = geohash._bits(precision)

    def span(low, high, start, width, bits):
        size = 2**bits
        first = int(np.floor((low - start) / width * size))
        last = int(np.floor((high - start) / width * size))
        return range(max(0, min(first, size - 1)), max(0, min(last, size - 1)) + 1)

    xmin, ymin, xmax, ymax = box
    return span(xmin, xmax, -180.0, 360.0, lon_bits), span(ymin, ymax, -90.0, 180.0, lat_bits)


def _cell_count(box: tuple[float, float, float, float], precision: int) -> int:
    columns, rows = _cell_spans(box, precision)
    return len(columns) * len(rows)


def _cell_name(x: int, y: int, precision: int) -> str:
    lon_bits, lat_bits = geohash._bits(precision)
    letters = []
    for place in range(precision):
        lon_used, lat_used = geohash._bits(place)
        if place % 2 == 0:
            three, two = (x >> (lon_bits - lon_used - 3)) & 7, (y >> (lat_bits - lat_used - 2)) & 3
        else:
            three, two = (y >> (lat_bits - lat_used - 3)) & 7, (x >> (lon_bits - lon_used - 2)) & 3
        letters.append(geohash.CHUNK_LETTERS[three * 4 + two])
    return "".join(letters)


def flat_bin_filter(box: tuple[float, float, float, float], column: str = "hashbin") -> Column:
    """Bins of a flat (one-letter) layout that can hold rows overlapping a box."""
    cells = covering_cells(*box, 1)
    return F.col(column).isin(*cells) | (F.length(column) > 1)


def overlaps(box: tuple[float, float, float, float], columns: tuple[str, str, str, str] = BOX) -> Column:
    xmin, ymin, xmax, ymax = (float(v) for v in box)
    w, s, e, n = (F.col(c) for c in columns)
    return (F.lit(xmin) <= e) & (F.lit(xmax) >= w) & (F.lit(ymin) <= n) & (F.lit(ymax) >= s)


def lookup(
    tree: DataFrame,
    box: tuple[float, float, float, float],
    depth: int = 3,
    columns: tuple[str, str, str, str] = BOX,
) -> DataFrame:
    """Rows of a bucket tree that overlap a box; the partition filter prunes whole folders."""
    return tree.where(bucket_filter(box, depth)).where(overlaps(box, columns))


# ---- bin tables ----------------------------------------------------------------------------

# Order of the region bins in the bin table; letters follow.
REGION_ORDER = ("All", "NE-NW", "NE", "NW", "SE-NE", "SW-NW", "SW", "SE", "SW-SE", "Central")


def count_bins(df: DataFrame, column: str = "hashbin") -> DataFrame:
    """Rows per bin with a rank: regions in fixed order, then letters."""
    counted = df.groupBy(column).agg(F.count(F.lit(1)).alias("n"))
    order = F.array_position(F.array(*[F.lit(r) for r in REGION_ORDER]), F.col(column))
    letter = F.instr(F.lit(geohash.ALPHABET), F.substring(F.col(column), 1, 1))
    rank = F.when(order > 0, order.cast("bigint")).otherwise(F.lit(len(REGION_ORDER)) + letter.cast("bigint"))
    return counted.withColumn("rank", rank)


def bin_summary(df: DataFrame, path: str = "path", literal: bool = False) -> DataFrame:
    """Counts per path, then Sum, Avg, BigSum, BigBox, BktSum and Bucket (whole-number averages).

    Big boxes are the region names. `literal` also counts any path whose text occurs in the joined
    list of region names. An empty class has no average.
    """
    counts = df.groupBy(F.col(path).alias("item")).agg(F.count(F.lit(1)).alias("value"))
    big = F.col("item").isin(*geohash.REGION_NAMES)
    if literal:
        big = F.instr(F.lit(",".join(geohash.REGION_NAMES)), F.col("item")) > 0
    n, v = F.lit(1), F.col("value")
    totals = counts.agg(
        F.sum(v).alias("Sum"),
        F.expr("sum(value) div nullif(count(1), 0)").alias("Avg"),
        F.coalesce(F.sum(F.when(big, v)), F.lit(0)).alias("BigSum"),
        F.count(F.when(big, n)).alias("_big"),
        F.coalesce(F.sum(F.when(~big, v)), F.lit(0)).alias("BktSum"),
        F.count(F.when(~big, n)).alias("_small"),
    ).select(
        "Sum",
        "Avg",
        "BigSum",
        F.expr("BigSum div nullif(_big, 0)").alias("BigBox"),
        "BktSum",
        F.expr("BktSum div nullif(_small, 0)").alias("Bucket"),
    )
    names = ["Sum", "Avg", "BigSum", "BigBox", "BktSum", "Bucket"]
    rows = totals.select(
        F.explode(F.array(*[F.struct(F.lit(m).alias("item"), F.col(m).alias("value")) for m in names])).alias("r")
    ).select("r.item", "r.value")
    return counts.unionByName(rows)


def bucket_info(df: DataFrame, path: str, record: str, box: tuple[str, str, str, str] = BOX) -> DataFrame:
    """One row per bucket: extent of all its rows and the hashes of its smallest record id."""
    xmin, ymin, xmax, ymax = box
    first = F.min_by(F.struct("hash1", "hash2"), F.col(record))
    info = df.groupBy(path).agg(
        F.count(F.lit(1)).alias("n"),
        F.min(xmin).alias("xmin"),
        F.min(ymin).alias("ymin"),
        F.max(xmax).alias("xmax"),
        F.max(ymax).alias("ymax"),
        first.alias("_first"),
    )
    info = info.withColumns({"hash1": F.col("_first.hash1"), "hash2": F.col("_first.hash2")}).drop("_first")
    return info.withColumns(
        {"hash": F.concat_ws("-", "hash1", "hash2"), "distance": geohash.approximate_metres("hash1", "hash2", 3)}
    )


# ---- extents -------------------------------------------------------------------------------


def extents(df: DataFrame, key: str | Column, box: tuple[str, str, str, str] = BOX) -> DataFrame:
    """Extent and row count per key (a column, or the partition number)."""
    key = F.col(key) if isinstance(key, str) else key
    xmin, ymin, xmax, ymax = box
    return df.groupBy(key.alias("part")).agg(
        F.count(F.lit(1)).alias("n"),
        F.min(xmin).alias("xmin"),
        F.min(ymin).alias("ymin"),
        F.max(xmax).alias("xmax"),
        F.max(ymax).alias("ymax"),
    )


def partition_extents(df: DataFrame, box: tuple[str, str, str, str] = BOX) -> DataFrame:
    return extents(df, F.spark_partition_id(), box)


def _hull(points: np.ndarray) -> np.ndarray:
    """Counter-clockwise convex hull, without its collinear vertices (monotone chain)."""
    points = np.unique(points, axis=0)
    if len(points) < 3:
        return points

    def half(rows):
        chain = []
        for p in rows:
            while len(chain) > 1:
                a, b = chain[-2], chain[-1]
                if (b[0] - a[0]) * (p[1] - a[1]) - (b[1] - a[1]) * (p[0] - a[0]) > 0:
                    break
                chain.pop()
            chain.append(p)
        return chain[:-1]

    return np.array(half(points) + half(points[::-1]))


def hulls(df: DataFrame, key: str, x: str, y: str) -> DataFrame:
    """Vertices of the convex hull of every key's points, as (key, x, y).

    Each task first reduces its own points to hulls, so a key reaches the final step as hull
    vertices only, however many points it has.
    """
    points = df.select(F.col(key), F.col(x).cast("double").alias("x"), F.col(y).cast("double").alias("y"))
    schema = points.schema

    def shrink(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        kept: dict = {}
        for batch in batches:
            for value, rows in batch.groupby(key, dropna=False):
                new = rows[["x", "y"]].to_numpy()
                old = kept.get(value)
                kept[value] = _hull(new if old is None else np.vstack([old, new]))
        for value, hull in kept.items():
            yield pd.DataFrame({key: [value] * len(hull), "x": hull[:, 0], "y": hull[:, 1]})

    def finish(rows: pd.DataFrame) -> pd.DataFrame:
        hull = _hull(rows[["x", "y"]].to_numpy())
        return pd.DataFrame({key: [rows[key].iloc[0]] * len(hull), "x": hull[:, 0], "y": hull[:, 1]})

    return points.mapInPandas(shrink, schema).groupBy(key).applyInPandas(finish, schema)
