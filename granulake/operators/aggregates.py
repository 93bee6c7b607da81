"""Counts, summaries and distributions of tables."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from granulake.operators.ordering import exact_quantiles


def count_by(df: DataFrame, *keys: str) -> DataFrame:
    return df.groupBy(*keys).agg(F.count(F.lit(1)).alias("n"))


def top_n_groups(df: DataFrame, key: str, n: int) -> DataFrame:
    """The n most frequent values; equal counts in name order."""
    return count_by(df, key).orderBy(F.desc("n"), F.col(key).asc_nulls_last()).limit(n)


def distinct_groups(df: DataFrame, key: str) -> DataFrame:
    """Number of distinct values, NULL counted as one of them."""
    one_null = F.max(F.col(key).isNull().cast("bigint"))
    return df.agg((F.countDistinct(key) + F.coalesce(one_null, F.lit(0))).alias("n"))


def largest_shape(
    df: DataFrame, key: str, size: str, tie: Sequence[str] = (), largest: bool = True
) -> DataFrame:
    """One row per key: its largest (or smallest) shape, ties by the `tie` columns.

    An aggregate, not a window: partial results are combined before the shuffle.
    """
    others = [c for c in df.columns if c != key]
    row = F.struct(*others)
    negative = -F.col(size) if largest else F.col(size)
    order = F.struct(negative.alias("o"), *[F.col(t) for t in tie])
    return df.groupBy(key).agg(F.min_by(row, order).alias("_r")).select(key, "_r.*")


def latest_revision(df: DataFrame, key: str, revision: str) -> DataFrame:
    """Newest row per concept."""
    others = [c for c in df.columns if c != key]
    return (
        df.groupBy(key).agg(F.max_by(F.struct(*others), F.col(revision)).alias("_r")).select(key, "_r.*")
    )


# ---- histograms ------------------------------------------------------------------------------

# Upper edges of the hand-made bins; the last bin ends at the maximum.
AREA_BREAKS = (1.0, 10.0, 100.0, 1000.0, 5000.0, 5e7, 1e8, 1e9)
VERTEX_BREAKS = (1.0, 1.0, 2.0, 3.0, 4.0, 5.0, 20.0, 100.0, 200.0, 1000.0)


def bin_index(value: Column, breaks: Sequence[float]) -> Column:
    """1-based right-closed bin; the first bin also holds its lower edge. NULL below the first edge.

    The last bin is open upwards: it ends at whatever the maximum is.
    """
    out = F.lit(len(breaks))
    for i in range(len(breaks) - 1, 0, -1):
        out = F.when(value <= breaks[i], F.lit(i)).otherwise(out)
    inside = value >= breaks[0]
    return F.when(inside, out)


def bin_labels(breaks: Sequence[float], maximum: float | None = None) -> list[str]:
    """'lower - upper' names of right-closed bins: the lower end is one above the break before."""
    text = lambda v: f"{v:g}" if v >= 10000 else f"{v:.0f}"
    labels = []
    for i, low in enumerate(breaks):
        high = breaks[i + 1] if i + 1 < len(breaks) else maximum
        first = low if i == 0 else low + 1
        labels.append(f"{text(first)} - {'max' if high is None else text(high)}")
    return labels


def histogram(df: DataFrame, value: str, breaks: Sequence[float]) -> DataFrame:
    """Rows per bin, with empty bins counted 0, as (bin, label, n)."""
    size = len(breaks)
    labels = bin_labels(breaks)
    at = bin_index(F.col(value), breaks)
    counts = df.agg(*[F.count_if(F.coalesce(at == i, F.lit(False))).alias(f"b{i}") for i in range(1, size + 1)])
    return counts.select(
        F.explode(
            F.array(
                *[
                    F.struct(
                        F.lit(i).alias("bin"), F.lit(labels[i - 1]).alias("label"), F.col(f"b{i}").alias("n")
                    )
                    for i in range(1, size + 1)
                ]
            )
        ).alias("r")
    ).select("r.*")


def histogram_by(df: DataFrame, value: str, breaks: Sequence[float], column: str, values: Sequence[str]) -> DataFrame:
    """The same bins side by side: all rows, and the rows of each listed value."""
    at = bin_index(F.col(value), breaks)
    return (
        df.select(at.alias("bin"), F.col(column).alias("_v"))
        .where(F.col("bin").isNotNull())
        .groupBy("bin")
        .agg(
            F.count(F.lit(1)).alias("n_all"),
            *[F.count_if(F.coalesce(F.col("_v") == v, F.lit(False))).alias(f"n_{v.lower()}") for v in values],
        )
    )


# ---- summaries -------------------------------------------------------------------------------


def describe(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """count, mean, std, min, quartiles and max of numeric columns, one row per column."""
    long = df.select(*[F.col(c).cast("double").alias(c) for c in columns]).unpivot(
        [], list(columns), "column", "value"
    )
    base = long.groupBy("column").agg(
        F.count("value").alias("count"),
        F.avg("value").alias("mean"),
        F.stddev_samp("value").alias("std"),
        F.min("value").alias("min"),
        F.max("value").alias("max"),
    )
    quartiles = exact_quantiles(long, "value", [0.25, 0.5, 0.75], ["column"]).drop("n")
    return base.join(quartiles, "column")


def non_null_counts(df: DataFrame) -> DataFrame:
    """(column, type, non_null) of every column in one pass."""
    counts = df.agg(*[F.count(F.col(f"`{c}`")).alias(f"c{i}") for i, c in enumerate(df.columns)])
    rows = [
        F.struct(F.lit(name).alias("column"), F.lit(kind).alias("type"), F.col(f"c{i}").alias("non_null"))
        for i, (name, kind) in enumerate(df.dtypes)
    ]
    return counts.select(F.explode(F.array(*rows)).alias("r")).select("r.*")


def table_extent(df: DataFrame, box: Sequence[str]) -> DataFrame:
    xmin, ymin, xmax, ymax = box
    return df.agg(
        F.min(xmin).alias("xmin"), F.min(ymin).alias("ymin"), F.max(xmax).alias("xmax"), F.max(ymax).alias("ymax")
    )


# ---- measured runs -----------------------------------------------------------------------------


def run_stats(runs: DataFrame, value: str = "value", run: str = "run", groups: Sequence[str] = ("test",)) -> DataFrame:
    """count, total, min, max with the run that first reached them, average and median.

    The list of values stays as rows of `runs`; it is not packed into one cell.
    """
    first = lambda pick, v: pick(F.col(run), F.struct(v.alias("v"), F.col(run).alias("r")))
    base = runs.groupBy(*groups).agg(
        F.count(value).alias("count"),
        F.sum(value).alias("total"),
        F.min(value).alias("min"),
        F.max(value).alias("max"),
        first(F.min_by, F.col(value)).alias("min_id"),
        first(F.min_by, -F.col(value)).alias("max_id"),
        F.avg(value).alias("average"),
    )
    median = exact_quantiles(runs, value, [0.5], list(groups)).drop("n").withColumnRenamed("p50", "median")
    return base.join(median, list(groups)) if groups else base.withColumn("median", median.scalar())


def verify(results: DataFrame, rules: DataFrame, key: str = "name") -> DataFrame:
    """Check result counts against rules (name, action, expected): `passed` per search.

    `results` has one row per search with `found` (row count) and optionally `first` (first result
    id) and `ids` (result ids). No rule, or a rule without a value, passes.
    """
    expected = F.col("expected").try_cast("bigint")
    found = F.col("found")
    ids = F.col("ids") if "ids" in results.columns else F.lit(None).cast("array<string>")
    passed = (
        F.when(F.col("action").isNull() | F.col("expected").isNull(), True)
        .when(F.col("action") == "count", found == expected)
        .when(F.col("action") == "greater-then", found > expected)
        .when(F.col("action") == "less-then", found < expected)
        .when(F.col("action") == "exact", ids == F.array(F.col("expected")))
        .when(F.col("action").isin("contains", "contain"), F.array_contains(ids, F.col("expected")))
    )
    return results.join(rules, key, "left").withColumn("passed", F.coalesce(passed, F.lit(False)))


def tally(checked: DataFrame) -> DataFrame:
    return checked.agg(F.count_if("passed").alias("valid"), F.count_if(~F.col("passed")).alias("failed"))


def unpivot(df: DataFrame, ids: Sequence[str], values: Sequence[str], name: str, value: str) -> DataFrame:
    return df.unpivot(list(ids), list(values), name, value)


def page_size_profile(df: DataFrame, column: str = "page_size", largest: int = 2000) -> DataFrame:
    """Requests per page size up to `largest`; NULLs and larger sizes counted apart."""
    size = F.col(column)
    group = F.when(size.isNull(), "null").when(size > largest, "excluded").otherwise("size")
    kept = F.when(group == "size", size)
    return df.groupBy(group.alias("kind"), kept.alias(column)).agg(F.count(F.lit(1)).alias("n"))
