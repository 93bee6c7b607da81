"""Sorted results: limits, top-k per source, paging, positions, running totals, quantiles.

Nothing here sends a whole group, or a whole table, to one task. Positions, running totals and
quantiles range-partition on the full sort key (with a tie-breaker, so one heavy key spreads over
many partitions), work inside each partition, and add what the earlier partitions hold, a table
with one row per partition.
"""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from granulake.session import cut, shuffle_partitions

DEFAULT_LIMIT = 2000


def _columns(names: Sequence[str | Column]) -> list[Column]:
    return [F.col(n).asc_nulls_last() if isinstance(n, str) else n for n in names]


def sort_limit(df: DataFrame, by: str | Sequence[str | Column], limit: int = DEFAULT_LIMIT) -> DataFrame:
    """Ascending order, NULLs last, then the first `limit` rows; below 1 means no limit."""
    keys = [by] if isinstance(by, (str, Column)) else list(by)
    ordered = df.orderBy(*_columns(keys))
    return ordered.limit(limit) if limit >= 1 else ordered


def limit_only(df: DataFrame, limit: int = DEFAULT_LIMIT) -> DataFrame:
    return df.limit(limit) if limit >= 1 else df


def offset_page(df: DataFrame, by: Sequence[str | Column], offset: int, size: int) -> DataFrame:
    return df.orderBy(*_columns(by)).offset(offset).limit(size)


def after_cursor(columns: Sequence[str], cursor: Sequence) -> Column:
    """(a, b, ...) > cursor, column by column."""
    condition = F.lit(False)
    for name, value in reversed(list(zip(columns, cursor))):
        condition = (F.col(name) > F.lit(value)) | ((F.col(name) == F.lit(value)) & condition)
    return condition


def keyset_page(df: DataFrame, by: Sequence[str], cursor: Sequence | None = None, size: int = 1000) -> DataFrame:
    """The next page after a cursor; the cursor is the sort values of the last row seen."""
    rest = df if cursor is None else df.where(after_cursor(by, cursor))
    return sort_limit(rest, list(by), size)


def top_k_per_group(
    df: DataFrame,
    groups: Sequence[str],
    order: Sequence[str | Column],
    k: int,
    rank: str | None = None,
    salts: int = 32,
) -> DataFrame:
    """Each group's first k rows.

    Two steps: k per (group, salt), then k of those. A group with a third of the table is cut by
    `salts` tasks, and the last step sees at most `salts * k` rows of a group.
    """
    keys = list(groups)
    order = _columns(order)
    hashed = [F.col(f"`{f.name}`") for f in df.schema.fields if f.dataType.typeName() not in ("map", "variant")]
    salted = df.withColumn("_salt", F.pmod(F.xxhash64(*hashed) + F.spark_partition_id(), F.lit(salts)))
    first = Window.partitionBy(*keys, "_salt").orderBy(*order)
    last = Window.partitionBy(*keys).orderBy(*order)
    kept = salted.withColumn("_k", F.row_number().over(first)).where(F.col("_k") <= k).drop("_k", "_salt")
    name = rank or "_k"
    out = kept.withColumn(name, F.row_number().over(last)).where(F.col(name) <= k)
    return out if rank else out.drop("_k")


def merge_tops(
    df: DataFrame, part: str, by: Sequence[str | Column], k: int = DEFAULT_LIMIT, recut: bool = False
) -> DataFrame:
    """Every part's own top k put together and sorted again; `recut` keeps only the first k."""
    if recut:
        return sort_limit(df, by, k)  # the global top k is the top k of the parts' tops
    return sort_limit(top_k_per_group(df, [part], by, k), by, 0)


# ---- positions and running totals ------------------------------------------------------------


def _range_parts(df: DataFrame, keys: Sequence[str | Column], partitions: int | None) -> DataFrame:
    count = partitions or shuffle_partitions(df.sparkSession)
    ranged = df.repartitionByRange(count, *_columns(keys)).withColumn("_part", F.spark_partition_id())
    return cut(ranged, "ranged")


def running_total(
    df: DataFrame,
    order: Sequence[str | Column],
    measures: dict[str, Column],
    groups: Sequence[str] = (),
    partitions: int | None = None,
) -> DataFrame:
    """Add running sums (name -> summed column) along `order`, restarting in every group.

    `order` must be unique within a group for a deterministic result.
    """
    keys = list(groups)
    named = df.withColumns({f"_m_{name}": column for name, column in measures.items()})
    ranged = _range_parts(named, [*keys, *order], partitions)
    within = (
        Window.partitionBy("_part", *keys).orderBy(*_columns(order)).rowsBetween(Window.unboundedPreceding, 0)
    )
    earlier = Window.partitionBy(*(keys or [F.lit(1)])).orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    # one row per (group, partition); only groups that span partitions carry something over
    carried = (
        ranged.groupBy("_part", *keys)
        .agg(*[F.sum(f"_m_{name}").alias(f"_s_{name}") for name in measures], F.count(F.lit(1)).alias("_n"))
        .withColumn("_before", F.sum("_n").over(earlier))
        .withColumns({f"_c_{name}": F.sum(f"_s_{name}").over(earlier) for name in measures})
        .where(F.col("_before") > 0)
        .select("_part", *[F.col(k).alias(f"_g_{k}") for k in keys], *[f"_c_{name}" for name in measures])
    )
    local = ranged.withColumns({name: F.sum(f"_m_{name}").over(within) for name in measures})
    match = F.col("l._part") == F.col("c._part")
    for key in keys:
        match = match & F.col(f"l.{key}").eqNullSafe(F.col(f"c._g_{key}"))
    # at most one row per partition boundary, so the broadcast is bounded by the partition count
    joined = local.alias("l").join(F.broadcast(carried.alias("c")), match, "left")
    total = {name: F.col(f"l.{name}") + F.coalesce(F.col(f"c._c_{name}"), F.lit(0)) for name in measures}
    return joined.select(*[F.col(f"l.`{c}`") for c in df.columns], *[v.alias(n) for n, v in total.items()])


def row_positions(
    df: DataFrame,
    order: Sequence[str | Column],
    name: str = "id",
    groups: Sequence[str] = (),
    partitions: int | None = None,
) -> DataFrame:
    """1-based positions along `order` (per group), without one task seeing a whole group."""
    return running_total(df, order, {name: F.lit(1).cast("bigint")}, groups, partitions)


def page_numbers(
    df: DataFrame, groups: Sequence[str], order: Sequence[str], size: int = 1000, max_pages: int | None = None
) -> DataFrame:
    """All pages of every (day, source) slice at once: a `page` column from 1."""
    placed = row_positions(df, order, "_pos", groups)
    paged = placed.withColumn("page", (F.floor((F.col("_pos") - 1) / size) + 1).cast("bigint")).drop("_pos")
    return paged if max_pages is None else paged.where(F.col("page") <= max_pages)


def with_previous(
    df: DataFrame, order: Sequence[str], columns: Sequence[str], prefix: str = "prev_", partitions: int | None = None
) -> DataFrame:
    """Add the values of the row before along `order` (NULL on the first row)."""
    ranged = _range_parts(df, order, partitions)
    local = Window.partitionBy("_part").orderBy(*_columns(order))
    picked = F.struct(*[F.col(c) for c in columns])
    marked = ranged.withColumns({"_here": F.lag(picked).over(local), "_at": F.row_number().over(local)})
    ends = marked.groupBy("_part").agg(F.max_by(picked, F.col("_at")).alias("_last"))
    # one row per partition
    carried = ends.select(
        F.col("_part").alias("_from"), F.lag("_last").over(Window.partitionBy(F.lit(1)).orderBy("_part")).alias("_last")
    )
    joined = marked.join(F.broadcast(carried), F.col("_part") == F.col("_from"), "left")
    before = F.when(F.col("_at") == 1, F.col("_last")).otherwise(F.col("_here"))
    return joined.select(*df.columns, *[before[c].alias(f"{prefix}{c}") for c in columns])


# ---- distributions ---------------------------------------------------------------------------


def exact_quantiles(
    df: DataFrame,
    value: str,
    probabilities: Sequence[float],
    groups: Sequence[str] = (),
    prefix: str = "p",
    accuracy: int = 10_000,
) -> DataFrame:
    """Exact quantiles with linear interpolation between neighbours, one row per group.

    The first pass makes a mergeable sketch of each group, whose ranks are off by a share of 1/accuracy at most, and
    from it a bracket around each quantile. The second pass counts what lies below a bracket and the different values inside
    it; only these, some 6/accuracy of the rows, are ranked by running counts. A group of up to `accuracy` rows is its own
    bracket. Both passes read `df`. Columns are named `p50`, `p95`, ... and `n`.
    """
    keys = list(groups)
    rows = df.where(F.col(value).isNotNull()).select(*keys, F.col(value).alias("_v"))
    slack = 3 / accuracy
    lows, highs = ([min(1.0, max(0.0, p + side)) for p in probabilities] for side in (-slack, slack))
    near = F.percentile_approx("_v", [*lows, *highs], accuracy)
    sketch = rows.groupBy(*keys).agg(F.count(F.lit(1)).alias("n"), F.min("_v").alias("_min"), F.max("_v").alias("_max"), near.alias("_near"))
    edges = []
    for i, (low, high) in enumerate(zip(lows, highs)):
        small = F.col("n") <= accuracy
        begin = F.when(small | F.lit(low == 0.0), F.col("_min")).otherwise(F.col("_near")[i])
        end = F.when(small | F.lit(high == 1.0), F.col("_max")).otherwise(F.col("_near")[len(lows) + i])
        edges.append(F.struct(F.lit(i).alias("i"), begin.alias("low"), end.alias("high")))
    brackets = sketch.select(*[F.col(k).alias(f"_k_{k}") for k in keys], F.struct("n", F.array(*edges).alias("edges")).alias("_b"))
    if keys:
        match = reduce(lambda x, y: x & y, [F.col(k).eqNullSafe(F.col(f"_k_{k}")) for k in keys])
        found = rows.join(brackets, match).drop(*[f"_k_{k}" for k in keys])
    else:
        found = rows.withColumn("_b", brackets.select("_b").scalar())
    # a value below a bracket is counted there without its value
    met = F.filter("_b.edges", lambda e: F.col("_v") <= e["high"])
    met = F.transform(met, lambda e: F.struct(e["i"].alias("i"), F.when(F.col("_v") >= e["low"], F.col("_v")).alias("v")))
    counted = (
        found.select(*keys, F.col("_b.n").alias("n"), F.explode(met).alias("_e"))
        .groupBy(*keys, "n", F.col("_e.i").alias("_i"), F.col("_e.v").alias("_v"))
        .agg(F.count(F.lit(1)).alias("_n"))
    )
    ranked = running_total(counted, [F.col("_v").asc_nulls_first()], {"_to": F.col("_n")}, [*keys, "_i"])
    aggs, names = [F.max("n").alias("n")], {}
    for i, p in enumerate(probabilities):
        at = (F.col("n") - 1) * F.lit(float(p))
        covers = lambda pos: (F.col("_i") == i) & (F.col("_to") - F.col("_n") <= pos) & (pos < F.col("_to"))  # noqa: E731, B023
        aggs += [F.max(F.when(covers(f(at)), F.col("_v"))).alias(f"_{side}{i}") for side, f in (("l", F.floor), ("u", F.ceil))]
        share = at - F.floor(at)
        names[quantile_name(p, prefix)] = F.col(f"_l{i}") + (F.col(f"_u{i}") - F.col(f"_l{i}")) * share
    out = ranked.groupBy(*keys).agg(*aggs)
    return out.select(*keys, "n", *[column.alias(name) for name, column in names.items()])


def quantile_name(p: float, prefix: str = "p") -> str:
    return f"{prefix}{p * 100:g}".replace(".", "_")


def ecdf(
    df: DataFrame, value: str, name: str = "pctile", base: Column | None = None, digits: int | None = None
) -> DataFrame:
    """Add the share of (base) rows with a value <= this row's; NULL values stay NULL.

    The distribution is built over distinct values and joined back by value.
    """
    part_of_base = F.lit(True) if base is None else base
    counted = (
        df.where(F.col(value).isNotNull())
        .groupBy(value)
        .agg(F.count(F.when(part_of_base, F.lit(1))).alias("_n"))
    )
    table = running_total(counted, [value], {"_to": F.col("_n")})
    share = F.col("_to") / counted.agg(F.sum("_n")).scalar()
    share = share if digits is None else F.round(share, digits)
    return _looked_up(df, F.col(value), table.select(F.col(value).alias("_v"), share.alias(name)))


def _looked_up(df: DataFrame, value: Column, lookup: DataFrame) -> DataFrame:
    """The other columns of `lookup` by its column `_v`, NULL where `value` is NULL."""
    # rows without a value find nothing: spread them instead of sending them all to one task
    others = [F.col(f"`{f.name}`") for f in df.schema.fields if f.dataType.typeName() not in ("map", "variant")]
    salt = F.pmod(F.xxhash64(*others), F.lit(1024)).cast("int")
    spread = df.withColumn("_s", F.when(value.isNull(), salt + 1).otherwise(F.lit(0)))
    on = (value == F.col("_v")) & (F.col("_s") == F.col("_spread"))
    return spread.join(lookup.withColumn("_spread", F.lit(0)), on, "left").drop("_v", "_s", "_spread")


def ecdfs(df: DataFrame, columns: dict[str, tuple[str, Column | None, int | None]]) -> DataFrame:
    """Several distributions from one pass: name -> (value, base, digits) as for `ecdf`. Values are compared as doubles."""
    entries = [
        F.struct(F.lit(name).alias("_kind"), F.col(value).cast("double").alias("_v"), (F.lit(True) if base is None else base).alias("_base"))
        for name, (value, base, _) in columns.items()
    ]
    counted = (
        df.select(F.explode(F.array(*entries)).alias("_e")).select("_e.*").where(F.col("_v").isNotNull())
        .groupBy("_kind", "_v").agg(F.count(F.when(F.col("_base"), F.lit(1))).alias("_n"))
    )
    table = running_total(counted, ["_v"], {"_to": F.col("_n")}, ["_kind"])
    # one row per distribution
    sizes = table.groupBy(F.col("_kind").alias("_of")).agg(F.sum("_n").alias("_size"))
    shares = table.join(F.broadcast(sizes), F.col("_kind") == F.col("_of")).select("_kind", "_v", (F.col("_to") / F.col("_size")).alias("_share"))
    for name, (value, _, digits) in columns.items():
        share = F.col("_share") if digits is None else F.round("_share", digits)
        lookup = shares.where(F.col("_kind") == name).select("_v", share.alias(name))
        df = _looked_up(df, F.col(value).cast("double"), lookup)
    return df


def ecdf_lookup(df: DataFrame, value: str, probes: DataFrame, probe: str = "x", name: str = "pctile") -> DataFrame:
    """Share of the table's values that are <= each outside value of a probe table.

    Probes join the counted values as rows of count 0 behind their own value, so the running
    count at a probe is its answer.
    """
    counted = (
        df.select(F.col(value).cast("double").alias("_v"))
        .where(F.col("_v").isNotNull())
        .groupBy("_v")
        .agg(F.count(F.lit(1)).alias("_n"))
        .withColumn("_probe", F.lit(0))
    )
    spots = probes.select(F.col(probe).cast("double").alias("_v")).where(F.col("_v").isNotNull()).distinct()
    both = counted.unionByName(spots.withColumns({"_n": F.lit(0).cast("bigint"), "_probe": F.lit(1)}))
    ranked = running_total(both, ["_v", "_probe"], {"_to": F.col("_n")}).where(F.col("_probe") == 1)
    total = counted.agg(F.sum("_n")).scalar()
    share = ranked.select("_v", (F.col("_to") / total).alias(name))
    return probes.join(share, F.col(probe).cast("double") == F.col("_v"), "left").drop("_v")


def add_quantile_flag(df: DataFrame, value: str, threshold: float, name: str = "in_quantile") -> DataFrame:
    """Flag rows at or above the `threshold` quantile; thresholds outside 0..1 are an error."""
    if not 0 <= threshold <= 1:
        raise ValueError("threshold must be between 0 and 1")
    cutoff = exact_quantiles(df, value, [threshold]).select(quantile_name(threshold))
    return df.withColumn(name, F.col(value) >= cutoff.scalar())


# ---- load -----------------------------------------------------------------------------------


def load_in_window(df: DataFrame, second: str, minutes: int, name: str = "load") -> DataFrame:
    """Queries within +-`minutes` of every second that had one, as (second, queries, load).

    Counted per second first. Each second goes to its own block of 2 x `minutes` and the two
    beside it, so a window never holds more than three blocks of seconds.
    """
    width = minutes * 60
    counted = df.groupBy(second).agg(F.count(F.lit(1)).alias("queries"))
    epoch = F.unix_timestamp(F.col(second).cast("timestamp"))
    spread = (
        counted.withColumn("_t", epoch)
        .withColumn("_own", F.floor(F.col("_t") / width))
        .withColumn("_block", F.explode(F.array(F.col("_own") - 1, F.col("_own"), F.col("_own") + 1)))
    )
    around = Window.partitionBy("_block").orderBy("_t").rangeBetween(-width, width)
    return (
        spread.withColumn(name, F.sum("queries").over(around))
        .where(F.col("_block") == F.col("_own"))
        .select(second, "queries", name)
    )
