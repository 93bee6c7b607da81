"""Declarative searches compiled to DataFrames, and whole suites answered in one scan."""

from __future__ import annotations

import uuid
from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from granulake.functions import geometry_batch as gb
from granulake.functions import raster
from granulake.functions.wkt import read_literal
from granulake.operators.layout import BOX, flat_bin_filter, overlaps
from granulake.operators.ordering import row_positions, sort_limit, top_k_per_group
from granulake.sources.spec import Operation, Predicate, Search, SpecError, Suite



# ---- predicates ------------------------------------------------------------------------------


def time_at_least(value: str, column: str = "StartTime") -> Column:
    return F.col(column) >= F.lit(value)


def time_at_most(value: str, column: str = "StartTime") -> Column:
    return F.col(column) <= F.lit(value)


def time_between(after: str, before: str, column: str = "StartTime") -> Column:
    """Open interval."""
    return (F.col(column) > F.lit(after)) & (F.col(column) < F.lit(before))


def time_range(
    text: str, mode: str = "covers", start: str = "StartTime", end: str = "EndTime"
) -> Column:
    """`a/b`, `a/` or `/b`.

    'covers': the granule's time span covers the range. 'overlaps': they share an instant.
    """
    first, _, last = text.partition("/")
    if mode == "covers":
        tests = [F.col(start) <= F.lit(first)] if first else []
        tests += [F.lit(last) <= F.col(end)] if last else []
    elif mode == "overlaps":
        tests = [F.col(end) >= F.lit(first)] if first else []
        tests += [F.col(start) <= F.lit(last)] if last else []
    else:
        raise ValueError(f"unknown range mode {mode!r}")
    return reduce(lambda a, b: a & b, tests, F.lit(True))


def box_struct(xmin: float, ymin: float, xmax: float, ymax: float, column: str = "bbox") -> Column:
    """Closed overlap with a covering-box struct column; the fields reach the Parquet scan."""
    c = F.col(column)
    return (
        (F.lit(float(xmin)) <= c["xmax"])
        & (F.lit(float(xmax)) >= c["xmin"])
        & (F.lit(float(ymin)) <= c["ymax"])
        & (F.lit(float(ymax)) >= c["ymin"])
    )


def box_columns(box: Sequence[float], columns: tuple[str, str, str, str] = BOX) -> Column:
    return overlaps(tuple(box), columns)


def shape_box(wkb: bytes) -> tuple[float, float, float, float]:
    """Box of a literal query shape."""
    shape = gb.read_wkb(wkb)
    if shape is None or not shape[1]:
        raise SpecError("the query shape cannot be read")
    lows = [ring[2].min(axis=0) for ring in shape[1]]
    highs = [ring[2].max(axis=0) for ring in shape[1]]
    low, high = reduce(lambda a, b: [min(p) for p in zip(a, b)], lows), reduce(
        lambda a, b: [max(p) for p in zip(a, b)], highs
    )
    return float(low[0]), float(low[1]), float(high[0]), float(high[1])


def intersects(
    df: DataFrame, wkb: bytes, geometry: str = "geometry", columns: tuple[str, str, str, str] | None = BOX
) -> DataFrame:
    """Rows whose geometry shares a point with the shape.

    The box test runs first in the JVM and prunes row groups. The raster of the shape then decides rows by
    their box; only geometries on its border reach the exact test, which stands in its own filter.
    `columns` must bound the geometry.
    """
    if columns is None:
        return df.where(gb.st_intersects(F.col(geometry), wkb))
    near = _marked(df.where(overlaps(shape_box(wkb), columns)), wkb, columns)
    return near.where(raster.intersects(F.col(_MARK), F.col(geometry), wkb)).drop(_MARK)


_MARK = "_raster_mark"


def _marked(near: DataFrame, wkb: bytes, columns: tuple[str, str, str, str]) -> DataFrame:
    """Rows that the raster does not decide to lie outside, with its mark, computed once a row."""
    return raster.Raster(wkb).with_mark(near, columns, _MARK).where(raster.may_intersect(F.col(_MARK)))


def raster_marks(df: DataFrame, wkb: bytes, columns: tuple[str, str, str, str] = BOX, name: str = "mark") -> DataFrame:
    """Rows near the shape with what its raster says of their box: `inside`, `border` or `outside`."""
    near = df.where(overlaps(shape_box(wkb), columns))
    return raster.Raster(wkb).with_mark(near, columns, name).withColumn(name, raster.label(F.col(name)))


def contains(
    df: DataFrame, wkb: bytes, geometry: str = "geometry", columns: tuple[str, str, str, str] | None = BOX
) -> DataFrame:
    """Rows whose geometry contains the shape (its edge does not count)."""
    near = df
    if columns is not None:
        xmin, ymin, xmax, ymax = shape_box(wkb)
        w, s, e, n = (F.col(c) for c in columns)
        near = df.where((w <= xmin) & (e >= xmax) & (s <= ymin) & (n >= ymax))
    return near.where(gb.st_contains(F.col(geometry), wkb))


def interior_or_exact(
    df: DataFrame,
    wkb: bytes,
    interior: Sequence[float],
    geometry: str = "geometry",
    columns: tuple[str, str, str, str] = BOX,
    interior_columns: tuple[str, str, str, str] = ("LRWest", "LRSouth", "LREast", "LRNorth"),
) -> DataFrame:
    """Rows near the shape whose interior rectangle overlaps the shape's one, or, failing that,
    whose geometry intersects it.

    A Python function in an OR runs for every row, so decided rows hand it NULL instead of their
    geometry and cost nothing there.
    """
    near = df.where(overlaps(shape_box(wkb), columns))
    sure = F.coalesce(overlaps(tuple(interior), interior_columns), F.lit(False))
    near = raster.Raster(wkb).with_mark(near.withColumn("_sure", sure), columns, _MARK)
    near = near.where(F.col("_sure") | raster.may_intersect(F.col(_MARK)))
    tested = near.withColumn("_exact", raster.intersects(F.when(~F.col("_sure"), F.col(_MARK)), F.col(geometry), wkb))
    return tested.where(F.col("_sure") | F.col("_exact")).drop("_sure", "_exact", _MARK)


# Values that mark a bound as one of the whole globe.
GLOBE_BOUNDS = (-180.0, -90.0, 90.0, 180.0)


def global_bounds(columns: Sequence[str] = BOX) -> Column:
    """All four bounds lie on the limits of the globe."""
    return reduce(lambda a, b: a & b, [F.col(c).isin(*GLOBE_BOUNDS) for c in columns])


def drop_global(df: DataFrame, columns: Sequence[str] = BOX) -> DataFrame:
    return df.where(~F.coalesce(global_bounds(columns), F.lit(False)))


def drop_equal(df: DataFrame, value, column: str = "geometry") -> DataFrame:
    """Rows whose geometry differs from the given one; rows without geometry stay."""
    return df.where(~F.col(column).eqNullSafe(F.lit(value)))


def half_open(column: str, start: str, end: str) -> Column:
    return (F.col(column) >= F.lit(start)) & (F.col(column) < F.lit(end))


def terms_range(
    df: DataFrame, column: str, start: str, end: str, ids: DataFrame | None = None, key: str = "CollectionConceptId"
) -> DataFrame:
    """Half-open range on the start, optionally only the ids of another table."""
    picked = df.where(half_open(column, start, end))
    return picked if ids is None else picked.join(ids.select(F.col(key)).distinct(), key, "left_semi")


# ---- compiling a specification -----------------------------------------------------------------


def _wkb_of(text: str) -> bytes:
    """Literal WKT of a specification as WKB."""
    shape = read_literal(text)
    if shape is None:
        raise SpecError("the geometry value is not valid WKT")
    return gb.write_wkb(*shape)


def _one_of(df: DataFrame, names: Sequence[str]) -> bool:
    return all(n in df.columns for n in names)


def _prunes_year(df: DataFrame, step: Predicate) -> bool:
    """A table with `year` folders gets the year test beside the time test."""
    return "year" in df.columns and step.value[:4].isdigit()


def predicate(df: DataFrame, step: Predicate, range_mode: str = "covers") -> tuple[Column | None, Column | None]:
    """(native test, exact test) of one predicate; the native part is what the scan can prune on."""
    if step.type_of == "attribute_raw":
        return F.expr(step.statement), None
    if step.type_of == "bbox":
        return box_struct(step.xmin, step.ymin, step.xmax, step.ymax, step.bbox_column_name), None
    if step.type_of == "time":
        if step.option == "greater-then":
            test = time_at_least(step.value)
            if _prunes_year(df, step):
                test = test & (F.col("year") >= int(step.value[:4]))
            return test, None
        if step.option == "less-then":
            test = time_at_most(step.value)
            if _prunes_year(df, step):
                test = test & (F.col("year") <= int(step.value[:4]))
            return test, None
        if step.option == "range":
            return time_range(step.value, range_mode), None
        raise SpecError(f"unknown time option {step.option!r}")
    wkb = _wkb_of(step.value)
    native = _near(df, wkb)
    if step.option in ("intersects", None):
        if _one_of(df, BOX):
            return native, raster.intersects(raster.Raster(wkb).mark(BOX), F.col("geometry"), wkb)
        return native, gb.st_intersects(F.col("geometry"), wkb)
    if step.option == "contains":
        return native, gb.st_contains(F.col("geometry"), wkb)
    raise SpecError(f"unknown geometry option {step.option!r}")


def _near(df: DataFrame, wkb: bytes) -> Column | None:
    """Native test of the box and bin columns that the table has."""
    box, native = shape_box(wkb), None
    if _one_of(df, BOX):
        native = overlaps(box)
    elif "bbox" in df.columns:
        native = box_struct(*box)
    if "hashbin" in df.columns:
        native = flat_bin_filter(box) if native is None else native & flat_bin_filter(box)
    return native


def _whole(parts: tuple[Column | None, Column | None]) -> Column:
    return reduce(lambda a, b: a & b, [p for p in parts if p is not None])


def filter_operations(df: DataFrame, operations: Sequence[Operation], range_mode: str = "covers") -> DataFrame:
    """All `ands` of all operations; `ors` of an operation need one match, `nots` no match.

    Native tests go into one filter, exact tests follow in filters of their own.
    """
    native, exact, marked = [], [], []
    for operation in operations:
        for step in operation.ands:
            if step.type_of == "geometry" and step.option in ("intersects", None) and _one_of(df, BOX):
                native.append(_near(df, _wkb_of(step.value)))
                marked.append(_wkb_of(step.value))
                continue
            quick, costly = predicate(df, step, range_mode)
            native += [] if quick is None else [quick]
            exact += [] if costly is None else [costly]
        if operation.ors:
            either = reduce(lambda a, b: a | b, [_whole(predicate(df, s, range_mode)) for s in operation.ors])
            (exact if any(s.type_of == "geometry" for s in operation.ors) else native).append(either)
        for step in operation.nots:
            none = ~F.coalesce(_whole(predicate(df, step, range_mode)), F.lit(False))
            (exact if step.type_of == "geometry" else native).append(none)
    if native:
        df = df.where(reduce(lambda a, b: a & b, native))
    for wkb in marked:
        df = _marked(df, wkb, BOX)
        df = df.where(raster.intersects(F.col(_MARK), F.col("geometry"), wkb)).drop(_MARK)
    for test in exact:
        df = df.where(test)
    return df


def raw(spark: SparkSession, statement: str, data: DataFrame) -> DataFrame:
    """User SQL with a `{data}` placeholder for the searched table."""
    view = f"data_{uuid.uuid4().hex}"
    data.createOrReplaceTempView(view)
    return spark.sql(statement.replace("{data}", view))


def search(df: DataFrame, spec: Search, range_mode: str = "covers") -> DataFrame:
    """One declarative search: filter, sort, limit, columns."""
    if spec.raw is not None:
        return raw(df.sparkSession, spec.raw, df)
    found = filter_operations(df, spec.operations or (), range_mode)
    columns = ["*"] if "*" in spec.columns else list(spec.columns)
    if spec.sortby:
        return sort_limit(found, spec.sortby, spec.limit).select(*columns)
    found = found.select(*columns)
    return found.limit(spec.limit) if spec.limit >= 1 else found


# ---- variants ----------------------------------------------------------------------------------

LIMIT_BIT, ORDER_BIT, ALL_BIT = 4, 2, 1


def variants(
    spec: Search, limit: int | None = None, orderless: bool = False, all_columns: bool = False, base: bool = True
) -> list[tuple[str, Search]]:
    """The base search and every distinct combination of the enabled variants, with their tags."""
    enabled = (LIMIT_BIT if limit else 0) | (ORDER_BIT if orderless else 0) | (ALL_BIT if all_columns else 0)
    out = [("flag-0-base", spec)] if base else []
    seen = set()
    for flag in range(1, 8):
        bits = flag & enabled
        if not bits or bits in seen:
            continue
        seen.add(bits)
        varied, tag = spec, f"flag-{flag}"
        if bits & LIMIT_BIT:
            varied, tag = varied.with_limit(limit), f"{tag}-limit:{limit}"
        if bits & ORDER_BIT:
            varied, tag = varied.without_order(), f"{tag}-orderless"
        if bits & ALL_BIT:
            varied, tag = varied.all_columns(), f"{tag}-all"
        out.append((tag, varied))
    return out


# ---- suites ------------------------------------------------------------------------------------


def _flags(df: DataFrame, suite: Suite, range_mode: str) -> tuple[DataFrame, list[str]]:
    """One boolean column per search. Native tests first; exact tests get NULL for rows they cannot
    change."""
    names = []
    for i, spec in enumerate(suite.tests):
        if spec.raw is not None or spec.operations is None:
            raise SpecError("a suite answered in one scan needs searches with operations")
        native, exact = F.lit(True), []
        for operation in spec.operations:
            for step in operation.ands:
                quick, costly = predicate(df, step, range_mode)
                native = native if quick is None else native & quick
                exact += [] if costly is None else [(step, quick)]
            if operation.ors:
                native = native & reduce(
                    lambda a, b: a | b, [_whole(predicate(df, s, range_mode)) for s in operation.ors]
                )
            for step in operation.nots:
                native = native & ~F.coalesce(_whole(predicate(df, step, range_mode)), F.lit(False))
        name = f"_hit{i}"
        df = df.withColumn(name, F.coalesce(native, F.lit(False)))
        for step, _ in exact:
            wkb = _wkb_of(step.value)
            df = df.withColumn("_open", F.when(F.col(name), F.col("geometry")))
            if step.option == "contains":
                test = gb.st_contains(F.col("_open"), wkb)
            elif _one_of(df, BOX):
                test = raster.intersects(raster.Raster(wkb).mark(BOX), F.col("_open"), wkb)
            else:
                test = gb.st_intersects(F.col("_open"), wkb)
            df = df.withColumn("_exact", F.coalesce(test, F.lit(False)))
            df = df.withColumn(name, F.col(name) & F.col("_exact")).drop("_open", "_exact")
        names.append(name)
    return df, names


def suite_counts(df: DataFrame, suite: Suite, range_mode: str = "covers") -> DataFrame:
    """(name, found) of every search from one scan."""
    flagged, names = _flags(df, suite, range_mode)
    counted = flagged.agg(*[F.count_if(n).alias(n) for n in names])
    rows = [
        F.struct(F.lit(s.name).alias("name"), F.col(n).alias("found")) for s, n in zip(suite.tests, names)
    ]
    return counted.select(F.explode(F.array(*rows)).alias("r")).select("r.*")


def suite_results(df: DataFrame, suite: Suite, key: str = "GranuleUR", range_mode: str = "covers") -> DataFrame:
    """(name, key, rank): the first ids of every search up to its limit, from one scan."""
    flagged, names = _flags(df, suite, range_mode)
    hits = F.filter(
        F.array(*[F.when(F.col(n), F.lit(i)) for i, n in enumerate(names)]), lambda i: i.isNotNull()
    )
    tagged = flagged.select(F.col(key), F.explode(hits).alias("_search"))
    limits = [s.limit if s.limit >= 1 else 2**62 for s in suite.tests]
    if max(limits) == 2**62:  # a search without a limit is ranked whole, spread over all tasks
        ranked = row_positions(tagged, [key], "rank", ["_search"])
    else:
        ranked = top_k_per_group(tagged, ["_search"], [key], max(limits), rank="rank")
    labels = F.array(*[F.lit(s.name) for s in suite.tests])
    most = F.array(*[F.lit(n) for n in limits])
    return ranked.where(F.col("rank") <= F.get(most, F.col("_search"))).select(
        F.get(labels, F.col("_search")).alias("name"), key, "rank"
    )


def suite_variant_counts(
    df: DataFrame, suite: Suite, limit: int | None = None, orderless: bool = False, all_columns: bool = False
) -> DataFrame:
    """(name, tag, rows): rows every variant of every search returns, from one scan."""
    tags = []
    for spec in suite.tests:
        for tag, varied in variants(spec, limit, orderless, all_columns):
            tags.append((spec.name, tag, varied.limit if varied.limit >= 1 else 2**62))
    listed = df.sparkSession.createDataFrame(tags, "name string, tag string, most bigint")
    return suite_counts(df, suite).join(F.broadcast(listed), "name").select(
        "name", "tag", F.least("found", "most").alias("rows")
    )


def run_lifecycle(spark: SparkSession, suite: Suite, action, view: str, data: DataFrame):
    """Setup SQL, `action()`, takedown SQL; the takedown also runs when the action fails.

    Returns the lifecycle rows (stage, statement) and the action's result. The statements may use
    the searched table under the name `view`.
    """
    data.createOrReplaceTempView(view)
    stages = []

    def run(stage: str, statements: dict | None) -> None:
        for statement in [statements["sql"]] if statements and "sql" in statements else []:
            spark.sql(statement)
            stages.append((stage, statement))

    run("setup", suite.setup)
    try:
        result = action()
    finally:
        run("takedown", suite.takedown)
    return spark.createDataFrame(stages, "stage string, statement string"), result
