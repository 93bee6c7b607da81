"""Zone maps: the bounds of every row group, kept beside a data set, choose the files of a search before its scan.

The map is a Parquet table in the folder `_zones` of the data set, which readers of the data skip: one row for each
file and row group, with the group's lowest and highest value of the mapped columns in their own types. It is read
from footers by tasks, never from the data. A search turns its specification into a test of these bounds; files with
no row group that can hold a match are not listed to the scan, and inside the others the scan's own filters skip row
groups by the same bounds. Files that are new or rewritten since the map was made are always read, so an old map costs
time and never rows.

Defined results: a row group without bounds for a column (only NULLs, or a writer that keeps none) counts as one that
may hold a match; predicates the map says nothing about (free SQL, columns not mapped) let every file through; a data
set without a map is scanned whole.
"""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, BinaryType, DataType, MapType, StructType, VariantType

from granulake.functions.geometry_batch import write_wkb
from granulake.functions.wkt import read_literal
from granulake.operators.layout import BOX
from granulake.operators.search import search, shape_box
from granulake.sources import footers
from granulake.sources.spec import Predicate, Search, SpecError

FOLDER = "_zones"


def _leaves(schema: StructType, above: str = "") -> dict[str, DataType]:
    """Columns with bounds in a footer, fields of structs by their path."""
    out = {}
    for field in schema:
        name = f"{above}{field.name}"
        if isinstance(field.dataType, StructType):
            out |= _leaves(field.dataType, f"{name}.")
        elif not isinstance(field.dataType, (ArrayType, MapType, BinaryType, VariantType)):
            out[name] = field.dataType
    return out


def _data(spark: SparkSession, path: str) -> DataFrame:
    """Names, sizes and times of the data files now."""
    reader = spark.read.format("binaryFile").option("recursiveFileLookup", "true").option("pathGlobFilter", "*.parquet")
    return reader.load(path).select("path", "length", "modificationTime")


def zone_map(spark: SparkSession, path: str, columns: Sequence[str]) -> DataFrame:
    """path, length, modificationTime, row_group, rows, and for each column its bounds as struct (low, high)."""
    types = _leaves(spark.read.parquet(path).schema)
    unknown = [c for c in columns if c not in types]
    if unknown:
        raise ValueError(f"no bounds are kept for {', '.join(unknown)}")
    stats = footers.column_stats(spark, path).groupBy("path", "row_group").agg(
        F.max("rows").alias("rows"), *[_bounds(c, types[c]) for c in columns]
    )
    return _data(spark, path).join(stats, "path")


def _bounds(name: str, kind: DataType) -> Column:
    mine = F.col("column") == name
    low, high = (F.max(F.when(mine, F.col(c))).cast(kind).alias(n) for c, n in (("min", "low"), ("max", "high")))
    return F.struct(low, high).alias(name)


def write_zone_map(spark: SparkSession, path: str, columns: Sequence[str]) -> None:
    """Make or renew the map of a data set."""
    zone_map(spark, path, columns).write.mode("overwrite").parquet(f"{path}/{FOLDER}")


def read_zone_map(spark: SparkSession, path: str) -> DataFrame | None:
    try:
        return spark.read.parquet(f"{path}/{FOLDER}")
    except AnalysisException:
        return None


# ---- tests of bounds -----------------------------------------------------------------------------


def _all(tests: Sequence[Column | None]) -> Column | None:
    tests = [t for t in tests if t is not None]
    return reduce(lambda a, b: a & b, tests) if tests else None


def _reaches(zones: DataFrame, column: str, low=None, high=None) -> Column | None:
    """A value between `low` and `high` may be there; None if the map does not say."""
    if column not in zones.columns:
        return None
    bounds = F.col(f"`{column}`")
    return _all(
        [
            None if low is None else F.coalesce(bounds["high"] >= F.lit(low), F.lit(True)),
            None if high is None else F.coalesce(bounds["low"] <= F.lit(high), F.lit(True)),
        ]
    )


def _meets(zones: DataFrame, box: Sequence[float], sides: Sequence[str]) -> Column | None:
    w, s, e, n = sides
    xmin, ymin, xmax, ymax = box
    return _all(
        [_reaches(zones, w, high=xmax), _reaches(zones, e, low=xmin), _reaches(zones, s, high=ymax), _reaches(zones, n, low=ymin)]
    )


def _sides(name: str) -> tuple[str, str, str, str]:
    return tuple(f"{name}.{side}" for side in ("xmin", "ymin", "xmax", "ymax"))


def _may_hold(zones: DataFrame, step: Predicate, range_mode: str) -> Column | None:
    """Test of the bounds that no row group with a match of the predicate fails."""
    if step.type_of == "bbox":
        return _meets(zones, (step.xmin, step.ymin, step.xmax, step.ymax), _sides(step.bbox_column_name))
    if step.type_of == "geometry":
        shape = read_literal(step.value)
        if shape is None:
            raise SpecError("the geometry value is not valid WKT")
        box = shape_box(write_wkb(*shape))
        return _meets(zones, box, BOX if all(c in zones.columns for c in BOX) else _sides("bbox"))
    if step.type_of != "time":
        return None
    if step.option == "greater-then":
        return _reaches(zones, "StartTime", low=step.value)
    if step.option == "less-then":
        return _reaches(zones, "StartTime", high=step.value)
    first, _, last = step.value.partition("/")
    if range_mode == "covers":
        return _all([_reaches(zones, "StartTime", high=first or None), _reaches(zones, "EndTime", low=last or None)])
    return _all([_reaches(zones, "EndTime", low=first or None), _reaches(zones, "StartTime", high=last or None)])


def may_match(zones: DataFrame, spec: Search, range_mode: str = "covers") -> Column:
    """Row groups that may hold a row of the search. `nots` say nothing: bounds cannot show that all rows match."""
    tests = []
    for operation in spec.operations or ():
        tests += [_may_hold(zones, step, range_mode) for step in operation.ands]
        either = [_may_hold(zones, step, range_mode) for step in operation.ors]
        if either and all(t is not None for t in either):
            tests.append(reduce(lambda a, b: a | b, either))
    whole = _all(tests)
    return F.lit(True) if whole is None else whole


# ---- searches ------------------------------------------------------------------------------------


def choice(spark: SparkSession, path: str, spec: Search, range_mode: str = "covers") -> DataFrame:
    """Every data file of now: path, known (the map has it as it is), row_groups, rows, and how many of both are in
    row groups that may match; `opened` if the search reads it."""
    now, zones = _data(spark, path), read_zone_map(spark, path)
    counts = "row_groups bigint, rows bigint, matching_groups bigint, matching_rows bigint"
    if zones is None:
        none = [F.lit(None).cast("bigint").alias(c.split()[0]) for c in counts.split(", ")]
        return now.select("path", F.lit(False).alias("known"), *none, F.lit(True).alias("opened"))
    may = may_match(zones, spec, range_mode)
    mapped = zones.groupBy("path", "length", "modificationTime").agg(
        F.count(F.lit(1)).alias("row_groups"),
        F.sum("rows").alias("rows"),
        F.count_if(may).alias("matching_groups"),
        F.coalesce(F.sum(F.when(may, F.col("rows"))), F.lit(0)).alias("matching_rows"),
    )
    known = F.col("row_groups").isNotNull()
    return now.join(mapped, ["path", "length", "modificationTime"], "left").select(
        "path",
        known.alias("known"),
        *[c.split()[0] for c in counts.split(", ")],
        F.coalesce(F.col("matching_groups") > 0, F.lit(True)).alias("opened"),
    )


def opened(spark: SparkSession, path: str, spec: Search, range_mode: str = "covers") -> DataFrame:
    """The rows of the files a search has to open.

    Only the names of these files come to the driver, which lists the files of any scan; the whole data set's
    schema is kept, folder columns included.
    """
    whole = spark.read.parquet(path)
    files = [r.path for r in choice(spark, path, spec, range_mode).where("opened").select("path").toLocalIterator()]
    if not files:
        return whole.where(F.lit(False))
    return spark.read.schema(whole.schema).option("basePath", path).parquet(*files)


def search_zoned(spark: SparkSession, path: str, spec: Search, range_mode: str = "covers", prepare=None) -> DataFrame:
    """The search over a stored data set, with its files chosen by the zone map. `prepare` may add columns."""
    if spec.raw is not None:
        data = spark.read.parquet(path)
    else:
        data = opened(spark, path, spec, range_mode)
    return search(data if prepare is None else prepare(data), spec, range_mode)
