"""Time slices."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

STEPS = {"hour": "interval 1 hour", "day": "interval 1 day", "month": "interval 1 month"}


def slices(start: Column, end: Column, unit: str, literal: bool = False) -> Column:
    """Array of half-open slices (start, end) of [start, end].

    Months begin on the first. The slices cover the whole span, the outer ones clipped to it;
    `literal` keeps only whole steps: nothing before the first boundary or after the last one.
    """
    if unit not in STEPS:
        raise ValueError(f"unsupported interval {unit!r}")
    step = F.expr(STEPS[unit])
    first = F.to_timestamp_ntz(F.date_trunc("month", start)) if unit == "month" else start
    upper = F.when(first < end, F.sequence(first, end, step)).otherwise(F.array(first))
    if literal:
        bounds = F.filter(upper, lambda b: b >= start)
    else:
        inner = F.filter(upper, lambda b: (b > start) & (b < end))
        bounds = F.concat(F.array(start), inner, F.array(end))
    pairs = F.transform(
        F.when(F.size(bounds) > 1, F.sequence(F.lit(0), F.size(bounds) - 2)).otherwise(F.array().cast("array<int>")),
        lambda i: F.struct(F.get(bounds, i).alias("start"), F.get(bounds, i + 1).alias("end")),
    )
    return F.filter(pairs, lambda p: p["start"] < p["end"])


def explode_slices(df: DataFrame, start: str, end: str, unit: str, literal: bool = False) -> DataFrame:
    """One row per slice of every row's span, as ISO text; the slices are those of `slices`.

    Only the boundaries are an array: a slice is computed from its boundary, in generated code.
    """
    if unit not in STEPS:
        raise ValueError(f"unsupported interval {unit!r}")
    step = F.expr(STEPS[unit])
    text = lambda c: F.date_format(c, "yyyy-MM-dd'T'HH:mm:ss.SSSSSS'Z'")
    timed = df.withColumns({"_a": F.to_timestamp_ntz(F.col(start)), "_b": F.to_timestamp_ntz(F.col(end))})
    a, b, at = F.col("_a"), F.col("_b"), F.col("_at")
    first = F.to_timestamp_ntz(F.date_trunc("month", a)) if unit == "month" else a
    rows = timed.withColumn("_at", F.explode(F.when(a < b, F.sequence(first, b, step))))
    rows = rows.where((at >= a) & (at + step <= b) if literal else at < b)
    begin, stop = (at, at + step) if literal else (F.greatest(at, a), F.least(at + step, b))
    return rows.withColumns({"slice_start": text(begin), "slice_end": text(stop)}).drop("_a", "_b", "_at")
