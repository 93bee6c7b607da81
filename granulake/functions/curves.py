"""Space-filling-curve keys of the midpoint of a box."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from granulake.functions import geohash


def _midpoint(box: tuple[str, str, str, str]) -> tuple[str, str]:
    xmin, ymin, xmax, ymax = box
    return f"(({xmin} + {xmax}) / 2e0)", f"(({ymin} + {ymax}) / 2e0)"


def _grid(value: str, low: float, span: float, bits: int) -> str:
    cell = f"cast(floor(({value} - ({low}e0)) / {span}e0 * {2 ** bits}e0) as bigint)"
    return f"greatest(least({cell}, {2 ** bits - 1}), 0)"


def morton_sql(x: str, y: str, bits: int) -> str:
    """Interleaved bits of two cell numbers, y in the higher place of each pair."""
    terms = []
    for i in range(bits):
        terms.append(f"((({x} >> {i}) & 1) << {2 * i})")
        terms.append(f"((({y} >> {i}) & 1) << {2 * i + 1})")
    return "(" + " | ".join(terms) + ")"


def hilbert(x: Column, y: Column, bits: int) -> Column:
    """Distance along the Hilbert curve: one fold over the bits, highest first."""
    start = F.struct(x.alias("x"), y.alias("y"), F.lit(0).cast("bigint").alias("d"))

    def step(acc, level):
        side = F.call_function("shiftleft", F.lit(1).cast("bigint"), level)
        rx = F.when(acc["x"].bitwiseAND(side) > 0, F.lit(1)).otherwise(F.lit(0)).cast("bigint")
        ry = F.when(acc["y"].bitwiseAND(side) > 0, F.lit(1)).otherwise(F.lit(0)).cast("bigint")
        low = side - 1
        cx, cy = acc["x"].bitwiseAND(low), acc["y"].bitwiseAND(low)
        flip = (ry == 0) & (rx == 1)
        fx, fy = F.when(flip, low - cx).otherwise(cx), F.when(flip, low - cy).otherwise(cy)
        turned = ry == 0
        return F.struct(
            F.when(turned, fy).otherwise(fx).alias("x"),
            F.when(turned, fx).otherwise(fy).alias("y"),
            (acc["d"] + side * side * (rx * 3).bitwiseXOR(ry)).alias("d"),
        )

    levels = F.array(*[F.lit(i) for i in range(bits - 1, -1, -1)])
    return F.aggregate(levels, start, step, lambda acc: acc["d"])


def with_curve_key(
    df: DataFrame,
    box: tuple[str, str, str, str] = ("MBRWest", "MBRSouth", "MBREast", "MBRNorth"),
    curve: str = "hilbert",
    bits: int = 16,
    name: str = "curve_key",
) -> DataFrame:
    """Add a long ordering key ('hilbert', 'morton') or a text key ('geohash')."""
    lon, lat = _midpoint(box)
    if curve == "geohash":
        df = df.withColumns({"_mx": F.expr(lon), "_my": F.expr(lat)})
        return geohash.with_geohash(df, "_mx", "_my", max(1, 2 * bits // 5), name).drop("_mx", "_my")
    df = df.withColumns({"_cx": F.expr(_grid(lon, -180, 360, bits)), "_cy": F.expr(_grid(lat, -90, 180, bits))})
    if curve == "morton":
        df = df.withColumn(name, F.expr(morton_sql("_cx", "_cy", bits)))
    elif curve == "hilbert":
        df = df.withColumn(name, hilbert(F.col("_cx"), F.col("_cy"), bits))
    else:
        raise ValueError(f"unknown curve {curve!r}")
    return df.drop("_cx", "_cy")
