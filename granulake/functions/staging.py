"""Computing an expression once.

The optimizer may copy a projected expression into every place that uses it, and into filters
pushed below the projection. That is right for cheap columns and ruinous for parsed documents.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def let(value: Column, use: Callable[[Column], Column]) -> Column:
    """`use(value)` with the value computed once per row, however often `use` names it."""
    return F.get(F.transform(F.array(value), use), F.lit(0))


def chain(value: Column, *steps: Callable[[Column], Column]) -> Column:
    """Steps that each see the result of the step before."""
    for step in steps:
        value = let(value, step)
    return value


def once(df: DataFrame, name: str, value: Column, keep_null: bool = True) -> DataFrame:
    """Add a column that is computed once per row and that filters are not pushed through.

    `keep_null=False` also drops the rows where it is NULL.
    """
    cell = F.array(value)
    rows = cell if keep_null else F.filter(cell, lambda v: v.isNotNull())
    others = [F.col(f"`{c}`") for c in df.columns if c != name]
    return df.select(*others, F.explode(rows).alias(name))
