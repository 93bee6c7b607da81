"""Unions and column sets."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def union_all(frames: Sequence[DataFrame]) -> DataFrame:
    return reduce(lambda a, b: a.unionByName(b), frames)


def union_fill(frames: Sequence[DataFrame]) -> DataFrame:
    """Union by name; a column a frame lacks is NULL there."""
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), frames)


def newly_set(before: DataFrame, after: DataFrame, key: str, column: str) -> DataFrame:
    """Keys whose `column` was NULL before and is set after."""
    was_null = before.where(F.col(column).isNull()).select(key)
    still_null = after.where(F.col(column).isNull()).select(key)
    return was_null.exceptAll(still_null)


def column_intersect(df: DataFrame, wanted: Sequence[str]) -> DataFrame:
    """The wanted columns that exist, in the wanted order."""
    return df.select(*[F.col(f"`{c}`") for c in wanted if c in df.columns])


def column_except(df: DataFrame, *dropped: str) -> DataFrame:
    """All columns but some, dots in names replaced by underscores."""
    kept = [c for c in df.columns if c not in dropped]
    return df.select(*[F.col(f"`{c}`").alias(c.replace(".", "_")) for c in kept])
