"""I/O counters written in query profile texts."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from granulake.functions.staging import let

# Bytes per unit.
UNIT_BYTES = {"TiB": 1024**4, "GiB": 1024**3, "MiB": 1024**2, "KiB": 1024}

# Request kinds that are counted.
ACTIONS = ("HEAD", "GET", "PUT", "POST")


def section(text: Column) -> Column:
    """The HTTP part of a profile; NULL when there is none."""
    part = F.regexp_extract(text, r"(?s)HTTPFS(.*?)└", 1)
    return F.when(text.rlike(r"(?s)HTTPFS.*?└"), part)


def byte_count(text: Column, name: str) -> Column:
    """Bytes of `name: 10.2 MiB`; no unit means bytes, an unknown unit -1, no entry 0."""
    pattern = rf"{name}:\s*(\d*\.?\d+)[ \t]*(\w*)"
    parts = [F.regexp_extract(text, pattern, i).alias(n) for i, n in ((1, "value"), (2, "unit"))]
    sizes = F.create_map(*[F.lit(v) for word, size in {"": 1, **UNIT_BYTES}.items() for v in (word, float(size))])
    number = lambda v: F.floor(v["value"].try_cast("double") * sizes[v["unit"]])
    known = lambda v: F.coalesce(number(v), F.lit(-1))
    return let(F.struct(*parts), lambda v: F.when(v["value"] == "", 0).otherwise(known(v)).cast("bigint"))


def request_count(text: Column, action: str) -> Column:
    """Number after `#GET:`; 0 when it is missing."""
    value = F.regexp_extract(text, rf"(?m)#{action}:\s*(\d*\.?\d+)", 1).try_cast("double")
    return F.coalesce(value, F.lit(0.0))


def io_stats(text: Column) -> Column:
    """Struct (in, out, HEAD, GET, PUT, POST); NULL without an HTTP part."""

    def read(part):
        fields = [byte_count(part, "in").alias("in"), byte_count(part, "out").alias("out")]
        fields += [request_count(part, a).alias(a) for a in ACTIONS]
        return F.when(part.isNotNull(), F.struct(*fields))

    return let(section(text), read)
