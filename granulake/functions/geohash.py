"""Geohash codes and the bin names made from them, as SQL text and as table steps.

A base-32 letter holds five bits, alternately longitude and latitude. Letters at even places take
three longitude bits and two latitude bits, letters at odd places the other way round, so each
letter is one lookup of a 3-bit chunk and a 2-bit chunk. The SQL text runs in any dialect with
`>>` and `&`.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# The geohash alphabet and the four quadrants of its one-letter cells.
ALPHABET = "0123456789bcdefghjkmnpqrstuvwxyz"
QUADRANT_LETTERS = {
    "NE": "uvyzstwx",
    "NW": "bcfg89de",
    "SE": "kmqrhjnp",
    "SW": "23670145",
}

# Metres of the approximate distance between two hashes by shared prefix length.
PREFIX_METRES = {
    0: 20000000.0,
    1: 5003530.0,
    2: 625441.0,
    3: 123264.0,
    4: 19545.0,
    5: 3803.0,
    6: 610.0,
    7: 118.0,
    8: 19.0,
    9: 3.71,
    10: 0.6,
}

REGION_NAMES = ("All", "Global", "North", "East", "West", "South", "NW", "NE", "SE", "SW")


def _chunk_letters() -> str:
    """ALPHABET re-indexed by (3-bit chunk * 4 + 2-bit chunk)."""
    letters = []
    for chunk in range(32):
        three, two = chunk >> 2, chunk & 3
        code = ((three >> 2) << 4) | ((two >> 1) << 3) | (((three >> 1) & 1) << 2) | ((two & 1) << 1) | (three & 1)
        letters.append(ALPHABET[code])
    return "".join(letters)


CHUNK_LETTERS = _chunk_letters()


def _bits(precision: int) -> tuple[int, int]:
    return (5 * precision + 1) // 2, (5 * precision) // 2


def _cell(value: str, low: float, span: float, bits: int, edge: str) -> str:
    cell = f"cast(floor((({value}) - ({low}e0)) / {span}e0 * {2 ** bits}e0) as bigint)"
    if edge == "clamp":
        return f"case when ({value}) is not null then greatest(least({cell}, {2 ** bits - 1}), 0) end"
    if edge == "wrap":
        return f"({cell} & {2 ** bits - 1})"
    raise ValueError(f"edge must be 'clamp' or 'wrap', not {edge!r}")


def cell_sql(lon: str, lat: str, precision: int, edge: str = "clamp") -> tuple[str, str]:
    """SQL of the integer cell numbers (column, row) of a point."""
    lon_bits, lat_bits = _bits(precision)
    return _cell(lon, -180, 360, lon_bits, edge), _cell(lat, -90, 180, lat_bits, edge)


def letters_sql(x: str, y: str, precision: int) -> str:
    """SQL of the hash of integer cell numbers."""
    lon_bits, lat_bits = _bits(precision)
    letters = []
    for place in range(precision):
        lon_used, lat_used = _bits(place)
        if place % 2 == 0:
            three = f"(({x} >> {lon_bits - lon_used - 3}) & 7)"
            two = f"(({y} >> {lat_bits - lat_used - 2}) & 3)"
        else:
            three = f"(({y} >> {lat_bits - lat_used - 3}) & 7)"
            two = f"(({x} >> {lon_bits - lon_used - 2}) & 3)"
        letters.append(f"substr('{CHUNK_LETTERS}', cast({three} * 4 + {two} + 1 as int), 1)")
    return letters[0] if precision == 1 else f"concat({', '.join(letters)})"


def geohash_sql(lon: str, lat: str, precision: int, edge: str = "clamp") -> str:
    x, y = cell_sql(lon, lat, precision, edge)
    return letters_sql(x, y, precision)


def with_geohash(
    df: DataFrame, lon: str, lat: str, precision: int, name: str = "geohash", edge: str = "clamp"
) -> DataFrame:
    """Add the hash of a coordinate pair; the cell numbers are computed once per row."""
    x, y = cell_sql(lon, lat, precision, edge)
    return (
        df.withColumns({"_gx": F.expr(x), "_gy": F.expr(y)})
        .withColumn(name, F.expr(letters_sql("_gx", "_gy", precision)))
        .drop("_gx", "_gy")
    )


def with_corner_hashes(
    df: DataFrame, box: tuple[str, str, str, str], precision: int, edge: str = "clamp"
) -> DataFrame:
    """Add `hash1` (lower left) and `hash2` (upper right) of a box given as (xmin, ymin, xmax, ymax)."""
    xmin, ymin, xmax, ymax = box
    df = with_geohash(df, xmin, ymin, precision, "hash1", edge)
    return with_geohash(df, xmax, ymax, precision, "hash2", edge)


def decode_sql(code: str, longest: int = 12) -> tuple[str, str]:
    """SQL of the exact centre (lon, lat) of a hash of up to `longest` letters."""
    lon_terms, lat_terms = [], []
    for place in range(longest):
        index = f"(instr('{CHUNK_LETTERS}', substr({code}, {place + 1}, 1)) - 1)"
        lon_end, lat_end = _bits(place + 1)
        three, two = f"({index} >> 2)", f"({index} & 3)"
        lon_chunk, lat_chunk = (three, two) if place % 2 == 0 else (two, three)
        present = f"length({code}) > {place}"
        lon_terms.append(f"case when {present} then {lon_chunk} / {2 ** lon_end}e0 else 0e0 end")
        lat_terms.append(f"case when {present} then {lat_chunk} / {2 ** lat_end}e0 else 0e0 end")
    lon_half = f"pow(2e0, -1 - ceil(5e0 * length({code}) / 2))"
    lat_half = f"pow(2e0, -1 - floor(5e0 * length({code}) / 2))"
    lon = f"(360e0 * ({' + '.join(lon_terms)} + {lon_half}) - 180e0)"
    lat = f"(180e0 * ({' + '.join(lat_terms)} + {lat_half}) - 90e0)"
    return lon, lat


def with_decoded(df: DataFrame, code: str, prefix: str = "", longest: int = 12) -> DataFrame:
    lon, lat = decode_sql(code, longest)
    return df.withColumns({f"{prefix}lon": F.expr(lon), f"{prefix}lat": F.expr(lat)})


def shared_prefix(left: str, right: str, longest: int = 12) -> Column:
    """Longest shared prefix of two hashes, letter case ignored."""
    a, b = F.lower(F.col(left)), F.lower(F.col(right))
    same = F.lit("")
    for size in range(1, longest + 1):
        grown = (F.length(a) >= size) & (F.substring(a, 1, size) == F.substring(b, 1, size))
        same = F.when(grown, F.substring(a, 1, size)).otherwise(same)
    return F.when(a.isNotNull() & b.isNotNull(), same)


def approximate_metres(left: str, right: str, longest: int = 12) -> Column:
    """Approximate distance of two hashes from the length of their shared prefix."""
    size = F.length(shared_prefix(left, right, longest))
    deepest = max(PREFIX_METRES)
    metres = F.create_map(*[F.lit(v) for pair in PREFIX_METRES.items() for v in pair])
    return metres[F.least(size, F.lit(deepest))]


def quadrant(letter: Column) -> Column:
    """NE, NW, SE or SW of a hash by its first letter; '' for a letter outside the alphabet."""
    first = F.lower(F.substring(letter, 1, 1))
    out = F.lit("")
    for name, letters in QUADRANT_LETTERS.items():
        out = F.when(first.isin(*letters), F.lit(name)).otherwise(out)
    return F.when(first.isNotNull(), out)


def corner_region(left: Column, right: Column) -> Column:
    """Region of a box by the first letters of its lower-left and upper-right hashes."""
    a, b = F.lower(F.substring(left, 1, 1)), F.lower(F.substring(right, 1, 1))
    qa, qb = quadrant(a), quadrant(b)
    sides = {
        ("SW", "NE"): "All",
        ("SE", "NE"): "East",
        ("SW", "NW"): "West",
        ("NW", "NE"): "North",
        ("SW", "SE"): "South",
    }
    region = qa
    for (low, high), name in sides.items():
        region = F.when((qa == low) & (qb == high), F.lit(name)).otherwise(region)
    return F.when(a == b, a).when((a == "0") & (b == "z"), F.lit("Global")).otherwise(region)


def hemispheres(xmin: Column, ymin: Column, xmax: Column, ymax: Column) -> Column:
    """Quadrants a box touches: one name, a pair, 'All', or 'Central' when it touches none."""
    return quadrant_names(xmin < 0, xmax > 0, ymin < 0, ymax > 0)


def quadrant_names(west: Column, east: Column, south: Column, north: Column) -> Column:
    """Name of the touched quadrants, looked up by the four flags (each is computed once)."""
    names = []
    for flags in range(16):
        w, e, s, n = flags & 8, flags & 4, flags & 2, flags & 1
        if w and e and s and n:
            name = "All"
        elif w and e and (s or n):
            name = "SW-SE" if s else "NE-NW"
        elif s and n and (w or e):
            name = "SW-NW" if w else "SE-NE"
        elif (w or e) and (s or n):
            name = ("S" if s else "N") + ("W" if w else "E")
        else:
            name = "Central"
        names.append(F.lit(name))
    index = sum(
        (F.coalesce(flag, F.lit(False)).cast("int") * weight for flag, weight in ((west, 8), (east, 4), (south, 2), (north, 1))),
        F.lit(0),
    )
    return F.get(F.array(*names), index)


def cell_hemispheres(hash1: Column, hash2: Column) -> Column:
    """Quadrants of the box between the centres of two cells, in either order.

    A cell lies in the quadrant of its first letter, and no centre lies on the equator or the prime
    meridian.
    """
    a, b = F.substring(hash1, 1, 1), F.substring(hash2, 1, 1)

    def either(*names):
        letters = list("".join(QUADRANT_LETTERS[n] for n in names))
        return a.isin(letters) | b.isin(letters)

    return quadrant_names(either("NW", "SW"), either("NE", "SE"), either("SW", "SE"), either("NW", "NE"))


# Pair names by quadrant -> the names by side used in prefix mode.
SIDE_OF_PAIR = {"SW-NW": "West", "SE-NE": "East", "NE-NW": "North", "SW-SE": "South"}


def is_beyond_globe(xmin: Column, ymin: Column, xmax: Column, ymax: Column) -> Column:
    return (xmin < -180) | (xmax > 180) | (ymin < -90) | (ymax > 90)


def path_of(prefix: Column, depth: int) -> Column:
    """Letters of a prefix joined by '/'."""
    letters = [F.nullif(F.substring(prefix, i + 1, 1), F.lit("")) for i in range(depth)]
    return F.concat_ws("/", *letters)


def with_nested_path(df: DataFrame, depth: int = 3, name: str = "path") -> DataFrame:
    """Path of a row with `hash1`/`hash2`: shared letters (at most `depth`) joined by '/', else
    the hemisphere of the two cell centres. `depth=1` is the flat bin."""
    a, b = F.col("hash1"), F.col("hash2")
    path = cell_hemispheres(a, b)
    for size in range(1, depth + 1):
        path = F.when(F.substring(a, 1, size) == F.substring(b, 1, size), path_of(a, size)).otherwise(path)
    return df.withColumn(name, F.when(a.isNotNull() & b.isNotNull(), path))


def flat_path(df: DataFrame, name: str = "path") -> DataFrame:
    """Flat bin of one-letter hashes; longer hashes are an error."""
    one = (F.length("hash1") == 1) & (F.length("hash2") == 1)
    checked = df.withColumn(
        "hash1", F.when(one, F.col("hash1")).otherwise(F.raise_error(F.lit("hashes must have one letter")))
    )
    return with_nested_path(checked, 1, name)


def with_prefix_path(df: DataFrame, depth: int, name: str = "path") -> DataFrame:
    """Path by shared prefix of any depth, else the region name of the corner letters."""
    region = corner_region(F.col("hash1"), F.col("hash2"))
    shared = shared_prefix("hash1", "hash2", depth)
    return df.withColumn(name, F.when(F.length(region) == 1, path_of(shared, depth)).otherwise(region))


def with_box_bins(
    df: DataFrame,
    box: tuple[str, str, str, str] = ("MBRWest", "MBRSouth", "MBREast", "MBRNorth"),
    mode: str = "flat",
    depth: int = 1,
    name: str = "hashbin",
    edge: str = "clamp",
) -> DataFrame:
    """One step from box columns to a bin column (mode 'flat', 'nested' or 'prefix')."""
    precision = 1 if mode == "flat" else depth
    df = with_corner_hashes(df, box, precision, edge)
    if mode == "flat":
        df = with_nested_path(df, 1, name)
    elif mode == "nested":
        df = with_nested_path(df, depth, name)
    elif mode == "prefix":
        df = with_prefix_path(df, depth, name)
    else:
        raise ValueError(f"unknown bin mode {mode!r}")
    return df.drop("hash1", "hash2")
