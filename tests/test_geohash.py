import pytest
from pyspark.sql import functions as F

from granulake.functions import curves, geohash
from granulake.operators import layout

CASES = [  # lat, lon, precision, clamped, wrapped
    (42.6, -5.6, 5, "ezs42", "ezs42"),
    (42.6, -5.6, 4, "ezs4", "ezs4"),
    (42.6, -5.6, 3, "ezs", "ezs"),
    (42.6, -5.6, 2, "ez", "ez"),
    (42.6, -5.6, 1, "e", "e"),
    (0.0, -180.0, 5, "80000", "80000"),
    (-90.0, 180.0, 5, "pbpbp", "00000"),
    (0.0, 180.0, 5, "xbpbp", "80000"),
    (90.0, 180.0, 5, "zzzzz", "00000"),
    (-90.0, 0.0, 5, "h0000", "h0000"),
    (0.0, -5.6, 5, "ebh00", "ebh00"),
    (-89.99, 179.99, 5, "pbpbp", "pbpbp"),
    (0.0, 179.99, 5, "xbpbp", "xbpbp"),
    (89.99, 179.99, 5, "zzzzz", "zzzzz"),
]


@pytest.mark.parametrize("lat,lon,precision,clamped,wrapped", CASES)
def test_codes(spark, lat, lon, precision, clamped, wrapped):
    df = spark.createDataFrame([(lat, lon)], "lat double, lon double")
    df = geohash.with_geohash(df, "lon", "lat", precision, "c")
    df = geohash.with_geohash(df, "lon", "lat", precision, "w", "wrap")
    assert df.select("c", "w").first() == (clamped, wrapped)


def test_missing_coordinates_have_no_code(spark):
    df = spark.createDataFrame([(None, 1.0)], "lat double, lon double")
    assert geohash.with_geohash(df, "lon", "lat", 3).first().geohash is None


def test_centres(spark):
    df = spark.createDataFrame([("ezs42",), ("e",), ("",)], "code string")
    rows = geohash.with_decoded(df, "code").collect()
    assert rows[0].lat == pytest.approx(42.60498046875) and rows[0].lon == pytest.approx(-5.60302734375)
    assert (rows[1].lon, rows[1].lat) == (-22.5, 22.5)
    assert (rows[2].lon, rows[2].lat) == (0.0, 0.0)


BOXES = [
    (-10, -10, 1, 1, "All"),
    (-10, -10, -5, -5, "SW"),
    (5, -10, 10, -5, "SE"),
    (-10, 5, -5, 10, "NW"),
    (5, 5, 10, 10, "NE"),
    (-10, -10, 10, 0, "SW-SE"),
    (-10, 0, 10, 10, "NE-NW"),
    (-10, -10, 0, 10, "SW-NW"),
    (0, -10, 10, 10, "SE-NE"),
    (-10, 0, 0, 10, "NW"),
    (0, -10, 10, 0, "SE"),
    (-10, -10, 0, 0, "SW"),
    (0, 0, 10, 10, "NE"),
    (0, 0, 0, 0, "Central"),
]


def test_hemispheres(spark):
    df = spark.createDataFrame([tuple(map(float, b[:4])) + (b[4],) for b in BOXES], "w double, s double, e double, n double, want string")
    got = df.select("want", geohash.hemispheres(F.col("w"), F.col("s"), F.col("e"), F.col("n")).alias("got"))
    assert all(r.want == r.got for r in got.collect())


def test_prefix_paths(spark):
    pairs = [
        ("u4pruydqqvj8", "u4pruydqqvj3", "u/4/p/r/u/y/d/q/q/v/j"),
        ("u4pruydqqvj8", "v4pruydqqvj3", "NE"),
        ("h4pruydqqvj8", "v4pruydqqvj3", "East"),
        ("74pruydqqvj8", "s4pruydqqvj3", "All"),
        ("04pruydqqvj8", "z4pruydqqvj3", "Global"),
        ("ecd", "uud", "North"),
        ("7cd", "7ud", "7"),
        ("8cd", "cud", "NW"),
    ]
    df = spark.createDataFrame(pairs, "hash1 string, hash2 string, want string")
    assert all(r.want == r.path for r in geohash.with_prefix_path(df, 12).collect())


def test_prefix_ignores_case(spark):
    df = spark.createDataFrame([("ABCe", "abcd")], "a string, b string")
    assert df.select(geohash.shared_prefix("a", "b")).first()[0] == "abc"


def test_flat_path_refuses_long_hashes(spark):
    df = spark.createDataFrame([("u4", "u5")], "hash1 string, hash2 string")
    with pytest.raises(Exception, match="one letter"):
        geohash.flat_path(df).collect()


def test_nested_path_honours_depth(spark):
    df = spark.createDataFrame([("u4pr", "u4pq"), ("u4pr", "u5pq"), ("u4pr", "e4pq")], "hash1 string, hash2 string")
    assert [r.path for r in geohash.with_nested_path(df, 2).collect()] == ["u/4", "u", "NE-NW"]


def test_summary_of_empty_class_is_null(spark):
    df = spark.createDataFrame([("u/4",), ("u/4",), ("b",)], "path string")
    rows = {r.item: r.value for r in layout.bin_summary(df).collect()}
    assert rows["Sum"] == 3 and rows["Avg"] == 1 and rows["BigSum"] == 0 and rows["BigBox"] is None and rows["Bucket"] == 1
    literal = {r.item: r.value for r in layout.bin_summary(df, literal=True).collect()}
    assert literal["BigSum"] == 1 and literal["BktSum"] == 2  # 'b' occurs inside 'Global'


def _hilbert(x, y, bits):
    d, side = 0, 1 << (bits - 1)
    while side:
        rx, ry = int(x & side > 0), int(y & side > 0)
        d += side * side * ((3 * rx) ^ ry)
        if ry == 0:
            if rx:
                x, y = (1 << bits) - 1 - x, (1 << bits) - 1 - y
            x, y = y, x
        side >>= 1
    return d


def test_hilbert_visits_every_cell_once(spark):
    df = spark.range(64).selectExpr("id div 8 as x", "id % 8 as y").withColumn("d", curves.hilbert(F.col("x"), F.col("y"), 3))
    rows = df.collect()
    assert sorted(r.d for r in rows) == list(range(64))
    assert all(r.d == _hilbert(r.x, r.y, 3) for r in rows)
    place = {r.d: (r.x, r.y) for r in rows}
    assert all(abs(place[i][0] - place[i + 1][0]) + abs(place[i][1] - place[i + 1][1]) == 1 for i in range(63))


def test_bucket_filter_keeps_every_overlapping_row(spark):
    boxes = [(float(x), float(y), float(x + w), float(y + h)) for x in range(-180, 180, 23) for y in range(-90, 85, 17) for w, h in ((0, 0), (1, 1), (50, 4), (45, 45)) if x + w <= 180 and y + h <= 90]
    df = spark.createDataFrame(boxes, ", ".join(f"{c} double" for c in layout.BOX))
    tree = layout.with_tree_columns(geohash.with_box_bins(df, mode="nested", depth=3, name="path"), "path", 3).cache()
    for box in [(0.0, 0.0, 10.0, 10.0), (-180.0, -90.0, 180.0, 90.0), (44.0, 20.0, 45.0, 45.0), (-23.0, -5.0, -22.0, -4.5)]:
        direct = df.where(layout.overlaps(box)).count()
        assert layout.lookup(tree, box, 3).count() == direct
    small = tree.where(layout.bucket_filter((1.0, 1.0, 2.0, 2.0), 3)).count()
    assert small < tree.count()
