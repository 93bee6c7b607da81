"""Zone maps: whole results from fewer files, and what happens without, beside or after a map."""

import pytest
from pyspark.sql import functions as F

from granulake.sources import zones
from granulake.sources.spec import Operation, Predicate, Search

TIME = Predicate("time", option="greater-then", value="1990-06")
BOX = Predicate("bbox", xmin=0.0, ymin=0.0, xmax=9.0, ymax=90.0)
RAW = Predicate("attribute_raw", statement="id % 2 = 0")


def rows(spark, first, count):
    id = F.col("id") + first
    x = id.cast("double")
    box = F.struct(x.alias("xmin"), x.alias("ymin"), (x + 0.5).alias("xmax"), (x + 0.5).alias("ymax"))
    when = F.format_string("19%02d-01", (id / 2).cast("int") + 60)
    return spark.range(count).select(id.alias("id"), F.when(id % 7 != 0, when).alias("StartTime"), box.alias("bbox"))


@pytest.fixture
def stored(spark, tmp_path):
    path = str(tmp_path / "data")
    rows(spark, 0, 80).repartitionByRange(8, "id").write.parquet(path)
    zones.write_zone_map(spark, path, ["StartTime", "bbox.xmin", "bbox.ymin", "bbox.xmax", "bbox.ymax"])
    return path


def both(spark, path, *operations):
    """Ids of the search with the map and of the whole scan, and the files opened."""
    spec = Search(columns=("id",), limit=-1, operations=operations)
    files = zones.choice(spark, path, spec)
    with_map = sorted(r.id for r in zones.search_zoned(spark, path, spec).collect())
    whole = sorted(r.id for r in zones.search(spark.read.parquet(path), spec).collect())
    return with_map, whole, files.where("opened").count(), files.count()


@pytest.mark.parametrize(
    "operation, fewer",
    [
        (Operation(ands=(TIME,)), True),
        (Operation(ands=(BOX,)), True),
        (Operation(ands=(BOX, TIME)), True),
        (Operation(ands=(BOX, RAW)), True),
        (Operation(ors=(BOX, TIME)), True),
        (Operation(ors=(BOX, RAW)), False),
        (Operation(nots=(BOX,)), False),
        (Operation(ands=(RAW,)), False),
    ],
)
def test_same_rows_from_the_listed_files(spark, stored, operation, fewer):
    found, whole, opened, files = both(spark, stored, operation)
    assert found == whole and files == 8
    assert (opened < files) == fewer


def test_only_listed_files_are_scanned(spark, stored):
    spec = Search(columns=("id",), limit=-1, operations=(Operation(ands=(BOX,)),))
    listed = {r.path for r in zones.choice(spark, stored, spec).where("opened").collect()}
    scanned = zones.opened(spark, stored, spec).select(F.input_file_name().alias("f")).distinct().collect()
    assert {r.f.replace("file:///", "file:/") for r in scanned} == {p.replace("file:///", "file:/") for p in listed}


def test_nothing_can_match(spark, stored):
    far = Predicate("bbox", xmin=500.0, ymin=0.0, xmax=600.0, ymax=90.0)
    found, whole, opened, _ = both(spark, stored, Operation(ands=(far,)))
    assert found == whole == [] and opened == 0


def test_new_files_are_read_and_a_renewed_map_knows_them(spark, stored):
    rows(spark, 5, 3).coalesce(1).write.mode("append").parquet(stored)
    found, whole, opened, files = both(spark, stored, Operation(ands=(BOX,)))
    assert found == whole and found.count(6) == 2 and files == 9
    far = Operation(ands=(Predicate("bbox", xmin=70.0, ymin=0.0, xmax=79.0, ymax=90.0),))
    before = both(spark, stored, far)
    zones.write_zone_map(spark, stored, ["bbox.xmin", "bbox.xmax"])
    after = both(spark, stored, far)
    assert before[0] == before[1] == after[0] and before[2] == after[2] + 1


def test_rows_without_values_stay_possible(spark, tmp_path):
    path = str(tmp_path / "nulls")
    spark.range(4).select("id", F.lit(None).cast("string").alias("StartTime")).coalesce(1).write.parquet(path)
    zones.write_zone_map(spark, path, ["StartTime"])
    assert both(spark, path, Operation(ands=(TIME,))) == ([], [], 1, 1)


def test_without_a_map_all_is_scanned(spark, tmp_path):
    path = str(tmp_path / "bare")
    rows(spark, 0, 20).coalesce(2).write.parquet(path)
    found, whole, opened, files = both(spark, path, Operation(ands=(BOX,)))
    assert found == whole and opened == files
    with pytest.raises(ValueError, match="no bounds"):
        zones.write_zone_map(spark, path, ["missing"])
