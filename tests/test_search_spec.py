import json

import pytest

from granulake.operators import search
from granulake.sources import spec

SHAPE = (
    "POLYGON((-110.60867891721024 53.37487808881224, -110.60867891721024 53.29764645852637, "
    "-109.73806661064765 53.29764645852637, -109.73806661064765 53.37487808881224, -110.60867891721024 53.37487808881224))"
)
SUITE = {
    "name": "Primary",
    "tests": [{"name": "geo1", "operations": [{"ands": [{"type_of": "geometry", "option": "intersects", "value": SHAPE}]}], "expected": {"action": "count", "value": 46151}}],
}
YAML = """
name: Primary
tests:
  - name: First
    operations:
      - ands:
          - {type_of: time, option: greater-then, value: '2017-06-29T16:21'}
    expected: {action: count, value: 11208}
"""


def test_json_defaults():
    one = spec.from_json(json.dumps(SUITE)).tests[0]
    assert one.limit == 2000 and one.columns == ("*",) and one.operations[0].ands[0].type_of == "geometry"


def test_yaml_by_suffix(tmp_path):
    pytest.importorskip("yaml")
    path = tmp_path / "suite.yml"
    path.write_text(YAML)
    assert spec.load(str(path)).tests[0].expected.value == 11208


@pytest.mark.parametrize(
    "broken",
    [
        {"tests": [{"name": "x"}]},
        {"tests": [{"raw": "select 1", "colour": "red"}]},
        {"tests": [{"operations": [{}]}]},
        {"tests": [{"operations": [{"ands": [{"type_of": "magic"}]}]}]},
        {"tests": [{"raw": "x", "limit": "many"}]},
        {"tests": [{"raw": "x", "expected": {"action": "count"}}]},
        {"name": "no tests"},
    ],
)
def test_closed_and_checked(broken):
    with pytest.raises(spec.SpecError):
        spec.from_json(json.dumps(broken))


def test_nots_alone_are_enough():
    data = {"tests": [{"operations": [{"nots": [{"type_of": "attribute_raw", "statement": "a > 1"}]}]}]}
    assert spec.from_json(json.dumps(data)).tests[0].operations[0].nots


BASE = spec.Search(name="s", columns=("c1",), operations=(), sortby="c1", limit=10)


def test_variant_edits():
    assert BASE.with_limit(128).limit == 128 and BASE.with_limit(-1).limit == -1
    assert spec.Search(operations=(), limit=0).with_limit(128).limit == 0
    assert BASE.without_order().sortby is None and BASE.without_order().limit == 10
    assert BASE.all_columns().columns == ("*",)


def test_variant_tags():
    tags = [t for t, _ in search.variants(BASE, 128, True, True)]
    assert tags == [
        "flag-0-base", "flag-1-all", "flag-2-orderless", "flag-3-orderless-all", "flag-4-limit:128",
        "flag-5-limit:128-all", "flag-6-limit:128-orderless", "flag-7-limit:128-orderless-all",
    ]
    assert [t for t, _ in search.variants(BASE, None, True, False, base=False)] == ["flag-2-orderless"]
    assert [t for t, _ in search.variants(BASE, 5, False, True)] == ["flag-0-base", "flag-1-all", "flag-4-limit:5", "flag-5-limit:5-all"]


def test_takedown_runs_even_after_failure(spark):
    suite = spec.Suite(tests=(), setup={"sql": "CREATE OR REPLACE TEMP VIEW up AS SELECT 1 AS x"}, takedown={"sql": "DROP VIEW up"})
    with pytest.raises(RuntimeError):
        search.run_lifecycle(spark, suite, lambda: (_ for _ in ()).throw(RuntimeError("no")), "v", spark.range(1))
    assert not spark.catalog.tableExists("up")


def test_unlimited_searches_of_a_suite(spark):
    from pyspark.sql import functions as F

    df = spark.range(3000).select(F.format_string("G%05d", "id").alias("GranuleUR"))
    step = spec.Predicate("attribute_raw", statement="GranuleUR >= 'G00500'")
    tests = tuple(spec.Search(name=n, limit=m, operations=(spec.Operation(ands=(step,)),)) for n, m in (("all", 0), ("few", 10)))
    rows = search.suite_results(df, spec.Suite(tests=tests)).groupBy("name").count().collect()
    assert {r["name"]: r["count"] for r in rows} == {"all": 2500, "few": 10}


def test_box_reaches_the_scan(spark, tmp_path):
    from granulake.sinks import tables as sinks

    path = str(tmp_path / "t")
    df = spark.createDataFrame([("a", 0.0, 0.0, 1.0, 1.0)], "GranuleUR string, MBRWest double, MBRSouth double, MBREast double, MBRNorth double")
    sinks.write_covering_box(df, path)
    spark.conf.set("spark.sql.maxMetadataStringLength", "10000")
    plan = spark.read.parquet(path).where(search.box_struct(0, 0, 5, 5)).select("GranuleUR")._jdf.queryExecution().executedPlan().toString()
    spark.conf.unset("spark.sql.maxMetadataStringLength")
    assert "GreaterThanOrEqual(bbox.xmax,0.0)" in plan and "MBRWest" not in plan.split("ReadSchema")[1]


def test_exact_test_runs_after_the_box_test(spark):
    import numpy as np

    from granulake.functions import geometry_batch as gb
    from granulake.functions import shapes
    from pyspark.sql import functions as F

    df = spark.range(10).selectExpr("cast(id as double) MBRWest", "cast(id as double) MBRSouth", "id + 1D MBREast", "id + 1D MBRNorth")
    rings = shapes.box_rings(*[F.col(c) for c in search.BOX])
    df = df.withColumn("geometry", F.struct(F.lit("Polygon").alias("kind"), rings.alias("rings")))
    shape = gb.write_wkb("Polygon", [(0, False, np.array([(2, 2), (4, 2), (4, 4), (2, 2)], dtype=float))])
    found = search.intersects(df, shape)
    plan = found._jdf.queryExecution().executedPlan().toString()
    python, box = plan.index("ArrowEvalPython"), plan.rindex("Filter")
    assert python < box and found.count() == 4
