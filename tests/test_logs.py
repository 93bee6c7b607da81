import json

import pytest
from pyspark.sql import functions as F

from granulake.functions import profiles, times
from granulake.operators import categories, logs


def line(**fields):
    return "2024 INFO REPORT " + json.dumps({"now": "2024-10-01T00:00:00", **fields})


def parsed(spark, *lines, **options):
    df = spark.createDataFrame([(x,) for x in lines], "value string")
    return logs.log_table(df, **options).collect()


def test_only_whole_reports_are_kept(spark):
    rows = parsed(spark, line(uri="/search/granules"), line(uri="/x")[:-1], "INFO {}", "REPORT nothing")
    assert [r.uri for r in rows] == ["/search/granules"]


@pytest.mark.parametrize(
    "uri,concept,fmt",
    [
        ("/search/granules.umm_json", "granules", "umm_json"),
        ("/search/granules/timeline", "granules/timeline", None),
        ("/search/concepts/C1-P.iso19115", "concepts", "iso"),
        ("/search/concepts/C1-P.dif10", "concepts", "dif"),
        ("/search/csw/collections", "csw/collections", None),
        ("/search/", "search/", None),
        ("/search", "search/", None),
        ("/search/index.PHP", "PHP requests", None),
        ("/search/odd/place", "odd/place", None),
        ("http://daac.example/daacdata/a/b.csv", "http://daac.example/daacdata", "csv"),
        ("/search/site/docs/x", "site/docs", None),
    ],
)
def test_concept_and_format(spark, uri, concept, fmt):
    row = spark.createDataFrame([(uri,)], "uri string").select(logs.uri_concept(F.col("uri")), logs.uri_format(F.col("uri"))).first()
    assert tuple(row) == (concept, fmt)


@pytest.mark.parametrize(
    "agent,kind",
    [
        ("python-requests/2.31", "Python"),
        ("Mozilla/5.0 (X11)", "Web Browser"),
        ("Googlebot/2.1", "Bot"),
        ("podaac-subscriber-1.9 v2", "podaac-subscriber"),
        ("HARMONY v2 x", "HARMONY"),
        ("PycURL/7", "Python"),
        ("tool(beta)", "tool"),
    ],
)
def test_agents(spark, agent, kind):
    assert spark.range(1).select(logs.user_agent_type(F.lit(agent))).first()[0] == kind


def test_parameters(spark):
    query = {"provider": "PROV'x", "page_size": "20.7", "sort_key[]": ["a", "b"], "version": "Near-Real-Time 6", "concept_id": "C1", "short_name": "MOD"}
    (row,) = parsed(spark, line(uri="/search/granules", **{"query-params": query, "form-params": {"short_name": "other", "page-num": "x"}}))
    assert (row.provider, row.page_size, row.sort_key, row.version, row.concept_id, row.short_name, row.page_num) == (
        "PROV", 20, "a,b", "Near-Real-Time 6", "C1", "MOD", None
    )


def test_last_temporal_parameter_wins_and_lists_join(spark):
    (row,) = parsed(spark, line(**{"query-params": {"temporal": "a"}, "form-params": {"temporal[]": ["b", "c"]}}))
    assert (row.time_query, row.time_type) == ("b;c", "params.temporal")


def test_facets_and_other_times(spark):
    facet = lambda **f: {"query-params": {"temporal_facet": {"0": f}, "updated_since": "u"}}
    rows = parsed(spark, line(**facet(year="2011", month="5", day="3")), line(**facet(year="2011")), line(**{"query-params": {"production_date": "p", "revision_date": ["r", "s"]}}))
    assert [(r.time_query, r.time_type) for r in rows] == [
        ("2011-5-3", "params.temporal.facet"), ("2011", "params.temporal.facet"), ("r;s", "params.revision.date"),
    ]


def test_circle_overwrites_only_when_literal(spark):
    text = line(**{"query-params": {"polygon": "0,0,1,0,1,1,0,0", "circle": "1,2,30"}})
    (guarded,), (literal,) = parsed(spark, text), parsed(spark, text, literal=True)
    assert (guarded.geo_type, guarded.circle_radius) == ("POLYGON", None)
    assert (literal.geo_type, literal.wkt, literal.circle_radius) == ("CIRCLE", "POINT (1 2)", 30)


def test_shapes_errors_and_tags(spark):
    make = lambda **q: line(**{"query-params": q})
    rows = parsed(
        spark, make(point="1,2,3"), make(bounding_box="1,2,3"), make(**{"polygon[]": ["0,0,1,0,1,1,0,0", "5,5,6,5,6,6,5,5"]}),
        make(orbit_number="4"), make(two_d_coordinate_system_name="WRS", point="1,2"), make(cycle="3"), make(page_size="1"),
    )
    assert [(r.geo_type, r.wkt, r.error) for r in rows] == [
        ("POINT", None, "POINT ERROR: Odd Coordinate Count"),
        ("BBOX", None, "ERROR: failed to parse bbox coordinates"),
        ("POLYGON", "MULTIPOLYGON (((0 0, 1 0, 1 1, 0 0)), ((5 5, 6 5, 6 6, 5 5)))", None),
        ("orbit", None, None), ("POINT", "POINT (1 2)", None), ("cycle/pass", None, None), (None, None, None),
    ]


def test_a_bracket_in_a_text_is_no_list(spark):
    (row,) = parsed(spark, line(**{"query-params": {"sort_key": "[a,b]"}}))
    assert row.sort_key == "[a,b]"


def test_category_needs_more_than_99_percent(spark):
    df = spark.createDataFrame([(0.99, None), (0.991, 1.0)], "area_pctile double, vertex_pctile double").selectExpr("*", "true spatial_bool", "false temporal_bool", "true sort_bool")
    assert [r.c for r in df.select(categories.category_code().alias("c")).collect()] == ["10100", "10111"]


SAMPLE = "HTTPFS \n HTTP Stats \n in: 10.2 MiB \n out: 0 \n #HEAD: 34 \n #GET: 12 \n #PUT: 0 \n #POST: 0 \n └"


def test_io_counters(spark):
    one = lambda t: spark.createDataFrame([(t,)], "t string").select(profiles.io_stats(F.col("t")).alias("s")).first().s
    assert one(SAMPLE).asDict() == {"in": 10695475, "out": 0, "HEAD": 34.0, "GET": 12.0, "PUT": 0.0, "POST": 0.0}
    assert one("HTTPFS in: 3 furlongs └")["in"] == -1 and one("HTTPFS #GET: 2 └")["in"] == 0
    assert one("nothing") is None


def test_time_slices(spark):
    df = spark.createDataFrame([("2024-01-15T06:00:00", "2024-03-02T00:00:00")], "a string, b string")
    pick = lambda **o: [(r.slice_start[:10], r.slice_end[:10]) for r in times.explode_slices(df, "a", "b", "month", **o).collect()]
    assert pick() == [("2024-01-15", "2024-02-01"), ("2024-02-01", "2024-03-01"), ("2024-03-01", "2024-03-02")]
    assert pick(literal=True) == [("2024-02-01", "2024-03-01")]
    assert len(times.explode_slices(df, "a", "b", "hour").collect()) == 46 * 24 + 18


def test_slices_are_computed_in_generated_code(spark):
    rows = [("2024-01-31T06:00:00", "2024-03-02T00:00:00"), ("2024-05-20T00:00:00", "2024-05-10T00:00:00"), ("2024-05-20T00:00:00",) * 2]
    rows += [(None, "2024-03-02T00:00:00"), ("2024-03-02T00:00:00", None), ("2024-12-31T23:00:00", "2025-01-02T23:00:00")]
    df = spark.createDataFrame([(i, *r) for i, r in enumerate(rows)], "id int, a string, b string")
    text = lambda c: F.date_format(c, "yyyy-MM-dd'T'HH:mm:ss.SSSSSS'Z'")
    for unit in times.STEPS:
        for literal in (False, True):
            found = times.explode_slices(df, "a", "b", unit, literal)
            listed = times.slices(F.to_timestamp_ntz("a"), F.to_timestamp_ntz("b"), unit, literal)
            plain = df.select("*", F.explode(listed).alias("_s")).select(*df.columns, text("_s.start"), text("_s.end"))
            assert found.columns == ["id", "a", "b", "slice_start", "slice_end"]
            assert sorted(map(str, map(tuple, found.collect()))) == sorted(map(str, map(tuple, plain.collect())))
            # before: arrays of slices, filtered and made one by one
            assert "lambda" not in found._jdf.queryExecution().optimizedPlan().toString()
