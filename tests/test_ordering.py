import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from granulake.functions import shapes
from granulake.operators import aggregates, joins, layout, ordering

random.seed(3)
# one group and one value hold a third of the rows
ROWS = [(i, "hot" if i % 3 == 0 else f"g{i % 11}", 7.0 if i % 3 == 0 else float(random.randint(0, 400)) / 4) for i in range(6000)]


@pytest.fixture(scope="module")
def table(spark):
    return spark.createDataFrame(ROWS, "id bigint, grp string, v double").repartition(7)


def test_positions(table):
    got = {r.id: r.pos for r in ordering.row_positions(table, ["v", "id"], "pos").collect()}
    want = {row[0]: n for n, row in enumerate(sorted(ROWS, key=lambda r: (r[2], r[0])), 1)}
    assert got == want


def test_positions_within_groups(table):
    got = {r.id: r.pos for r in ordering.row_positions(table, ["v", "id"], "pos", ["grp"]).collect()}
    want, seen = {}, {}
    for row in sorted(ROWS, key=lambda r: (r[2], r[0])):
        seen[row[1]] = want[row[0]] = seen.get(row[1], 0) + 1
    assert got == want


def test_top_k_per_group(table):
    got = sorted((r.grp, r.id) for r in ordering.top_k_per_group(table, ["grp"], [F.desc("v"), "id"], 25).collect())
    want = []
    for name in {r[1] for r in ROWS}:
        want += [(name, r[0]) for r in sorted((r for r in ROWS if r[1] == name), key=lambda r: (-r[2], r[0]))[:25]]
    assert got == sorted(want)


def test_top_k_of_equal_rows(spark):
    df = spark.createDataFrame([("a", 1)] * 500, "g string, v int").repartition(5)
    assert ordering.top_k_per_group(df, ["g"], ["v"], 40).count() == 40


@pytest.mark.parametrize("groups", [(), ("grp",)])
def test_quantiles(table, groups):
    rows = ordering.exact_quantiles(table, "v", [0.0, 0.5, 0.95, 1.0], groups).collect()
    for row in rows:
        values = [r[2] for r in ROWS if not groups or r[1] == row.grp]
        want = np.quantile(values, [0.0, 0.5, 0.95, 1.0])
        assert [row.p0, row.p50, row.p95, row.p100] == pytest.approx(list(want)) and row.n == len(values)


def test_ecdf_and_lookup(spark, table):
    values = np.array([r[2] for r in ROWS])
    for row in ordering.ecdf(table, "v").limit(200).collect():
        assert row.pctile == pytest.approx((values <= row.v).mean())
    probes = spark.createDataFrame([("a", 7.0), ("b", -1.0), ("c", 1e9), ("d", 50.1)], "n string, x double")
    got = {r.n: r.pctile for r in ordering.ecdf_lookup(table, "v", probes).collect()}
    assert got == pytest.approx({"a": (values <= 7).mean(), "b": 0.0, "c": 1.0, "d": (values <= 50.1).mean()})


def test_threshold_outside_is_an_error(table):
    with pytest.raises(ValueError):
        ordering.add_quantile_flag(table, "v", 1.2)


def test_previous_row(table):
    got = {r.id: r.prev_v for r in ordering.with_previous(table, ["v", "id"], ["v"]).collect()}
    order = sorted(ROWS, key=lambda r: (r[2], r[0]))
    assert got == {row[0]: before[2] if before else None for row, before in zip(order, [None, *order])}


def test_pages_after_a_cursor(table):
    seen, cursor = [], None
    for _ in range(3):
        page = ordering.keyset_page(table, ["v", "id"], cursor, 100).collect()
        seen += [r.id for r in page]
        cursor = (page[-1].v, page[-1].id)
    assert seen == [r[0] for r in sorted(ROWS, key=lambda r: (r[2], r[0]))[:300]]


def test_max_pages_caps_only_when_asked(table):
    assert ordering.page_numbers(table, ["grp"], ["v", "id"], 100).count() == len(ROWS)
    capped = ordering.page_numbers(table, ["grp"], ["v", "id"], 100, max_pages=2)
    assert capped.agg(F.max("page")).first()[0] == 2


def test_load_in_window(spark):
    stamps = [f"2024-01-01T00:{m:02d}:{s:02d}" for m in range(0, 50, 3) for s in (0, 0, 59)]
    got = {r.now: r.load for r in ordering.load_in_window(spark.createDataFrame([(t,) for t in stamps], "now string"), "now", 5).collect()}
    seconds = [int(t[14:16]) * 60 + int(t[17:]) for t in stamps]
    for text, at in zip(stamps, seconds):
        assert got[text] == sum(abs(at - other) <= 300 for other in seconds)


def _boxes(count, largest):
    out = []
    for i in range(count):
        w, s = random.uniform(-180, 170), random.uniform(-90, 80)
        out.append((i, w, s, min(180.0, w + random.uniform(0, largest)), min(90.0, s + random.uniform(0, largest))))
    return out + [(count, -180.0, -90.0, 180.0, 90.0), (count + 1, 10.0, 10.0, 20.0, 20.0)]


@pytest.mark.parametrize("broadcast_limit", [20_000, 0])
def test_shape_join_finds_every_pair_once(spark, monkeypatch, broadcast_limit):
    monkeypatch.setattr(joins, "BROADCAST_CELLS", broadcast_limit)
    left, right = _boxes(400, 60), _boxes(60, 30)
    g = spark.createDataFrame(left, "id int, MBRWest double, MBRSouth double, MBREast double, MBRNorth double")
    q = spark.createDataFrame(right, "shape int, xmin double, ymin double, xmax double, ymax double")
    got = sorted((r.id, r.shape) for r in joins.shape_join(g, q).collect())
    want = sorted((a[0], b[0]) for a in left for b in right if a[1] <= b[3] and a[3] >= b[1] and a[2] <= b[4] and a[4] >= b[2])
    assert got == want


def test_hulls(spark):
    points = [("hot" if i % 3 == 0 else "cold", random.gauss(0, 1), random.gauss(0, 1)) for i in range(900)]
    points += [("hot", x, y) for x, y in ((-9.0, -9.0), (9.0, -9.0), (9.0, 9.0), (-9.0, 9.0), (0.0, -9.0))]
    df = spark.createDataFrame(points, "k string, x double, y double").repartition(6)
    hot = {(r.x, r.y) for r in layout.hulls(df, "k", "x", "y").where("k = 'hot'").collect()}
    assert hot == {(-9.0, -9.0), (9.0, -9.0), (9.0, 9.0), (-9.0, 9.0)}


def test_right_closed_bins(spark):
    values = [0.5, 1.0, 1.5, 10.0, 10.5, 100.0, 5e9]
    rows = aggregates.histogram(spark.createDataFrame([(v,) for v in values], "v double"), "v", (1.0, 10.0, 100.0)).collect()
    assert [r.n for r in rows] == [3, 2, 1] and rows[0].label == "1 - 10"


def test_verification_rules(spark):
    results = spark.createDataFrame([("a", 0, ["x"]), ("b", 5, ["x", "y"]), ("c", 5, ["x"]), ("d", 3, []), ("e", 1, ["q"])], "name string, found bigint, ids array<string>")
    rules = spark.createDataFrame([("a", "count", "0"), ("b", "contains", "y"), ("c", "exact", "x"), ("d", "greater-then", "3")], "name string, action string, expected string")
    got = {r.name: r.passed for r in aggregates.verify(results, rules).collect()}
    assert got == {"a": True, "b": True, "c": True, "d": False, "e": True}
    assert tuple(aggregates.tally(aggregates.verify(results, rules)).first()) == (4, 1)


def test_world_wide_shapes_stay_a_small_broadcast(spark):
    box = [F.lit(v) for v in (-180.0, -90.0, 180.0, 90.0)]
    cells = lambda levels: spark.range(1).select(sum((joins._cell_count(s, box) for s in levels), F.lit(0))).first()[0]
    assert cells(joins.GRID_LEVELS) > 500 and 20_000 * cells(joins.COARSE_LEVELS) <= joins.BROADCAST_CELLS
    q = spark.range(20_000).select("id", *[v.alias(n) for v, n in zip(box, ("xmin", "ymin", "xmax", "ymax"))])
    g = spark.createDataFrame([(i, x, x / 2, x + 1, x / 2 + 1) for i, x in enumerate((-170.0, 0.0, 150.0))], "g int, MBRWest double, MBRSouth double, MBREast double, MBRNorth double")
    assert joins.shape_join(g, q).count() == 60_000


def test_exact_join_of_wide_and_small_shapes(spark, monkeypatch):
    monkeypatch.setattr(joins, "BROADCAST_BYTES", 0)
    left, right = _boxes(60, 40), [*_boxes(20, 30), (90, -180.0, -90.0, 180.0, 90.0), (91, -100.0, -80.0, 100.0, 80.0)]
    rings = lambda *c: F.struct(F.lit("Polygon").alias("kind"), shapes.box_rings(*[F.col(x) for x in c]).alias("rings"))
    g = spark.createDataFrame(left, "id int, MBRWest double, MBRSouth double, MBREast double, MBRNorth double")
    q = spark.createDataFrame(right, "shape_id int, xmin double, ymin double, xmax double, ymax double")
    g, q = g.withColumn("geometry", rings(*joins.BOX)), q.withColumn("shape", rings("xmin", "ymin", "xmax", "ymax"))
    got = sorted((r.id, r.shape_id) for r in joins.shape_join(g, q, exact=True).select("id", "shape_id").collect())
    assert got == sorted((a[0], b[0]) for a in left for b in right if a[1] <= b[3] and a[3] >= b[1] and a[2] <= b[4] and a[4] >= b[2])


def test_quantiles_inside_sketch_brackets(spark):
    rows = [("hot" if i % 3 else "cold", random.choice([5.0, random.gauss(0, 100), float(i % 50)])) for i in range(6000)]
    rows += [("one", 7.0), ("two", 1.0), ("two", 3.0), (None, 2.0), (None, 9.0), ("gone", None)]
    df = spark.createDataFrame(rows, "k string, v double").repartition(5)
    probabilities = [0.0, 0.01, 0.5, 0.95, 0.999, 1.0]
    for groups in (["k"], []):
        got = ordering.exact_quantiles(df, "v", probabilities, groups, accuracy=100).collect()
        assert {r["k"] for r in got} == {"hot", "cold", "one", "two", None} if groups else len(got) == 1
        for r in got:
            mine = [v for k, v in rows if v is not None and (not groups or k == r["k"])]
            want = np.quantile(mine, probabilities)
            assert r["n"] == len(mine)
            assert np.allclose([r[ordering.quantile_name(p)] for p in probabilities], want)
    ranged = ordering.exact_quantiles(df, "v", [0.5], ["k"], accuracy=1000)
    assert ranged.where("k = 'hot'").first()["p50"] == np.quantile([v for k, v in rows if k == "hot"], 0.5)


def test_distributions_of_one_pass_are_those_of_their_own(spark):
    rows = [(i, i % 7 if i % 4 else None, float(i % 11) / 3 if i % 5 else None, i % 3 == 0) for i in range(500)]
    df = spark.createDataFrame(rows, "id int, a int, b double, some boolean")
    both = ordering.ecdfs(df, {"pa": ("a", F.col("some"), 6), "pb": ("b", None, None)})
    alone = ordering.ecdf(ordering.ecdf(df, "a", "pa", base=F.col("some"), digits=6), "b", "pb")
    assert sorted(map(str, both.collect())) == sorted(map(str, alone.select(*both.columns).collect()))
