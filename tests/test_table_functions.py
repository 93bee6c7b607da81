"""Table functions against the column forms, bins by function, bucketed joins, published files."""

import gzip
import json
import os

import numpy as np
import pyarrow.parquet as pq
import pytest
from pyspark.sql import functions as F

from granulake.functions import geohash, geometry_batch, shapes, table_functions, udfs
from granulake.operators import joins
from granulake.plans import inputs
from granulake.sinks import tables as sinks
from granulake.sources import echo10, hits
from oracle import SF_DIR


def xml(inner, place="Spatial"):
    text = f"<Granule><GranuleUR>G</GranuleUR><{place}><HorizontalSpatialDomain><Geometry>{inner}</Geometry></HorizontalSpatialDomain></{place}></Granule>"
    return gzip.compress(text.encode())


def pt(x, y):
    return f"<Point><PointLongitude>{x}</PointLongitude><PointLatitude>{y}</PointLatitude></Point>"


def test_documents_as_the_column_form(spark):
    ring = pt(0, 0) + pt(4, 0) + pt(4, 4)
    docs = [
        xml("<Point><Longitude>1.5</Longitude><Latitude>2</Latitude></Point>"),
        xml(f"<Line>{pt(0, 0)}</Line><Line>{pt(0, 0)}{pt(1, 1)}</Line>", "SpatialExtent"),
        xml(f"<GPolygon><Boundary>{ring}</Boundary></GPolygon><GPolygon><Boundary>{ring}{pt(0, 0)}</Boundary></GPolygon>"),
        xml("<Point><Longitude>1</Longitude></Point>"),
        gzip.compress(b"<Granule/>"),
        gzip.compress(b"not xml <"),
        b"not gzip",
        b"",
        None,
    ]
    df = spark.createDataFrame([(d,) for d in docs], "metadata binary")
    table_functions.register(spark)
    got = spark.sql("select * from xml_to_rows(table({df}))", df=df)
    want = echo10.with_wkb(echo10.to_shapes(df))
    key = lambda rows: sorted((r.GranuleID, bytes(r.geometry)) for r in rows.select("GranuleID", "geometry").collect())
    assert key(got) == key(want) and got.count() == 4
    assert "Exchange" not in got._jdf.queryExecution().executedPlan().toString()


@pytest.mark.parametrize("seed", range(3))
def test_hits_as_the_column_form(spark, seed):
    rng = np.random.default_rng(seed)
    rows = []
    for i in range(300):
        info, ords = [], []
        for _ in range(rng.integers(0, 4)):
            code = int(rng.integers(0 if i % 9 == 0 else 1, 10 if i % 9 == 0 else 9))
            n = int({3: 2, 4: 1}.get(code, rng.integers(2, 6)) * 2) + int(i % 13 == 0)
            info += [code, n]
            ords += [int(v) for v in rng.integers(-900000000, 900000000, n)]
            if code in (1, 2) and i % 2:
                ords[-2:] = ords[-n : len(ords) - n + 2]
        if i % 17 == 0:
            ords = ords[:-1]
        if i % 19 == 0:
            info = info[:-1]
        rows.append((f"G{i}", None if i % 31 == 0 else ords, None if i % 37 == 0 else info))
    df = spark.createDataFrame(rows, "GranuleUR string, ords array<bigint>, ords_info array<int>")
    table_functions.register(spark)
    got = spark.sql("select * from ords_to_rows(table({df}))", df=df)
    want = hits.explode_shapes(df.select("GranuleUR", hits.decode_ords(F.col("ords"), F.col("ords_info")).alias("shapes")))
    kind = F.when(F.col("shape.kind").isin("Hole", "Rectangle"), "Polygon").otherwise(F.col("shape.kind"))
    rings = F.array(shapes.ring(F.col("shape.xs"), F.col("shape.ys")))
    want = want.select("GranuleUR", "shape_no", geometry_batch.encode_wkb(kind, rings).alias("geometry"))
    key = lambda rows: sorted((r.GranuleUR, r.shape_no, bytes(r.geometry)) for r in rows.collect())
    assert key(got) == key(want) and got.count() > 100


def test_bins_by_function(spark):
    udfs.register_hashbin(spark)
    boxes = inputs.granule_boxes(spark, SF_DIR, wkb=True)
    both = geohash.with_box_bins(inputs.granules(spark, SF_DIR), mode="flat").select("GranuleUR", "hashbin").join(boxes, "GranuleUR")
    assert both.where(F.expr("hashbin_wkb(geometry, 1)") != F.col("hashbin")).count() == 0
    empty = geometry_batch.write_wkb("Polygon", [])
    rows = spark.createDataFrame([(None,), (empty,)], "g binary").selectExpr("hashbin_wkb(g, 1) as b").collect()
    assert [r.b for r in rows] == [None, None]


def test_bucketed_tables_join_without_a_shuffle(spark, tmp_path):
    left = spark.range(500).selectExpr("id as GranuleUR", "id * 2 as v")
    right = spark.range(0, 500, 3).selectExpr("id as GranuleUR", "'A' as hashbin")
    stored = [sinks.save_bucketed(df, f"bucketed_{n}_{os.getpid()}", "GranuleUR", 4, str(tmp_path / n)) for n, df in (("l", left), ("r", right))]
    joined = joins.join_bins(stored[0], stored[1].hint("merge"))
    assert "Exchange" not in joined._jdf.queryExecution().executedPlan().toString()
    assert joined.count() == 167


def test_files_appear_at_the_commit_only(spark, tmp_path):
    path = str(tmp_path / "geo")
    df = spark.range(90).selectExpr("encode(cast(id as string), 'utf-8') as geometry", "'Point' as kind", "id", *[f"cast(id as double) as {c}" for c in sinks.BOX])
    written = sinks.write_geo(df.repartition(3), path)
    assert written.agg(F.sum("rows")).first()[0] == 90
    bad = df.repartition(3).withColumn("id", F.when(F.col("id") == 77, F.raise_error(F.lit("lost")).cast("long")).otherwise(F.col("id")))
    out = bad.drop("kind").write.format("geo_files").mode("append").option("geo", "{}").option("group_rows", "10")
    with pytest.raises(Exception, match="lost|aborted"):
        out.save(path)
    names = sorted(os.listdir(path))
    assert len(names) == 3 and all(n.startswith("part-") for n in names)
    geo = [json.loads(pq.ParquetFile(os.path.join(path, n)).schema_arrow.metadata[b"geo"]) for n in names]
    assert all(g == geo[0] for g in geo)
    column = geo[0]["columns"]["geometry"]
    assert column["bbox"] == [0.0, 0.0, 89.0, 89.0] and column["crs"]["id"] == {"authority": "OGC", "code": "CRS84"}
    sinks.write_geo(df.limit(5), path, mode="overwrite")
    assert spark.read.parquet(path).count() == 5
    sinks.write_geo(df.limit(0), str(tmp_path / "none"))
    assert os.listdir(tmp_path / "none") == []
