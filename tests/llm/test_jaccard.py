"""The Jaccard join against all pairs."""

import random

import plain
from granulake.llm import jaccard
from granulake.llm.q_jaccard import op4


def rows_of(df):
    return sorted(map(tuple, df.select("doc_id", "n_shingles", "component_id").collect()), key=str)


def check(spark, rows, **options):
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    expected = [(i, *c) for (i, _), c in zip(rows, plain.components(rows))]
    assert rows_of(jaccard.jaccard_components(docs, **options)) == sorted(expected, key=str)


def test_every_document_of_the_table(spark, texts):
    from plain import SF

    expected = [(i, *c) for (i, _), c in zip(texts, plain.components(texts))]
    assert rows_of(op4(spark, SF)) == sorted(expected, key=str)


def test_chains_near_the_threshold(spark):
    rng = random.Random(3)
    rows, text = [], plain.prose(9, 60).split()
    for i in range(90):  # neighbours link, the ends of a chain do not
        if i % 30 == 0:
            text = plain.prose(100 + i, 60).split()
        text = [*text]
        text[rng.randrange(len(text))] = f"new{i}"
        rows.append((1000 - i, " ".join(text)))
    rows += [(2000 + i, " ".join(text)) for i in range(20)]
    check(spark, rows)


def test_exact_threshold(spark):
    base = plain.prose(11, 11).split()  # 7 shingles; 6 of 8 are 75 %
    rows = [(1, " ".join(base)), (2, " ".join([*base[:10], "other"])), (3, " ".join(base[:10])), (4, " ".join([*base[:9], "x", "y"]))]
    check(spark, rows)


def test_odd_rows(odd, none, spark):
    rows = [(r[0], r[1]) for r in plain.odd_rows()]
    check(spark, rows)
    assert rows_of(jaccard.jaccard_components(none)) == []
    kept = jaccard.keep_one(odd)
    assert kept.columns == odd.columns
    ids = sorted((r.doc_id for r in kept.collect()), key=str)
    # 5 copies 4, 8 and 9 copy 7, 15 is twice; rows without an id stay
    assert ids == sorted([1, 2, 3, 4, 6, 7, 10, 11, 12, 13, 14, 15, 16, 17, None, None], key=str)
    assert jaccard.keep_one(none).count() == 0


def test_a_table_that_is_there_twice(spark, texts):
    rows = [(r[0], r[1]) for r in plain.odd_rows() if r[0] is not None]
    docs = spark.createDataFrame(rows, "doc_id long, text string").coalesce(1)
    expected = sorted(((i, *c) for (i, _), c in zip(rows, plain.components(rows))), key=str)
    got = rows_of(jaccard.jaccard_components(docs.union(docs)))
    assert got == sorted(expected * 2, key=str)
