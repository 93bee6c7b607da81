"""Decontamination against windows in plain sets."""

import hashlib

import plain
from granulake.llm import decontaminate
from granulake.llm.q_decontaminate import op6


def expected(rows, items):
    found = plain.windows(items)
    out = []
    for i, t in rows:
        n, hit, names = plain.hits(t, found)
        digest = hashlib.sha256(",".join(sorted(map(str, names))).encode()).hexdigest()
        out.append((i, n, hit, len(names), digest, hit > 0))
    return sorted(out, key=str)


def test_every_document_of_the_table(spark, texts):
    from plain import SF

    items = [tuple(r) for r in spark.read.parquet(f"{SF}/benchmark.parquet").select("item_id", "text").collect()]
    got = sorted(map(tuple, op6(spark, SF).collect()), key=str)
    assert got == expected(texts, items) and any(r[-1] for r in got)


def cases():
    rows = [(r[0], r[1]) for r in plain.odd_rows()]
    base = plain.prose(1, 120).split()
    items = [(1, " ".join(base[20:45])), (2, "ONE"), (3, None), (4, ""), (5, "x " * 12), (6, " ".join(base[100:112])), (6, "two words"), (7, "?!"), (None, " ".join(base[40:52]))]
    return rows, items


def test_odd_rows_in_one_pass_and_in_several(spark, odd, none):
    rows, items = cases()
    table = spark.createDataFrame([(*x, "more") for x in items], "item_id long, text string, doc_id string")
    named = [("" if i is None else i, t) for i, t in items]
    for options in ({}, {"block_words": 13, "shard_bytes": 50}):
        found = decontaminate.find_matches(odd, table, **options)
        assert sorted(map(tuple, decontaminate.digest(found).collect()), key=str) == expected(rows, named)
    assert decontaminate.find_matches(none, table).count() == 0
    nothing = decontaminate.digest(decontaminate.find_matches(odd, table.limit(0)))
    assert nothing.where("contaminated").count() == 0 and nothing.count() == len(rows)


def test_longest_matches_and_removal(spark, odd):
    base = plain.prose(1, 120).split()
    items = spark.createDataFrame([("a", " ".join(["zzz", *base[20:45], "zzz"]))], "item_id string, text string")
    found = {r.kept.doc_id: r.spans for r in decontaminate.find_matches(odd, items).where("size(spans) > 0").collect() if r.kept.doc_id}
    assert set(found) == {7, 8, 9, 10}
    assert [(s.start, s.words, s.item, s.item_start) for s in found[7]] == [(20, 25, "a", 1)]
    left = decontaminate.decontaminate(odd, items)
    assert left.columns == odd.columns
    assert not {7, 8, 9, 10} & {r.doc_id for r in left.collect()} and left.count() == odd.count() - 5
