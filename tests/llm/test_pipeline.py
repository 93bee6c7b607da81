"""The pipeline stage by stage against plain versions of what each decides."""

import hashlib

import pytest
from pyspark.sql import functions as F

import corpus_pipeline as pipeline
import plain
from plain import SF
from granulake.llm import quality_rules, toxicity
from granulake.llm.fitting import fold


@pytest.fixture(scope="module")
def stages(spark):
    """Input and output rows of every stage."""
    docs, out = pipeline.table(spark, SF, "documents"), []
    for _, stage in pipeline.STAGES:
        after = stage(spark, docs, SF).cache()
        out.append((docs, after))
        docs = after
    return out


def ids(df):
    return sorted(r.doc_id for r in df.select("doc_id").collect())


def test_columns_and_order(spark, stages):
    assert [n for n, _ in pipeline.STAGES] == ["toxicity", "quality rules", "n-gram Jaccard join", "benchmark decontamination", "byte-level BPE"]
    for before, after in stages[:-1]:
        assert after.schema == before.schema
        assert not after.exceptAll(before).count()  # rows go, none changes


def test_toxicity(spark, stages):
    docs, after = stages[0]
    labels = pipeline.table(spark, SF, "labels")
    scores = toxicity.scored(docs, toxicity.fit(docs, labels, fold("doc_id", 3) != 1)).collect()
    assert ids(after) == sorted(r.doc_id for r in scores if r.score < pipeline.THRESHOLD)


def test_quality(spark, stages):
    docs, after = stages[1]
    rules = quality_rules.fit(docs, pipeline.table(spark, SF, "labels"))
    judged = {r.doc_id: r.kept for r in quality_rules.judged(docs, rules, [F.col("doc_id")]).collect()}
    assert ids(after) == sorted(i for i, kept in judged.items() if kept)
    for r in docs.collect():
        n, _, _, _, repeated = plain.statistics(r.text)
        assert not (judged[r.doc_id] and (n < 50 or 100 * repeated > 50 * n))


def test_one_of_each_group(stages):
    docs, after = stages[2]
    rows = sorted((r.doc_id, r.text) for r in docs.collect())
    assert ids(after) == [i for (i, _), (_, least) in zip(rows, plain.components(rows)) if i == least]


def test_decontamination(spark, stages):
    docs, after = stages[3]
    found = plain.windows([tuple(r) for r in pipeline.table(spark, SF, "benchmark").select("item_id", "text").collect()])
    assert ids(after) == sorted(r.doc_id for r in docs.collect() if not plain.hits(r.text, found)[1])


def test_encoding(stages):
    docs, after = stages[4]
    assert {r.doc_id: r.decoded_sha256 for r in after.collect()} == {r.doc_id: hashlib.sha256(r.text.encode()).hexdigest() for r in docs.collect()}


def test_run_gives_the_last_stage(spark, stages):
    assert sorted(map(tuple, pipeline.run(spark, SF).collect())) == sorted(map(tuple, stages[-1][1].collect()))


def test_odd_rows_pass_every_stage(spark, odd, none):
    for docs in (odd, none):
        for _, stage in pipeline.STAGES:
            after = stage(spark, docs, SF)
            assert after.count() <= docs.count()
            docs = after if "text" in after.columns else docs
