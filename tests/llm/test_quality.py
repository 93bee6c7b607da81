"""Statistics against plain counting; learned rules on labels that follow a rule."""

import numpy as np
from pyspark.sql import functions as F

import plain
from granulake.llm import quality_rules, rule_ensemble
from granulake.llm.q_quality import op7, op9
from granulake.llm.statistics import SHARES, with_statistics

NAMES = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")


def counted(df):
    return sorted(((r.doc_id, *(r[n] for n in NAMES)) for r in df.collect()), key=str)


def test_statistics_of_every_document(spark, texts):
    from plain import SF

    got = op7(spark, SF)
    assert counted(got) == sorted(((i, *plain.statistics(t)) for i, t in texts), key=str)
    for r in got.collect():
        assert r.base_failed == (r.n_words < 50 or 100 * r.n_repeat_words > 50 * r.n_words)
        assert not (r.base_failed and r.kept)


def test_statistics_of_odd_rows(odd, none):
    got = with_statistics(odd, [F.col("doc_id")])
    assert counted(got) == sorted(((r[0], *plain.statistics(r[1])) for r in plain.odd_rows()), key=str)
    assert with_statistics(none, [F.col("doc_id")]).count() == 0


def table(n=900):
    rng = np.random.default_rng(1)
    out = {name: rng.random(n) for name in SHARES}
    out["failed"] = np.zeros(n, bool)
    bad = ((out["symbols"] > 0.7) & (out["upper"] <= 0.6)) | (out["distinct"] <= 0.15)
    return out, (~bad).astype(int)


def test_decision_list_finds_the_rules():
    shares, label = table()
    rules = quality_rules.learn(shares, label)
    rejected = np.zeros(len(label), bool)
    for rule in rules:
        rejected |= np.logical_and.reduce([c.holds(shares) for c in rule])
    assert (rejected == (label == 0)).mean() > 0.95
    assert not (rejected & (label == 1)).mean() > 0.02


def test_the_list_ends_where_rules_are_not_right():
    shares, label = table()
    assert quality_rules.learn(shares, np.random.default_rng(0).integers(0, 2, len(label))) == []
    assert quality_rules.learn(shares, np.ones(len(label), int)) == []


def test_column_expressions_say_what_the_rules_say(spark):
    shares, label = table(60)
    rules = [[quality_rules.Condition("symbols", True, 0.7), quality_rules.Condition("upper", False, 0.6)], [quality_rules.Condition("distinct", False, 0.15)]]
    rows = [(i, *(float(shares[n][i]) for n in SHARES)) for i in range(60)]
    df = spark.createDataFrame(rows, ["i", *SHARES]).withColumn("x", F.struct(*SHARES))
    assert [r[0] for r in df.orderBy("i").select(quality_rules.verdict(rules)).collect()] == [bool(y) for y in label]
    model = rule_ensemble.Ensemble([tuple(r) for r in rules], [1.5, -2.0], 0.25)
    holds = np.array([np.logical_and.reduce([c.holds(shares) for c in r]) for r in rules])
    expected = 1 / (1 + np.exp(-(0.25 + holds.T @ np.array([1.5, -2.0]))))
    got = [r[0] for r in df.orderBy("i").select(model.column()).collect()]
    assert np.allclose(got, expected)


def test_documents_without_labels_are_kept(spark, odd, none):
    labels = spark.createDataFrame([], "doc_id long, quality int")
    rules = quality_rules.fit(odd, labels)
    assert rules == []
    kept = quality_rules.keep_good(odd, rules)
    expected = [r for r in plain.odd_rows() if (s := plain.statistics(r[1]))[0] >= 50 and 100 * s[4] <= 50 * s[0]]
    assert kept.columns == odd.columns and sorted(map(tuple, kept.collect()), key=str) == sorted(expected, key=str)
    assert quality_rules.keep_good(none, rules).count() == 0
    model = rule_ensemble.fit(odd, labels)
    scores = {r.score for r in rule_ensemble.scored(odd, model, [F.col("doc_id")]).collect()}
    assert scores == {0.5}


def test_ensemble_is_sparse_and_right():
    shares, label = table()
    model = rule_ensemble.fit_table(shares, label, float(label.mean()))
    holds = np.array([np.logical_and.reduce([c.holds(shares) for c in r]) for r in model.rules])
    p = 1 / (1 + np.exp(-(model.start + holds.T @ np.array(model.weights))))
    assert ((p >= 0.5) == (label == 1)).mean() > 0.95
    assert len(model.rules) < len(rule_ensemble.grow_trees(shares, label))


def test_held_out_labels(spark):
    sf = "/root/testdata/sf0.01"
    labels = {r.doc_id: r.quality for r in spark.read.parquet(f"{sf}/labels.parquet").collect()}
    held = [r for r in op9(spark, sf).collect() if r.held_out and labels.get(r.doc_id) is not None]
    right = sum(r.predicted == labels[r.doc_id] for r in held)
    assert right >= 0.95 * len(held) and all(0 <= r.score <= 1 for r in held)
