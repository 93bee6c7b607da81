"""The licence scan: statements, near misses, and the column expression against the classifier."""

import pytest
from pyspark.sql import functions as F

import plain
from granulake.llm import licenses


@pytest.fixture(scope="module")
def scanner():
    return licenses.learn([plain.prose(i, 20) for i in range(200)] + ["We use the file you may want, it is not free of terms."])


def found(spark, scanner, texts):
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    rows = licenses.scan(docs, scanner, [F.col("doc_id")]).orderBy("doc_id").collect()
    return [[(f.line, f.family) for f in r.found if f.family != licenses.UNKNOWN] for r in rows], rows


def test_every_statement_names_its_family(spark, scanner):
    pairs = [(s, f) for f in licenses.TEMPLATES for s in licenses.TEMPLATES[f]]
    texts = [f"{plain.prose(i, 30)}\n\n{s.upper() if i % 2 else s}\n{plain.prose(i + 50, 9)}" for i, (s, _) in enumerate(pairs)]
    got, rows = found(spark, scanner, texts)
    assert got == [[(2, f)] for _, f in pairs]
    assert all(r.n_paragraphs == 3 for r in rows)


def test_near_misses_are_unknown(spark, scanner):
    texts = ["My driving license has expired.", "The MIT campus is large.", "Apache helicopters, version 2.0", "CC me on the mail", "Permission to land", "GNU is an animal"]
    assert found(spark, scanner, texts)[0] == [[] for _ in texts]


def test_expression_follows_the_classifier(spark, scanner):
    texts = [s for f in licenses.TEMPLATES for s in licenses.TEMPLATES[f]]
    names = [*scanner.families, licenses.UNKNOWN]
    got, _ = found(spark, scanner, texts)
    assert [g[0][1] for g in got] == [names[int(scanner.logits(t).argmax())] for t in texts]


def test_odd_rows(spark, odd, none, scanner):
    rows = licenses.scan(odd, scanner, [F.col("doc_id")]).collect()
    assert len(rows) == odd.count()
    assert {r.n_paragraphs for r in rows if r.doc_id in (1, 2, 3)} == {0}
    assert {r.n_paragraphs for r in rows if r.doc_id == 16} == {9}
    assert all(f.family == licenses.UNKNOWN for r in rows for f in r.found)
    assert licenses.scan(none, scanner, [F.col("doc_id")]).count() == 0
    assert licenses.fit(none).families == sorted(licenses.TEMPLATES)


def test_scan_has_no_python(spark, docs, scanner):
    plan = licenses.scan(docs, scanner, [F.col("doc_id")])._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Arrow" not in plan and "Exchange" not in plan


def test_wrapped_statements_are_whole(spark, scanner):
    import textwrap

    pairs = [(s, f) for f in licenses.TEMPLATES for s in licenses.TEMPLATES[f] if len(s) > 100]
    texts = [f"{plain.prose(i, 9)}\n\n" + "\n".join(f" * {x}" for x in textwrap.wrap(s, 40)) + "\n\nend" for i, (s, _) in enumerate(pairs)]
    got, _ = found(spark, scanner, texts)
    assert len(pairs) >= 4 and got == [[(2, f)] for _, f in pairs]


def test_marking_words_lose_no_statement():
    # the words of the statements are frequent in the corpus
    often = [s for f in licenses.TEMPLATES for s in licenses.TEMPLATES[f]]
    often = [" ".join(reversed(licenses.words_of(s))) for s in often] * 20
    marks = set(licenses.learn(often).marks)
    for f in licenses.TEMPLATES:
        for s in licenses.TEMPLATES[f]:
            pairs = licenses.pairs_of(licenses.words_of(s))
            assert len([p for p in pairs if not marks & set(p.split())]) < licenses.SHARE * len(pairs)


def test_a_line_below_a_blank_one_hides_no_wrapped_statement(spark, scanner):
    grant = licenses.TEMPLATES["MIT"][1].replace(" a copy ", "\na copy ")
    text = f"{grant}\n\n{licenses.TEMPLATES['MIT'][0]}"
    assert found(spark, scanner, [text])[0] == [[(0, "MIT"), (3, "MIT")]]
