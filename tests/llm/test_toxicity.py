"""Kneser-Ney models: proper distributions, held-out labels, odd rows."""

import re

import numpy as np
import pyarrow as pa
import pytest
from pyarrow.fs import SubTreeFileSystem

import plain
from granulake.llm import toxicity
from granulake.llm.q_toxicity import op10

BAD = ("vile", "vileness", "rotten")


def corpus(spark, n=400):
    rows = []
    for i in range(n):
        words = plain.prose(50 + i, 60 + i % 200).split()
        if i % 4 == 0:
            words[5::20] = [BAD[(i + k) % 3] for k in range(len(words[5::20]))]
        rows.append((i, " ".join(words), int(i % 4 == 0)))
    return spark.createDataFrame(rows, "doc_id long, text string, toxic int")


def test_toxic_texts_are_found_and_clean_ones_left(spark):
    docs = corpus(spark)
    model = toxicity.fit(docs.select("doc_id", "text"), docs.select("doc_id", "toxic").where("doc_id % 3 <> 0"))
    got = {r.doc_id: r.score for r in toxicity.scored(docs, model).collect()}
    held = [i for i in got if i % 3 == 0]
    assert all((got[i] >= 0.7) == (i % 4 == 0) for i in held)
    kept = toxicity.drop_toxic(docs, model)
    assert kept.columns == docs.columns and {r.doc_id for r in kept.collect()} == {i for i, s in got.items() if s < 0.7}


def test_one_stretch_in_a_long_text_counts(spark):
    docs = corpus(spark)
    model = toxicity.fit(docs.select("doc_id", "text"), docs.select("doc_id", "toxic"))
    long = plain.prose(7, 4000)
    texts = pa.array([long, long + " vile rotten vile and rotten " + long])
    clean, toxic = model.score(texts)
    assert clean < 0.7 <= toxic


def counts_of(spark, texts, least=2):
    """Counts of texts by class, toxic first."""
    rows = [(t, label, i % 2) for label, part in zip((1, 0), texts) for i, t in enumerate(part.to_pylist())]
    return toxicity.gather(spark.createDataFrame(rows, "text string, label int, half int").repartition(3), least)


def test_known_words_leave_mass_for_unknown_ones(spark):
    texts = [pa.array([plain.prose(i, 300) for i in range(s, s + 20)]) for s in (0, 100)]
    models = toxicity.Models(counts_of(spark, texts)[2], 2)
    known = models.forms[0].rows[:-1]
    assert (known > 0).all() and (known.sum(axis=0) < 1).all()


def test_odd_rows(spark, odd, none):
    docs = corpus(spark, 80)
    model = toxicity.fit(docs.select("doc_id", "text"), docs.select("doc_id", "toxic"))
    got = toxicity.scored(odd, model).collect()
    assert len(got) == odd.count() and all(0 <= r.score <= 1 for r in got)
    assert {round(r.score, 9) for r in got if r.doc_id in (1, 2, 3)} == {round(model.share, 9)}
    assert toxicity.scored(none, model).count() == 0
    unlabelled = toxicity.fit(odd, spark.createDataFrame([(None, 1), (4, None)], "doc_id long, toxic int"))
    assert {r.score for r in toxicity.scored(odd, unlabelled).collect()} == {0.0} or unlabelled.share == 1.0


def test_query(spark):
    from plain import SF

    got = op10(spark, SF)
    assert got.columns == ["doc_id", "held_out", "score", "predicted"]
    rows = got.collect()
    assert len(rows) == 200 and all((r.score >= 0.7) == bool(r.predicted) for r in rows)
    assert np.isfinite([r.score for r in rows]).all()


def test_counts_are_those_of_plain_loops(spark):
    texts = [pa.array([plain.prose(i % 13, 90) + bad for i in range(s, s + 20)]) for s, bad in ((0, " vile rotten" * 3), (7, ""))]
    texts[1] = pa.array([*texts[1].to_pylist(), None, "", "of the", "the"])
    for v, counts in enumerate(counts_of(spark, texts)):
        for k, part in enumerate(texts):
            contexts, before = {}, {}
            for i, text in enumerate(part.to_pylist()):
                words = re.findall("[a-z0-9]+", (text or "").lower())
                if v == 2 or i % 2 == v:
                    seen = set()
                    for j, w in enumerate(words):
                        pair = (words[j - 1] if j else None, w)
                        if pair in seen:  # a text's pair counts once, with its first context
                            continue
                        seen.add(pair)
                        contexts.setdefault(pair, set()).add(words[j - 2] if j > 1 else 0 if j else None)
                        before.setdefault(w, set()).add(pair[0])
            sizes = {}
            for (first, _), some in contexts.items():
                sizes[first] = sizes.get(first, 0) + len(some)
            strong = sorted((len(s), sizes[p[0]]) for p, s in contexts.items() if len(s) >= 2)
            assert sorted(zip(counts.pairs[k][2].tolist(), counts.pairs[k][3].tolist())) == strong
            assert counts.rare[k] == tuple(sum(len(s) == n for s in contexts.values()) for n in (1, 2))
            assert sorted(n for n in counts.types[k].tolist() if n) == sorted(map(len, before.values()))


def test_long_toxic_texts_are_learned_and_repeated_ids_count_once(spark):
    rows = [(i, plain.prose(i, 3000) + (" vile rotten" * 40 if i % 2 else ""), i % 2) for i in range(24)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, toxic int")
    repeated = docs.union(docs.where("doc_id = 1")).union(docs.where("doc_id = 1"))
    labels = docs.select("doc_id", "toxic")
    once, again = (toxicity.fit(d.select("doc_id", "text"), labels) for d in (docs, repeated))
    assert once.models is not None and np.allclose(once.weights, again.weights)
    clean, toxic = once.score(pa.array([plain.prose(99, 60), plain.prose(98, 50) + " vile rotten vile rotten vile rotten"]))
    assert clean < toxic


def test_every_word_of_a_text_counts_as_often_as_it_is_there(spark):
    texts = [pa.array([plain.prose(i, 300) + bad for i in range(s, s + 20)]) for s, bad in ((0, " vile rotten" * 9), (100, ""))]
    models = toxicity.Models(counts_of(spark, texts)[2], 2)
    text = plain.prose(140, 200)
    once, often = (text + " vile rotten" * n for n in (1, 500))
    scores, size = models.evidence(pa.array([once, often]), 12)
    assert list(size) == [202, 1200]
    assert scores[1, 0] > scores[0, 0] + 0.5 * (scores[1, 1] - scores[0, 0])  # most of its words are toxic
    # the sums and stretches of a plain loop, word by word
    tokens = often.split()
    alone, _ = models.evidence(pa.array([" ".join(tokens[: i + 1]) for i in range(220)]), 12)
    sums = np.concatenate([[0.0], alone[:, 0] * np.arange(1, 221)])
    runs = (sums[12:] - sums[:-12]) / 12
    assert abs(alone[-1, 1] - runs.max()) < 1e-6


def test_every_labelled_document_is_learned(spark):
    # 9000 ordinary and 1800 toxic texts; a word of four toxic ones with ids anywhere among them is known
    rows = [(i, f"{plain.prose(i % 50, 6)} {'vile rotten' if i % 6 == 0 else 'fine'} mark{i}", int(i % 6 == 0)) for i in range(10_800)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, toxic int")
    model = toxicity.fit(docs.select("doc_id", "text"), docs.select("doc_id", "toxic"))
    found = toxicity.find_words(*toxicity.text_offsets(pa.array([" ".join(f"mark{i}" for i in range(10_800))])), toxicity.MASK_ALNUM)
    assert np.isin(found.hashes, model.models.forms[0].keys).all()


def test_models_on_spark_are_those_in_memory(spark, odd):
    docs = corpus(spark, 120)
    texts, labels = docs.select("doc_id", "text"), docs.select("doc_id", "toxic").where("doc_id % 3 <> 0")
    small, large = (toxicity.fit(texts, labels, most=most) for most in (1 << 20, 0))
    assert small.models is not None and large.models is None and large.rows is not None
    assert np.allclose(small.weights, large.weights, rtol=1e-4)
    for some in (texts, odd.select("doc_id", "text"), texts.union(texts)):
        one, two = (sorted((r.doc_id or -1, round(r.score, 4)) for r in toxicity.scored(some, m).collect()) for m in (small, large))
        assert len(one) == some.count() and np.allclose(one, two, atol=2e-4)
    kept = toxicity.drop_toxic(docs, large)
    assert kept.columns == docs.columns and kept.count() == toxicity.drop_toxic(docs, small).count()


def test_large_models_leave_texts_where_they_are(spark):
    docs = corpus(spark, 120)
    texts, labels = docs.select("doc_id", "text"), docs.select("doc_id", "toxic").where("doc_id % 3 <> 0")
    model = toxicity.fit(texts, labels, most=0)
    # before: written and shuffled with the keys that they ask for
    assert "Exchange" not in toxicity.scored(texts, model)._jdf.queryExecution().executedPlan().toString()


@pytest.mark.parametrize("store", [False, True])
def test_models_in_files_are_those_in_memory(spark, monkeypatch, store):
    parts = [pa.array([plain.prose(i, 300) + bad for i in range(s, s + 20)]) for s, bad in ((0, " vile rotten" * 3), (100, ""))]
    rows = [(t, label, i % 2) for label, part in zip((1, 0), parts) for i, t in enumerate(part.to_pylist())]
    table, unseen = toxicity.model_table(spark.createDataFrame(rows, "text string, label int, half int"), 2)
    files = toxicity.file_models(table, unseen, 5 << 20)
    assert len(files) == 3 and len(files[0].names) == 5
    if store:  # one whose files cannot be mapped
        system = toxicity.file_system
        monkeypatch.setattr(toxicity, "file_system", lambda name: (SubTreeFileSystem("/", system(name)[0]), system(name)[1].lstrip("/")))
    held, keys = table.toArrow(), np.random.default_rng(1).integers(0, 1 << 63, 999, np.uint64) * np.uint64(2)
    for v in range(3):
        here, there = toxicity.Models.of_rows(held, v, unseen[v]), files[v].models()
        assert (here.unseen == there.unseen).all()
        for a, b in zip((*here.forms, here.pairs, here.contexts), (*there.forms, there.pairs, there.contexts)):
            asked = np.concatenate([a.keys, keys, a.keys[:50]])
            assert len(a.keys) and np.array_equal(a(asked), b(asked), equal_nan=True)


def test_the_table_of_the_models_is_what_counts_in_memory_give(spark):
    parts = [pa.array([plain.prose(i, 300) + bad for i in range(s, s + 20)]) for s, bad in ((0, " vile rotten" * 3), (100, ""))]
    rows = [(t, label, i % 2) for label, part in zip((1, 0), parts) for i, t in enumerate(part.to_pylist())]
    sample = spark.createDataFrame(rows, "text string, label int, half int")
    table, unseen = toxicity.model_table(sample, 2)
    table = table.toArrow()
    for v, counts in enumerate(toxicity.gather(sample, 2)):
        here, there = toxicity.Models(counts, 2), toxicity.Models.of_rows(table, v, unseen[v])
        assert np.allclose(here.unseen, there.unseen)
        for a, b in zip((*here.forms, here.pairs, here.contexts), (*there.forms, there.pairs, there.contexts)):
            assert (a.keys == b.keys).all() and np.allclose(a.rows, b.rows, rtol=1e-4, equal_nan=True)


def test_expressions_are_sent_packed_and_come_back_whole():
    # half of the words have a number in the book, the others (and the marks of a beginning) are found again by their hash
    texts = [" ".join(f"{w}{i % 7}" if j % 9 == 0 else w for j, w in enumerate(plain.prose(i, 900).split())) for i in range(60)] + ["", None, "one"]
    batch = pa.RecordBatch.from_pydict({"label": [i % 2 for i in range(63)], "half": [i // 2 % 2 for i in range(63)], "text": texts})
    words = sorted({w for t in texts for w in re.findall("[a-z0-9]+", (t or "").lower())})
    spans = toxicity.find_words(*toxicity.text_offsets(pa.array([" ".join(words)])), toxicity.MASK_ALNUM)
    heads = toxicity.first_bytes(spans.data, spans.starts, spans.ends, 7)
    fixed = np.array([0, toxicity._BEGIN], np.uint64)
    book = toxicity.Codebook(np.append(fixed, spans.hashes[::2]), np.append(np.zeros(2, np.uint64), heads[::2]))

    class Shared:
        value = book

    sent = list(toxicity._expressions([batch], Shared, 2))
    rows = pa.Table.from_batches(sent)
    before, word, ahead, head, mark = toxicity._unpacked(rows, book)
    names = {None: int(toxicity._BEGIN), 0: 0, **dict(zip(words, spans.hashes.tolist()))}
    expected = {}
    for i, text in enumerate(texts):
        tokens, seen = re.findall("[a-z0-9]+", (text or "").lower()), set()
        for j, w in enumerate(tokens):
            pair = (tokens[j - 1] if j else None, w)
            if pair not in seen:
                seen.add(pair)
                key = (names[pair[0]], names[w], names[(tokens[j - 2] if j > 1 else None) if j else 0])
                expected[key] = expected.get(key, 0) | 1 << (2 * (i % 2) + i // 2 % 2)
    assert dict(zip(zip(before.tolist(), word.tolist(), ahead.tolist()), mark.tolist())) == expected and len(word) == len(expected)
    assert dict(zip(word.tolist(), head.tolist())) == dict(zip(spans.hashes.tolist(), heads.tolist()))
    # three hashes and a mark are 25 bytes; words in random order, as here, pack worst
    assert rows.nbytes < 15 * len(word)


def test_only_unknown_words_need_their_stems(monkeypatch):
    text = pa.array([plain.prose(3, 500) + " strangeness"])
    found = toxicity.find_words(*toxicity.text_offsets(text), toxicity.MASK_ALNUM)
    known = np.unique(found.hashes[:-1])
    models = toxicity.Models.__new__(toxicity.Models)
    none = np.zeros(0, np.uint64), np.zeros((0, 2))
    models.forms = [toxicity.Lookup(known, np.full((len(known), 2), 0.01), [np.nan] * 2), *[toxicity.Lookup(*none, [np.nan] * 2)] * 3]
    models.pairs, models.contexts = toxicity.Lookup(*none, [0, 0]), toxicity.Lookup(*none, [1, 1])
    models.unseen = np.array([0.004, 0.002])
    spans, hashed = toxicity.hash_spans, []
    monkeypatch.setattr(toxicity, "hash_spans", lambda data, starts, ends: hashed.append(len(starts)) or spans(data, starts, ends))
    scores, size = models.evidence(text, 12)
    assert size[0] == len(found.hashes) and np.allclose(scores, [[np.log(2) / size[0], np.log(2) / 12]], rtol=1e-5)
    assert sum(hashed) <= 3  # before: three for every word


def test_whole_texts_go_to_python_in_batches_of_bounded_size(spark):
    name = "spark.sql.execution.arrow.maxBytesPerBatch"
    spark.conf.unset(name)
    docs = corpus(spark, 80)
    toxicity.fit(docs.select("doc_id", "text"), docs.select("doc_id", "toxic"))
    long = spark.range(0, 1500, 1, 1).selectExpr("id as doc_id", "repeat('vile words ', 2000) as text")

    def sizes(batches):
        for batch in batches:
            yield pa.RecordBatch.from_pydict({"n": [batch.nbytes]})

    got = [r.n for r in long.mapInArrow(sizes, "n long").collect()]
    assert sum(got) > 30 << 20 and max(got) < 10 << 20  # before: one of 33 MB
    spark.conf.set(name, "12345678")
    toxicity.fit(docs.select("doc_id", "text"), docs.select("doc_id", "toxic"))
    assert spark.conf.get(name) == "12345678"
    spark.conf.unset(name)
