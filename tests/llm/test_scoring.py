"""Masked pseudo-likelihood against a plain computation."""

import tracemalloc

import numpy as np
import pyarrow as pa

import plain
from granulake.llm import scoring


def model(texts):
    counts = np.bincount(scoring._buckets(pa.array(texts))[0], minlength=1 << scoring.BITS).astype(float)
    return scoring.train(counts, pa.array(texts), steps=60), counts


def test_scores_are_sums_of_conditional_probabilities():
    texts = [plain.prose(i % 5, 80) for i in range(30)]
    net, counts = model(texts)
    buckets, first = scoring._buckets(pa.array([texts[3]]))
    got = net.word_scores(buckets, first)
    kinds = net.kinds[buckets]
    filled = np.where(counts > 0, counts, 0.5)
    for t in (0, 1, 40, len(kinds) - 1):
        total = net.start.astype(float).copy()
        for i, k in enumerate(scoring._OFFSETS):
            total += net.inner[i][kinds[t + k] if 0 <= t + k < len(kinds) else scoring.CLASSES]
        z = np.tanh(total) @ net.outer + net.outer_start
        p = np.exp(z - z.max())
        p /= p.sum()
        share = filled[buckets[t]] / filled[net.kinds == kinds[t]].sum()
        assert abs(got[t] - np.log(p[kinds[t]] * share)) < 1e-3


def test_a_word_does_not_see_itself():
    net, _ = model([plain.prose(i, 50) for i in range(9)])
    a, first = scoring._buckets(pa.array(["one two three four five"]))
    context = scoring.context_of(net.kinds[a], first)
    b, _ = scoring._buckets(pa.array(["one two other four five"]))
    assert (context[2] == scoring.context_of(net.kinds[b], first)[2]).all()


def test_training_helps_and_repetition_is_likely():
    texts = [plain.prose(i % 4, 120) for i in range(40)]
    counts = np.bincount(scoring._buckets(pa.array(texts))[0], minlength=1 << scoring.BITS).astype(float)
    words = scoring._buckets(pa.array(texts[:4]))
    few, many = (scoring.train(counts, pa.array(texts), steps=n).word_scores(*words).mean() for n in (1, 400))
    assert many > few + 0.5


def test_counts_cover_all_documents(spark, docs, texts):
    got = {r.bucket: r.n for r in scoring.count_words(docs).collect()}
    assert sum(got.values()) == sum(len(plain.SPACE_WORDS.findall(t)) for _, t in texts)


def test_odd_rows(spark, odd, none):
    fitted = scoring.fit(odd, rows=5)
    rows = scoring.score(odd, fitted).collect()
    assert len(rows) == odd.count() and all(np.isfinite(r.log_likelihood) and r.log_likelihood <= 0 for r in rows)
    words = sorted((str(r.kept.doc_id), r.n_words) for r in rows)
    assert words == sorted((str(r[0]), len(plain.SPACE_WORDS.findall(r[1] or ""))) for r in plain.odd_rows())
    assert {r.per_word for r in rows if r.n_words == 0} == {0.0}
    assert scoring.score(none, scoring.fit(none)).count() == 0


def test_every_word_has_its_own_count(spark):
    # words that shared a row of 2^18 are counted apart: more words than rows, each as often as it is there
    rows = [(i, " ".join(f"w{i}x{k}" for k in range(9000))) for i in range(40)] + [(99, "often " * 500)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    got = sorted(r.n for r in scoring.count_words(docs).collect())
    assert got == [1] * 360_000 + [500]


def test_shares_of_a_class_are_those_of_its_words(spark, texts):
    counts = {}
    for _, t in texts:
        for w in plain.SPACE_WORDS.findall(plain.low(t)):
            counts[w] = counts.get(w, 0) + 1
    docs = spark.createDataFrame(texts, "doc_id long, text string")
    fitted = scoring.fit(docs, rows=3)
    table = {r.bucket: (r.n, r.kind) for r in fitted.words.collect()}
    assert len(table) == len(counts)
    got = {r.kept.doc_id: r for r in scoring.score(docs, fitted).collect()}
    for doc_id, text in texts[:20]:
        hashes, first = scoring._hashes(pa.array([text]))
        n, kinds = (np.array(x) for x in zip(*(table[h] for h in hashes))) if len(hashes) else (np.zeros(0), np.zeros(0, int))
        assert list(n) == [counts[w] for w in plain.SPACE_WORDS.findall(plain.low(text))]
        expected = (np.log(n / fitted.totals[kinds]) + fitted.network.class_scores(kinds, first)).sum()
        assert abs(got[doc_id].log_likelihood - expected) < 1e-3 * max(1, len(n)) ** 0.5


def test_the_network_learns_from_every_document(spark):
    # long texts, and more of them than a sample of 600 short ones would hold: words follow each other in them alone
    rows = [(i, plain.prose(i % 7, 20)) for i in range(700)] + [(1000 + i, "ping pong " * 2500) for i in range(4)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    model = scoring.fit(docs)
    got = {r.kept.doc_id: r for r in scoring.score(docs, model).collect()}
    both = {r.kept.doc_id: r for r in scoring.fit_score(docs).collect()}
    assert all(abs(both[i].per_word - r.per_word) < 1e-6 for i, r in got.items())
    assert len(got) == len(rows) and got[1001].n_words == 5000
    alone = np.log(10_000 / sum(r.n_words for r in got.values()))  # what the count of either word says
    assert got[1001].per_word > alone / 2


def test_how_rows_lie_does_not_change_the_network(spark, monkeypatch):
    monkeypatch.setattr(scoring, "SHARD", 200)
    rows = [(i, plain.prose(i, 40)) for i in range(90)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    a, b = (scoring.fit(d).network for d in (docs.repartition(5), docs.orderBy(docs.doc_id.desc()).coalesce(1)))
    assert np.allclose(a.inner, b.inner) and np.allclose(a.outer, b.outer)


def test_gradient_is_the_slope_of_the_loss():
    rng = np.random.default_rng(1)
    net = scoring.train_network(np.zeros(0, np.int64), np.zeros(1, np.int64), np.ones(scoring.CLASSES))
    first = np.array([0, 30, 30, 64])
    kinds = rng.integers(0, scoring.CLASSES, 64)
    around, place = scoring._padded(kinds, first)
    context = [around[place + k] for k in scoring._OFFSETS]
    assert (np.column_stack(context) == scoring.context_of(kinds, first)).all()
    grads = scoring._gradient(net, context, around[place])
    for array, grad in zip((net.inner, net.start, net.outer, net.outer_start), grads):
        way = rng.standard_normal(array.shape).astype(np.float32)
        at = array.copy()
        loss = []
        for step in (1e-2, -1e-2):
            array[...] = at + np.float32(step) * way
            loss.append(-net.class_scores(kinds, first).mean())
        array[...] = at
        assert abs((loss[0] - loss[1]) / 2e-2 - (grad * way).sum()) < 2e-2


def test_gradient_holds_when_float32_could_not_weight_the_exponentials():
    rng = np.random.default_rng(2)
    first = np.array([0, 700, 1400])
    kinds = rng.integers(0, scoring.CLASSES, 1400)
    around, place = scoring._padded(kinds, first)
    context = [around[place + k] for k in scoring._OFFSETS]
    for far in (1, 40):
        net = scoring.train_network(np.zeros(0, np.int64), np.zeros(1, np.int64), np.ones(scoring.CLASSES))
        net.outer *= np.float32(far)
        net.outer_start += rng.standard_normal(scoring.CLASSES).astype(np.float32)
        assert (net._bias() is None) == (far == 40)
        h = np.tanh(sum(net.inner[k][c].astype(float) for k, c in enumerate(context)) + net.start)
        z = h @ net.outer + net.outer_start
        p = np.exp(z - z.max(axis=1, keepdims=True))
        p /= p.sum(axis=1, keepdims=True)
        assert np.allclose(net.class_scores(kinds, first), np.log(p[np.arange(1400), kinds]), atol=1e-3)
        p[np.arange(1400), kinds] -= 1
        d = (p @ net.outer.T) * (1 - h * h) / 1400
        inner = np.zeros(net.inner.shape)
        for k, c in enumerate(context):
            np.add.at(inner[k], c, d)
        for got, wanted in zip(scoring._gradient(net, context, around[place]), (inner, d.sum(axis=0), h.T @ p / 1400, p.mean(axis=0))):
            assert np.allclose(got, wanted, atol=1e-5 * np.abs(wanted).max() + 1e-7)


def test_class_scores_of_a_step_are_made_block_by_block():
    rng = np.random.default_rng(3)
    net = scoring.train_network(np.zeros(0, np.int64), np.zeros(1, np.int64), np.ones(scoring.CLASSES))
    kinds = rng.integers(0, scoring.CLASSES, 2048)
    around, place = scoring._padded(kinds, np.array([0, 2048]))
    context = [around[place + k] for k in scoring._OFFSETS]
    for work in (lambda: scoring._gradient(net, context, around[place]), lambda: net.class_scores(kinds, np.array([0, 2048]))):
        work()
        tracemalloc.start()
        work()
        most = tracemalloc.get_traced_memory()[1]
        tracemalloc.stop()
        assert most < 2048 * scoring.CLASSES * 4  # before: the scores of all words at once, 2 MB, and more beside them
