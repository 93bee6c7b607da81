"""The recurrent network: gradients, held-out accuracy, odd rows."""

import numpy as np
import pyarrow as pa

import plain
from granulake.llm import language
from granulake.llm.q_language import op8


def test_gradients_are_those_of_the_loss():
    rng = np.random.default_rng(4)
    network = language.new_network(["a", "b"], 3, rng)
    for layer in network.layers:
        for name in layer.names():
            setattr(layer, name, getattr(layer, name).astype(np.float64))
    network.heads = tuple(h.astype(np.float64) for h in network.heads)
    windows, inside = rng.integers(0, 5, (7, 4)), np.ones((7, 4), bool)
    inside[5:, 1] = False
    label = np.array([0, 1, 1, 0])

    def loss():
        p = language._softmax(network._logits(windows, inside).astype(np.float64))
        return -(np.log(p[:, np.arange(4), label]) * inside).sum() / inside.sum()

    kept, states = ([], []), [np.zeros((7, 4, 3)) for _ in "ab"]
    d = language._softmax(network._logits(windows, inside, kept, states)).astype(np.float64)
    d[:, np.arange(4), label] -= 1
    d *= inside[:, :, None] / inside.sum()
    for side, layer in enumerate(network.layers):
        grads = layer.back(windows, inside, kept[side], d @ network.heads[side].T)
        for name in layer.names():
            weights = getattr(layer, name)
            at = (1, 2)
            before, step = weights[at], 1e-3
            weights[at] = before + step
            high = loss()
            weights[at] = before - step
            low = loss()
            weights[at] = before
            assert abs((high - low) / (2 * step) - grads[name][at]) < 2e-4


def test_every_byte_counts_once():
    network = language.new_network(["a", "b"], 4, np.random.default_rng(0))
    text = plain.prose(1, 700)
    p, sizes = network.probabilities(pa.array([text, None, "", "x"]))
    assert sizes.tolist() == [len(text), 0, 0, 1]
    assert np.allclose(p.sum(axis=1), [1, 0, 0, 1], atol=1e-4)
    assert np.allclose(network.probabilities(pa.array(["x"]))[0][0], p[3], atol=1e-5)


def test_held_out_documents(spark):
    sf = "/root/testdata/sf0.01"
    truth = {r.doc_id: r.lang for r in spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "lang").collect()}
    held = [r for r in op8(spark, sf).collect() if r.held_out]
    assert sum(r.lang_pred == truth[r.doc_id] for r in held) >= 0.97 * len(held)


def test_odd_rows(spark, odd, none):
    network = language.fit(odd, steps=3)
    assert network.languages == ["en"]
    got = language.predict(odd, network).select("kept.doc_id", "lang_pred", "score").collect()
    assert len(got) == odd.count() and all(0 <= r.score <= 1 for r in got)
    assert {(r.lang_pred, r.score) for r in got if r.doc_id in (1, 2, 3, 15)} == {("und", 0.0)}
    assert {r.lang_pred for r in got if r.doc_id in (4, 7, 11, 14)} == {"en"}
    assert language.predict(none, network).count() == 0
    assert language.fit(none) is None
    assert {r.lang_pred for r in language.predict(odd, None).collect()} == {"und"}
