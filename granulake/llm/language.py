"""Language identification by a bidirectional gated recurrent network over bytes.

A text is read in windows of `WINDOW` bytes, each by two recurrent layers from both sides; every byte gets a
probability for every language, and the mean over all bytes of the text is the document's. The network is
trained in numpy by backpropagation through time on labelled windows.

It is fitted on about `rows` documents of each language, chosen by the hash of their id, with at most `longest`
characters each and `windows` windows of each document; languages are the values of `lang` among the training rows.
All bytes of all texts are read when predicting.

Defined results: a NULL text, or one without a letter, is `und` with score 0; without training rows every text is `und`;
equal texts get equal results; other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from granulake.llm.words import pieces, text_offsets

WINDOW = 96
LANES = 2048
UNKNOWN = "und"


def _sigmoid(x: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-x))


def _softmax(x: np.ndarray) -> np.ndarray:
    x = np.exp(x - x.max(axis=-1, keepdims=True))
    return x / x.sum(axis=-1, keepdims=True)


@dataclass
class Layer:
    """One direction: gate inputs by byte, and weights of the state (update, reset, candidate)."""

    gates: np.ndarray  # 256 x 2h
    fresh: np.ndarray  # 256 x h
    state_gates: np.ndarray  # h x 2h
    state_fresh: np.ndarray  # h x h

    def names(self):
        return ("gates", "fresh", "state_gates", "state_fresh")

    def run(
        self, windows: np.ndarray, inside: np.ndarray, order, keep: list | None = None
    ) -> Iterator[tuple[int, np.ndarray]]:
        """State after each byte, in the order given; bytes outside a text leave an empty state."""
        h = self.state_fresh.shape[0]
        state = np.zeros((windows.shape[1], h), np.float32)
        for t in order:
            gates = _sigmoid(np.take(self.gates, windows[t], axis=0) + state @ self.state_gates)
            update, reset = gates[:, :h], gates[:, h:]
            inner = state @ self.state_fresh
            fresh = 2 * _sigmoid(2 * (np.take(self.fresh, windows[t], axis=0) + reset * inner)) - 1
            after = fresh + update * (state - fresh)
            if not inside[t].all():
                after *= inside[t][:, None]
            if keep is not None:
                keep.append((t, state, update, reset, inner, fresh))
            state = after
            yield t, state

    def back(self, windows: np.ndarray, inside: np.ndarray, kept: list, pull: np.ndarray) -> dict[str, np.ndarray]:
        """Gradients of the weights; `pull` is the gradient of each state, by position."""
        h = self.state_fresh.shape[0]
        grads = {n: np.zeros_like(getattr(self, n)) for n in self.names()}
        carried = np.zeros((windows.shape[1], h), np.float32)
        for t, state, update, reset, inner, fresh in reversed(kept):
            d = (carried + pull[t]) * inside[t][:, None]
            d_fresh = d * (1 - update) * (1 - fresh**2)
            d_update = d * (state - fresh) * update * (1 - update)
            d_reset = d_fresh * inner * reset * (1 - reset)
            d_gates = np.concatenate([d_update, d_reset], axis=1)
            d_inner = d_fresh * reset
            np.add.at(grads["gates"], windows[t], d_gates)
            np.add.at(grads["fresh"], windows[t], d_fresh)
            grads["state_gates"] += state.T @ d_gates
            grads["state_fresh"] += state.T @ d_inner
            carried = d * update + d_gates @ self.state_gates.T + d_inner @ self.state_fresh.T
        return grads


@dataclass
class Network:
    languages: list[str]
    layers: tuple[Layer, Layer]
    heads: tuple[np.ndarray, np.ndarray]
    start: np.ndarray

    def _logits(self, windows, inside, kept=None, states=None) -> np.ndarray:
        steps = range(len(windows))
        out = np.empty((len(windows), windows.shape[1], len(self.languages)), np.float32)
        for side, order in enumerate((steps, reversed(steps))):
            for t, state in self.layers[side].run(windows, inside, order, None if kept is None else kept[side]):
                if states is not None:
                    states[side][t] = state
                if side == 0:
                    out[t] = state @ self.heads[0] + self.start
                else:
                    out[t] += state @ self.heads[1]
        return out

    def probabilities(self, column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """Mean probabilities of each text's bytes, and the number of bytes."""
        data, offsets = text_offsets(column)
        sizes = np.diff(offsets)
        total = np.zeros((len(sizes), len(self.languages)))
        lanes = -(-sizes // WINDOW)
        text = np.repeat(np.arange(len(sizes)), lanes)
        begin = offsets[:-1][text] + (np.arange(len(text)) - np.repeat(np.cumsum(lanes) - lanes, lanes)) * WINDOW
        for at in range(0, len(text), LANES):
            own = text[at : at + LANES]
            windows, inside = _cut(data, begin[at : at + LANES], offsets[1:][own])
            sums = (_softmax(self._logits(windows, inside)) * inside[:, :, None]).sum(axis=0)
            for k in range(len(self.languages)):
                total[:, k] += np.bincount(own, sums[:, k], len(sizes))
        return total / np.maximum(sizes, 1)[:, None], sizes

    def train(self, windows, inside, label, rng, steps, batch, rate=0.02) -> None:
        """Adam on the mean cross-entropy of all bytes."""
        weights = [(layer, n) for layer in self.layers for n in layer.names()]
        arrays = [getattr(layer, n) for layer, n in weights] + [*self.heads, self.start]
        first, second = ([np.zeros_like(a) for a in arrays] for _ in "ab")
        for step in range(1, steps + 1):
            rows = rng.choice(windows.shape[1], min(batch, windows.shape[1]), replace=False)
            w, inn = windows[:, rows], inside[:, rows]
            kept = ([], [])
            states = [np.zeros((len(w), len(rows), self.layers[0].state_fresh.shape[0]), np.float32) for _ in "ab"]
            d = _softmax(self._logits(w, inn, kept, states))
            d[:, np.arange(len(rows)), label[rows]] -= 1
            d *= inn[:, :, None] / max(1, inn.sum())
            grads = []
            for side in (0, 1):
                got = self.layers[side].back(w, inn, kept[side], d @ self.heads[side].T)
                grads += [got[n] for n in self.layers[side].names()]
            grads += [np.einsum("tnh,tnc->hc", states[side], d) for side in (0, 1)] + [d.sum(axis=(0, 1))]
            now = rate * (1 - step / (steps + 1))
            for a, g, m, v in zip(arrays, grads, first, second):
                m += 0.1 * (g - m)
                v += 0.01 * (g * g - v)
                a -= (now * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.99**step)) + 1e-6)).astype(np.float32)


def _cut(data: np.ndarray, begin: np.ndarray, end: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Bytes of windows by position, and whether they are inside the text."""
    at = begin[None, :] + np.arange(WINDOW)[:, None]
    inside = at < end[None, :]
    return np.where(inside, data[np.minimum(at, len(data) - 1)], 0), inside


def new_network(languages: list[str], hidden: int, rng) -> Network:
    def some(*shape):
        return (rng.standard_normal(shape) * 0.3).astype(np.float32)

    layers = tuple(
        Layer(some(256, 2 * hidden), some(256, hidden), some(hidden, 2 * hidden), some(hidden, hidden)) for _ in "ab"
    )
    heads = tuple(some(hidden, len(languages)) for _ in "ab")
    return Network(languages, layers, heads, np.zeros(len(languages), np.float32))


def fit(
    docs: DataFrame,
    where: Column | None = None,
    *,
    rows: int = 300,
    longest: int = 20_000,
    windows: int = 12,
    hidden: int = 8,
    steps: int = 160,
    batch: int = 384,
) -> Network | None:
    """Network from the rows with a language, among those `where` (a condition on doc_id)."""
    known = docs.where("lang is not null and text is not null").where(F.length("text") <= longest)
    known = (known if where is None else known.where(where)).select("doc_id", "lang", "text")
    counts = {r[0]: r[1] for r in known.groupBy("lang").count().collect()}
    if not counts:
        return None
    # one row a language: the share of its documents to take
    shares = [(k, min(1.0, rows / n)) for k, n in sorted(counts.items())]
    shares = docs.sparkSession.createDataFrame(shares, "lang string, share double")
    chance = F.pmod(F.xxhash64("doc_id"), F.lit(1_000_000)) < F.col("share") * 1_000_000
    chosen = known.join(F.broadcast(shares), "lang").where(chance).select("doc_id", "lang", "text")
    got = chosen.orderBy("doc_id", "lang", "text").toArrow()
    rng = np.random.default_rng(20)
    languages = sorted(counts)
    data, offsets = text_offsets(got["text"].combine_chunks() if got.num_rows else pa.array([], pa.string()))
    sizes = np.diff(offsets)
    text = np.repeat(np.arange(len(sizes)), np.minimum(windows, -(-sizes // WINDOW)))
    if not len(text):
        return None
    begin = offsets[:-1][text] + (rng.random(len(text)) * np.maximum(1, sizes[text] - WINDOW // 2)).astype(np.int64)
    cut, inside = _cut(data, begin, offsets[1:][text])
    numbers = {k: i for i, k in enumerate(languages)}
    label = np.array([numbers[k] for k in got["lang"].to_pylist()], int)[text]
    network = new_network(languages, hidden, rng)
    network.train(cut, inside, label, rng, steps, batch)
    return network


def _predict(batches, network: Network | None) -> Iterator[pa.RecordBatch]:
    import regex

    letter = regex.compile(r"\p{L}").search
    for batch in pieces(batches, "text"):
        texts = batch.column("text")
        found = np.array([t is not None and letter(t) is not None for t in texts.to_pylist()], bool)
        names, score = [UNKNOWN] * len(texts), np.zeros(len(texts))
        if network is not None:
            p, _ = network.probabilities(texts)
            best = p.argmax(axis=1)
            score = np.where(found, np.minimum(p[np.arange(len(p)), best], 1.0), 0.0)
            names = [network.languages[k] if f else UNKNOWN for k, f in zip(best, found)]
        columns = [batch.column("kept"), pa.array(names), pa.array(score)]
        yield pa.RecordBatch.from_arrays(columns, names=["kept", "lang_pred", "score"])


def predict(
    docs: DataFrame, network: Network | None, *, text: str = "text", keep: tuple[str, ...] = ("doc_id",)
) -> DataFrame:
    """`kept` (a struct of the columns `keep`), `lang_pred` and `score` of every text."""
    shared = docs.sparkSession.sparkContext.broadcast(network)
    rows = docs.select(F.struct(*[F.col(f"`{c}`") for c in keep]).alias("kept"), F.col(f"`{text}`").alias("text"))
    schema = rows.select("kept", F.lit("").alias("lang_pred"), F.lit(0.0).alias("score")).schema
    return rows.mapInArrow(lambda b: _predict(b, shared.value), schema)
