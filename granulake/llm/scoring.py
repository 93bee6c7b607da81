"""Language-model scores by masked pseudo-likelihood.

Every word is predicted from the `SIDE` words on each side of it, with the word itself left out, by a window network; the
sum of the conditional log-probabilities scores the document. The output is factored: the network gives
a probability to each of `CLASSES` frequency classes, and inside a class a word has its share of the
corpus count. Words are counted over the whole corpus by their full 64-bit hash; the table of counts and classes stays on
Spark, whatever its size, and meets the texts in a join: each block of texts asks for the words it holds.

The network is trained on every word of every text (`train_on_spark`). The texts are dealt over `ROUNDS` rounds and, inside a
round, over shards of about `SHARD` words; tasks train on the shards from the same weights, and the mean of what they reach
begins the next round. Every word of every text is counted, learned and scored.

Defined results: a NULL, empty or wordless text has 0 words, a sum of 0 and 0 a word; a word at an edge sees
padding; a word that the fitted corpus does not hold counts as half a word of the last class; equal texts get equal
scores; other columns are ignored.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StructField, StructType

from granulake.llm.words import MASK_SPACE, find_words, pieces, text_offsets
from granulake.session import cut

ROUNDS = 8
SHARD = 1 << 18  # words
BITS = 18  # of the table in memory that `train` takes
CLASSES = 256
SIDE = 3
BLOCK = 512  # words whose class scores are held at once, so that they stay in the cache
_OFFSETS = [k for k in range(-SIDE, SIDE + 1) if k]


def _hashes(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Full hash of every word, and the first word of each text."""
    words = find_words(*text_offsets(column), MASK_SPACE)
    return words.hashes.view(np.int64), words.first


def _buckets(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Row of every word in a table of 2^BITS rows, and the first word of each text."""
    hashes, first = _hashes(column)
    return (hashes.view(np.uint64) >> np.uint64(64 - BITS)).astype(np.int64), first


def _count(batches, most: int = 1 << 20) -> Iterator[pa.RecordBatch]:
    """Partial counts; a task holds at most about `most` words before it hands them on."""
    names, counts = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]

    def merged() -> tuple[np.ndarray, np.ndarray]:
        every, row = np.unique(np.concatenate(names), return_inverse=True)
        return every, np.bincount(row, np.concatenate(counts), len(every)).astype(np.int64)

    for batch in pieces(batches, "text"):
        got = np.unique(_hashes(batch.column("text"))[0], return_counts=True)
        names.append(got[0])
        counts.append(got[1])
        if sum(map(len, names)) > most:
            every, total = merged()
            if len(every) > most // 2:
                yield pa.RecordBatch.from_arrays([pa.array(every), pa.array(total)], names=["bucket", "n"])
                every, total = every[:0], total[:0]
            names, counts = [every], [total]
    every, total = merged()
    yield pa.RecordBatch.from_arrays([pa.array(every), pa.array(total)], names=["bucket", "n"])


def count_words(docs: DataFrame, text: str = "text") -> DataFrame:
    """Words of all texts: a row for each different word, `bucket` being its full 64-bit hash."""
    rows = docs.select(F.col(f"`{text}`").alias("text"))
    return rows.mapInArrow(_count, "bucket bigint, n bigint").groupBy("bucket").agg(F.sum("n").alias("n"))


def classed_words(counted: DataFrame) -> DataFrame:
    """The counted words with their class: classes of about equal total count, frequent words first. Words of the same
    count are dealt over the classes of their stretch by their hash. What the driver sees is one row for
    each different count, which grows with the square root of the corpus at most."""
    steps = counted.groupBy("n").agg(F.count("*").alias("words")).orderBy(F.desc("n")).toArrow()
    n = steps["n"].to_numpy()
    mass = n * steps["words"].to_numpy()
    before = (np.cumsum(mass) - mass).astype(float)
    whole = float(max(1, mass.sum()))
    table = pa.table({"n": n, "before": before / whole, "mass": mass / whole})
    steps = counted.sparkSession.createDataFrame(table)
    place = F.pmod(F.xxhash64("bucket"), F.lit(1 << 30)) / float(1 << 30)
    kind = F.least(F.floor((F.col("before") + place * F.col("mass")) * CLASSES), F.lit(CLASSES - 1)).cast("int")
    return counted.join(F.broadcast(steps), "n").select("bucket", "n", kind.alias("kind"))


@dataclass
class Network:
    """Weights that give each word's class a probability from the classes around it."""

    inner: np.ndarray  # offset x (class or padding) x hidden
    start: np.ndarray
    outer: np.ndarray  # hidden x class
    outer_start: np.ndarray

    def _hidden(self, context: list[np.ndarray]) -> np.ndarray:
        total = self.inner[0].take(context[0], axis=0)
        total += self.start
        for k in range(1, len(_OFFSETS)):
            total += self.inner[k].take(context[k], axis=0)
        return np.tanh(total, out=total)

    def _logits(self, hidden: np.ndarray) -> np.ndarray:
        logits = hidden @ self.outer
        logits += self.outer_start
        return logits

    def _bias(self) -> np.ndarray | None:
        """The bias of the classes if their exponentials can be weighted by its own, which spares a pass over all scores; None if
        float32 could not hold that: a hidden unit is at most 1, so the weights bound every logit."""
        most, start = np.abs(self.outer).sum(axis=0), self.outer_start
        top, low = (most + start).max(), (start - most).max()  # the largest logit is between them
        small = most.max() < 80 and top < 70 and top - start.min() < 80 and low > -70
        return start if small else None

    def _blocks(self, hidden: np.ndarray, bias: np.ndarray | None) -> Iterator[tuple[int, np.ndarray]]:
        """Where every `BLOCK` words begin, and their logits without the bias, or with it and shifted by their maximum."""
        for at in range(0, len(hidden), BLOCK):
            logits = hidden[at : at + BLOCK] @ self.outer
            if bias is None:
                logits += self.outer_start
                logits -= logits.max(axis=1, keepdims=True)
            yield at, logits

    def class_scores(self, kinds: np.ndarray, first: np.ndarray) -> np.ndarray:
        """Conditional log-probability of every word's class."""
        around, place = _padded(kinds, first)
        out, bias = np.empty(len(kinds)), self._bias()
        added = np.zeros(CLASSES, np.float32) if bias is None else bias
        weight = np.exp(added)
        for begin in range(0, len(kinds), 2048):
            own = place[begin : begin + 2048]
            target = around[own]
            for at, logits in self._blocks(self._hidden([around[own + k] for k in _OFFSETS]), bias):
                kind = target[at : at + BLOCK]
                chosen = logits[np.arange(len(kind)), kind] + added[kind]
                out[begin + at : begin + at + len(kind)] = chosen - np.log(np.exp(logits, out=logits) @ weight)
        return out


@dataclass
class Model(Network):
    """A network with a table in memory: class of each row, and log share of a row in its class."""

    kinds: np.ndarray
    shares: np.ndarray

    def word_scores(self, buckets: np.ndarray, first: np.ndarray) -> np.ndarray:
        """Conditional log-probability of every word."""
        return self.class_scores(self.kinds[buckets], first) + self.shares[buckets]


@dataclass
class Fitted:
    """A network with a table on Spark: `words` (bucket, n, kind) and the total count of each class."""

    network: Network
    words: DataFrame
    totals: np.ndarray


def context_of(kinds: np.ndarray, first: np.ndarray) -> np.ndarray:
    """Classes around every word of the same text, padding beyond its edges."""
    text = np.repeat(np.arange(len(first) - 1), np.diff(first))
    place = np.arange(len(kinds))
    out = np.full((len(kinds), len(_OFFSETS)), CLASSES)
    for i, k in enumerate(_OFFSETS):
        at = place + k
        inside = (at >= first[:-1][text]) & (at < first[1:][text])
        out[inside, i] = kinds[at[inside]]
    return out


def frequency_classes(counts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Classes of about equal total count, frequent buckets first, and the log share of each bucket; a bucket without
    a count gets half a word."""
    counts = np.where(counts > 0, counts, 0.5)
    order = np.argsort(-counts, kind="stable")
    before = np.cumsum(counts[order]) - counts[order]
    kinds = np.empty(len(counts), np.int64)
    kinds[order] = np.minimum(before / counts.sum() * CLASSES, CLASSES - 1).astype(np.int64)
    total = np.bincount(kinds, counts, CLASSES)
    return kinds, np.log(counts / total[kinds])


def train(counts: np.ndarray, texts: pa.Array, **options) -> Model:
    """Network fitted to texts, with a table in memory of the counts of 2^BITS rows."""
    kinds, shares = frequency_classes(counts)
    buckets, first = _buckets(texts)
    network = train_network(kinds[buckets], first, np.bincount(kinds, np.maximum(counts, 0.5), CLASSES), **options)
    return Model(network.inner, network.start, network.outer, network.outer_start, kinds, shares)


def train_network(
    target: np.ndarray,
    first: np.ndarray,
    totals: np.ndarray,
    *,
    hidden: int = 32,
    steps: int = 1200,
    batch: int = 512,
    rate: float = 0.01,
) -> Network:
    """Network fitted to the classes of the words of texts by Adam; `totals` are the counts of the classes."""
    rng = np.random.default_rng(11)
    model = Network(
        (rng.standard_normal((len(_OFFSETS), CLASSES + 1, hidden)) * 0.1).astype(np.float32),
        np.zeros(hidden, np.float32),
        (rng.standard_normal((hidden, CLASSES)) * 0.1).astype(np.float32),
        np.log(totals / max(1, totals.sum()) + 1e-9).astype(np.float32),
    )
    if not len(target):
        return model
    context = context_of(target, first)
    arrays = [model.inner, model.start, model.outer, model.outer_start]
    moments = [(np.zeros_like(a), np.zeros_like(a)) for a in arrays]
    for step in range(1, steps + 1):
        rows = rng.integers(0, len(target), batch)
        c, y = context[rows], target[rows]
        h = model._hidden(list(c.T))
        p = model._logits(h)
        p = np.exp(p - p.max(axis=1, keepdims=True))
        p /= p.sum(axis=1, keepdims=True)
        p[np.arange(batch), y] -= 1
        p /= batch
        d = (p @ model.outer.T) * (1 - h * h)
        inner = np.zeros_like(model.inner)
        for k in range(len(_OFFSETS)):
            np.add.at(inner[k], c[:, k], d)
        now = rate * (1 - step / (steps + 1))
        for a, g, (m, v) in zip(arrays, (inner, d.sum(axis=0), h.T @ p, p.sum(axis=0)), moments):
            m += 0.1 * (g - m)
            v += 0.01 * (g * g - v)
            a -= (now * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.99**step)) + 1e-8)).astype(np.float32)
    return model


def _padded(kinds: np.ndarray, first: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The classes with padding around every text, and the place of every word among them."""
    place = np.arange(len(kinds)) + SIDE * (1 + np.repeat(np.arange(len(first) - 1), np.diff(first)))
    out = np.full(len(kinds) + SIDE * len(first), CLASSES, np.int16)
    out[place] = kinds
    return out, place


def _gradient(model: Network, context: list[np.ndarray], target: np.ndarray) -> tuple[np.ndarray, ...]:
    """Mean gradient of the words' negative log-probability, for each array of the network."""
    n, bias = len(target), model._bias()
    weight = np.ones(CLASSES, np.float32) if bias is None else np.exp(bias)
    back = (model.outer * weight).T
    h = model._hidden(context)
    d = 1 - h * h
    outer, outer_start = np.zeros((CLASSES, h.shape[1]), np.float32), np.zeros(CLASSES, np.float32)
    for at, p in model._blocks(h, bias):
        kind = target[at : at + BLOCK]
        np.exp(p, out=p)
        total = p @ weight
        p[np.arange(len(kind)), kind] -= total / weight[kind]
        # weights and totals go to the narrow sides, not to the scores of all classes
        part = 1 / (n * total)
        outer += p.T @ (h[at : at + BLOCK] * part[:, None])
        outer_start += part @ p
        d[at : at + BLOCK] *= (p @ back) * part[:, None]
    inner = np.zeros_like(model.inner)
    # sums of neighbouring units are made together, as the parts of a complex number
    both = d.view(np.complex64) if d.shape[1] % 2 == 0 else d
    for k, kinds in enumerate(context):
        order = np.argsort(kinds, kind="stable")
        ranked = kinds[order]
        begin = np.append(0, np.flatnonzero(ranked[1:] != ranked[:-1]) + 1)
        inner[k][ranked[begin]] = np.add.reduceat(both.take(order, axis=0), begin, axis=0).view(np.float32)
    return inner, np.ones(n, np.float32) @ d, np.ascontiguousarray(outer.T) * weight, outer_start * weight


def _train_shard(model: Network, kinds: np.ndarray, first: np.ndarray, seed: int, turn: int, steps: int, batch: int, rate: float) -> None:
    """Adam over all words of a shard in random order: one pass, or on a small shard so many that there are about `steps` steps."""
    rng = np.random.default_rng([11, turn, seed & 0xFFFFFFFF])
    around, place = _padded(kinds, first)
    arrays = [model.inner, model.start, model.outer, model.outer_start]
    moments = [(np.zeros_like(a), np.zeros_like(a)) for a in arrays]
    a_pass = -(-len(place) // batch)
    passes = max(1, round(steps / a_pass))
    step = 0
    for _ in range(passes):
        mixed = rng.permutation(place)
        for at in range(0, len(mixed), batch):
            step += 1
            own = mixed[at : at + batch]
            grads = _gradient(model, [around[own + k] for k in _OFFSETS], around[own])
            now = rate * (1 - (turn + step / (passes * a_pass + 1)) / ROUNDS)
            for a, g, (m, v) in zip(arrays, grads, moments):
                g *= np.float32(0.1)
                m *= np.float32(0.9)
                m += g
                v *= np.float32(0.99)
                v += np.multiply(g, g, out=g)  # a hundredth of the square
                np.sqrt(np.multiply(v, np.float32(1 / (1 - 0.99**step)), out=g), out=g)
                g += np.float32(1e-8)
                np.divide(m, g, out=g)
                g *= np.float32(now / (1 - 0.9**step))
                a -= g


def _packed(model: Network) -> bytes:
    return b"".join(np.asarray(a, "<f4").tobytes() for a in (model.inner, model.start, model.outer, model.outer_start))


def _unpacked(data: bytes) -> Network:
    whole = np.frombuffer(data, "<f4").astype(np.float32)
    width = len(_OFFSETS) * (CLASSES + 1) + 1 + CLASSES  # numbers for each hidden unit
    hidden = (len(whole) - CLASSES) // width
    shapes = [(len(_OFFSETS), CLASSES + 1, hidden), (hidden,), (hidden, CLASSES), (CLASSES,)]
    ends = np.cumsum([np.prod(x) for x in shapes])
    return Network(*[part.reshape(x) for part, x in zip(np.split(whole, ends[:-1]), shapes)])


def _mean(rows: pa.Table) -> pa.Table:
    """The mean of weights, each as often as it has words, in a fixed order."""
    rows = rows.sort_by([("shard", "ascending")])
    n = rows["n"].to_numpy()
    total = sum(k * np.frombuffer(w.as_py(), "<f4").astype(float) for k, w in zip(n, rows["weights"]))
    packed = (total / n.sum()).astype("<f4").tobytes()
    return pa.table({"shard": rows["shard"][:1], "n": pa.array([n.sum()], pa.int64()), "weights": pa.array([packed], pa.binary())})


def _trainer(start, turn: int, steps: int, batch: int, rate: float):
    """A function that gives the weights which a shard reaches from the broadcast ones, and its number of words."""

    def trained(rows: pa.Table) -> pa.Table:
        rows = rows.sort_by([("mark", "ascending"), ("kinds", "ascending")])
        model = _unpacked(start.value)
        kinds, first = _kinds(rows["kinds"])
        shard = rows["shard"][0].as_py()
        _train_shard(model, kinds, first, shard, turn, steps, batch, rate)
        columns = [pa.array([shard], pa.int32()), pa.array([len(kinds)], pa.int64()), pa.array([_packed(model)], pa.binary())]
        return pa.Table.from_arrays(columns, names=["shard", "n", "weights"])

    return trained


def train_on_spark(texts: DataFrame, totals: np.ndarray, *, steps: int = 150, batch: int = 2048, rate: float = 0.015) -> Network:
    """Network fitted to all words of `texts` (`kept`, `kinds`): a shard takes every word of its texts once, or in as many
    passes as make about `steps` steps. A shard is one row of weights; they are averaged by tasks first, so the driver sees
    the square root of their number.

    Texts are dealt by the hash of all their columns and sorted in their shard: the result does not depend on how the rows lie.
    """
    spark = texts.sparkSession
    model = train_network(np.zeros(0, np.int64), np.zeros(1, np.int64), totals)
    every = texts.where(F.length("kinds") > 0)
    words = every.agg(F.sum(F.length("kinds"))).first()[0] or 0
    shards = max(1, int(words // (ROUNDS * SHARD)))
    every = every.select(F.xxhash64("kept", "kinds").alias("mark"), "kinds")
    every = every.withColumn("shard", F.pmod(F.xxhash64("mark"), F.lit(shards)).cast("int"))
    parts = int(np.ceil(np.sqrt(shards)))
    schema = "shard int, n bigint, weights binary"
    for turn in range(ROUNDS if words else 0):
        start = spark.sparkContext.broadcast(_packed(model))
        own = every.where(F.pmod("mark", F.lit(ROUNDS)) == turn)
        got = own.groupBy("shard").applyInArrow(_trainer(start, turn, steps, batch, rate), schema)
        got = got.groupBy(F.pmod("shard", F.lit(parts)).alias("part")).applyInArrow(_mean, schema).toArrow()
        if got.num_rows:
            model = _unpacked(_mean(got)["weights"][0].as_py())
        start.destroy()
    return model


def _blocks(batches, size: int) -> Iterator[pa.RecordBatch]:
    """Blocks of texts: a row with the different words of the block, and a row for each text with the places of its
    words among them."""
    for batch in pieces(batches, "text", size):
        hashes, first = _hashes(batch.column("text"))
        words, at = np.unique(hashes, return_inverse=True)
        at = at.astype("<i4")
        # named by its rows in their order: a repeated task names it alike, and a repeated block is the same
        name = hashlib.sha256(words.tobytes() + at.tobytes() + first.tobytes()).digest()[:8]
        name = int.from_bytes(name, "little", signed=True)
        places = pa.array([at[a:b].tobytes() for a, b in zip(first, first[1:])], pa.binary())
        kept, rows = batch.column("kept"), batch.num_rows
        names = ["block", "kept", "places", "words"]
        yield pa.RecordBatch.from_arrays(
            [pa.array([name] * rows, pa.int64()), kept, places, pa.nulls(rows, pa.list_(pa.int64()))], names=names
        )
        words = pa.ListArray.from_arrays(pa.array([0, len(words)], pa.int32()), pa.array(words))
        yield pa.RecordBatch.from_arrays(
            [pa.array([name], pa.int64()), pa.nulls(1, kept.type), pa.nulls(1, pa.binary()), words], names=names
        )


def _classed(texts: pa.Table, words: pa.Table, totals: np.ndarray) -> pa.Table:
    """Per text of a block the class of each word, and the sum of the words' log shares of their classes."""
    bucket, once = np.unique(words["bucket"].to_numpy(), return_index=True)
    kinds = words["kind"].to_numpy()[once].astype(np.uint8)
    shares = np.log(words["n"].to_numpy()[once] / totals[kinds])
    at = [np.frombuffer(x.as_py(), "<i4") for x in texts["places"]]
    return pa.table(
        {
            "kept": texts["kept"],
            "kinds": pa.array([kinds[x].tobytes() for x in at], pa.binary()),
            "shares": pa.array([float(shares[x].sum()) for x in at], pa.float64()),
        }
    )


def classed(
    docs: DataFrame,
    words: DataFrame,
    totals: np.ndarray,
    *,
    text: str = "text",
    keep: tuple[str, ...] = ("doc_id",),
    size: int = 8 << 20,
) -> DataFrame:
    """`kept`, the classes of the words of each text, one byte a word, and the sum of their log shares."""
    rows = docs.select(F.struct(*[F.col(f"`{c}`") for c in keep]).alias("kept"), F.col(f"`{text}`").alias("text"))
    kept = rows.select("kept").schema
    added = StructType.fromDDL("places binary, words array<bigint>")
    sent = StructType([*StructType.fromDDL("block bigint"), StructField("kept", kept[0].dataType), *added])
    blocks = cut(rows.mapInArrow(lambda b: _blocks(b, size), sent), "blocks")
    asked = blocks.where("words is not null").select("block", F.explode("words").alias("bucket"))
    half = [F.coalesce("n", F.lit(0.5)).alias("n"), F.coalesce("kind", F.lit(CLASSES - 1)).alias("kind")]
    given = asked.join(words, "bucket", "left").select(F.col("block").alias("at"), "bucket", *half)
    texts = blocks.where("words is null").select("block", "kept", "places")
    schema = StructType([*kept, *StructType.fromDDL("kinds binary, shares double")])
    both = texts.groupBy("block").cogroup(given.groupBy("at"))
    return both.applyInArrow(lambda a, b: _classed(a, b, totals), schema)


def _kinds(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Classes of all words one after another, and the first word of each text."""
    texts = [np.frombuffer(x.as_py(), np.uint8) for x in column]
    first = np.concatenate([[0], np.cumsum([len(x) for x in texts])]).astype(np.int64)
    return np.concatenate([np.zeros(0, np.uint8), *texts]).astype(np.int64), first


def _counted(docs: DataFrame, text: str) -> tuple[DataFrame, np.ndarray]:
    """The words of all documents with their classes, and the total count of each class."""
    words = cut(classed_words(cut(count_words(docs, text), "counts")), "words")
    totals = np.zeros(CLASSES)
    for r in words.groupBy("kind").agg(F.sum("n").alias("n")).collect():
        totals[r["kind"]] = r["n"]
    totals[CLASSES - 1] += 0.5  # for the words that are not in the table
    return words, totals


def fit(docs: DataFrame, *, rows: int | None = None) -> Fitted:
    """Counts over all documents and a network from all of them; only on request from the `rows` with the smallest hash of the id."""
    words, totals = _counted(docs, "text")
    some = docs
    if rows is not None:
        some = docs.where("text is not null and doc_id is not null")
        hashed = some.select("doc_id", F.xxhash64("doc_id").alias("h")).distinct()
        chosen = hashed.orderBy("h", "doc_id").limit(rows).select("doc_id")
        some = some.select("doc_id", "text").join(F.broadcast(chosen), "doc_id")
    return Fitted(train_on_spark(cut(classed(some, words, totals), "classes"), totals), words, totals)


def _score(batches, shared) -> Iterator[pa.RecordBatch]:
    network = shared.value
    for big in batches:
        ends = np.cumsum(pc.binary_length(big.column("kinds")).to_numpy())
        at = 0
        while at < big.num_rows:  # slices of about 2^17 words, a longer text alone
            upto = max(at + 1, int(np.searchsorted(ends, (ends[at - 1] if at else 0) + (1 << 17), "right")))
            batch, at = big.slice(at, upto - at), upto
            kinds, first = _kinds(batch.column("kinds"))
            n = np.diff(first)
            text = np.repeat(np.arange(len(n)), n)
            total = np.bincount(text, network.class_scores(kinds, first), len(n)) + batch.column("shares").to_numpy()
            columns = [batch.column("kept"), pa.array(n), pa.array(total), pa.array(total / np.maximum(n, 1))]
            yield pa.RecordBatch.from_arrays(columns, names=["kept", "n_words", "log_likelihood", "per_word"])


def _scored(rows: DataFrame, network: Network) -> DataFrame:
    shared = rows.sparkSession.sparkContext.broadcast(network)
    added = StructType.fromDDL("n_words bigint, log_likelihood double, per_word double")
    schema = StructType([*rows.select("kept").schema, *added])
    return rows.mapInArrow(lambda b: _score(b, shared), schema)


def score(docs: DataFrame, model: Fitted, *, text: str = "text", keep: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """`kept` (a struct of the columns `keep`), number of words, summed log-probability, and that a word."""
    return _scored(classed(docs, model.words, model.totals, text=text, keep=keep), model.network)


def fit_score(docs: DataFrame, *, text: str = "text", keep: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """What `score` gives for the documents that the model is fitted on; their classes are found once."""
    words, totals = _counted(docs, text)
    texts = cut(classed(docs, words, totals, text=text, keep=keep), "classes")
    return _scored(texts, train_on_spark(texts, totals))
