"""Toxicity by class-conditional Kneser-Ney word models.

Two interpolated Kneser-Ney bigram models, one of toxic and one of ordinary labelled texts: a pair backs off to the
number of different words before the word in the class, that to the number of different words with the word's stem
(its first 7 bytes), to that of longer stems with its shorter stems, and those to the counts which both classes
share. What a class has seen rarely or never is left to those shared counts, so it says little about the class. Discounts come from the counts of counts.

A text is judged by the difference of both log-likelihoods per word, over the whole text and over its most
toxic stretch of `stretch` words, so that a long text is not excused by its length. A logistic calibration, fitted
on scores from models that did not see the scored half, turns both into a probability.

The models are fitted on every labelled document, whole texts of any length. Spark counts their words and pairs
(`count_tables`) and makes the models a table of them (`model_table`). Its rows are counted: up to `most` rows the models are
broadcast, a larger one is written to the shared folder, sorted by ranges of keys (`file_models`), and tasks map these files
instead of holding them; texts stay where they are either way. Every word of every text is scored, as often as it is there; only the models count a pair of a text once. Of rows with the
same id every text is learned, each expression once; the calibration takes one of them.

Defined results: a NULL, empty or wordless text gets the share of toxic rows among the labelled; without labels of both
classes every text gets that share (0 without any labels); equal rows get equal scores; other columns are kept out.
"""

from __future__ import annotations

import math
import mmap
import shutil
import tempfile
import uuid
from collections.abc import Iterator
from dataclasses import dataclass, replace
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, LongType, StructField, StructType

from granulake.llm.fitting import logistic, sigmoid
from granulake.llm.words import MASK_ALNUM, Words, find_words, first_bytes, hash_spans, kept_and_text, mix, pieces, text_offsets
from granulake.llm.workers import give_back, hold, let_go
from granulake.session import bound_batches, cut, scratch, shuffle_partitions
from granulake.sources.footers import file_system

STEMS = (7, 5, 4)  # bytes
_BEGIN = np.uint64(0x5BD1E9955BD1E995)


def _read(column: pa.Array) -> tuple[Words, np.ndarray, np.ndarray]:
    """The words of the texts, for each the one before it (a mark at the beginning of a text), and the first word of each
    text that has one."""
    found = find_words(*text_offsets(column), MASK_ALNUM)
    begins = found.first[:-1][np.diff(found.first) > 0]
    before = np.empty_like(found.hashes)
    before[1:] = found.hashes[:-1]
    before[begins] = _BEGIN
    return found, before, begins


def _joined(before: np.ndarray, words: np.ndarray) -> np.ndarray:
    """Hash of a word and the one before it."""
    with np.errstate(over="ignore"):
        return mix(before * np.uint64(0x9E3779B97F4A7C15) ^ words)


def _kept(counts: np.ndarray, least: int) -> np.ndarray:
    """Counts that stay with the class after the discount."""
    return np.where(counts < least, 0, counts - _discount((counts == 1).sum(), (counts == 2).sum()))


def _discount(once: int, twice: int) -> float:
    """Kneser-Ney's discount from the numbers of expressions seen once and twice."""
    return float(np.clip(once / max(1, once + 2 * twice), 0.1, 0.95))


class Lookup:
    """Rows of numbers by 64-bit key, with a default row for the other keys."""

    def __init__(self, keys: np.ndarray, rows: np.ndarray, default):
        order = np.argsort(keys)
        self.keys = keys[order]
        self.rows = np.vstack([rows[order], np.asarray(default)[None]]).astype(np.float32)
        self.some = np.zeros(1 << 20, bool)
        self.some[(keys >> np.uint64(44)).astype(np.int64)] = True

    def __call__(self, keys: np.ndarray) -> np.ndarray:
        out = np.full(len(keys), len(self.keys))
        if len(self.keys):
            at = np.flatnonzero(self.some[(keys >> np.uint64(44)).astype(np.int64)])
            found = np.minimum(np.searchsorted(self.keys, keys[at]), len(self.keys) - 1)
            out[at] = np.where(self.keys[found] == keys[at], found, len(self.keys))
        return self.rows[out]


def _part_of(keys: np.ndarray, parts: int) -> np.ndarray:
    """Which of `parts` equal ranges of 64-bit numbers a key is in."""
    return ((keys >> np.uint64(32)) * np.uint64(parts) >> np.uint64(32)).astype(np.int64)


class MappedLookup:
    """`Lookup` over the keys of each range of `_part_of`, sorted, with a column for either class."""

    def __init__(self, parts: list[tuple[np.ndarray, ...]], default):
        self.parts = parts
        self.default = np.asarray(default, np.float32)

    def __call__(self, keys: np.ndarray) -> np.ndarray:
        # words repeat; in order, what is searched lies close together
        own, back = np.unique(keys, return_inverse=True)
        out = np.tile(self.default, (len(own), 1))
        edges = np.searchsorted(_part_of(own, len(self.parts)), np.arange(len(self.parts) + 1))
        for (known, *columns), low, high in zip(self.parts, edges, edges[1:]):
            if len(known) and high > low:
                at = np.minimum(np.searchsorted(known, own[low:high]), len(known) - 1)
                hit = np.flatnonzero(known[at] == own[low:high])
                for i, column in enumerate(columns):
                    out[low + hit, i] = column[at[hit]]
        return out[back]


@dataclass
class Counts:
    """What both models are made of, toxic first: pairs in at least `least` contexts (before, word, contexts, contexts of
    all pairs with that word before), how many pairs have one and two contexts, and every word with its stems and, for
    each class, the number of words before it."""

    pairs: list[tuple[np.ndarray, ...]]
    rare: list[tuple[int, int]]
    words: np.ndarray
    stems: list[np.ndarray]
    types: list[np.ndarray]


_STEMS = [f"stem{i}" for i in range(len(STEMS))]
#: Counts of half 0, of half 1 and of both, toxic first in each.
_VIEWS = [(f"a{v}", f"b{v}") for v in range(3)]
_COLUMNS = [c for view in _VIEWS for c in view]
_BLOCK = 4 << 20  # bytes of text that are packed together
_COUNTED = pa.schema([("kind", pa.string()), *[(c, pa.int64()) for c in ("before", "word", "head", *_COLUMNS)]])


@dataclass
class Codebook:
    """Short numbers of frequent words, by their rank: no word, the mark of a beginning, then the words. Any other
    word is sent by its hash, so the choice of words only changes how much is sent."""

    names: np.ndarray
    heads: np.ndarray

    def __post_init__(self):
        self.order = np.argsort(self.names)
        self.ranked = self.names[self.order]

    def __call__(self, words: np.ndarray) -> np.ndarray:
        """The numbers of the words, -1 for those without one."""
        at = np.minimum(np.searchsorted(self.ranked, words), len(self.ranked) - 1)
        return np.where(self.ranked[at] == words, self.order[at], -1)


def _frequent(batches) -> Iterator[pa.RecordBatch]:
    """The words that a block of texts has four times or more, and as word 0 the number of all its words."""
    let_go()
    for piece in pieces(batches, "text", _BLOCK):
        found = find_words(*text_offsets(piece["text"]), MASK_ALNUM)
        words, at, n = np.unique(found.hashes, return_index=True, return_counts=True)
        often = n >= 4
        heads = first_bytes(found.data, found.starts[at[often]], found.ends[at[often]], STEMS[0])
        columns = [np.append(np.uint64(0), x).view(np.int64) for x in (words[often], heads)]
        yield pa.RecordBatch.from_arrays([pa.array(x) for x in (*columns, np.append(n.sum(), n[often]))], names=["word", "head", "n"])
    give_back()


def codebook(sample: DataFrame, most: int = 1 << 17) -> tuple[Codebook, int]:
    """Numbers for at most `most` frequent words, and how many words all texts have."""
    found = sample.select("text").mapInArrow(_frequent, "word bigint, head bigint, n bigint")
    found = found.groupBy("word").agg(F.min("head").alias("head"), F.sum("n").alias("n"))
    found = found.orderBy(F.desc("n"), "word").limit(most + 1).toArrow()
    words, heads = (found[c].to_numpy().astype(np.int64).view(np.uint64) for c in ("word", "head"))
    some = words != 0
    fixed = np.array([0, _BEGIN], np.uint64)
    return Codebook(np.append(fixed, words[some]), np.append(np.zeros(2, np.uint64), heads[some])), int(found["n"].to_numpy()[~some].sum())


def _runs(*keys: np.ndarray) -> np.ndarray:
    """Where each run of equal keys begins."""
    new = np.zeros(len(keys[0]), bool)
    new[:1] = True
    for key in keys:
        new[1:] |= key[1:] != key[:-1]
    return np.flatnonzero(new)


def _expressions(batches, shared, side: int) -> Iterator[pa.RecordBatch]:
    """The different expressions (a word, the one before it and the one before that) of blocks of texts, packed by
    part: the word before chooses one of `side` rows of a grid, the word one of its columns, so that the sums of a word come from
    `side` parts only. `codes` are the numbers of the three words and a mark, byte by byte; `words` and `heads` name
    words without a number. The mark has bit 2 * label + half."""
    let_go()
    book, side = shared.value, np.uint64(side)
    known = len(book.names)
    for piece in pieces(batches, "text", _BLOCK):
        found, before, begins = _read(piece["text"])
        word = found.hashes
        ahead = np.empty_like(before)
        ahead[1:] = before[:-1]
        ahead[begins] = 0
        text = np.repeat(np.arange(piece.num_rows), np.diff(found.first))
        pair = _joined(before, word)
        # a text's pair counts once, with its first context
        at = np.unique(_joined(text.astype(np.uint64), pair), return_index=True)[1]
        mark = (1 << (2 * piece["label"].to_numpy() + piece["half"].to_numpy())).astype(np.uint8)[text[at]]
        three = _joined(ahead[at], pair[at])
        order = np.argsort(three)
        first = _runs(three[order])
        mark = np.bitwise_or.reduceat(mark[order], first) if len(first) else mark
        at = at[order][first]
        # numbers of the block's words: those of the book, then others
        own, there = np.unique(word, return_index=True)
        heads = first_bytes(found.data, found.starts[there], found.ends[there], STEMS[0])
        number = book(own)
        new = number < 0
        number[new] = known + np.arange(new.sum())
        own, heads, names = own[new], heads[new], own
        code = lambda x: number[np.minimum(np.searchsorted(names, x), max(len(names) - 1, 0))]  # noqa: E731, B023
        codes = [np.where((x == 0) | (x == _BEGIN), (x == _BEGIN).astype(np.int64), code(x)) for x in (before[at], word[at], ahead[at])]
        part = (mix(before[at]) % side * side + mix(word[at]) % side).astype(np.int64)
        order = np.lexsort((*codes[::-1], part))
        edges = np.searchsorted(part[order], np.arange(int(side) ** 2 + 1))
        out = {c: [] for c in ("part", "n", "codes", "words", "heads")}
        for p in np.flatnonzero(np.diff(edges)):
            here = order[edges[p] : edges[p + 1]]
            sent = np.concatenate([x[here] for x in codes])
            others = np.unique(sent[sent >= known])
            sent = np.where(sent >= known, known + np.searchsorted(others, sent), sent).reshape(3, -1)
            sent[0, 1:] = np.diff(sent[0])
            # a block has less than 2^24 words
            planes = [*sent.astype("<u4")[:, :, None].view(np.uint8)[:, :, :3].transpose(0, 2, 1).reshape(9, -1), mark[here]]
            out["part"].append(p)
            out["n"].append(len(here))
            out["codes"].append([pa.compress(x.tobytes(), codec="zstd", asbytes=True) for x in planes])
            out["words"].append(own[others - known].tobytes())
            out["heads"].append(pa.compress(heads[others - known].tobytes(), codec="zstd", asbytes=True))
        types = (pa.int32(), pa.int32(), pa.list_(pa.binary()), pa.binary(), pa.binary())
        yield pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(out.values(), types)], names=list(out))
    give_back()


def _unpacked(rows: pa.Table, book: Codebook) -> tuple[np.ndarray, ...]:
    """Word before, word, the one before both, head of the word and mark of every expression that was sent."""
    out = []
    for row in rows.to_batches():
        for n, planes, words, heads in zip(*[row[c].to_pylist() for c in ("n", "codes", "words", "heads")]):
            planes = np.stack([np.frombuffer(pa.decompress(x, n, codec="zstd", asbytes=True), np.uint8) for x in planes])
            numbers = (planes[:9].reshape(3, 3, n).astype(np.int64) << np.array([0, 8, 16])[:, None]).sum(axis=1)
            numbers[0] = np.cumsum(np.append(numbers[0, :1], numbers[0, 1:]))
            names = np.append(book.names, np.frombuffer(words, np.uint64))
            heads = np.append(book.heads, np.frombuffer(pa.decompress(heads, len(words), codec="zstd", asbytes=True), np.uint64))
            out.append((*names[numbers], heads[numbers[1]], planes[9]))
    return tuple(np.concatenate(x) for x in zip(*out))


def _counted(rows: pa.Table, shared, least: int) -> pa.Table:
    """The rows of `count_tables` that one part of the grid gives."""
    let_go()
    before, word, ahead, head, mark = _unpacked(rows, shared.value)
    order = np.lexsort((ahead, word, before))
    before, word, ahead, head, mark = (x[order] for x in (before, word, ahead, head, mark))
    # contexts, then pairs
    at = _runs(before, word, ahead)
    mark = np.bitwise_or.reduceat(mark, at)
    before, word, head = before[at], word[at], head[at]
    bits = [bit << shift for bit in (1, 2, 3) for shift in (2, 0)]
    at = _runs(before, word)
    counts = np.add.reduceat(np.column_stack([mark & bit != 0 for bit in bits]).astype(np.int64), at)
    before, word, head = before[at], word[at], head[at]
    out = []

    def put(kind: str, counts: np.ndarray, **columns):
        arrays = [columns[c].view(np.int64) if c in columns else None for c in ("before", "word", "head")]
        arrays = [pa.nulls(len(counts), pa.int64()) if x is None else pa.array(x) for x in arrays]
        out.append(pa.Table.from_arrays([pa.array([kind] * len(counts), pa.string()), *arrays, *map(pa.array, counts.T.copy())], schema=_COUNTED))

    some = counts[:, -2:].max(axis=1) >= least
    put("pair", counts[some], before=before[some], word=word[some])
    at = _runs(before)
    put("size", np.add.reduceat(counts, at), before=before[at])
    order = np.argsort(word, kind="stable")
    at = _runs(word[order])
    put("types", np.add.reduceat((counts > 0)[order].astype(np.int64), at), word=word[order][at], head=head[order][at])
    put("rare", np.stack([(counts == n).sum(axis=0) for n in (1, 2)]), word=np.array([1, 2]))
    give_back()
    return pa.concat_tables(out)


def count_tables(sample: DataFrame, least: int) -> DataFrame:
    """Counts of the texts; `sample` has text, label and half.

    Rows of four kinds: 'pair' (before, word, contexts) for pairs in at least `least` contexts, 'size' (before, contexts of all
    pairs with that word before), 'types' (word, its first bytes, words before it), and 'rare' with 1 and 2 as `word`: how many
    pairs have so many contexts. The columns a0, b0 count half 0 of the toxic and the ordinary texts, a1, b1 half 1, a2, b2 both.
    A context of a pair counts once however often it is there.
    """
    spark = sample.sparkSession
    sample = sample.select("label", "half", "text")
    book, words = codebook(sample)
    shared = spark.sparkContext.broadcast(book)
    # every expression is sent once, packed, to the part of its pair; a part has about 2^20 of them at most
    side = math.isqrt(max(shuffle_partitions(spark), words >> 20) - 1) + 1
    sent = sample.mapInArrow(lambda b: _expressions(b, shared, side), "part int, n int, codes array<binary>, words binary, heads binary")
    schema = "kind string, " + ", ".join(f"{c} bigint" for c in _COUNTED.names[1:])
    counts = sent.groupBy("part").applyInArrow(lambda rows: _counted(rows, shared, least), schema)
    sums = [F.sum(c).alias(c) for c in _COLUMNS]
    out = cut(counts.groupBy("kind", "before", "word").agg(F.min("head").alias("head"), *sums), "counts")
    shared.destroy()
    return out


def _add_stems(batches) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        heads = batch["head"].to_numpy().astype("<u8")
        starts, sizes = np.arange(len(heads)) * 8, (heads >> np.uint64(56)).astype(np.int64)
        stems = [hash_spans(heads.view(np.uint8), starts, starts + np.minimum(sizes, n)) for n in STEMS]
        kept = [c for c in batch.schema.names if c != "head"]
        arrays = [*[batch[c] for c in kept], *[pa.array(x.view(np.int64)) for x in stems]]
        yield pa.RecordBatch.from_arrays(arrays, names=[*kept, *_STEMS])


def word_types(counts: DataFrame) -> DataFrame:
    """Every word with its counts and stems."""
    types = counts.where(F.col("kind") == "types").select("word", "head", *_COLUMNS)
    return types.mapInArrow(_add_stems, ", ".join(f"{c} bigint" for c in ("word", *_COLUMNS, *_STEMS)))


def gather(sample: DataFrame, least: int) -> list[Counts]:
    """What `count_tables` counts of half 0, half 1 and both, in memory, for a sample that fits there."""
    counts = count_tables(sample, least)
    kind = lambda name: counts.where(F.col("kind") == name)
    sizes = kind("size").select("before", *[F.col(c).alias(f"{c}_size") for c in _COLUMNS])
    strong = kind("pair").join(sizes, "before").toArrow()
    types = word_types(counts).toArrow()
    rare = kind("rare").orderBy("word").toArrow()
    column = lambda table, name: table[name].to_numpy()
    key = lambda table, name: column(table, name).astype(np.int64).view(np.uint64)
    out = []
    for view in _VIEWS:
        own = []
        for c in view:
            at = np.flatnonzero(column(strong, c) >= least)
            own.append((key(strong, "before")[at], key(strong, "word")[at], column(strong, c)[at], column(strong, f"{c}_size")[at]))
        few = [tuple(column(rare, c).tolist()) for c in view]
        order = np.argsort(key(types, "word"))
        numbers = [column(types, c)[order] for c in view]
        some = (numbers[0] > 0) | (numbers[1] > 0)
        out.append(Counts(own, few, key(types, "word")[order][some], [key(types, x)[order][some] for x in _STEMS], [x[some] for x in numbers]))
    return out


def _pair_names(batches) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        keys = _joined(*(batch[c].to_numpy().view(np.uint64) for c in ("before", "word")))
        yield batch.append_column("key", pa.array(keys.view(np.int64)))


def model_table(sample: DataFrame, least: int) -> tuple[DataFrame, list[np.ndarray]]:
    """Both class models as rows: what `Models` computes of counts in memory, for half 0, half 1 and both.

    `kind` is 0 to 3 for words and their shorter and shorter stems, 4 for pairs, 5 for contexts; a0, b0 and so on are the numbers
    of the toxic and ordinary model, NULL where the half does not have the row. Beside it the mass of unknown words.
    """
    counts = count_tables(sample, least)
    kind = lambda name: counts.where(F.col("kind") == name)
    rare = {r["word"]: r for r in kind("rare").collect()}
    sizes = kind("size").select("before", *[F.col(c).alias(f"{c}_size") for c in _COLUMNS])
    pairs = kind("pair").join(sizes, "before")
    held = []
    for view in _VIEWS:
        for c in view:
            part = F.when(F.col(c) >= least, (F.col(c) - _discount(rare[1][c], rare[2][c])) / F.col(f"{c}_size")).otherwise(0.0)
            held.append(F.when(F.greatest(*view) >= least, part).alias(c))
    pairs = pairs.select("before", "word", *held)
    pairs = cut(pairs.mapInArrow(_pair_names, StructType([*pairs.schema, StructField("key", LongType())])).drop("word"), "pairs")
    contexts = pairs.groupBy(F.col("before").alias("key")).agg(*[(1 - F.sum(c)).alias(c) for c in _COLUMNS])
    rows = [x.select(F.lit(k).alias("kind"), "key", *_COLUMNS) for k, x in ((4, pairs), (5, cut(contexts, "contexts")))]
    # from words to the shortest stems: the number of longer forms, and the shared counts of them
    there = [(F.col(a) > 0) | (F.col(b) > 0) for a, b in _VIEWS]
    shared = [F.when(t, F.least(a, b) + 0.5) for t, (a, b) in zip(there, _VIEWS)]
    level = word_types(counts).withColumnRenamed("word", "key")
    levels, scalars = [], []
    for i in range(len(STEMS) + 1):
        levels.append(cut(level, f"forms{i}") if i else level)
        big = lambda c: F.when(F.col(c) >= least, F.col(c))
        wanted = {"sum": F.sum, "once": lambda c: F.count_if(F.col(c) == 1), "twice": lambda c: F.count_if(F.col(c) == 2)}
        wanted |= {"big": lambda c: F.coalesce(F.sum(big(c)), F.lit(0)), "bigs": lambda c: F.count(big(c))}
        sums = [f(c).alias(f"{c}_{name}") for c in _COLUMNS for name, f in wanted.items()]
        scalars.append(levels[-1].agg(*sums, *[F.coalesce(F.sum(x), F.lit(0.0)).alias(f"shared{v}") for v, x in enumerate(shared)]).first())
        if i < len(STEMS):
            up = levels[-1].groupBy(F.col(_STEMS[i]).alias("key"))
            below = [F.sum(x).alias(f"below{v}") for v, x in enumerate(shared)]
            level = up.agg(*[F.count_if(F.col(c) > 0).alias(c) for c in _COLUMNS], *below, *[F.min(x).alias(x) for x in _STEMS[i + 1 :]])
    number = lambda i, c, name: scalars[i][f"{c}_{name}"] or 0
    discount = lambda i, c: _discount(number(i, c, "once"), number(i, c, "twice"))
    spare = lambda i, c: 1 - (number(i, c, "big") - discount(i, c) * number(i, c, "bigs")) / max(1, number(i, c, "sum"))
    over = {c: np.cumprod([1.0, *(spare(i, c) for i in range(len(levels)))]) for c in _COLUMNS}
    above = None
    for i in reversed(range(len(levels))):
        level = levels[i]
        if above is not None:
            level = level.join(above, level[_STEMS[i]] == above["above_key"])
        own = []
        for v, view in enumerate(_VIEWS):
            for c in view:
                kept = F.when(F.col(c) >= least, (F.col(c) - discount(i, c)) / max(1, number(i, c, "sum"))).otherwise(0.0)
                rest = shared[v] / (scalars[i][f"shared{v}"] + 0.5) if above is None else F.col(f"above_{c}") * shared[v] / (F.col(f"above_below{v}") + 0.5)
                own.append(F.when(there[v], kept + spare(i, c) * rest).alias(c))
        below = [f"below{v}" for v in range(3) if i]
        done = level.select("key", *own, *below)
        if i:
            done = cut(done, f"level{i}")
            above = done.select(*[F.col(c).alias(f"above_{c}") for c in ("key", *_COLUMNS, *below)])
        done = done.select(F.lit(i).alias("kind"), "key", *[(F.col(c) * float(over[c][i])).cast("float").alias(c) for c in _COLUMNS])
        rows.append(done if i else cut(done, "level0"))
    # the tables as they are written; no copy of them all
    every = reduce(DataFrame.unionByName, [x.select("kind", "key", *[F.col(c).cast("float").alias(c) for c in _COLUMNS]) for x in rows])
    return every, [np.array([over[c][-1] for c in view]) for view in _VIEWS]


#: What a kind of `model_table` has for keys without a row.
_DEFAULTS = [*[[np.nan, np.nan]] * (len(STEMS) + 1), [0, 0], [1, 1]]


class Models:
    """Both class models: P(w | v) = held(v, w) + back(v) * word(w), each for toxic and ordinary.

    Every order counts different contexts: a pair the words before it, a word the words before it, so that neither
    repetition nor copies are evidence. Counts below `least` are left to the back-off.
    """

    def __init__(self, counts: Counts, least: int):
        words, types = counts.words, counts.types
        names = [_joined(before, word) for before, word, _, _ in counts.pairs]
        every = np.unique(np.concatenate(names))
        contexts = np.unique(np.concatenate([p[0] for p in counts.pairs]))
        held, back = [], []
        for (before, _, number, size), name, rare in zip(counts.pairs, names, counts.rare):
            kept = (number - _discount(*rare)) / size
            held.append(np.zeros(len(every)))
            held[-1][np.searchsorted(every, name)] = kept
            back.append(1 - np.bincount(np.searchsorted(contexts, before), kept, len(contexts)))
        # forms from whole words to the shortest stems, and for each form the next shorter one
        forms, names, shorter = [words, *counts.stems], [words], []
        for longer, stem in zip(forms, forms[1:]):
            at = np.unique(longer, return_index=True)[1]
            keys, up = np.unique(stem[at], return_inverse=True)
            names.append(keys)
            shorter.append(up)
        counts = [types]
        for up, keys in zip(shorter, names[1:]):
            counts.append([np.bincount(up, t > 0, len(keys)) for t in counts[-1]])
        # from the shortest stems up to words; half a count stands for forms that only one class has
        rows, spares, above = [], [], None
        for level in reversed(range(len(names))):
            shared = np.minimum(*counts[level]) + 0.5
            kept = np.column_stack([_kept(t, least) / max(1, t.sum()) for t in counts[level]])
            spares.insert(0, 1 - kept.sum(axis=0))
            if above is None:
                above = kept + spares[0] * (shared / (shared.sum() + 0.5))[:, None]
            else:
                up = shorter[level]
                part = shared / (np.bincount(up, shared, len(names[level + 1])) + 0.5)[up]
                above = kept + spares[0] * above[up] * part[:, None]
            rows.insert(0, above)
        # a form that is looked up because longer ones are unknown has their spare mass; what is alike in both
        # classes is left out, as only the ratio counts there
        over = np.ones(2)
        self.forms = []
        for keys, held_here, spare in zip(names, rows, spares):
            self.forms.append(Lookup(keys, held_here * over, [np.nan, np.nan]))
            over = over * spare
        self.unseen = over
        self.pairs = Lookup(every, np.column_stack(held), [0, 0])
        self.contexts = Lookup(contexts, np.column_stack(back), [1, 1])

    @classmethod
    def of_rows(cls, rows: pa.Table, view: int, unseen: np.ndarray) -> Models:
        """Models of one view from rows of `model_table`."""
        kind, key = rows["kind"].to_numpy(), rows["key"].to_numpy().astype(np.int64).view(np.uint64)
        values = np.column_stack([rows[c].to_numpy() for c in _VIEWS[view]])
        looks = []
        for k, default in enumerate(_DEFAULTS):
            at = np.flatnonzero((kind == k) & ~np.isnan(values[:, 0]))
            looks.append(Lookup(key[at], values[at], default))
        return cls.of_looks(looks, unseen)

    @classmethod
    def of_looks(cls, looks: list, unseen: np.ndarray) -> Models:
        out = cls.__new__(cls)
        *out.forms, out.pairs, out.contexts = looks
        out.unseen = unseen
        return out

    def evidence(self, column: pa.Array, stretch: int) -> tuple[np.ndarray, np.ndarray]:
        """Per text the log-likelihood difference a word, over the text and over its most toxic stretch of
        consecutive words; and the number of its words."""
        found, before, _ = _read(column)
        word, first = found.hashes, found.first
        alone = self.forms[0](word).astype(np.float64)
        for keys, n in zip(self.forms[1:], STEMS):  # only unknown words need their stems
            new = np.flatnonzero(np.isnan(alone[:, 0]))
            starts = found.starts[new]
            alone[new] = keys(hash_spans(found.data, starts, np.minimum(found.ends[new], starts + n)))
        new = np.isnan(alone[:, 0])
        alone[new] = self.unseen
        p = self.pairs(_joined(before, word)) + self.contexts(before) * alone
        del found, before, word, alone, new
        sums = np.concatenate([[0.0], np.cumsum(np.log(p[:, 0].astype(np.float64) / p[:, 1]))])
        size = np.diff(first)
        mean = (sums[first[1:]] - sums[first[:-1]]) / np.maximum(size, 1)
        most = mean.copy()
        long = np.flatnonzero(size > stretch)
        if len(long):
            runs = (sums[stretch:] - sums[:-stretch]) / stretch
            # stretches inside one text are first .. first + size - stretch
            edges = np.column_stack([first[:-1][long], first[1:][long] - stretch + 1]).ravel()
            runs = np.append(runs, -np.inf)
            most[long] = np.maximum.reduceat(runs, edges)[::2]
        return np.column_stack([mean, most]), size


@dataclass
class ModelFiles:
    """Models of `view` in files of the shared folder, one for each range of `_part_of`, None where it has no rows."""

    names: list[str | None]
    view: int
    unseen: np.ndarray

    def models(self) -> Models:
        """The models with their files mapped; the files of a store are copied to the worker's disk first, unnamed."""
        batches = [_mapped(name) for name in self.names if name]
        parts = iter([np.searchsorted(b["kind"].to_numpy(), np.arange(len(_DEFAULTS) + 1)), *[b[c].to_numpy() for c in b.schema.names[1:]]] for b in batches)
        none = [np.zeros(len(_DEFAULTS) + 1, np.int64), np.zeros(0, np.int64), *[np.zeros(0, np.float32)] * 2]
        parts = [next(parts) if name else none for name in self.names]
        looks = []
        for k, default in enumerate(_DEFAULTS):
            own = [[x[edges[k] : edges[k + 1]] for x in columns] for edges, *columns in parts]
            looks.append(MappedLookup([(key.view(np.uint64), *values) for key, *values in own], default))
        return Models.of_looks(looks, self.unseen)


def _mapped(name: str) -> pa.RecordBatch:
    """The one batch of an Arrow file, which stays in the file."""
    from pyarrow.fs import LocalFileSystem

    system, inner = file_system(name)
    if isinstance(system, LocalFileSystem):
        return pa.ipc.open_file(pa.memory_map(inner)).get_batch(0)
    with tempfile.TemporaryFile() as copy, system.open_input_stream(inner) as stored:
        shutil.copyfileobj(stored, copy, 1 << 20)
        copy.flush()
        return pa.ipc.open_file(pa.py_buffer(mmap.mmap(copy.fileno(), 0, access=mmap.ACCESS_READ))).get_batch(0)


def _filed(rows: pa.Table, path: str) -> pa.Table:
    """Writes the rows of one range, a file for each view; an attempt has files of its own, and only those it returns count."""
    let_go()
    key, kind = rows["key"].to_numpy().astype(np.int64), rows["kind"].to_numpy()
    order = np.lexsort((key.view(np.uint64), kind))
    system, inner = file_system(path)
    system.create_dir(inner)
    names = []
    for view in _VIEWS:
        values = [rows[c].to_numpy().astype(np.float32)[order] for c in view]
        some = np.flatnonzero(~np.isnan(values[0]))
        names.append(f"{path}/{uuid.uuid4().hex}.arrow")
        arrays = [pa.array(x[some]) for x in (kind[order].astype(np.int8), key[order], *values)]
        batch = pa.RecordBatch.from_arrays(arrays, names=["kind", "key", *view])
        with system.open_output_stream(names[-1].replace(path, inner, 1)) as to, pa.ipc.new_file(to, batch.schema) as out:
            out.write(batch)
    give_back()
    return pa.table({"part": rows["part"][:1].combine_chunks(), "names": pa.array([names], pa.list_(pa.string()))})


def file_models(rows: DataFrame, unseen: list[np.ndarray], count: int) -> list[ModelFiles]:
    """The models of each view from `model_table`, in files of about a million rows by ranges of keys."""
    path, parts = scratch(rows.sparkSession, "models"), max(1, count >> 20)
    part = F.shiftright(F.shiftrightunsigned("key", 32) * parts, 32).cast("int")
    made = rows.withColumn("part", part).groupBy("part").applyInArrow(lambda x: _filed(x, path), "part int, names array<string>")
    names = {r["part"]: r["names"] for r in made.collect()}
    return [ModelFiles([names[p][v] if p in names else None for p in range(parts)], v, unseen[v]) for v in range(len(_VIEWS))]


def _held(files: list[ModelFiles]) -> list[Models]:
    """The worker's mapped models."""
    return hold(tuple((f.view, *f.names) for f in files), lambda: [f.models() for f in files])


@dataclass
class Toxicity:
    """Fitted models: in memory, or as `rows` on Spark and `files` of them if they are too many; neither without labels of both
    classes."""

    models: Models | None
    weights: np.ndarray
    share: float
    stretch: int
    rows: DataFrame | None = None
    files: ModelFiles | None = None

    def score(self, column: pa.Array) -> np.ndarray:
        if self.models is None and self.files is None:
            return np.full(len(column), self.share)
        models = self.models if self.files is None else _held([self.files])[0]
        return self.rated(*models.evidence(column, self.stretch))

    def rated(self, x: np.ndarray, size: np.ndarray) -> np.ndarray:
        return np.where(size > 0, sigmoid(x @ self.weights[:-1] + self.weights[-1]), self.share)


def _cross(batches, shared, stretch: int) -> Iterator[pa.RecordBatch]:
    """Evidence of labelled texts, every half by the models of the other one; `shared` is a broadcast of both, or their files."""
    if not isinstance(shared, list):
        let_go()
    both = _held(shared) if isinstance(shared, list) else shared.value
    for batch in pieces(batches, lambda b: b["text"], 1 << 20):
        found = [m.evidence(batch["text"], stretch)[0] for m in both]
        own = np.where(batch["half"].to_numpy()[:, None] == 0, *found)
        yield pa.RecordBatch.from_arrays([batch["doc_id"], batch["label"], pa.array(own[:, 0]), pa.array(own[:, 1])], names=["doc_id", "label", "mean", "most"])
    give_back()


def fit(
    docs: DataFrame,
    labels: DataFrame,
    where: Column | None = None,
    *,
    stretch: int = 12,
    least: int = 4,
    most: int = 6 << 20,
) -> Toxicity:
    """Models and calibration from all labels among the rows `where` (a condition on doc_id). Rows without id, label or text
    are not labelled; of several labels of an id the smallest holds."""
    spark = docs.sparkSession
    bound_batches(spark)
    known = labels if where is None else labels.where(where)
    known = known.where(F.col("toxic").isin(0, 1))
    rates = known.agg(F.avg("toxic"), F.count("toxic")).first()
    share = float(rates[0] or 0.0)
    known = known.where("doc_id is not null").groupBy("doc_id").agg(F.min("toxic").cast("int").alias("label"))
    known = F.broadcast(known) if rates[1] <= 2 << 20 else known  # 16 bytes a row; texts stay where they are
    half = F.pmod(F.xxhash64(F.lit("half"), "doc_id"), F.lit(2)).cast("int")
    sample = docs.select("doc_id", "text").where("text is not null").join(known, "doc_id").withColumn("half", half)
    sizes = {r["label"]: r["n"] for r in sample.groupBy("label").agg(F.countDistinct("doc_id").alias("n")).collect()}
    if min(sizes.get(v, 0) for v in (0, 1)) < 4:
        return Toxicity(None, np.zeros(3), share, stretch)
    rows, unseen = model_table(sample, least)
    count = rows.count()
    small = count <= most
    if small:

        def model(v: int) -> Models:
            own = rows.select("kind", "key", *_VIEWS[v]).where(F.col(_VIEWS[v][0]).isNotNull())
            out = Models.of_rows(own.toArrow(), v, unseen[v])
            give_back()
            return out

        shared = spark.sparkContext.broadcast([model(1), model(0)])
    else:
        files = file_models(rows, unseen, count)
        shared = [files[1], files[0]]
    scores = sample.mapInArrow(lambda b: _cross(b, shared, stretch), StructType([sample.schema["doc_id"], *StructType.fromDDL("label int, mean double, most double")]))
    # one row an id
    scores = scores.groupBy("doc_id").agg(F.min(F.struct("label", "mean", "most")).alias("x")).select("x.*").toArrow()
    scores = scores.sort_by([(c, "ascending") for c in scores.column_names])
    if small:
        shared.destroy()
    y = scores["label"].to_numpy()
    x = np.column_stack([scores["mean"].to_numpy(), scores["most"].to_numpy()])
    weight = np.where(y == 1, share / (y == 1).mean(), (1 - share) / (y == 0).mean())
    held = {"models": model(2)} if small else {"models": None, "rows": rows, "files": files[2]}
    return Toxicity(weights=logistic(x, y, weight), share=share, stretch=stretch, **held)


def _score(batches, model: Toxicity, text) -> Iterator[pa.RecordBatch]:
    if model.files is None:
        let_go()
    for batch in pieces(batches, text, 1 << 20):
        score = pa.array(model.score(text(batch)))
        yield pa.RecordBatch.from_arrays([batch.column("kept"), score], names=["kept", "score"])
    give_back()


def score(docs: DataFrame, model: Toxicity, *, text: str = "text", keep: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """The columns `keep` and `score`, the probability that the text is toxic."""
    bound_batches(docs.sparkSession)
    rows, column = kept_and_text(docs, keep, text)
    schema = StructType([rows.schema["kept"], StructField("score", DoubleType())])
    shared = docs.sparkSession.sparkContext.broadcast(replace(model, rows=None))
    return rows.mapInArrow(lambda b: _score(b, shared.value, column), schema)


def scored(docs: DataFrame, model: Toxicity) -> DataFrame:
    """doc_id and score."""
    return score(docs, model).select("kept.doc_id", "score")


def drop_toxic(docs: DataFrame, model: Toxicity, threshold: float = 0.7) -> DataFrame:
    """The documents below the threshold, in their own columns."""
    return score(docs, model, keep=tuple(docs.columns)).where(F.col("score") < threshold).select("kept.*")
