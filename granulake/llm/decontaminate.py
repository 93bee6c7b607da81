"""Benchmark decontamination by suffix arrays of the training text.

Each task cuts its documents into shards of bounded size and builds a suffix array over the words of each
shard: the positions sorted by the words that follow. Every suffix of every test item is looked up there by
binary search, which gives the longest verbatim matches and where they are; documents that hold a whole test
window are affected and can be removed.

Positions whose first word is in no test item cannot match and are left out of the arrays, and the order
is refined past the first packed words only inside ranges that a test suffix enters.

Test items travel in broadcasts of at most `block_words` words; a larger test set takes further passes, with the
matches so far written to the shared scratch folder between them. Words are compared by 64-bit hashes.

Defined results: a NULL, empty or wordless text has no words and no matches; a NULL, empty or wordless item
is in no document; an item with fewer words than a window is one window; equal rows each get a row;
equal item ids count once; other columns of both inputs are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from granulake.llm.words import MASK_ALNUM, find_words, kept_and_text, pieces, text_offsets
from granulake.llm.workers import give_back, let_go
from granulake.session import cut

SPANS = "array<struct<start:bigint,words:bigint,item:string,item_start:bigint>>"
_SPAN = pa.list_(
    pa.struct([("start", pa.int64()), ("words", pa.int64()), ("item", pa.string()), ("item_start", pa.int64())])
)


class Tests:
    """Test items as word numbers: `ids` of all items one after another, `first` word of each, `names`."""

    def __init__(self, names: list[str], texts: list[str | None], window: int):
        words = find_words(*text_offsets(pa.array(texts, pa.string())), MASK_ALNUM)
        self.names, self.first, self.window = names, words.first, window
        self.vocabulary, ids = np.unique(words.hashes, return_inverse=True)
        self.ids = ids.astype(np.int64) + 1
        self.bits = max(1, int(len(self.vocabulary) + 1).bit_length())
        self.per_key = max(1, 64 // self.bits)
        self.seen = np.zeros(1 << 16, bool)
        self.seen[(self.vocabulary & np.uint64(0xFFFF)).astype(np.int64)] = True
        sizes = np.diff(self.first)
        counts = np.where(sizes > 0, np.maximum(1, sizes - window + 1), 0)
        #: windows: item, first word in the item, number of words
        self.item = np.repeat(np.arange(len(sizes)), counts)
        self.at = np.arange(len(self.item)) - np.repeat(np.cumsum(counts) - counts, counts)
        self.size = np.minimum(sizes, window)[self.item]

    def number(self, hashes: np.ndarray) -> np.ndarray:
        """Test word number of each word, 0 for words in no item."""
        out = np.zeros(len(hashes), np.int64)
        if len(self.vocabulary):
            rows = np.flatnonzero(self.seen[(hashes & np.uint64(0xFFFF)).astype(np.int64)])
            at = np.minimum(np.searchsorted(self.vocabulary, hashes[rows]), len(self.vocabulary) - 1)
            out[rows] = np.where(self.vocabulary[at] == hashes[rows], at + 1, 0)
        return out

    def packed(self, ids: np.ndarray, at: np.ndarray, n: int) -> np.ndarray:
        """The n words from each position on in one number, the first word in the highest bits."""
        padded = np.concatenate([ids, np.zeros(n, np.int64)]).astype(np.uint64)
        out = np.zeros(len(at), np.uint64)
        for i in range(n):
            out = (out << np.uint64(self.bits)) | padded[np.minimum(at + i, len(ids))]
        return out


class Shard:
    """Suffix array of one shard's words; texts are kept apart by a word that no item has."""

    def __init__(self, ids: np.ndarray, tests: Tests):
        self.ids, self.tests = ids, tests
        positions = np.flatnonzero(ids)
        keys = tests.packed(ids, positions, tests.per_key)
        order = np.argsort(keys)
        self.positions, self.keys = positions[order], keys[order]

    def occurrences(self) -> tuple[np.ndarray, np.ndarray]:
        """Every (window, position) where a test window stands in the shard."""
        t = self.tests
        n = np.minimum(t.size, t.per_key)
        rest = ((t.per_key - n) * t.bits).astype(np.uint64)
        low = t.packed(t.ids, t.first[t.item] + t.at, t.per_key) >> rest << rest
        high = low | ((np.uint64(1) << rest) - np.uint64(1))
        left = np.searchsorted(self.keys, low, "left")
        counts = np.searchsorted(self.keys, high, "right") - left
        window = np.repeat(np.arange(len(left)), counts)
        where = self.positions[np.repeat(left - (np.cumsum(counts) - counts), counts) + np.arange(len(window))]
        padded = np.concatenate([self.ids, np.zeros(t.window, np.int64)])
        for i in range(t.per_key, t.window):  # words beyond the key, inside the entered ranges only
            begin = t.first[t.item[window]] + t.at[window]
            same = (i >= t.size[window]) | (
                padded[np.minimum(where + i, len(self.ids))] == t.ids[np.minimum(begin + i, len(t.ids) - 1)]
            )
            window, where = window[same], where[same]
        return window, where

    def matches(self) -> tuple[np.ndarray, ...]:
        """Longest matches: position, words, item, first word in the item."""
        t = self.tests
        window, where = self.occurrences()
        item, at, size = t.item[window], t.at[window], t.size[window]
        order = np.lexsort((where, where - at, item))
        item, at, size, where = item[order], at[order], size[order], where[order]
        same = np.zeros(len(where), bool)
        aligned = where[1:] - at[1:] == where[:-1] - at[:-1]
        same[1:] = (item[1:] == item[:-1]) & aligned & (where[1:] == where[:-1] + 1)
        begin = np.flatnonzero(~same)
        end = np.append(begin[1:], len(where))[: len(begin)] - 1
        return where[begin], where[end] - where[begin] + size[end], item[begin], at[begin]


def _search(batches, tests: Tests, shard_bytes: int, text) -> Iterator[pa.RecordBatch]:
    let_go()
    names = np.array(tests.names, dtype=object)
    for batch in pieces(batches, text, shard_bytes):
        words = find_words(*text_offsets(text(batch)), MASK_ALNUM)
        docs = batch.num_rows
        counts = np.diff(words.first)
        # one foreign word after each text keeps matches inside texts
        shift = np.repeat(np.arange(docs), counts)
        ids = np.zeros(len(words.hashes) + docs, np.int64)
        ids[np.arange(len(words.hashes)) + shift] = tests.number(words.hashes)
        begins = words.first[:-1] + np.arange(docs)
        start, size, item, item_at = Shard(ids, tests).matches()
        doc = np.searchsorted(begins, start, "right") - 1
        order = np.lexsort((start, doc))
        start, size, item, item_at, doc = (x[order] for x in (start, size, item, item_at, doc))
        spans = pa.StructArray.from_arrays(
            [
                pa.array(start - begins[doc]),
                pa.array(size),
                pa.array(names[item].tolist(), pa.string()),
                pa.array(item_at),
            ],
            fields=list(_SPAN.value_type),
        )
        found = pa.ListArray.from_arrays(pa.array(np.searchsorted(doc, np.arange(docs + 1)), pa.int32()), spans)
        yield pa.RecordBatch.from_arrays(
            [*(batch.column(c) for c in batch.schema.names), pa.array(counts.astype(np.int64)), found.cast(_SPAN)],
            names=[*batch.schema.names, "n_words", "found"],
        )
    give_back()


def find_matches(
    docs: DataFrame,
    items: DataFrame,
    *,
    text: str = "text",
    keep: tuple[str, ...] = ("doc_id",),
    item_id: str = "item_id",
    item_text: str = "text",
    window: int = 10,
    shard_bytes: int = 4 << 20,
    block_words: int = 2_000_000,
) -> DataFrame:
    """`kept` (a struct of the columns `keep`), `n_words` and `spans` of each document, its longest verbatim matches of
    at least a window: first word, number of words, item, first word in the item."""
    spark = docs.sparkSession
    out, column = kept_and_text(docs, keep, text)
    out = out.withColumn("spans", F.expr(f"cast(array() as {SPANS})"))
    names, texts, size, blocks = [], [], 0, 0

    def look(frame: DataFrame) -> DataFrame:
        shared = spark.sparkContext.broadcast(Tests(names, texts, window))
        schema = StructType([*frame.drop("n_words").schema, *StructType.fromDDL(f"n_words bigint, found {SPANS}")])
        got = frame.drop("n_words").mapInArrow(lambda b: _search(b, shared.value, shard_bytes, column), schema)
        return got.withColumn("spans", F.concat("spans", "found")).drop("found")

    # the items come one partition at a time; a block goes out before the next is gathered
    for row in items.select(F.col(f"`{item_id}`").cast("string"), F.col(f"`{item_text}`")).toLocalIterator():
        weight = len((row[1] or "").split()) + 1
        if size and size + weight > block_words:
            out, blocks = cut(look(out), "matches"), blocks + 1
            names, texts, size = [], [], 0
        names.append(row[0] if row[0] is not None else "")
        texts.append(row[1])
        size += weight
    out = look(out)
    return out.select("kept", "n_words", "spans")


def words_hit(spans: str | Column) -> Column:
    """Number of words inside any of the spans."""
    spans = F.col(spans) if isinstance(spans, str) else spans
    start = F.struct(F.lit(0).cast("bigint").alias("end"), F.lit(0).cast("bigint").alias("hit"))

    def step(state, span):
        end = span["start"] + span["words"]
        fresh = F.greatest(F.lit(0).cast("bigint"), end - F.greatest(state["end"], span["start"]))
        return F.struct(F.greatest(state["end"], end).alias("end"), (state["hit"] + fresh).alias("hit"))

    return F.aggregate(F.array_sort(spans), start, step)["hit"]


def decontaminate(docs: DataFrame, items: DataFrame, **options) -> DataFrame:
    """The documents without a whole test window, in their own columns."""
    found = find_matches(docs, items, keep=tuple(docs.columns), **options)
    return found.where(F.size("spans") == 0).select("kept.*")


def digest(found: DataFrame) -> DataFrame:
    """Per document: hit words, items found and their digest."""
    items = F.array_sort(F.array_distinct(F.col("spans.item")))
    return found.select(
        "kept.doc_id",
        "n_words",
        words_hit("spans").alias("n_hit"),
        F.size(items).cast("bigint").alias("n_items"),
        F.sha2(F.array_join(items, ","), 256).alias("items_sha256"),
        (F.size("spans") > 0).alias("contaminated"),
    )
