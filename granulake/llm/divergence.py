"""Source divergence audit: how far each source's use of words is from the other sources and from its language.

Counting (`count_terms`): each task cuts its documents into slices of bounded size. In a slice it builds pointers to
all word starts over the Arrow buffer and sorts them by the words they point to with a multikey quicksort, whose
character is eight bytes: three-way partition around a pivot, the equal part goes one character deeper, and small parts
are finished by a sort on the same characters. Documents stand in the order of their group in a slice and the
sort is stable, so inside a run of equal words each group's pointers, and each document's, stand together: the runs give
a term's count and document frequency in each group, which Spark sums over all slices.

Comparing: a term is kept in a language where at least `least` documents have it. `divergent_terms` ranks a source's terms
by how far their share is above that of the language. `source_distances` sums the differences of shares over all kept
terms for every two sources of a language: the terms of a language are dealt over shards by their number, sources stand
in blocks, and a task adds up one small matrix for each two blocks; no row is made for a term and two sources.
All numbers are integers.

Defined results: NULL text, language and source read as ''; a group is there even if it has no words; equal rows
each count as a document; an empty table has no groups; other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from granulake.llm.words import pieces, text_offsets, word_spans
from granulake.session import cut

SLICE_BYTES = 8 << 20
SMALL = 1 << 14
BLOCK = 64
CHUNK_TERMS = 256
TERMS_A_SHARD = 1 << 12
#: Letters of ASCII (after lower-casing) and everything beyond ASCII.
MASK_TERM = np.ones(256, bool)
MASK_TERM[[*range(0x00, 0x61), *range(0x7B, 0x80)]] = False
COUNTS = "lang string, source string, term string, n bigint, docs bigint"


# ---- sorting word pointers ---------------------------------------------------------------------


class Pointers:
    """Words of a buffer, compared character by character, where a character is eight bytes in their order."""

    def __init__(self, data: np.ndarray, starts: np.ndarray, ends: np.ndarray):
        padded = np.concatenate([data, np.zeros(8, np.uint8)])
        self.eights = np.ndarray((len(padded) - 7,), ">u8", padded, strides=(1,))
        self.starts, self.sizes = starts, ends - starts

    def characters(self, at: np.ndarray, depth: int) -> np.ndarray:
        """The character at `depth` of each word, with zeros beyond the word's end (no word has a zero byte)."""
        left = np.clip(self.sizes[at] - 8 * depth, 0, 8)
        where = np.where(left > 0, self.starts[at] + 8 * depth, 0)
        spare = ((8 - left) * 8).astype(np.uint64)
        got = self.eights[where].astype(np.uint64)
        return np.where(left > 0, (got >> np.minimum(spare, np.uint64(63))) << np.minimum(spare, np.uint64(63)), np.uint64(0))

    def sort(self) -> tuple[np.ndarray, np.ndarray]:
        """The words' numbers in the order of the words, and whether each begins a run of equal words; stable."""
        out, fresh = [], []
        every = np.arange(len(self.starts))
        todo = [(every, self.characters(every, 0), 0)] if len(every) else []
        while todo:
            at, keys, depth = todo.pop()
            if not len(at):
                continue
            if keys is None:  # all words are the same
                out.append(at)
                fresh.append(np.arange(len(at)) == 0)
            elif len(at) <= SMALL:
                for got, into in zip(self._small(at, keys, depth), (out, fresh)):
                    into.append(got)
            else:
                pivot = np.partition(keys[:: len(keys) // 63], 32)[32]
                same = keys == pivot
                ended = self.sizes[at[same]] <= 8 * (depth + 1)
                longer = at[same][~ended]
                parts = [
                    (at[keys < pivot], keys[keys < pivot], depth),
                    (at[same][ended], None, depth),
                    (longer, self.characters(longer, depth + 1), depth + 1),
                    (at[keys > pivot], keys[keys > pivot], depth),
                ]
                todo += reversed(parts)
        if not out:
            return np.zeros(0, np.int64), np.zeros(0, bool)
        return np.concatenate(out), np.concatenate(fresh)

    def _small(self, at: np.ndarray, keys: np.ndarray, depth: int) -> tuple[np.ndarray, np.ndarray]:
        order = np.argsort(keys, kind="stable")
        at, keys = at[order], keys[order]
        fresh = np.append(True, keys[1:] != keys[:-1])
        while True:
            depth += 1
            run = np.cumsum(fresh) - 1
            longer = np.maximum.reduceat(self.sizes[at], np.flatnonzero(fresh)) > 8 * depth
            some = np.flatnonzero(longer[run] & ~(fresh & np.append(fresh[1:], True)))  # runs of one word are done
            if not len(some):
                return at, fresh
            keys = self.characters(at[some], depth)
            order = np.lexsort((keys, run[some]))
            at[some], keys = at[some][order], keys[order]
            fresh[some[1:]] |= keys[1:] != keys[:-1]


def _groups(batch: pa.RecordBatch) -> tuple[np.ndarray, list[tuple[str, str]]]:
    """Number of each row's group, and the groups."""
    lang, source = (pc.dictionary_encode(batch.column(c)) for c in ("lang", "source"))
    wide = max(1, len(source.dictionary))
    code = lang.indices.to_numpy().astype(np.int64) * wide + source.indices.to_numpy()
    codes, group = np.unique(code, return_inverse=True)
    langs, sources = lang.dictionary.to_pylist(), source.dictionary.to_pylist()
    return group, [(langs[c // wide], sources[c % wide]) for c in codes.tolist()]


def slice_counts(batch: pa.RecordBatch) -> pa.RecordBatch:
    """Count and document frequency of every term in each group of a slice."""
    group, names = _groups(batch)
    order = np.argsort(group, kind="stable")
    group = group[order]
    data, offsets = text_offsets(batch.column("text").take(pa.array(order)))
    data, starts, ends = word_spans(data, offsets, MASK_TERM)
    at, fresh = Pointers(data, starts, ends).sort()
    doc = np.searchsorted(offsets, starts[at], "right") - 1
    mine = group[doc]
    change = np.append(True, mine[1:] != mine[:-1])[: len(at)] | fresh
    begin = np.flatnonzero(change)
    docs = (np.append(True, doc[1:] != doc[:-1])[: len(at)] | fresh).astype(np.int64)
    docs = np.add.reduceat(docs, begin) if len(begin) else docs
    first = at[begin]
    sizes = (ends - starts)[first]
    last = np.cumsum(sizes)
    letters = data[np.repeat(starts[first] - (last - sizes), sizes) + np.arange(int(last[-1]) if len(last) else 0)]
    spans = np.concatenate([[0], last]).astype(np.int64)
    terms = pa.LargeStringArray.from_buffers(len(first), pa.py_buffer(spans), pa.py_buffer(letters)).cast(pa.string())
    which = mine[begin].astype(np.int32)
    columns = [pa.DictionaryArray.from_arrays(pa.array(which), pa.array([n[i] for n in names], pa.string())).cast(pa.string()) for i in (0, 1)]
    columns += [terms, pa.array(np.diff(np.append(begin, len(at)))), pa.array(docs)]
    return pa.RecordBatch.from_arrays(columns, names=["lang", "source", "term", "n", "docs"])


def _cut_long(row: pa.RecordBatch, size: int) -> Iterator[pa.RecordBatch]:
    """A long text in parts that begin at ends of words."""
    data, _ = text_offsets(row.column("text"))
    stops = np.flatnonzero(~MASK_TERM[np.where((data >= 0x41) & (data <= 0x5A), data + 0x20, data)])
    stops = stops[np.unique(np.searchsorted(stops, np.arange(size, len(data), size)).clip(0, max(0, len(stops) - 1)))] if len(stops) else stops
    for a, b in zip([0, *stops.tolist()], [*stops.tolist(), len(data)]):
        part = pa.array([data[a:b].tobytes()], pa.large_binary()).cast(pa.large_string())
        yield pa.RecordBatch.from_arrays([row.column("lang"), row.column("source"), part], names=["lang", "source", "text"])


def _count(batches, size: int) -> Iterator[pa.RecordBatch]:
    for batch in pieces(batches, "text", size):
        if batch.num_rows > 1 or len(text_offsets(batch.column("text"))[0]) <= size:
            yield slice_counts(batch)
            continue
        # one long text: its parts' counts are added up, and it stays one document
        whole = None
        for part in _cut_long(batch, size):
            got = pa.Table.from_batches([slice_counts(part)])
            both = got if whole is None else pa.concat_tables([whole, got])
            summed = both.group_by(["lang", "source", "term"]).aggregate([("n", "sum"), ("docs", "max")])
            whole = summed.rename_columns(["lang", "source", "term", "n", "docs"])
        yield from whole.to_batches(max_chunksize=1 << 16)


# ---- tables ------------------------------------------------------------------------------------


def _read(docs: DataFrame, text: str, lang: str, source: str) -> DataFrame:
    names = {"text": text, "lang": lang, "source": source}
    return docs.select(*[F.coalesce(F.col(f"`{c}`").cast("string"), F.lit("")).alias(n) for n, c in names.items()])


def count_terms(
    docs: DataFrame,
    *,
    text: str = "text",
    lang: str = "lang",
    source: str = "source",
    slice_bytes: int = SLICE_BYTES,
) -> DataFrame:
    """lang, source, term, n (occurrences) and docs (documents that have it) of all terms."""
    rows = _read(docs, text, lang, source)
    found = rows.mapInArrow(lambda b: _count(b, slice_bytes), COUNTS)
    return found.groupBy("lang", "source", "term").agg(F.sum("n").alias("n"), F.sum("docs").alias("docs"))


def kept_terms(counts: DataFrame, least: int) -> DataFrame:
    """The terms that at least `least` documents of the language have, with their count in the language (`all_n`).
    `lead` marks one row of each term of a language."""
    term = Window.partitionBy("lang", "term")
    return (
        counts.withColumn("df", F.sum("docs").over(term))
        .withColumn("all_n", F.sum("n").over(term))
        .withColumn("lead", F.min("source").over(term) == F.col("source"))
        .where(F.col("df") >= least)
        .select("lang", "source", "term", "n", "all_n", "lead")
    )


def group_sizes(docs: DataFrame, kept: DataFrame, *, lang: str = "lang", source: str = "source") -> DataFrame:
    """Every (lang, source) with `size`, its count over the kept terms, and `all_size` and `terms` of the language."""
    names = {"lang": lang, "source": source}
    groups = docs.select(*[F.coalesce(F.col(f"`{c}`").cast("string"), F.lit("")).alias(n) for n, c in names.items()]).distinct()
    own = kept.groupBy("lang", "source").agg(F.sum("n").alias("size"), F.count_if("lead").alias("leads"))
    whole = Window.partitionBy("lang")
    zero = lambda c: F.coalesce(c, F.lit(0).cast("bigint"))
    return groups.join(own, ["lang", "source"], "left").select(
        "lang", "source", zero(F.col("size")).alias("size"),
        zero(F.sum("size").over(whole)).alias("all_size"), zero(F.sum("leads").over(whole)).alias("terms"),
    )


def share(n: str, size: str, terms: str = "terms") -> Column:
    """1 + floor(10^9 (n + 5) / (size + 5 terms)), exact also where 10^9 n has more than 64 bits."""
    above = f"cast(1000000000 as decimal(10,0)) * cast({n} + 5 as decimal(19,0))"
    return F.expr(f"1 + ({above}) div cast({size} + 5 * {terms} as decimal(20,0))")


def divergent_terms(kept: DataFrame, sizes: DataFrame, first: int) -> DataFrame:
    """lang, source, item, value, rank: each group's terms whose share is above the language's, the `first` largest."""
    rows = kept.join(sizes, ["lang", "source"])
    rows = rows.withColumn("value", share("n", "size") - share("all_n", "all_size")).where("value > 0")
    order = Window.partitionBy("lang", "source").orderBy(F.col("value").desc(), F.col("term"))
    ranked = rows.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= first)
    return ranked.select("lang", "source", F.col("term").alias("item"), "value", "rank")


_DISTANCE = "lang string, source string, item string, value bigint"


def source_distances(
    kept: DataFrame, sizes: DataFrame, *, block: int = BLOCK, terms_a_shard: int = TERMS_A_SHARD
) -> DataFrame:
    """lang, source, item (another source of the language), value: the sum of |difference of shares| over all kept terms."""
    by_name = Window.partitionBy("lang").orderBy("source")
    groups = sizes.withColumn("at", F.row_number().over(by_name) - 1).withColumn("groups", F.count("*").over(Window.partitionBy("lang")))
    groups = groups.withColumns({
        "blocks": F.expr(f"cast((groups - 1) div {block} as int)"),
        "shards": F.expr(f"cast(terms div {terms_a_shard} as int)"),
        "base": F.when(F.col("terms") > 0, share("0", "size")).otherwise(F.lit(0)),
    })
    mine = F.expr(f"cast(at div {block} as int)")

    def dealt(rows: DataFrame) -> DataFrame:
        """A row for each two blocks that its source is in."""
        rows = rows.withColumn("mine", mine).withColumn("other", F.explode(F.sequence(F.lit(0), "blocks")))
        columns = ["lang", F.least("mine", "other").alias("i"), F.greatest("mine", "other").alias("j"), "shard", "at", "term", "source", "value", "terms"]
        return rows.select(*columns)

    heads = groups.withColumn("shard", F.explode(F.sequence(F.lit(0), "shards")))
    heads = heads.withColumns({"term": F.lit(None).cast("string"), "value": F.col("base")})
    terms = kept.select("lang", "source", "term", "n").join(groups, ["lang", "source"])
    terms = terms.withColumns({"shard": F.expr("cast(pmod(xxhash64(term), shards + 1) as int)"), "value": share("n", "size")})
    rows = dealt(heads).unionByName(dealt(terms))
    key = ["lang", "i", "j", "shard"]
    ordered = rows.repartition(*key).sortWithinPartitions(*key, F.col("term").asc_nulls_first(), "at")
    parts = ordered.mapInArrow(lambda b: _distances(b, block), _DISTANCE)
    return parts.groupBy("lang", "source", "item").agg(F.sum("value").alias("value"))


class _Matrix:
    """Distances between the sources of two blocks, over the terms of one shard."""

    def __init__(self, key: tuple, block: int):
        self.block = block
        self.key, self.at, self.names, self.base, self.terms = key, [], [], [], 0
        self.rows: list[tuple[np.ndarray, np.ndarray]] = []  # places and shares of whole terms that wait
        self.sums = None

    def head(self, at: int, name: str, base: int, terms: int) -> None:
        self.at.append(at)
        self.names.append(name)
        self.base.append(base)
        self.terms = terms

    def _ready(self) -> None:
        if self.sums is None:
            self.at, self.base = np.array(self.at), np.array(self.base, np.int64)
            self.sums = np.zeros((len(self.at), len(self.at)), np.int64)
            self.gap = np.abs(self.base[:, None] - self.base[None, :])

    def term(self, at: np.ndarray, values: np.ndarray) -> None:
        self.rows.append((at, values))
        if len(self.rows) == CHUNK_TERMS:
            self.add()

    def add(self) -> None:
        """Beyond what sources without any of the terms differ by."""
        self._ready()
        table = np.tile(self.base, (len(self.rows), 1))
        for line, (at, values) in zip(table, self.rows):
            line[np.searchsorted(self.at, at)] = values
        for k in range(len(self.at)):
            self.sums[k] += np.abs(table - table[:, k : k + 1]).sum(axis=0) - len(self.rows) * self.gap[k]
        self.rows = []

    def result(self) -> pa.RecordBatch:
        self.add()
        lang, i, j, shard = self.key
        sums = self.sums + (self.gap * self.terms if shard == 0 else 0)
        block = self.at // self.block
        a, b = np.nonzero((block[:, None] != block[None, :]) if i != j else ~np.eye(len(block), dtype=bool))
        names = np.array(self.names, dtype=object)
        columns = [pa.array([lang] * len(a), pa.string()), *(pa.array(names[x].tolist(), pa.string()) for x in (a, b))]
        return pa.RecordBatch.from_arrays([*columns, pa.array(sums[a, b])], names=["lang", "source", "item", "value"])


def _distances(batches, block: int) -> Iterator[pa.RecordBatch]:
    """Sums over the ordered rows: of each (lang, i, j, shard) first its sources, then its terms."""
    now, term, at, values = None, None, [], []

    def close():
        if term is not None:
            now.term(np.array(at), np.array(values, np.int64))

    for batch in batches:
        for row in zip(*(batch.column(c).to_pylist() for c in ("lang", "i", "j", "shard", "at", "term", "source", "value", "terms"))):
            key = row[:4]
            if now is None or key != now.key:
                if now is not None:
                    close()
                    yield now.result()
                now, term = _Matrix(key, block), None
            if row[5] is None:
                now.head(row[4], row[6], row[7], row[8])
                continue
            if row[5] != term:
                close()
                term, at, values = row[5], [], []
            at.append(row[4])
            values.append(row[7])
    if now is not None:
        close()
        yield now.result()


def audit(
    docs: DataFrame,
    *,
    least: int = 30,
    first: int = 50,
    text: str = "text",
    lang: str = "lang",
    source: str = "source",
    **options,
) -> DataFrame:
    """lang, source, part (`pair`, `term`), item, value, rank."""
    kept = cut(kept_terms(count_terms(docs, text=text, lang=lang, source=source), least), "kept-terms")
    sizes = group_sizes(docs, kept, lang=lang, source=source)
    order = Window.partitionBy("lang", "source").orderBy(F.col("value").desc(), F.col("item"))
    pairs = source_distances(kept, sizes, **options).withColumn("rank", F.row_number().over(order))
    terms = divergent_terms(kept, sizes, first)
    columns = ["lang", "source", "part", "item", "value", "rank"]
    parts = [rows.withColumn("part", F.lit(part)).select(*columns) for rows, part in ((pairs, "pair"), (terms, "term"))]
    return parts[0].unionByName(parts[1])
