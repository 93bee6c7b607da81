"""Token ids in compressed binary files: canonical length-limited Huffman codes.

Writing: every text is encoded by the tokenizers library (`Ids`), the ids of the whole corpus are counted, a
canonical Huffman code of at most `LIMIT` bits is made from the counts (package-merge), every document is coded into a
byte-aligned bit stream, and documents in ascending doc_id order fill blocks.

Format (`write`): a folder with `codebook` (id, bits: the code lengths, from which the canonical codes follow) and
`blocks`, Parquet files whose rows are independent blocks: shard and block number, the ids before it in its
shard, doc_ids, ids per document, payload, and checkpoints: the bit offset of every `STRIDE`-th id of each document. Parquet carries the rows, so that
an output is published whole and tasks can be repeated; the payload is the format's own.

Reading (`read`): every stretch between checkpoints is decoded with one table of 2^LIMIT entries; the stretches of a
block advance together. Blocks need nothing but the codebook.

The library encodes every different piece of text once a worker and remembers up to `REMEMBERED` pieces by 64-bit
hash; the pieces are those of the library's own splitter. A text that contains the text of an added token goes through
the library whole. The counts and the codebook have one row for each id of the vocabulary; range bounds have one row a
shard.

Defined results: a NULL or empty text has the end id only; equal doc_ids stand next to each other, ordered by
their ids; a NULL doc_id stands first; an empty table gives no blocks and an empty codebook; other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from granulake.llm.pretokens import PieceStore, library_classes
from granulake.llm.words import pieces, text_offsets
from granulake.session import shuffle_partitions

LIMIT = 18
STRIDE = 1024
REMEMBERED = 2_000_000
BLOCK_BYTES = 1 << 20
BLOCK = (
    "shard int, block bigint, before bigint, doc_ids array<bigint>, n_tokens array<bigint>, bytes array<bigint>, "
    "payload binary, checkpoints array<bigint>"
)


# ---- ids ---------------------------------------------------------------------------------------


@dataclass(frozen=True)
class Tokenizer:
    """A tokenizer file's text, its splitter's character classes, and the id that ends a document."""

    text: str
    classes: bytes
    end: int
    added: tuple[str, ...]


def load_tokenizer(path: str, end: int) -> Tokenizer:
    from tokenizers import Tokenizer as Library

    with open(path, encoding="utf-8") as file:
        text = file.read()
    library = Library.from_str(text)
    split = lambda s: [span for _, span in library.pre_tokenizer.pre_tokenize_str(s)]
    added = tuple(t.content for t in library.get_added_tokens_decoder().values())
    return Tokenizer(text, library_classes(split).tobytes(), end, added)


class Ids:
    """Encodes texts with the library, every different piece once."""

    def __init__(self, tokenizer: Tokenizer):
        from tokenizers import Tokenizer as Library

        self.library = Library.from_str(tokenizer.text)
        self.added = [t.encode() for t in tokenizer.added]
        self.store = PieceStore(self.words, np.frombuffer(tokenizer.classes, np.uint8), REMEMBERED)

    def words(self, words: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Ids of different pieces one after another, and how many each has."""
        got = [e.ids for e in self.library.encode_batch_fast(words, add_special_tokens=False)]
        sizes = np.fromiter(map(len, got), np.int32, len(got))
        return np.fromiter((i for e in got for i in e), np.int32, int(sizes.sum())), sizes

    def documents(self, column: pa.Array, end: int) -> list[np.ndarray]:
        """Ids of every text with the end id."""
        ids, first = self.store.encode(column)
        out = [np.append(ids[a:b], end) for a, b in zip(first, first[1:])]
        raw = text_offsets(column)[0].tobytes()
        if any(t in raw for t in self.added):
            for i, text in enumerate(column.to_pylist()):
                if text and any(t.decode() in text for t in self.added):
                    out[i] = np.append(np.array(self.library.encode(text, add_special_tokens=False).ids, np.int64), end)
        return out


@lru_cache(maxsize=1)
def _ids(tokenizer: Tokenizer) -> Ids:
    """One encoder a worker process."""
    return Ids(tokenizer)


def _tokenize(batches, shared) -> Iterator[pa.RecordBatch]:
    tokenizer = shared.value
    ids = _ids(tokenizer)
    for batch in pieces(batches, "text", 1 << 20):
        docs = ids.documents(batch.column("text"), tokenizer.end)
        packed = [_pack_ids(d) for d in docs]
        columns = [batch.column("doc_id"), pa.array(packed, pa.binary())]
        yield pa.RecordBatch.from_arrays(columns, names=["doc_id", "ids"])


def _pack_ids(ids: np.ndarray) -> bytes:
    """Two bytes an id where they fit, else four; the first byte tells."""
    size = 2 if not len(ids) or ids.max() < 65536 else 4
    return bytes([size]) + ids.astype(f"<u{size}").tobytes()


def _unpack_ids(data: bytes) -> np.ndarray:
    return np.frombuffer(data, f"<u{data[0]}", offset=1)


# ---- code --------------------------------------------------------------------------------------


def code_lengths(counts: np.ndarray, limit: int) -> np.ndarray:
    """Optimal code lengths of at most `limit` bits for symbols with these counts (package-merge)."""
    n = len(counts)
    if n > 1 << limit:
        raise ValueError(f"{n} symbols do not fit in {limit} bits")
    if n < 2:
        return np.ones(n, np.int64)
    order = np.argsort(counts, kind="stable")
    weights = counts[order].astype(np.float64)
    # each level merges the symbols with pairs of the level below; which items are symbols is all that is kept
    levels, items = [], weights
    kinds = np.ones(n, bool)
    for _ in range(limit - 1):
        levels.append(kinds)
        pairs = items[: len(items) // 2 * 2].reshape(-1, 2).sum(axis=1)
        both = np.concatenate([weights, pairs])
        place = np.argsort(both, kind="stable")
        items, kinds = both[place], place < n
    levels.append(kinds)
    lengths, take = np.zeros(n, np.int64), 2 * n - 2
    for kinds in reversed(levels):
        symbols = int(kinds[:take].sum())
        lengths[:symbols] += 1
        take = 2 * (take - symbols)
    out = np.empty(n, np.int64)
    out[order] = lengths
    return out


@dataclass
class Code:
    """Canonical code: symbols by id, code lengths, codes."""

    ids: np.ndarray
    bits: np.ndarray

    def __post_init__(self):
        order = np.lexsort((self.ids, self.bits))
        self.ids, self.bits = self.ids[order], self.bits[order]
        steps = np.int64(1) << (LIMIT - self.bits)
        self.codes = (np.cumsum(steps) - steps) >> (LIMIT - self.bits)

    def encoder(self) -> tuple[np.ndarray, np.ndarray]:
        """Code and length by id."""
        size = int(self.ids.max()) + 1 if len(self.ids) else 1
        codes, bits = np.zeros(size, np.uint64), np.zeros(size, np.int64)
        codes[self.ids], bits[self.ids] = self.codes, self.bits
        return codes, bits

    def decoder(self) -> np.ndarray:
        """By the next LIMIT bits: id and length in one number."""
        table = np.zeros(1 << LIMIT, np.uint32)
        filled = np.repeat((self.ids.astype(np.uint32) << 5) | self.bits.astype(np.uint32), 1 << (LIMIT - self.bits))
        table[: len(filled)] = filled
        return table


def pack_bits(codes: np.ndarray, bits: np.ndarray, at: np.ndarray, size: int) -> np.ndarray:
    """Codes written at their bit offsets (ascending, apart), highest bit first, into `size` bytes."""
    words = np.zeros(size // 4 + 3, np.uint32)
    if len(codes):
        word = at >> 5
        shifted = codes << (64 - bits - (at & 31)).astype(np.uint64)
        begin = np.flatnonzero(np.append(True, word[1:] != word[:-1]))
        last = np.append(begin[1:], len(word)) - 1
        words[word[begin]] = np.bitwise_or.reduceat(shifted >> np.uint64(32), begin)
        over = (shifted[last] & np.uint64(0xFFFFFFFF)).astype(np.uint32)
        words[word[last] + 1] |= over
    return words.astype(">u4").view(np.uint8)[:size]


def unpack_bits(payload: bytes, starts: np.ndarray, sizes: np.ndarray, table: np.ndarray) -> np.ndarray:
    """Ids of stretches that begin at bit offsets; all stretches advance one id at a time."""
    data = np.frombuffer(payload + b"\0" * 8, np.uint8)
    eights = np.ndarray((len(data) - 7,), ">u8", data, strides=(1,))
    order = np.argsort(-sizes, kind="stable")
    ends = np.cumsum(sizes)
    at, out_at, left = starts[order].astype(np.int64), (ends - sizes)[order], sizes[order]
    out = np.zeros(int(ends[-1]) if len(ends) else 0, np.uint32)
    longest = int(left[0]) if len(left) else 0
    running = np.searchsorted(-left, -np.arange(1, longest + 1), "right")
    mask = np.uint64((1 << LIMIT) - 1)
    for step in range(longest):
        n = running[step]
        now = at[:n]
        window = eights[now >> 3].astype(np.uint64) >> (64 - LIMIT - (now & 7)).astype(np.uint64)
        found = table[(window & mask).astype(np.int64)]
        out[out_at[:n] + step] = found >> 5
        now += found & 31
    return out


# ---- files -------------------------------------------------------------------------------------


def _count(batches) -> Iterator[pa.RecordBatch]:
    total = np.zeros(0, np.int64)
    for batch in batches:
        for value in batch.column("ids"):
            got = np.bincount(_unpack_ids(value.as_py()))
            if len(got) > len(total):
                total, got = got, total
            total[: len(got)] += got
    some = np.flatnonzero(total)
    yield pa.RecordBatch.from_arrays([pa.array(some), pa.array(total[some])], names=["id", "n"])


def _encode(batches, shared) -> Iterator[pa.RecordBatch]:
    codes, bits = shared.value.encoder()
    for batch in batches:
        sizes, payload, marks = [], [], []
        for value in batch.column("ids"):
            ids = _unpack_ids(value.as_py())
            length = bits[ids]
            ends = np.cumsum(length)
            at = ends - length
            payload.append(pack_bits(codes[ids], length, at, (int(ends[-1]) + 7) // 8).tobytes())
            marks.append(at[::STRIDE])
            sizes.append(len(ids))
        columns = [pa.array(sizes, pa.int64()), pa.array(payload, pa.binary()), pa.array(marks, pa.list_(pa.int64()))]
        columns = [batch.column("doc_id"), batch.column("shard"), *columns]
        yield pa.RecordBatch.from_arrays(columns, names=["doc_id", "shard", "n", "bits", "marks"])


def _assemble(batches) -> Iterator[pa.RecordBatch]:
    """Ordered documents of a shard into blocks."""
    rows: list[tuple] = []
    size = number = before = 0
    shard = None

    def block():
        sizes = np.array([len(r[2]) for r in rows])
        base = (np.cumsum(sizes) - sizes) * 8
        marks = np.concatenate([np.array(r[3], np.int64) + b for r, b in zip(rows, base)])
        ids, counts, payload = [r[0] for r in rows], [r[1] for r in rows], b"".join(r[2] for r in rows)
        columns = [[x] for x in (shard, number, before, ids, counts, sizes.tolist(), payload, marks.tolist())]
        kinds = [pa.int32(), pa.int64(), pa.int64(), *[pa.list_(pa.int64())] * 3, pa.binary(), pa.list_(pa.int64())]
        names = ["shard", "block", "before", "doc_ids", "n_tokens", "bytes", "payload", "checkpoints"]
        return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds)], names=names)

    for batch in batches:
        for *row, part in zip(*(batch.column(c).to_pylist() for c in ("doc_id", "n", "bits", "marks", "shard"))):
            if rows and (size + len(row[2]) > BLOCK_BYTES or part != shard):
                yield block()
                same = part == shard
                number, before = (number + 1, before + sum(r[1] for r in rows)) if same else (0, 0)
                rows, size = [], 0
            shard = part
            rows.append(row)
            size += len(row[2])
    if rows:
        yield block()


def _decode(batches, shared) -> Iterator[pa.RecordBatch]:
    table = shared.value.decoder()
    for batch in batches:
        for i in range(batch.num_rows):
            row = {c: batch.column(c)[i] for c in batch.schema.names}
            counts = np.array(row["n_tokens"].as_py(), np.int64)
            stretches = -(-counts // STRIDE)
            sizes = np.full(int(stretches.sum()), STRIDE)
            sizes[np.cumsum(stretches) - 1] = counts - (stretches - 1) * STRIDE
            ids = unpack_bits(row["payload"].as_py(), np.array(row["checkpoints"].as_py(), np.int64), sizes, table)
            ends = np.cumsum(counts)
            before = row["before"].as_py()
            raw = ids.astype("<u4")
            each = [raw[a:b].tobytes() for a, b in zip(ends - counts, ends)]
            doc_ids = pa.array(row["doc_ids"].as_py(), pa.int64())
            yield pa.RecordBatch.from_arrays(
                [doc_ids, pa.array(before + ends - counts), pa.array(counts), pa.array(each, pa.binary())],
                names=["doc_id", "start", "n_tokens", "ids"],
            )


def tokenize(docs: DataFrame, tokenizer: Tokenizer, *, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """doc_id and `ids`, packed, of every text."""
    shared = docs.sparkSession.sparkContext.broadcast(tokenizer)
    rows = docs.select(F.col(f"`{doc_id}`").cast("bigint").alias("doc_id"), F.col(f"`{text}`").alias("text"))
    return rows.mapInArrow(lambda b: _tokenize(b, shared), "doc_id bigint, ids binary")


def write(tokens: DataFrame, path: str) -> None:
    """Files of the documents' ids in ascending doc_id order; `tokens` is read several times."""
    spark = tokens.sparkSession
    counted = tokens.select("ids").mapInArrow(_count, "id bigint, n bigint")
    got = counted.groupBy("id").agg(F.sum("n").alias("n")).orderBy("id").toArrow()
    ids = got["id"].to_numpy()
    code = Code(ids, code_lengths(got["n"].to_numpy(), LIMIT))
    book = pa.table({"id": pa.array(code.ids, pa.int64()), "bits": pa.array(code.bits, pa.int32())})
    book = spark.createDataFrame(book)
    book.coalesce(1).write.parquet(f"{path}/codebook")
    shards = shuffle_partitions(spark)
    bounds = tokens.agg(F.percentile_approx("doc_id", [i / shards for i in range(1, shards)] or [0.5], 10_000)).first()[0]
    bounds = sorted(set(bounds or []))
    # the range of a doc_id among the bounds, which have one entry a shard
    shard = F.size(F.filter(F.lit(bounds).cast("array<bigint>"), lambda b: b < F.coalesce("doc_id", F.lit(-(2**63)))))
    shared = spark.sparkContext.broadcast(code)
    coded = tokens.withColumn("shard", shard).mapInArrow(
        lambda b: _encode(b, shared), "doc_id bigint, shard int, n bigint, bits binary, marks array<bigint>"
    )
    sharded = coded.repartitionById(len(bounds) + 1, F.col("shard"))
    ordered = sharded.sortWithinPartitions(F.col("doc_id").asc_nulls_first(), "n", "bits")
    ordered.mapInArrow(_assemble, BLOCK).write.parquet(f"{path}/blocks")


def read(spark: SparkSession, path: str) -> DataFrame:
    """doc_id, start, n_tokens and ids (little-endian, four bytes each) of every document in the files."""
    book = spark.read.parquet(f"{path}/codebook").toArrow()
    code = Code(book["id"].to_numpy(), book["bits"].to_numpy().astype(np.int64))
    shared = spark.sparkContext.broadcast(code)
    blocks = spark.read.schema(BLOCK).parquet(f"{path}/blocks")
    # ids of all shards before: one row a shard
    own = F.aggregate("n_tokens", F.lit(0).cast("bigint"), lambda a, b: a + b)
    sizes = blocks.groupBy("shard").agg(F.max(F.col("before") + own))
    start, starts = 0, []
    for shard, n in sorted((r[0], r[1]) for r in sizes.collect()):
        starts.append((shard, start))
        start += n
    first = F.broadcast(spark.createDataFrame(starts, "shard int, first bigint"))
    placed = blocks.join(first, "shard").withColumn("before", F.col("first") + F.col("before"))
    return placed.select("before", "doc_ids", "n_tokens", "payload", "checkpoints").mapInArrow(
        lambda b: _decode(b, shared), "doc_id bigint, start bigint, n_tokens bigint, ids binary"
    )
