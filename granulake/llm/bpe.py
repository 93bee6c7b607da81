"""Byte-level BPE encoding and decoding by DuckDB queries inside each partition.

A text is cut by the usual pattern of byte-level tokenizers (`pretokens`). The different pieces of a block become
rows (word, position, token), one per byte; a recursive query joins every token and its right neighbour to the merge
table and contracts each word's leftmost pair of smallest rank, until no pair of the word is in the table. Decoding
joins ids to the vocabulary and aggregates the pieces of each text in order.

Pieces of more than `LONG` bytes go through a second query that contracts every occurrence of the smallest pair
at once where that provably gives the same tokens (no merge of the new token ranks before it), in rounds of
bounded size, so that a text without blanks neither fills the memory nor takes a step per byte.

A worker keeps the tokens of at most `REMEMBERED` pieces; the rest is bounded by the block (2 MB of text, or one
longer text). The vocabulary travels as a broadcast; its size is that of the tokenizer file, which is checked.

Defined results: a NULL or empty text has no ids and decodes to no bytes; equal texts get equal ids; NULL ids decode to
no bytes; an id outside the vocabulary is an error; other columns are ignored.
"""

from __future__ import annotations

import base64
from collections.abc import Iterator
from contextlib import closing
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from granulake.llm.pretokens import PieceStore
from granulake.llm.words import pieces
from granulake.llm.workers import hold

LONG = 64
REMEMBERED = 1_500_000
BLOCK_BYTES = 2 << 20
CHUNK_BYTES = 300_000
LARGEST_VOCABULARY = 1_000_000

#: A row knows the position and token of its right neighbour; a word's last step holds its tokens.
SHORT_WORDS = """
with recursive state(w, pos, npos, tok, nxt, step) as (
  select w, pos, lead(pos) over (partition by w order by pos), tok, lead(tok) over (partition by w order by pos), 0
  from seed
  union all
  select * from (
    with pair as (select state.*, r from state left join merges on a = tok and b = nxt),
    best as (
      select w, min((r::bigint << 32) | pos) as k, arg_min(npos, (r::bigint << 32) | pos) as g
      from pair where r is not null group by w),
    gone as (
      select best.w, k >> 32 as br, k & 4294967295 as bp, g, npos as gn, nxt as gx
      from best join pair on pair.w = best.w and pos = g)
    select pair.w, pos, case when pos = bp then gn else npos end, (case when pos = bp then br else tok end)::integer,
      (case when pos = bp then gx when npos = bp then br else nxt end)::integer, step + 1
    from pair join gone on pair.w = gone.w where pos <> g))
select w, list(tok order by pos) as ids
from state join (select w, max(step) as step from state group by w) using (w, step) group by w order by w"""

LONG_WORDS = """
with recursive state(w, pos, tok, live, step) as (
  select w, pos, tok, true, 0 from seed
  union all
  select * from (
    with pair as (
      select w, pos, tok, step, lead(tok) over (partition by w order by pos) as nxt,
        row_number() over (partition by w order by pos) as i
      from state where live and step < $steps),
    ranked as (
      select pair.*, r, eager, min(r) over (partition by w) as br from pair left join merges on a = tok and b = nxt),
    best as (
      select *, coalesce(r = br, false) as hit,
        row_number() over (partition by w, coalesce(r = br, false) order by i) as j,
        min(case when r = br then i end) over (partition by w) as leftmost from ranked),
    run as (select *, row_number() over (partition by w, hit, i - j order by i) as place from best),
    chosen as (select *, hit and case when eager then place % 2 = 1 else i = leftmost end as take from run),
    new as (select *, lag(take) over (partition by w order by i) as gone from chosen)
    select w, pos, (case when take then r else tok end)::integer, br is not null, step + 1
    from new where gone is distinct from true))
select w, pos, tok, live
from state join (select w, max(step) as step from state group by w) using (w, step) order by w, pos"""

DECODE = """
select text, unhex(string_agg(piece, '' order by pos)) as bytes
from rows join vocabulary using (id) group by text"""


@dataclass(frozen=True)
class Vocabulary:
    """Tokens with their ranks."""

    tokens: tuple[bytes, ...]
    ranks: tuple[int, ...]


def read_vocabulary(path: str) -> Vocabulary:
    """A file of base64 tokens and ranks."""
    with open(path, "rb") as lines:
        pairs = [line.split() for line in lines if line.strip()]
    if len(pairs) > LARGEST_VOCABULARY:
        raise ValueError(f"{len(pairs)} tokens are more than {LARGEST_VOCABULARY}")
    return Vocabulary(tuple(base64.b64decode(t) for t, _ in pairs), tuple(int(r) for _, r in pairs))


class Coder:
    """The merge table, the vocabulary and the pieces seen so far, and a DuckDB connection while a task runs."""

    def __init__(self, vocabulary: Vocabulary):
        self.rank = dict(zip(vocabulary.tokens, vocabulary.ranks))
        self.bytes = np.array([self.rank[bytes([i])] for i in range(256)], np.int32)
        self.known = np.zeros(max(vocabulary.ranks) + 1, bool)
        self.known[list(vocabulary.ranks)] = True
        parts = [
            (a, b, r)
            for token, r in self.rank.items()
            for i in range(1, len(token))
            if (a := self.rank.get(token[:i])) is not None and (b := self.rank.get(token[i:])) is not None
        ]
        a, b, r = (np.array(x, np.int32) for x in (zip(*parts) if parts else ((), (), ())))
        # the earliest merge that a token takes part in; a token all of whose merges rank after it is eager
        least = np.full(len(self.known), np.iinfo(np.int32).max)
        for side in (a, b):
            np.minimum.at(least, side, r)
        self.merges = pa.table({"a": a, "b": b, "r": r, "eager": least[r] > r})
        self.vocabulary = pa.table(
            {"id": pa.array(vocabulary.ranks, pa.int32()), "piece": [t.hex() for t in vocabulary.tokens]}
        )
        self.db = None
        self.store = PieceStore(self.words, most=REMEMBERED)

    def open(self) -> None:
        import duckdb

        self.db = duckdb.connect(config={"threads": 1, "memory_limit": "300MB"})
        self.db.execute("set preserve_insertion_order = false")
        self.query("create table merges as select * from given", given=self.merges)
        self.query("create table vocabulary as select * from given", given=self.vocabulary)

    def close(self) -> None:
        """Gives back the database's memory; what was learned stays."""
        if self.db is not None:
            self.db.close()
            self.db = None

    def query(self, sql: str, **tables: pa.Table) -> pa.Table | None:
        if self.db is None:
            self.open()
        for name, table in tables.items():
            self.db.register(name, table)
        got = self.db.sql(sql)
        got = got if got is None else got.to_arrow_table()
        for name in tables:
            self.db.unregister(name)
        return got

    def words(self, words: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Ids of different pieces one after another, and how many each has."""
        found: list = [None] * len(words)
        short, long = [], []
        for i, word in enumerate(words):
            raw = word.encode()
            rank = self.rank.get(raw)
            if rank is not None:
                found[i] = (rank,)
            else:
                (short if len(raw) <= LONG else long).append((i, raw))
        at = 0
        while at < len(short):
            upto, size = at, 0
            while upto < len(short) and (upto == at or size + len(short[upto][1]) <= CHUNK_BYTES):
                size += len(short[upto][1])
                upto += 1
            got = self.query(SHORT_WORDS, seed=self._seed([raw for _, raw in short[at:upto]]))
            for (i, _), ids in zip(short[at:upto], got["ids"].to_pylist()):
                found[i] = ids
            at = upto
        for i, raw in long:
            found[i] = self._long(raw)
        sizes = np.fromiter(map(len, found), np.int32, len(found))
        return np.fromiter((x for ids in found for x in ids), np.int32, int(sizes.sum())), sizes

    def _seed(self, words: list[bytes]) -> pa.Table:
        sizes = np.array([len(w) for w in words])
        ends = np.cumsum(sizes)
        pos = np.arange(ends[-1]) - np.repeat(ends - sizes, sizes)
        tokens = self.bytes[np.frombuffer(b"".join(words), np.uint8)]
        return pa.table({"w": np.repeat(np.arange(len(words)), sizes), "pos": pos, "tok": tokens})

    def _long(self, word: bytes) -> np.ndarray:
        state = self._seed([word])
        while True:
            steps = max(1, min(64, 2_000_000 // state.num_rows))
            got = self.query(LONG_WORDS.replace("$steps", str(steps)), seed=state)
            if not got["live"][0].as_py():
                return got["tok"].to_numpy()
            state = got.select(["w", "pos", "tok"])

    def encode(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all texts one after another, and where each text begins."""
        return self.store.encode(texts)

    def decode(self, ids: np.ndarray, first: np.ndarray) -> list[bytes]:
        """Bytes of each text."""
        if len(ids) and not (ids.min() >= 0 and ids.max() < len(self.known) and self.known[ids].all()):
            raise ValueError("ids outside the vocabulary")
        text = np.repeat(np.arange(len(first) - 1), np.diff(first))
        rows = pa.table({"text": text, "pos": np.arange(len(ids)), "id": ids.astype(np.int32)})
        got = self.query(DECODE, rows=rows)
        out = [b""] * (len(first) - 1)
        for i, value in zip(got["text"].to_pylist(), got["bytes"].to_pylist()):
            out[i] = value
        return out


def coder(vocabulary: Vocabulary) -> Coder:
    """One coder a worker process."""
    return hold(("bpe", vocabulary), lambda: Coder(vocabulary))


def _encode(batches, vocabulary) -> Iterator[pa.RecordBatch]:
    with closing(coder(vocabulary.value)) as work:
        for batch in pieces(batches, "text", BLOCK_BYTES):
            ids, first = work.encode(batch.column("text"))
            lists = pa.ListArray.from_arrays(pa.array(first, pa.int32()), pa.array(ids, pa.int32()))
            yield pa.RecordBatch.from_arrays([batch.column("kept"), lists], names=["kept", "ids"])


def _decode(batches, vocabulary) -> Iterator[pa.RecordBatch]:
    with closing(coder(vocabulary.value)) as work:
        for batch in batches:
            sizes = pc.fill_null(pc.list_value_length(batch.column("ids")), 0).to_numpy()
            ends = np.concatenate([[0], np.cumsum(sizes)])
            at = 0
            while at < batch.num_rows:  # some 300,000 ids at a time
                upto = max(at + 1, int(np.searchsorted(ends, ends[at] + 300_000, "right")) - 1)
                part = batch.slice(at, upto - at)
                flat = part.column("ids").flatten().to_numpy(zero_copy_only=False)
                out = work.decode(flat, ends[at : at + part.num_rows + 1] - ends[at])
                columns = [*(part.column(c) for c in part.schema.names), pa.array(out, pa.binary())]
                yield pa.RecordBatch.from_arrays(columns, names=[*part.schema.names, "decoded"])
                at += part.num_rows


def encode(
    docs: DataFrame, vocabulary: Vocabulary, *, text: str = "text", keep: tuple[str, ...] = ("doc_id",)
) -> DataFrame:
    """`kept` (a struct of the columns `keep`) and `ids` of every text."""
    shared = docs.sparkSession.sparkContext.broadcast(vocabulary)
    rows = docs.select(F.struct(*[F.col(f"`{c}`") for c in keep]).alias("kept"), F.col(f"`{text}`").alias("text"))
    schema = StructType([*rows.select("kept").schema, *StructType.fromDDL("ids array<int>")])
    return rows.mapInArrow(lambda b: _encode(b, shared), schema)


def decode(encoded: DataFrame, vocabulary: Vocabulary) -> DataFrame:
    """Adds `decoded`, the bytes of the column `ids`."""
    shared = encoded.sparkSession.sparkContext.broadcast(vocabulary)
    schema = StructType([*encoded.schema, *StructType.fromDDL("decoded binary")])
    return encoded.mapInArrow(lambda b: _decode(b, shared), schema)


def round_trip(
    docs: DataFrame, vocabulary: Vocabulary, *, text: str = "text", keep: tuple[str, ...] = ("doc_id",)
) -> DataFrame:
    """What `decode` gives for `encode`, by one worker a task: two of them would hold a coder each."""
    shared = docs.sparkSession.sparkContext.broadcast(vocabulary)
    rows = docs.select(F.struct(*[F.col(f"`{c}`") for c in keep]).alias("kept"), F.col(f"`{text}`").alias("text"))
    schema = StructType([*rows.select("kept").schema, *StructType.fromDDL("ids array<int>, decoded binary")])
    return rows.mapInArrow(lambda b: _decode(_encode(b, shared), shared), schema)


def digest(docs: DataFrame, vocabulary: Vocabulary) -> DataFrame:
    """Per document the number of ids, and digests of the ids and of the decoded bytes."""
    return round_trip(docs, vocabulary).select(
        "kept.doc_id",
        F.size("ids").cast("bigint").alias("n_tokens"),
        F.sha2(F.array_join(F.col("ids").cast("array<string>"), ",").cast("binary"), 256).alias("ids_sha256"),
        F.sha2("decoded", 256).alias("decoded_sha256"),
    )
