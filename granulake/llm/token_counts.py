"""Numbers of tokens, without the tokens: byte-pair merging on a heap and a linked list.

A text is cut at the strings of added tokens (one token each) and into the pieces that the tokenizer merges separately.
Every different piece is merged once a worker: its bytes are a linked list of symbols, its adjacent pairs stand on a
heap by (rank, place), and the smallest is popped until none is left; an entry whose pair has changed meanwhile is
passed over. A piece has as many tokens as bytes less merges, so a count is all that is kept of it, by the piece's 64-bit
hash. A piece of n bytes takes about n log n steps, so a megabyte without a blank is no special case.

Texts are worked on in stretches of some `STRETCH` bytes, cut only in front of a blank that follows a letter, a number or
another sign, where a piece begins whatever stands around it. So memory follows the stretch and the longest
piece, not the text.

The tokenizer file must be a byte-level BPE with the usual splitter, and without a normalizer, truncation, padding, a prefix space
or dropout; others are refused. Its merge table and the classes of all code points travel in a broadcast of at most
`LARGEST` merges.

Defined results: a NULL or empty text has no bytes and no tokens; equal rows each get a row; other columns are ignored.
"""

from __future__ import annotations

import json
import re
from collections.abc import Iterator
from dataclasses import dataclass
from heapq import heapify, heappop, heappush

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import LongType, StructField, StructType

from granulake.llm.pretokens import find_pieces, library_classes
from granulake.llm.words import hash_spans, kept_and_text, pieces, text_offsets
from granulake.llm.workers import hold

STRETCH = 1 << 20
REMEMBERED = 2_000_000
LARGEST = 1_000_000
_BITS = 20  # of a symbol
_PLACE = (1 << 40) - 1

#: What surely is no blank when it stands before one: visible ASCII, and last bytes that no blank's UTF-8 form has.
_SOLID = np.zeros(256, bool)
_SOLID[0x21:0x7F] = True
_SOLID[0xB0:0xC0] = True


@dataclass(frozen=True)
class MergeTable:
    """Symbol of each byte; left, right and made symbol of each merge by rank; code point classes; added tokens."""

    first: bytes
    merges: bytes
    classes: bytes
    added: tuple[bytes, ...]


def _alphabet() -> list[str]:
    """The character that stands for each byte in the file: visible Latin-1 as it is, the rest from 256 on."""
    seen = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    rest = [b for b in range(256) if b not in seen]
    names = {b: chr(b) for b in seen} | {b: chr(256 + i) for i, b in enumerate(rest)}
    return [names[b] for b in range(256)]


def load_merges(path: str) -> MergeTable:
    from tokenizers import Tokenizer as Library

    with open(path, encoding="utf-8") as file:
        text = file.read()
    spec = json.loads(text)
    model, splitter = spec["model"], spec["pre_tokenizer"] or {}
    plain = not any(spec.get(k) for k in ("normalizer", "truncation", "padding"))
    plain &= model["type"] == "BPE" and not any(
        model.get(k) for k in ("dropout", "unk_token", "continuing_subword_prefix", "end_of_word_suffix", "ignore_merges")
    )
    plain &= splitter.get("type") == "ByteLevel" and splitter.get("use_regex", True) and not splitter.get("add_prefix_space")
    plain &= not any(t["lstrip"] or t["rstrip"] or t["single_word"] for t in spec["added_tokens"])
    if not plain:
        raise ValueError("not a plain byte-level BPE")
    if len(model["merges"]) > LARGEST:
        raise ValueError(f"{len(model['merges'])} merges are more than {LARGEST}")
    symbols = model["vocab"]
    merges = [m.split(" ") if isinstance(m, str) else m for m in model["merges"]]
    made = np.array([(symbols[a], symbols[b], symbols[a + b]) for a, b in merges], np.int32).reshape(-1, 3)
    first = np.array([symbols[c] for c in _alphabet()], np.int32)
    library = Library.from_str(text)
    split = lambda s: [span for _, span in library.pre_tokenizer.pre_tokenize_str(s)]
    added = tuple(t["content"].encode() for t in spec["added_tokens"])
    return MergeTable(first.tobytes(), made.tobytes(), library_classes(split).tobytes(), added)


class Counter:
    """Counts the tokens of pieces and texts; remembers at most `REMEMBERED` pieces."""

    def __init__(self, table: MergeTable):
        self.first = np.frombuffer(table.first, np.int32).tolist()
        merges = np.frombuffer(table.merges, np.int32).reshape(-1, 3).astype(np.int64)
        pairs = (merges[:, 0] << _BITS) | merges[:, 1]
        self.rank = {pair: rank for rank, pair in enumerate(pairs.tolist())}
        self.made = merges[:, 2].tolist()
        self.classes = np.frombuffer(table.classes, np.uint8)
        longest_first = sorted(table.added, key=lambda t: (-len(t), t))
        self.added = re.compile(b"|".join(map(re.escape, longest_first))) if table.added else None
        self.forget()

    def forget(self) -> None:
        self.keys, self.sizes = np.zeros(0, np.uint64), np.zeros(0, np.int64)

    def piece(self, piece: bytes) -> int:
        """Number of tokens of one piece."""
        n = len(piece)
        symbol = [self.first[b] for b in piece]
        after, before = list(range(1, n + 1)), list(range(-1, n - 1))
        rank, made = self.rank, self.made
        heap = []
        for i in range(n - 1):
            r = rank.get(symbol[i] << _BITS | symbol[i + 1])
            if r is not None:
                heap.append(r << 40 | i)
        heapify(heap)
        count = n
        while heap:
            entry = heappop(heap)
            r, i = entry >> 40, entry & _PLACE
            j = after[i]
            # merged away, or another pair by now
            if symbol[i] < 0 or j >= n or rank.get(symbol[i] << _BITS | symbol[j]) != r:
                continue
            symbol[i], symbol[j] = made[r], -1
            k = after[i] = after[j]
            count -= 1
            if k < n:
                before[k] = i
                r = rank.get(symbol[i] << _BITS | symbol[k])
                if r is not None:
                    heappush(heap, r << 40 | i)
            k = before[i]
            if k >= 0:
                r = rank.get(symbol[k] << _BITS | symbol[i])
                if r is not None:
                    heappush(heap, r << 40 | k)
        return count

    def _stretch(self, column: pa.Array) -> np.ndarray:
        """Number of tokens of each text, added tokens aside."""
        data, begins, ends, first = find_pieces(column, self.classes)
        different, at, place = np.unique(hash_spans(data, begins, ends), return_index=True, return_inverse=True)
        if len(self.keys) + len(different) > REMEMBERED:
            self.forget()
        where = np.searchsorted(self.keys, different)
        known = where < len(self.keys)
        known[known] = self.keys[where[known]] == different[known]
        new = np.flatnonzero(~known)
        if len(new):
            raw = data.tobytes()
            counts = [self.piece(raw[a:b]) for a, b in zip(begins[at[new]].tolist(), ends[at[new]].tolist())]
            self.keys = np.insert(self.keys, where[new], different[new])
            self.sizes = np.insert(self.sizes, where[new], counts)
            where = np.searchsorted(self.keys, different)
        sums = np.concatenate([[0], np.cumsum(self.sizes[where][place])])
        return sums[first[1:]] - sums[first[:-1]]

    def texts(self, column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """Number of bytes and of tokens of each text."""
        data, offsets = text_offsets(column)
        marks, special = [offsets], np.zeros((0, 2), np.int64)
        if self.added is not None:
            special = np.array([m.span() for m in self.added.finditer(data.tobytes())], np.int64).reshape(-1, 2)
            inside = np.searchsorted(offsets, special[:, 0], "right") == np.searchsorted(offsets, special[:, 1], "left")
            special = special[inside] if inside.all() else self._one_by_one(data, offsets)
            marks.append(special.ravel())
        if len(data) > STRETCH:
            blank = np.flatnonzero((data[1:] == 0x20) | (data[1:] == 0x0A)) + 1
            blank = blank[_SOLID[data[blank - 1]]]
            if len(special):  # never inside an added token
                blank = blank[np.searchsorted(special[:, 0], blank, "left") == np.searchsorted(special[:, 1], blank, "right")]
            wanted = np.searchsorted(blank, np.arange(STRETCH, len(data), STRETCH))
            marks.append(blank[wanted[wanted < len(blank)]])
        cuts = np.unique(np.concatenate(marks))
        counts = np.zeros(max(0, len(cuts) - 1), np.int64)
        at = 0
        while at < len(counts):
            upto = max(at + 1, int(np.searchsorted(cuts, cuts[at] + STRETCH, "right")) - 1)
            counts[at:upto] = self._stretch(_strings(data, cuts[at : upto + 1]))
            at = upto
        counts[np.searchsorted(cuts, special[:, 0])] = 1
        sums = np.concatenate([[0], np.cumsum(counts)])[np.searchsorted(cuts, offsets)]
        return np.diff(offsets), np.diff(sums)

    def _one_by_one(self, data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
        """Spans of added tokens, looked for in each text alone: where texts meet, their ends may look like one."""
        found = []
        for a, b in zip(offsets.tolist(), offsets[1:].tolist()):
            found += [(a + m.start(), a + m.end()) for m in self.added.finditer(data[a:b].tobytes())]
        return np.array(found, np.int64).reshape(-1, 2)


def _strings(data: np.ndarray, cuts: np.ndarray) -> pa.Array:
    """The texts between the cuts, without a copy."""
    part = np.ascontiguousarray(data[cuts[0] : cuts[-1]])
    ends = np.ascontiguousarray(cuts - cuts[0], np.int64)
    return pa.LargeStringArray.from_buffers(len(cuts) - 1, pa.py_buffer(ends), pa.py_buffer(part))


def _counter(table: MergeTable) -> Counter:
    """One counter a worker process."""
    return hold(("token counts", table), lambda: Counter(table))


def _count(batches, shared, text) -> Iterator[pa.RecordBatch]:
    counter = _counter(shared.value)
    for batch in pieces(batches, text, 4 * STRETCH):
        n_bytes, n_tokens = counter.texts(text(batch))
        yield pa.RecordBatch.from_arrays(
            [batch.column("kept"), pa.array(n_bytes), pa.array(n_tokens)], names=["kept", "n_bytes", "n_tokens"]
        )


def count_tokens(
    docs: DataFrame,
    table: MergeTable,
    *,
    limit: int = 1024,
    text: str = "text",
    keep: tuple[str, ...] = ("doc_id",),
) -> DataFrame:
    """`kept` (a struct of the columns `keep`), n_bytes, n_tokens and whether a text has more than `limit` tokens."""
    shared = docs.sparkSession.sparkContext.broadcast(table)
    rows, column = kept_and_text(docs, keep, text)
    numbers = [StructField(c, LongType()) for c in ("n_bytes", "n_tokens")]
    out = rows.mapInArrow(lambda b: _count(b, shared, column), StructType([rows.schema["kept"], *numbers]))
    return out.withColumn("over_limit", F.col("n_tokens") > limit)
