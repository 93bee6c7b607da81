"""Words of many texts at once, as numpy arrays over the bytes of an Arrow block.

Both word classes in use keep every non-ASCII byte inside words, so words can be cut on bytes. A word is
named by a 64-bit hash of its lower-cased bytes and its length.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

MASK_SPACE = np.ones(256, bool)
MASK_SPACE[[0x20, *range(0x09, 0x0E)]] = False
MASK_ALNUM = np.ones(256, bool)
MASK_ALNUM[[*range(0x00, 0x30), *range(0x3A, 0x61), *range(0x7B, 0x80)]] = False
#: A-Z become a-z before the class is applied.
LOWER = np.arange(256, dtype=np.uint8)
LOWER[0x41:0x5B] += 0x20

_A, _B, _C = (np.uint64(x) for x in (0x9E3779B97F4A7C15, 0xBF58476D1CE4E5B9, 0x94D049BB133111EB))
_TAIL = np.array([(1 << (8 * i)) - 1 for i in range(8)] + [2**64 - 1], dtype=np.uint64)


def mix(x: np.ndarray) -> np.ndarray:
    """Finalizer that spreads 64 bits."""
    x = (x ^ (x >> np.uint64(30))) * _B
    x = (x ^ (x >> np.uint64(27))) * _C
    return x ^ (x >> np.uint64(31))


def kept_and_text(docs: DataFrame, keep: tuple[str, ...], text: str):
    """The columns `keep` as the struct `kept`, with `text` beside it only if it is not kept anyway; and a function
    that finds the text in a batch of these rows."""
    rows = docs.select(F.struct(*[F.col(f"`{c}`") for c in keep]).alias("kept"), F.col(f"`{text}`").alias("text"))
    if text not in keep:
        return rows, lambda batch: batch.column("text")
    at = keep.index(text)
    return rows.select("kept"), lambda batch: pc.struct_field(batch.column("kept"), [at])


def pieces(batches, column, max_bytes: int = 2 << 20) -> Iterator[pa.RecordBatch]:
    """Slices of the batches with at most `max_bytes` of text each; a longer text is alone in its slice.

    `column` is the text's name, or a function of the batch.
    """
    for batch in batches:
        if not batch.num_rows:
            continue
        ends = text_offsets(column(batch) if callable(column) else batch.column(column))[1]
        at = 0
        while at < batch.num_rows:
            upto = int(np.searchsorted(ends, ends[at] + max_bytes, "right")) - 1
            upto = max(at + 1, min(upto, batch.num_rows))
            yield batch.slice(at, upto - at)
            at = upto


def text_offsets(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """UTF-8 bytes of all texts one after another, and where each begins; NULL is an empty text."""
    column = column.cast(pa.large_string())
    if column.null_count:
        column = column.fill_null("")
    _, offsets, data = column.buffers()
    ends = np.frombuffer(offsets, np.int64)[column.offset : column.offset + len(column) + 1]
    whole = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
    return whole[ends[0] : ends[-1]], ends - ends[0]


@dataclass
class Words:
    """Words of a block: where each starts and ends in `data`, its hash, and the first word of each text."""

    data: np.ndarray
    starts: np.ndarray
    ends: np.ndarray
    first: np.ndarray
    hashes: np.ndarray


def word_spans(data: np.ndarray, offsets: np.ndarray, inside: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Lower-cased bytes, and where each maximal run of bytes in class `inside` begins and ends, never across texts."""
    low = LOWER[data]
    within = inside[low]
    starts, ends = within.copy(), within.copy()
    if len(within):
        starts[1:] &= ~within[:-1]
        ends[:-1] &= ~within[1:]
        cuts = offsets[(offsets > 0) & (offsets < len(low))]
        starts[cuts] = within[cuts]
        ends[cuts - 1] = within[cuts - 1]
    return low, np.flatnonzero(starts), np.flatnonzero(ends) + 1


def find_words(data: np.ndarray, offsets: np.ndarray, inside: np.ndarray) -> Words:
    """The words of the class, each with its hash."""
    low, starts, ends = word_spans(data, offsets, inside)
    return Words(low, starts, ends, np.searchsorted(starts, offsets), hash_spans(low, starts, ends))


def hash_spans(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """64-bit hashes of byte spans, eight bytes at a time."""
    padded = np.concatenate([data, np.zeros(8, np.uint8)])
    eights = np.ndarray((len(padded) - 7,), "<u8", padded, strides=(1,))
    left = ends - starts
    with np.errstate(over="ignore"):
        hashes = mix(left.astype(np.uint64) * _A)
        rows, at = np.arange(len(starts)), starts
        while len(rows):
            part = eights[at] & _TAIL[np.minimum(left, 8)]
            hashes[rows] = mix((hashes[rows] ^ part) * _A)
            more = left > 8
            rows, at, left = rows[more], at[more] + 8, left[more] - 8
    return hashes


def first_bytes(data: np.ndarray, starts: np.ndarray, ends: np.ndarray, n: int) -> np.ndarray:
    """The first n bytes of spans, 7 at most, as numbers whose highest byte says how many there are."""
    padded = np.concatenate([data, np.zeros(8, np.uint8)])
    eights = np.ndarray((len(padded) - 7,), "<u8", padded, strides=(1,))
    size = np.minimum(ends - starts, n)
    return eights[starts] & _TAIL[size] | size.astype(np.uint64) << np.uint64(56)


def chained(hashes: np.ndarray, n: int) -> np.ndarray:
    """Hash of the n values from each position on; the array is n - 1 shorter."""
    count = max(0, len(hashes) - n + 1)
    with np.errstate(over="ignore"):
        out = np.full(count, _C, np.uint64)
        for i in range(n):
            out = mix((out ^ hashes[i : i + count]) * _A + np.uint64(i))
    return out
