"""The pieces that a byte-level BPE encodes separately, for many texts at once.

The usual pattern (contractions, letters, numbers, other signs, each with a space before, and blanks) is applied to
arrays of character classes; `tests/llm` hold it against the pattern itself.
"""

from __future__ import annotations

from functools import lru_cache

import numpy as np
import pyarrow as pa

from granulake.llm.words import hash_spans, text_offsets

_SPACE, _LETTER, _NUMBER, _OTHER = range(4)


def library_classes(split) -> np.ndarray:
    """Class of every code point as a library sees it whose Unicode tables may be of another year.

    `split` gives the (start, end) of the pieces of a text. A character is of a probe's class when it makes one piece
    with the probe; what goes with no probe is a blank.
    """
    out = classes().copy()
    points = np.flatnonzero((out != _OTHER) | _assigned())
    points = points[points > 0x7F]
    seen = np.full(len(points), _SPACE, np.uint8)
    for kind, probe in ((_LETTER, "a"), (_NUMBER, "1"), (_OTHER, "!")):
        ends = {a: b for a, b in split("".join(f"{probe}{chr(c)}\n" for c in points))}
        seen[[i for i in range(len(points)) if ends.get(3 * i, 0) >= 3 * i + 2]] = kind
    out[points] = seen
    return out


def _assigned() -> np.ndarray:
    import regex

    out = np.zeros(0x110000, bool)
    points = [c for c in range(0x110000) if not 0xD800 <= c < 0xE000]
    out[[ord(c) for c in regex.findall(r"[\p{P}\p{S}\p{M}\p{Zl}\p{Zp}\p{Cf}]", "".join(map(chr, points)))]] = True
    return out


@lru_cache(maxsize=1)
def classes() -> np.ndarray:
    """Class of every code point."""
    import regex

    points = np.array([c for c in range(0x110000) if not 0xD800 <= c < 0xE000], np.int64)
    every = "".join(map(chr, points))
    out = np.full(0x110000, _OTHER, np.uint8)
    for kind, pattern in ((_LETTER, r"\p{L}+"), (_NUMBER, r"\p{N}+"), (_SPACE, r"\s+")):
        for run in regex.finditer(pattern, every):
            out[points[run.start() : run.end()]] = kind
    return out


def find_pieces(
    column: pa.Array, table: np.ndarray | None = None
) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """UTF-8 bytes of all texts, start and end of every piece in them, and the first piece of each text.

    `table` holds the class of each code point.
    """
    data, offsets = text_offsets(column)
    if not len(data):
        return data, np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(len(offsets), np.int64)
    point = np.frombuffer(data.tobytes().decode().encode("utf-32-le"), np.uint32)
    lead = np.flatnonzero((data & 0xC0) != 0x80)
    kind = (classes() if table is None else table)[point]
    first = np.searchsorted(lead, offsets)
    opens = np.zeros(len(point) + 1, bool)  # the first character of each text, and the end
    opens[first] = True
    blank = kind == _SPACE
    changed = np.ones(len(point), bool)
    changed[1:] = (kind[1:] != kind[:-1]) | opens[1:-1]
    after_space = np.zeros(len(point), bool)
    after_space[1:] = (point[:-1] == 0x20) & ~opens[1:-1]
    word_next = np.zeros(len(point), bool)  # a word of the same text follows
    word_next[:-1] = ~blank[1:] & ~opens[1:-1]
    starts = changed & (blank | ~after_space) | blank & word_next
    _contract(point, kind, opens, starts)
    at = np.flatnonzero(starts)
    begins = lead[at]
    return data, begins, np.append(begins[1:], len(data)), np.searchsorted(at, first)


def _contract(point: np.ndarray, kind: np.ndarray, opens: np.ndarray, starts: np.ndarray) -> None:
    """'s 't 'm 'd 're 've 'll are pieces of their own where a piece begins with the apostrophe."""
    at = np.flatnonzero(starts & (point == 0x27))
    if not len(at):
        return
    size = len(point)
    padded = np.append(point, [0, 0, 0])
    inside = [at + 1 < size, at + 2 < size]
    inside[0] &= ~opens[np.minimum(at + 1, size)]
    inside[1] &= inside[0] & ~opens[np.minimum(at + 2, size)]
    one, two = padded[at + 1], padded[at + 2]
    short = inside[0] & np.isin(one, [ord(c) for c in "stmd"])
    long = inside[1] & np.logical_or.reduce([(one == ord(a)) & (two == ord(b)) for a, b in ("re", "ve", "ll")])
    for some, length in ((at[short], 2), (at[long], 3)):
        starts[some + 1] = False
        rest = some + length
        rest = rest[rest < size]
        rest = rest[~opens[rest] & (kind[rest] == _LETTER)]
        starts[rest] = True


class PieceStore:
    """Ids of the pieces seen so far, by 64-bit hash; at most `most` pieces are remembered.

    `encode_words` gives the ids of each of a list of different pieces.
    """

    def __init__(self, encode_words, table: np.ndarray | None = None, most: int = 1_000_000):
        self.encode_words, self.table, self.most = encode_words, table, most
        self.forget()

    def forget(self) -> None:
        self.keys = np.zeros(0, np.uint64)
        self.starts = self.sizes = np.zeros(0, np.int32)
        self.flat, self.used = np.zeros(1 << 16, np.int32), 0

    def learn(self, keys: np.ndarray, words: list[str]) -> None:
        """Ids of new pieces; the keys are ascending."""
        ids, sizes = self.encode_words(words)
        starts = (self.used + np.cumsum(sizes) - sizes).astype(np.int32)
        while self.used + len(ids) > len(self.flat):
            self.flat = np.concatenate([self.flat, np.zeros_like(self.flat)])
        self.flat[self.used : self.used + len(ids)] = ids
        self.used += len(ids)
        at = np.searchsorted(self.keys, keys)
        self.keys = np.insert(self.keys, at, keys)
        self.starts, self.sizes = np.insert(self.starts, at, starts), np.insert(self.sizes, at, sizes)

    def encode(self, column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all texts one after another, and where each text begins."""
        data, begins, ends, first = find_pieces(column, self.table)
        hashes = hash_spans(data, begins, ends)
        different, at, place = np.unique(hashes, return_index=True, return_inverse=True)
        if len(self.keys) + len(different) > self.most:
            self.forget()
        where = np.searchsorted(self.keys, different)
        known = np.zeros(len(different), bool)
        inside = where < len(self.keys)
        known[inside] = self.keys[where[inside]] == different[inside]
        new = np.flatnonzero(~known)
        if len(new):
            raw = data.tobytes()
            self.learn(different[new], [raw[a:b].decode() for a, b in zip(begins[at[new]], ends[at[new]])])
            where = np.searchsorted(self.keys, different)
        sizes = self.sizes[where].astype(np.int64)[place]
        last = np.cumsum(sizes)
        total = int(last[-1]) if len(last) else 0
        ids = self.flat[np.repeat(self.starts[where][place] - (last - sizes), sizes) + np.arange(total)]
        return ids, np.concatenate([[0], last])[first]
