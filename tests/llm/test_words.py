"""Words and pieces of texts against the patterns they stand for."""

import numpy as np
import pyarrow as pa
import public_tokenizers
import regex
from hypothesis import given, settings
from hypothesis import strategies as st

import plain
from granulake.llm.pretokens import find_pieces
from granulake.llm.words import MASK_ALNUM, MASK_SPACE, chained, find_words, pieces, text_offsets

TEXTS = st.lists(st.none() | st.text(st.sampled_from("aBé日'stvrel01² \n\t\x0b\x00\x1c\x85.#\U0001f600"), max_size=40), max_size=6)


@settings(max_examples=200, deadline=None)
@given(TEXTS)
def test_words_are_those_of_the_classes(texts):
    for inside, pattern in ((MASK_SPACE, plain.SPACE_WORDS), (MASK_ALNUM, plain.ALNUM_WORDS)):
        words = find_words(*text_offsets(pa.array(texts, pa.string())), inside)
        got = [words.data[a:b].tobytes().decode() for a, b in zip(words.starts, words.ends)]
        expected = [pattern.findall(plain.low(t)) for t in texts]
        assert got == [w for some in expected for w in some]
        assert np.diff(words.first).tolist() == [len(w) for w in expected]
        assert len(set(words.hashes.tolist())) == len(set(got))


@settings(max_examples=300, deadline=None)
@given(TEXTS)
def test_pieces_are_those_of_the_pattern(texts):
    data, begins, ends, first = find_pieces(pa.array(texts, pa.string()))
    raw = data.tobytes()
    got = [raw[a:b].decode() for a, b in zip(begins, ends)]
    expected = [regex.findall(public_tokenizers.PATTERN, t or "") for t in texts]
    assert got == [w for some in expected for w in some]
    assert np.diff(first).tolist() == [len(w) for w in expected]


def test_chained_hashes_follow_the_values():
    values = np.array([1, 2, 3, 1, 2, 3, 4], np.uint64)
    got = chained(values, 3)
    assert len(got) == 5 and got[0] == got[3] and len(set(got.tolist())) == 4
    assert len(chained(values[:2], 3)) == 0


def test_slices_hold_every_row_once():
    batch = pa.RecordBatch.from_arrays([pa.array(range(6)), pa.array(["a" * 5, None, "", "b" * 50, "c", "d"])], names=["i", "text"])
    got = [s.column("i").to_pylist() for s in pieces([batch, batch.slice(0, 0)], "text", 8)]
    assert [i for s in got for i in s] == list(range(6)) and [3] in got
