"""BPE against the tiktoken library."""

import hashlib

import public_tokenizers
import pyarrow as pa
import pytest
import tiktoken

import plain
from granulake.llm import bpe
from granulake.llm.q_bpe import op1, vocabulary


@pytest.fixture(scope="module")
def library():
    v = vocabulary()
    return tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=dict(zip(v.tokens, v.ranks)), special_tokens={})


@pytest.fixture(scope="module")
def coder():
    return bpe.Coder(vocabulary())


def expected(library, text):
    ids = library.encode_ordinary(text or "")
    return len(ids), hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest(), hashlib.sha256((text or "").encode()).hexdigest()


def test_ids_are_those_of_the_library(coder, library):
    texts = [t for _, t, *_ in plain.odd_rows()] + ["=" * 333, "ab" * 999, "don't I'LL ''s 're", "<|endoftext|>", "日本" * 300, " \n\n  x"]
    ids, first = coder.encode(pa.array(texts, pa.string()))
    for text, a, b in zip(texts, first, first[1:]):
        assert ids[a:b].tolist() == library.encode_ordinary(text or "")
    assert coder.decode(ids, first) == [(t or "").encode() for t in texts]


def test_long_pieces_take_bounded_rounds(coder, library):
    word = "acgt" * 40 + plain.prose(5, 400).replace(" ", "")
    assert coder._long(word.encode()).tolist() == library.encode_ordinary(word)


def test_unknown_ids_are_an_error(coder):
    import numpy as np

    with pytest.raises(ValueError):
        coder.decode(np.array([10**6]), np.array([0, 1]))


def test_every_document_of_the_table(spark, texts, library):
    from plain import SF

    got = {r.doc_id: tuple(r)[1:] for r in op1(spark, SF).collect()}
    assert got == {i: expected(library, t) for i, t in texts}


def test_odd_rows(odd, none, library):
    got = sorted(map(tuple, bpe.digest(odd, vocabulary()).collect()), key=str)
    assert got == sorted(((i, *expected(library, t)) for i, t, *_ in plain.odd_rows()), key=str)
    assert bpe.digest(none, vocabulary()).count() == 0


def test_null_ids_decode_to_nothing(spark):
    rows = spark.createDataFrame([(1, None), (2, [])], "k int, ids array<int>")
    assert [r.decoded for r in bpe.decode(rows, vocabulary()).collect()] == [b"", b""]


def test_a_task_needs_one_worker_for_both_ways(spark):
    docs = spark.createDataFrame([(1, "one two"), (2, None)], "doc_id long, text string")
    plan = bpe.digest(docs, vocabulary())._jdf.queryExecution().sparkPlan().toString()
    assert plan.count("MapInArrow") == 1  # before: two, each with a coder in a worker of its own
    both, apart = (bpe.round_trip(docs, vocabulary()), bpe.decode(bpe.encode(docs, vocabulary()), vocabulary()))
    assert both.schema == apart.schema and sorted(both.collect()) == sorted(apart.collect())
