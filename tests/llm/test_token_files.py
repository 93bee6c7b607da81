"""Token files: code lengths, bit streams, and whole tables against the tokenizers library."""

import zlib

import numpy as np
import public_tokenizers
import pyarrow as pa
import pytest
from tokenizers import Tokenizer

import plain
from granulake.llm import token_files as files
from granulake.llm.q_token_files import END, op5
from granulake.session import scratch

PATH = public_tokenizers.path("byte_bpe_50k.json")


@pytest.fixture(scope="module")
def tokenizer():
    return files.load_tokenizer(PATH, END)


@pytest.fixture(scope="module")
def library():
    return Tokenizer.from_file(PATH)


def ids_of(library, text):
    return [*library.encode(text or "", add_special_tokens=False).ids, END]


def expected(library, rows):
    out, at = [], 0
    for i, t in rows:
        ids = np.array(ids_of(library, t), "<u4")
        out.append((i, at, len(ids), zlib.crc32(ids.tobytes())))
        at += len(ids)
    return out


def optimal(counts):
    """Total length of an unlimited Huffman code."""
    heap, total = sorted(counts), 0
    while len(heap) > 1:
        a, b = heap.pop(0), heap.pop(0)
        total += a + b
        heap = sorted([*heap, a + b])
    return total


def test_code_lengths():
    rng = np.random.default_rng(2)
    for n in (2, 3, 17, 200):
        counts = rng.integers(1, 1000, n)
        lengths = files.code_lengths(counts, 18)
        assert (lengths * counts).sum() == optimal(counts.tolist())
        assert (0.5 ** lengths.astype(float)).sum() == 1
    steep = files.code_lengths(np.array([2**k for k in range(30)]), 6)
    assert steep.max() <= 6 and (0.5 ** steep.astype(float)).sum() <= 1
    assert files.code_lengths(np.array([5]), 18).tolist() == [1]
    with pytest.raises(ValueError):
        files.code_lengths(np.ones(5), 2)


def test_bit_streams_from_any_checkpoint():
    rng = np.random.default_rng(3)
    ids = rng.zipf(1.5, 5000).clip(1, 40_000)
    some, counts = np.unique(ids, return_counts=True)
    code = files.Code(some, files.code_lengths(counts, files.LIMIT))
    codes, bits = code.encoder()
    length = bits[ids]
    at = np.cumsum(length) - length
    payload = files.pack_bits(codes[ids], length, at, (int(length.sum()) + 7) // 8).tobytes()
    sizes = np.array([1000, 1, 2999, 1000])
    starts = at[np.cumsum(sizes) - sizes]
    assert (files.unpack_bits(payload, starts, sizes, code.decoder()) == ids).all()
    assert len(files.pack_bits(codes[:0], bits[:0], at[:0], 0)) == 0


def test_ids_are_those_of_the_library(tokenizer, library):
    texts = [t for _, t, *_ in plain.odd_rows()] + ["<|endoftext|>", "a <|endoftext|>b", "don't", "՘ ꟢x"]
    got = files.Ids(tokenizer).documents(pa.array(texts, pa.string()), END)
    assert [g.tolist() for g in got] == [ids_of(library, t) for t in texts]


def test_every_document_of_the_table(spark, texts, library):
    from plain import SF

    assert sorted(map(tuple, op5(spark, SF).collect())) == expected(library, texts)


def test_odd_rows(spark, odd, none, tokenizer, library):
    path = scratch(spark, "files")
    files.write(files.tokenize(odd, tokenizer), path)
    got = files.read(spark, path).orderBy("start").collect()
    assert [r.start for r in got] == np.cumsum([0, *(r.n_tokens for r in got[:-1])]).tolist()
    keys = [(r.doc_id is not None, r.doc_id or 0) for r in got]
    assert keys == sorted(keys)
    back = sorted((str(r.doc_id), np.frombuffer(r.ids, "<u4").tolist()) for r in got)
    assert back == sorted((str(r[0]), ids_of(library, r[1])) for r in plain.odd_rows())
    path = scratch(spark, "files")
    files.write(files.tokenize(none, tokenizer), path)
    assert files.read(spark, path).count() == 0
