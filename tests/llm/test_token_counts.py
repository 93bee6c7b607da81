"""Token counts against the tokenizers library."""

import json
import random

import public_tokenizers
import pyarrow as pa
import pytest
from tokenizers import Tokenizer

import plain
from granulake.llm import token_counts as counts
from granulake.llm.q_token_counts import op12
from plain import SF

PATH = public_tokenizers.path("byte_bpe_50k.json")


@pytest.fixture(scope="module")
def table():
    return counts.load_merges(PATH)


@pytest.fixture(scope="module")
def library():
    return Tokenizer.from_file(PATH)


def numbers(library, text):
    return len((text or "").encode()), len(library.encode(text or "", add_special_tokens=False).ids)


def check(table, library, texts):
    n_bytes, n_tokens = counts.Counter(table).texts(pa.array(texts, pa.string()))
    assert list(zip(n_bytes.tolist(), n_tokens.tolist())) == [numbers(library, t) for t in texts]


def test_odd_texts(table, library):
    check(table, library, [t for _, t, *_ in plain.odd_rows()])
    check(table, library, [])
    check(table, library, [None, "", None])


def test_added_tokens(table, library):
    mark = "<|endoftext|>"
    check(table, library, [mark, f"a {mark} b", f"{mark}{mark}", f" {mark} ", "<|endoftext|", "|>", "<|endof", "text|>", f"x{mark}"])


def test_blanks_signs_and_scripts(table, library):
    rng = random.Random(5)
    signs = ["a", "Word", "'s", "'ll", "'", " ", "  ", "\n", "\t", "\r\n", " ", "　", " ", "1", "٣", "é", "日本", "😀", "ß", "!", "…", "́"]
    check(table, library, ["".join(rng.choices(signs, k=rng.randrange(1, 60))) for _ in range(3000)])


def test_stretches_change_nothing(table, library, monkeypatch):
    rng = random.Random(6)
    texts = ["".join(rng.choices(["ab", " ", "\n", "日", "　", "<|endoftext|>", "x" * 30, "1", "."], k=400)) for _ in range(40)]
    monkeypatch.setattr(counts, "STRETCH", 64)
    check(table, library, texts)


def test_long_runs_without_blanks(table, library):
    rng = random.Random(7)
    check(table, library, ["".join(rng.choices("acgt", k=300_000)), "a" * 200_000, "日本語" * 30_000])


def test_forgotten_pieces_are_counted_again(table, library, monkeypatch):
    monkeypatch.setattr(counts, "REMEMBERED", 3)
    counter = counts.Counter(table)
    for text in ("one two three four", "two five", "one two three four"):
        assert counter.texts(pa.array([text]))[1].tolist() == [numbers(library, text)[1]]


def test_one_counter_for_many_texts(table, library):
    counter = counts.Counter(table)
    for seed in range(30):
        text = plain.prose(seed, 3)
        assert counter.texts(pa.array([text]))[1].tolist() == [numbers(library, text)[1]]


def test_other_tokenizers_are_refused(tmp_path):
    with pytest.raises((ValueError, KeyError)):
        counts.load_merges(public_tokenizers.path("word_bpe_49k.json"))
    spec = json.load(open(PATH))
    spec["pre_tokenizer"]["add_prefix_space"] = True
    (tmp_path / "t.json").write_text(json.dumps(spec))
    with pytest.raises(ValueError):
        counts.load_merges(str(tmp_path / "t.json"))


def test_every_document_of_the_table(spark, texts, library):
    expected = [(i, *numbers(library, t)) for i, t in texts]
    assert sorted(map(tuple, op12(spark, SF).collect())) == [(*r, r[2] > 1024) for r in expected]


def test_odd_rows(spark, odd, none, table, library):
    got = counts.count_tokens(odd, table, keep=("doc_id", "text", "words")).collect()
    assert sorted((str(r.kept.doc_id), r.n_bytes, r.n_tokens) for r in got) == sorted((str(r[0]), *numbers(library, r[1])) for r in plain.odd_rows())
    assert all(numbers(library, r.kept.text) == (r.n_bytes, r.n_tokens) for r in got)
    assert counts.count_tokens(none, table).count() == 0
