"""Source divergence: the pointer sort, counts per slice, and the whole audit against plain code."""

import re
from collections import Counter, defaultdict

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

import plain
from granulake.llm import divergence as div
from granulake.llm.words import text_offsets, word_spans

TERM = re.compile(r"[^\x00-\x40\x5B-\x60\x7B-\x7F]+")


def words(text):
    return TERM.findall(plain.low(text))


def plain_audit(rows, least, first):
    """rows of (lang, source, text)."""
    rows = [(a or "", b or "", words(t)) for a, b, t in rows]
    df, count, groups = defaultdict(int), defaultdict(Counter), defaultdict(set)
    for lang, source, found in rows:
        groups[lang].add(source)
        count[lang, source].update(found)
        for w in set(found):
            df[lang, w] += 1
    out = set()
    for lang, sources in groups.items():
        kept = sorted(w for (of, w), n in df.items() if of == lang and n >= least)
        whole = Counter()
        for s in sources:
            whole.update(count[lang, s])

        def shares(counts):
            size = sum(counts[w] for w in kept) + 5 * len(kept)
            return {w: 1 + 10**9 * (counts[w] + 5) // size for w in kept}

        p = {s: shares(count[lang, s]) for s in sources}
        q = shares(whole)
        for s in sources:
            far = [(sum(abs(p[s][w] - p[o][w]) for w in kept), o) for o in sources if o != s]
            far.sort(key=lambda x: (-x[0], x[1].encode()))
            out |= {(lang, s, "pair", o, v, i) for i, (v, o) in enumerate(far, 1)}
            over = [(p[s][w] - q[w], w) for w in kept if count[lang, s][w] and p[s][w] > q[w]]
            over.sort(key=lambda x: (-x[0], x[1].encode()))
            out |= {(lang, s, "term", w, v, i) for i, (v, w) in enumerate(over[:first], 1)}
    return out


def some_rows(n=400):
    rng = np.random.default_rng(3)
    vocabulary = ["a", "the", "café", "日本語", "internationalisation", "internationalise", "eightchr", "eightchr日", "Zebra", *plain.prose(9, 60).split()]
    rows = []
    for i in range(n):
        source = f"s{min(int(rng.zipf(1.6)), 7)}"
        text = " ".join(rng.choice(vocabulary, rng.integers(0, 40)).tolist()) + ("!?" if i % 3 else " 12 x1y")
        rows.append(("en" if i % 3 else "fr", source, text if i % 17 else None))
    return [*rows, (None, None, "alone"), ("de", "s1", None), ("de", "s2", ""), *rows[:9]]


def test_pointer_sort(monkeypatch):
    monkeypatch.setattr(div, "SMALL", 70)
    rng = np.random.default_rng(1)
    pool = ["", "a", "ab", "abcdefgh", "abcdefghi", "abcdefgh" * 3, "abcdefgh" * 3 + "z", "é" * 9, *plain.prose(1, 300).split()]
    text = " ".join(rng.choice(pool, 5000).tolist())
    data, offsets = text_offsets(pa.array([text]))
    low, starts, ends = word_spans(data, offsets, div.MASK_TERM)
    at, fresh = div.Pointers(low, starts, ends).sort()
    found = [low[starts[i] : ends[i]].tobytes() for i in range(len(starts))]
    assert [found[i] for i in at] == sorted(found)
    assert at.tolist() == sorted(range(len(found)), key=lambda i: found[i])  # stable
    assert fresh.tolist() == [i == 0 or found[at[i]] != found[at[i - 1]] for i in range(len(at))]
    assert not len(div.Pointers(low, starts[:0], ends[:0]).sort()[0])


@pytest.mark.parametrize("size", [1, 50, 1 << 20])
def test_counts_of_slices(spark, size):
    rows = some_rows(60) + [("en", "s1", "long " * 300 + "WORD" + "é" * 90)]
    df = spark.createDataFrame(rows, "lang string, source string, text string")
    got = {(r.lang, r.source, r.term): (r.n, r.docs) for r in div.count_terms(df, slice_bytes=size).collect()}
    n, docs = Counter(), Counter()
    for a, b, t in rows:
        n.update((a or "", b or "", w) for w in words(t))
        docs.update((a or "", b or "", w) for w in set(words(t)))
    assert got == {k: (v, docs[k]) for k, v in n.items()}


@pytest.mark.parametrize("block", [64, 2])
def test_audit_against_plain_code(spark, block):
    rows = some_rows()
    df = spark.createDataFrame(rows, "lang string, source string, text string").repartition(3)
    got = [tuple(r) for r in div.audit(df, least=5, first=4, block=block, terms_a_shard=16).collect()]
    assert len(got) == len(set(got)) and set(got) == plain_audit(rows, 5, 4)


def test_large_counts_stay_exact(spark):
    df = spark.createDataFrame([(3 * 10**12, 7 * 10**12, 11)], "n long, size long, terms long")
    got = df.select(div.share("n", "size")).first()[0]
    assert got == 1 + 10**9 * (3 * 10**12 + 5) // (7 * 10**12 + 55)


def test_odd_tables(spark, odd, none):
    rows = [(r[2], r[3], r[1]) for r in plain.odd_rows()]
    got = div.audit(odd, least=2).drop("kept")
    assert set(map(tuple, got.collect())) == plain_audit(rows, 2, 50)
    other = odd.select(F.col("text").alias("body"), F.col("lang").alias("l"), F.lit("x").alias("term"), F.lit(1).alias("n"), F.lit(None).cast("string").alias("s"))
    assert set(map(tuple, div.audit(other, least=2, text="body", lang="l", source="s").collect())) == plain_audit(rows, 2, 50)
    assert div.audit(none).count() == 0
