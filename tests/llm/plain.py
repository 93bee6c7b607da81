"""Plain versions of the operators, and a small table with every odd case."""

from __future__ import annotations

import re
from collections import Counter, defaultdict

SF = "/root/testdata/sf0.001"

SPACE_WORDS = re.compile(r"[^\x20\x09-\x0D]+")
ALNUM_WORDS = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
SCHEMA = "doc_id long, text string, lang string, source string, kept string, score double, label int, t string, words string, n_words string"


def low(text):
    return re.sub("[A-Z]", lambda m: m[0].lower(), text or "")


def prose(seed: int, n: int) -> str:
    """Words that follow from the seed."""
    out, x = [], seed * 7919 + 13
    for _ in range(n):
        x = (x * 1103515245 + 12345) % (1 << 31)
        out.append("".join("etaoinshrdlucmwy"[(x >> (4 * k)) & 15] for k in range(1, 2 + (x >> 20) % 6)))
    return " ".join(out)


def odd_rows():
    """NULLs in every column, empty and blank and very long texts, copies, near copies, ties, repeated rows."""
    base = prose(1, 120).split()
    near = [*base[:60], "CHANGED", *base[61:]]
    far = [*base[:60], *prose(2, 60).split()]
    rows = [
        (1, None), (2, ""), (3, " \n\t "), (4, "one"), (5, "One"), (6, "two words"), (7, " ".join(base)),
        (8, " ".join(base).upper()), (9, " ".join(near)), (10, " ".join(far)), (11, prose(3, 30_000)),
        (12, "x " * 66_000), (13, "a" * 5000), (14, "é à ñ ß 日本語 😀 ²"), (15, "!!! ??? ###"), (15, "!!! ??? ###"),
        (None, " ".join(base)), (None, None), (16, "\n".join(["same line here"] * 9)), (17, prose(4, 80)),
    ]
    return [(i, t, "en" if i else None, None, "k", 1.5, 1, "t", "w", "n") for i, t in rows]


def odd_docs(spark):
    return spark.createDataFrame(odd_rows(), SCHEMA)


def empty_docs(spark):
    return spark.createDataFrame([], SCHEMA)


def shingles(text, n=5):
    words = SPACE_WORDS.findall(low(text))
    if len(words) < n:
        return frozenset([tuple(words)] if words else [])
    return frozenset(tuple(words[i : i + n]) for i in range(len(words) - n + 1))


def components(rows, n=5, percent=75):
    """(number of shingles, smallest id that links reach) of every row, in order."""
    sets = [shingles(t, n) for _, t in rows]
    holders = defaultdict(list)
    for i, s in enumerate(sets):
        for x in s:
            holders[x].append(i)
    up = list(range(len(rows)))

    def top(i):
        while up[i] != i:
            i = up[i]
        return i

    for i, s in enumerate(sets):
        for j, both in Counter(j for x in s for j in holders[x] if j > i).items():
            if 100 * both >= percent * (len(s) + len(sets[j]) - both):
                up[max(top(i), top(j))] = min(top(i), top(j))
    least = {}
    for i, (doc, _) in enumerate(rows):
        if doc is not None:
            least[top(i)] = min(least.get(top(i), doc), doc)
    return [(len(s), least.get(top(i)) if s else rows[i][0]) for i, s in enumerate(sets)]


def windows(items, size=10):
    out = defaultdict(set)
    for name, text in items:
        words = ALNUM_WORDS.findall(low(text))
        for i in range(max(1, len(words) - size + 1) if words else 0):
            out[tuple(words[i : i + size])].add(name)
    return out


def hits(text, found):
    """Number of words, hit words, and items found in a text."""
    words, hit, items = ALNUM_WORDS.findall(low(text)), set(), set()
    for n in {len(w) for w in found}:
        for i in range(len(words) - n + 1):
            if (got := found.get(tuple(words[i : i + n]))) is not None:
                hit.update(range(i, i + n))
                items |= got
    return len(words), len(hit), items


def statistics(text):
    """n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words."""
    text = text or ""
    words = SPACE_WORDS.findall(text)
    triples = [tuple(words[i : i + 3]) for i in range(len(words) - 2)]
    counts = Counter(triples)
    covered = {i + k for i, t in enumerate(triples) if counts[t] > 1 for k in range(3)}
    seen, repeated = set(), 0
    for line in text.split("\n"):
        if SPACE_WORDS.search(line):
            repeated += line in seen
            seen.add(line)
    return len(words), sum(map(len, words)), sum(c in "#*$%&|<>" for c in text), repeated, len(covered)
