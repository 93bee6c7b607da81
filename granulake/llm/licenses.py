"""Licence scan: a trained paragraph classifier whose predictions a template has to confirm.

A paragraph is a line with a word, alone and together with the lines after it up to a blank one (`_wide`), as far as the
longest statement reaches, so that hard-wrapped statements are whole. A multinomial logistic regression over
word 1- to 3-grams, fitted with a lasso penalty on the statements of `TEMPLATES` and on lines of the corpus that
hold no template as the unknown class, names a licence family or `unknown`; temperature and unknown offset are calibrated on
a held-out part. A prediction counts only if the paragraph holds at least `SHARE` of the word pairs of one statement
of that family.

The lines of the corpus come from at most `rows` documents chosen by the hash of their id. Only paragraphs with a marking
word are scored. Every statement has so many marking words that a paragraph without any of them cannot hold
`SHARE` of its pairs; the corpus lines only say which of its words are the rarest.

Scanning is made of column expressions only, one row in and one row out.

Defined results: a NULL, empty or blank text has no paragraphs and no licences; equal rows get equal results; an
empty corpus leaves the templates as the only training text; other columns are ignored.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Statements by which texts name their licence.
TEMPLATES = {
    "Apache-2.0": (
        "Licensed under the Apache License, Version 2.0.",
        'Licensed under the Apache License, Version 2.0 (the "License"); you may not use this file except in compliance with the License.',
        "This software is distributed under the terms of the Apache License, Version 2.0.",
    ),
    "BSD-3-Clause": (
        "Released under the BSD 3-Clause License.",
        "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met:",
    ),
    "CC-BY-4.0": (
        "Licensed under CC BY 4.0.",
        "This work is licensed under a Creative Commons Attribution 4.0 International License.",
    ),
    "CC-BY-NC-4.0": (
        "Licensed under CC BY-NC 4.0.",
        "This work is licensed under a Creative Commons Attribution-NonCommercial 4.0 International License.",
    ),
    "GPL-3.0": (
        "This work is licensed under the GNU General Public License, version 3.",
        "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or any later version.",
        "Released under the GPLv3.",
    ),
    "MIT": (
        "Released under the MIT License.",
        "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files, to deal in the Software without restriction.",
        "Licensed under the MIT license.",
    ),
}
UNKNOWN = "unknown"
SHARE = 0.6


def words_of(line: str) -> list[str]:
    return [w for w in "".join(c if c.isascii() and c.isalnum() else " " for c in line.lower()).split() if w]


def grams_of(words: list[str], most: int = 3) -> list[str]:
    return [" ".join(words[i : i + n]) for n in range(1, most + 1) for i in range(len(words) - n + 1)]


def pairs_of(words: list[str]) -> set[str]:
    return set(grams_of(words, 2)) - set(words)


def holds(words: list[str], statement: str) -> bool:
    """The line has enough of the statement's word pairs."""
    own = pairs_of(words_of(statement))
    return len(own & pairs_of(words)) >= SHARE * len(own)


def marks_of(statement: str, held: dict[str, int]) -> set[str]:
    """Words of a statement, those that `held` counts least first, without which too few of its word pairs are left for
    `SHARE`."""
    pairs = pairs_of(words_of(statement))
    left, out = pairs, set()
    for w in sorted(set(words_of(statement)), key=lambda w: (held.get(w, 0), w.isdigit(), -len(w), w)):
        if len(left) < SHARE * len(pairs):
            break
        out.add(w)
        left = {p for p in left if w not in p.split()}
    return out


#: Words of the longest statement.
LONGEST = max(len(words_of(s)) for f in TEMPLATES for s in TEMPLATES[f])


@dataclass
class Scanner:
    """Families, weights of each n-gram (one for each family and unknown last), offsets, and marking words."""

    families: list[str]
    weights: dict[str, list[float]]
    start: list[float]
    marks: list[str]

    def logits(self, line: str) -> np.ndarray:
        """The classifier on one line, as the column expression computes it."""
        out = np.array(self.start)
        for gram in grams_of(words_of(line)):
            if gram in self.weights:
                out = out + self.weights[gram]
        return out


def _fit(x: np.ndarray, y: np.ndarray, weight: np.ndarray, classes: int, penalty: float, rounds: int = 300):
    """Multinomial logistic regression with a lasso penalty, by accelerated proximal steps."""
    w = ahead = np.zeros((x.shape[1], classes))
    start = np.zeros(classes)
    target = np.eye(classes)[y]
    step, t = 2.0 / (np.mean((x**2).sum(axis=1)) + 1), 1.0
    for _ in range(rounds):
        z = x @ ahead + start
        p = np.exp(z - z.max(axis=1, keepdims=True))
        p /= p.sum(axis=1, keepdims=True)
        pull = (p - target) * weight[:, None]
        moved = ahead - step * (x.T @ pull)
        shrunk = np.sign(moved) * np.maximum(np.abs(moved) - step * penalty, 0)
        start = start - step * pull.sum(axis=0)
        nxt = (1 + np.sqrt(1 + 4 * t * t)) / 2
        ahead = shrunk + (t - 1) / nxt * (shrunk - w)
        w, t = shrunk, nxt
    return w, start


def learn(lines: list[str], *, copies: int = 12, penalty: float = 2e-4) -> Scanner:
    """Scanner from the templates and from lines of the corpus."""
    rng = np.random.default_rng(7)
    families = sorted(TEMPLATES)
    corpus = [w for w in map(words_of, lines) if w and not any(holds(w, s) for f in families for s in TEMPLATES[f])]
    pool = [w for words in corpus for w in words] or ["text"]
    held = {w: 0 for f in families for s in TEMPLATES[f] for w in words_of(s)}
    for words in corpus:
        for w in set(words) & held.keys():
            held[w] += 1
    marks = sorted({w for f in families for s in TEMPLATES[f] for w in marks_of(s, held)})
    rows, y = [], []
    for k, family in enumerate(families):
        for statement in TEMPLATES[family]:
            words = words_of(statement)
            for copy in range(copies):  # alone, and among words of the corpus
                around = [list(rng.choice(pool, rng.integers(0, 12))) if copy else [] for _ in "ab"]
                rows.append(around[0] + words + around[1])
                y.append(k)
    for words in corpus:
        rows.append(words)
        y.append(len(families))
    for _ in range(8 * copies):  # single marking words among others name no licence
        around = list(rng.choice(pool, 8))
        rows.append(around[:4] + list(rng.choice(marks or ["text"], 2)) + around[4:])
        y.append(len(families))
    every = {g for f in families for s in TEMPLATES[f] for g in grams_of(words_of(s))}
    vocabulary = {g: i for i, g in enumerate(sorted(every))}
    x = np.zeros((len(rows), len(vocabulary)))
    for i, words in enumerate(rows):
        for gram in grams_of(words):
            if gram in vocabulary:
                x[i, vocabulary[gram]] += 1
    y = np.array(y)
    share = np.bincount(y, minlength=len(families) + 1)
    weight = 1 / (share[y] * (share > 0).sum())
    test = np.arange(len(y)) % 4 == 0
    w, start = _fit(x[~test], y[~test], weight[~test] / weight[~test].sum(), len(families) + 1, penalty)
    z, rows_at = x[test] @ w + start, np.arange(test.sum())

    def loss(heat: float, offset: float) -> float:
        v = z / heat
        v[:, -1] += offset
        v -= v.max(axis=1, keepdims=True)
        return float(-(weight[test] * (v[rows_at, y[test]] - np.log(np.exp(v).sum(axis=1)))).sum())

    heat, offset = min(((a, b) for a in (0.25, 0.5, 1.0, 2.0) for b in (-1.0, 0.0, 1.0, 2.0)), key=lambda p: loss(*p))
    start = start / heat
    start[-1] += offset
    some = {g: [round(float(v), 6) for v in w[i] / heat] for g, i in vocabulary.items() if np.abs(w[i]).max() > 1e-6}
    return Scanner(families, some, [float(v) for v in start], marks)


def corpus_lines(docs: DataFrame, rows: int, longest: int = 400) -> list[str]:
    """Lines of at most `rows` documents, up to 8 a document and `longest` characters a line, for training."""
    some = docs.where("text is not null and doc_id is not null").select("doc_id", F.xxhash64("doc_id").alias("h"))
    chosen = F.broadcast(some.select("doc_id", "h").distinct().orderBy("h", "doc_id").limit(rows))
    lines = F.slice(F.filter(F.split("text", "\n", -1), lambda x: (F.btrim(x) != "") & (F.length(x) <= longest)), 1, 8)
    got = docs.join(chosen, "doc_id").select("doc_id", F.explode(lines).alias("line")).orderBy("doc_id", "line")
    return [r["line"] for r in got.collect()]


def fit(docs: DataFrame, *, rows: int = 600) -> Scanner:
    return learn(corpus_lines(docs, rows))


def _words(line: Column) -> Column:
    return F.filter(F.split(F.lower(line), "[^a-z0-9]+"), lambda w: w != "")


def _joined(words: Column, n: int) -> Column:
    last = F.size(words) - n
    places = F.sequence(F.lit(0), F.greatest(last, F.lit(0)))
    grams = F.transform(places, lambda i: F.array_join(F.slice(words, i + 1, n), " "))
    return F.when(last < 0, F.array().cast("array<string>")).otherwise(grams)


def _judge(words: Column, scanner: Scanner) -> Column:
    """Family of a paragraph, or unknown, from its words."""
    names = F.array(*[F.lit(f) for f in [*scanner.families, UNKNOWN]])
    table = F.create_map(*[x for g, w in scanner.weights.items() for x in (F.lit(g), F.array(*[F.lit(v) for v in w]))])
    start = F.array(*[F.lit(v) for v in scanner.start])
    grams = F.concat(*[_joined(words, n) for n in (1, 2, 3)])
    known = F.filter(grams, lambda g: F.map_contains_key(table, g))
    logits = F.aggregate(known, start, lambda a, g: F.zip_with(a, table[g], lambda p, q: p + q))
    best = F.transform(F.array(logits), lambda z: F.array_position(z, F.array_max(z)).cast("int"))[0]
    family = F.element_at(names, best)
    pairs = _joined(words, 2)
    confirmed = F.lit(False)
    for name in scanner.families:
        for statement in TEMPLATES[name]:
            own = sorted(pairs_of(words_of(statement)))
            held = F.size(F.array_intersect(pairs, F.array(*[F.lit(g) for g in own])))
            confirmed = confirmed | ((family == name) & (held >= SHARE * len(own)))
    return F.when(confirmed, family).otherwise(F.lit(UNKNOWN))


def _wide(lines: Column, place: Column) -> Column:
    """The line's place, the last line before one without a word (`LONGEST` lines further at most), and the words of the line
    with the `LONGEST` words after it in these."""
    after = F.slice(lines, place + 2, LONGEST)
    blank = F.array_position(F.transform(after, lambda w: F.size(w)), 0).cast("int")
    upto = F.when(blank > 0, blank - 1).otherwise(F.size(after))
    words = F.concat(lines[place], F.slice(F.flatten(F.slice(after, F.lit(1), upto)), 1, LONGEST))
    return F.struct(place.alias("line"), (place + upto).alias("upto"), F.lit(True).alias("wide"), words.alias("words"))


def scan(docs: DataFrame, scanner: Scanner, keep: list[Column], text: str = "text") -> DataFrame:
    """The columns `keep` with `n_paragraphs`, and `found`: line number and family of every line with a marking
    word, and first line and family of every statement that only several lines hold; statements of one family that follow each
    other without a blank line between them may be one."""
    lines = F.split(F.coalesce(F.col(f"`{text}`"), F.lit("")), "\n", -1)
    rows = docs.select(F.struct(*keep).alias("kept"), F.transform(lines, _words).alias("lines"))
    marks = F.array(*[F.lit(m) for m in scanner.marks]).cast("array<string>")
    filled = F.size(F.filter("lines", lambda w: F.size(w) > 0)).cast("bigint")
    # a wide paragraph has to reach a marked line, which is at most LONGEST lines below
    marked = F.filter(F.transform("lines", lambda w, i: F.when(F.arrays_overlap(w, marks), i)), lambda i: i.isNotNull())
    rows = rows.select("kept", "lines", filled.alias("n_paragraphs"), marked.alias("marked"))
    near = F.flatten(F.transform("marked", lambda i: F.sequence(F.greatest(i - LONGEST, F.lit(0)), i)))
    alone = F.transform("marked", lambda i: F.struct(i.alias("line"), i.alias("upto"), F.lit(False).alias("wide"), F.col("lines")[i].alias("words")))
    starts = F.filter(F.array_distinct(near), lambda i: F.size(F.col("lines")[i]) > 0)
    wide = F.transform(starts, lambda i: _wide(F.col("lines"), i))
    wide = F.filter(wide, lambda p: (F.size(p["words"]) > F.size(F.col("lines")[p["line"]])) & F.arrays_overlap(p["words"], marks))
    rows = rows.select("kept", "n_paragraphs", F.concat(alone, wide).alias("paragraphs"))
    judged = lambda p: F.struct(
        p["line"].alias("line"), _judge(p["words"], scanner).alias("family"), p["upto"].alias("upto"), p["wide"].alias("wide")
    )
    rows = rows.select("kept", "n_paragraphs", F.transform("paragraphs", judged).alias("judged"))
    rows = rows.select(
        "kept",
        "n_paragraphs",
        F.filter("judged", lambda p: ~p["wide"]).alias("alone"),
        F.filter("judged", lambda p: p["wide"] & (p["family"] != UNKNOWN)).alias("wide"),
    )

    def new(p: Column) -> Column:
        """Neither a line that the paragraph reaches nor the paragraph before it names the family."""
        same = lambda q: q["family"] == p["family"]
        below = F.exists("alone", lambda q: same(q) & q["line"].between(p["line"], p["upto"]))
        return ~below & ~F.exists("wide", lambda q: same(q) & (q["line"] == p["line"] - 1))

    rows = rows.select("kept", "n_paragraphs", "alone", F.filter("wide", new).alias("wide"))
    found = F.array_sort(F.concat("alone", "wide"))
    found = F.transform(found, lambda p: F.struct(p["line"].alias("line"), p["family"].alias("family")))
    return rows.select("kept.*", "n_paragraphs", found.alias("found"))
