"""Quality rules as a learned decision list.

Sequential covering: a rule is a conjunction of thresholds on text statistics, grown by information gain on two
thirds of the labelled texts that no earlier rule covers and pruned on the rest. A rule that is not right often enough
on the pruning part ends the list. The list becomes one ordered Spark conditional expression; texts that
no rule rejects are kept.

The statistics, the sample and the verdict are DataFrame operations; the driver only sees the statistics of at
most `rows` labelled texts.

Defined results: a NULL text counts as empty; without enough labels the list is empty and keeps everything;
equal rows get equal verdicts; other columns are ignored or, in `keep_good`, returned as they were.
"""

from __future__ import annotations

from dataclasses import dataclass
from functools import reduce

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from granulake.llm.fitting import labelled_sample
from granulake.llm.statistics import SHARES, with_shares, with_statistics

#: A text of fewer words, or with more than half of its words in repeated windows, fails before any learned rule.
BASE_FAILED = "n_words < 50 or 100 * n_repeat_words > 50 * n_words"


@dataclass(frozen=True)
class Condition:
    """A statistic at most, or above, a threshold."""

    name: str
    above: bool
    bound: float

    def column(self) -> Column:
        value = F.col("x")[self.name]
        return value > F.lit(self.bound) if self.above else value <= F.lit(self.bound)

    def holds(self, table: dict[str, np.ndarray]) -> np.ndarray:
        return table[self.name] > self.bound if self.above else table[self.name] <= self.bound


def sample_statistics(
    docs: DataFrame, labels: DataFrame, rows: tuple[int, int], where: Column | None = None
) -> tuple[dict[str, np.ndarray], np.ndarray]:
    """Shares and labels of the sampled texts, ordered by id and shares."""
    chosen = labelled_sample(docs, labels, "quality", rows, where)
    stats = with_shares(with_statistics(chosen, [F.col("doc_id"), F.col("label")]))
    got = stats.select("doc_id", "label", F.expr(BASE_FAILED).alias("failed"), "x.*")
    got = got.orderBy("doc_id", *SHARES).collect()
    table = {n: np.array([r[n] for r in got], float) for n in SHARES}
    table["failed"] = np.array([r["failed"] for r in got], bool)
    return table, np.array([r["label"] for r in got], int)


def _gain(p: float, n: float, p0: float, n0: float) -> float:
    return p * (np.log2(p / (p + n)) - np.log2(p0 / (p0 + n0))) if p else -np.inf


def _candidates(table: dict[str, np.ndarray], rows: np.ndarray, cuts: int):
    for name in SHARES:
        values = np.unique(table[name][rows])
        at = np.searchsorted(values, np.quantile(table[name][rows], np.linspace(0, 1, cuts + 1)[:-1], method="lower"))
        for i in np.unique(at[at < len(values) - 1]):
            bound = float(values[i] + values[i + 1]) / 2  # between two values that occur
            for above in (True, False):
                yield Condition(name, above, bound)


def _grow(table, bad, rows, most, cuts) -> list[Condition]:
    rule: list[Condition] = []
    while len(rule) < most:
        p0, n0 = bad[rows].sum(), (~bad[rows]).sum()
        if not p0 or not n0:
            break
        scored = []
        for c in _candidates(table, rows, cuts):
            hit = c.holds(table)[rows]
            gain = _gain((hit & bad[rows]).sum(), (hit & ~bad[rows]).sum(), p0, n0)
            scored.append((gain, c.name, c.above, c.bound, c))
        best = max(scored, key=lambda s: s[:4])
        if best[0] <= 0:
            break
        rule.append(best[4])
        rows = rows[best[4].holds(table)[rows]]
    return rule


def _counts(rule, table, bad, rows) -> tuple[int, int]:
    hit = reduce(np.logical_and, (c.holds(table)[rows] for c in rule))
    return int((hit & bad[rows]).sum()), int((hit & ~bad[rows]).sum())


def learn(
    table: dict[str, np.ndarray],
    label: np.ndarray,
    *,
    precision: float = 0.9,
    least: int = 3,
    most: int = 4,
    rules: int = 12,
    cuts: int = 40,
) -> list[list[Condition]]:
    """Rules that reject, in the order in which they were learned."""
    bad = label == 0
    rows = np.flatnonzero(~table["failed"])
    out: list[list[Condition]] = []
    while len(out) < rules:
        growing, pruning = rows[rows % 3 != 0], rows[rows % 3 == 0]
        rule = _grow(table, bad, growing, most, cuts)
        if not rule:
            break
        shorter = [rule[: i + 1] for i in range(len(rule))]
        worth = [(p - n) / (p + n) if p + n else -1.0 for p, n in (_counts(r, table, bad, pruning) for r in shorter)]
        rule = shorter[int(np.argmax(worth))]
        p, n = _counts(rule, table, bad, pruning)
        if p < least or p < precision * (p + n):
            break
        out.append(rule)
        rows = rows[~reduce(np.logical_and, (c.holds(table)[rows] for c in rule))]
    return out


def fit(
    docs: DataFrame, labels: DataFrame, *, rows: tuple[int, int] = (2000, 6000), where: Column | None = None
) -> list[list[Condition]]:
    """Decision list from at most `rows` texts labelled 0 and 1."""
    return learn(*sample_statistics(docs, labels, rows, where))


def verdict(rules: list[list[Condition]]) -> Column:
    """Ordered conditional over the struct `x` of shares: false where a rule rejects."""
    out = None
    for rule in rules:
        hit = reduce(lambda a, b: a & b, (c.column() for c in rule))
        out = F.when(hit, F.lit(False)) if out is None else out.when(hit, F.lit(False))
    return F.lit(True) if out is None else out.otherwise(F.lit(True))


def judged(docs: DataFrame, rules: list[list[Condition]], keep: list[Column]) -> DataFrame:
    """The columns `keep`, every statistic, `base_failed` and `kept`."""
    stats = with_shares(with_statistics(docs, keep))
    failed = F.expr(BASE_FAILED)
    return stats.select("*", failed.alias("base_failed"), (~failed & verdict(rules)).alias("kept")).drop("x")


def keep_good(docs: DataFrame, rules: list[list[Condition]]) -> DataFrame:
    """The documents that no rule rejects, in their own columns."""
    row = F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row")
    # the one-row explode keeps the filter above the statistics, which would be copied into it
    found = judged(docs, rules, [row]).select(F.explode(F.array(F.struct("row", "kept"))).alias("found"))
    return found.where("found.kept").select("found.row.*")
