"""Quality classifier: a sparse ensemble of rules.

Small regression trees are boosted on the statistics of labelled texts; every path from a root is a conjunctive
rule. A logistic regression with lasso penalty weighs the rules, most get weight 0, and the rest
becomes one Spark column expression over the statistics. The penalty is chosen on a quarter of the sample.

Fitted on the statistics of at most `rows` labelled texts of each label. A NULL text counts as empty and is scored
like any other text; without labels of both kinds every text gets the share of label 1 (0.5 without any label).
"""

from __future__ import annotations

from dataclasses import dataclass
from functools import reduce

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from granulake.llm.fitting import sigmoid
from granulake.llm.quality_rules import Condition, sample_statistics
from granulake.llm.statistics import SHARES, with_shares, with_statistics


@dataclass
class Ensemble:
    rules: list[tuple[Condition, ...]]
    weights: list[float]
    start: float

    def column(self) -> Column:
        """Probability of label 1 over the struct `x` of shares."""
        terms = (
            F.when(reduce(lambda a, b: a & b, (c.column() for c in rule)), F.lit(w)).otherwise(F.lit(0.0))
            for rule, w in zip(self.rules, self.weights)
        )
        return 1 / (1 + F.exp(-reduce(lambda a, b: a + b, terms, F.lit(self.start))))


def _split(table, rows, pull, curve, cuts):
    """Best threshold of a node: (gain, condition)."""
    best = (1e-6, None)
    total, weight = pull[rows].sum(), curve[rows].sum()
    for name in SHARES:
        values = table[name][rows]
        order = np.argsort(values, kind="stable")
        v, g, h = values[order], np.cumsum(pull[rows][order]), np.cumsum(curve[rows][order])
        at = np.unique(np.linspace(0, len(v) - 1, cuts + 2).astype(int)[1:-1])
        at = at[v[at] < v[-1]]
        at = np.unique(np.searchsorted(v, v[at], "right") - 1)
        if not len(at):
            continue
        left, lw = g[at], h[at]
        gain = left**2 / (lw + 1) + (total - left) ** 2 / (weight - lw + 1) - total**2 / (weight + 1)
        i = int(np.argmax(gain))
        if gain[i] > best[0]:
            best = (float(gain[i]), Condition(name, False, float(v[at[i]] + v[at[i] + 1]) / 2))
    return best


def grow_trees(
    table, y, *, trees: int = 30, depth: int = 3, rate: float = 0.3, least: int = 10, cuts: int = 48
) -> list[tuple[Condition, ...]]:
    """Paths of boosted trees as rules, without repeats, in the order found."""
    margin = np.zeros(len(y))
    rules: dict[tuple[Condition, ...], None] = {}
    for _ in range(trees):
        p = sigmoid(margin)
        pull, curve = y - p, p * (1 - p)
        nodes = [((), np.arange(len(y)))]
        leaves = []
        while nodes:
            path, rows = nodes.pop()
            cut = _split(table, rows, pull, curve, cuts)[1] if len(path) < depth and len(rows) >= 2 * least else None
            if cut is None:
                leaves.append(rows)
                continue
            low = cut.holds(table)[rows]
            for condition, part in ((cut, rows[low]), (Condition(cut.name, True, cut.bound), rows[~low])):
                rules[(*path, condition)] = None
                nodes.append(((*path, condition), part))
        for rows in leaves:
            margin[rows] += rate * pull[rows].sum() / (curve[rows].sum() + 1)
    return list(rules)


def lasso(x: np.ndarray, y: np.ndarray, weight: np.ndarray, penalty: float, rounds: int = 400) -> np.ndarray:
    """Weights (the intercept last, unpenalised) by accelerated proximal steps."""
    x = np.column_stack([x, np.ones(len(x))])
    weight = weight / weight.sum()
    step = 4 / (np.linalg.norm(x * np.sqrt(weight)[:, None], 2) ** 2 + 1e-12)
    w = ahead = np.zeros(x.shape[1])
    t = 1.0
    for _ in range(rounds):
        moved = ahead - step * (x.T @ (weight * (sigmoid(x @ ahead) - y)))
        shrunk = np.sign(moved) * np.maximum(np.abs(moved) - step * penalty, 0)
        shrunk[-1] = moved[-1]
        nxt = (1 + np.sqrt(1 + 4 * t * t)) / 2
        ahead = shrunk + (t - 1) / nxt * (shrunk - w)
        w, t = shrunk, nxt
    return w


def fit_table(table, y: np.ndarray, share: float) -> Ensemble:
    """Ensemble from statistics and labels; `share` is the share of label 1 among all labels."""
    if min((y == 0).sum(), (y == 1).sum()) < 4:
        share = min(max(share, 1e-3), 1 - 1e-3)
        return Ensemble([], [], float(np.log(share / (1 - share))))
    weight = np.where(y == 1, share / (y == 1).mean(), (1 - share) / (y == 0).mean())
    rules = grow_trees(table, y)
    x = np.column_stack([reduce(np.logical_and, (c.holds(table) for c in r)) for r in rules]).astype(float)
    held = np.arange(len(y)) % 4 == 0

    def loss(w):
        p = np.clip(sigmoid(x[held] @ w[:-1] + w[-1]), 1e-6, 1 - 1e-6)
        return float(-(weight[held] * np.where(y[held] == 1, np.log(p), np.log(1 - p))).mean())

    penalties = (0.03, 0.01, 0.003, 0.001)
    best = min(penalties, key=lambda k: loss(lasso(x[~held], y[~held], weight[~held], k)))
    w = lasso(x, y, weight, best)
    some = np.flatnonzero(np.abs(w[:-1]) > 1e-4)
    return Ensemble([rules[i] for i in some], [float(w[i]) for i in some], float(w[-1]))


def fit(
    docs: DataFrame, labels: DataFrame, where: Column | None = None, *, rows: tuple[int, int] = (3000, 6000)
) -> Ensemble:
    """Ensemble from at most `rows` texts labelled 0 and 1, among the labels `where`."""
    known = labels if where is None else labels.where(where)
    share = known.where(F.col("quality").isin(0, 1)).agg(F.avg("quality")).first()[0]
    return fit_table(*sample_statistics(docs, known, rows), 0.5 if share is None else float(share))


def scored(docs: DataFrame, model: Ensemble, keep: list[Column]) -> DataFrame:
    """The columns `keep`, every statistic and `score`."""
    stats = with_shares(with_statistics(docs, keep))
    return stats.withColumn("score", model.column()).drop("x")
