"""Regression trees grown from sufficient statistics per cell.

A cell is one combination of feature values.  Squared-error trees on such features depend on
nothing but the weight, the sum and the sum of squares of the labels in each cell, so one
aggregation over all rows is all the distributed work; the trees then grow on the cells, of which
there are few (64 for three quartiles).  More than ``MOST_CELLS`` is an error: bin the features.

Gains are compared after rounding to ``DIGITS`` places, as sums of the same numbers in another
order differ in their last bits; of equal splits the first feature wins, then the lowest threshold.
"""

from __future__ import annotations

import math
from collections.abc import Sequence
from dataclasses import dataclass

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tillwise.functions.columns import exact_sum

MOST_CELLS = 100_000
DIGITS = 12
#: Places of decimals in which labels are summed, so that sums repeat.
LABEL_PLACES = 15


@dataclass(frozen=True)
class Cells:
    """Feature values as places in each feature's sorted values, and the statistics per cell."""

    values: list[np.ndarray]
    places: np.ndarray
    weight: np.ndarray
    total: np.ndarray


def _checked(rows: list, n: int) -> list:
    if len(rows) > n:
        raise ValueError(f"more than {MOST_CELLS} combinations of feature values: bin the features")
    return rows


def _cells(keys: np.ndarray, weight: np.ndarray, total: np.ndarray) -> Cells:
    values, places = [], np.zeros(keys.shape, np.int64)
    for k in range(keys.shape[1]):
        levels, places[:, k] = np.unique(keys[:, k], return_inverse=True)
        values.append(levels)
    return Cells(values, places, weight, total)


def cells_of(df: DataFrame, features: Sequence[str], label: str) -> Cells:
    """The cells of all rows, from one aggregation."""
    states = df.groupBy(*features).agg(
        F.count("*").alias("n"), exact_sum(label, LABEL_PLACES).cast("double").alias("s")
    )
    rows = _checked(states.orderBy(*features).limit(MOST_CELLS + 1).collect(), MOST_CELLS)
    keys = np.array([[float(r[c]) for c in features] for r in rows]).reshape(-1, len(features))
    return _cells(keys, np.array([float(r["n"]) for r in rows]), np.array([r["s"] for r in rows], float))


@dataclass(frozen=True)
class Split:
    feature: int
    threshold: float
    gain: float
    left: np.ndarray
    right: np.ndarray


def best_split(
    cells: Cells, node: np.ndarray, total: np.ndarray, penalty: float = 0.0
) -> Split | None:
    """The split of the cells ``node`` that lowers the squared error most; None for a single value.

    With G the sum of ``total`` and H the weight of a side, a side's score is G * G / (H +
    ``penalty``), and the gain is the sides' scores less that of the node.  ``total`` stands for
    the cells' own, so that boosting can pass residuals.
    """
    weight = cells.weight[node]
    g, h = float(total[node].sum()), float(weight.sum())
    best = None
    for k, values in enumerate(cells.values):
        at = cells.places[node, k]
        hs = np.bincount(at, weight, len(values))
        gs = np.bincount(at, total[node], len(values))
        held = np.flatnonzero(np.bincount(at, minlength=len(values)))[:-1]
        if not len(held):
            continue
        gl, hl = np.cumsum(gs)[held], np.cumsum(hs)[held]
        gains = gl * gl / (hl + penalty) + (g - gl) ** 2 / (h - hl + penalty) - g * g / (h + penalty)
        gains = np.round(gains, DIGITS)
        j = int(gains.argmax())
        if best is None or gains[j] > best[0]:
            best = (gains[j], k, held[j])
    if best is None:
        return None
    gain, k, last = best
    left = cells.places[node, k] <= last
    threshold = (cells.values[k][last] + cells.values[k][cells.places[node, k][~left].min()]) / 2
    return Split(k, float(threshold), float(gain), node[left], node[~left])


@dataclass(frozen=True)
class Boosting:
    """How boosted trees grow.

    A tree adds ``rate`` times its leaves' G / (H + ``penalty``) to the prediction, the first tree
    ``first_rate`` times.  A split must gain more than ``least_gain``, which is per unit of
    weight if ``per_weight``.  Predictions start at ``base``, the mean label if None.
    """

    depth: int = 3
    rounds: int = 100
    rate: float = 0.1
    penalty: float = 1.0
    least_gain: float = 1e-6
    per_weight: bool = False
    first_rate: float | None = None
    base: float | None = None

    def splits(self, cells: Cells) -> list[list[Split]]:
        """The splits of each tree, from the root down."""
        n = len(cells.weight)
        out: list[list[Split]] = []
        if not n:
            return [[] for _ in range(self.rounds)]
        base = cells.total.sum() / cells.weight.sum() if self.base is None else self.base
        predicted = np.full(n, float(base))
        for k in range(self.rounds):
            rate = self.first_rate if k == 0 and self.first_rate is not None else self.rate
            residual = cells.total - cells.weight * predicted
            tree: list[Split] = []
            level = [np.arange(n)]
            leaves = []
            for _ in range(self.depth):
                below = []
                for node in level:
                    split = best_split(cells, node, residual, self.penalty)
                    bar = self.least_gain * (cells.weight[node].sum() if self.per_weight else 1.0)
                    if split is None or not split.gain > bar:
                        leaves.append(node)
                    else:
                        tree.append(split)
                        below += [split.left, split.right]
                level = below
            for leaf in leaves + level:
                h = cells.weight[leaf].sum() + self.penalty
                predicted[leaf] += rate * residual[leaf].sum() / h
            out.append(tree)
        return out


def importances(cells: Cells, depth: int) -> np.ndarray | None:
    """Of one fully grown tree: the part of the gain that each feature's splits bring.

    A node is split while its cells' means differ; None if the root is not.
    """
    gains = np.zeros(len(cells.values))
    held = cells.weight > 0
    level = [np.flatnonzero(held)] if held.any() else []
    grown = False
    for _ in range(depth):
        below = []
        for node in level:
            w, s = cells.weight[node], cells.total[node]
            spread = float((s * s / w).sum() - s.sum() ** 2 / w.sum())
            split = best_split(cells, node, cells.total) if round(spread, DIGITS) > 0 else None
            if split is not None:
                grown = True
                gains[split.feature] += split.gain
                below += [split.left, split.right]
        level = below
    if not grown:
        return None
    return gains / gains.sum() if gains.sum() > 0 else gains


# A row is drawn as often as 16 bits of its hash reach one of these: the distribution function of
# a Poisson variable of mean 1, times 2 ** 16.
DRAWS = tuple(
    round(65536 * sum(math.exp(-1) / math.factorial(i) for i in range(k + 1))) for k in range(8)
)
#: Draws that one sha256 gives.
PER_HASH = 16


def draws(key: Column, trees: int, seed: int) -> Column:
    """How often each of ``trees`` samples draws the row: an array, from hashes of ``key``."""
    texts = [
        F.sha2(F.concat_ws(":", F.lit(str(seed)), F.lit(str(block)), key).cast("binary"), 256)
        for block in range((trees + PER_HASH - 1) // PER_HASH)
    ]

    def drawn(digits):
        def one(tree):
            bits = F.conv(F.substr(digits, tree * 4 + 1, F.lit(4)), 16, 10).cast("int")
            return sum([(bits >= d).cast("int") for d in DRAWS[1:]], (bits >= DRAWS[0]).cast("int"))

        return F.transform(F.sequence(F.lit(0), F.lit(trees - 1)), one)

    # One element, so that the hashes are taken once.
    return F.get(F.transform(F.array(F.concat(*texts)), drawn), F.lit(0))


def sampled_cells(
    df: DataFrame, features: Sequence[str], label: str, key: Column, trees: int, seed: int
) -> list[Cells]:
    """The cells of each bootstrap sample, from one aggregation of all rows.

    A sample draws a row by a hash of the row's ``key``, so it does not matter how the rows are
    dealt or in what order they come.  Rows of the same key are drawn alike.
    """
    sampled = (
        df.select(*features, label, F.posexplode(draws(key, trees, seed)).alias("tree", "w"))
        .filter(F.col("w") > 0)
        .groupBy("tree", *features)
        .agg(
            F.sum("w").alias("n"),
            exact_sum(F.col(label).cast(f"decimal(28,{LABEL_PLACES})") * F.col("w"), LABEL_PLACES)
            .cast("double")
            .alias("s"),
        )
    )
    rows = _checked(sampled.limit(MOST_CELLS * trees + 1).collect(), MOST_CELLS * trees)
    keys = np.array([[float(r[c]) for c in features] for r in rows]).reshape(-1, len(features))
    tree = np.array([r["tree"] for r in rows], np.int64)
    n = np.array([float(r["n"]) for r in rows])
    s = np.array([r["s"] for r in rows], float)
    out = []
    for k in range(trees):
        mine = np.flatnonzero(tree == k)
        mine = mine[np.lexsort(keys[mine].T[::-1])]
        out.append(_cells(keys[mine], n[mine], s[mine]))
    return out
