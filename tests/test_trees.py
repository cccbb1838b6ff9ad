"""Trees grown on cells against plain versions over the single rows."""

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from tests.conftest import plan
from tillwise.operators import trees, weights
from tillwise.operators.trees import Boosting

SCHEMA = "name string, r_quartile int, f_quartile int, m_quartile int, overall_share_per_merchant double"
DATA = "r_quartile", "f_quartile", "m_quartile"


def _points(n, seed=11):
    rng = random.Random(seed)
    out = []
    for i in range(n):
        r, f, m = (rng.randint(1, 4) for _ in range(3))
        out.append((f"m{i}", r, f, m, 0.03 * r * f + 0.1 * (m > 2) + rng.gauss(0, 0.02)))
    return out


@pytest.fixture(scope="module")
def points(spark):
    return spark.createDataFrame(_points(200), SCHEMA).cache()


def _plain_split(x, g, rows, penalty):
    """Of single rows: (gain, feature, threshold), the first of those that gain most."""
    best = None
    whole = g[rows].sum() ** 2 / (len(rows) + penalty)
    for k in range(x.shape[1]):
        values = sorted(set(x[rows, k]))
        for low, high in zip(values, values[1:]):
            left, right = rows[x[rows, k] <= low], rows[x[rows, k] > low]
            gain = sum(g[s].sum() ** 2 / (len(s) + penalty) for s in (left, right)) - whole
            if best is None or round(gain, 12) > best[0]:
                best = (round(gain, 12), k, (low + high) / 2)
    return best


def _plain_boosting(x, y, depth, rounds, rate, penalty, least):
    predicted, out = np.full(len(y), y.mean()), []
    for tree in range(rounds):
        g, level, place = y - predicted, [np.arange(len(y))], 0
        leaves = []
        for _ in range(depth):
            below = []
            for rows in level:
                found = _plain_split(x, g, rows, penalty)
                if found is None or not found[0] > least:
                    leaves.append(rows)
                    continue
                gain, k, threshold = found
                out.append((tree, place, DATA[k], threshold, gain))
                place += 1
                below += [rows[x[rows, k] <= threshold], rows[x[rows, k] > threshold]]
            level = below
        for rows in leaves + level:
            predicted[rows] += rate * g[rows].sum() / (len(rows) + penalty)
    return out


@pytest.mark.parametrize("penalty, least", [(1.0, 1e-6), (0.0, 1e-6), (5.0, 1e-3)])
def test_boosting_on_cells_equals_boosting_on_rows(points, penalty, least):
    data = _points(200)
    x, y = np.array([p[1:4] for p in data], float), np.array([p[4] for p in data])
    boosting = Boosting(rounds=12, penalty=penalty, least_gain=least)
    got = [tuple(r) for r in weights.boosted_splits(points, boosting=boosting).collect()]
    want = _plain_boosting(x, y, 3, 12, 0.1, penalty, least)
    assert [g[:4] for g in got] == [w[:4] for w in want]
    assert [g[4] for g in got] == pytest.approx([w[4] for w in want], abs=1e-9)
    used = [g[2] for g in got]
    shares = weights.fit_penalized_weights(points, boosting=boosting).first()
    assert tuple(shares) == pytest.approx([used.count(k) / len(used) for k in DATA])


def test_a_large_penalty_stops_all_splits(points):
    boosting = Boosting(rounds=3, penalty=1e9)
    assert weights.boosted_splits(points, boosting=boosting).count() == 0
    assert tuple(weights.fit_penalized_weights(points, boosting=boosting).first()) == (None,) * 3


def test_a_fit_is_one_aggregation(points):
    """The rows are read and shuffled once, however many trees grow."""
    seen = []
    build = trees.cells_of
    with pytest.MonkeyPatch.context() as patch:
        patch.setattr(trees, "cells_of", lambda *a: seen.append(a) or build(*a))
        weights.fit_penalized_weights(points)
    assert len(seen) == 1
    assert plan(seen[0][0].groupBy(*DATA).count()).count("Exchange hashpartitioning") <= 1


def _plain_importance(x, y, drawn):
    """Gain per feature of one full tree over the rows as often as they are drawn."""
    x, y = np.repeat(x, drawn, axis=0), np.repeat(y, drawn)
    gains, level = np.zeros(3), [np.arange(len(y))]
    while level:
        below = []
        for rows in level:
            found = _plain_split(x, y, rows, 0.0)
            if found is None:
                continue
            gain, k, threshold = found
            gains[k] += gain
            below += [rows[x[rows, k] <= threshold], rows[x[rows, k] > threshold]]
        level = below
    return gains / gains.sum()


def test_forest_equals_full_trees_on_drawn_rows(points):
    data = _points(200)
    x, y = np.array([p[1:4] for p in data], float), np.array([p[4] for p in data])
    drawn = points.select("name", trees.draws(F.col("name"), 7, 42).alias("w")).collect()
    times = {r["name"]: r["w"] for r in drawn}
    counts = np.array([times[p[0]] for p in data])
    want = np.mean([_plain_importance(x, y, counts[:, k]) for k in range(7)], axis=0)
    got = weights.fit_forest_weights(points, trees=7, key=["name"]).first()
    assert tuple(got) == pytest.approx(want / want.sum(), abs=1e-9)


def test_draws_are_those_of_a_bootstrap(spark):
    """Poisson draws of mean 1, independent between trees, the same on every run."""
    rows = spark.range(4000).select(trees.draws(F.col("id").cast("string"), 20, 1).alias("w"))
    w = np.array([r["w"] for r in rows.collect()])
    assert w.shape == (4000, 20)
    assert abs(w.mean() - 1) < 0.02 and abs(w.var() - 1) < 0.05
    assert abs((w == 0).mean() - np.exp(-1)) < 0.01
    assert np.abs(np.corrcoef(w.T) - np.eye(20)).max() < 0.08
    other = spark.range(4000).select(trees.draws(F.col("id").cast("string"), 20, 2).alias("w"))
    assert (np.array([r["w"] for r in other.collect()]) != w).any()


def test_forest_is_the_same_for_any_partitions_and_order(points):
    found = set()
    for n in (1, 3, 8):
        df = points.repartition(n).sortWithinPartitions(F.rand(n))
        found.add(tuple(weights.fit_forest_weights(df, trees=20, key=["name"]).first()))
    assert len(found) == 1


def test_missing_labels_and_features_are_left_out(spark, points):
    more = points.unionByName(
        spark.createDataFrame([("a", 1, 1, 1, None), ("b", None, 2, 2, 5.0), (None, 4, None, 1, 5.0)], SCHEMA)
    )
    for fit in (
        lambda df: weights.fit_forest_weights(df, trees=5, key=["name"]),
        lambda df: weights.fit_penalized_weights(df, boosting=Boosting(rounds=5)),
        lambda df: weights.fit_boosted_weights(df, rounds=5),
    ):
        assert tuple(fit(more).first()) == tuple(fit(points).first())


def test_empty_and_constant_frames(spark):
    none = spark.createDataFrame([], SCHEMA)
    flat = spark.createDataFrame([("a", 1, 1, 1, 0.5), ("b", 1, 1, 1, 0.7), ("b", 1, 1, 1, 0.7)], SCHEMA)
    for df in (none, flat):
        assert tuple(weights.fit_forest_weights(df, trees=3).first()) == (0.0, 0.0, 0.0)
        assert tuple(weights.fit_penalized_weights(df).first()) == (None, None, None)
        assert weights.boosted_splits(df).count() == 0


def test_too_many_cells_are_an_error(points, monkeypatch):
    monkeypatch.setattr(trees, "MOST_CELLS", 10)
    with pytest.raises(ValueError, match="bin the features"):
        weights.fit_penalized_weights(points)
    with pytest.raises(ValueError, match="bin the features"):
        weights.fit_forest_weights(points, trees=2)
