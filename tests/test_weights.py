"""Fits against numpy, and what must hold for the tree models."""

import random

import numpy as np
import pytest

from tests.conftest import rows
from tillwise.operators import weights
from tillwise.plans import reports
from tillwise.sources.shared import settle

SCHEMA = "r_quartile int, f_quartile int, m_quartile int, overall_share_per_merchant double"


def _points(n, seed=3):
    rng = random.Random(seed)
    out = []
    for _ in range(n):
        r, f, m = (rng.randint(1, 4) for _ in range(3))
        out.append((r, f, m, 0.02 * r + 0.01 * f + 0.2 * m + rng.gauss(0, 0.01)))
    return out


@pytest.fixture(scope="module")
def points(spark):
    return settle(spark.createDataFrame(_points(300), SCHEMA))


def _least_squares(data, scaled):
    x, y = np.array([p[:3] for p in data], float), np.array([p[3] for p in data])
    if scaled:
        x = (x - x.mean(0)) / x.std(0)
    a = np.c_[x, np.ones(len(x))]
    return np.linalg.lstsq(a, y, rcond=None)[0][:3]


def test_standardize(points):
    z = weights.standardize(points)
    got = np.array([tuple(r) for r in z.select("r_quartile", "r_quartile_z").collect()])
    assert got[:, 1] == pytest.approx((got[:, 0] - got[:, 0].mean()) / got[:, 0].std())


def test_linear_weights(points):
    scaled = weights.fit_linear_weights(points).first()
    assert tuple(scaled) == pytest.approx(_least_squares(_points(300), True), abs=1e-9)
    raw = weights.fit_linear_weights_raw(points).first()
    assert tuple(raw) == pytest.approx(_least_squares(_points(300), False), abs=1e-9)


def test_collinear_features_get_the_least_norm(spark):
    data = [(i, i, 5 - i, 0.1 * i * i) for i in (1, 2, 3, 4)]
    df = spark.createDataFrame(data, SCHEMA)
    for scaled, fit in ((True, weights.fit_linear_weights), (False, weights.fit_linear_weights_raw)):
        x, y = np.array([p[:3] for p in data], float), np.array([p[3] for p in data])
        x, y = x - x.mean(0), y - y.mean()
        x = x / x.std(0) if scaled else x
        assert tuple(fit(df).first()) == pytest.approx(np.linalg.lstsq(x, y, rcond=None)[0], abs=1e-9)


def test_rows_without_a_share_change_nothing(spark, points):
    more = points.unionByName(spark.createDataFrame([(4, 1, 4, None)], points.schema))
    fits = (
        weights.fit_linear_weights,
        weights.fit_linear_weights_raw,
        lambda df: weights.fit_forest_weights(df, trees=5),
        lambda df: weights.fit_boosted_weights(df, rounds=5),
    )
    for fit in fits:
        assert tuple(fit(more).first()) == pytest.approx(tuple(fit(points).first()))


def test_forest_does_not_depend_on_partitions(points):
    found = {
        tuple(weights.fit_forest_weights(points.repartition(n), trees=10).first())
        for n in (1, 3, 8)
    }
    assert len(found) == 1


def test_no_feature_varies(spark):
    df = spark.createDataFrame([(1, 1, 1, 0.5), (1, 1, 1, 0.7)], SCHEMA)
    assert tuple(weights.fit_linear_weights_raw(df).first()) == (0.0, 0.0, 0.0)


def test_tree_weights(points):
    fits = (
        weights.fit_forest_weights(points),
        weights.fit_boosted_weights(points, rounds=10),
    )
    for fitted in fits:
        w = fitted.first()
        assert min(w) >= 0
        assert sum(w) == pytest.approx(1)
    forest = fits[0].first()
    assert forest.monetary > 0.8


def test_boosting_never_splits_on_an_idle_feature(spark):
    idle = [(r, f, m, 0.1 * m * m) for r, f, m, _ in _points(100)]
    fitted = weights.fit_boosted_weights(spark.createDataFrame(idle, SCHEMA), rounds=5)
    assert tuple(fitted.first()) == (0.0, 0.0, 1.0)


def test_boosting_on_cells_equals_boosting_on_rows(points):
    """Split counts are those of a fit over the single rows."""
    import re

    from pyspark.ml.regression import GBTRegressor

    z = [f"{c}_z" for c in weights.FEATURES]
    training = weights._rows(weights.standardize(points), z, weights.LABEL)
    model = GBTRegressor(maxDepth=3, stepSize=0.1, maxIter=5, minInfoGain=1e-12, seed=42).fit(
        training
    )
    used = re.findall(r"If \(feature (\d+) ", model.toDebugString)
    want = [used.count(str(i)) / len(used) for i in range(3)]
    assert tuple(weights.fit_boosted_weights(points, rounds=5).first()) == pytest.approx(want)


def test_scores(spark, points):
    given = {"recency": 1.0, "frequency": 2.0, "monetary": 3.0}
    frame = spark.createDataFrame(
        [tuple(given.values())], "recency double, frequency double, monetary double"
    )
    plain = weights.apply_weights(points, given)
    assert rows(plain) == rows(weights.apply_weights(points, frame))
    scored = weights.normalize_by_max(plain)
    assert max(r.normalized_weighted_rfm for r in scored.collect()) == 1.0
    top = max(r.weighted_rfm for r in plain.collect())
    for w in (given, frame):
        assert weights.scaled_weight_by_max(plain, w).first()[0] == pytest.approx(3 / top)
    shares = weights.normalize_to_shares(frame).first()
    assert tuple(shares) == pytest.approx((1 / 6, 2 / 6, 3 / 6))


def test_more_than_one_row_of_weights_is_an_error(spark, points):
    two = spark.createDataFrame(
        [(1.0, 1.0, 1.0)] * 2, "recency double, frequency double, monetary double"
    )
    with pytest.raises(Exception, match="SCALAR_SUBQUERY_TOO_MANY_ROWS"):
        weights.apply_weights(points, two).collect()


def test_weighted_scores_chain(points):
    out = reports.weighted_scores(points, weights.fit_linear_weights)
    assert {"weighted_rfm", "normalized_weighted_rfm"} <= set(out.columns)
    assert out.count() == 300
