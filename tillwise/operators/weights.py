"""Weights of the three RFM quartiles, fitted to explain the channel share.

Every fit is one aggregation of the whole frame; only the three weights come back, as a
one-row frame (recency, frequency, monetary).  One-row frames enter other frames as scalar
subqueries, not as joins.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence

import numpy as np
from pyspark.ml.feature import VectorAssembler
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tillwise.operators import trees as trees_of
from tillwise.operators.trees import Boosting
from tillwise.sources.shared import reusable

FEATURES = ("r_quartile", "f_quartile", "m_quartile")
LABEL = "overall_share_per_merchant"
NAMES = ("recency", "frequency", "monetary")


def _row(df: DataFrame, values: Sequence[float]) -> DataFrame:
    schema = ", ".join(f"{n} double" for n in NAMES)
    return df.sparkSession.createDataFrame([tuple(float(v) for v in values)], schema)


def _scalar(df: DataFrame, **columns: Column) -> Column:
    """Aggregates of ``df`` as one struct value."""
    return df.agg(F.struct(*[c.alias(n) for n, c in columns.items()]).alias("v")).scalar()


def standardize(df: DataFrame, cols: Sequence[str] = FEATURES) -> DataFrame:
    """Add ``<col>_z``: distance from the mean in population standard deviations.

    A constant column becomes 0.
    """
    stats = _scalar(
        df,
        **{f"mean_{c}": F.avg(c) for c in cols},
        **{f"dev_{c}": F.stddev_pop(c) for c in cols},
    )
    return df.withColumns(
        {
            f"{c}_z": F.when(stats[f"dev_{c}"] == 0, F.lit(0.0)).otherwise(
                (F.col(c) - stats[f"mean_{c}"]) / stats[f"dev_{c}"]
            )
            for c in cols
        }
    )


def _rows(df: DataFrame, features: Sequence[str], label: str) -> DataFrame:
    vectors = VectorAssembler(inputCols=list(features), outputCol="features")
    return vectors.transform(df.select(*features, F.col(label).cast("double").alias("label")))


def _labelled(df: DataFrame, label: str) -> DataFrame:
    """The rows a fit learns from: those with a label."""
    return df.filter(F.col(label).isNotNull())


def fit_linear_weights_raw(
    df: DataFrame, features: Sequence[str] = FEATURES, label: str = LABEL
) -> DataFrame:
    """Least-squares coefficients of ``label`` on ``features``, as they are.

    All comes from one aggregate of second moments.  Where features determine each other, the
    solution of least norm is given; a constant feature gets weight 0.  Rows without a label are
    left out; without rows all weights are 0.
    """
    names = [*features, label]
    pairs = [(i, j) for i in range(len(names)) for j in range(i + 1)]
    stats = (
        _labelled(df, label)
        .agg(*[F.covar_pop(names[i], names[j]).alias(f"cov_{i}_{j}") for i, j in pairs])
        .first()
    )
    cov = np.zeros((len(names), len(names)))
    for i, j in pairs:
        cov[i, j] = cov[j, i] = stats[f"cov_{i}_{j}"] or 0.0
    n = len(features)
    return _row(df, np.linalg.pinv(cov[:n, :n], rcond=1e-10, hermitian=True) @ cov[:n, n])


def fit_linear_weights(
    df: DataFrame, features: Sequence[str] = FEATURES, label: str = LABEL
) -> DataFrame:
    """Least-squares coefficients on standardized features."""
    scaled = standardize(reusable(_labelled(df, label)), features)
    return fit_linear_weights_raw(scaled, [f"{c}_z" for c in features], label)


def fit_forest_weights(
    df: DataFrame,
    features: Sequence[str] = FEATURES,
    label: str = LABEL,
    trees: int = 100,
    seed: int = 42,
    depth: int = 9,
    key: Sequence[str] | None = None,
) -> DataFrame:
    """Feature importances of a random forest that sees all features at every split.

    Each tree draws rows with replacement by hashes of ``key``, columns that tell rows apart, or
    of all columns (rows alike in these are drawn together), so the fit is the same however the
    frame is partitioned.  One aggregation gives the cells of all trees (``operators.trees``).
    An importance is the part of a tree's gain that a feature's splits bring, averaged over
    the trees that split at all; without any, all are 0.  Rows without a label or with a missing
    feature are left out.  Three features of four levels each can be split nine times at most,
    so ``depth`` 9 grows the trees in full.
    """
    names = sorted(df.columns) if key is None else list(key)
    # A missing value must not vanish from the key.
    parts = [F.coalesce(F.col(f"`{c}`").cast("string"), F.lit("\0")) for c in names]
    known = _labelled(df, label).dropna(subset=list(features))
    samples = trees_of.sampled_cells(known, features, label, F.concat_ws(":", *parts), trees, seed)
    found = [x for x in (trees_of.importances(s, depth) for s in samples) if x is not None]
    mean = np.mean(found, axis=0) if found else np.zeros(len(features))
    return _row(df, mean / mean.sum() if mean.sum() > 0 else mean)


def boosted_splits(
    df: DataFrame,
    features: Sequence[str] = FEATURES,
    label: str = LABEL,
    boosting: Boosting = Boosting(),
) -> DataFrame:
    """Every split of the boosted trees: ``tree``, ``place``, ``feature``, ``threshold``, ``gain``.

    ``tree`` and ``place`` count from 0; a tree's splits are listed level by level.  Features are
    taken as they are: scaling moves thresholds and changes no split.  Rows without a label or
    with a missing feature are left out.
    """
    grown = _grown(df, features, label, boosting)
    rows = [
        (k, i, features[s.feature], s.threshold, s.gain)
        for k, tree in enumerate(grown)
        for i, s in enumerate(tree)
    ]
    schema = "tree bigint, place bigint, feature string, threshold double, gain double"
    return df.sparkSession.createDataFrame(rows, schema)


def _grown(
    df: DataFrame, features: Sequence[str], label: str, boosting: Boosting
) -> list[list[trees_of.Split]]:
    known = _labelled(df, label).dropna(subset=list(features))
    return boosting.splits(trees_of.cells_of(known, features, label))


def _split_shares(
    df: DataFrame, features: Sequence[str], label: str, boosting: Boosting
) -> DataFrame:
    used = [s.feature for tree in _grown(df, features, label, boosting) for s in tree]
    return normalize_to_shares(_row(df, [used.count(k) for k in range(len(features))]))


def fit_penalized_weights(
    df: DataFrame,
    features: Sequence[str] = FEATURES,
    label: str = LABEL,
    boosting: Boosting = Boosting(),
) -> DataFrame:
    """How often second-order boosted trees split on each feature, as shares of all splits.

    Leaves carry an L2 penalty, trees start from the mean label, and every tree counts by the
    same rate.  All trees grow from one aggregation of the rows.  NULL shares mean that no tree
    splits.
    """
    return _split_shares(df, features, label, boosting)


def fit_boosted_weights(
    df: DataFrame,
    features: Sequence[str] = FEATURES,
    label: str = LABEL,
    depth: int = 3,
    eta: float = 0.1,
    rounds: int = 100,
    min_gain: float = 1e-12,
) -> DataFrame:
    """The same for gradient boosting without penalty, whose first tree counts in full.

    It splits as a fit over the single rows does.  ``min_gain``, per row, keeps rounding errors
    from passing as gains.
    """
    # The gradient of the squared error is twice the residual: the step is twice ``eta``, and
    # so doubled residuals must reach ``min_gain`` with four times the gain.
    boosting = Boosting(depth, rounds, 2 * eta, 0.0, min_gain / 4, True, 1.0, 0.0)
    return _split_shares(df, features, label, boosting)


def normalize_to_shares(weights: DataFrame) -> DataFrame:
    """Divide each weight by their sum."""
    total = F.nullif(sum((F.col(n) for n in NAMES[1:]), F.col(NAMES[0])), F.lit(0.0))
    return weights.select(*[(F.col(n) / total).alias(n) for n in NAMES])


def weighted_sum(
    weights: Mapping[str, float] | DataFrame,
    features: Sequence[str] = FEATURES,
    divisor: float = 1,
) -> Column:
    """Sum of ``weight / divisor * feature``; the weights are numbers or a one-row frame."""
    if isinstance(weights, DataFrame):
        held = weights.select(F.struct(*NAMES).alias("w")).scalar()
        values = [held[n] for n in NAMES]
    else:
        values = [F.lit(float(weights[n])) for n in NAMES]
    terms = [w / F.lit(divisor) * F.col(c) for w, c in zip(values, features)]
    return sum(terms[1:], terms[0])


def apply_weights(
    df: DataFrame,
    weights: Mapping[str, float] | DataFrame,
    features: Sequence[str] = FEATURES,
) -> DataFrame:
    """Add ``weighted_rfm``."""
    return df.withColumn("weighted_rfm", weighted_sum(weights, features))


def normalize_by_max(df: DataFrame, col: str = "weighted_rfm") -> DataFrame:
    """Add ``normalized_<col>``: the column over its largest value."""
    largest = df.agg(F.max(col)).scalar()
    return df.withColumn(f"normalized_{col}", F.col(col) / F.nullif(largest, F.lit(0.0)))


def scaled_weight_by_max(
    df: DataFrame,
    weights: Mapping[str, float] | DataFrame,
    name: str = "monetary",
    col: str = "weighted_rfm",
) -> DataFrame:
    """One weight over the largest weighted score, as a one-row frame ``scaled_weight``."""
    if isinstance(weights, DataFrame):
        weight = weights.select(name).scalar()
    else:
        weight = F.lit(float(weights[name]))
    return df.agg(F.max(col).alias("largest")).select(
        (weight / F.nullif(F.col("largest"), F.lit(0.0))).alias("scaled_weight")
    )
