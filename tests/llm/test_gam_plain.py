"""The additive model against plain versions: tree cuts tried one by one, scores added up by loops."""

import bisect
import itertools
import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from tillwise.llm import quality_gam
from tillwise.llm.quality_gam import BINS, LEAVES, PAIR_BINS

SMALL = "/root/testdata/sf0.001"


def _score(g, h):
    return sum(g) ** 2 / (sum(h) + 1)


def _plain_tree(g, h):
    """Cut where it gains most, over all parts and places, until there are ``LEAVES`` leaves."""
    parts = [(0, len(g))]
    while len(parts) < LEAVES:
        options = [
            (_score(g[a:k], h[a:k]) + _score(g[k:b], h[k:b]) - _score(g[a:b], h[a:b]), a, k, b)
            for a, b in parts
            for k in range(a + 1, b)
        ]
        gain, a, k, b = max(options)
        if gain <= 1e-9:
            break
        parts.remove((a, b))
        parts += [(a, k), (k, b)]
    out = [0.0] * len(g)
    for a, b in parts:
        out[a:b] = [sum(g[a:b]) / (sum(h[a:b]) + 1)] * (b - a)
    return out


@pytest.mark.parametrize("seed", range(8))
def test_tree_equals_all_cuts_tried(seed):
    rng = np.random.default_rng(seed)
    g, h = rng.normal(size=BINS) * 5, rng.random(BINS) * 4
    assert quality_gam._tree(g, h) == pytest.approx(_plain_tree(g.tolist(), h.tolist()))


@pytest.mark.parametrize("seed", range(5))
def test_pair_tree_equals_all_cuts_tried(seed):
    """One cut of a side, then one cut of the other side in each half: the best of all gains."""
    rng = np.random.default_rng(seed)
    g, h = rng.normal(size=(PAIR_BINS, PAIR_BINS)) * 3, rng.random((PAIR_BINS, PAIR_BINS)) * 2
    score = lambda a, b: a.sum() ** 2 / (b.sum() + 1)
    best = 0.0
    for turned, cut in itertools.product((False, True), range(1, PAIR_BINS)):
        a, b = (g.T, h.T) if turned else (g, h)
        total = 0.0
        for rows in (slice(0, cut), slice(cut, None)):
            sides = [
                score(a[rows, :k], b[rows, :k]) + score(a[rows, k:], b[rows, k:]) for k in range(1, PAIR_BINS)
            ]
            total += max(sides)
        best = max(best, total)
    gain, values = quality_gam._pair_tree(g, h)
    assert gain == pytest.approx(best - score(g, h))
    # The values are those of four leaves with that gain.
    leaves = sum(score(g[values == v], h[values == v]) for v in np.unique(values))
    assert leaves == pytest.approx(best)


def _plain_score(model, x):
    bins = [bisect.bisect_right(model.edges[j].tolist(), v) for j, v in enumerate(x)]
    total = model.base + sum(t[b] for t, b in zip(model.tables, bins))
    for (i, j), values in zip(model.pairs, model.pair_tables):
        total += values[bins[i] * PAIR_BINS // BINS][bins[j] * PAIR_BINS // BINS]
    return 1 / (1 + math.exp(-min(30, max(-30, total))))


def test_scores_equal_looked_up_sums(spark):
    docs = spark.read.parquet(f"{SMALL}/documents.parquet")
    labels = spark.read.parquet(f"{SMALL}/labels.parquet")
    x = quality_gam.described(docs).cache()
    model = quality_gam.train(x, labels)
    want = {r.doc_id: _plain_score(model, r.x) for r in x.collect()}
    got = {r.doc_id: r.score for r in quality_gam.classify(docs, labels).collect()}
    assert got.keys() == want.keys()
    for i, score in got.items():
        assert score == pytest.approx(want[i], abs=1e-9)


def test_model_learns_from_the_named_fold_only(spark):
    """Turning the labels of the held-out fold around changes no score."""
    docs = spark.read.parquet(f"{SMALL}/documents.parquet")
    labels = spark.read.parquet(f"{SMALL}/labels.parquet")
    held = quality_gam.fold(F.col("doc_id")) == 0
    turned = labels.withColumn("quality", F.when(held, 1 - F.col("quality")).otherwise(F.col("quality")))
    scores = lambda some: sorted((r.doc_id, r.score) for r in quality_gam.classify(docs, some).collect())
    assert labels.filter(held).count() > 0
    assert scores(labels) == scores(turned)
