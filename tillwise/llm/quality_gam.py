"""Quality classifier: a generalised additive model with pairwise interactions.

Each document becomes some twenty numbers.  The model is a sum of lookup tables over the bins of
single numbers and of pairs of them.  The tables are learned by cyclic gradient boosting: in each
round every number in turn gets one shallow tree on the logistic gradients, which is added, shrunk,
to its table; then the pairs that explain most of what is left get their turn in the same way.
A score is the logistic function of the sum of the looked-up values.

Numbers are computed in one pass over the texts and stored.  Fitting takes
every k-th labelled row by hash, with the least k that leaves about ``most_labels`` at most, so it
is bounded whatever the input.
"""

from __future__ import annotations

import operator
from collections.abc import Iterator
from itertools import islice

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tillwise.llm.common import table
from tillwise.sources.shared import settle

#: Bound on the labelled rows that a model is fitted on (in expectation, as they are chosen by hash).
MOST_LABELS = 100_000
BINS = 48
PAIR_BINS = 12
ROUNDS = 60
PAIR_ROUNDS = 25
PAIRS = 8
RATE = 0.15
LEAVES = 4

NAMES = (
    "words word_length word_spread longest distinct doubled trigrams lines line_words line_repeats upper "
    "digits symbols marks bangs bars titles short ends entropy"
).split()
_UPPER = bytes(range(65, 91))
_DIGITS = bytes(range(48, 58))
_SYMBOLS = b"#*$%&<>@^~=+\\/_{}[]"
_MARKS = b".,;:?'\"()-"


def numbers(text: str | None) -> list[float]:
    """The document's numbers, in the order of ``NAMES``; all 0 for texts without words."""
    text = text or ""
    words = text.split()
    n = len(words)
    if not n:
        return [0.0] * len(NAMES)
    raw = text.encode("utf-8", "surrogatepass")
    size = len(raw)
    share = lambda some: (size - len(raw.translate(None, some))) / size
    lengths = np.fromiter(map(len, words), np.float64, n)
    lines = text.split("\n")
    counts = np.bincount(np.frombuffer(raw, np.uint8), minlength=256)
    p = counts[counts > 0] / size
    triples = len(set(zip(words, islice(words, 1, None), islice(words, 2, None)))) if n > 2 else 1
    return [
        np.log1p(n),
        float(lengths.mean()),
        float(lengths.std()),
        float(lengths.max()),
        len(set(words)) / n,
        sum(map(operator.eq, words, islice(words, 1, None))) / n,
        triples / max(1, n - 2),
        np.log1p(len(lines)),
        n / len(lines),
        1 - len(set(lines)) / len(lines),
        share(_UPPER),
        share(_DIGITS),
        share(_SYMBOLS),
        share(_MARKS),
        share(b"!"),
        share(b"|"),
        sum(map(str.istitle, words)) / n,
        float((lengths <= 3).mean()),
        sum(w[-1] in ".,;:!?" for w in words) / n,
        float(-(p * np.log2(p)).sum()),
    ]


class Additive:
    """Bin edges, lookup tables and pair tables."""

    def __init__(self, edges, base, tables, pairs, pair_tables):
        self.edges, self.base, self.tables = edges, base, tables
        self.pairs, self.pair_tables = pairs, pair_tables

    def binned(self, x: np.ndarray) -> np.ndarray:
        columns = [np.searchsorted(e, x[:, j], "right") for j, e in enumerate(self.edges)]
        return np.stack(columns, 1).astype(np.uint8) if columns else np.zeros((len(x), 0), np.uint8)

    def score(self, x: np.ndarray) -> np.ndarray:
        bins = self.binned(x)
        total = np.full(len(x), self.base)
        for j, values in enumerate(self.tables):
            total += values[bins[:, j]]
        for (i, j), values in zip(self.pairs, self.pair_tables):
            total += values[_coarse(bins[:, i]), _coarse(bins[:, j])]
        return 1 / (1 + np.exp(-np.clip(total, -30, 30)))


def _coarse(bins: np.ndarray) -> np.ndarray:
    return bins.astype(np.int64) * PAIR_BINS // BINS


def _cut(g: np.ndarray, h: np.ndarray, low: int, high: int) -> tuple[float, int]:
    """Best gain of cutting bins low..high in two, and where."""
    if high - low < 2:
        return 0.0, low
    left_g, left_h = np.cumsum(g[low:high])[:-1], np.cumsum(h[low:high])[:-1]
    all_g, all_h = g[low:high].sum(), h[low:high].sum()
    gain = left_g**2 / (left_h + 1) + (all_g - left_g) ** 2 / (all_h - left_h + 1) - all_g**2 / (all_h + 1)
    k = int(gain.argmax())
    return float(gain[k]), low + k + 1


def _tree(g: np.ndarray, h: np.ndarray) -> np.ndarray:
    """Values per bin of a tree with ``LEAVES`` leaves on gradient and curvature sums."""
    parts = [(0, len(g))]
    while len(parts) < LEAVES:
        gain, at, k = max((*_cut(g, h, *p), i) for i, p in enumerate(parts))
        if gain <= 1e-9:
            break
        low, high = parts[k]
        parts[k : k + 1] = [(low, at), (at, high)]
    out = np.zeros(len(g))
    for low, high in parts:
        out[low:high] = g[low:high].sum() / (h[low:high].sum() + 1)
    return out


def _pair_tree(g: np.ndarray, h: np.ndarray) -> tuple[float, np.ndarray]:
    """Gain and values of a tree of depth two: one cut of the rows, each half cut by columns."""
    best, values = 0.0, np.zeros_like(g)
    for turned in (False, True):
        a, b = (g.T, h.T) if turned else (g, h)
        top_a, top_b = np.cumsum(a, 0), np.cumsum(b, 0)
        for cut in range(1, len(a)):
            gain, halves = 0.0, []
            for ga, hb in ((top_a[cut - 1], top_b[cut - 1]), (top_a[-1] - top_a[cut - 1], top_b[-1] - top_b[cut - 1])):
                more, at = _cut(ga, hb, 0, len(ga))
                gain += more + ga.sum() ** 2 / (hb.sum() + 1)
                halves.append((ga, hb, at))
            if gain > best:
                out = np.zeros_like(a)
                for rows, (ga, hb, at) in zip((slice(0, cut), slice(cut, None)), halves):
                    for columns in (slice(0, at), slice(at, None)):
                        out[rows, columns] = ga[columns].sum() / (hb[columns].sum() + 1)
                best, values = gain, out.T if turned else out
    return best - g.sum() ** 2 / (h.sum() + 1), values


def fit(x: np.ndarray, y: np.ndarray) -> Additive:
    """Learn the tables.  Without rows, or with one class only, the model is (nearly) constant."""
    features = x.shape[1]
    edges = []
    for j in range(features):
        levels = np.unique(np.quantile(x[:, j], np.linspace(0, 1, BINS + 1)[1:-1])) if len(x) else np.zeros(0)
        edges.append(levels)
    rate = (y.sum() + 0.5) / (len(y) + 1)
    model = Additive(edges, float(np.log(rate / (1 - rate))), [np.zeros(BINS) for _ in range(features)], [], [])
    if not len(x):
        return model
    bins = model.binned(x).astype(np.int64)
    total = np.full(len(y), model.base)

    def slopes():
        p = 1 / (1 + np.exp(-total))
        return y - p, p * (1 - p)

    for _ in range(ROUNDS):
        for j in range(features):
            g, h = slopes()
            step = RATE * _tree(np.bincount(bins[:, j], g, BINS), np.bincount(bins[:, j], h, BINS))
            model.tables[j] += step
            total += step[bins[:, j]]
    coarse = _coarse(bins)
    g, h = slopes()
    cell = lambda i, j: coarse[:, i] * PAIR_BINS + coarse[:, j]
    square = lambda c, v: np.bincount(c, v, PAIR_BINS**2).reshape(PAIR_BINS, PAIR_BINS)
    gains = []
    for i in range(features):
        for j in range(i):
            c = cell(i, j)
            gains.append((_pair_tree(square(c, g), square(c, h))[0], i, j))
    model.pairs = [(i, j) for _, i, j in sorted(gains, reverse=True)[:PAIRS]]
    model.pair_tables = [np.zeros((PAIR_BINS, PAIR_BINS)) for _ in model.pairs]
    cells = [cell(i, j) for i, j in model.pairs]
    for _ in range(PAIR_ROUNDS):
        for c, values in zip(cells, model.pair_tables):
            g, h = slopes()
            step = RATE * _pair_tree(square(c, g), square(c, h))[1]
            values += step
            total += step.ravel()[c]
    return model


def described(docs: DataFrame) -> DataFrame:
    """``doc_id`` and ``x``, the document's numbers; one row per row of ``docs``."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 1000):
                few = batch.slice(at, 1000)
                x = [numbers(t) for t in few.column("text").to_pylist()]
                yield pa.RecordBatch.from_arrays(
                    [few.column("doc_id"), pa.array(x, pa.list_(pa.float64()))], names=["doc_id", "x"]
                )

    narrow = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), "text")
    return narrow.mapInArrow(run, "doc_id bigint, x array<double>")


def fold(doc_id: Column) -> Column:
    return F.crc32(doc_id.cast("string").cast("binary")) % 5


def train(described_docs: DataFrame, labels: DataFrame, most_labels: int = MOST_LABELS) -> Additive:
    """Fit on labelled rows outside fold 0.  Documents with several labels take the lowest; null
    labels and labels of unknown documents are not used."""
    known = labels.filter(F.col("quality").isNotNull() & F.col("doc_id").isNotNull())
    known = known.groupBy("doc_id").agg(F.min("quality").alias("quality"))
    known = known.filter(fold(F.col("doc_id")) != 0)
    part = max(1, -(-known.count() // most_labels))
    known = known.filter(F.pmod(F.xxhash64("doc_id"), F.lit(part)) == 0)
    rows = described_docs.join(known, "doc_id").select("doc_id", "x", "quality")
    rows = rows.toPandas().sort_values(["doc_id", "quality"], kind="stable")
    x = np.array(rows["x"].tolist(), np.float64).reshape(-1, len(NAMES))
    order = np.lexsort((*x.T, rows["doc_id"].to_numpy(np.int64)))
    return fit(x[order], rows["quality"].to_numpy(np.float64)[order])


def classify(docs: DataFrame, labels: DataFrame, **options) -> DataFrame:
    """One row per document: ``doc_id``, ``score`` (probability of label 1) and ``x``.

    Null and empty texts are scored like any other, with all numbers 0.  Labels, languages,
    sources and ids are no inputs of the score.  Repeated rows get equal scores.
    """
    x = settle(described(docs))
    model = train(x, labels, **options)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            flat = batch.column("x").flatten().to_numpy(zero_copy_only=False)
            scores = model.score(flat.reshape(-1, len(NAMES)))
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), pa.array(scores, pa.float64()), batch.column("x")],
                names=["doc_id", "score", "x"],
            )

    return x.mapInArrow(run, "doc_id bigint, score double, x array<double>")


def op6_gam_quality(spark, folder):
    scored = classify(table(spark, folder, "documents"), table(spark, folder, "labels"))
    return scored.select(
        "doc_id",
        F.coalesce(fold(F.col("doc_id")) == 0, F.lit(False)).alias("held_out"),
        "score",
        (F.col("score") >= 0.3).cast("int").alias("predicted"),
    )
