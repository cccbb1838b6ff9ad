"""Quality rules: robust multivariate outliers per language and source.

Every document has a vector of transformed statistics.  For each (lang, source) the minimum
covariance determinant estimate of centre and scatter is found by concentration steps: start
from the medians and median deviations, then again and again take the ``support`` share of the
rows with the least Mahalanobis distances and compute mean and covariance from them.  A document
is rejected when its distance under the last estimate is above the cut.

Only DataFrame operations.  Statistics are kept as whole thousandths and summed exactly, so
results do not depend on the order of rows.  Distances are counted in bins per group, so no
group is ever brought together in a task; groups below ``least_rows`` rows use the estimate over
all documents.
"""

from __future__ import annotations

import math
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tillwise.llm.common import SPACE, table
from tillwise.sources.shared import settle, sized

WINDOW = 5
SUPPORT = 0.75
STEPS = 4
LEAST_ROWS = 200
#: Share of normal documents that the cut keeps.
QUANTILE = 0.999
#: Each statistic with the least standard deviation it is given, in its own units: small enough
#: that each can reject by itself, also repeats, of which the base rule leaves a fifth at most.
FLOORS = {"word_length": 0.10, "symbols": 0.04, "dup_lines": 0.10, "repeats": 0.07, "capitals": 0.05}
UNIT = 1000


def chi_square(x: float, df: int) -> float:
    """Distribution function of chi-square with an odd number of degrees of freedom."""
    term, total = math.sqrt(2 * x / math.pi) * math.exp(-x / 2), math.erf(math.sqrt(x / 2))
    for k in range(1, df, 2):
        total -= term
        term *= x / (k + 2)
    return total


def chi_square_quantile(share: float, df: int) -> float:
    low, high = 0.0, 1000.0
    for _ in range(100):
        middle = (low + high) / 2
        low, high = (middle, high) if chi_square(middle, df) < share else (low, middle)
    return low


def cut_at(quantile: float = QUANTILE, support: float = SUPPORT) -> float:
    """Squared distance above which a document is rejected: a quantile of chi-square, times the
    consistency factor of a scatter taken from the ``support`` share of the closest rows."""
    df = len(FLOORS)
    kept = chi_square(chi_square_quantile(support, df), df + 2) if support < 1 else 1.0
    return chi_square_quantile(quantile, df) * support / kept


CUT = cut_at()


def _let(value: Column, body) -> Column:
    """``body(value)`` with the value computed once, not once per element of inner lambdas."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def repeated_words(words: Column, window: int = WINDOW) -> Column:
    """How many words lie in a window of ``window`` words that the array holds twice or more.

    Windows are compared by 64-bit hash; only texts in which a hash repeats are sorted.
    """

    def covered(hashes: Column) -> Column:
        placed = F.transform(hashes, lambda h, i: F.struct(h.alias("h"), i.alias("i")))

        def starts(s: Column) -> Column:
            twice = F.filter(
                s,
                lambda x, i: F.coalesce(F.get(s, i - 1)["h"] == x["h"], F.lit(False))
                | F.coalesce(F.get(s, i + 1)["h"] == x["h"], F.lit(False)),
            )
            return F.array_sort(F.transform(twice, lambda x: x["i"]))

        def total(at: Column) -> Column:
            ahead = F.transform(
                at, lambda p, i: F.least(F.coalesce(F.get(at, i + 1) - p, F.lit(window)), F.lit(window))
            )
            return F.aggregate(ahead, F.lit(0).cast("bigint"), lambda n, k: n + k)

        return _let(_let(F.array_sort(placed), starts), total)

    def all_windows(w: Column) -> Column:
        places = F.sequence(F.lit(0), F.size(w) - window)
        return F.transform(places, lambda i: F.xxhash64(*[F.get(w, i + k) for k in range(window)]))

    def count(h: Column) -> Column:
        return F.when(F.size(F.array_distinct(h)) < F.size(h), covered(h)).otherwise(F.lit(0).cast("bigint"))

    return F.when(F.size(words) > window, _let(all_windows(words), count)).otherwise(F.lit(0).cast("bigint"))


def statistics(docs: DataFrame) -> DataFrame:
    """``docs`` with ``stats``: the counts of the contract and the number of capital letters."""
    text = F.coalesce(F.col("text"), F.lit(""))
    staged = docs.withColumn("__words", F.filter(F.split(text, SPACE), lambda w: w != ""))
    lines = F.filter(F.split(text, "\n"), lambda x: x.rlike(r"[^\x20\x09-\x0D]"))
    one_line = ~F.contains(text, F.lit("\n"))
    dup_lines = F.when(one_line, F.lit(0)).otherwise(
        _let(lines, lambda x: F.size(x) - F.size(F.array_distinct(x)))
    )
    return staged.withColumn(
        "stats",
        F.struct(
            F.size("__words").cast("bigint").alias("n_words"),
            F.length(F.array_join("__words", "")).cast("bigint").alias("word_chars"),
            F.length(F.regexp_replace(text, r"[^#*$%&|<>]+", "")).cast("bigint").alias("n_symbols"),
            dup_lines.cast("bigint").alias("n_dup_lines"),
            repeated_words(F.col("__words")).alias("n_repeat_words"),
            F.length(F.regexp_replace(text, r"[^\p{Lu}]+", "")).cast("bigint").alias("n_capitals"),
            F.when(one_line, F.lit(1)).otherwise(F.size(F.split(text, "\n"))).cast("bigint").alias("n_lines"),
        ),
    ).drop("__words")


def _vector() -> list[Column]:
    """The transformed statistics in thousandths: logarithm of the mean word length, square
    roots of the shares of symbols, repeated lines, repeated words and capital letters."""
    s = F.col("stats")
    words, chars = F.greatest(s["n_words"], F.lit(1)), F.greatest(s["word_chars"], F.lit(1))
    values = {
        "word_length": F.log(chars / words),
        "symbols": F.sqrt(s["n_symbols"] / chars),
        "dup_lines": F.sqrt(s["n_dup_lines"] / s["n_lines"]),
        "repeats": F.sqrt(s["n_repeat_words"] / words),
        "capitals": F.sqrt(s["n_capitals"] / chars),
    }
    return [F.round(v * UNIT).cast("bigint").alias(n) for n, v in values.items()]


NAMES = tuple(FLOORS)
PAIRS = [(i, j) for i in range(len(NAMES)) for j in range(i + 1)]
GROUP = ["lang", "source", "whole"]


def _whitened() -> Column:
    """Squared Mahalanobis distance by forward substitution with the stored Cholesky factor."""
    solved: list[Column] = []
    for i, name in enumerate(NAMES):
        rest = F.col(name) - F.col(f"m{i}")
        for j in range(i):
            rest = rest - F.col(f"l{i}{j}") * solved[j]
        solved.append(rest / F.col(f"l{i}{i}"))
    total = solved[0] * solved[0]
    for z in solved[1:]:
        total = total + z * z
    return total


def _factored(moments: DataFrame) -> DataFrame:
    """Mean and Cholesky factor from counts, sums and products; variances get their floors."""
    n = F.col("n").cast("double")
    mean = [(F.col(f"s{i}").cast("double") / n).alias(f"m{i}") for i in range(len(NAMES))]
    df = moments.select("*", *mean)
    for i, j in PAIRS:
        c = F.col(f"p{i}{j}").cast("double") / n - F.col(f"m{i}") * F.col(f"m{j}")
        if i == j:
            c = F.greatest(c, F.lit(0.0)) + (FLOORS[NAMES[i]] * UNIT) ** 2
        df = df.withColumn(f"c{i}{j}", c)
    for i, j in PAIRS:
        rest = F.col(f"c{i}{j}")
        for k in range(j):
            rest = rest - F.col(f"l{i}{k}") * F.col(f"l{j}{k}")
        df = df.withColumn(f"l{i}{j}", F.sqrt(rest) if i == j else rest / F.col(f"l{j}{j}"))
    means = [f"m{i}" for i in range(len(NAMES))]
    return df.select(*GROUP, *means, *[f"l{i}{j}" for i, j in PAIRS])


def _with(vectors: DataFrame, params: DataFrame, how: str = "inner") -> DataFrame:
    """Each row beside its group's parameters: one row per group, broadcast if Spark finds it
    small enough and else a join whose large partitions Spark may split."""
    theirs = params.select(*[F.col(g).alias(f"__{g}") if g in GROUP else F.col(g) for g in params.columns])
    on = F.lit(True)
    for g in GROUP:
        on = on & F.col(g).eqNullSafe(F.col(f"__{g}"))
    return vectors.join(theirs, on, how).drop(*[f"__{g}" for g in GROUP])


def _start(vectors: DataFrame) -> DataFrame:
    """Medians and, as a diagonal factor, scaled median absolute deviations.

    ``percentile`` keeps one count per distinct value; values are whole thousandths of bounded
    statistics, so its state is bounded.
    """
    medians = settle(
        vectors.groupBy(*GROUP).agg(*[F.expr(f"percentile({n}, 0.5D)").alias(f"m{i}") for i, n in enumerate(NAMES)])
    )
    spread = [
        F.expr(f"percentile(cast(bround(abs({n} - m{i})) as bigint), 0.5D)").alias(f"a{i}") for i, n in enumerate(NAMES)
    ]
    deviations = _with(vectors, medians).groupBy(*GROUP).agg(*spread)
    joined = _with(medians, deviations)
    zero = F.lit(0.0)
    return joined.select(
        *GROUP,
        *[f"m{i}" for i in range(len(NAMES))],
        *[
            (F.sqrt(F.pow(F.col(f"a{i}") * 1.4826, 2) + (FLOORS[NAMES[i]] * UNIT) ** 2) if i == j else zero).alias(f"l{i}{j}")
            for i, j in PAIRS
        ],
    )


def _concentrate(vectors: DataFrame, params: DataFrame, support: float) -> DataFrame:
    """One concentration step.  Distances fall into bins of about 2 %; the closest bins that
    together hold the support give the next estimate."""
    exact = lambda c: F.sum(c.cast("decimal(38,0)"))
    near = _with(vectors, params).withColumn("bin", F.floor(F.log1p(_whitened()) * 50))
    sums = [exact(F.col(n)).alias(f"s{i}") for i, n in enumerate(NAMES)]
    sums += [exact(F.col(NAMES[i]) * F.col(NAMES[j])).alias(f"p{i}{j}") for i, j in PAIRS]
    bins = near.groupBy(*GROUP, "bin").agg(F.count("*").alias("n"), *sums)
    whole = W.partitionBy(*GROUP)
    before = whole.orderBy("bin").rowsBetween(W.unboundedPreceding, -1)
    bins = bins.withColumn("before", F.coalesce(F.sum("n").over(before), F.lit(0)))
    bins = bins.withColumn("all", F.sum("n").over(whole))
    inner = bins.filter(F.col("before") < F.col("all") * support)
    names = ["n", *[f"s{i}" for i in range(len(NAMES))], *[f"p{i}{j}" for i, j in PAIRS]]
    return _factored(inner.groupBy(*GROUP).agg(*[F.sum(n).alias(n) for n in names]))


def estimates(vectors: DataFrame, support: float = SUPPORT, steps: int = STEPS) -> DataFrame:
    """Centre and factored scatter per (lang, source), and one over all rows (``whole``)."""
    both = vectors.withColumn("whole", F.explode(F.array(F.lit(False), F.lit(True))))
    for g in ("lang", "source"):
        both = both.withColumn(g, F.when(~F.col("whole"), F.col(g)))
    params = settle(_start(both))
    for _ in range(steps):
        params = settle(_concentrate(both, params, support))
    return params


def judge(
    docs: DataFrame, cut: float | None = None, least_rows: int = LEAST_ROWS, keys: Sequence[Column] = (), **options
) -> DataFrame:
    """One row per document: ``doc_id``, ``stats``, ``distance``, ``base_failed`` and ``kept``.

    ``keys``, expressions over ``docs``, follow under their names.

    Base rules: fewer than 10 words, or more than 20 % of the words in repeated windows, fail.
    Null texts have no words.  Null languages and sources form groups.  Documents that fail the
    base rules are left out of the estimates but still get a distance.  ``cut`` is ``cut_at`` of
    the support unless given.  An empty table gives no rows; without a single document that passes the base rules all fail.
    """
    cut = cut_at(support=options.get("support", SUPPORT)) if cut is None else cut
    narrow = docs.select("doc_id", F.col("lang").cast("string").alias("lang"), F.col("source").cast("string").alias("source"), "text", *keys)
    names = narrow.columns[4:]
    stated = settle(statistics(narrow).drop("text"))
    s = F.col("stats")
    failed = (s["n_words"] < 10) | (100 * s["n_repeat_words"] > 20 * s["n_words"])
    rows = stated.select("doc_id", *names, "lang", "source", "stats", failed.alias("base_failed"), *_vector())
    vectors = settle(rows.filter(~F.col("base_failed")).select("lang", "source", *NAMES))
    params = estimates(vectors, **options)
    small = (
        rows.filter(~F.col("base_failed"))
        .groupBy("lang", "source")
        .agg((F.count("*") < least_rows).alias("__small"))
        .select(F.col("lang").alias("__lang"), F.col("source").alias("__source"), "__small")
    )
    on = F.col("lang").eqNullSafe(F.col("__lang")) & F.col("source").eqNullSafe(F.col("__source"))
    placed = rows.join(settle(small), on, "left").drop("__lang", "__source")
    placed = placed.withColumn("whole", F.coalesce(F.col("__small"), F.lit(True)))
    for g in ("lang", "source"):
        placed = placed.withColumn(g, F.when(~F.col("whole"), F.col(g)))
    scored = _with(placed, params, "left").withColumn("distance", _whitened())
    good = ~F.col("base_failed") & (F.coalesce(F.col("distance"), F.lit(0.0)) <= cut)
    return scored.select("doc_id", "stats", "distance", "base_failed", good.alias("kept"), *names)


def clean(docs: DataFrame, **options) -> DataFrame:
    """The documents that ``judge`` keeps, columns unchanged.

    A verdict depends on text, language and source, so each row has its own, whatever its id:
    those to leave out come back by a digest of the three.
    """
    held = [F.coalesce(F.col(c).cast("string"), F.lit("\0")) for c in ("lang", "source", "text")]
    digest = F.md5(F.concat_ws("\1", *held).cast("binary"))
    judged = judge(docs, keys=[digest.alias("__digest")], **options)
    gone = sized(settle(judged.filter("not kept").select(F.col("__digest").alias("__gone")).distinct()))
    return docs.join(gone, digest == F.col("__gone"), "left_anti")


def op8_robust_rules(spark, folder):
    judged = judge(table(spark, folder, "documents"))
    names = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words"]
    return judged.select("doc_id", *[F.col(f"stats.{n}").alias(n) for n in names], "base_failed", "kept", "distance")
