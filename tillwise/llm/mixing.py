"""Mixing sources to target weights: a curriculum whose weights change over training.

Every source has a share of the training words (its target) and a schedule, a density over
training time that grows or falls in a straight line.  The integral of the density is the
source's cumulative demand; inverting it turns the running word count of a document within its
source into a position in training, and documents are range-sorted by that position.

Only DataFrame operations: word counts stay in the JVM, running counts come from range
partitions and their totals, so a source with a third of all rows is spread over all tasks.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tillwise.llm.common import WORD, running_total
from tillwise.sources.shared import settle

KEY = ("doc_id", "source", "size")


def word_count(text: Column) -> Column:
    return F.regexp_count(F.coalesce(text, F.lit("")), F.lit(WORD)).cast("bigint")


def targets(
    sizes: DataFrame,
    weights: Sequence[float] = (3.0, 1.0, 2.0),
    share: float = 1.5,
    most: float = 2.0,
    slopes: Sequence[float] = (-0.5, 0.0, 0.5),
) -> DataFrame:
    """One row per source: ``source``, ``source_size``, ``target`` and the slope of its schedule.

    Sources in code point order, null last, take ``weights`` in turn and share ``share`` times
    all words by weight.  A target stops at ``most`` times its source; what is above is shared
    again by weight among the rest.  That ends at the one level L with
    sum(min(most * size, L * weight)) equal to the total, found from the sources sorted by the
    level at which they fill up.  Without words all targets are 0.
    """
    sources = settle(
        sizes.groupBy("source").agg(F.sum(F.col("size") * F.col("rows")).alias("source_size"))
    )
    by_name = [F.col("source").asc_nulls_last()]
    numbered = running_total(sources.withColumn("one", F.lit(1)), by_name, "one", "number")
    turn = F.col("number") % len(weights)
    numbered = settle(
        numbered.select(
            "source",
            "source_size",
            F.get(F.array(*[F.lit(float(w)) for w in weights]), turn.cast("int")).alias("weight"),
            F.get(F.array(*[F.lit(float(s)) for s in slopes]), (F.col("number") % len(slopes)).cast("int")).alias("slope"),
        )
        .withColumn("top", F.col("source_size") * F.lit(float(most)))
        .withColumn("fills_at", F.col("top") / F.col("weight"))
    )
    total, weight = numbered.agg(F.sum("source_size"), F.sum("weight")).first()
    total, weight = float(total or 0) * share, float(weight or 0)
    by_level = [F.col("fills_at"), *by_name]
    filled = running_total(numbered, by_level, "top", "top_before")
    filled = running_total(settle(filled), by_level, "weight", "weight_before")
    filled = filled.withColumn("top_till", F.col("top_before") + F.col("top")).withColumn(
        "weight_till", F.col("weight_before") + F.col("weight")
    )
    reached = F.col("top_till") + F.col("fills_at") * (F.lit(weight) - F.col("weight_till"))
    last = (
        filled.filter(reached <= total)
        .agg(F.max(F.struct("weight_till", "top_till")).alias("last"))
        .first()["last"]
    )
    full, used = (last["top_till"], last["weight_till"]) if last else (0.0, 0.0)
    level = (total - full) / (weight - used) if weight > used else float("inf")
    return numbered.select(
        "source",
        "source_size",
        F.least(F.col("top"), F.lit(level) * F.col("weight")).alias("target"),
        "slope",
    )


def _when(slope: Column, demand: Column) -> Column:
    """The time at which a source has met the fraction ``demand`` of its target.

    The density (1 - slope) + 2 * slope * t integrates to (1 - slope) t + slope t^2.
    """
    straight = 1 - slope
    root = (F.sqrt(straight * straight + 4 * slope * demand) - straight) / (2 * slope)
    return F.when(slope == 0, demand).otherwise(root)


def plan_mix(docs: DataFrame, most: float = 2.0, **options) -> DataFrame:
    """What the mix takes: one row per distinct ``doc_id``, ``source`` and size in words.

    Columns: the key, ``rows`` (how many rows share it; they share its fate), ``source_size``,
    ``target``, ``taken`` (words per row, repeats counted) and ``positions``, one training time
    in [0, 1] per copy.  A source is walked in the order of md5(doc_id), again from the start
    when its target is above its size; a copy is taken if its middle word lies below the target,
    so a source misses its target by half a document at most, and nothing is taken more than
    ``most`` times (rounded up).  Null texts have size 0, null sources form a source, an empty
    table gives an empty plan.  Further columns of ``docs`` are not read.
    """
    sizes = settle(
        docs.select("doc_id", "source", word_count(F.col("text")).alias("size"))
        .groupBy(*KEY)
        .agg(F.count("*").alias("rows"))
    )
    goals = targets(sizes, most=most, **options)
    goals = settle(goals.withColumnRenamed("source", "__goal"))
    mixed = sizes.withColumn("turn", F.md5(F.coalesce(F.col("doc_id").cast("string"), F.lit("")).cast("binary")))
    mixed = mixed.withColumn("words", F.col("size") * F.col("rows"))
    order = [F.col("turn"), F.col("doc_id"), F.col("size")]
    mixed = running_total(mixed, order, "words", "start", ["source"])
    mixed = mixed.join(goals, F.col("source").eqNullSafe(F.col("__goal")), "left").drop("__goal")
    rounds = F.sequence(F.lit(0), F.lit(max(0, int(-(-most // 1)) - 1)))
    begins = F.transform(rounds, lambda k: k.cast("bigint") * F.col("source_size") + F.col("start"))
    taken = F.filter(begins, lambda at: at + F.col("words") / 2 <= F.col("target"))
    mixed = mixed.withColumn("begins", taken)
    demand = lambda at: F.least(
        F.lit(1.0), F.coalesce(F.try_divide(at.cast("double"), F.col("target")), F.lit(0.0))
    )
    return mixed.select(
        *KEY,
        "rows",
        "source_size",
        "target",
        (F.size("begins") * F.col("size")).alias("taken"),
        F.transform("begins", lambda at: _when(F.col("slope"), demand(at))).alias("positions"),
    )


def mix(docs: DataFrame, **options) -> DataFrame:
    """The mixed documents in training order: each row once per copy taken, columns unchanged."""
    names = docs.columns
    plan = plan_mix(docs, **options).select(
        *[F.col(k).alias(f"__{k}") for k in KEY], F.col("positions").alias("__positions")
    )
    sized = docs.withColumn("__words", word_count(F.col("text")))
    on = (
        F.col("doc_id").eqNullSafe(F.col("__doc_id"))
        & F.col("source").eqNullSafe(F.col("__source"))
        & (F.col("__words") == F.col("__size"))
    )
    copies = sized.join(plan, on).withColumn("__at", F.explode("__positions"))
    ordered = copies.repartitionByRange("__at", "doc_id").sortWithinPartitions("__at", "doc_id")
    return ordered.select(*names)


def op2_curriculum_mix(spark, folder):
    """All documents with what the mix takes of each, in training order of the first copy."""
    from tillwise.llm.common import table

    plan = plan_mix(table(spark, folder, "documents"))
    each = plan.withColumn("copy", F.explode(F.sequence(F.lit(1), F.col("rows").cast("int"))))
    result = each.select(
        "doc_id", "size", "source_size", "target", "taken", F.get("positions", F.lit(0)).alias("position")
    )
    return result.repartitionByRange(F.col("position").asc_nulls_last(), F.col("doc_id")).sortWithinPartitions(
        F.col("position").asc_nulls_last(), F.col("doc_id")
    )


OP2_SQL = r"""
WITH d AS (
  SELECT doc_id, source,
         length(regexp_replace(regexp_replace(coalesce(text, ''), '[^\x20\x09-\x0D]+', 'w', 'g'), '[\x20\x09-\x0D]+', '', 'g')) AS size
  FROM documents),
s AS (SELECT source, sum(size) AS source_size FROM d GROUP BY source),
w AS (
  SELECT source, source_size, 2.0 * source_size AS top,
         CASE (row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3
              WHEN 0 THEN 3.0 WHEN 1 THEN 1.0 ELSE 2.0 END AS weight,
         CASE (row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3
              WHEN 0 THEN -0.5 WHEN 1 THEN 0.0 ELSE 0.5 END AS slope
  FROM s),
c AS (
  SELECT *, sum(top) OVER (ORDER BY top / weight, source NULLS LAST ROWS UNBOUNDED PRECEDING) AS top_till,
         sum(weight) OVER (ORDER BY top / weight, source NULLS LAST ROWS UNBOUNDED PRECEDING) AS weight_till,
         sum(weight) OVER () AS all_weight, 1.5 * sum(source_size) OVER () AS total
  FROM w),
l AS (
  SELECT max(total) AS total, max(all_weight) AS all_weight,
         coalesce(max(CASE WHEN top_till + top / weight * (all_weight - weight_till) <= total THEN weight_till END), 0) AS used,
         coalesce(max(CASE WHEN top_till + top / weight * (all_weight - weight_till) <= total THEN top_till END), 0) AS filled
  FROM c),
t AS (
  SELECT source, source_size, slope,
         CASE WHEN all_weight > used THEN least(top, (total - filled) / (all_weight - used) * weight) ELSE top END AS target
  FROM c, (SELECT total AS t_total, all_weight AS t_all, used, filled FROM l)),
r AS (
  SELECT d.doc_id, d.size, t.source_size, t.target, t.slope,
         sum(d.size) OVER (PARTITION BY d.source ORDER BY md5(coalesce(CAST(d.doc_id AS VARCHAR), '')), d.doc_id, d.size
                           ROWS UNBOUNDED PRECEDING) - d.size AS start
  FROM d JOIN t ON d.source IS NOT DISTINCT FROM t.source),
x AS (
  SELECT *, CASE WHEN start + size / 2.0 <= target THEN 1 ELSE 0 END AS once,
         CASE WHEN source_size + start + size / 2.0 <= target THEN 1 ELSE 0 END AS twice,
         CASE WHEN target > 0 THEN least(1.0, CAST(start AS DOUBLE) / target) ELSE 0.0 END AS demand
  FROM r)
SELECT doc_id, size, CAST(source_size AS BIGINT) AS source_size, CAST(target AS DOUBLE) AS target,
       CAST(size * (once + twice) AS BIGINT) AS taken,
       CASE WHEN once = 0 THEN NULL WHEN slope = 0 THEN CAST(demand AS DOUBLE)
            ELSE (sqrt((1.0 - slope) * (1.0 - slope) + 4 * slope * demand) - (1.0 - slope)) / (2 * slope) END AS position
FROM x
"""
