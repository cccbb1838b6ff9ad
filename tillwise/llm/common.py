"""Helpers shared by the text operators: tables, running totals, null-safe joins."""

from __future__ import annotations

import ctypes
import functools
import sys
from collections.abc import Callable, Iterator, Sequence

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tillwise.sources.shared import settle

#: A word where the contract says so: a run of anything but these six ASCII characters.
WORD = r"[^\x20\x09-\x0D]+"
SPACE = r"[\x20\x09-\x0D]+"


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


def same(left: DataFrame, right: DataFrame, names: Sequence[str]) -> Column:
    """Null-safe equality of the named columns."""
    on = F.lit(True)
    for name in names:
        on = on & left[name].eqNullSafe(right[name])
    return on


def giving_back(run: Callable) -> Callable:
    """The function of a ``mapInArrow`` that at its end returns freed memory to the system.

    A Python worker outlives its task and would keep that memory beside the next stage's.
    """

    @functools.wraps(run)
    def wrapped(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        yield from run(batches)
        pa.default_memory_pool().release_unused()
        trim = getattr(ctypes.CDLL(None), "malloc_trim", None) if sys.platform == "linux" else None
        if trim:
            trim(0)

    return wrapped


def running_total(
    df: DataFrame, order: Sequence[Column], amount: str, out: str, group: Sequence[str] = ()
) -> DataFrame:
    """Add ``out``, the sum of ``amount`` over the rows before this one (exclusive).

    The order is ``group`` first, then ``order``; sums start again with each group.  No group is
    brought together in one task: rows are range-partitioned, summed within a partition, and
    shifted by the totals of the partitions before, of which there is one row per partition and
    group.  Rows that tie in ``order`` may be numbered in any order.  Columns starting with
    ``__`` are reserved.  ``df`` should be narrow and stored: it is read for the range bounds too.
    """
    groups = [F.col(g).asc_nulls_last() for g in group]
    placed = settle(
        df.repartitionByRange(*groups, *order).withColumn("__part", F.spark_partition_id())
    )
    keys = ["__part", *group]
    totals = placed.groupBy(*keys).agg(F.sum(amount).alias("__sum"))
    earlier = W.orderBy("__part").rowsBetween(W.unboundedPreceding, -1)
    if group:
        earlier = W.partitionBy(*group).orderBy("__part").rowsBetween(W.unboundedPreceding, -1)
    totals = totals.withColumn("__before", F.coalesce(F.sum("__sum").over(earlier), F.lit(0)))
    totals = totals.select(*[F.col(k).alias(f"__of_{k}") for k in keys], "__before")
    within = W.partitionBy(*keys).orderBy(*order).rowsBetween(W.unboundedPreceding, -1)
    run = placed.withColumn("__run", F.coalesce(F.sum(amount).over(within), F.lit(0)))
    on = F.lit(True)
    for k in keys:
        on = on & F.col(k).eqNullSafe(F.col(f"__of_{k}"))
    joined = run.join(totals, on, "left").withColumn(out, F.col("__run") + F.col("__before"))
    return joined.select(*df.columns, out)
