"""Row numbers and NTILE over a whole frame without sending it through one task.

A window with no PARTITION BY moves every row to one task.  Here the frame is range-partitioned
by the sort keys, stored with the number of each row's partition, numbered within partitions in
parallel, and shifted by the number of rows in the partitions before, of which there is one row
per partition.  A value shared by many rows is split by the later keys; the last key must be
unique, which also makes the numbering repeatable.  Small frames become one partition by Spark's
own adaptive execution; there is no other path.

NTILE buckets need no numbers: the rows at the borders of the buckets are enough, and every other
row is compared with them.  ``ntiles`` finds the borders of all orders in one sort.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql.types import DataType

from tillwise.sources.shared import settle

SortKeys = Sequence[tuple[str, str]]


def _sorting(keys: SortKeys) -> list[Column]:
    return [F.col(c).desc() if way == "desc" else F.col(c).asc() for c, way in keys]


def number_rows(df: DataFrame, orders: Mapping[str, SortKeys]) -> tuple[DataFrame, int]:
    """Add one 1-based row number per entry of ``orders``; also return the row count.

    NULLs come first in ascending and last in descending order.  ``df`` is read twice for the
    first order, so pass a stored table (see ``sources.shared.reusable``).
    """
    for name, keys in orders.items():
        part, ahead = f"__part_{name}", f"__ahead_{name}"
        placed = settle(
            df.repartitionByRange(*_sorting(keys)).withColumn(part, F.spark_partition_id())
        )
        before = F.sum("rows").over(W.orderBy("of").rowsBetween(W.unboundedPreceding, -1))
        counts = placed.groupBy(F.col(part).alias("of")).agg(F.count("*").alias("rows"))
        counts = counts.select("of", F.coalesce(before, F.lit(0)).alias(ahead))
        within = F.row_number().over(W.partitionBy(part).orderBy(*_sorting(keys)))
        df = (
            placed.withColumn(name, within)
            .join(counts, F.col(part) == F.col("of"))
            .withColumn(name, F.col(name) + F.col(ahead))
            .drop(part, ahead, "of")
        )
    return df, df.count()


def _border_ranks(total: int, buckets: int) -> list[int]:
    """The rank of the last row of each bucket but the last, where rows follow."""
    size, extra = divmod(total, buckets)
    ends = [k * size + min(k, extra) for k in range(1, buckets)]
    return [e for e in ends if e < total]


def _beyond(keys: SortKeys, row: Sequence, kinds: Mapping[str, DataType]) -> Column:
    """Does a row come after ``row`` in the order of ``keys``?"""
    after = F.lit(False)
    for (name, way), value in reversed(list(zip(keys, row))):
        col, at = F.col(name), F.lit(value).cast(kinds[name])
        if way == "desc":
            later = F.lit(False) if value is None else col.isNull() | (col < at)
        else:
            later = col.isNotNull() if value is None else col > at
        after = F.coalesce(later, F.lit(False)) | (col.eqNullSafe(at) & after)
    return after


def ntiles(df: DataFrame, orders: Mapping[str, SortKeys], buckets: int) -> DataFrame:
    """Add one NTILE bucket per entry of ``orders``, by one sort for all of them.

    The keys of each order are laid side by side with the order's number in front; they are
    range-partitioned and stored once.  Counts per partition, one row each, tell where the last
    row of each bucket lies; these rows come to the driver, ``buckets - 1`` per order, and rows
    of ``df`` are compared with them.  So nothing is joined back, and ``df`` stays as wide as it
    is.  NULLs come as in ``number_rows``.  ``df`` is read twice: pass a stored table.
    """
    kinds = {f.name: f.dataType for f in df.schema.fields}
    names = {o: [f"k{i}_{j}" for j in range(len(keys))] for i, (o, keys) in enumerate(orders.items())}
    entries, sorting = [], [F.col("of")]
    for i, (mine, keys) in enumerate(orders.items()):
        sorting += _sorting([(n, way) for n, (_, way) in zip(names[mine], keys)])
        columns = [F.lit(i).alias("of")]
        for other, theirs in orders.items():
            for name, (col, _) in zip(names[other], theirs):
                value = F.col(col) if other == mine else F.lit(None).cast(kinds[col])
                columns.append(value.alias(name))
        entries.append(F.struct(*columns))
    laid = df.select(F.explode(F.array(*entries)).alias("x")).select("x.*")
    placed = settle(laid.repartitionByRange(*sorting).withColumn("part", F.spark_partition_id()))
    counts = sorted(tuple(r) for r in placed.groupBy("of", "part").count().collect())
    wanted: list[tuple[int, int, int]] = []
    for i in range(len(orders)):
        mine = [(part, n) for of, part, n in counts if of == i]
        for rank in _border_ranks(sum(n for _, n in mine), buckets):
            for part, n in mine:
                if rank <= n:
                    wanted.append((i, part, rank))
                    break
                rank -= n
    if not wanted:
        return df.withColumns({o: F.lit(1) for o in orders})
    here = F.struct("of", "part").isin([F.struct(F.lit(i), F.lit(p)) for i, p, _ in wanted])
    at = F.struct("of", "part", "place").isin(
        [F.struct(F.lit(i), F.lit(p), F.lit(rank)) for i, p, rank in wanted]
    )
    place = F.row_number().over(W.partitionBy("of", "part").orderBy(*sorting[1:]))
    borders = placed.filter(here).withColumn("place", place).filter(at).collect()
    found = {}
    for i, (order, keys) in enumerate(orders.items()):
        rows = [[r[n] for n in names[order]] for r in borders if r["of"] == i]
        passed = [_beyond(keys, row, kinds).cast("int") for row in rows]
        found[order] = sum(passed, F.lit(1))
    return df.withColumns(found)


def ntile_of(position: Column, total: int, buckets: int) -> Column:
    """The NTILE bucket of a 1-based row number: the first ``total % buckets`` get one row more."""
    size, extra = divmod(total, buckets)
    in_long = extra * (size + 1)
    long_part = F.ceil(position / F.lit(size + 1))
    if size == 0:
        return long_part.cast("int")
    short_part = F.lit(extra) + F.ceil((position - F.lit(in_long)) / F.lit(size))
    return F.when(position <= in_long, long_part).otherwise(short_part).cast("int")
