"""Monthly sales that are brought up to date a month at a time.

The three fact tables are reduced to states by day or month that may be summed further, kept in
sinks partitioned by month: orders and payments by day, POS totals by month.  A refresh reads the facts
of the months named and nothing else, and replaces those partitions.  Activity windows, ids and
the flags of locations, which depend on all months, are taken from the sinks at every report,
so a late row in one month changes the others as it should.
"""

from __future__ import annotations

from collections.abc import Iterable
from dataclasses import dataclass, replace
from datetime import date, timedelta

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tillwise.functions.columns import on_days, period
from tillwise.operators import activity, channels
from tillwise.plans.reports import Inputs, id_bridge, spans_a, spans_b
from tillwise.sources.tables import replace_partitions


def month_bounds(month: str) -> tuple[date, date]:
    """First and last day of a month given as ``yyyy-MM``."""
    first = date.fromisoformat(f"{month}-01")
    return first, (first + timedelta(days=31)).replace(day=1) - timedelta(days=1)


@dataclass(frozen=True)
class Sinks:
    """Folders of the states by month."""

    spark: SparkSession
    folder: str

    def path(self, name: str) -> str:
        return f"{self.folder}/{name}"

    def read(self, name: str, first: str | None = None, last: str | None = None) -> DataFrame:
        """States of the months from ``first`` to ``last``; other folders are not opened."""
        df = self.spark.read.parquet(self.path(name))
        if first is not None:
            df = df.filter(F.col("of").between(first, last))
        return df.drop("of")


def _months_of(df: DataFrame, ts: str, months: list[str]) -> DataFrame:
    bounds = [month_bounds(m) for m in months]
    inside = F.lit(False)
    for first, last in bounds:
        inside = inside | on_days(ts, first, last)
    # The outer bounds reach the scan, whatever lies between the months.
    outer = on_days(ts, min(b[0] for b in bounds), max(b[1] for b in bounds))
    return df.filter(outer & inside)


def refresh(t: Inputs, sinks: Sinks, months: Iterable[str]) -> None:
    """Replace the states of these months (``yyyy-MM``) by those of the facts in ``t``.

    A month without rows any more is removed.  Facts without a date belong to no month.
    """
    months = sorted(set(months))
    if not months:
        return
    first, last = month_bounds(months[0])[0], month_bounds(months[-1])[1]
    orders = activity.order_days(_months_of(t.orders, "created_at", months))
    paid = _months_of(t.pos_a_payments, "payment_details.created_at", months)
    payments = channels.payment_days(paid, t.flag, first, last)
    due = _months_of(t.pos_b_orders, "payment_details.estimatedfulfillmentdate", months)
    totals = channels.pos_totals_by_location_period(due, first, last)
    for name, df, month in (
        ("orders", orders, period("ordered_on")),
        ("payments", payments, period("paid_on")),
        ("pos_totals", totals, F.col("period")),
    ):
        replace_partitions(df.withColumn("of", month), sinks.path(name), "of", months)


def monthly_sales(t: Inputs, sinks: Sinks) -> DataFrame:
    """``reports.monthly_sales`` from the sinks; of ``t`` only the dimension tables are read."""
    window = (t.start.strftime("%Y-%m"), t.end.strftime("%Y-%m"))
    t = replace(t, days=sinks.read("orders"))
    payments = sinks.read("payments", *window).filter(
        F.col("paid_on").between(F.lit(t.start), F.lit(t.end))
    )
    a = channels.channel_sales_of_days(payments, t.pos_a_locations, id_bridge(t), spans_a(t))
    live = activity.live_locations(t.locations)
    direct = channels.direct_orders_of_days(t.days, live, spans_b(t), t.start, t.end)
    pos = sinks.read("pos_totals", *window)
    return channels.union_channel_sales(a, channels.channel_totals_by_period(pos, direct))
