"""The share of point-of-sale revenue that arrives through one flagged ordering channel.

POS system A keeps payments with a free-text note, which tells the channel.  POS system B keeps
totals only; the platform's own orders stand for the channel.
"""

from __future__ import annotations

from datetime import date

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tillwise.functions.columns import day, exact_sum, first_id, month, on_days, period, ratio
from tillwise.operators.activity import activity_gate, activity_windows
from tillwise.sources.shared import settle, sized


def _settled_payments(payments: DataFrame, start: date, end: date, status: str) -> DataFrame:
    return payments.filter(
        (F.col("payment_details.status") == status)
        & on_days("payment_details.created_at", start, end)
    )


def flagged_count_by_location(
    payments: DataFrame,
    locations: DataFrame,
    flag: Column,
    start: date,
    end: date,
    status: str = "COMPLETED",
) -> DataFrame:
    """Flagged completed payments per location; locations with none of those count 0."""
    counts = (
        _settled_payments(payments, start, end, status)
        .groupBy(F.col("payment_details.location_id").alias("id"))
        .agg(F.count(F.when(flag, F.col("payment_details.id"))).alias("n"))
    )
    return (
        counts.join(locations.select("id", "merchant_id", "business_name"), "id")
        .groupBy("id", "merchant_id", "business_name")
        .agg(F.sum("n").alias("platform_order_count"))
        .select(
            F.col("id").alias("pos_location_id"),
            F.col("merchant_id").alias("pos_merchant_id"),
            F.col("business_name").alias("pos_merchant_name"),
            "platform_order_count",
        )
    )


def channel_sales_by_period(
    payments: DataFrame,
    locations: DataFrame,
    bridge: DataFrame,
    location_flags: DataFrame,
    spans: DataFrame,
    flag: Column,
    start: date,
    end: date,
    status: str = "COMPLETED",
) -> DataFrame:
    """Sales of POS system A per merchant and month, split into flagged and other payments.

    Only locations with a flagged payment count, and only days on which the merchant was active.
    A merchant with several resolved ids has each payment counted once per id, in sums and
    counts though not in distinct customers or the share.

    Locations, ids, flags and activity windows are small; they are joined with each other first
    and meet the payments in one join.  Payments are then summed per customer before they are
    summed per merchant: that gives both distinct counts without copying rows, and spreads a
    merchant with very many payments over all tasks.
    """
    places = sized(
        _open_places(locations, bridge, spans).join(
            location_flags.filter(F.col("platform_order_count") > 0).select(
                F.col("pos_location_id").alias("location_id")
            ),
            "location_id",
        )
    )
    facts = _facts(payments, flag, start, end, status)
    # The windows of a merchant do not overlap, so no payment is matched by two of them.
    gated = facts.join(places, "location_id").filter(
        F.col("paid_on").between(F.col("opens"), F.col("closes"))
    )
    per_customer = gated.groupBy(
        "merchant_id", "merchant_name", month("paid_on").alias("month"), "customer_id"
    ).agg(*_states())
    return _per_merchant(per_customer)


def channel_sales_in_one_read(
    payments: DataFrame,
    locations: DataFrame,
    bridge: DataFrame,
    spans: DataFrame,
    flag: Column,
    start: date,
    end: date,
    status: str = "COMPLETED",
) -> DataFrame:
    """``channel_sales_by_period`` with the locations' flags taken in the same read.

    Whether a location has a flagged payment is known only when all are read, and a flagged
    payment counts for that on any day.  So payments are summed per location, customer and month
    first, those outside the merchant's windows to one row per location that keeps only the flag.
    This table is stored; flags come from it, and then the sums of the flagged locations.
    """
    places = sized(_open_places(locations, bridge, spans))
    open_ = F.col("merchant_id").isNotNull()
    facts = _facts(payments, flag, start, end, status).alias("f")
    on = (F.col("f.location_id") == F.col("p.place")) & F.col("f.paid_on").between(
        F.col("p.opens"), F.col("p.closes")
    )
    matched = facts.join(places.withColumnRenamed("location_id", "place").alias("p"), on, "left")
    states = settle(
        matched.filter(open_ | F.col("flagged"))
        .groupBy(
            "location_id",
            "merchant_id",
            "merchant_name",
            F.when(open_, month("paid_on")).alias("month"),
            F.when(open_, F.col("customer_id")).alias("customer_id"),
        )
        .agg(F.bool_or("flagged").alias("any_flagged"), *_states())
    )
    flagged = sized(states.filter("any_flagged").select("location_id").distinct())
    return _per_merchant(_summed(states.filter(open_).join(flagged, "location_id", "left_semi")))


def payment_days(
    payments: DataFrame, flag: Column, start: date, end: date, status: str = "COMPLETED"
) -> DataFrame:
    """Payments by location, day and customer, as states that may be summed further."""
    return (
        _facts(payments, flag, start, end, status)
        .groupBy("location_id", "paid_on", "customer_id")
        .agg(F.bool_or("flagged").alias("any_flagged"), *_states())
    )


def channel_sales_of_days(
    days: DataFrame, locations: DataFrame, bridge: DataFrame, spans: DataFrame
) -> DataFrame:
    """``channel_sales_by_period`` from the stored ``payment_days``, without the payments."""
    flagged = days.filter("any_flagged").select("location_id").distinct()
    places = sized(
        _open_places(locations, bridge, spans).join(flagged, "location_id", "left_semi")
    )
    gated = days.join(places, "location_id").filter(
        F.col("paid_on").between(F.col("opens"), F.col("closes"))
    )
    return _per_merchant(_summed(gated.withColumn("month", month("paid_on"))))


def _summed(states: DataFrame) -> DataFrame:
    """States of payments summed per merchant, month and customer."""
    names = ["total", *[f"{s}_{x}" for s in _SIDES for x in ("total", "rows", "paid")]]
    return states.groupBy("merchant_id", "merchant_name", "month", "customer_id").agg(
        *[F.sum(n).alias(n) for n in names]
    )


def _open_places(locations: DataFrame, bridge: DataFrame, spans: DataFrame) -> DataFrame:
    """Locations with merchant, name and activity windows."""
    windows = activity_windows(spans, "pos_merchant_id").withColumnRenamed("entity", "merchant_id")
    return (
        locations.select(F.col("id").alias("location_id"), "merchant_id")
        .join(bridge.select("merchant_id", "merchant_name"), "merchant_id")
        .join(windows, "merchant_id")
    )


def _facts(
    payments: DataFrame, flag: Column, start: date, end: date, status: str
) -> DataFrame:
    return _settled_payments(payments, start, end, status).select(
        F.col("payment_details.location_id").alias("location_id"),
        day("payment_details.created_at").alias("paid_on"),
        F.col("payment_details.customer_id").alias("customer_id"),
        F.col("payment_details.total_money.amount").alias("amount"),
        flag.alias("flagged"),
    )


_SIDES = ("platform", "other")


def _states() -> list[Column]:
    """Sums and counts of payments, in all and on both sides of the flag."""
    sides = dict(zip(_SIDES, (F.col("flagged"), ~F.col("flagged"))))
    value = F.coalesce("amount", F.lit(0))
    return [
        F.sum("amount").alias("total"),
        *[F.sum(F.when(on, value).otherwise(0)).alias(f"{s}_total") for s, on in sides.items()],
        *[F.count(F.when(on, F.lit(1))).alias(f"{s}_rows") for s, on in sides.items()],
        *[F.count(F.when(on, F.col("amount"))).alias(f"{s}_paid") for s, on in sides.items()],
    ]


def _per_merchant(per_customer: DataFrame) -> DataFrame:
    """Sales per merchant and month from the states per customer."""
    sides = _SIDES
    known = F.col("customer_id").isNotNull()
    per_merchant = per_customer.groupBy("merchant_id", "merchant_name", "month").agg(
        F.sum("total").alias("total_order"),
        *[F.sum(f"{s}_total").alias(f"{s}_total") for s in sides],
        *[F.sum(f"{s}_rows").alias(f"{s}_rows") for s in sides],
        *[F.sum(f"{s}_paid").alias(f"{s}_order_count") for s in sides],
        *[
            F.sum(F.when(known, F.col(f"{s}_rows")).otherwise(0)).alias(f"{s}_customer_count")
            for s in sides
        ],
        *[
            F.count(F.when(known & (F.col(f"{s}_rows") > 0), F.lit(1))).alias(
                f"{s}_unique_customers"
            )
            for s in sides
        ],
    )
    return per_merchant.select(
        "merchant_id",
        F.col("merchant_name").alias("business_name"),
        period("month").alias("period"),
        "total_order",
        *[f"{s}_total" for s in sides],
        *[ratio(F.col(f"{s}_total"), F.col(f"{s}_rows")).alias(f"{s}_avg_total") for s in sides],
        *[f"{s}_order_count" for s in sides],
        *[f"{s}_customer_count" for s in sides],
        *[f"{s}_unique_customers" for s in sides],
        ratio(F.col("platform_total"), F.col("total_order")).alias("share_per_merchant"),
    )


def pos_totals_by_location_period(
    pos_orders: DataFrame, start: date, end: date, strict: bool = True
) -> DataFrame:
    """Sales of POS system B per location, merchant and month of fulfilment, of any status."""
    due = "payment_details.estimatedfulfillmentdate"
    return (
        pos_orders.filter(on_days(due, start, end))
        .groupBy(
            first_id("ext_location_id", "ext_location_id__it", strict).alias("location_id"),
            "merchant_name",
            month(due).alias("month"),
        )
        .agg(exact_sum("payment_details.checks_total_order_sum").cast("double").alias("total_orders_sum"))
        .select(
            "total_orders_sum", "location_id", "merchant_name", period("month").alias("period")
        )
    )


def direct_orders_by_location_period(
    orders: DataFrame,
    live_locations: DataFrame,
    spans: DataFrame,
    start: date,
    end: date,
    status: str = "COMPLETED",
) -> DataFrame:
    """Completed platform orders per live location and month of creation, on active days.

    The windows are broadcast to the scan where their size allows it.  Orders are summed per
    location and month before they meet the locations.
    """
    facts = orders.filter(
        (F.col("orderStatus") == status) & on_days("created_at", start, end)
    ).select(
        "company_ord_fk",
        F.col("location_fk").alias("location_id"),
        day("created_at").alias("ordered_on"),
        F.col("calculated_total").cast("decimal(28,8)").alias("worth"),
    )
    return _direct(facts, live_locations, spans)


def direct_orders_of_days(
    days: DataFrame,
    live_locations: DataFrame,
    spans: DataFrame,
    start: date,
    end: date,
    status: str = "COMPLETED",
) -> DataFrame:
    """The same from the stored ``activity.order_days``, without the orders."""
    facts = days.filter(
        (F.col("orderStatus") == status) & F.col("ordered_on").between(F.lit(start), F.lit(end))
    ).select("company_ord_fk", F.col("location_fk").alias("location_id"), "ordered_on", "worth")
    return _direct(facts, live_locations, spans)


def _direct(facts: DataFrame, live_locations: DataFrame, spans: DataFrame) -> DataFrame:
    return (
        activity_gate(facts, sized(spans), "company_ord_fk", "ordered_on", "company_id")
        .groupBy("location_id", month("ordered_on").alias("month"))
        .agg(F.sum("worth").alias("monthly_sum"))
        .join(
            live_locations.select(
                F.col("id").alias("location_id"), F.col("name").alias("location_name")
            ),
            "location_id",
        )
        .groupBy("location_id", "location_name", "month")
        .agg(F.sum("monthly_sum").cast("double").alias("total_orders_sum"))
        .select(
            "location_id", "location_name", "total_orders_sum", period("month").alias("period")
        )
    )


def _side_by_side(pos: DataFrame, direct: DataFrame) -> DataFrame:
    """POS and platform totals of the same location and month; both must exist."""
    own = direct.select(
        "location_id",
        "period",
        "location_name",
        F.col("total_orders_sum").alias("platform_sum"),
    )
    return pos.withColumnRenamed("total_orders_sum", "pos_sum").join(
        own, ["location_id", "period"]
    )


def _share(part: Column, whole: Column) -> Column:
    return F.coalesce(ratio(part, whole), F.lit(0.0))


def share_by_location_period(pos: DataFrame, direct: DataFrame) -> DataFrame:
    """Platform share of POS sales per location and month, 0 where nothing was sold."""
    return _side_by_side(pos, direct).select(
        _share(F.col("platform_sum"), F.col("pos_sum")).alias("share"),
        F.col("platform_sum").alias("total_platform_orders_sum"),
        F.col("pos_sum").alias("total_orders_sum"),
        "location_id",
        "merchant_name",
        "location_name",
        "period",
    )


def share_by_period(pos: DataFrame, direct: DataFrame) -> DataFrame:
    """The same per merchant and month, as a ratio of sums."""
    own, all_pos = (exact_sum(c).cast("double") for c in ("platform_sum", "pos_sum"))
    return (
        _side_by_side(pos, direct)
        .groupBy("merchant_name", "period")
        .agg(_share(own, all_pos).alias("share"))
        .select("share", "merchant_name", "period")
    )


def channel_totals_by_period(pos: DataFrame, direct: DataFrame) -> DataFrame:
    """Platform and POS totals per merchant and month, with their ratio.

    A location listed under two merchant names counts its platform sales under both.
    """
    own, all_pos = (exact_sum(c).cast("double") for c in ("platform_sum", "pos_sum"))
    return (
        _side_by_side(pos, direct)
        .groupBy("merchant_name", "period")
        .agg(
            F.coalesce(own, F.lit(0.0)).alias("platform_total"),
            F.coalesce(all_pos, F.lit(0.0)).alias("total"),
            _share(own, all_pos).alias("share_per_merchant"),
        )
    )


def union_channel_sales(
    a: DataFrame, b: DataFrame, minor_unit: int = 100, max_share: float = 1
) -> DataFrame:
    """Both POS systems in one shape, in major currency units.

    ``a`` counts in units of ``1 / minor_unit``.  Months with a share above ``max_share``, or
    with none, are dropped.
    """
    cents = ["platform_total", "other_total", "total_order"]
    plausible = F.col("share_per_merchant") <= max_share
    left = a.filter(plausible).select(
        "period",
        F.col("business_name").alias("merchant_name"),
        "share_per_merchant",
        *[(F.col(c) / F.lit(minor_unit)).alias(c) for c in cents],
    )
    right = b.filter(plausible).select(
        "period",
        "merchant_name",
        "share_per_merchant",
        "platform_total",
        (F.col("total") - F.col("platform_total")).alias("other_total"),
        F.col("total").alias("total_order"),
    )
    return left.unionByName(right)
