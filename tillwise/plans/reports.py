"""From stored tables to the merchant reports.

``monthly_sales`` is the one expensive relation: it reads every payment and order.  Each report
stores it (merchants x months) and works on from there.
"""

from __future__ import annotations

from collections.abc import Callable, Iterable, Mapping
from dataclasses import dataclass, replace
from datetime import date
from functools import cached_property

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tillwise.functions.columns import channel_flag, day, exact_sum, month, period
from tillwise.operators import activity, channels, cohorts, customers, rfm, segments, weights
from tillwise.sources.shared import settle


@dataclass(frozen=True)
class Inputs:
    """Tables in the shape of ``sources.schemas`` and what the reports ask of them."""

    orders: DataFrame
    companies: DataFrame
    locations: DataFrame
    pos_a_locations: DataFrame
    pos_a_payments: DataFrame
    pos_b_orders: DataFrame
    start: date
    end: date
    note_pattern: str = "%Platform%"
    churn_pattern: str = "%CHURN%"
    pos_a: str = "POS_A"
    pos_b: str = "POS_B"
    #: The stored ``activity.order_days(orders)``: see ``with_order_days``.
    days: DataFrame | None = None

    @property
    def flag(self) -> Column:
        return channel_flag("payment_details.note", self.note_pattern)


def with_order_days(t: Inputs) -> Inputs:
    """Inputs with the orders by day, stored: one read of the orders for all that is per merchant."""
    return t if t.days is not None else replace(t, days=settle(activity.order_days(t.orders)))


def id_bridge(t: Inputs) -> DataFrame:
    return activity.resolve_external_ids(
        t.pos_a_locations, "ext_id", "ext_id__it", ["merchant_id", "merchant_name"]
    )


def _dates(t: Inputs) -> DataFrame | None:
    return None if t.days is None else activity.dates_of_days(t.days)


def spans_a(t: Inputs) -> DataFrame:
    return activity.activity_span_bridged(
        t.orders, t.companies, id_bridge(t), t.pos_a, t.churn_pattern, dates=_dates(t)
    )


def spans_b(t: Inputs) -> DataFrame:
    return activity.activity_span(
        t.orders, t.companies, t.pos_b, t.churn_pattern, dates=_dates(t)
    )


def pos_a_sales(t: Inputs) -> DataFrame:
    return channels.channel_sales_in_one_read(
        t.pos_a_payments,
        t.pos_a_locations,
        id_bridge(t),
        spans_a(t),
        t.flag,
        t.start,
        t.end,
    )


def pos_b_sides(t: Inputs) -> tuple[DataFrame, DataFrame]:
    """POS totals and the platform's own totals per location and month."""
    t = with_order_days(t)
    pos = channels.pos_totals_by_location_period(t.pos_b_orders, t.start, t.end)
    direct = channels.direct_orders_of_days(
        t.days, activity.live_locations(t.locations), spans_b(t), t.start, t.end
    )
    return pos, direct


def monthly_sales(t: Inputs) -> DataFrame:
    """Sales per merchant and month over both POS systems.

    Activity windows and the platform's own totals come from the orders by day.
    """
    t = with_order_days(t)
    return channels.union_channel_sales(
        pos_a_sales(t), channels.channel_totals_by_period(*pos_b_sides(t))
    )


@dataclass(frozen=True)
class Segment:
    """Stored monthly sales with the large merchants, their labels and the k picked ones."""

    sales: DataFrame
    merchants: DataFrame
    picked: DataFrame

    @cached_property
    def labels(self) -> DataFrame:
        """Ranked only where a report shows them."""
        return segments.anonymize_by_rank(self.merchants)


def segment(
    t: Inputs, descending: bool = True, k: int = 10, sales: DataFrame | None = None
) -> Segment:
    """``sales`` is the stored result of ``monthly_sales``, if several reports share it."""
    sales = settle(monthly_sales(t)) if sales is None else sales
    merchants = segments.top_revenue_quartile(sales)
    return Segment(
        sales,
        merchants,
        segments.pick_k(merchants, k=k, descending=descending),
    )


def channel_split(
    t: Inputs, descending: bool = True, k: int = 10, sales: DataFrame | None = None
) -> DataFrame:
    s = segment(t, descending, k, sales)
    return segments.channel_split_report(s.sales, s.labels, s.picked)


def repeat_vs_first_time(
    t: Inputs, descending: bool = True, k: int = 10, sales: DataFrame | None = None
) -> DataFrame:
    s = segment(t, descending, k, sales)
    lifetime = customers.lifetime_of_orders(t.orders, t.companies, s.picked)
    kinds = settle(customers.customer_kinds(lifetime))
    return customers.repeat_vs_first_time_report(
        customers.repeat_side(kinds), customers.first_time_side(kinds), s.labels
    )


def rfm_scores(
    t: Inputs,
    as_of: date | None = None,
    descending: bool = True,
    k: int = 10,
    score_weights: Mapping[str, float] | DataFrame = rfm.DEFAULT_WEIGHTS,
    sales: DataFrame | None = None,
) -> DataFrame:
    t = with_order_days(t)
    s = segment(t, descending, k, sales)
    base = rfm.rfm_base(s.merchants, t.companies, None, as_of, t.days)
    return rfm.rfm_report(rfm.rfm_quartiles(base), s.labels, s.picked, score_weights)


def all_reports(t: Inputs, as_of: date | None = None, k: int = 10) -> dict[str, DataFrame]:
    """The three reports for the best and the worst merchants.

    Monthly sales, the segment, the customers of both picks and the scores are taken once each;
    the two sides are filters on them.
    """
    t = with_order_days(t)
    sales = settle(monthly_sales(t))
    merchants = settle(segments.top_revenue_quartile(sales))
    labels = settle(segments.anonymize_by_rank(merchants))
    picks = {
        side: settle(segments.pick_k(merchants, k=k, descending=side == "top"))
        for side in ("top", "bottom")
    }
    both = picks["top"].union(picks["bottom"]).distinct()
    kinds = settle(
        customers.customer_kinds(customers.lifetime_of_orders(t.orders, t.companies, both))
    )
    base = rfm.rfm_base(merchants, t.companies, None, as_of, t.days)
    quartiles = settle(rfm.rfm_quartiles(base))
    reports = {}
    for side, picked in picks.items():
        mine = kinds.join(picked, "merchant_name", "left_semi")
        reports[f"channel_split_{side}"] = segments.channel_split_report(sales, labels, picked)
        reports[f"repeat_vs_first_time_{side}"] = customers.repeat_vs_first_time_report(
            customers.repeat_side(mine), customers.first_time_side(mine), labels
        )
        reports[f"rfm_scores_{side}"] = rfm.rfm_report(quartiles, labels, picked)
    return reports


def all_merchant_quartiles(t: Inputs, as_of: date | None = None) -> DataFrame:
    """RFM quartiles over every merchant with sales, stored: the input of the weight fits."""
    t = with_order_days(t)
    totals = segments.merchant_totals(monthly_sales(t))
    return settle(rfm.rfm_quartiles(rfm.rfm_base(totals, t.companies, None, as_of, t.days)))


def weighted_scores(
    quartiles: DataFrame, fit: Callable[[DataFrame], DataFrame] = weights.fit_boosted_weights
) -> DataFrame:
    """Fit weights on stored quartiles and add the weighted score, raw and over its maximum."""
    scored = weights.apply_weights(quartiles, fit(quartiles))
    return weights.normalize_by_max(scored)


def cohort_report(
    orders: DataFrame,
    companies: DataFrame,
    min_cohort: str,
    label_pattern: str,
    yes: str,
    no: str,
    names: Iterable[str] | None = None,
    status: str = "completed",
) -> DataFrame:
    """Cohorts from one scan of the orders.

    The same result as ``first_activity``, ``cohort_activity_matrix`` and ``cohort_rollup``.
    Orders are reduced to months per user and merchant, and the first date is the least over
    those months, so the orders are read once and shuffled after that reduction only.
    """
    merchants = cohorts.with_shared_names(cohorts.merchants_of(companies, names))
    monthly = (
        orders.filter((F.lower("orderStatus") == status) & F.col("user_id_fk").isNotNull())
        .groupBy(
            F.col("user_id_fk").alias("user_id"),
            F.col("company_ord_fk").alias("company_id"),
            month("created_at").alias("order_month"),
        )
        .agg(
            exact_sum("calculated_total").alias("total_revenue"),
            F.min(day("created_at")).alias("first_in_month"),
        )
    )
    # One row per month here, so a user's rows at one merchant are few.
    first = F.min("first_in_month").over(W.partitionBy("user_id", "company_id"))
    matrix = (
        monthly.withColumn("cohort_period", period(first))
        .filter(F.col("cohort_period") >= min_cohort)
        .join(merchants, "company_id")
        .groupBy("merchant_name", "cohort_period", "order_month")
        .agg(
            cohorts.customers_in(F.col("shared"), F.col("user_id")).alias("active_customers"),
            F.sum("total_revenue").cast("double").alias("total_revenue"),
        )
    )
    return cohorts.cohort_rollup(matrix, min_cohort, label_pattern, yes, no)
