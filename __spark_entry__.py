"""Queries over the test tables and the SQL each one is checked against."""

from __future__ import annotations

import dataclasses
import uuid
from collections.abc import Callable
from datetime import date

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from oracle.texts import oracle_texts
from tillwise.functions.columns import day, period
from tillwise.operators import (
    activity,
    channels,
    cohorts,
    customers,
    profile,
    rfm,
    segments,
    weights,
)
from tillwise.plans import incremental, reports
from tillwise.sources.sample_tables import POS_A, POS_B, SampleTables
from tillwise.sources import schemas, tables
from tillwise.sources.shared import settle, shared_folder

try:
    import corpus_pipeline
    from tillwise.llm import queries as text_queries
except ModuleNotFoundError as gone:
    if gone.name not in ("corpus_pipeline", "tillwise.llm"):
        raise
    corpus_pipeline = text_queries = None

START, END = date(1996, 1, 1), date(1996, 9, 30)
AS_OF = date(2001, 9, 1)
MIN_COHORT = "1996-01"
LATE = "1996-05"
LABEL = ("%7%", "Seven", "Not seven")
RELABEL = {"PROMO": "Promotion", "ECONOMY": "Economy"}
BUCKETS = 16
NAMED = ("Supplier#000000002", "Supplier#000000003", "Supplier#000000007 CHURN")


def _inputs(t: SampleTables, stored: bool = False) -> reports.Inputs:
    return reports.Inputs(
        orders=t.stored_orders if stored else t.orders,
        companies=t.companies,
        locations=t.locations,
        pos_a_locations=t.pos_a_locations,
        pos_a_payments=t.pos_a_payments,
        pos_b_orders=t.pos_b_orders,
        start=START,
        end=END,
        pos_a=POS_A,
        pos_b=POS_B,
    )


def _shown(df: DataFrame, money: str = "", ratios: str = "") -> DataFrame:
    """Round floating-point columns and spell out dates and times for the comparison."""
    for places, names in ((2, money), (6, ratios)):
        for name in names.split():
            df = df.withColumn(name, F.round(F.col(name), places))
    for name, kind in df.dtypes:
        if kind in ("date", "timestamp_ntz", "timestamp"):
            df = df.withColumn(name, F.col(name).cast("string"))
        elif kind == "int":
            df = df.withColumn(name, F.col(name).cast("bigint"))
    return df


# A. Activity profile


def orders_by_hour(t):
    return _shown(profile.orders_by_hour(t.timed_orders, t.companies))


def orders_by_weekday(t):
    return _shown(profile.orders_by_weekday(t.orders, t.companies))


def orders_by_hour_named(t):
    return _shown(profile.orders_by_hour(t.timed_orders, t.companies, NAMED))


def orders_by_weekday_named(t):
    return _shown(profile.orders_by_weekday(t.orders, t.companies, NAMED))


def category_popularity(t):
    return _categories(t, None)


def category_popularity_named(t):
    return _categories(t, NAMED)


def category_popularity_bucketed(t):
    """The same from orders and items stored in buckets of the order's id."""
    folder, name = _folder(t)
    stored = [
        tables.write_bucketed(df, f"{name}_{what}", f"{folder}/{what}", key, BUCKETS)
        for what, df, key in (("orders", t.orders, "id"), ("items", t.order_items, "order_fk"))
    ]
    return _categories(t, None, *stored)


def orders_by_weekday_catalog(t):
    """The same from catalog tables whose columns have other names."""
    folder, name = _folder(t)
    own = t.orders.withColumnsRenamed({"created_at": "placed", "company_ord_fk": "company"})
    tables.write_catalog(own, f"{name}_orders", f"{folder}/orders")
    tables.write_catalog(t.companies, f"{name}_companies", f"{folder}/companies")
    orders = tables.read_catalog(
        t.spark,
        f"{name}_orders",
        schemas.ORDERS,
        {"created_at": "placed", "company_ord_fk": "company"},
    )
    companies = tables.read_catalog(t.spark, f"{name}_companies", schemas.COMPANIES)
    return _shown(profile.orders_by_weekday(orders, companies))


def _categories(t, names, orders=None, items=None):
    result = profile.category_popularity(
        t.companies,
        t.orders if orders is None else orders,
        t.order_items if items is None else items,
        t.product_items,
        t.products,
        t.categories,
        relabel=RELABEL,
        names=names,
    )
    return _shown(result, ratios="average_price")


# B. Cohorts


def first_activity(t):
    return _shown(cohorts.first_activity(t.orders, t.companies))


def first_activity_named(t):
    return _shown(cohorts.first_activity(t.orders, t.companies, names=NAMED))


def _matrix(t):
    orders = t.stored_orders
    return cohorts.cohort_activity_matrix(
        orders,
        cohorts.first_activity(orders, t.companies),
        merchants=cohorts.merchants_of(t.companies, None),
    )


def cohort_activity_matrix(t):
    return _shown(_matrix(t), money="total_revenue")


def cohort_rollup(t):
    return _shown(cohorts.cohort_rollup(_matrix(t), MIN_COHORT, *LABEL), money="total_revenue")


def cohort_report(t):
    result = reports.cohort_report(t.orders, t.companies, MIN_COHORT, *LABEL)
    return _shown(result, money="total_revenue")


# C. Identity and activity windows


def resolve_external_ids(t):
    return reports.id_bridge(_inputs(t))


def activity_span_bridged(t):
    return _shown(reports.spans_a(_inputs(t)))


def activity_span(t):
    return _shown(reports.spans_b(_inputs(t)))


def active_entities(t):
    return _shown(activity.active_entities(t.orders, t.companies, t.credentials, POS_A))


def live_locations(t):
    return activity.live_locations(t.locations)


def activity_gate(t):
    facts = t.stored_orders.withColumn("ordered_on", day("created_at"))
    spans = settle(reports.spans_b(_inputs(t, stored=True)))
    kept = activity.activity_gate(facts, spans, "company_ord_fk", "ordered_on", "company_id")
    return _shown(kept.select("id", "company_ord_fk", "ordered_on"))


# D. Channel share


def flagged_count_by_location(t):
    x = _inputs(t)
    return channels.flagged_count_by_location(
        x.pos_a_payments, x.pos_a_locations, x.flag, x.start, x.end
    )


def channel_sales_by_period(t):
    return _shown(
        reports.pos_a_sales(_inputs(t)),
        ratios="platform_avg_total other_avg_total share_per_merchant",
    )


def pos_totals_by_location_period(t):
    result = channels.pos_totals_by_location_period(t.pos_b_orders, START, END)
    return _shown(result, money="total_orders_sum")


def direct_orders_by_location_period(t):
    return _shown(reports.pos_b_sides(_inputs(t))[1], money="total_orders_sum")


def share_by_location_period(t):
    result = channels.share_by_location_period(*reports.pos_b_sides(_inputs(t)))
    return _shown(result, money="total_platform_orders_sum total_orders_sum", ratios="share")


def share_by_period(t):
    result = channels.share_by_period(*reports.pos_b_sides(_inputs(t)))
    return _shown(result, ratios="share")


def channel_totals_by_period(t):
    result = channels.channel_totals_by_period(*reports.pos_b_sides(_inputs(t)))
    return _shown(result, money="platform_total total", ratios="share_per_merchant")


def union_channel_sales(t):
    return _shown(
        reports.monthly_sales(_inputs(t)),
        money="platform_total other_total total_order",
        ratios="share_per_merchant",
    )


def _folder(t):
    """A new folder of the session, and a name for tables in it."""
    name = f"tillwise_{uuid.uuid4().hex}"
    return f"{shared_folder(t.spark)}/{name}", name


def monthly_sales_refreshed(t):
    """Sales from the sinks: built without a third of one month's facts, then that month again."""
    x = _inputs(t)
    sinks = incremental.Sinks(t.spark, _folder(t)[0])
    stale = lambda ts: (period(ts) != LATE) | (F.day(ts) > 10)
    before = dataclasses.replace(
        x,
        orders=x.orders.filter(stale("created_at")),
        pos_a_payments=x.pos_a_payments.filter(stale("payment_details.created_at")),
        pos_b_orders=x.pos_b_orders.filter(stale("payment_details.estimatedfulfillmentdate")),
    )
    months = [r[0] for r in x.orders.select(period("created_at")).distinct().collect()]
    window = [f"{START.year}-{m:02d}" for m in range(START.month, END.month + 1)]
    incremental.refresh(before, sinks, {*months, *window})
    incremental.refresh(x, sinks, [LATE])
    return _shown(
        incremental.monthly_sales(x, sinks),
        money="platform_total other_total total_order",
        ratios="share_per_merchant",
    )


# E. Segments and reports


def top_revenue_quartile(t):
    return _shown(
        segments.top_revenue_quartile(reports.monthly_sales(_inputs(t))),
        money="total_platform_revenue total_revenue",
        ratios="avg_share_per_merchant overall_share_per_merchant",
    )


def anonymize_by_rank(t):
    return reports.segment(_inputs(t)).labels


def pick_k_top(t):
    return reports.segment(_inputs(t)).picked


def pick_k_bottom(t):
    return reports.segment(_inputs(t), descending=False).picked


def channel_split_report_top(t):
    return _shown(reports.channel_split(_inputs(t)), money="total_revenue")


def channel_split_report_bottom(t):
    return _shown(
        reports.channel_split(_inputs(t), descending=False), money="total_revenue"
    )


# F. Customers


def _picked_orders(t):
    x = _inputs(t, stored=True)
    return x.orders, x.companies, reports.segment(x).picked


def customer_orders(t):
    return _shown(customers.customer_orders(*_picked_orders(t)), money="order_total")


def customer_lifetime(t):
    lifetime = customers.customer_lifetime(customers.customer_orders(*_picked_orders(t)))
    return _shown(lifetime, money="total_revenue")


def repeat_customers(t):
    return _shown(
        customers.repeat_customers(customers.lifetime_of_orders(*_picked_orders(t))),
        money="total_revenue_from_repeat_customers",
        ratios="avg_orders_per_repeat_customer",
    )


def first_time_customers(t):
    return _shown(
        customers.first_time_customers(customers.lifetime_of_orders(*_picked_orders(t))),
        money="total_revenue_from_first_time_customers",
    )


def _customer_report(t, descending):
    return _shown(
        reports.repeat_vs_first_time(_inputs(t, stored=True), descending),
        money="total_revenue_from_repeat_customers total_revenue_from_first_time_customers",
        ratios="avg_orders_per_repeat_customer",
    )


def repeat_vs_first_time_report_top(t):
    return _customer_report(t, True)


def repeat_vs_first_time_report_bottom(t):
    return _customer_report(t, False)


# G. RFM


def _rfm_base(t):
    x = reports.with_order_days(_inputs(t))
    large = segments.top_revenue_quartile(reports.monthly_sales(x))
    return rfm.rfm_base(large, x.companies, None, AS_OF, x.days)


def rfm_base(t):
    return _shown(_rfm_base(t), money="monetary", ratios="overall_share_per_merchant")


def rfm_base_today(t):
    """Recency as of today."""
    x = reports.with_order_days(_inputs(t))
    large = segments.top_revenue_quartile(reports.monthly_sales(x))
    base = rfm.rfm_base(large, x.companies, x.orders)
    return _shown(base, money="monetary", ratios="overall_share_per_merchant")


def rfm_quartiles(t):
    return _shown(
        rfm.rfm_quartiles(_rfm_base(t)), money="monetary", ratios="overall_share_per_merchant"
    )


def _rfm_report(t, descending):
    return _shown(
        reports.rfm_scores(_inputs(t), AS_OF, descending),
        money="monetary",
        ratios="overall_share_per_merchant weighted_rfm",
    )


def rfm_report_top(t):
    return _rfm_report(t, True)


def rfm_report_bottom(t):
    return _rfm_report(t, False)


# H. Weights, fitted on the quartiles of all merchants with sales

_WEIGHTS = "recency frequency monetary"


def _quartiles(t):
    return reports.all_merchant_quartiles(_inputs(t), AS_OF)


def standardize(t):
    scored = weights.standardize(_quartiles(t))
    z = [f"{c}_z" for c in weights.FEATURES]
    return _shown(scored.select("merchant_name", *z), ratios=" ".join(z))


def fit_linear_weights(t):
    return _shown(weights.fit_linear_weights(_quartiles(t)), ratios=_WEIGHTS)


def fit_linear_weights_raw(t):
    return _shown(weights.fit_linear_weights_raw(_quartiles(t)), ratios=_WEIGHTS)


def _forest(quartiles):
    return weights.fit_forest_weights(quartiles, key=["merchant_name"])


def fit_forest_weights(t):
    return _shown(_forest(_quartiles(t)), ratios=_WEIGHTS)


def fit_boosted_weights(t):
    return _shown(weights.fit_boosted_weights(_quartiles(t)), ratios=_WEIGHTS)


def fit_penalized_weights(t):
    return _shown(weights.fit_penalized_weights(_quartiles(t)), ratios=_WEIGHTS)


def fit_penalized_weights_csv(t):
    """The same from a CSV file of the scores, as the scores may come from elsewhere."""
    path = f"{_folder(t)[0]}/rfm.csv"
    tables.write_csv(_quartiles(t).select(*[f.name for f in schemas.RFM.fields]), path)
    scores = tables.read_csv(t.spark, path, schemas.RFM)
    return _shown(weights.fit_penalized_weights(scores), ratios=_WEIGHTS)


def boosted_splits(t):
    return _shown(weights.boosted_splits(_quartiles(t)), ratios="gain")


def normalize_to_shares(t):
    fitted = weights.fit_linear_weights(_quartiles(t))
    return _shown(weights.normalize_to_shares(fitted), ratios=_WEIGHTS)


def _scores(scored: DataFrame) -> DataFrame:
    added = [c for c in scored.columns if c.endswith("weighted_rfm")]
    return _shown(
        scored.select("merchant_name", *weights.FEATURES, *added), ratios=" ".join(added)
    )


def apply_weights(t):
    quartiles = _quartiles(t)
    return _scores(weights.apply_weights(quartiles, weights.fit_linear_weights(quartiles)))


def normalize_by_max(t):
    return _scores(reports.weighted_scores(_quartiles(t), weights.fit_linear_weights))


def scaled_weight_by_max(t):
    quartiles = _quartiles(t)
    fitted = weights.fit_linear_weights(quartiles)
    scored = weights.apply_weights(quartiles, fitted)
    return _shown(weights.scaled_weight_by_max(scored, fitted), ratios="scaled_weight")


def weighted_scores_forest(t):
    return _scores(reports.weighted_scores(_quartiles(t), _forest))


def weighted_scores_boosted(t):
    return _scores(reports.weighted_scores(_quartiles(t), weights.fit_boosted_weights))


def weighted_scores_penalized(t):
    return _scores(reports.weighted_scores(_quartiles(t), weights.fit_penalized_weights))


_QUERIES = (
    orders_by_hour,
    orders_by_hour_named,
    orders_by_weekday,
    orders_by_weekday_named,
    category_popularity,
    category_popularity_named,
    category_popularity_bucketed,
    orders_by_weekday_catalog,
    first_activity,
    first_activity_named,
    cohort_activity_matrix,
    cohort_rollup,
    cohort_report,
    resolve_external_ids,
    activity_span_bridged,
    activity_span,
    active_entities,
    live_locations,
    activity_gate,
    flagged_count_by_location,
    channel_sales_by_period,
    pos_totals_by_location_period,
    direct_orders_by_location_period,
    share_by_location_period,
    share_by_period,
    channel_totals_by_period,
    union_channel_sales,
    monthly_sales_refreshed,
    top_revenue_quartile,
    anonymize_by_rank,
    pick_k_top,
    pick_k_bottom,
    channel_split_report_top,
    channel_split_report_bottom,
    customer_orders,
    customer_lifetime,
    repeat_customers,
    first_time_customers,
    repeat_vs_first_time_report_top,
    repeat_vs_first_time_report_bottom,
    rfm_base,
    rfm_base_today,
    rfm_quartiles,
    rfm_report_top,
    rfm_report_bottom,
    standardize,
    fit_linear_weights,
    fit_linear_weights_raw,
    fit_forest_weights,
    fit_boosted_weights,
    fit_penalized_weights,
    fit_penalized_weights_csv,
    boosted_splits,
    normalize_to_shares,
    apply_weights,
    normalize_by_max,
    scaled_weight_by_max,
    weighted_scores_forest,
    weighted_scores_boosted,
    weighted_scores_penalized,
)


def entry(spark: SparkSession) -> DataFrame:
    """RFM report of the merchants with the highest platform share."""
    return rfm_report_top(SampleTables(spark, "/root/testdata/sf0.001"))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    """One query per operator, reports with both directions; text operators if they are there."""
    found = {
        q.__name__: lambda spark, folder, q=q: q(SampleTables(spark, folder)) for q in _QUERIES
    }
    if text_queries:
        found |= text_queries.QUERIES | {"pipeline": corpus_pipeline.run}
    return found


def oracle_sql() -> dict[str, str]:
    """The same results in DuckDB SQL over the raw tables."""
    found = oracle_texts()
    if text_queries:
        found |= text_queries.ORACLE_SQL
        if corpus_pipeline.ORACLE_SQL:
            found["pipeline"] = corpus_pipeline.ORACLE_SQL
    return found
