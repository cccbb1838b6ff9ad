"""First-time and repeat customers of picked merchants."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tillwise.functions.columns import exact_sum
from tillwise.sources.shared import settle, sized


def _chosen(companies: DataFrame, picked: DataFrame) -> DataFrame:
    """Ids and names of the picked merchants, of known size, to be broadcast to the orders."""
    return sized(
        companies.select(
            F.col("id").alias("company_id"), F.col("name").alias("merchant_name")
        ).join(picked.select("merchant_name"), "merchant_name", "left_semi")
    )


def _completed(orders: DataFrame, status: str) -> DataFrame:
    """Dated orders with ``status`` (lower case)."""
    return orders.filter(
        (F.lower("orderStatus") == status) & F.col("created_at").isNotNull()
    ).select(
        "id",
        F.col("user_id_fk").alias("user_id"),
        F.col("company_ord_fk").alias("company_id"),
        "created_at",
        "orderStatus",
        F.coalesce("calculated_total", F.lit(0.0)).alias("order_total"),
    )


def _per_company(done: DataFrame, chosen: DataFrame, *measures: Column) -> DataFrame:
    """Measures per user and picked merchant id.

    Spark moves the semi-join below the aggregation, to the scan, when it can be broadcast.
    When it cannot, the orders are reduced first, so that no merchant's orders meet in one task.
    """
    return (
        done.groupBy("user_id", "company_id")
        .agg(*measures)
        .join(chosen.select("company_id"), "company_id", "left_semi")
    )


def customer_orders(
    orders: DataFrame, companies: DataFrame, picked: DataFrame, status: str = "completed"
) -> DataFrame:
    """Completed orders of the picked merchants with the customer's order count there.

    The orders are read once: those of the picked merchants are stored, and counted from there.
    The counts are joined back instead of taken from a window, which would hold all orders of
    one customer in one task; orders without a user form one group, possibly a very large one.
    Its count comes from partial counts, and Spark splits the group in the join.
    """
    chosen = _chosen(companies, picked)
    done = _completed(orders, status)
    theirs = settle(done.join(chosen.select("company_id"), "company_id", "left_semi"))
    counts = theirs.groupBy(F.col("user_id").alias("u"), F.col("company_id").alias("c")).agg(
        F.count("id").alias("order_count")
    )
    return (
        theirs.join(chosen, "company_id")
        .join(counts, F.col("user_id").eqNullSafe(F.col("u")) & (F.col("company_id") == F.col("c")))
        .select(
            "user_id",
            "company_id",
            "merchant_name",
            "created_at",
            "orderStatus",
            "order_total",
            "order_count",
        )
    )


def customer_lifetime(customer_orders: DataFrame) -> DataFrame:
    """First and last order, revenue and order count per user and merchant name.

    Where two merchants share a name, ``total_orders`` is the larger of the two counts.
    """
    return customer_orders.groupBy("user_id", "merchant_name").agg(
        F.min("created_at").alias("first_order_date"),
        F.max("created_at").alias("last_order_date"),
        exact_sum("order_total").cast("double").alias("total_revenue"),
        F.max("order_count").alias("total_orders"),
    )


def lifetime_of_orders(
    orders: DataFrame, companies: DataFrame, picked: DataFrame, status: str = "completed"
) -> DataFrame:
    """``customer_lifetime(customer_orders(...))`` by two aggregations and no join back.

    Use it where the single orders are not wanted: it reads the orders once and reduces them
    before the first shuffle.
    """
    chosen = _chosen(companies, picked)
    per_company = _per_company(
        _completed(orders, status),
        chosen,
        F.min("created_at").alias("first"),
        F.max("created_at").alias("last"),
        exact_sum("order_total").alias("revenue"),
        F.count("id").alias("n"),
    )
    return (
        per_company.join(chosen, "company_id")
        .groupBy("user_id", "merchant_name")
        .agg(
            F.min("first").alias("first_order_date"),
            F.max("last").alias("last_order_date"),
            F.sum("revenue").cast("double").alias("total_revenue"),
            F.max("n").alias("total_orders"),
        )
    )


def customer_kinds(lifetime: DataFrame) -> DataFrame:
    """Repeat and first-time customers of each merchant, side by side, in one pass.

    Revenue without a user counts, its user does not.
    """
    orders, revenue = F.col("total_orders"), F.col("total_revenue")
    again, once = orders > 1, orders == 1
    return lifetime.groupBy("merchant_name").agg(
        F.count(F.when(again, F.lit(1))).alias("repeat_rows"),
        F.count(F.when(again, F.col("user_id"))).alias("repeat_customer_count"),
        F.avg(F.when(again, orders)).alias("avg_orders_per_repeat_customer"),
        exact_sum(F.when(again, revenue))
        .cast("double")
        .alias("total_revenue_from_repeat_customers"),
        F.count(F.when(once, F.lit(1))).alias("first_time_rows"),
        F.count(F.when(once, F.col("user_id"))).alias("first_time_customer_count"),
        exact_sum(F.when(once, revenue))
        .cast("double")
        .alias("total_revenue_from_first_time_customers"),
    )


def repeat_customers(lifetime: DataFrame) -> DataFrame:
    """Customers with more than one order, per merchant that has any."""
    return repeat_side(customer_kinds(lifetime))


def first_time_customers(lifetime: DataFrame) -> DataFrame:
    """Customers with exactly one order, per merchant that has any."""
    return first_time_side(customer_kinds(lifetime))


def repeat_side(kinds: DataFrame) -> DataFrame:
    return kinds.filter(F.col("repeat_rows") > 0).select(
        "merchant_name",
        "repeat_customer_count",
        "avg_orders_per_repeat_customer",
        "total_revenue_from_repeat_customers",
    )


def first_time_side(kinds: DataFrame) -> DataFrame:
    return kinds.filter(F.col("first_time_rows") > 0).select(
        "merchant_name", "first_time_customer_count", "total_revenue_from_first_time_customers"
    )


def repeat_vs_first_time_report(
    repeat: DataFrame, first: DataFrame, labels: DataFrame
) -> DataFrame:
    """Both kinds side by side with their part of the revenue in percent.

    Merchants with customers of one kind only are left out.
    """
    again = F.col("total_revenue_from_repeat_customers")
    once = F.col("total_revenue_from_first_time_customers")

    def percent(part):
        return F.round(part / F.nullif(again + once, F.lit(0.0)) * 100, 2)

    return (
        repeat.join(first, "merchant_name")
        .join(labels, "merchant_name")
        .select(
            "merchant_name",
            "merchant_label",
            "repeat_customer_count",
            "first_time_customer_count",
            "avg_orders_per_repeat_customer",
            again,
            once,
            percent(again).alias("repeat_customer_revenue_percentage"),
            percent(once).alias("first_time_customer_revenue_percentage"),
        )
        .orderBy("merchant_name")
    )
