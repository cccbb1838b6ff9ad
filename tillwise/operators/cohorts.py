"""Customer cohorts by month of first order."""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tillwise.functions.columns import day, exact_sum, month, named, period
from tillwise.sources.shared import sized


def _done(orders: DataFrame, status: str) -> DataFrame:
    return orders.filter(F.lower("orderStatus") == status)


def merchants_of(companies: DataFrame, names: Iterable[str] | None) -> DataFrame:
    return (
        companies.filter(named("name", names))
        .select(F.col("id").alias("company_id"), F.col("name").alias("merchant_name"))
        .distinct()
    )


def with_shared_names(merchants: DataFrame) -> DataFrame:
    """Merchants with ``shared``: does the name belong to several ids?"""
    ids = F.count("*").over(W.partitionBy("merchant_name"))
    return merchants.withColumn("shared", ids > 1)


def customers_in(shared: Column, user: Column) -> Column:
    """Distinct users of a group of rows that each have a user of their own per merchant id.

    Rows are counted.  Only where ids share a name can a user stand twice in a group: there, and
    nowhere else, users are told apart, so hardly any user is shuffled once more.
    """
    alone = F.count(F.when(~shared, F.lit(1)))
    return alone + F.count_distinct(F.when(shared, user))


def first_activity(
    orders: DataFrame,
    companies: DataFrame,
    status: str = "completed",
    names: Iterable[str] | None = None,
) -> DataFrame:
    """Date of the first order with ``status`` (lower case) per user and merchant."""
    merchants = merchants_of(companies, names)
    done = _done(orders, status).select(
        F.col("user_id_fk").alias("user_id"),
        F.col("company_ord_fk").alias("company_id"),
        day("created_at").alias("ordered_on"),
    )
    if names is not None:
        merchants = sized(merchants)
        done = done.join(merchants.select("company_id"), "company_id", "left_semi")
    return (
        done.groupBy("user_id", "company_id")
        .agg(F.min("ordered_on").alias("first_order_date"))
        .join(merchants, "company_id")
        .select("user_id", "company_id", "merchant_name", "first_order_date")
    )


def cohort_activity_matrix(
    orders: DataFrame,
    first_activity: DataFrame,
    status: str = "completed",
    merchants: DataFrame | None = None,
) -> DataFrame:
    """Distinct customers and revenue per merchant, cohort month and order month.

    Orders are first reduced to one row per user, merchant and month.  Orders without a user
    belong to no cohort.  ``merchants`` is ``merchants_of(companies, names)``: with it, users are
    counted by rows wherever a merchant's name is its own.
    """
    if merchants is None:
        shared = F.lit(True)
    else:
        per_id = with_shared_names(merchants).groupBy("company_id")
        names = sized(per_id.agg(F.max("shared").alias("shared")))
        first_activity = first_activity.join(names, "company_id")
        shared = F.col("shared")
    monthly = (
        _done(orders, status)
        .filter(F.col("user_id_fk").isNotNull())
        .groupBy(
            F.col("user_id_fk").alias("user_id"),
            F.col("company_ord_fk").alias("company_id"),
            month("created_at").alias("order_month"),
        )
        .agg(exact_sum("calculated_total").alias("revenue"))
    )
    return (
        monthly.join(first_activity, ["user_id", "company_id"])
        .groupBy(
            "merchant_name", month("first_order_date").alias("cohort_month"), "order_month"
        )
        .agg(
            customers_in(shared, F.col("user_id")).alias("active_customers"),
            F.sum("revenue").cast("double").alias("total_revenue"),
        )
        .select(
            "merchant_name",
            period("cohort_month").alias("cohort_period"),
            period("order_month").alias("order_period"),
            "active_customers",
            "total_revenue",
        )
    )


def cohort_rollup(
    matrix: DataFrame, min_cohort: str, label_pattern: str, yes: str, no: str
) -> DataFrame:
    """Sum the matrix over order months from cohort ``min_cohort`` (``yyyy-MM``) on.

    ``active_customers`` then counts customer-months.  Merchants whose name is LIKE
    ``label_pattern`` are labelled ``yes``, the others ``no``.
    """
    return (
        matrix.filter(F.col("cohort_period") >= min_cohort)
        .groupBy("merchant_name", "cohort_period")
        .agg(
            F.sum("active_customers").alias("active_customers"),
            exact_sum("total_revenue").cast("double").alias("total_revenue"),
        )
        .select(
            "merchant_name",
            F.when(F.col("merchant_name").like(label_pattern), yes)
            .otherwise(no)
            .alias("merchant"),
            "cohort_period",
            "active_customers",
            "total_revenue",
        )
    )
