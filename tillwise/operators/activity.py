"""Who a merchant is in the other system, and from when to when it was active.

Orders are reduced to one row per merchant id before they meet any other table.
"""

from __future__ import annotations

from collections.abc import Sequence
from datetime import date

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tillwise.functions.columns import churned, day, exact_sum, first_id


def resolve_external_ids(
    df: DataFrame, primary: str, fallback: str, keep: Sequence[str], strict: bool = True
) -> DataFrame:
    """Distinct ``keep`` columns with one id out of two; rows with neither id are dropped."""
    return (
        df.select(*keep, first_id(primary, fallback, strict).alias("resolved_id"))
        .filter(F.col("resolved_id").isNotNull())
        .distinct()
    )


def order_dates(orders: DataFrame, status: str = "COMPLETED") -> DataFrame:
    """First and last order with ``status`` per merchant id; both kinds of span start here."""
    ordered_on = day("created_at")
    return (
        orders.filter(F.col("orderStatus") == status)
        .groupBy(F.col("company_ord_fk").alias("id"))
        .agg(F.min(ordered_on).alias("first_order"), F.max(ordered_on).alias("latest_order"))
    )


def order_days(orders: DataFrame) -> DataFrame:
    """Orders by merchant id, location, status and day, as states that may be summed further.

    Windows (``dates_of_days``), the platform's own totals and RFM scores need no more of the
    orders, so stored once it stands for them: its rows are the days on which something was sold.
    """
    return orders.groupBy(
        "company_ord_fk", "location_fk", "orderStatus", day("created_at").alias("ordered_on")
    ).agg(
        F.count("id").alias("n"),
        F.max("created_at").alias("last"),
        exact_sum("calculated_total").alias("worth"),
    )


def dates_of_days(days: DataFrame, status: str = "COMPLETED") -> DataFrame:
    """``order_dates`` from ``order_days``."""
    return (
        days.filter(F.col("orderStatus") == status)
        .groupBy(F.col("company_ord_fk").alias("id"))
        .agg(F.min("ordered_on").alias("first_order"), F.max("ordered_on").alias("latest_order"))
    )


def activity_span_bridged(
    orders: DataFrame,
    companies: DataFrame,
    bridge: DataFrame,
    integration: str,
    churn_pattern: str = "%CHURN%",
    status: str = "COMPLETED",
    dates: DataFrame | None = None,
) -> DataFrame:
    """First and last completed order per merchant, with its id in the POS system.

    ``bridge`` (merchant_id, resolved_id) gives that id, the company table does where the bridge
    has none.  A merchant with no bridge row is left out.  ``dates`` is ``order_dates(orders)``
    if that is at hand already.
    """
    merchants = (
        companies.filter(F.col("payment_integration") == integration)
        .join(
            bridge.select("merchant_id", F.col("resolved_id").alias("payment_credentials_id")),
            "payment_credentials_id",
        )
        .select(
            "name",
            "id",
            "is_disabled",
            churned("is_disabled", "name", churn_pattern).alias("is_churned"),
            F.coalesce("merchant_id", "pos_merchant_id").alias("pos_merchant_id"),
        )
        .distinct()
    )
    dates = order_dates(orders, status) if dates is None else dates
    return (
        dates.join(merchants, "id")
        .select("first_order", "latest_order", "name", "id", "is_churned", "pos_merchant_id")
    )


def activity_span(
    orders: DataFrame,
    companies: DataFrame,
    integration: str,
    churn_pattern: str = "%CHURN%",
    status: str = "COMPLETED",
    dates: DataFrame | None = None,
) -> DataFrame:
    """The same for a POS system whose merchants need no id bridge."""
    merchants = (
        companies.filter(F.col("payment_integration") == integration)
        .select(
            "name",
            "id",
            "is_disabled",
            churned("is_disabled", "name", churn_pattern).alias("is_churned"),
        )
        .distinct()
    )
    dates = order_dates(orders, status) if dates is None else dates
    return (
        dates.join(merchants, "id")
        .select(
            "first_order", "latest_order", "name", F.col("id").alias("company_id"), "is_churned"
        )
    )


def active_entities(
    orders: DataFrame,
    companies: DataFrame,
    credentials: DataFrame,
    integration: str,
    churn_pattern: str = "%CHURN%",
) -> DataFrame:
    """Enabled merchants, not marked as churned, with at least one order of any status."""
    ordered = orders.select(F.col("company_ord_fk").alias("id")).distinct()
    return (
        companies.filter(
            (F.col("payment_integration") == integration)
            & (F.col("is_disabled") == 0)
            & ~F.col("name").like(churn_pattern)
        )
        .join(
            credentials.select(F.col("id").alias("payment_credentials_id"), "merchant_id"),
            "payment_credentials_id",
        )
        .join(ordered, "id", "left_semi")
        .select(
            "name",
            "id",
            "is_disabled",
            F.coalesce("merchant_id", "pos_merchant_id").alias("pos_merchant_id"),
        )
        .distinct()
    )


def live_locations(locations: DataFrame) -> DataFrame:
    """Locations that are not deleted; an unknown flag is not live."""
    return locations.filter(~F.col("is_deleted").cast("boolean")).select("id", "name")


def activity_windows(spans: DataFrame, key: str) -> DataFrame:
    """Disjoint (entity, opens, closes) windows that hold the same days as ``spans``.

    Overlapping windows of one entity are merged.  Entities that have not churned stay open
    to the last date there is.
    """
    windows = (
        spans.select(
            F.col(key).alias("entity"),
            F.col("first_order").alias("opens"),
            F.when(~F.col("is_churned"), F.lit(date.max))
            .otherwise(F.col("latest_order"))
            .alias("closes"),
        )
        .dropna()
        .distinct()
    )
    by_start = W.partitionBy("entity").orderBy("opens", "closes")
    reach = F.max("closes").over(by_start.rowsBetween(W.unboundedPreceding, -1))
    gap = F.coalesce(F.col("opens") > reach, F.lit(True)).cast("int")
    return (
        windows.withColumn("gap", gap)
        .withColumn("run", F.sum("gap").over(by_start.rowsBetween(W.unboundedPreceding, 0)))
        .groupBy("entity", "run")
        .agg(F.min("opens").alias("opens"), F.max("closes").alias("closes"))
        .drop("run")
    )


def activity_gate(
    facts: DataFrame, spans: DataFrame, key: str, date_col: str, span_key: str | None = None
) -> DataFrame:
    """Keep facts dated inside an activity window of their entity.

    Windows of entities that have not churned have no upper end.  ``key`` is the entity column
    of ``facts`` and ``span_key`` that of ``spans``.  The facts are moved only when the windows
    are too large to broadcast, which the planner can tell if ``spans`` is a stored table.
    """
    window = spans.select(
        F.col(span_key or key).alias("__entity"),
        F.col("first_order").alias("__from"),
        F.col("latest_order").alias("__to"),
        F.col("is_churned").alias("__churned"),
    )
    on = F.col(date_col)
    return facts.join(
        window,
        (F.col(key) == F.col("__entity"))
        & (on >= F.col("__from"))
        & ((on <= F.col("__to")) | ~F.col("__churned")),
        "left_semi",
    )
