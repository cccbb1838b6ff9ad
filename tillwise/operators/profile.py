"""When merchants sell, and what.

Facts are counted per merchant id before any join, so only counts are shuffled and a merchant
that holds much of the table is already reduced on the map side.
"""

from __future__ import annotations

from collections.abc import Iterable, Mapping

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tillwise.functions.columns import exact_sum, named
from tillwise.sources.shared import sized


def _orders_by(
    orders: DataFrame, companies: DataFrame, slot: Column, label: str, names: Iterable[str] | None
) -> DataFrame:
    counts = orders.groupBy("company_ord_fk", slot.alias(label)).agg(F.count("id").alias("n"))
    merchants = companies.filter(named("name", names)).select(
        F.col("id").alias("company_ord_fk"), F.col("name").alias("merchant_name")
    )
    return (
        counts.join(merchants, "company_ord_fk")
        .groupBy("merchant_name", label)
        .agg(F.sum("n").alias("order_count"))
    )


def orders_by_hour(
    orders: DataFrame,
    companies: DataFrame,
    names: Iterable[str] | None = None,
    ts: str = "created_at",
) -> DataFrame:
    """Orders per merchant and hour of day."""
    return _orders_by(orders, companies, F.hour(ts), "hour", names)


def orders_by_weekday(
    orders: DataFrame,
    companies: DataFrame,
    names: Iterable[str] | None = None,
    ts: str = "created_at",
) -> DataFrame:
    """Orders per merchant and weekday, 0 = Sunday."""
    weekday = F.dayofweek(ts) - F.lit(1)
    return _orders_by(orders, companies, weekday, "day_of_the_week", names)


def category_popularity(
    companies: DataFrame,
    orders: DataFrame,
    items: DataFrame,
    variants: DataFrame,
    products: DataFrame,
    categories: DataFrame,
    relabel: Mapping[str, str] | None = None,
    exclude: str = "%test%",
    names: Iterable[str] | None = None,
) -> DataFrame:
    """Order lines and mean list price per merchant and category, most lines first.

    Rows are grouped by the stored category name and relabelled afterwards, so two categories
    given one label stay two rows.  ``exclude`` is a LIKE pattern on lower-case product and
    merchant names.
    """
    kept = ~F.lower("name").like(exclude)
    merchants = companies.filter(kept & named("name", names)).select(
        F.col("id").alias("company_ord_fk"), F.col("name").alias("merchant_name")
    )
    placed = orders.select(F.col("id").alias("order_fk"), "company_ord_fk")
    if names is not None:
        placed = placed.join(
            sized(merchants.select("company_ord_fk")), "company_ord_fk", "left_semi"
        )
    lines = (
        items.join(placed, "order_fk")
        .groupBy("company_ord_fk", "productItem_fk")
        .agg(F.count("*").alias("n"))
    )
    listed = (
        variants.select(F.col("id").alias("productItem_fk"), "product_fk", "price")
        .join(
            products.filter(kept).select(F.col("id").alias("product_fk"), "category_fk"),
            "product_fk",
        )
        .join(
            categories.select(F.col("id").alias("category_fk"), F.col("name").alias("category")),
            "category_fk",
        )
        .select("productItem_fk", "category", "price")
    )
    priced = F.when(F.col("price").isNotNull(), F.col("n"))
    label = F.col("category")
    for old, new in (relabel or {}).items():
        label = F.when(F.col("category") == old, F.lit(new)).otherwise(label)
    return (
        lines.join(listed, "productItem_fk")
        .groupBy("company_ord_fk", "category")
        .agg(
            F.sum("n").alias("n"),
            exact_sum(F.col("price").cast("decimal(18,8)") * F.col("n")).alias("worth"),
            F.sum(priced).alias("priced"),
        )
        .join(merchants, "company_ord_fk")
        .groupBy("merchant_name", "category")
        .agg(
            F.sum("n").alias("total_orders"),
            (F.sum("worth").cast("double") / F.sum("priced")).alias("average_price"),
        )
        .select("merchant_name", label.alias("category_name"), "total_orders", "average_price")
        .orderBy(F.desc("total_orders"), "merchant_name", "category_name")
    )
