"""The large merchants, their anonymous labels, and the best and worst of them by share.

Every ordering ends with the merchant name, so ties are broken the same way on every run.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tillwise.functions.columns import exact_mean, exact_sum, ratio
from tillwise.functions.ranking import ntiles, number_rows
from tillwise.sources.shared import reusable

SHARE = "overall_share_per_merchant"


def merchant_totals(sales: DataFrame) -> DataFrame:
    """Revenue and share per merchant: the mean of the monthly shares, and the ratio of sums.

    Sums are decimals to the end, so merchants rank alike however the months were partitioned.
    """
    own, all_ = (exact_sum(c).cast("double") for c in ("platform_total", "total_order"))
    return sales.groupBy("merchant_name").agg(
        exact_mean("share_per_merchant").alias("avg_share_per_merchant"),
        own.alias("total_platform_revenue"),
        all_.alias("total_revenue"),
        ratio(own, all_).alias(SHARE),
    )


def top_revenue_quartile(sales: DataFrame, buckets: int = 4, keep: int = 1) -> DataFrame:
    """Totals of the merchants in NTILE bucket ``keep`` of ``buckets``, largest revenue first."""
    order = [("total_revenue", "desc"), ("merchant_name", "asc")]
    placed = ntiles(reusable(merchant_totals(sales)), {"place": order}, buckets)
    return placed.filter(F.col("place") == keep).drop("place")


def anonymize_by_rank(
    segment: DataFrame, by: str = SHARE, prefix: str = "Merchant "
) -> DataFrame:
    """Label each merchant with its rank by ``by``, highest first."""
    ranked, _ = number_rows(
        reusable(segment.select("merchant_name", by)),
        {"place": [(by, "desc"), ("merchant_name", "asc")]},
    )
    return ranked.select(
        "merchant_name", F.concat(F.lit(prefix), F.col("place")).alias("merchant_label")
    )


def pick_k(
    segment: DataFrame, by: str = SHARE, k: int = 10, descending: bool = True
) -> DataFrame:
    """The ``k`` merchants with the highest, or lowest, ``by``."""
    order = F.desc(by) if descending else F.asc(by)
    return segment.orderBy(order, "merchant_name").limit(k).select("merchant_name")


def channel_split_report(
    sales: DataFrame,
    labels: DataFrame,
    picked: DataFrame,
    names: tuple[str, str] = ("Platform", "Other"),
) -> DataFrame:
    """Revenue of the picked merchants, one row per merchant and channel, in one pass."""
    split = (
        sales.join(picked, "merchant_name", "left_semi")
        .groupBy("merchant_name")
        .agg(
            exact_sum("platform_total").cast("double").alias("flagged"),
            exact_sum("other_total").cast("double").alias("rest"),
        )
        .join(labels, "merchant_name")
    )
    channel = F.explode(
        F.array(
            F.struct(F.col("flagged").alias("total_revenue"), F.lit(names[0]).alias("type")),
            F.struct(F.col("rest").alias("total_revenue"), F.lit(names[1]).alias("type")),
        )
    )
    return split.select("merchant_name", "merchant_label", channel.alias("channel")).select(
        "merchant_name", "merchant_label", "channel.total_revenue", "channel.type"
    )
