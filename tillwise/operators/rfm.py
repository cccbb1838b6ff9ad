"""Recency, frequency and monetary scores of merchants."""

from __future__ import annotations

from collections.abc import Mapping
from datetime import date

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tillwise.functions.columns import day, exact_sum
from tillwise.functions.ranking import ntiles
from tillwise.operators.segments import SHARE
from tillwise.operators.weights import weighted_sum
from tillwise.sources.shared import reusable

# The default score weights of recency, frequency and share.
DEFAULT_WEIGHTS = {
    "recency": 0.28287841191067,
    "frequency": 0.34987593052109184,
    "monetary": 0.3672456575682382,
}


def rfm_base(
    segment: DataFrame,
    companies: DataFrame,
    orders: DataFrame | None,
    as_of: date | None = None,
    days: DataFrame | None = None,
) -> DataFrame:
    """Days since the last order, order count and order value per merchant of the segment.

    Orders of any status count.  Merchants whose order value is zero or unknown are dropped.
    ``as_of`` defaults to today.  Orders are reduced to one row per merchant id first; where
    ``days``, the stored ``activity.order_days(orders)``, is at hand, they are not read at all.
    """
    today = F.current_date() if as_of is None else F.lit(as_of)
    if days is None:
        dated = orders.filter(F.col("created_at").isNotNull())
        per_company = dated.groupBy(F.col("company_ord_fk").alias("id")).agg(
            F.max("created_at").alias("last"),
            F.count("id").alias("n"),
            exact_sum("calculated_total").alias("worth"),
        )
    else:
        dated = days.filter(F.col("ordered_on").isNotNull())
        per_company = dated.groupBy(F.col("company_ord_fk").alias("id")).agg(
            F.max("last").alias("last"), F.sum("n").alias("n"), F.sum("worth").alias("worth")
        )
    return (
        per_company.join(companies.select("id", F.col("name").alias("merchant_name")), "id")
        .join(segment.select("merchant_name", SHARE), "merchant_name")
        .groupBy("merchant_name", SHARE)
        .agg(
            F.max("last").alias("last_order_date"),
            F.sum("n").alias("frequency"),
            F.sum("worth").cast("double").alias("monetary"),
        )
        .filter(F.col("monetary") != 0)
        .select(
            "merchant_name",
            SHARE,
            F.date_diff(today, day("last_order_date")).alias("recency"),
            "last_order_date",
            "frequency",
            "monetary",
        )
    )


def rfm_quartiles(
    rfm_base: DataFrame,
    buckets: int = 4,
    m_by: str = SHARE,
) -> DataFrame:
    """Add NTILE scores; the highest is the most recent, most frequent, highest ``m_by``.

    ``m_by`` is the channel share unless another column is named.
    """
    name = ("merchant_name", "asc")
    scores = {
        "r_quartile": [("recency", "desc"), ("frequency", "asc"), name],
        "f_quartile": [("frequency", "asc"), name],
        "m_quartile": [(m_by, "asc"), name],
    }
    return ntiles(reusable(rfm_base), scores, buckets)


def rfm_report(
    quartiles: DataFrame,
    labels: DataFrame,
    picked: DataFrame,
    weights: Mapping[str, float] | DataFrame = DEFAULT_WEIGHTS,
    buckets: int = 4,
) -> DataFrame:
    """Scores of the picked merchants, most recent first.

    ``weighted_rfm`` is at most 1 when the weights sum to 1.
    """
    digits = [F.col(c).cast("string") for c in ("r_quartile", "f_quartile", "m_quartile")]
    return (
        quartiles.join(picked, "merchant_name", "left_semi")
        .join(labels, "merchant_name")
        .select(
            "merchant_name",
            "merchant_label",
            SHARE,
            "recency",
            "frequency",
            "monetary",
            "r_quartile",
            "f_quartile",
            "m_quartile",
            F.concat(*digits).alias("rfm_score"),
            weighted_sum(weights, divisor=buckets).alias("weighted_rfm"),
        )
        .orderBy("recency", "merchant_name")
    )
