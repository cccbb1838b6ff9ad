"""What must hold for any input."""

from datetime import date

import pytest
from pyspark.sql import functions as F

from tests.conftest import make_payments, rows
from tillwise.functions.columns import channel_flag
from tillwise.operators import channels, segments
from tillwise.plans import reports
from tillwise.sources.sample_tables import SampleTables
from tillwise.sources.shared import settle

import __spark_entry__ as entry

START, END = date(2023, 1, 1), date(2023, 6, 30)


def _sales(spark, payments):
    flag = channel_flag("payment_details.note", "%Platform%")
    places = spark.createDataFrame(
        [(i, f"M{i % 3}", f"shop {i}") for i in range(20)],
        "id long, merchant_id string, business_name string",
    )
    bridge = spark.createDataFrame(
        [("M0", "Zero", 1), ("M0", "Zero", 2), ("M1", "One", 3), ("M2", "Two", 4)],
        "merchant_id string, merchant_name string, resolved_id long",
    )
    spans = spark.createDataFrame(
        [
            ("M0", date(2023, 2, 1), date(2023, 3, 1), True),
            ("M0", date(2023, 2, 15), date(2023, 4, 1), True),
            ("M1", START, START, False),
            ("M2", START, END, None),
        ],
        "pos_merchant_id string, first_order date, latest_order date, is_churned boolean",
    )
    flags = channels.flagged_count_by_location(payments, places, flag, START, END)
    out = channels.channel_sales_by_period(
        payments, places, bridge, flags, spans, flag, START, END
    )
    return out, places, bridge, spans


@pytest.fixture(scope="module")
def payments(spark):
    return settle(make_payments(spark, 4000))


def test_sales_against_the_plain_definition(spark, payments):
    """Row by row in Python: gates, fan-out, sums and distinct customers."""
    out, places, bridge, spans = _sales(spark, payments)
    shops = {r.id: r.merchant_id for r in places.collect()}
    names = [(r.merchant_id, r.merchant_name) for r in bridge.collect()]
    windows = [tuple(r) for r in spans.collect()]
    paid = [
        r.payment_details
        for r in payments.collect()
        if r.payment_details.status == "COMPLETED"
        and START <= r.payment_details.created_at.date() <= END
    ]
    flagged_shops = {p.location_id for p in paid if "Platform" in (p.note or "")}
    want = {}
    for p in paid:
        merchant, on = shops[p.location_id], p.created_at.date()
        if p.location_id not in flagged_shops:
            continue
        if not any(
            m == merchant and a <= on and (on <= b or c is False) for m, a, b, c in windows
        ):
            continue
        for m, name in names:
            if m == merchant:
                key = (m, name, on.strftime("%Y-%m"))
                want.setdefault(key, []).append(p)
    expected = []
    for key, group in want.items():
        sides = {True: [], False: []}
        for p in group:
            sides["Platform" in (p.note or "")].append(p)
        amounts = {k: sum(p.total_money.amount for p in v) for k, v in sides.items()}
        expected.append(
            (
                *key,
                amounts[True] + amounts[False],
                amounts[True],
                len(sides[True]),
                len(sides[False]),
                sum(p.customer_id is not None for p in sides[True]),
                len({p.customer_id for p in sides[True]} - {None}),
                len({p.customer_id for p in sides[False]} - {None}),
            )
        )
    got = rows(
        out,
        "merchant_id",
        "business_name",
        "period",
        "total_order",
        "platform_total",
        "platform_order_count",
        "other_order_count",
        "platform_customer_count",
        "platform_unique_customers",
        "other_unique_customers",
    )
    assert got == sorted(expected)
    assert len(got) > 5


def test_parts_make_the_whole_whatever_the_partitioning(spark, payments):
    results = []
    for df in (payments, payments.repartition(1), payments.repartition(16)):
        out = _sales(spark, df)[0]
        assert out.filter(
            F.col("platform_total") + F.col("other_total") != F.col("total_order")
        ).isEmpty()
        results.append(rows(out))
    assert results[0] == results[1] == results[2]


def test_shares_lie_between_zero_and_one(spark):
    tables = SampleTables(spark, "/root/testdata/sf0.001")
    sales = settle(reports.monthly_sales(entry._inputs(tables, stored=True)))
    assert sales.filter(~F.col("share_per_merchant").between(0, 1)).isEmpty()
    sizes = [segments.top_revenue_quartile(sales, keep=k).count() for k in (1, 2, 3, 4)]
    assert sum(sizes) == sales.select("merchant_name").distinct().count()
    assert max(sizes) - min(sizes) <= 1


def test_session_time_zone_does_not_matter(spark, conf):
    tables = SampleTables(spark, "/root/testdata/sf0.001")
    results = []
    for zone in ("UTC", "America/Sao_Paulo", "Asia/Tokyo"):
        conf("spark.sql.session.timeZone", zone)
        results.append(
            [
                rows(entry.orders_by_hour(tables)),
                rows(entry.union_channel_sales(tables)),
                rows(entry.cohort_report(tables)),
            ]
        )
    assert results[0] == results[1] == results[2]


def test_reports_over_shared_sales_are_the_single_reports(spark):
    tables = SampleTables(spark, "/root/testdata/sf0.001")
    inputs = entry._inputs(tables, stored=True)
    together = reports.all_reports(inputs, entry.AS_OF)
    assert len(together) == 6
    apart = {
        "channel_split_top": reports.channel_split(inputs),
        "repeat_vs_first_time_bottom": reports.repeat_vs_first_time(inputs, descending=False),
        "rfm_scores_top": reports.rfm_scores(inputs, entry.AS_OF),
    }
    for name, single in apart.items():
        assert rows(together[name]) == rows(single), name
        assert rows(single)
