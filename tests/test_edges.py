"""Hand-made rows for the cases listed in FIXTURES.md section 4."""

from datetime import date, datetime

import pytest
from pyspark.sql import functions as F

from tests.conftest import rows
from tillwise.functions.columns import channel_flag, day
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
from tillwise.plans import reports
from tillwise.sources import schemas

START, END = date(2023, 1, 1), date(2023, 12, 31)


def flag():
    return channel_flag("payment_details.note", "%Platform%")


def at(text):
    return datetime.fromisoformat(text)


def make(spark, schema, data):
    return spark.createDataFrame(data, schema)


def company(i, name, disabled=0, integration="POS_A", credentials=None, merchant="M1"):
    return (i, name, disabled, integration, credentials or i + 100, merchant)


def order(i, user, comp, when, total, status="COMPLETED", location=1):
    return (i, user, comp, location, at(when) if when else None, status, total)


def payment(i, location, when, note, customer, amount, status="COMPLETED"):
    return ((i, status, location, at(when), note, customer, (amount,)),)


@pytest.fixture
def pos_a(spark):
    def build(payments, locations, bridge, spans, start=START, end=END):
        p = make(spark, schemas.POS_A_PAYMENTS, payments)
        l = make(
            spark,
            "id long, merchant_id string, business_name string",
            [(i, m, f"shop {i}") for i, m in locations],
        )
        flags = channels.flagged_count_by_location(p, l, flag(), start, end)
        return channels.channel_sales_by_period(
            p,
            l,
            make(spark, "merchant_id string, merchant_name string, resolved_id long", bridge),
            flags,
            make(
                spark,
                "pos_merchant_id string, first_order date, latest_order date, is_churned boolean",
                spans,
            ),
            flag(),
            start,
            end,
        )

    return build


OPEN = ("M1", date(2023, 1, 1), date(2023, 6, 1), False)


def test_bridge_fan_out(pos_a):
    out = pos_a(
        [payment(1, 1, "2023-02-01", "Platform", 9, 1000)],
        [(1, "M1")],
        [("M1", "One", 5), ("M1", "One", 6)],
        [OPEN],
    )
    r = out.first()
    assert (r.total_order, r.platform_order_count) == (2000, 2)
    assert (r.platform_unique_customers, r.share_per_merchant) == (1, 1.0)


def test_note_decides_channel_and_averages_keep_apart(pos_a):
    out = pos_a(
        [
            payment(1, 1, "2023-02-01", "a Platform order", 9, 100),
            payment(2, 1, "2023-02-02", None, 9, 900),
            payment(3, 1, "2023-02-03", "x", 8, 500),
            payment(4, 1, "2023-02-03", "platform", None, None),
        ],
        [(1, "M1")],
        [("M1", "One", 5)],
        [OPEN],
    )
    r = out.first()
    assert (r.total_order, r.platform_total, r.other_total) == (1500, 100, 1400)
    assert r.platform_avg_total == 100
    # The missing amount counts as 0 in the average and not at all in the order count.
    assert r.other_avg_total == pytest.approx(1400 / 3)
    assert (r.platform_order_count, r.other_order_count) == (1, 2)
    assert (r.platform_customer_count, r.other_customer_count) == (1, 2)
    assert (r.platform_unique_customers, r.other_unique_customers) == (1, 2)


def test_only_the_other_channel_in_a_month(pos_a):
    out = pos_a(
        [
            payment(1, 1, "2023-02-01", "Platform", 9, 100),
            payment(2, 1, "2023-03-01", None, 9, 50),
        ],
        [(1, "M1")],
        [("M1", "One", 5)],
        [OPEN],
    )
    march = out.filter("period = '2023-03'").first()
    assert march.platform_avg_total is None
    assert (march.platform_total, march.share_per_merchant) == (0, 0.0)


def test_location_gate(pos_a):
    out = pos_a(
        [
            payment(1, 1, "2023-02-01", "Platform", 9, 100),
            payment(2, 2, "2023-02-01", "till", 9, 700),
            payment(3, 2, "2022-02-01", "Platform", 9, 700),
            payment(4, 2, "2023-02-01", "Platform", 9, 700, status="FAILED"),
        ],
        [(1, "M1"), (2, "M1")],
        [("M1", "One", 5)],
        [OPEN],
    )
    assert rows(out, "total_order") == [(100,)]


def test_flagged_count_keeps_locations_with_none(spark):
    p = make(
        spark,
        schemas.POS_A_PAYMENTS,
        [
            payment(1, 1, "2023-02-01", "Platform", 9, 1),
            payment(2, 2, "2023-02-01", "till", 9, 1),
            payment(3, 3, "2023-02-01", "Platform", 9, 1),
        ],
    )
    l = make(
        spark,
        "id long, merchant_id string, business_name string",
        [(1, "M1", "a"), (2, "M1", "b")],
    )
    out = channels.flagged_count_by_location(p, l, flag(), START, END)
    assert rows(out, "pos_location_id", "platform_order_count") == [(1, 1), (2, 0)]


@pytest.mark.parametrize("churned,kept", [(True, 1), (None, 1), (False, 2)])
def test_activity_window_in_sales(pos_a, churned, kept):
    out = pos_a(
        [
            payment(1, 1, "2022-12-31", "Platform", 9, 1),
            payment(2, 1, "2023-05-01", "Platform", 9, 1),
            payment(3, 1, "2023-07-01", "Platform", 9, 1),
        ],
        [(1, "M1")],
        [("M1", "One", 5)],
        [("M1", date(2023, 1, 1), date(2023, 6, 1), churned)],
        start=date(2022, 1, 1),
    )
    assert out.agg(F.sum("total_order")).first()[0] == kept


def test_overlapping_windows_do_not_double_payments(pos_a):
    out = pos_a(
        [
            payment(1, 1, "2023-02-01", "Platform", 9, 1),
            payment(2, 1, "2023-04-10", "Platform", 9, 1),
            payment(3, 1, "2023-08-01", "Platform", 9, 1),
        ],
        [(1, "M1")],
        [("M1", "One", 5)],
        [
            ("M1", date(2023, 1, 1), date(2023, 3, 1), True),
            ("M1", date(2023, 1, 15), date(2023, 2, 20), True),
            ("M1", date(2023, 4, 1), date(2023, 5, 1), True),
        ],
    )
    assert out.agg(F.sum("total_order")).first()[0] == 2


def test_windows_hold_the_same_days(spark):
    spans = make(
        spark,
        "k string, first_order date, latest_order date, is_churned boolean",
        [
            ("a", date(2023, 1, 1), date(2023, 1, 10), True),
            ("a", date(2023, 1, 5), date(2023, 1, 20), None),
            ("a", date(2023, 2, 1), date(2023, 2, 2), True),
            ("b", date(2023, 1, 3), date(2023, 1, 4), False),
            ("b", date(2023, 1, 1), date(2023, 1, 1), True),
            ("c", None, date(2023, 1, 1), True),
        ],
    )
    assert rows(activity.activity_windows(spans, "k")) == [
        ("a", date(2023, 1, 1), date(2023, 1, 20)),
        ("a", date(2023, 2, 1), date(2023, 2, 2)),
        ("b", date(2023, 1, 1), date(2023, 1, 1)),
        ("b", date(2023, 1, 3), date.max),
    ]


def test_activity_gate(spark):
    spans = make(
        spark,
        "id long, first_order date, latest_order date, is_churned boolean",
        [
            (1, date(2023, 1, 1), date(2023, 2, 1), True),
            (2, date(2023, 1, 1), date(2023, 2, 1), False),
            (3, date(2023, 1, 1), date(2023, 2, 1), None),
            (2, date(2023, 1, 1), date(2023, 2, 1), False),
        ],
    )
    facts = make(
        spark,
        "id long, on date",
        [(i, d) for i in (1, 2, 3, 4) for d in (date(2022, 1, 1), START, date(2023, 3, 1))],
    )
    kept = activity.activity_gate(facts, spans, "id", "on")
    assert rows(kept) == [(1, START), (2, START), (2, date(2023, 3, 1)), (3, START)]


def test_unresolved_ids_and_churn(spark):
    l = make(
        spark,
        schemas.POS_A_LOCATIONS,
        [
            (1, "M1", "b", "One", "101", None),
            (2, "M1", "b", "One", None, 101),
            (3, "M2", "b", "Two", None, None),
            (4, "M3", "b", "Three", "103", 999),
        ],
    )
    bridge = activity.resolve_external_ids(l, "ext_id", "ext_id__it", ["merchant_id"])
    assert rows(bridge) == [("M1", 101), ("M3", 103)]
    comps = make(
        spark,
        schemas.COMPANIES,
        [
            company(1, "One CHURN", credentials=101),
            company(3, "Three", credentials=103, merchant=None, disabled=None),
            company(4, "Four", credentials=104),
        ],
    )
    orders = make(
        spark,
        schemas.ORDERS,
        [
            order(1, 1, 1, "2023-01-05", 1.0),
            order(2, 1, 1, "2023-01-09", 1.0),
            order(3, 1, 1, "2023-01-11", 1.0, status="completed"),
            order(4, 1, 3, "2023-01-11", 1.0),
            order(5, 1, 4, "2023-01-11", 1.0),
        ],
    )
    spans = activity.activity_span_bridged(orders, comps, bridge, "POS_A")
    assert rows(spans, "id", "first_order", "latest_order", "is_churned", "pos_merchant_id") == [
        (1, date(2023, 1, 5), date(2023, 1, 9), True, "M1"),
        (3, date(2023, 1, 11), date(2023, 1, 11), None, "M3"),
    ]


def test_dirty_ids(spark):
    df = make(spark, "a string, b long", [("12.6", 7), ("x", None), ("8", 1)])
    lenient = activity.resolve_external_ids(df, "a", "b", [], strict=False)
    assert rows(lenient) == [(7,), (8,)]
    with pytest.raises(Exception, match="CAST_INVALID_INPUT"):
        activity.resolve_external_ids(df, "a", "b", []).collect()


def test_big_ids(spark):
    df = make(spark, "a string, b long", [("3000000000", None)])
    assert rows(activity.resolve_external_ids(df, "a", "b", [])) == [(3000000000,)]


def test_active_entities_and_live_locations(spark):
    comps = make(
        spark,
        schemas.COMPANIES,
        [
            company(1, "One"),
            company(2, "Two CHURN"),
            company(3, "Three", disabled=1),
            company(4, "Four"),
            company(5, "Five", merchant="M5"),
        ],
    )
    creds = make(spark, schemas.CREDENTIALS, [(101, "C1"), (102, "C2"), (103, "C3"), (105, None)])
    orders = make(
        spark,
        schemas.ORDERS,
        [order(i, 1, i, "2023-01-05", 1.0, status="CANCELLED") for i in (1, 1, 2, 3, 4, 5)],
    )
    active = activity.active_entities(orders, comps, creds, "POS_A")
    assert rows(active, "id", "pos_merchant_id") == [(1, "C1"), (5, "M5")]
    places = make(spark, schemas.LOCATIONS, [(1, "a", 0), (2, "b", 1), (3, "c", None)])
    assert rows(activity.live_locations(places)) == [(1, "a")]


def _sides(spark):
    pos = make(
        spark,
        "total_orders_sum double, location_id long, merchant_name string, period string",
        [
            (10.0, 1, "One", "2023-01"),
            (0.0, 2, "Zero", "2023-01"),
            (20.0, 3, "One", "2023-01"),
            (8.0, 3, "Twin", "2023-01"),
            (5.0, 4, "Alone", "2023-01"),
        ],
    )
    direct = make(
        spark,
        "location_id long, location_name string, total_orders_sum double, period string",
        [
            (1, "a", 12.0, "2023-01"),
            (2, "b", 3.0, "2023-01"),
            (3, "c", 4.0, "2023-01"),
            (5, "d", 4.0, "2023-01"),
        ],
    )
    return pos, direct


def test_pos_b_shares(spark):
    pos, direct = _sides(spark)
    by_place = channels.share_by_location_period(pos, direct)
    assert rows(by_place, "location_id", "merchant_name", "share") == [
        (1, "One", 1.2),
        (2, "Zero", 0.0),
        (3, "One", 0.2),
        (3, "Twin", 0.5),
    ]
    totals = channels.channel_totals_by_period(pos, direct)
    # The platform sales of location 3 count under both of its names.
    assert rows(totals, "merchant_name", "platform_total", "total") == [
        ("One", 16.0, 30.0),
        ("Twin", 4.0, 8.0),
        ("Zero", 3.0, 0.0),
    ]
    assert rows(channels.share_by_period(pos, direct), "merchant_name", "share") == rows(
        totals, "merchant_name", "share_per_merchant"
    )


def test_union_drops_implausible_shares_and_converts_units(spark):
    a = make(
        spark,
        "business_name string, period string, share_per_merchant double, platform_total long, "
        "other_total long, total_order long",
        [
            ("A", "2023-01", 0.25, 50, 150, 200),
            ("A", "2023-02", None, 0, 0, 0),
            ("A", "2023-03", 1.2, 12, 0, 10),
        ],
    )
    b = make(
        spark,
        "merchant_name string, period string, platform_total double, total double, "
        "share_per_merchant double",
        [("B", "2023-01", 1.0, 4.0, 0.25), ("B", "2023-02", 12.0, 10.0, 1.2)],
    )
    out = channels.union_channel_sales(a, b)
    wanted = ("merchant_name", "platform_total", "other_total", "total_order")
    assert rows(out, *wanted) == [("A", 0.5, 1.5, 2.0), ("B", 1.0, 3.0, 4.0)]


def test_pos_b_totals_take_any_status_and_both_id_columns(spark):
    df = make(
        spark,
        schemas.POS_B_ORDERS,
        [
            ("7", None, "One", (5.0, at("2023-01-31T23:59:59"))),
            (None, 7, "One", (6.0, at("2023-01-01"))),
            ("7", None, "One", (1.0, at("2024-01-01"))),
        ],
    )
    out = channels.pos_totals_by_location_period(df, START, END)
    assert rows(out) == [(11.0, 7, "One", "2023-01")]


SALES = "merchant_name string, period string, share_per_merchant double, platform_total double, other_total double, total_order double"


def _sales(spark, shares):
    return make(
        spark,
        SALES,
        [(n, "2023-01", p / t, p, t - p, t) for n, p, t in shares],
    )


def test_tied_quartiles_and_few_rows(spark):
    five = _sales(spark, [(n, 1.0, 10.0) for n in "edcba"])
    sizes = [rows(segments.top_revenue_quartile(five, keep=k), "merchant_name") for k in (1, 2, 3, 4)]
    assert sizes == [[("a",), ("b",)], [("c",)], [("d",)], [("e",)]]
    three = _sales(spark, [("a", 1.0, 10.0), ("b", 1.0, 30.0), ("c", 1.0, 20.0)])
    assert rows(segments.top_revenue_quartile(three), "merchant_name") == [("b",)]
    assert rows(segments.top_revenue_quartile(three, keep=4)) == []


def test_shares_of_segment_are_ratio_of_sums_and_mean_of_ratios(spark):
    sales = make(
        spark,
        SALES,
        [
            ("a", "2023-01", 0.5, 5.0, 5.0, 10.0),
            ("a", "2023-02", 0.1, 3.0, 27.0, 30.0),
            ("z", "2023-02", 0.0, 0.0, 0.0, 0.0),
        ],
    )
    out = segments.merchant_totals(sales)
    assert rows(out) == [
        ("a", pytest.approx(0.3), 8.0, 40.0, 0.2),
        ("z", 0.0, 0.0, 0.0, None),
    ]


def test_labels_and_picks(spark):
    segment = segments.merchant_totals(
        _sales(spark, [("a", 1.0, 10.0), ("b", 5.0, 10.0), ("c", 3.0, 10.0), ("d", 3.0, 10.0)])
    )
    labels = segments.anonymize_by_rank(segment)
    assert rows(labels) == [
        ("a", "Merchant 4"),
        ("b", "Merchant 1"),
        ("c", "Merchant 2"),
        ("d", "Merchant 3"),
    ]
    assert rows(segments.pick_k(segment, k=2)) == [("b",), ("c",)]
    assert rows(segments.pick_k(segment, k=2, descending=False)) == [("a",), ("c",)]
    assert rows(segments.pick_k(segment, k=9)) == [("a",), ("b",), ("c",), ("d",)]


def _lifetime(spark, orders, companies, picked):
    o, c = make(spark, schemas.ORDERS, orders), make(spark, schemas.COMPANIES, companies)
    p = make(spark, "merchant_name string", [(n,) for n in picked])
    slow = customers.customer_lifetime(customers.customer_orders(o, c, p))
    fast = customers.lifetime_of_orders(o, c, p)
    assert rows(slow) == rows(fast)
    return fast


def test_two_merchants_of_one_name(spark):
    orders = [order(i, 1, 1, f"2023-01-0{i}", 10.0) for i in (1, 2)]
    orders += [order(i, 1, 2, f"2023-01-0{i}", 10.0) for i in (3, 4, 5)]
    life = _lifetime(spark, orders, [company(1, "Twin"), company(2, "Twin")], ["Twin"])
    assert rows(life, "total_orders", "total_revenue") == [(3, 50.0)]


def test_customers_without_id_and_merchants_of_one_kind(spark):
    orders = [
        order(1, None, 1, "2023-01-01", 10.0),
        order(2, None, 1, "2023-01-02", 20.0),
        order(3, 7, 1, "2023-01-02", 5.0, status="Completed"),
        order(4, 7, 1, "2023-01-03", 5.0, status="CANCELLED"),
        order(5, 8, 1, "2023-01-02", None),
        order(6, 8, 1, None, 99.0),
        order(7, 9, 2, "2023-01-02", 1.0),
        order(8, 9, 2, "2023-01-02", 1.0),
        order(9, 9, 3, "2023-01-02", 1.0),
    ]
    comps = [company(1, "One"), company(2, "Two"), company(3, "Three")]
    life = _lifetime(spark, orders, comps, ["One", "Two"])
    repeat, first = customers.repeat_customers(life), customers.first_time_customers(life)
    assert rows(repeat) == [("One", 0, 2.0, 30.0), ("Two", 1, 2.0, 2.0)]
    assert rows(first) == [("One", 2, 5.0)]
    labels = make(
        spark, "merchant_name string, merchant_label string", [("One", "m1"), ("Two", "m2")]
    )
    report = customers.repeat_vs_first_time_report(repeat, first, labels)
    assert rows(report) == [("One", "m1", 0, 2, 2.0, 30.0, 5.0, 85.71, 14.29)]


def test_report_without_revenue(spark):
    orders = [
        order(1, 1, 1, "2023-01-01", 0.0),
        order(2, 2, 1, "2023-01-02", 0.0),
        order(3, 2, 1, "2023-01-02", None),
    ]
    life = _lifetime(spark, orders, [company(1, "One")], ["One"])
    labels = make(spark, "merchant_name string, merchant_label string", [("One", "m1")])
    report = customers.repeat_vs_first_time_report(
        customers.repeat_customers(life), customers.first_time_customers(life), labels
    )
    assert report.first().repeat_customer_revenue_percentage is None


SEGMENT = "merchant_name string, overall_share_per_merchant double"


def test_rfm_base(spark):
    comps = make(
        spark, schemas.COMPANIES, [company(i, n) for i, n in enumerate("ABCDE", 1)]
    )
    orders = make(
        spark,
        schemas.ORDERS,
        [
            order(1, 1, 1, "2023-12-31T18:00:00", 4.0, status="CANCELLED"),
            order(2, 1, 1, "2023-12-01", 6.0),
            order(3, 1, 2, "2023-12-29", 1.0),
            order(4, 1, 3, "2023-12-29", 1.0),
            order(5, 1, 3, "2023-12-30", -1.0),
            order(6, 1, 4, "2023-12-30", None),
            order(7, 1, 2, None, 50.0),
        ],
    )
    segment = make(spark, SEGMENT, [("A", 0.1), ("B", 0.2), ("C", 0.3), ("D", 0.4), ("E", 0.5)])
    out = rfm.rfm_base(segment, comps, orders, as_of=date(2023, 12, 31))
    assert rows(out, "merchant_name", "recency", "frequency", "monetary") == [
        ("A", 0, 2, 10.0),
        ("B", 2, 1, 1.0),
    ]
    today = rfm.rfm_base(segment, comps, orders)
    assert today.filter("merchant_name = 'A'").first().recency > 0


def test_rfm_report(spark):
    base = make(
        spark,
        f"{SEGMENT}, recency int, last_order_date timestamp_ntz, frequency long, monetary double",
        [(n, 0.1 * i, 10 - i, at("2023-01-01"), i, 100.0 - i) for i, n in enumerate("abcd", 1)],
    )
    quartiles = rfm.rfm_quartiles(base)
    scores = ("merchant_name", "r_quartile", "f_quartile", "m_quartile")
    assert rows(quartiles, *scores) == [(n, i, i, i) for i, n in enumerate("abcd", 1)]
    by_money = rfm.rfm_quartiles(base, m_by="monetary")
    assert rows(by_money, "merchant_name", "m_quartile") == [
        (n, 5 - i) for i, n in enumerate("abcd", 1)
    ]
    labels = make(
        spark, "merchant_name string, merchant_label string", [(n, n.upper()) for n in "abcd"]
    )
    picked = make(spark, "merchant_name string", [("d",), ("a",)])
    report = rfm.rfm_report(quartiles, labels, picked).collect()
    assert [(r.merchant_name, r.rfm_score) for r in report] == [("d", "444"), ("a", "111")]
    assert report[0].weighted_rfm == pytest.approx(1.0)
    assert report[1].weighted_rfm == pytest.approx(0.25)
    exact = {"recency": 114 / 403, "frequency": 141 / 403, "monetary": 148 / 403}
    assert rfm.DEFAULT_WEIGHTS == pytest.approx(exact, abs=1e-15)
    one_row = make(spark, "recency double, frequency double, monetary double", [(1.0, 2.0, 3.0)])
    framed = rfm.rfm_report(quartiles, labels, picked, one_row).collect()
    assert framed[0].weighted_rfm == pytest.approx(6.0)


def test_category_relabel_after_grouping(spark):
    out = profile.category_popularity(
        make(
            spark,
            schemas.COMPANIES,
            [company(1, "One"), company(2, "A Test shop"), company(3, "Other")],
        ),
        make(
            spark,
            schemas.ORDERS,
            [order(i, 1, c, "2023-01-01", 1.0) for i, c in ((1, 1), (2, 1), (3, 2), (4, 3))],
        ),
        make(
            spark,
            schemas.ORDER_ITEMS,
            [(1, 1), (1, 1), (2, 2), (2, 3), (2, 4), (3, 1), (4, 1), (9, 1)],
        ),
        make(
            spark,
            schemas.PRODUCT_ITEMS,
            [(1, 1, 2.0), (2, 2, 5.0), (3, 3, 9.0), (4, 4, None)],
        ),
        make(
            spark,
            schemas.PRODUCTS,
            [(1, "bun", "x"), (2, "roll", "y"), (3, "TEST roll", "y"), (4, "cake", "x")],
        ),
        make(spark, schemas.CATEGORIES, [("x", "Pastry"), ("y", "Pastries")]),
        relabel={"Pastry": "Pastries"},
        names=["One", "A Test shop"],
    )
    assert out.collect() == [("One", "Pastries", 3, 2.0), ("One", "Pastries", 1, 5.0)]


def test_hours_and_weekdays(spark):
    comps = make(spark, schemas.COMPANIES, [company(1, "One"), company(2, "Two")])
    orders = make(
        spark,
        schemas.ORDERS,
        [
            order(1, 1, 1, "2023-01-01T09:59:00", 1.0),
            order(2, 1, 1, "2023-01-07T09:00:00", 1.0),
            order(None, 1, 1, "2023-01-07T09:00:00", 1.0),
            order(3, 1, 2, "2023-01-07T23:00:00", 1.0),
        ],
    )
    assert rows(profile.orders_by_hour(orders, comps, ["One"])) == [("One", 9, 2)]
    assert rows(profile.orders_by_weekday(orders, comps)) == [
        ("One", 0, 1),
        ("One", 6, 1),
        ("Two", 6, 1),
    ]


def test_cohorts(spark):
    comps = make(spark, schemas.COMPANIES, [company(1, "Ruby"), company(2, "Ruby"), company(3, "X")])
    orders = make(
        spark,
        schemas.ORDERS,
        [order(i, 1, 1, f"2023-0{i}-05", 10.0) for i in (1, 2, 3)]
        + [
            order(4, 1, 2, "2023-02-09", 1.0),
            order(5, None, 1, "2023-02-09", 100.0),
            order(6, 2, 1, "2022-12-31", 1.0),
            order(7, 2, 1, "2023-01-31", 1.0),
            order(8, 3, 1, "2023-01-31", 1.0, status="CANCELLED"),
            order(9, 4, 3, "2023-03-31", 2.0, status="Completed"),
            order(10, 5, 3, "2023-03-01", None),
            order(11, 1, 1, "2023-01-06", 10.0),
            order(12, 1, 1, None, 7.0),
        ],
    )
    first = cohorts.first_activity(orders, comps)
    matrix = cohorts.cohort_activity_matrix(orders, first)
    january = matrix.filter("merchant_name = 'Ruby' and cohort_period = '2023-01'")
    assert rows(january, "order_period", "active_customers", "total_revenue") == [
        (None, 1, 7.0),
        ("2023-01", 1, 20.0),
        ("2023-02", 1, 10.0),
        ("2023-03", 1, 10.0),
    ]
    args = ("2023-01", "%Ruby%", "yes", "no")
    rolled = cohorts.cohort_rollup(matrix, *args)
    assert rows(rolled) == [
        ("Ruby", "yes", "2023-01", 4, 47.0),
        ("Ruby", "yes", "2023-02", 1, 1.0),
        ("X", "no", "2023-03", 2, 2.0),
    ]
    assert rows(reports.cohort_report(orders, comps, *args)) == rows(rolled)
    only = cohorts.first_activity(orders, comps, names=["X"])
    assert rows(only, "user_id", "first_order_date") == [
        (4, date(2023, 3, 31)),
        (5, date(2023, 3, 1)),
    ]
    assert rows(reports.cohort_report(orders, comps, *args, names=["X"])) == [
        ("X", "no", "2023-03", 2, 2.0)
    ]


def test_direct_orders(spark):
    orders = make(
        spark,
        schemas.ORDERS,
        [
            order(1, 1, 1, "2023-01-05", 1.0),
            order(2, 1, 1, "2023-01-05T20:00:00", 2.0),
            order(3, 1, 1, "2023-01-09", 4.0),
            order(4, 1, 1, "2023-02-01", 8.0),
            order(5, 1, 1, "2023-01-06", 16.0, status="CANCELLED"),
            order(6, 1, 1, "2023-01-06", 32.0, location=2),
            order(7, 1, 9, "2023-01-06", 64.0),
        ],
    )
    spans = make(
        spark,
        "company_id long, first_order date, latest_order date, is_churned boolean",
        [(1, date(2023, 1, 5), date(2023, 1, 31), True)],
    )
    live = make(spark, "id long, name string", [(1, "a")])
    out = channels.direct_orders_by_location_period(orders, live, spans, START, END)
    assert rows(out) == [(1, "a", 7.0, "2023-01")]


def test_day_of_timestamp(spark):
    df = make(spark, "t timestamp_ntz", [(at("2023-01-31T23:59:59"),)])
    assert df.select(day("t")).first()[0] == date(2023, 1, 31)


def test_weights_on_constant_feature(spark):
    df = make(
        spark,
        "r_quartile int, f_quartile int, m_quartile int, overall_share_per_merchant double",
        [(2, f, m, 0.1 * f + 0.3 * m) for f in (1, 2, 3, 4) for m in (1, 2, 4)],
    )
    z = weights.standardize(df)
    assert {r.r_quartile_z for r in z.collect()} == {0.0}
    assert weights.fit_linear_weights_raw(df).first() == pytest.approx((0.0, 0.1, 0.3))
    scaled = weights.fit_linear_weights(df).first()
    assert scaled.recency == 0.0
    dev = df.agg(F.stddev_pop("f_quartile")).first()[0]
    assert scaled.frequency == pytest.approx(0.1 * dev)
