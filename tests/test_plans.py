"""The physical plans are the ones wanted."""

import re
from datetime import date, datetime

import pytest
from pyspark.sql import functions as F

from tests.conftest import make_payments, plan, rows
from tillwise.functions.columns import channel_flag
from tillwise.operators import activity, channels, customers, profile, segments
from tillwise.sources import schemas
from tillwise.sources.shared import settle
from tillwise.sources.tables import conform

START, END = date(2023, 1, 1), date(2023, 3, 31)


@pytest.fixture(scope="module")
def stored_payments(spark):
    return settle(make_payments(spark, 5000))


def scans(df):
    return re.findall(r"FileScan.*", df._jdf.queryExecution().executedPlan().toString())


def test_date_window_and_nested_columns_reach_the_scan(spark, stored_payments, conf):
    conf("spark.sql.debug.maxToStringFields", "1000")
    conf("spark.sql.maxMetadataStringLength", "10000")
    places = spark.createDataFrame(
        [(i, f"M{i % 3}", f"shop {i}") for i in range(20)],
        "id long, merchant_id string, business_name string",
    )
    flag = channel_flag("payment_details.note", "%Platform%")
    out = channels.flagged_count_by_location(
        stored_payments.filter(flag), places, flag, START, END
    )
    (scan,) = scans(out)
    pushed = scan[scan.index("PushedFilters") :]
    assert "EqualTo(payment_details.status,COMPLETED)" in pushed
    assert "GreaterThanOrEqual(payment_details.created_at,2023-01-01T00:00" in pushed
    assert "LessThan(payment_details.created_at,2023-04-01T00:00" in pushed
    read = scan[scan.index("ReadSchema") :]
    assert "customer_id" not in read and "amount" not in read


def test_conform_keeps_pushdown_and_pruning(spark, stored_payments, conf):
    conf("spark.sql.maxMetadataStringLength", "10000")
    df = conform(stored_payments, schemas.POS_A_PAYMENTS)
    out = df.filter(F.col("payment_details.status") == "FAILED").select(
        "payment_details.total_money.amount"
    )
    (scan,) = scans(out)
    assert "EqualTo(payment_details.status,FAILED)" in scan
    assert "note" not in scan[scan.index("ReadSchema") :]


def test_gate_is_a_semi_join(spark):
    facts = spark.range(100).select("id", F.lit(date(2023, 2, 1)).alias("on"))
    spans = settle(
        spark.range(10).select(
            "id",
            F.lit(START).alias("first_order"),
            F.lit(END).alias("latest_order"),
            F.lit(True).alias("is_churned"),
        )
    )
    text = plan(activity.activity_gate(facts, spans, "id", "on"))
    assert re.search(r"BroadcastHashJoin.*LeftSemi", text)
    assert "Exchange hashpartitioning" not in text


def test_profile_counts_before_it_joins(spark, conf):
    conf("spark.sql.autoBroadcastJoinThreshold", "-1")
    orders = spark.createDataFrame([], schemas.ORDERS)
    companies = spark.createDataFrame([], schemas.COMPANIES)
    text = plan(profile.orders_by_hour(orders, companies))
    join = text.index("SortMergeJoin")
    assert "partial_count(id" in text[join:]


def test_pick_is_a_top_k(spark):
    segment = spark.createDataFrame([], "merchant_name string, overall_share_per_merchant double")
    assert "TakeOrderedAndProject(limit=10" in plan(segments.pick_k(segment))


def _hot_orders(spark):
    """A third of all orders have no user and belong to one merchant."""
    n = 60_000
    return settle(
        spark.range(n)
        .select(
            "id",
            F.when(F.col("id") % 3 > 0, F.col("id") % 997).alias("user_id_fk"),
            F.when(F.col("id") % 3 > 0, F.col("id") % 10).otherwise(0).alias("company_ord_fk"),
            F.lit(1).cast("long").alias("location_fk"),
            F.lit(datetime(2023, 2, 1)).cast("timestamp_ntz").alias("created_at"),
            F.lit("COMPLETED").alias("orderStatus"),
            F.lit(1.0).alias("calculated_total"),
        )
        .repartition(8)
    )


def test_hot_customer_is_split_in_the_join(spark, conf):
    """Without broadcasts, the orders without a user are joined by several tasks."""
    orders = _hot_orders(spark)
    companies = spark.createDataFrame(
        [(i, f"m{i}", 0, "POS_A", i, None) for i in range(10)], schemas.COMPANIES
    )
    picked = spark.createDataFrame([(f"m{i}",) for i in range(10)], "merchant_name string")
    for key, value in {
        "spark.sql.autoBroadcastJoinThreshold": "-1",
        "spark.sql.adaptive.advisoryPartitionSizeInBytes": "20000",
        "spark.sql.adaptive.skewJoin.skewedPartitionThresholdInBytes": "40000",
        "spark.sql.adaptive.skewJoin.skewedPartitionFactor": "2",
    }.items():
        conf(key, value)
    out = customers.customer_orders(orders, companies, picked)
    counts = out.filter("user_id is null").groupBy("order_count").count()
    assert [tuple(r) for r in counts.collect()] == [(20_000, 20_000)]
    result = out.collect()
    assert len(result) == 60_000
    assert "skew=true" in out._jdf.queryExecution().executedPlan().toString()


def test_hot_location_is_split_when_places_cannot_be_broadcast(spark, stored_payments, conf):
    for key, value in {
        "spark.sql.autoBroadcastJoinThreshold": "-1",
        "spark.sql.adaptive.advisoryPartitionSizeInBytes": "4000",
        "spark.sql.adaptive.skewJoin.skewedPartitionThresholdInBytes": "8000",
        "spark.sql.adaptive.skewJoin.skewedPartitionFactor": "2",
    }.items():
        conf(key, value)
    flag = channel_flag("payment_details.note", "%Platform%")
    places = spark.createDataFrame(
        [(i, f"M{i % 3}", f"shop {i}") for i in range(20)],
        "id long, merchant_id string, business_name string",
    )
    bridge = spark.createDataFrame(
        [(f"M{i}", f"Name {i}", i) for i in range(3)],
        "merchant_id string, merchant_name string, resolved_id long",
    )
    spans = spark.createDataFrame(
        [(f"M{i}", START, END, False) for i in range(3)],
        "pos_merchant_id string, first_order date, latest_order date, is_churned boolean",
    )

    def sales():
        flags = channels.flagged_count_by_location(stored_payments, places, flag, START, END)
        return channels.channel_sales_by_period(
            stored_payments.repartition(8), places, bridge, flags, spans, flag, START, END
        )

    split = sales()
    got = rows(split)
    assert "skew=true" in split._jdf.queryExecution().executedPlan().toString()
    conf("spark.sql.autoBroadcastJoinThreshold", "10000000")
    whole = sales()
    assert rows(whole) == got
    assert "SortMergeJoin" not in plan(whole)


def test_no_query_plan_crosses_tables(spark):
    """Nested-loop joins and Cartesian products appear in no plan."""
    import __spark_entry__ as entry
    from tillwise.sources.sample_tables import SampleTables

    tables = SampleTables(spark, "/root/testdata/sf0.001")
    for name in (
        "rfm_report_top",
        "channel_split_report_bottom",
        "cohort_report",
        "category_popularity",
        "customer_orders",
        "standardize",
        "activity_gate",
    ):
        text = plan(getattr(entry, name)(tables))
        assert "CartesianProduct" not in text, name
        assert "NestedLoopJoin" not in text, name


def _reads(monkeypatch, build, path):
    """How often the plans of ``build()``, with all that it stores, scan files below ``path``."""
    import importlib

    found = []

    def counted(df):
        found.append(df._jdf.queryExecution().optimizedPlan().toString().count("Relation") and _scans_of(df, path))

    def watched(df):
        counted(df)
        return settle(df)

    for name in ("plans.reports", "operators.channels", "operators.customers", "functions.ranking"):
        monkeypatch.setattr(importlib.import_module(f"tillwise.{name}"), "settle", watched)
    out = build()
    counted(out)
    return sum(found)


def _scans_of(df, path):
    leaves = df._jdf.queryExecution().optimizedPlan().collectLeaves()
    texts = []
    for i in range(leaves.size()):
        leaf = leaves.apply(i)
        if leaf.nodeName() == "LogicalRelation":
            texts.append(leaf.relation().location().rootPaths().mkString(","))
    return sum(path in t for t in texts)


@pytest.fixture
def stored_inputs(spark):
    """Report inputs whose orders and payments are files of their own."""
    import dataclasses

    import __spark_entry__ as entry
    from tillwise.sources.sample_tables import SampleTables

    tables = SampleTables(spark, "/root/testdata/sf0.001")
    orders, payments = settle(tables.orders), settle(tables.pos_a_payments)
    inputs = dataclasses.replace(entry._inputs(tables), orders=orders, pos_a_payments=payments)
    paths = [x.inputFiles()[0].rsplit("/", 1)[0].split("/")[-1] for x in (orders, payments)]
    return inputs, *paths


def test_orders_and_payments_are_read_once(stored_inputs, monkeypatch):
    from tillwise.plans import reports

    inputs, orders, payments = stored_inputs
    as_of = date(2001, 9, 1)
    for build in (
        lambda: reports.monthly_sales(inputs),
        lambda: reports.rfm_scores(inputs, as_of),
        lambda: reports.channel_split(inputs),
        lambda: reports.all_merchant_quartiles(inputs, as_of),
    ):
        for path in (orders, payments):
            with monkeypatch.context() as patch:
                assert _reads(patch, build, path) == 1


def test_customer_orders_read_the_orders_once(spark, monkeypatch):
    orders = _hot_orders(spark)
    companies = spark.createDataFrame(
        [(i, f"m{i}", 0, "POS_A", i, None) for i in range(10)], schemas.COMPANIES
    )
    picked = spark.createDataFrame([("m0",), ("m1",)], "merchant_name string")
    path = orders.inputFiles()[0].rsplit("/", 1)[0].split("/")[-1]
    build = lambda: customers.customer_orders(orders, companies, picked)
    assert _reads(monkeypatch, build, path) == 1


def test_one_read_of_payments_gives_what_two_reads_give(spark, stored_inputs):
    from tillwise.plans import reports

    x, _, _ = stored_inputs
    flags = channels.flagged_count_by_location(
        x.pos_a_payments, x.pos_a_locations, x.flag, x.start, x.end
    )
    two = channels.channel_sales_by_period(
        x.pos_a_payments, x.pos_a_locations, reports.id_bridge(x), flags, reports.spans_a(x), x.flag, x.start, x.end
    )
    got = rows(reports.pos_a_sales(x))
    assert got and got == rows(two)


def test_days_give_what_orders_give(spark, stored_inputs):
    from tillwise.operators import rfm
    from tillwise.plans import reports

    x, _, _ = stored_inputs
    days = settle(activity.order_days(x.orders))
    assert rows(activity.dates_of_days(days)) == rows(activity.order_dates(x.orders))
    live, spans = activity.live_locations(x.locations), reports.spans_b(x)
    args = (live, spans, x.start, x.end)
    direct = rows(channels.direct_orders_by_location_period(x.orders, *args))
    assert direct and rows(channels.direct_orders_of_days(days, *args)) == direct
    large = segments.top_revenue_quartile(reports.monthly_sales(x))
    base = rows(rfm.rfm_base(large, x.companies, x.orders, date(2001, 9, 1)))
    assert base and rows(rfm.rfm_base(large, x.companies, None, date(2001, 9, 1), days)) == base


def test_sums_are_the_same_for_any_partitions(spark, conf):
    """Doubles are summed in decimals up to the last sum."""
    rng = __import__("random").Random(1)
    data = [
        (f"2023-{1 + i % 9:02d}", f"m{i % 7}", rng.random(), rng.random() * 1e6, rng.random() * 1e6, rng.random() * 1e7)
        for i in range(600)
    ]
    schema = "period string, merchant_name string, share_per_merchant double, platform_total double, other_total double, total_order double"
    lives = [(i, f"m{i % 7}", 1 + i % 3, rng.random() * 1e5) for i in range(600)]
    found = []
    for n in (4, 16):
        conf("spark.sql.shuffle.partitions", str(n))
        sales = settle(spark.createDataFrame(data, schema).repartition(n))
        lifetime = spark.createDataFrame(
            lives, "user_id long, merchant_name string, total_orders long, total_revenue double"
        ).repartition(n)
        top = segments.top_revenue_quartile(sales)
        labels = segments.anonymize_by_rank(top)
        found.append(
            (
                rows(segments.merchant_totals(sales)),
                rows(segments.channel_split_report(sales, labels, top.select("merchant_name"))),
                rows(customers.customer_kinds(lifetime)),
            )
        )
    assert found[0] == found[1]


def test_customers_are_counted_by_rows_but_for_shared_names(spark):
    """Two ids of one name: a user at both counts once.  Other names send no user twice."""
    from tillwise.operators import cohorts
    from tillwise.plans import reports

    orders = settle(
        spark.range(4000).select(
            "id",
            (F.col("id") % 300).alias("user_id_fk"),
            (F.col("id") % 7).alias("company_ord_fk"),
            F.lit(1).cast("long").alias("location_fk"),
            F.expr("timestamp_ntz'2023-01-05 08:00:00' + make_dt_interval(int(id % 90))").alias("created_at"),
            F.lit("COMPLETED").alias("orderStatus"),
            F.lit(2.5).alias("calculated_total"),
        )
    )
    # Ids 0, 1 and 2 share a name.
    companies = spark.createDataFrame(
        [(i, f"m{max(0, i - 2)}", 0, "POS_A", i, None) for i in range(7)], schemas.COMPANIES
    )
    first = cohorts.first_activity(orders, companies)
    plainly = cohorts.cohort_activity_matrix(orders, first)
    merchants = cohorts.merchants_of(companies, None)
    by_rows = cohorts.cohort_activity_matrix(orders, first, merchants=merchants)
    got = rows(by_rows)
    assert got and got == rows(plainly)
    report = reports.cohort_report(orders, companies, "2023-01", "%1%", "one", "other")
    rolled = cohorts.cohort_rollup(plainly, "2023-01", "%1%", "one", "other")
    assert rows(report, *rolled.columns) == rows(rolled)
    # Users of names of their own are no key of the second shuffle.
    assert re.search(r"Exchange hashpartitioning\(merchant_name[^)]*if \(shared|CASE WHEN shared", plan(by_rows))
