"""Sinks by month against the full run, and tables that are stored and read back."""

import dataclasses
import glob
import os
from datetime import date

import pytest
from pyspark.sql import functions as F

import __spark_entry__ as entry
from tests.conftest import plan, rows
from tillwise.functions.columns import period
from tillwise.operators import profile
from tillwise.plans import incremental, reports
from tillwise.sources import tables
from tillwise.sources.sample_tables import SampleTables
from tillwise.sources.shared import settle

MONTHS = [f"{y}-{m:02d}" for y in range(1992, 2003) for m in range(1, 13)]


@pytest.fixture(scope="module")
def inputs(spark):
    t = SampleTables(spark, "/root/testdata/sf0.001")
    x = entry._inputs(t)
    return dataclasses.replace(
        x, orders=settle(x.orders), pos_a_payments=settle(x.pos_a_payments), pos_b_orders=settle(x.pos_b_orders)
    )


def _files(folder):
    return {f: os.stat(f).st_mtime_ns for f in glob.glob(f"{folder}/**/*.parquet", recursive=True)}


def test_full_refresh_equals_the_full_run(spark, inputs, tmp_path):
    sinks = incremental.Sinks(spark, str(tmp_path))
    incremental.refresh(inputs, sinks, MONTHS)
    got = rows(incremental.monthly_sales(inputs, sinks))
    assert got and got == rows(reports.monthly_sales(inputs))


def test_one_month_is_refreshed_alone(spark, inputs, tmp_path):
    """Late rows arrive, and rows vanish, in one month; only its folders are written."""
    sinks = incremental.Sinks(spark, str(tmp_path))
    off = lambda ts: period(ts) != "1996-03"
    early = dataclasses.replace(
        inputs,
        orders=inputs.orders.filter(off("created_at")),
        pos_a_payments=inputs.pos_a_payments.filter(off("payment_details.created_at")),
        pos_b_orders=inputs.pos_b_orders.filter(off("payment_details.estimatedfulfillmentdate")),
    )
    incremental.refresh(early, sinks, MONTHS)
    assert rows(incremental.monthly_sales(early, sinks)) == rows(reports.monthly_sales(early))
    before = _files(tmp_path)
    incremental.refresh(inputs, sinks, ["1996-03"])
    after = _files(tmp_path)
    assert {f for f in after if before.get(f) != after[f]} == {f for f in after if "of=1996-03" in f}
    assert rows(incremental.monthly_sales(inputs, sinks)) == rows(reports.monthly_sales(inputs))
    # A month whose rows are gone is removed.
    incremental.refresh(early, sinks, ["1996-03"])
    assert not [f for f in _files(tmp_path) if "of=1996-03" in f]
    assert rows(incremental.monthly_sales(early, sinks)) == rows(reports.monthly_sales(early))


def test_refresh_of_nothing(spark, inputs, tmp_path):
    sinks = incremental.Sinks(spark, str(tmp_path))
    incremental.refresh(inputs, sinks, [])
    assert not _files(tmp_path)


def test_only_folders_of_the_window_are_read(spark, inputs, tmp_path, conf):
    conf("spark.sql.maxMetadataStringLength", "10000")
    sinks = incremental.Sinks(spark, str(tmp_path))
    incremental.refresh(inputs, sinks, MONTHS)
    df = sinks.read("payments", "1996-02", "1996-04")
    assert "PartitionFilters: [isnotnull(of" in plan(df)
    assert {f.split("of=")[1][:7] for f in df.inputFiles()} >= {"1996-02"}
    kept = df.agg(F.min("paid_on"), F.max("paid_on")).first()
    assert date(1996, 2, 1) <= kept[0] and kept[1] <= date(1996, 4, 30)
    scan = df._jdf.queryExecution().sparkPlan().toString()
    assert "DataFilters: []" in scan


@pytest.mark.parametrize("month, last", [("2023-01", 31), ("2024-02", 29), ("2023-12", 31), ("2023-04", 30)])
def test_month_bounds(month, last):
    first, end = incremental.month_bounds(month)
    assert (first.day, end.day, end.month) == (1, last, first.month)


def test_replaced_partitions(spark, tmp_path):
    path = str(tmp_path / "t")
    df = spark.createDataFrame([(1, "a"), (2, "b"), (3, "c")], "x int, k string")
    tables.replace_partitions(df, path, "k", ["a", "b"])
    assert rows(spark.read.parquet(path)) == [(1, "a"), (2, "b")]
    tables.replace_partitions(df.withColumn("x", F.col("x") * 10), path, "k", ["b", "c"])
    assert rows(spark.read.parquet(path)) == [(1, "a"), (20, "b"), (30, "c")]
    tables.replace_partitions(df.limit(0), path, "k", ["b"])
    assert rows(spark.read.parquet(path)) == [(1, "a"), (30, "c")]


def test_bucketed_orders_and_items_are_not_moved(spark, conf, tmp_path):
    conf("spark.sql.autoBroadcastJoinThreshold", "-1")
    conf("spark.sql.adaptive.enabled", "false")
    t = SampleTables(spark, "/root/testdata/sf0.001")
    orders = tables.write_bucketed(t.orders, "bucketed_orders", str(tmp_path / "o"), "id", 4)
    items = tables.write_bucketed(t.order_items, "bucketed_items", str(tmp_path / "i"), "order_fk", 4)
    try:
        out = profile.category_popularity(
            t.companies, orders, items, t.product_items, t.products, t.categories
        )
        text = plan(out)
        join = text[text.index("HashAggregate(keys=[company_ord_fk", text.index("productItem_fk")) :]
        lines = join.split("\n")
        at = next(k for k, line in enumerate(lines) if "SortMergeJoin [order_fk" in line)
        depth = len(lines[at]) - len(lines[at].lstrip(" :+-"))
        below = []
        for line in lines[at + 1 :]:
            if len(line) - len(line.lstrip(" :+-")) <= depth:
                break
            below.append(line)
        assert sum("FileScan" in x and "Bucketed: true" in x for x in below) == 2
        assert not any("Exchange" in x for x in below)
        assert rows(out) == rows(
            profile.category_popularity(
                t.companies, t.orders, t.order_items, t.product_items, t.products, t.categories
            )
        )
    finally:
        spark.sql("drop table bucketed_orders")
        spark.sql("drop table bucketed_items")
