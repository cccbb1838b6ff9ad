"""Readers, writers and the shared folder."""

import os
from datetime import datetime

import pytest
from pyspark.sql import functions as F

from tests.conftest import make_payments, plan, rows
from tillwise.sources import schemas, shared, tables


def test_conform_renames_casts_and_rebuilds_structs(spark):
    df = spark.createDataFrame(
        [("7", "x", (1, "A", (5,)))],
        "oid string, extra string, d struct<id int, st string, money struct<cents int>>",
    )
    out = tables.conform(
        df,
        schemas.StructType([*schemas.CREDENTIALS.fields]),
        {"id": "oid", "merchant_id": "extra"},
    )
    assert out.schema == schemas.CREDENTIALS
    assert rows(out) == [(7, "x")]
    nested = tables.conform(
        df.select("d"),
        schemas.StructType(
            [
                schemas.StructField(
                    "details",
                    schemas._table(id=schemas.LONG, total=schemas._table(amount=schemas.LONG)),
                )
            ]
        ),
        {"details.id": "d.id", "details.total.amount": "d.money.cents"},
    )
    assert nested.first().asDict(recursive=True) == {"details": {"id": 1, "total": {"amount": 5}}}
    with pytest.raises(ValueError, match="nowhere"):
        tables.conform(df, schemas.CREDENTIALS, {"id": "nowhere", "merchant_id": "extra"})


def test_round_trips(spark, tmp_path):
    made = make_payments(spark, 50)
    folder = str(tmp_path / "payments")
    by_month = made.withColumn(
        "month", F.date_format(F.col("payment_details.created_at").cast("date"), "yyyy-MM")
    )
    tables.write_parquet(by_month, folder, partition_by="month")
    back = tables.read_parquet(spark, folder, schemas.POS_A_PAYMENTS)
    assert rows(back, "payment_details.id", "payment_details.created_at") == rows(
        made, "payment_details.id", "payment_details.created_at"
    )
    made.createOrReplaceTempView("payments_for_test")
    assert tables.read_catalog(spark, "payments_for_test", schemas.POS_A_PAYMENTS).count() == 50


def test_csv_by_column_name(spark, tmp_path):
    folder = str(tmp_path / "rfm")
    tables.write_csv(
        spark.createDataFrame(
            [("a", 0.25, 1, 2, 3)], "merchant_name string, share double, r int, f int, m int"
        ),
        folder,
    )
    names = {
        "r_quartile": "r",
        "f_quartile": "f",
        "m_quartile": "m",
        "overall_share_per_merchant": "share",
    }
    out = tables.read_csv(spark, folder, schemas.RFM, names)
    assert out.schema == schemas.RFM
    assert rows(out) == [(1, 2, 3, 0.25)]


def test_settle_goes_to_the_folder_of_the_session(spark):
    df = spark.range(10).select("id", F.lit(datetime(2023, 1, 1)).cast("timestamp_ntz").alias("t"))
    stored = shared.settle(df)
    (path,) = {p.rsplit("/", 1)[0] for p in stored.inputFiles()}
    assert shared.shared_folder(spark) in path
    named = spark.conf.get("spark.checkpoint.dir", None)
    if named:
        assert shared.shared_folder(spark) == named.rstrip("/")
    assert stored.dtypes == df.dtypes
    assert rows(stored) == rows(df)


def test_sized_side_is_broadcast_only_within_bounds(spark, conf, monkeypatch):
    small = spark.range(100).withColumnRenamed("id", "k")
    unknown = small.join(spark.range(100).withColumnRenamed("id", "k"), "k")
    facts = spark.range(1000).withColumnRenamed("id", "k")
    conf("spark.sql.autoBroadcastJoinThreshold", "200")
    side = shared.sized(unknown)
    assert "FileScan" in plan(side)
    assert "BroadcastHashJoin" in plan(facts.join(side, "k"))
    monkeypatch.setattr(shared, "BROADCAST_ROWS", 99)
    assert "SortMergeJoin" in plan(facts.join(shared.sized(unknown), "k"))
    monkeypatch.setattr(shared, "BROADCAST_ROWS", 100)
    monkeypatch.setattr(shared, "BROADCAST_BYTES", 300)
    assert "SortMergeJoin" in plan(facts.join(shared.sized(unknown), "k"))
    conf("spark.sql.autoBroadcastJoinThreshold", "-1")
    monkeypatch.setattr(shared, "BROADCAST_BYTES", 10**9)
    assert "SortMergeJoin" in plan(facts.join(shared.sized(unknown), "k"))
    conf("spark.sql.autoBroadcastJoinThreshold", "10000000")
    assert shared.sized(small) is small


def test_reusable_stores_only_what_costs_to_repeat(spark, conf):
    stored = shared.settle(spark.range(1000).selectExpr("id", "id % 7 as k"))
    conf("spark.sql.autoBroadcastJoinThreshold", "100")
    scan = stored.filter("k > 1").select("k")
    assert shared.reusable(scan) is scan
    counted = stored.groupBy("k").count()
    assert "Aggregate" not in plan(shared.reusable(counted))
    assert rows(shared.reusable(counted)) == rows(counted)


def test_release_removes_what_was_stored_and_nothing_else(spark, tmp_path):
    shared.release(spark)
    other = str(tmp_path / "other")
    spark.range(3).write.parquet(other)
    stored = shared.settle(spark.range(5))
    assert stored.count() == 5
    path = stored.inputFiles()[0].removeprefix("file://").rsplit("/", 1)[0]
    assert os.path.exists(path)
    assert shared.release(spark) == 1 and shared.release(spark) == 0
    assert not os.path.exists(path) and spark.read.parquet(other).count() == 3


def test_only_plain_local_masters_get_a_folder_of_their_own(monkeypatch):
    class Session:
        def __init__(self, master):
            self.conf = {"spark.master": master, "spark.app.id": "a"}

    monkeypatch.setattr(shared.tempfile, "mkdtemp", lambda prefix: "/made")
    monkeypatch.setattr(shared.atexit, "register", lambda *a, **b: None)
    monkeypatch.setattr(shared, "_own_folder", {})
    for master in ("local", "local[4]", "local[*]"):
        assert shared.shared_folder(Session(master)) == "/made"
    for master in ("local-cluster[2,1,512]", "yarn", "spark://local:7077"):
        with pytest.raises(RuntimeError):
            shared.shared_folder(Session(master))


def test_some_stored_tables_can_be_released(spark):
    import os

    from tillwise.sources import shared

    first, second = (shared.settle(spark.range(n)) for n in (3, 5))
    mine = shared.stored_tables(spark)[-2:]
    assert shared.release(spark, mine[:1]) == 1
    assert not os.path.exists(mine[0].removeprefix("file:")) and second.count() == 5
    assert mine[0] not in shared.stored_tables(spark) and mine[1] in shared.stored_tables(spark)
    assert shared.release(spark, mine[:1]) == 0
