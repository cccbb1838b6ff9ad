"""Numbering in slices gives what one window gives."""

import random

import pytest
from pyspark.sql import functions as F

from tests.conftest import plan
from tillwise.functions import ranking
from tillwise.functions.ranking import ntile_of, ntiles, number_rows
from tillwise.sources.shared import settle


def _frame(spark, n, seed, hot=0.4):
    rng = random.Random(seed)
    data = []
    for i in range(n):
        a = None if rng.random() < 0.1 else (7 if rng.random() < hot else rng.randint(0, 50))
        b = None if rng.random() < 0.1 else rng.choice([0.5, 1.5, float(rng.randint(0, 9))])
        data.append((f"m{i:05d}", a, b))
    rng.shuffle(data)
    return settle(spark.createDataFrame(data, "name string, a int, b double"))


ORDERS = {
    "up": [("a", "asc"), ("b", "desc"), ("name", "asc")],
    "down": [("a", "desc"), ("name", "desc")],
    "other": [("b", "asc"), ("name", "asc")],
}


def _one_window(df):
    from pyspark.sql import Window as W

    from tillwise.functions.ranking import _sorting

    for name, keys in ORDERS.items():
        df = df.withColumn(name, F.row_number().over(W.orderBy(*_sorting(keys))))
    return df


@pytest.mark.parametrize("n", [0, 1, 3, 500])
@pytest.mark.parametrize("apart", [True, False])
def test_numbers_equal_one_window(spark, conf, n, apart):
    conf("spark.sql.adaptive.coalescePartitions.enabled", str(not apart).lower())
    df = _frame(spark, n, seed=n)
    numbered, total = number_rows(df, ORDERS)
    assert total == n
    assert sorted(numbered.collect()) == sorted(_one_window(df).collect())


def test_hot_value_is_split_over_partitions(spark, conf):
    """Nine tenths of the rows share one value; the name splits them."""
    conf("spark.sql.adaptive.coalescePartitions.enabled", "false")
    df = _frame(spark, 2000, seed=5, hot=0.9)
    numbered, _ = number_rows(df, {"up": ORDERS["up"]})
    assert "hashpartitioning(__part_up" in plan(numbered)
    numbers = [r["up"] for r in numbered.orderBy("up").collect()]
    assert numbers == list(range(1, 2001))


@pytest.mark.parametrize("n", [1, 2, 3, 4, 5, 7, 8, 39])
@pytest.mark.parametrize("buckets", [1, 2, 3, 4, 7])
def test_ntile(spark, n, buckets):
    df = spark.range(1, n + 1).withColumn("got", ntile_of(F.col("id"), n, buckets))
    got = [r["got"] for r in df.orderBy("id").collect()]
    want = [
        r["w"]
        for r in df.selectExpr("id", f"ntile({buckets}) over (order by id) as w")
        .orderBy("id")
        .collect()
    ]
    assert got == want


TILE_ORDERS = ORDERS | {"by_text": [("name", "desc")]}


@pytest.mark.parametrize("n", [0, 1, 3, 4, 7, 500])
@pytest.mark.parametrize("apart", [True, False])
@pytest.mark.parametrize("buckets", [1, 4, 9])
def test_ntiles_of_several_orders_equal_windows(spark, conf, n, apart, buckets):
    from pyspark.sql import Window as W

    from tillwise.functions.ranking import _sorting

    conf("spark.sql.adaptive.coalescePartitions.enabled", str(not apart).lower())
    df = _frame(spark, n, seed=n)
    want = df
    for name, keys in TILE_ORDERS.items():
        want = want.withColumn(name, F.ntile(buckets).over(W.orderBy(*_sorting(keys))))
    assert sorted(map(repr, ntiles(df, TILE_ORDERS, buckets).collect())) == sorted(map(repr, want.collect()))


def test_ntiles_store_one_table_and_join_nothing(spark, monkeypatch):
    df = _frame(spark, 200, seed=1)
    stored = []
    monkeypatch.setattr(ranking, "settle", lambda x: stored.append(x) or settle(x))
    out = ntiles(df, TILE_ORDERS, 4)
    assert len(stored) == 1
    assert "Join" not in plan(out) and "Exchange" not in plan(out)
