import os
import sys

import pytest
from pyspark.sql import SparkSession
from pyspark.sql import functions as F

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))


@pytest.fixture(scope="session")
def spark():
    session = (
        SparkSession.builder.master("local[8]")
        .config("spark.sql.shuffle.partitions", "8")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.driver.memory", "6g")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .getOrCreate()
    )
    session.sparkContext.setLogLevel("ERROR")
    yield session
    session.stop()


@pytest.fixture
def conf(spark):
    """Set session options for one test."""
    before = {}

    def put(key, value):
        before.setdefault(key, spark.conf.get(key, None))
        spark.conf.set(key, value)

    yield put
    for key, value in before.items():
        spark.conf.unset(key) if value is None else spark.conf.set(key, value)


def rows(df, *columns):
    """Rows as sorted tuples; NULLs first."""
    out = [tuple(r) for r in (df.select(*columns) if columns else df).collect()]
    return sorted(out, key=lambda r: [(v is not None, v) for v in r])


def plan(df):
    return df._jdf.queryExecution().toString().split("== Physical Plan ==")[1]


def make_payments(spark, n):
    """Payments of January to June 2023, a third of them at location 0."""
    i = F.col("id")
    note = F.when(i % 5 == 0, "Platform order").when(i % 5 == 1, "till")
    return spark.range(n).select(
        F.struct(
            i.alias("id"),
            F.when(i % 11 == 0, "FAILED").otherwise("COMPLETED").alias("status"),
            F.when(i % 3 == 0, 0).otherwise(i % 20).cast("long").alias("location_id"),
            F.expr("timestamp_ntz'2023-01-01 08:00:00' + make_dt_interval(int(id % 180))").alias(
                "created_at"
            ),
            note.alias("note"),
            F.when(i % 7 > 0, i % 400).alias("customer_id"),
            F.struct((i % 90 * 10).alias("amount")).alias("total_money"),
        ).alias("payment_details")
    )
