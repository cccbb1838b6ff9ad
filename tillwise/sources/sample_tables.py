"""The input tables of the operators, derived from TPC-H-like parquet tables.

A supplier stands for a merchant with three locations, a customer for a user, an order's lines
at one supplier for one merchant order, and an order line for a POS ticket.  Even suppliers use
POS system A, odd ones B.  Return flag R marks the platform channel, N gives a missing note.
FIXTURES.md section 3 has the same mapping as SQL.
"""

from __future__ import annotations

from functools import cached_property

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tillwise.sources.shared import settle

POS_A, POS_B = "POS_A", "POS_B"

# The columns used, of the types they are stored with.
RAW_SCHEMAS = {
    "supplier": "s_suppkey bigint, s_name string, s_acctbal double",
    "orders": "o_orderkey bigint, o_custkey bigint, o_orderstatus string, "
    "o_orderdate timestamp_ntz",
    "lineitem": "l_orderkey bigint, l_partkey bigint, l_suppkey bigint, l_linenumber int, "
    "l_extendedprice double, l_returnflag string, l_linestatus string, l_shipdate timestamp_ntz",
    "part": "p_partkey bigint, p_name string, p_type string, p_retailprice double",
    "events": "event_id bigint, ts timestamp_ntz, user_id bigint",
}


def _key(order: str, number: str, scale: int) -> Column:
    return F.col(order) * scale + F.col(number)


class SampleTables:
    """Lazily derived tables over one folder of parquet files."""

    def __init__(self, spark: SparkSession, folder: str):
        self.spark, self.folder = spark, folder
        self._raw: dict[str, DataFrame] = {}

    def raw(self, name: str) -> DataFrame:
        if name not in self._raw:
            reader = self.spark.read.schema(RAW_SCHEMAS[name])
            self._raw[name] = reader.parquet(f"{self.folder}/{name}.parquet")
        return self._raw[name]

    @cached_property
    def companies(self) -> DataFrame:
        key, name = F.col("s_suppkey"), F.col("s_name")
        return self.raw("supplier").select(
            key.alias("id"),
            F.when(key % 25 == 7, F.concat(name, F.lit(" CHURN"))).otherwise(name).alias("name"),
            F.when(F.col("s_acctbal") < 0, 1).otherwise(0).alias("is_disabled"),
            F.when(key % 2 == 0, POS_A).otherwise(POS_B).alias("payment_integration"),
            (key + 5000).alias("payment_credentials_id"),
            F.concat(F.lit("M"), key).alias("pos_merchant_id"),
        )

    @cached_property
    def locations(self) -> DataFrame:
        key = F.col("s_suppkey")
        return (
            self.raw("supplier")
            .select(key, "s_name", F.explode(F.lit([0, 1, 2])).alias("k"))
            .select(
                (key * 10 + F.col("k")).alias("id"),
                F.concat("s_name", F.lit("/"), F.col("k")).alias("name"),
                F.when((F.col("k") == 2) & (key % 11 == 0), 1).otherwise(0).alias("is_deleted"),
                key.alias("company_id"),
            )
        )

    @cached_property
    def credentials(self) -> DataFrame:
        return self.companies.filter(F.col("payment_integration") == POS_A).select(
            F.col("payment_credentials_id").alias("id"),
            F.when(F.col("id") % 4 == 0, F.col("pos_merchant_id")).alias("merchant_id"),
        )

    @cached_property
    def orders(self) -> DataFrame:
        # Lines are summed before they meet the orders: fewer and narrower keys to group by.
        return (
            self.raw("lineitem")
            .groupBy("l_orderkey", "l_suppkey")
            .agg(F.sum("l_extendedprice").alias("calculated_total"))
            .join(
                self.raw("orders").select(
                    F.col("o_orderkey").alias("l_orderkey"),
                    "o_custkey",
                    "o_orderdate",
                    "o_orderstatus",
                ),
                "l_orderkey",
            )
            .select(
                _key("l_orderkey", "l_suppkey", 100000).alias("id"),
                F.col("o_custkey").alias("user_id_fk"),
                F.col("l_suppkey").alias("company_ord_fk"),
                (F.col("l_suppkey") * 10 + F.col("l_orderkey") % 3).alias("location_fk"),
                F.col("o_orderdate").alias("created_at"),
                F.when(F.col("o_orderstatus").isin("F", "P"), "COMPLETED")
                .otherwise("CANCELLED")
                .alias("orderStatus"),
                "calculated_total",
            )
        )

    @cached_property
    def stored_orders(self) -> DataFrame:
        """``orders`` as a table of its own, for plans that read it several times."""
        return settle(self.orders)

    @cached_property
    def timed_orders(self) -> DataFrame:
        return self.raw("events").select(
            F.col("event_id").alias("id"),
            F.col("user_id").alias("user_id_fk"),
            (F.col("user_id") % 10).alias("company_ord_fk"),
            F.col("ts").alias("created_at"),
        )

    @cached_property
    def order_items(self) -> DataFrame:
        return self.raw("lineitem").select(
            _key("l_orderkey", "l_suppkey", 100000).alias("order_fk"),
            F.col("l_partkey").alias("productItem_fk"),
        )

    @cached_property
    def product_items(self) -> DataFrame:
        return self.raw("part").select(
            F.col("p_partkey").alias("id"),
            F.col("p_partkey").alias("product_fk"),
            F.col("p_retailprice").alias("price"),
        )

    @cached_property
    def products(self) -> DataFrame:
        return self.raw("part").select(
            F.col("p_partkey").alias("id"),
            F.col("p_name").alias("name"),
            F.col("p_type").alias("category_fk"),
        )

    @cached_property
    def categories(self) -> DataFrame:
        kind = F.col("p_type")
        return self.raw("part").select(kind.alias("id"), kind.alias("name")).distinct()

    @cached_property
    def pos_a_locations(self) -> DataFrame:
        company = F.col("company_id")
        second = F.when((F.col("id") % 10 == 1) & (company % 20 == 0), 1).otherwise(0)
        ext_id = company + 5000 + second
        companies = self.companies.filter(F.col("payment_integration") == POS_A).select(
            F.col("id").alias("company_id"),
            F.col("pos_merchant_id").alias("merchant_id"),
            F.col("name").alias("merchant_name"),
        )
        return self.locations.join(companies, "company_id").select(
            "id",
            "merchant_id",
            F.col("name").alias("business_name"),
            "merchant_name",
            F.when(company % 3 == 0, ext_id.cast("string")).alias("ext_id"),
            F.when((company % 3 != 0) & (company % 10 != 8), ext_id).alias("ext_id__it"),
        )

    @cached_property
    def pos_a_payments(self) -> DataFrame:
        lines = self.raw("lineitem").filter(F.col("l_suppkey") % 2 == 0)
        buyers = self.raw("orders").select(F.col("o_orderkey").alias("l_orderkey"), "o_custkey")
        cents = F.round(F.col("l_extendedprice") * 100).cast("bigint")
        return lines.join(buyers, "l_orderkey").select(
            F.struct(
                _key("l_orderkey", "l_linenumber", 100).alias("id"),
                F.when(F.col("l_linestatus") == "F", "COMPLETED")
                .otherwise("FAILED")
                .alias("status"),
                (F.col("l_suppkey") * 10 + F.col("l_orderkey") % 3).alias("location_id"),
                F.col("l_shipdate").alias("created_at"),
                F.when(F.col("l_returnflag") == "R", "Platform order")
                .when(F.col("l_returnflag") == "A", "till")
                .alias("note"),
                F.col("o_custkey").alias("customer_id"),
                F.struct(cents.alias("amount")).alias("total_money"),
            ).alias("payment_details")
        )

    @cached_property
    def pos_b_orders(self) -> DataFrame:
        supplier = F.col("l_suppkey")
        place = supplier * 10 + F.col("l_orderkey") % 3
        names = self.companies.select(
            F.col("id").alias("l_suppkey"), F.col("name").alias("merchant_name")
        )
        return (
            self.raw("lineitem")
            .filter(supplier % 2 == 1)
            .join(names, "l_suppkey")
            .select(
                F.when(supplier % 3 == 0, place.cast("string")).alias("ext_location_id"),
                F.when(supplier % 3 != 0, place).alias("ext_location_id__it"),
                "merchant_name",
                F.struct(
                    (F.col("l_extendedprice") * 4).alias("checks_total_order_sum"),
                    F.col("l_shipdate").alias("estimatedfulfillmentdate"),
                ).alias("payment_details"),
            )
        )
