"""Input tables of the operators.  Schemas are declared, never inferred.

Operators only compare keys with each other, so where a system's ids are text, declare a schema of
your own with text ids and read with that.
"""

from __future__ import annotations

from pyspark.sql.types import (
    DoubleType,
    IntegerType,
    LongType,
    StringType,
    StructField,
    StructType,
    TimestampNTZType,
)


def _table(**columns) -> StructType:
    return StructType([StructField(name, kind, True) for name, kind in columns.items()])


LONG, INT, DOUBLE, TEXT, TIME = (
    LongType(),
    IntegerType(),
    DoubleType(),
    StringType(),
    TimestampNTZType(),
)

ORDERS = _table(
    id=LONG,
    user_id_fk=LONG,
    company_ord_fk=LONG,
    location_fk=LONG,
    created_at=TIME,
    orderStatus=TEXT,
    calculated_total=DOUBLE,
)
COMPANIES = _table(
    id=LONG,
    name=TEXT,
    is_disabled=INT,
    payment_integration=TEXT,
    payment_credentials_id=LONG,
    pos_merchant_id=TEXT,
)
LOCATIONS = _table(id=LONG, name=TEXT, is_deleted=INT)
CREDENTIALS = _table(id=LONG, merchant_id=TEXT)
ORDER_ITEMS = _table(order_fk=LONG, productItem_fk=LONG)
PRODUCT_ITEMS = _table(id=LONG, product_fk=LONG, price=DOUBLE)
PRODUCTS = _table(id=LONG, name=TEXT, category_fk=TEXT)
CATEGORIES = _table(id=TEXT, name=TEXT)
POS_A_LOCATIONS = _table(
    id=LONG,
    merchant_id=TEXT,
    business_name=TEXT,
    merchant_name=TEXT,
    ext_id=TEXT,
    ext_id__it=LONG,
)
POS_A_PAYMENTS = _table(
    payment_details=_table(
        id=LONG,
        status=TEXT,
        location_id=LONG,
        created_at=TIME,
        note=TEXT,
        customer_id=LONG,
        total_money=_table(amount=LONG),
    )
)
POS_B_ORDERS = _table(
    ext_location_id=TEXT,
    ext_location_id__it=LONG,
    merchant_name=TEXT,
    payment_details=_table(checks_total_order_sum=DOUBLE, estimatedfulfillmentdate=TIME),
)
RFM = _table(
    r_quartile=INT,
    f_quartile=INT,
    m_quartile=INT,
    overall_share_per_merchant=DOUBLE,
)
