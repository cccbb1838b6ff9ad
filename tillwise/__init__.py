"""Merchant analytics for point-of-sale and mobile-order data, as Spark DataFrame operators."""
