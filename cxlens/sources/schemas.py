"""Explicit schemas of the nine source tables (CSV has no types of its own).

Column names follow the marketplace export; seller and geolocation columns
are not named by the reports, the ones below are this project's choice.
"""

from pyspark.sql.types import (DateType, DecimalType, DoubleType, IntegerType, StringType,
                               StructField, StructType, TimestampNTZType)

MONEY = DecimalType(18, 2)


def _s(*cols) -> StructType:
    return StructType([StructField(n, t, True) for n, t in cols])


SCHEMAS = {
    "customers": _s(("customer_id", StringType()), ("customer_unique_id", StringType()),
                    ("customer_state", StringType())),
    "orders": _s(("order_id", StringType()), ("customer_id", StringType()),
                 ("order_status", StringType()), ("purchase_ts", TimestampNTZType()),
                 ("approved_ts", TimestampNTZType()), ("delivered_carrier_ts", TimestampNTZType()),
                 ("delivered_customer_ts", TimestampNTZType()),
                 ("estimated_delivery_ts", TimestampNTZType())),
    "order_items": _s(("order_id", StringType()), ("order_item_id", IntegerType()),
                      ("product_id", StringType()), ("seller_id", StringType()),
                      ("price", MONEY), ("freight_value", MONEY)),
    "products": _s(("product_id", StringType()), ("category_id", StringType()),
                   ("weight_grams", IntegerType())),
    "product_categories": _s(("category_id", StringType()), ("category_name", StringType())),
    "sellers": _s(("seller_id", StringType()), ("seller_state", StringType()),
                  ("onboarded_date", DateType())),
    "payments": _s(("order_id", StringType()), ("payment_type", StringType()),
                   ("payment_installments", IntegerType()), ("payment_value", MONEY)),
    "reviews": _s(("review_id", StringType()), ("order_id", StringType()),
                  ("review_score", IntegerType()), ("review_title", StringType()),
                  ("review_message", StringType()), ("review_created_ts", TimestampNTZType()),
                  ("review_answered_ts", TimestampNTZType())),
    "geolocation": _s(("zip_prefix", StringType()), ("state", StringType()),
                      ("lat", DoubleType()), ("lng", DoubleType())),
}
