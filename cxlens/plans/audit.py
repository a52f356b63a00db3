"""Sanity checks and the data-quality audit over the nine tables."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cxlens.functions import pct, round_half, round_money
from cxlens.operators import fk_audit, fk_orphans, null_audit, quantile_rows, row_counts, running_share, share_of_total
from cxlens.plans.order_view import VIEW_COLUMNS
from cxlens.plans.common import c
from cxlens.plans.registry import report
from cxlens.sources.tables import TABLE_NAMES, Tables


@report("sanity_row_counts")
def sanity_row_counts(t: Tables) -> DataFrame:
    return row_counts(t, TABLE_NAMES, "tbl", "rows")


@report("dq_row_counts")
def dq_row_counts(t: Tables) -> DataFrame:
    return row_counts(t, TABLE_NAMES, "table_name", "row_count").orderBy(F.desc("row_count"))


def _order_days(t: Tables) -> DataFrame:
    # Distinct purchase days first (a small table), then the day/month counts.
    return (t.orders.groupBy(F.to_date("purchase_ts").alias("d"))
            .agg(F.min("purchase_ts").alias("lo"), F.max("purchase_ts").alias("hi")))


@report("sanity_date_range")
def sanity_date_range(t: Tables) -> DataFrame:
    return _order_days(t).agg(F.min("lo").alias("earliest_order"),
                              F.max("hi").alias("latest_order"),
                              F.count("d").alias("active_days"))


@report("dq_date_coverage")
def dq_date_coverage(t: Tables) -> DataFrame:
    return _order_days(t).agg(
        F.min("lo").cast("date").alias("earliest_order"),
        F.max("hi").cast("date").alias("latest_order"),
        F.count("d").alias("active_days"),
        F.count_distinct(F.date_trunc("month", F.col("d"))).alias("active_months"))


@report("sanity_orphan_items")
def sanity_orphan_items(t: Tables) -> DataFrame:
    return fk_orphans(t.order_items, "order_id", t.orders, "order_id", "orphaned_items")


@report("dq_null_orders")
def dq_null_orders(t: Tables) -> DataFrame:
    c = F.col
    return (null_audit(t.orders, "total_orders", {
        "null_delivered_ts": c("delivered_customer_ts").isNull(),
        "null_estimated_ts": c("estimated_delivery_ts").isNull(),
        "null_approved_ts": c("approved_ts").isNull(),
        "null_customer_id": c("customer_id").isNull(),
        "null_status": c("order_status").isNull(),
    }).withColumn("pct_null_delivered", round_half(pct("null_delivered_ts", "total_orders"), 1)))


@report("dq_null_reviews")
def dq_null_reviews(t: Tables) -> DataFrame:
    c = F.col
    return (null_audit(t.reviews, "total_reviews", {
        "null_score": c("review_score").isNull(),
        "null_message": c("review_message").isNull(),
        "null_answered": c("review_answered_ts").isNull(),
    }).withColumn("pct_unanswered", round_half(pct("null_answered", "total_reviews"), 1)))


@report("dq_invalid_items")
def dq_invalid_items(t: Tables) -> DataFrame:
    c = F.col
    return null_audit(t.order_items, "total_items", {
        "null_seller": c("seller_id").isNull(),
        "null_product": c("product_id").isNull(),
        "invalid_price": c("price").isNull() | (c("price") <= 0),
        "invalid_freight": c("freight_value").isNull() | (c("freight_value") < 0),
    })


@report("dq_status_distribution")
def dq_status_distribution(t: Tables) -> DataFrame:
    counts = t.orders.groupBy("order_status").agg(F.count(F.lit(1)).alias("orders"))
    return share_of_total(counts, "orders", "pct_of_total").orderBy(F.desc("orders"))


@report("dq_score_distribution")
def dq_score_distribution(t: Tables) -> DataFrame:
    counts = t.reviews.groupBy("review_score").agg(F.count(F.lit(1)).alias("reviews"))
    out = share_of_total(counts, "reviews", "pct_of_total")
    return (running_share(out, "reviews", "review_score", "cumulative_pct")
            .orderBy(F.col("review_score").asc_nulls_last()))


# Relationship labels of the foreign-key audit, in report order.
FK_EDGES = [
    ("order_items → orders", "order_items", "order_id", "orders", "order_id"),
    ("reviews → orders", "reviews", "order_id", "orders", "order_id"),
    ("order_items → products", "order_items", "product_id", "products", "product_id"),
    ("order_items → sellers", "order_items", "seller_id", "sellers", "seller_id"),
    ("payments → orders", "payments", "order_id", "orders", "order_id"),
]


@report("dq_fk_integrity")
def dq_fk_integrity(t: Tables) -> DataFrame:
    return fk_audit(t, FK_EDGES, "relationship", "orphaned_records")


@report("dq_price_sanity")
def dq_price_sanity(t: Tables) -> DataFrame:
    price, total = F.col("price"), F.sum("price").cast("double")
    stats = t.order_items.agg(
        F.min(price).cast("double").alias("min_price"), F.max(price).cast("double").alias("max_price"),
        round_half(total / F.count(price), 2).alias("avg_price"), total.alias("total_gmv"), F.count(F.lit(1)).alias("total_items"))
    # The median is the midpoint of two prices, in double, and then rounded.
    median = quantile_rows(t.order_items, price, 0.5, out="median")
    return stats.crossJoin(F.broadcast(median)).select("min_price", "max_price", "avg_price",
                                                       round_half(F.col("median"), 2).alias("median_price"), "total_gmv", "total_items")


@report("dq_review_coverage")
def dq_review_coverage(t: Tables) -> DataFrame:
    # Distinct reviewed order ids, then one (order, status) row each; the
    # group-by on (order_id, status) reuses the join's order_id partitioning.
    reviewed = t.reviews.groupBy("order_id").agg(F.max(F.lit(1)).alias("has_review"))
    per_order = (t.orders.select("order_id", "order_status")
                 .join(reviewed, "order_id", "left")
                 .groupBy("order_id", "order_status")
                 .agg(F.max("has_review").alias("has_review")))
    out = per_order.groupBy("order_status").agg(
        F.count("order_id").alias("orders"),
        F.count(F.when(F.col("order_id").isNotNull(), F.col("has_review"))).alias("reviewed"))
    return (out.withColumn("review_rate_pct", round_half(pct("reviewed", "orders"), 1))
            .orderBy(F.desc("orders")))


@report("order_analysis", uses=VIEW_COLUMNS)
def order_analysis_report(v: DataFrame) -> DataFrame:
    return v.select(*VIEW_COLUMNS)
