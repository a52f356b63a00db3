"""Daily states of the orders, and the reports that can be merged from them.

``order_states`` holds, per purchase day and order status, the first and last purchase and the sets of orders and
of reviewed orders; ``late_states`` holds, per purchase day, the sums behind the lateness trend. The reports
below give the rows of ``dq_date_coverage``, ``dq_review_coverage`` and ``late_monthly_trend`` without the tables.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cxlens.functions import month_start, pct, ratio, round_half
from cxlens.operators.states import count_ids, id_sets
from cxlens.plans.common import c, delivered, n_rows, reviewed, sum_long
from cxlens.plans.order_view import order_analysis
from cxlens.sources.tables import Tables


def order_states(t: Tables) -> DataFrame:
    """(day, order_status, bucket) with the bitmaps ``orders`` and ``reviewed``; bucket -1 has ``lo`` and ``hi``, the first and last purchase."""
    orders = t.orders.select("order_id", "order_status", "purchase_ts", F.to_date("purchase_ts").alias("day"))
    seen = t.reviews.filter(c("order_id").isNotNull()).groupBy("order_id").agg(F.lit(True).alias("_reviewed"))
    keys = ["day", "order_status"]
    sets = id_sets(orders.join(seen, "order_id", "left"), keys, "order_id", {"orders": F.lit(True), "reviewed": c("_reviewed")})
    spans = orders.groupBy(*keys).agg(F.min("purchase_ts").alias("lo"), F.max("purchase_ts").alias("hi")).withColumn("bucket", F.lit(-1).cast("bigint"))
    return sets.unionByName(spans, allowMissingColumns=True)


def late_states(t: Tables) -> DataFrame:
    """Per purchase day: reviewed and delivered rows, how many were late, and the sums of the scores of late and of other rows."""
    v = order_analysis(t, ["purchase_ts", "review_score", "is_late"]).filter(reviewed() & delivered())
    late = c("is_late") == 1
    return v.groupBy(F.to_date("purchase_ts").alias("day")).agg(
        n_rows("n"), F.sum("is_late").alias("late"),
        F.sum(F.when(late, c("review_score"))).alias("score_late"), F.sum(F.when(~late, c("review_score"))).alias("score_on_time"))


def date_coverage(states: DataFrame) -> DataFrame:
    """``dq_date_coverage`` from ``order_states``."""
    days = states.filter(c("bucket") == -1).groupBy("day").agg(F.min("lo").alias("lo"), F.max("hi").alias("hi"))
    months = F.count_distinct(F.date_trunc("month", c("day")))
    return days.agg(F.min("lo").cast("date").alias("earliest_order"), F.max("hi").cast("date").alias("latest_order"),
                    F.count("day").alias("active_days"), months.alias("active_months"))


def review_coverage(states: DataFrame) -> DataFrame:
    """``dq_review_coverage`` from ``order_states``."""
    known = states.filter(c("bucket") == -1).select("order_status").distinct()
    counts = count_ids(states.filter(c("bucket") >= 0), ["order_status"], ["orders", "reviewed"]).withColumnRenamed("order_status", "_status")
    out = known.join(counts, c("order_status").eqNullSafe(c("_status")), "left").select(
        "order_status", *[F.coalesce(n, F.lit(0)).cast("bigint").alias(n) for n in ("orders", "reviewed")])
    return out.withColumn("review_rate_pct", round_half(pct("reviewed", "orders"), 1)).orderBy(F.desc("orders"))


def late_trend(states: DataFrame) -> DataFrame:
    """``late_monthly_trend`` from ``late_states``."""
    month = month_start(c("day").cast("timestamp_ntz"))
    sums = states.groupBy(month.alias("order_month")).agg(
        sum_long("n", "delivered_orders"), sum_long("late", "late_orders"), F.sum("score_late").alias("_late"), F.sum("score_on_time").alias("_on_time"))
    on_time = c("delivered_orders") - c("late_orders")
    return sums.select("order_month", "delivered_orders", "late_orders", round_half(ratio("late_orders", "delivered_orders") * 100, 1).alias("late_rate_pct"),
                       round_half(ratio("_late", "late_orders"), 2).alias("avg_score_late"),
                       round_half(F.col("_on_time").cast("double") / F.nullif(on_time.cast("double"), F.lit(0.0)), 2).alias("avg_score_on_time")).orderBy("order_month")
