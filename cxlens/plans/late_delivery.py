"""What late delivery costs: detractor rates and GMV by lateness."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cxlens.functions import round_half
from cxlens.operators.shares import order_rank
from cxlens.operators import rate_table
from cxlens.plans.common import (delivered, detractor, reviewed, avg2, c, detractor_gmv,
                                 mean_money, money0, n_rows, pct_of, sum_long)
from cxlens.plans.order_view import DELIVERY_BUCKETS
from cxlens.plans.registry import report

def late() -> Column:
    return c("is_late") == 1

def on_time() -> Column:
    return c("is_late") == 0



@report("late_detractor_by_bucket",
        uses=["review_score", "delivery_bucket", "is_detractor", "is_promoter"])
def late_detractor_by_bucket(v: DataFrame) -> DataFrame:
    return (v.filter(reviewed()).groupBy("delivery_bucket").agg(
        n_rows("orders"), pct_of("is_detractor", "detractor_rate_pct"),
        pct_of("is_promoter", "promoter_rate_pct"), avg2("review_score", "avg_review_score"))
        .orderBy(order_rank("delivery_bucket", DELIVERY_BUCKETS[:4])))


@report("late_gmv_by_bucket",
        uses=["review_score", "delivery_bucket", "is_detractor", "order_gmv"])
def late_gmv_by_bucket(v: DataFrame) -> DataFrame:
    return (v.filter(reviewed() & (c("delivery_bucket") != "not_delivered"))
            .groupBy("delivery_bucket").agg(
                n_rows("total_orders"), sum_long("is_detractor", "detractor_orders"),
                detractor_gmv("gmv_at_risk"),
                mean_money(F.when(detractor(), c("order_gmv")), 2, "avg_gmv_at_risk_per_order"))
            .orderBy(order_rank("delivery_bucket", DELIVERY_BUCKETS[:4])))


@report("late_monthly_trend", uses=["review_score", "is_late", "order_month"])
def late_monthly_trend(v: DataFrame) -> DataFrame:
    return (v.filter(reviewed() & delivered()).groupBy("order_month").agg(
        n_rows("delivered_orders"), sum_long("is_late", "late_orders"),
        pct_of("is_late", "late_rate_pct"),
        round_half(F.avg(F.when(late(), c("review_score"))), 2).alias("avg_score_late"),
        round_half(F.avg(F.when(on_time(), c("review_score"))), 2).alias("avg_score_on_time"))
        .orderBy("order_month"))


@report("late_by_state",
        uses=["review_score", "is_late", "customer_state", "is_detractor", "order_gmv"])
def late_by_state(v: DataFrame, min_rows: int = 200) -> DataFrame:
    return rate_table(v.filter(reviewed() & delivered()), ["customer_state"], min_rows, "delivered_orders", [
        sum_long("is_late", "late_orders"),
        pct_of("is_late", "late_rate_pct"), pct_of("is_detractor", "detractor_rate_pct"),
        detractor_gmv("gmv_at_risk")]).orderBy(F.desc("late_rate_pct"))


@report("late_headline",
        uses=["review_score", "is_late", "is_detractor", "order_gmv", "late_days"])
def late_headline(v: DataFrame) -> DataFrame:
    return v.filter(reviewed()).agg(
        round_half(F.avg(F.when(on_time(), c("is_detractor"))) * 100, 1).alias("on_time_detractor_pct"),
        round_half(F.avg(F.when(late(), c("is_detractor"))) * 100, 1).alias("late_detractor_pct"),
        money0(F.when(late() & detractor(), c("order_gmv")).otherwise(F.lit(0)), "late_detractor_gmv"),
        money0(F.when(late(), c("order_gmv")).otherwise(F.lit(0)), "total_late_gmv"),
        round_half(F.avg(F.when(late(), c("late_days"))), 1).alias("avg_days_late"))
