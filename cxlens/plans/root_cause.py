"""What drives complaints: root-cause mix of detractor reviews."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from cxlens.functions import pct, round_half
from cxlens.operators import share_of_total
from cxlens.plans.common import detractor, c, mean_money, money0, n_rows, sum_long
from cxlens.plans.registry import report


@report("rc_distribution", uses=["is_detractor", "root_cause"])
def rc_distribution(v: DataFrame) -> DataFrame:
    out = v.filter(detractor()).groupBy("root_cause").agg(n_rows("detractor_reviews"))
    return share_of_total(out, "detractor_reviews", "pct_of_detractors").orderBy(
        F.desc("detractor_reviews"))


@report("rc_by_category", uses=["is_detractor", "root_cause", "category_name"])
def rc_by_category(v: DataFrame) -> DataFrame:
    out = (v.filter(detractor() & c("category_name").isNotNull())
           .groupBy("category_name", "root_cause").agg(n_rows("detractor_reviews")))
    return share_of_total(out, "detractor_reviews", "pct_within_category",
                          within=["category_name"]).orderBy("category_name", F.desc("detractor_reviews"))


@report("rc_monthly_trend", uses=["is_detractor", "root_cause", "order_month"])
def rc_monthly_trend(v: DataFrame) -> DataFrame:
    out = v.filter(detractor()).groupBy("order_month", "root_cause").agg(n_rows("detractor_reviews"))
    return share_of_total(out, "detractor_reviews", "pct_of_month",
                          within=["order_month"]).orderBy("order_month", F.desc("detractor_reviews"))


@report("rc_response_rate", uses=["is_detractor", "root_cause", "has_seller_response"])
def rc_response_rate(v: DataFrame) -> DataFrame:
    out = v.filter(detractor()).groupBy("root_cause").agg(
        n_rows("detractor_reviews"), sum_long("has_seller_response", "seller_responded"))
    return (out.withColumn("response_rate_pct",
                           round_half(pct("seller_responded", "detractor_reviews"), 1))
            .orderBy(F.desc("response_rate_pct")))


@report("rc_gmv_at_risk", uses=["is_detractor", "root_cause", "order_gmv"])
def rc_gmv_at_risk(v: DataFrame) -> DataFrame:
    out = v.filter(detractor()).groupBy("root_cause").agg(
        n_rows("detractor_reviews"),
        money0(c("order_gmv"), "gmv_at_risk"),
        mean_money(c("order_gmv"), 2, "avg_order_value"),
        F.sum("order_gmv").alias("_gmv"))
    total = F.sum("_gmv").over(Window.partitionBy())
    return (out.withColumn("pct_of_total_gmv_at_risk", round_half(pct("_gmv", total), 1))
            .drop("_gmv").orderBy(F.desc("gmv_at_risk")))
