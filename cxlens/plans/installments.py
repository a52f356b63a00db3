"""Do installment terms go with complaints: rates by installment bucket."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cxlens.functions import round_half
from cxlens.operators.shares import order_rank
from cxlens.operators import rate_table
from cxlens.plans.common import (delivered, detractor, reviewed, avg2, c, detractor_gmv,
                                 mean_money, money0, n_rows, pct_of, sum_long)
from cxlens.plans.order_view import INSTALLMENT_BUCKETS
from cxlens.plans.registry import report

def six_plus() -> Column:
    return c("installment_bucket") == "6_plus_installments"

def single_pay() -> Column:
    return c("installment_bucket") == "1_installment"


_USES = ["review_score", "installment_bucket", "is_detractor", "is_promoter", "order_gmv"]


def _share_6plus():
    return F.avg(F.when(six_plus(), F.lit(1.0)).otherwise(F.lit(0.0))) * 100


@report("inst_by_bucket", uses=_USES)
def inst_by_bucket(v: DataFrame) -> DataFrame:
    return (v.filter(reviewed() & c("installment_bucket").isNotNull())
            .groupBy("installment_bucket").agg(
                n_rows("orders"), pct_of("is_detractor", "detractor_rate_pct"),
                pct_of("is_promoter", "promoter_rate_pct"), avg2("review_score", "avg_review_score"),
                mean_money(c("order_gmv"), 2, "avg_order_gmv"), detractor_gmv("detractor_gmv"))
            .orderBy(order_rank("installment_bucket", INSTALLMENT_BUCKETS)))


@report("inst_by_category", uses=_USES + ["category_name", "max_installments"])
def inst_by_category(v: DataFrame, min_rows: int = 200) -> DataFrame:
    return rate_table(v.filter(reviewed() & c("category_name").isNotNull()), ["category_name"], min_rows, "orders", [
        round_half(F.avg("max_installments"), 1).alias("avg_installments"),
        round_half(_share_6plus(), 1).alias("pct_6plus_installments"),
        pct_of("is_detractor", "detractor_rate_pct"),
        mean_money(c("order_gmv"), 2, "avg_order_gmv")]).orderBy(F.desc("pct_6plus_installments"))


@report("inst_late_combined", uses=_USES + ["is_late"])
def inst_late_combined(v: DataFrame) -> DataFrame:
    status = F.when(c("is_late") == 1, "late").otherwise("on_time")
    return (v.filter(reviewed() & c("installment_bucket").isNotNull() & delivered())
            .groupBy("installment_bucket", status.alias("delivery_status")).agg(
                n_rows("orders"), pct_of("is_detractor", "detractor_rate_pct"),
                avg2("review_score", "avg_review_score"), detractor_gmv("detractor_gmv"))
            .orderBy(order_rank("installment_bucket", INSTALLMENT_BUCKETS), "delivery_status"))


@report("inst_monthly_trend", uses=_USES + ["order_month", "max_installments"])
def inst_monthly_trend(v: DataFrame) -> DataFrame:
    return (v.filter(reviewed()).groupBy("order_month").agg(
        n_rows("total_orders"), round_half(F.avg("max_installments"), 2).alias("avg_installments"),
        sum_long(F.when(six_plus(), 1).otherwise(0), "orders_6plus"),
        round_half(_share_6plus(), 1).alias("pct_6plus"),
        round_half(F.avg(F.when(six_plus(), c("is_detractor"))) * 100, 1).alias("detractor_rate_6plus"))
        .orderBy("order_month"))


@report("inst_headline", uses=_USES)
def inst_headline(v: DataFrame) -> DataFrame:
    return v.filter(reviewed()).agg(
        round_half(F.avg(F.when(single_pay(), c("is_detractor"))) * 100, 1).alias("single_pay_detractor_pct"),
        round_half(F.avg(F.when(six_plus(), c("is_detractor"))) * 100, 1).alias("high_install_detractor_pct"),
        money0(F.when(six_plus() & detractor(), c("order_gmv")).otherwise(F.lit(0)),
               "high_install_detractor_gmv"),
        F.count(F.when(six_plus(), 1)).alias("high_install_orders"),
        mean_money(F.when(six_plus(), c("order_gmv")), 2, "avg_high_install_order_value"))
