"""Who complains again: per-customer complaint counts, returns and sequences.

Per-customer rollups are partially aggregated group-bys; the first
complaint and the next order after it are min-aggregates plus one
customer-level join; the complaint sequence keeps only the first three
complaints per customer, which Spark pre-filters per map task.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cxlens.functions import day_diff, flag, pct, round_half, round_money, tier
from cxlens.operators import event_sequence, first_event_then_next, share_of_total
from cxlens.plans.common import c, detractor, mean_money, n_rows, reviewed, sum_long
from cxlens.plans.registry import report

_USES = ["review_score", "customer_unique_id", "is_detractor", "is_promoter", "order_gmv",
         "purchase_ts"]


def customer_complaints(v: DataFrame) -> DataFrame:
    return v.filter(reviewed()).groupBy("customer_unique_id").agg(
        n_rows("total_orders"), sum_long("is_detractor", "complaint_count"),
        sum_long("is_promoter", "promoter_count"),
        F.round(F.sum("order_gmv"), 2).alias("lifetime_gmv"),
        F.min("purchase_ts").alias("first_order"), F.max("purchase_ts").alias("last_order"))


@report("rpt_frequency", uses=_USES)
def rpt_frequency(v: DataFrame) -> DataFrame:
    out = customer_complaints(v).groupBy("complaint_count").agg(
        n_rows("customers"), mean_money(c("lifetime_gmv"), 2, "avg_lifetime_gmv"),
        round_money(F.sum("lifetime_gmv"), 0).alias("total_gmv"))
    return (share_of_total(out, "customers", "pct_of_customers")
            .select("complaint_count", "customers", "pct_of_customers", "avg_lifetime_gmv",
                    "total_gmv")
            .orderBy(F.col("complaint_count").asc_nulls_last()))


# Complaint tiers by number of detractor reviews.
def complaint_tier(n):
    return tier(n, [("0_complaints", n == 0), ("1_complaint", n == 1),
                    ("2_complaints", n == 2), ("3_plus_complaints", None)])


@report("rpt_profile", uses=_USES)
def rpt_profile(v: DataFrame) -> DataFrame:
    cc = customer_complaints(v).withColumn("complaint_tier", complaint_tier(c("complaint_count")))
    return (cc.groupBy("complaint_tier").agg(
        n_rows("customers"),
        round_half(F.avg("total_orders"), 2).alias("avg_orders_per_customer"),
        mean_money(c("lifetime_gmv"), 2, "avg_lifetime_gmv"),
        round_money(F.sum("lifetime_gmv"), 0).alias("total_gmv"),
        round_half(F.avg(day_diff("first_order", "last_order")), 0).alias("avg_days_as_customer"))
        .orderBy("complaint_tier"))


@report("rpt_return_after_complaint", uses=_USES)
def rpt_return_after_complaint(v: DataFrame) -> DataFrame:
    nxt = first_event_then_next(v.filter(reviewed()), "customer_unique_id", "purchase_ts",
                                detractor(), "complaint_ts", "next_order_ts")
    returned = c("next_order_ts").isNotNull()
    return nxt.agg(
        n_rows("customers_with_complaint"),
        F.sum(flag(returned)).cast("bigint").alias("returned_after_complaint"),
        round_half(pct(F.sum(flag(returned)), F.count(F.lit(1))), 1).alias("return_rate_pct"),
        round_half(F.avg(F.when(returned, day_diff("complaint_ts", "next_order_ts"))), 0)
        .alias("avg_days_to_return"))


@report("rpt_root_cause_sequence",
        uses=["is_detractor", "customer_unique_id", "purchase_ts", "root_cause", "order_id",
              "review_id"])
def rpt_root_cause_sequence(v: DataFrame, k: int = 3) -> DataFrame:
    seq = event_sequence(v.filter(detractor()).select("customer_unique_id", "purchase_ts",
                                                    "order_id", "review_id", "root_cause"),
                         "customer_unique_id", ["purchase_ts", "order_id", "review_id"], k,
                         "complaint_seq")
    out = seq.groupBy("complaint_seq", "root_cause").agg(n_rows("occurrences"))
    return (share_of_total(out, "occurrences", "pct_of_seq", within=["complaint_seq"])
            .withColumn("complaint_seq", c("complaint_seq").cast("bigint"))
            .orderBy("complaint_seq", F.desc("occurrences")))


@report("rpt_gmv_at_risk", uses=_USES)
def rpt_gmv_at_risk(v: DataFrame, repeat_min: int = 2) -> DataFrame:
    cc = customer_complaints(v)
    rep = c("complaint_count") >= repeat_min
    rep_gmv = F.sum(F.when(rep, c("lifetime_gmv")).otherwise(F.lit(0)))
    return cc.agg(
        round_money(rep_gmv, 0).alias("repeat_complainer_gmv"),
        round_money(F.sum("lifetime_gmv"), 0).alias("total_customer_gmv"),
        round_half(pct(rep_gmv, F.sum("lifetime_gmv")), 1).alias("repeat_complainer_gmv_pct"),
        F.count(F.when(rep, 1)).alias("repeat_complainers"),
        n_rows("total_customers"),
        round_half(pct(F.count(F.when(rep, 1)), F.count(F.lit(1))), 1).alias("repeat_complainer_pct"))
