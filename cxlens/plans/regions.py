"""Where logistics fail: states at or above twice the national late rate.

Each report scans the view once into a small roll-up (state, (month, state), or
(state, root cause, lateness)); state totals are windows partitioned by
state over the roll-up (a few rows per state), and the national rate is a
window over the per-state rows, computed before the minimum-rows filter so
it covers every state. One scan, no join, whatever the state skew.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from cxlens.functions import pct, ratio, round_half, round_money
from cxlens.operators import rate_table, share_of_total
from cxlens.plans.common import c, delivered, detractor, n_rows, reviewed, sum_long
from cxlens.plans.registry import report

MIN_ROWS = 100
FACTOR = 2.0

_USES = ["review_score", "is_late", "customer_state", "is_detractor", "order_gmv"]


def rollup(v: DataFrame, *keys: str) -> DataFrame:
    """Reviewed and delivered rows summed by key: the one scan of the view.

    State-level, national and monthly figures below are exact
    re-aggregations of these sums (integer counts, decimal money).
    """
    return rate_table(v.filter(reviewed() & delivered()), keys, rows="n", aggregates=[
        F.sum("is_late").alias("late"), F.sum("is_detractor").alias("det"),
        F.sum("review_score").alias("score"), F.sum("order_gmv").alias("gmv"),
        F.sum(F.when(detractor(), c("order_gmv")).otherwise(F.lit(0))).alias("det_gmv")])


def _national(late: str, n: str):
    # Over already-aggregated rows only (one per state or per state and key).
    everything = Window.partitionBy()
    return ratio(F.sum(late).over(everything), F.sum(n).over(everything))


def _is_hotspot(n, late, national, min_rows: int, factor: float):
    # A NULL state never matches a state list, so it is never a hotspot.
    return (c("customer_state").isNotNull() & (n >= min_rows)
            & (ratio(late, n) >= national * factor))


def state_rates(v: DataFrame, min_rows: int = MIN_ROWS, factor: float = FACTOR) -> DataFrame:
    """One row per state with >= min_rows rows: rates, money, national rate and flag."""
    states = (rollup(v, "customer_state")
              .withColumnsRenamed({"n": "reviewed_orders", "gmv": "total_gmv", "det_gmv": "detractor_gmv"})
              .withColumn("national_late_rate", _national("late", "reviewed_orders")))
    return (states.filter(c("reviewed_orders") >= min_rows)
            .withColumn("late_rate", ratio("late", "reviewed_orders"))
            .withColumn("detractor_rate", ratio("det", "reviewed_orders"))
            .withColumn("avg_score", ratio("score", "reviewed_orders"))
            .withColumn("region_flag", F.when(c("late_rate") >= c("national_late_rate") * factor,
                                              "hotspot").otherwise("standard")))


@report("region_scorecard", uses=_USES)
def region_scorecard(v: DataFrame, min_rows: int = MIN_ROWS) -> DataFrame:
    return (state_rates(v, min_rows).select(
        "customer_state", "reviewed_orders",
        round_half(c("late_rate") * 100, 1).alias("late_rate_pct"),
        round_half(c("detractor_rate") * 100, 1).alias("detractor_rate_pct"),
        round_half(c("avg_score"), 2).alias("avg_review_score"),
        round_money(c("detractor_gmv"), 0).alias("detractor_gmv"),
        round_money(c("total_gmv"), 0).alias("total_gmv"),
        round_half(pct("detractor_gmv", "total_gmv"), 1).alias("detractor_gmv_pct"))
        .orderBy(F.desc("late_rate_pct")))


@report("region_vs_national", uses=_USES)
def region_vs_national(v: DataFrame, min_rows: int = MIN_ROWS, factor: float = FACTOR) -> DataFrame:
    return (state_rates(v, min_rows, factor).select(
        "customer_state", "reviewed_orders",
        round_half(c("late_rate") * 100, 1).alias("late_rate_pct"),
        round_half(c("national_late_rate") * 100, 1).alias("national_late_rate_pct"),
        round_half(ratio("late_rate", "national_late_rate"), 2).alias("late_rate_multiplier"),
        round_half(c("detractor_rate") * 100, 1).alias("detractor_rate_pct"),
        round_money(c("detractor_gmv"), 0).alias("detractor_gmv"), "region_flag")
        .orderBy(F.desc("late_rate_multiplier")))


@report("region_hotspot_summary", uses=_USES)
def region_hotspot_summary(v: DataFrame, min_rows: int = MIN_ROWS,
                           factor: float = FACTOR) -> DataFrame:
    return (state_rates(v, min_rows, factor).groupBy("region_flag").agg(
        n_rows("state_count"), sum_long("reviewed_orders", "total_orders"),
        round_half(F.avg("late_rate") * 100, 1).alias("avg_late_rate_pct"),
        round_half(F.avg("detractor_rate") * 100, 1).alias("avg_detractor_rate_pct"),
        round_money(F.sum("total_gmv"), 0).alias("total_gmv"),
        round_money(F.sum("detractor_gmv"), 0).alias("total_detractor_gmv"),
        round_half(ratio(F.sum("detractor_gmv"), F.sum("total_gmv")) * 100, 1)
        .alias("detractor_gmv_pct"))
        .orderBy("region_flag"))


@report("region_hotspot_root_causes", uses=_USES + ["root_cause"])
def region_hotspot_root_causes(v: DataFrame, min_rows: int = MIN_ROWS,
                               factor: float = FACTOR) -> DataFrame:
    # One scan: reviewed rows per (state, root cause, lateness). Delivered rows
    # give the hotspot test, detractor rows (root cause not NULL) the counts.
    causes = rate_table(v.filter(reviewed()), ["customer_state", "root_cause", "is_late"], rows="n",
                        aggregates=[F.sum("is_late").alias("late")])
    dn = F.when(c("is_late").isNotNull(), c("n"))
    per_state = Window.partitionBy("customer_state")
    flagged = (causes
               .withColumn("st_n", F.sum(dn).over(per_state))
               .withColumn("st_late", F.sum("late").over(per_state))
               .withColumn("nat", _national("late", dn)))
    hot = _is_hotspot(c("st_n"), c("st_late"), c("nat"), min_rows, factor)
    out = (flagged.filter(hot & c("root_cause").isNotNull())
           .groupBy("root_cause").agg(sum_long("n", "detractor_reviews")))
    return share_of_total(out, "detractor_reviews", "pct_of_hotspot_detractors").orderBy(
        F.desc("detractor_reviews"))


@report("region_monthly_trend", uses=_USES + ["order_month"])
def region_monthly_trend(v: DataFrame, min_rows: int = MIN_ROWS, factor: float = FACTOR) -> DataFrame:
    per_state = Window.partitionBy("customer_state")  # rows per state = months
    months = (rollup(v, "order_month", "customer_state")
              .withColumn("st_n", F.sum("n").over(per_state))
              .withColumn("st_late", F.sum("late").over(per_state))
              .withColumn("nat", _national("late", "n")))
    region_type = F.when(_is_hotspot(c("st_n"), c("st_late"), c("nat"), min_rows, factor),
                         "hotspot").otherwise("standard")
    return (months.groupBy("order_month", region_type.alias("region_type")).agg(
        sum_long("n", "orders"),
        round_half(ratio(F.sum("late"), F.sum("n")) * 100, 1).alias("late_rate_pct"),
        round_half(ratio(F.sum("det"), F.sum("n")) * 100, 1).alias("detractor_rate_pct"))
        .orderBy("order_month", "region_type"))
