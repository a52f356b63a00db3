"""Reports the original write-up states or recommends but never computes.

* ``ext_overall_csat``: overall satisfaction and detractor share of reviews.
* ``ext_monthly_detractor_volume``: detractors per month against the mean month.
* ``ext_lift_table``: the headline lifts (late vs on time, 8+ days vs on time,
  6+ installments vs single payment, problem vs standard sellers).
* ``ext_seller_watchlist``: sellers at/above P90, above the probation rate,
  or within a margin below P90.
* ``ext_repeat_trigger_12m``: days on which a customer reaches 2+ detractor
  reviews within the trailing 365 days. Reviews are first counted per
  (customer, day), so the per-customer window sees at most one row per
  calendar day however many reviews a hot customer has.
* ``ext_delay_alerts``: orders at least 2 days past the estimate as of a
  date (compensation at 4+), open orders included.
* ``ext_installment_priority``: 6+ installment orders with delivery state.
* ``ext_price_p90_by_category``: the exact P90 of the first item's price, for every category.
* ``ext_late_hotspots``: (category, state) pairs at or above twice the overall late rate.
* ``ext_next_order_after_complaint``: for every complaint, the customer's next order.
* ``ext_running_gmv``: orders and value up to every instant of purchase.
* ``payment_methods``: payment types used per order.
* ``ext_taxonomy_on_documents``: the keyword classifier on ``documents``.

The streaming versions of the alerts live in ``cxlens.streaming``.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from cxlens.functions import classify, day_diff, ratio, round_half
from cxlens.operators import next_event, quantile_rows, rate_table, relative_hotspots, running_total, share_of_total, with_quantile
from cxlens.plans.common import c, detractor, n_rows, reviewed
from cxlens.plans.order_view import order_columns, order_totals, payment_totals
from cxlens.plans.registry import report
from cxlens.plans.sellers import seller_rates
from cxlens.sources.tables import Tables

PROBATION_RATE = 0.40
WATCH_MARGIN = 0.05
ALERT_DAYS = 2
COMPENSATE_DAYS = 4
MIN_INSTALLMENTS = 6
REPEAT_WINDOW_DAYS = 365


@report("ext_overall_csat")
def ext_overall_csat(t: Tables) -> DataFrame:
    s = c("review_score")
    return t.reviews.filter(s.isNotNull()).agg(
        n_rows("reviews"),
        F.count_if(s >= 4).alias("promoters"), F.count_if(s <= 2).alias("detractors"),
        round_half(ratio(F.count_if(s >= 4), F.count(F.lit(1))) * 100, 1).alias("csat_pct"),
        round_half(ratio(F.count_if(s <= 2), F.count(F.lit(1))) * 100, 1).alias("detractor_pct"))


@report("ext_monthly_detractor_volume", uses=["is_detractor", "order_month"])
def ext_monthly_detractor_volume(v: DataFrame) -> DataFrame:
    per_month = v.filter(detractor()).groupBy("order_month").agg(n_rows("detractor_reviews"))
    mean = F.avg("detractor_reviews").over(Window.partitionBy())  # over months, not rows
    return (per_month.withColumn("ratio_to_mean_month", round_half(ratio("detractor_reviews", mean), 2))
            .orderBy("order_month"))


@report("ext_lift_table", uses=["review_score", "is_late", "is_detractor", "delivery_bucket",
                                "installment_bucket", "seller_id"])
def ext_lift_table(v: DataFrame, min_rows: int = 30, q: float = 0.9) -> DataFrame:
    # One roll-up serves the order-level rates and, summed again by seller, the cohorts.
    sums = rate_table(v.filter(reviewed()), ["seller_id", "is_late", "delivery_bucket", "installment_bucket"], rows="n",
                      aggregates=[F.sum("is_detractor").alias("det")])

    def rate(when, name):
        return (F.sum(F.when(when, c("det"))).cast("double") / F.sum(F.when(when, c("n")))).alias(name)

    rates = sums.agg(
        rate(c("is_late") == 0, "on_time"), rate(c("is_late") == 1, "late"),
        rate(c("delivery_bucket") == "late_8_plus_days", "late8"),
        rate(c("installment_bucket") == "1_installment", "single"),
        rate(c("installment_bucket") == "6_plus_installments", "six"))
    sellers = (sums.groupBy("seller_id").agg(F.sum("n").alias("n"), F.sum("det").alias("det"))
               .filter(c("n") >= min_rows).select(ratio("det", "n").alias("detractor_rate")))
    problem = c("detractor_rate") >= c("p90")
    cohorts = with_quantile(sellers, "detractor_rate", q, "p90").agg(
        F.avg(F.when(problem, c("detractor_rate"))).alias("problem"),
        F.avg(F.when(~problem, c("detractor_rate"))).alias("standard"))
    return rates.crossJoin(F.broadcast(cohorts)).select(
        round_half(ratio("late", "on_time"), 2).alias("late_vs_on_time"),
        round_half(ratio("late8", "on_time"), 2).alias("late_8_plus_vs_on_time"),
        round_half(ratio("six", "single"), 2).alias("six_plus_vs_single_installment"),
        round_half(ratio("problem", "standard"), 2).alias("problem_vs_standard_seller"))


@report("ext_seller_watchlist", uses=["review_score", "seller_id", "is_detractor", "order_gmv"])
def ext_seller_watchlist(v: DataFrame, min_rows: int = 30, q: float = 0.9,
                         probation: float = PROBATION_RATE, margin: float = WATCH_MARGIN) -> DataFrame:
    stats = with_quantile(seller_rates(v, min_rows), "detractor_rate", q, "p90")
    rate = c("detractor_rate")
    status = (F.when(rate >= c("p90"), "problem_seller").when(rate > probation, "probation")
              .when(rate >= c("p90") - margin, "watch"))
    return (stats.withColumn("status", status)
            .filter(c("status").isNotNull())
            .select("seller_id", "reviewed_orders",
                    round_half(rate * 100, 1).alias("detractor_rate_pct"),
                    F.round("total_gmv", 0).cast("double").alias("total_gmv"), "status")
            .orderBy(F.desc("detractor_rate_pct")))


@report("ext_repeat_trigger_12m",
        uses=["is_detractor", "customer_unique_id", "review_created_ts"])
def ext_repeat_trigger_12m(v: DataFrame, window_days: int = REPEAT_WINDOW_DAYS,
                           threshold: int = 2) -> DataFrame:
    per_day = (v.filter(detractor() & c("review_created_ts").isNotNull())
               .groupBy("customer_unique_id", F.to_date("review_created_ts").alias("alert_date"))
               .agg(n_rows("n")))
    trailing = (Window.partitionBy("customer_unique_id").orderBy(F.unix_date("alert_date"))
                .rangeBetween(-(window_days - 1), 0))
    return (per_day.withColumn("detractor_reviews_12m", F.sum("n").over(trailing))
            .filter(c("detractor_reviews_12m") >= threshold)
            .select("customer_unique_id", "alert_date", "detractor_reviews_12m")
            .orderBy("alert_date", "customer_unique_id"))


def is_live() -> Column:
    return ~c("order_status").isin("canceled", "unavailable")


def delay_level(overdue: Column, compensate_days: int) -> Column:
    return F.when(overdue >= compensate_days, "compensate").otherwise("alert")


def priority_row(orders: DataFrame) -> DataFrame:
    """Order rows with ``max_installments`` as rows of the priority report."""
    cols = order_columns()
    return orders.select("order_id", "max_installments", "order_status",
                         cols["delivery_bucket"].alias("delivery_bucket"), cols["is_late"].alias("is_late"))


def delay_alerts(orders: DataFrame, as_of: DataFrame, alert_days: int = ALERT_DAYS,
                 compensate_days: int = COMPENSATE_DAYS) -> DataFrame:
    """Orders overdue by ``alert_days``+ as of the one-row ``as_of`` frame (column ``as_of``)."""
    delivered, est = c("delivered_customer_ts"), c("estimated_delivery_ts")
    overdue = F.datediff(F.coalesce(delivered, c("as_of")), est).cast("bigint")
    return (orders.filter(est.isNotNull() & (delivered.isNotNull() | is_live()))
            .crossJoin(F.broadcast(as_of))
            .filter(overdue >= alert_days)
            .select("order_id", "estimated_delivery_ts", "delivered_customer_ts",
                    overdue.alias("overdue_days"),
                    delay_level(overdue, compensate_days).alias("alert_level"),
                    delivered.isNull().cast("int").alias("is_open")))


@report("ext_delay_alerts")
def ext_delay_alerts(t: Tables) -> DataFrame:
    # "Now" is the latest purchase in the data, so the report is reproducible.
    as_of = t.orders.agg(F.max("purchase_ts").alias("as_of"))
    return delay_alerts(t.orders, as_of)


@report("ext_installment_priority")
def ext_installment_priority(t: Tables, min_installments: int = MIN_INSTALLMENTS) -> DataFrame:
    return priority_row(t.orders.join(payment_totals(t).filter(c("max_installments") >= min_installments), "order_id"))


@report("ext_price_p90_by_category", uses=["category_name", "item_price"])
def ext_price_p90_by_category(v: DataFrame, q: float = 0.9) -> DataFrame:
    p90 = quantile_rows(v, "item_price", q, ["category_name"], out="p90")
    return p90.select("category_name", round_half(c("p90"), 2).alias("p90_price")).orderBy("category_name")


@report("ext_late_hotspots", uses=["review_score", "is_late", "category_name", "customer_state", "is_detractor"])
def ext_late_hotspots(v: DataFrame, min_rows: int = 30, factor: float = 2.0) -> DataFrame:
    spots = relative_hotspots(v.filter(reviewed()), ["category_name", "customer_state"], "is_late", min_rows, factor, "reviewed_orders",
                              [F.sum("is_detractor").alias("detractors")])
    return spots.filter(c("cohort") == "hotspot").select(
        "category_name", "customer_state", "reviewed_orders", "detractors", round_half(c("rate") * 100, 1).alias("late_rate_pct"),
        round_half(c("overall_rate") * 100, 1).alias("overall_late_rate_pct"))


@report("ext_next_order_after_complaint", uses=["customer_unique_id", "order_id", "review_id", "purchase_ts", "is_detractor"])
def ext_next_order_after_complaint(v: DataFrame) -> DataFrame:
    rows = next_event(v.filter(detractor()), v, "customer_unique_id", "purchase_ts", "purchase_ts", "next_order_ts")
    return rows.select("customer_unique_id", "order_id", "review_id", "purchase_ts", "next_order_ts",
                       day_diff("purchase_ts", "next_order_ts").alias("days_to_next_order"))


@report("ext_running_gmv")
def ext_running_gmv(t: Tables) -> DataFrame:
    orders = t.orders.select("order_id", "purchase_ts").join(order_totals(t).select("order_id", "order_gmv"), "order_id", "left")
    out = running_total(orders, "purchase_ts", {"orders": F.lit(1), "gmv": c("order_gmv")})
    return out.select("purchase_ts", "orders", "running_orders", c("gmv").cast("double").alias("gmv"), c("running_gmv").cast("double").alias("running_gmv"))


@report("payment_methods")
def payment_methods(t: Tables) -> DataFrame:
    """Per order: how many payment types were used, with the installments and the amount."""
    return payment_totals(t, with_methods=True).select(
        "order_id", "payment_methods", "max_installments", F.col("total_paid").cast("double").alias("total_paid"))


#: Rules for documents as data: label, then substrings of the lower-cased text; the first hit wins.
DOCUMENT_RULES = [
    ("license", ["license", "licence", "copyright"]),
    ("contact", ["@"]),
    ("credential", ["token =", "password", "secret"]),
]


def taxonomy_on_documents(docs: DataFrame, rules=DOCUMENT_RULES, fallback: str = "other") -> DataFrame:
    """Documents per label of ``rules``, over whole texts."""
    labelled = docs.select(classify(c("text"), rules, fallback=fallback).alias("label"))
    return share_of_total(labelled.groupBy("label").agg(n_rows("documents")), "documents", "pct_of_documents").orderBy("label")
