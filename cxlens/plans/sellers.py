"""Which sellers drive complaints: P90 problem-seller cohort.

Per-seller statistics are one partially aggregated group-by (a seller with
a third of all rows is pre-reduced on every map task). The P90 threshold is
one row that the plan itself finds from the seller rows.
Category and root-cause breakdowns aggregate view rows to (seller, key)
first; seller totals are windows over that roll-up, never over raw rows.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from cxlens.functions import ratio, round_half, round_money
from cxlens.operators import percentile_cohort, rate_table, share_of_total, with_quantile
from cxlens.plans.common import avg2, c, money0, n_rows, pct_of, reviewed, sum_long
from cxlens.plans.registry import report

MIN_REVIEWED = 30
QUANTILE = 0.90
# The labels of sellers at or above the threshold, and of the others.
COHORT_LABELS = ("problem_seller", "standard")


def seller_money() -> list:
    return [F.sum("order_gmv").alias("total_gmv"), F.sum(c("is_detractor") * c("order_gmv")).alias("detractor_gmv")]


def seller_rates(v: DataFrame, min_rows: int = MIN_REVIEWED) -> DataFrame:
    """Unrounded per-seller rates over reviewed rows (sellers with >= min_rows)."""
    return rate_table(v.filter(reviewed()), ["seller_id"], min_rows, "reviewed_orders", [
        F.avg("is_detractor").alias("detractor_rate"), *seller_money()])


def problem_rows(v: DataFrame, key: str, min_rows: int = MIN_REVIEWED, q: float = QUANTILE, money: bool = False) -> DataFrame:
    """Reviewed rows summed per (seller, key), kept for sellers in the P90 cohort; with their gmv if ``money``.

    Seller totals are windows partitioned by seller over the roll-up (at
    most one row per key value per seller), and P90 runs over one
    representative row per qualifying seller. A NULL seller takes part
    in the P90 but never matches a seller list, so its rows are dropped.
    P90 and rows read the same roll-up: neither a column nor a filter sets
    them apart, so Spark joins and groups the view once for both.
    """
    rollup = (v.filter(reviewed()).groupBy("seller_id", key).agg(
        n_rows("n"), F.sum("is_detractor").alias("det"), *([F.sum("order_gmv").alias("gmv")] if money else [])))
    if money:
        rollup = rollup.filter((c("n") > 0) | c("gmv").isNotNull())  # true of every group; P90's roll-up keeps gmv by it
    per_seller = Window.partitionBy("seller_id")
    first = Window.partitionBy("seller_id").orderBy(F.col(key).asc_nulls_first())
    rows = (rollup
            .withColumn("seller_n", F.sum("n").over(per_seller))
            .withColumn("seller_rate", ratio(F.sum("det").over(per_seller), c("seller_n")))
            .withColumn("_rep", F.row_number().over(first) == 1))
    eligible = c("seller_n") >= min_rows
    rows = with_quantile(rows, F.when(c("_rep") & eligible, c("seller_rate")), q, "p90")
    # The NULL seller fails here and not by a filter of its own, which Spark would push below the roll-up.
    return rows.filter(eligible & (c("seller_rate") >= F.when(c("seller_id").isNotNull(), c("p90"))))


@report("seller_overview", uses=["review_score", "seller_id", "is_detractor", "is_promoter",
                                 "order_gmv", "is_late"])
def seller_overview(v: DataFrame, min_rows: int = MIN_REVIEWED) -> DataFrame:
    return rate_table(v.filter(reviewed()), ["seller_id"], min_rows, "reviewed_orders", [
        pct_of("is_detractor", "detractor_rate_pct"),
        pct_of("is_promoter", "promoter_rate_pct"), avg2("review_score", "avg_review_score"),
        money0(c("order_gmv"), "total_gmv"), pct_of("is_late", "late_rate_pct")]).orderBy(F.desc("detractor_rate_pct"))


@report("seller_flagged", uses=["review_score", "seller_id", "is_detractor", "order_gmv",
                                "is_late"])
def seller_flagged(v: DataFrame, min_rows: int = MIN_REVIEWED, q: float = QUANTILE) -> DataFrame:
    # This cohort ranks the *rounded* percentage.
    return percentile_cohort(v.filter(reviewed()), "seller_id", pct_of("is_detractor", "detractor_rate_pct"), q, min_rows, "reviewed_orders", [
        avg2("review_score", "avg_review_score"), money0(c("order_gmv"), "total_gmv"),
        money0(c("is_detractor") * c("order_gmv"), "detractor_gmv"),
        pct_of("is_late", "late_rate_pct")], COHORT_LABELS, "cohort_flag").orderBy(F.desc("detractor_rate_pct"))


@report("seller_cohort_summary", uses=["review_score", "seller_id", "is_detractor", "order_gmv"])
def seller_cohort_summary(v: DataFrame, min_rows: int = MIN_REVIEWED,
                          q: float = QUANTILE) -> DataFrame:
    flagged = percentile_cohort(v.filter(reviewed()), "seller_id", F.avg("is_detractor").alias("detractor_rate"), q, min_rows, "reviewed_orders",
                                seller_money(), COHORT_LABELS, "cohort_flag")
    return (flagged.groupBy("cohort_flag").agg(
        n_rows("seller_count"), sum_long("reviewed_orders", "total_orders"),
        round_half(F.avg("detractor_rate") * 100, 1).alias("avg_detractor_rate_pct"),
        round_money(F.sum("total_gmv"), 0).alias("total_gmv"),
        round_money(F.sum("detractor_gmv"), 0).alias("detractor_gmv"),
        round_half(ratio(F.sum("detractor_gmv"), F.sum("total_gmv")) * 100, 1)
        .alias("detractor_gmv_pct"))
        .orderBy("cohort_flag"))


@report("seller_problem_categories",
        uses=["review_score", "seller_id", "category_name", "is_detractor", "order_gmv"])
def seller_problem_categories(v: DataFrame, min_rows: int = MIN_REVIEWED,
                              q: float = QUANTILE) -> DataFrame:
    hits = problem_rows(v, "category_name", min_rows, q, money=True)
    return (hits.groupBy("category_name").agg(
        F.count("seller_id").alias("problem_sellers"), sum_long("n", "orders"),
        round_half(ratio(F.sum("det"), F.sum("n")) * 100, 1).alias("detractor_rate_pct"),
        round_money(F.sum("gmv"), 0).alias("gmv"))
        .orderBy(F.desc("orders")))


@report("seller_problem_root_causes",
        uses=["review_score", "seller_id", "is_detractor", "order_gmv", "root_cause"])
def seller_problem_root_causes(v: DataFrame, min_rows: int = MIN_REVIEWED,
                               q: float = QUANTILE) -> DataFrame:
    # root_cause is set exactly on detractor rows, whose count is ``det``.
    hits = problem_rows(v, "root_cause", min_rows, q).filter(c("root_cause").isNotNull())
    out = hits.groupBy("root_cause").agg(sum_long("det", "detractor_reviews"))
    return share_of_total(out, "detractor_reviews", "pct_of_complaints").orderBy(
        F.desc("detractor_reviews"))
