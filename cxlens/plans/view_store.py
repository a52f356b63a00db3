"""The order view kept up to date by month.

A store is a folder with ``parts/<id>/month=...`` (rows of the view), ``sets/<id>`` (which part holds each
month, and a fingerprint of every order) and ``log`` (the set that counts). A refresh fingerprints the
orders of the new tables, compares them with those of the last set, and rebuilds only the months that a changed, new or
vanished order was or is in: their orders are joined anew, written as a new part, and the other months stay where
they are. The log entry is written last, so a reader sees the old set or the new one,
never a mixture, and a refresh that fails leaves the old one.

The fingerprint of an order is the sum of the hashes of all its rows, as the
view reads them: order with customer, items with product and category, payments, reviews.
It is one aggregate over narrow (order, hash) rows, combined before its shuffle, so a hot order stays cheap.
A change goes unseen if two 64-bit hashes agree by chance.
"""

from __future__ import annotations

from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from cxlens.functions import month_start
from cxlens.plans.order_view import VIEW_COLUMNS, order_analysis
from cxlens.sources.bucketed import enriched
from cxlens.sources.files import commit_set, fresh_folder, join_path, latest_set
from cxlens.sources.tables import Tables

#: Folder name of orders without a purchase time.
NO_MONTH = "none"


def month_of_order(purchase: Column) -> Column:
    return F.coalesce(F.date_format(month_start(purchase), "yyyy-MM"), F.lit(NO_MONTH))


def _row_hash(df: DataFrame, tag: str) -> Column:
    """Hash of all columns by name and value; nulls differ from any text."""
    values = [F.coalesce(F.concat(F.lit("="), F.col(c).cast("string")), F.lit("")) for c in sorted(df.columns)]
    return F.xxhash64(F.lit(tag), *values)


def fingerprints(t: Tables) -> DataFrame:
    """(order_id, month, mark): one row per order_id and month; a mark of all its rows. Null order ids are one order."""
    parts = []
    for name, df in enriched(t).items():
        month = month_of_order(F.col("purchase_ts")) if name == "orders" else F.lit(None).cast("string")
        parts.append(df.select("order_id", month.alias("month"), _row_hash(df, name).cast("decimal(38,0)").alias("h")))
    rows = reduce(DataFrame.union, parts)
    marks = rows.groupBy("order_id").agg(F.collect_set("month").alias("months"), F.sum("h").alias("mark"))
    # Rows of other tables without an order do not show in the view.
    return marks.select("order_id", F.explode("months").alias("month"), "mark")


@dataclass(frozen=True)
class Refresh:
    """What a refresh did: the set written, and the months rebuilt and dropped (sorted)."""
    folder: str
    rebuilt: list[str]
    dropped: list[str]


class ViewStore:
    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path

    def _latest(self) -> str | None:
        return latest_set(self.spark, join_path(self.path, "log"))

    def months(self, folder: str | None = None) -> dict[str, str]:
        """Month -> folder of its rows, in the set that counts (or in ``folder``, an earlier one)."""
        folder = folder or self._latest()
        if folder is None:
            return {}
        return {r["month"]: r["part"] for r in self.spark.read.parquet(join_path(folder, "months")).collect()}  # one row a month

    def read(self, folder: str | None = None) -> DataFrame:
        """The view as of the last complete refresh, or as of an earlier one by its set."""
        folder = folder or self._latest()
        if folder is None:
            raise FileNotFoundError(f"{self.path} holds no complete view")
        paths = sorted(join_path(part, f"month={m}") for m, part in self.months(folder).items())
        schema = self.spark.read.parquet(join_path(folder, "empty")).schema
        if not paths:
            return self.spark.createDataFrame([], schema)
        return self.spark.read.schema(schema).parquet(*paths).select(*VIEW_COLUMNS)

    def changed_months(self, now: DataFrame) -> list[str]:
        """Months in which an order differs between fingerprints ``now`` and the set that counts."""
        folder = self._latest()
        if folder is None:
            return sorted(r[0] for r in now.select("month").distinct().collect())
        before = self.spark.read.parquet(join_path(folder, "orders"))
        both = before.withColumn("n", F.lit(-1)).unionByName(now.withColumn("n", F.lit(1)))
        # A row that is the same on both sides adds up to nothing.
        moved = both.groupBy("order_id", "month", "mark").agg(F.sum("n").alias("n")).filter("n <> 0")
        return sorted(r[0] for r in moved.select("month").distinct().collect())

    def refresh(self, t: Tables) -> Refresh:
        """Bring the store to the tables; without any change nothing is written."""
        folder, part = fresh_folder(join_path(self.path, "sets")), fresh_folder(join_path(self.path, "parts"))
        fingerprints(t).write.parquet(join_path(folder, "orders"))
        now = self.spark.read.parquet(join_path(folder, "orders"))
        first, months = self._latest() is None, self.months()
        touched = self.changed_months(now)
        if not touched and not first:
            return Refresh(self._latest(), [], [])
        live = {r[0] for r in now.filter(F.col("month").isin(touched)).select("month").distinct().collect()}
        rebuilt, dropped = sorted(m for m in touched if m in live), sorted(m for m in touched if m not in live)
        if rebuilt:
            self._write(t, rebuilt, part)
        kept = {m: p for m, p in months.items() if m not in set(touched)} | {m: part for m in rebuilt}
        self.spark.createDataFrame(sorted(kept.items()), "month string, part string").coalesce(1).write.parquet(join_path(folder, "months"))
        order_analysis(t).limit(0).write.parquet(join_path(folder, "empty"))
        commit_set(self.spark, join_path(self.path, "log"), folder)
        return Refresh(folder, rebuilt, dropped)

    def _write(self, t: Tables, months: list[str], part: str) -> None:
        """The rows of some months, from their orders alone."""
        orders = t.orders.filter(month_of_order(F.col("purchase_ts")).isin(months))
        ids = orders.select("order_id")
        mine = t.replace(orders=orders, **{n: t[n].join(ids, "order_id", "left_semi") for n in ("order_items", "payments", "reviews")})
        view = order_analysis(mine).withColumn("month", month_of_order(F.col("purchase_ts")))
        # Rows of a month come together first (a large month is split again), else every task would write into every month.
        view.hint("rebalance", F.col("month")).write.partitionBy("month").parquet(part)
