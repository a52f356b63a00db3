"""Derive the nine marketplace tables from the driver's TPC-H-like Parquet files.

The test data has no marketplace tables, so they are made from ``orders``,
``customer``, ``nation``, ``lineitem``, ``part`` and ``supplier`` with integer
modulo rules keyed on the order key ``k`` (see FIXTURES.md, part B). Every
rule is a column expression, so the derivation is one lazy plan that Spark
prunes and pushes down like any other read; nothing is collected.

The modulo expressions decide attributes of whole tables (which orders carry
a review, a second payment or a NULL timestamp, which status an order has);
every input row is used and nothing is sampled, capped or subset.

``M(a, p, m)`` below means ``((k * a) % p) % m``.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from cxlens.sources.tables import Tables

MONEY = "decimal(18,2)"

# Fixed values of the fixture rules (FIXTURES.md part B), in rule order.
CANCELED_STATUS = ["canceled", "unavailable", "shipped", "processing"]
PAYMENT_TYPES = ["credit_card", "debit_card", "bank_transfer", "wallet"]
REVIEW_MESSAGES = [
    "Arrived five days LATE", "Box was broken", "Sent the wrong size", "Seller never replied",
    "Feels cheap", "Fine", "Damaged and delayed", "Chocolate plate set",
    "Customer service ignored me", "It fell apart", "Meh", None,
]
EXCLUDED_BRAND = "Brand#25"
# Order of an order's lines when numbering them. The SQL goes on with l_discount, l_tax, l_returnflag and l_linestatus;
# lines that agree up to l_quantity give equal items, so which of them comes first shows nowhere and those need no shuffle.
ITEM_ORDER = ["l_linenumber", "l_partkey", "l_suppkey", "l_shipdate", "l_extendedprice", "l_quantity"]


def _m(k: Column, a: int, p: int, m: int) -> Column:
    return ((k * a) % p) % m


def _pick(index: Column, values: list) -> Column:
    """values[index] as a CASE chain (NULL entries stay NULL)."""
    out = None
    for i, v in enumerate(values):
        out = (F.when(index == i, F.lit(v)) if out is None else out.when(index == i, F.lit(v)))
    return out


def _negated(when: Column, key: Column) -> Column:
    """The key, or where ``when`` holds its negative, which no table has."""
    return F.when(when, -key).otherwise(key)


def _plus(ts: Column, unit: str, qty) -> Column:
    q = qty if isinstance(qty, Column) else F.lit(qty)
    return F.timestamp_add(unit, q, ts)


def _installments(k: Column) -> Column:
    h = _m(k, 2741, 10061, 100)
    return F.when(h < 35, 1 + h % 10).otherwise(F.lit(1).cast("bigint"))


def _read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


def _item_key(key: Column) -> Column:
    """order_id of an item from its order key, and back."""
    return _negated(key % 443 == 0, key)


def derive_items(lineitem: DataFrame, tasks: int | None = None) -> DataFrame:
    """The order items, and on an order's first one its seller before the faults (``first_seller``, else NULL).

    ``tasks``: number the lines in so many tasks (else as the session says).
    """
    # order_item_id: (l_orderkey, l_linenumber) is not unique, so number the
    # lines of an order by ITEM_ORDER. The window is partitioned by order key
    # (a handful of lines per order).
    number = F.row_number().over(Window.partitionBy("l_orderkey").orderBy(*ITEM_ORDER))
    lk = F.col("l_orderkey")
    # Orphans (negated keys), NULLs and impossible amounts, so that every audit has something to find.
    lines = lineitem.select("l_orderkey", *ITEM_ORDER)
    if tasks:
        lines = lines.repartition(tasks, "l_orderkey")
    return lines.select("*", number.alias("order_item_id")).select(
        _item_key(lk).alias("order_id"),
        "order_item_id",
        F.when(lk % 389 != 0, _negated(lk % 397 == 0, F.col("l_partkey"))).alias("product_id"),
        F.when(lk % 401 != 0, _negated(lk % 409 == 0, F.col("l_suppkey"))).alias("seller_id"),
        F.when(lk % 419 == 0, F.lit(None)).when(lk % 421 == 0, -F.col("l_extendedprice")).when(lk % 431 == 0, F.lit(0.0))
        .otherwise(F.col("l_extendedprice")).cast(MONEY).alias("price"),
        F.when(lk % 433 == 0, -F.col("l_quantity")).when(lk % 439 != 0, F.col("l_quantity")).cast(MONEY).alias("freight_value"),
        F.when(F.col("order_item_id") == 1, F.col("l_suppkey")).alias("first_seller"),
    )


def derive_marketplace(spark: SparkSession, sf_dir: str, items: DataFrame | None = None) -> Tables:
    """Build the nine marketplace tables (lazily) from ``sf_dir``; ``items``: a written copy of ``derive_items``."""
    orders = _read(spark, sf_dir, "orders")
    customer = _read(spark, sf_dir, "customer")
    nation = _read(spark, sf_dir, "nation")
    lineitem = _read(spark, sf_dir, "lineitem")
    part = _read(spark, sf_dir, "part")
    supplier = _read(spark, sf_dir, "supplier")

    # nation is a fixed 25-row dimension of the TPC-H schema: a proven size bound.
    nations = F.broadcast(nation.select("n_nationkey", "n_name"))
    base = (orders.select(F.col("o_orderkey").alias("k"), "o_custkey", "o_orderdate", "o_totalprice")
            .join(customer.select(F.col("c_custkey").alias("o_custkey"), "c_nationkey"),
                  "o_custkey")
            .join(nations, F.col("c_nationkey") == F.col("n_nationkey")))
    k = F.col("k")
    od = F.col("o_orderdate")
    purchase = _plus(od, "SECOND", k % 86400)
    est_base = _plus(od, "DAY", 10)
    shift = 1 + ((k * 104729) % 10009) % 264
    delivered = (F.when(k % 11 == 0, F.lit(None))
                 .when(_m(k, 7919, 10007, 100)
                       < F.when(F.col("c_nationkey") % 8 == 0, 41).otherwise(13),
                       _plus(est_base, "HOUR", shift))
                 .otherwise(_plus(est_base, "DAY", -(shift % 9))))
    estimated = F.when(k % 499 == 0, F.lit(None)).otherwise(est_base)
    status = (F.when(k % 463 == 0, F.lit(None)).when(k % 11 == 0, _pick(_m(k, 37, 101, 4), CANCELED_STATUS))
              .when(k % 33 == 1, F.lit("returned"))
              .otherwise(F.lit("delivered")))

    mk_orders = base.select(
        k.alias("order_id"),
        F.when(k % 467 != 0, k).alias("customer_id"),
        status.alias("order_status"),
        purchase.alias("purchase_ts"),
        F.when(k % 101 == 0, F.lit(None)).otherwise(_plus(purchase, "HOUR", 1)).alias("approved_ts"),
        F.when(k % 11 == 0, F.lit(None)).otherwise(_plus(od, "DAY", 2)).alias("delivered_carrier_ts"),
        delivered.alias("delivered_customer_ts"),
        estimated.alias("estimated_delivery_ts"),
    )
    mk_customers = base.select(k.alias("customer_id"),
                               F.col("o_custkey").alias("customer_unique_id"),
                               F.col("n_name").alias("customer_state"))

    if items is None:
        items = derive_items(lineitem)

    mk_products = part.select(F.col("p_partkey").alias("product_id"),
                              F.col("p_brand").alias("category_id"),
                              (F.col("p_size") * 100).alias("weight_grams"))
    mk_categories = (part.select("p_brand").distinct()
                     .filter(F.col("p_brand") != EXCLUDED_BRAND)
                     .select(F.col("p_brand").alias("category_id"),
                             F.upper("p_brand").alias("category_name")))
    mk_sellers = (supplier.join(nations, F.col("s_nationkey") == F.col("n_nationkey"))
                  .select(F.col("s_suppkey").alias("seller_id"),
                          F.col("n_name").alias("seller_state"),
                          F.date_add(F.lit("1994-01-01").cast("date"),
                                     (F.col("s_suppkey") % 365).cast("int")).alias("onboarded_date")))

    ok = orders.select(F.col("o_orderkey").alias("k"), "o_totalprice", "o_orderdate")
    pay1 = ok.filter(k % 97 != 0).select(
        k.alias("order_id"),
        _pick((k * 53) % 4, PAYMENT_TYPES).alias("payment_type"),
        _installments(k).alias("payment_installments"),
        F.col("o_totalprice").cast(MONEY).alias("payment_value"))
    pay2 = ok.filter(k % 13 == 0).select(
        k.alias("order_id"),
        F.lit("voucher").alias("payment_type"),
        F.lit(2).cast("bigint").alias("payment_installments"),
        (k % 50 + 1).cast(MONEY).alias("payment_value"))
    mk_payments = pay1.unionByName(pay2).withColumn("order_id", _negated(F.col("order_id") % 449 == 0, F.col("order_id")))

    # Review score depends on lateness, the first item's seller and the
    # installment rule; first items are one row per order, joined on k.
    first_seller = (items.filter(F.col("order_item_id") == 1)
                    .select(_item_key(F.col("order_id")).alias("k"), "first_seller"))
    late = (F.col("delivered_customer_ts").isNotNull()
            & (F.col("delivered_customer_ts") > F.col("estimated_delivery_ts")))
    rv = (mk_orders.filter(F.col("order_id") % 5 != 0)
          .select(F.col("order_id").alias("k"), late.alias("late"))
          .join(first_seller, "k", "left")
          .join(ok.select("k", "o_orderdate"), "k"))
    s = _m(k, 15485863, 10039, 100)
    t = (22 + F.when(F.coalesce(F.col("late"), F.lit(False)), 12).otherwise(0)
         + F.when(F.coalesce(F.col("first_seller") % 10 == 7, F.lit(False)), 22).otherwise(0)
         + F.when(_installments(k) >= 6, 8).otherwise(0))
    score = (F.when(k % 461 == 0, F.lit(None)).when(2 * s < t, 1).when(s < t, 2).when(s < t + 9, 3).when(s < t + 38, 4)
             .otherwise(5))
    common = [
        k.alias("order_id"),
        F.when(k % 3 == 0, F.lit(None).cast("string")).otherwise(F.lit("Review")).alias("review_title"),
        _plus(od, "DAY", 22).alias("review_created_ts"),
        F.when(_m(k, 433, 1009, 9) == 0, _plus(od, "DAY", 25)).alias("review_answered_ts"),
    ]
    rev1 = rv.select((k * 10).alias("review_id"), score.alias("review_score"),
                     _pick((k * 6151 % 10037) % 12, REVIEW_MESSAGES).alias("review_message"),
                     *common)
    rev2 = rv.filter((k * 31) % 211 == 0).select(
        (k * 10 + 1).alias("review_id"), F.lit(3).alias("review_score"),
        F.lit("Second review").alias("review_message"), *common)
    mk_reviews = rev1.unionByName(rev2).withColumn("order_id", _negated(F.col("order_id") % 457 == 0, F.col("order_id")))

    mk_geo = nation.select(F.col("n_nationkey").alias("zip_prefix"), F.col("n_name").alias("state"),
                           F.col("n_nationkey").cast("double").alias("lat"),
                           (-F.col("n_nationkey")).cast("double").alias("lng"))

    return Tables({
        "customers": mk_customers, "orders": mk_orders, "order_items": items.drop("first_seller"),
        "products": mk_products, "product_categories": mk_categories, "sellers": mk_sellers,
        "payments": mk_payments, "reviews": mk_reviews, "geolocation": mk_geo,
    })


#: Bytes of lineitem files for a task that numbers lines; its sort takes some eight times as much.
LINE_BYTES = 8 << 20
SOURCE_TABLES = ("orders", "customer", "nation", "lineitem", "part", "supplier")


def _fingerprint(spark: SparkSession, sf_dir: str) -> str:
    """Key of a derived copy: the source files and the derivation rules (this module)."""
    import hashlib
    import inspect
    import sys

    from cxlens.sources.files import file_statuses, join_path

    h = hashlib.sha1(sf_dir.encode())
    h.update(inspect.getsource(sys.modules[__name__]).encode())
    for name in SOURCE_TABLES:
        h.update(repr(file_statuses(spark, join_path(sf_dir, f"{name}.parquet"))).encode())
    return h.hexdigest()[:16]


def load_marketplace(spark: SparkSession, sf_dir: str) -> Tables:
    """Derive the nine tables once per source snapshot, write them, read them back.

    The written copy lives under ``spark.checkpoint.dir`` (a shared folder on a
    cluster), keyed by the source files; later calls read the Parquet copy, so
    every report starts from short lineage and pruned, filter-pushed scans.
    The nine tables go to a fresh folder, recorded when all are complete, so a
    half-written copy is never read. The items are written first, with their
    orders' first sellers, so that the reviews need no second pass over all lines.
    """
    from cxlens.session import ensure_checkpoint_dir
    from cxlens.sources.files import (commit_set, file_statuses, fresh_folder, join_path, latest_set,
                                      read_parquet_tables, write_tables)

    base = join_path(ensure_checkpoint_dir(spark), "cxlens-fixtures", _fingerprint(spark, sf_dir))
    target = latest_set(spark, join_path(base, "complete"))
    if target is None:
        target = fresh_folder(base)
        path = join_path(target, "order_items")
        n_bytes = sum(size for _, size, _ in file_statuses(spark, join_path(sf_dir, "lineitem.parquet")))
        derive_items(_read(spark, sf_dir, "lineitem"), max(1, -(-n_bytes // LINE_BYTES))).write.parquet(path)
        derived = derive_marketplace(spark, sf_dir, spark.read.parquet(path))
        write_tables({n: derived[n] for n in derived if n != "order_items"}, target, concurrent_jobs=4)
        commit_set(spark, join_path(base, "complete"), target)
    tables = read_parquet_tables(spark, target)
    return tables.replace(order_items=tables.order_items.drop("first_seller"))
