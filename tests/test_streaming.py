"""Streaming alerts give the same rows as their batch reports."""

import datetime as dt
import os
import tempfile

import pytest
from pyspark.sql import functions as F

from cxlens.plans import all_reports
from cxlens.plans.extensions import delay_alerts
from cxlens.streaming import (beyond_horizon, current_alerts, delay_alert_stream, detractor_events, installment_priority_stream,
                              overdue_stream, start_batches, start_parquet_sink, start_repeat_trigger)

R = all_reports()


def _scratch(spark) -> str:
    return tempfile.mkdtemp(prefix="stream-", dir=spark.conf.get("spark.checkpoint.dir"))


def _replay(spark, df, ts_col, root):
    """Write rows as one Parquet folder per month, then read them back as a stream."""
    src = os.path.join(root, "src")
    (df.withColumn("_m", F.date_format(ts_col, "yyyyMM")).repartition("_m")
     .write.partitionBy("_m").parquet(src))
    return (spark.readStream.schema(spark.read.parquet(src).schema)
            .option("maxFilesPerTrigger", 4).parquet(src).drop("_m"))


def _run(stream_df, root, name):
    q = (stream_df.writeStream.format("memory").queryName(name).outputMode("append")
         .option("checkpointLocation", os.path.join(root, "ckpt")).start())
    try:
        q.processAllAvailable()
    finally:
        q.stop()
    return stream_df.sparkSession.table(name)


def _same(a, b):
    cols = sorted(a.columns)
    assert sorted(b.columns) == cols
    key = lambda r: tuple((v is None, str(v)) for v in r)
    ra = sorted((tuple(r) for r in a.select(cols).collect()), key=key)
    rb = sorted((tuple(r) for r in b.select(cols).collect()), key=key)
    assert ra == rb and len(ra) > 0


def test_delay_alert_stream_equals_batch(spark, fixture_tables):
    t = fixture_tables
    root = _scratch(spark)
    as_of = t.orders.agg(F.max("purchase_ts").alias("as_of"))
    stream = delay_alert_stream(_replay(spark, t.orders, "purchase_ts", root), as_of)
    _same(_run(stream, root, "delay_alerts_out"), R["ext_delay_alerts"].run(t))


def _play(spark, root, schemas, batches, build, name, restarts=True):
    """Rows written by ``build(streams)``; each batch (stream -> rows as text) adds a file to every stream it has.

    With ``restarts`` the query is started anew from its checkpoint for every batch.
    """
    out, name = os.path.join(root, "out"), f"{name}-{os.path.basename(root)}"
    for i, batch in enumerate(batches):
        for stream, rows in batch.items():
            text = ", ".join(f"{f.split()[0]} string" for f in schemas[stream].split(", "))
            (spark.createDataFrame(rows, text).selectExpr(*[f"cast({f.split()[0]} as {f.split()[1]}) as {f.split()[0]}" for f in schemas[stream].split(", ")])
             .coalesce(1).write.mode("append").parquet(os.path.join(root, stream)))
        if restarts or i == len(batches) - 1:
            streams = {k: spark.readStream.schema(v).option("maxFilesPerTrigger", 1).parquet(os.path.join(root, k)) for k, v in schemas.items()}
            start_batches(build(streams), out, name, available_now=True).awaitTermination()
    return spark.read.parquet(out).drop("batch")


def _texts(df, columns, chunk):
    """Rows as texts, by the value of ``chunk``."""
    out = {}
    for r in df.select(*[F.col(c).cast("string") for c in columns], F.col(chunk).cast("string").alias("_c")).collect():
        out.setdefault(r["_c"], []).append(tuple(r)[:-1])
    return out


ORDERS = "order_id string, order_status string, purchase_ts timestamp_ntz, delivered_customer_ts timestamp_ntz, estimated_delivery_ts timestamp_ntz"
DELIVERIES = "order_id string, delivered_customer_ts timestamp_ntz"
# The test tables have numbers for ids.
NUMBERED = {k: v.replace("order_id string", "order_id bigint") for k, v in (("orders", ORDERS), ("deliveries", DELIVERIES))}
PAYMENTS = "order_id string, paid_ts timestamp_ntz, payment_installments int"


def _order(i, est, status="shipped", bought="2024-01-01 10:00:00"):
    return (i, status, bought, None, est)


def _overdue(streams):
    return overdue_stream(streams["orders"], streams["deliveries"])


@pytest.mark.parametrize("restarts", [True, False])
def test_overdue_orders(spark, restarts):
    root = _scratch(spark)
    batches = [
        {"orders": [_order("early", "2024-01-20 08:00:00"), _order("late", "2024-01-05 08:00:00")], "deliveries": [("other", "2024-01-02 00:00:00")]},
        {"deliveries": [("early", "2024-01-04 12:00:00")]},
        {"orders": [_order("open", "2024-01-06 23:00:00"), _order("gone", "2024-01-06 01:00:00", "canceled"), _order("none", None)]},
        # delivered on the last day before the second deadline, and out of order within the watermark
        {"deliveries": [("late", "2024-01-08 23:59:59"), ("just", "2024-01-08 05:00:00")], "orders": [_order("just", "2024-01-07 00:00:00", bought="2024-01-05 00:00:00")]},
        {"deliveries": [("other", "2024-01-12 00:00:01")], "orders": [_order("far", "2024-06-01 00:00:00")]},
        {"deliveries": [("other", "2024-01-12 00:00:02")], "orders": [_order("far2", "2024-06-01 00:00:00")]},
    ]
    events = _play(spark, root, {"orders": ORDERS, "deliveries": DELIVERIES}, batches, _overdue, "overdue", restarts)
    got = sorted((r["order_id"], r["alert_level"], str(r["due_ts"].date())) for r in events.collect())
    assert got == [("gone", "alert", "2024-01-08"), ("gone", "compensate", "2024-01-10"), ("late", "alert", "2024-01-07"),
                   ("open", "alert", "2024-01-08"), ("open", "compensate", "2024-01-10")]
    # Folded as of a day, they are the batch report of the same orders.
    orders = [r for b in batches for r in b.get("orders", [])]
    delivered = spark.createDataFrame([r for b in batches for r in b.get("deliveries", [])], "order_id string, d string").selectExpr("order_id", "cast(d as timestamp_ntz) as delivered_customer_ts")
    as_of = spark.sql("select timestamp_ntz'2024-01-11 00:00:00' as as_of")
    static = spark.createDataFrame(orders, "order_id string, order_status string, p string, d string, e string").selectExpr(
        "order_id", "order_status", "cast(e as timestamp_ntz) as estimated_delivery_ts").join(delivered, "order_id", "left")
    _same(current_alerts(events, delivered, as_of), delay_alerts(static, as_of))


def test_orders_sent_again_and_deliveries_too_late(spark):
    """A repeated order is one alert; a delivery behind the watermark changes nothing in the past."""
    root = _scratch(spark)
    batches = [
        {"orders": [_order("a", "2024-01-05 00:00:00"), _order("b", "2024-01-05 00:00:00")], "deliveries": [("x", "2024-01-02 00:00:00")]},
        {"orders": [_order("a", "2024-01-05 00:00:00")], "deliveries": [("b", "2024-01-06 10:00:00")]},
        {"deliveries": [("x", "2024-01-30 00:00:00")], "orders": [_order("far", "2024-06-01 00:00:00")]},
        {"deliveries": [("a", "2024-01-03 00:00:00"), ("x", "2024-01-30 00:00:00")], "orders": [_order("far", "2024-06-01 00:00:00")]},
    ]
    events = _play(spark, root, {"orders": ORDERS, "deliveries": DELIVERIES}, batches, _overdue, "overdue-again")
    assert {r["order_id"] for r in events.collect()} == {"a"}
    delivered = spark.createDataFrame([("b", "2024-01-06 10:00:00")], "order_id string, d string").selectExpr("order_id", "cast(d as timestamp_ntz) as delivered_customer_ts")
    rows = current_alerts(events, delivered, spark.sql("select timestamp_ntz'2024-01-29 00:00:00' as as_of")).collect()
    assert [(r["order_id"], r["overdue_days"], r["alert_level"], r["is_open"]) for r in rows] == [("a", 24, "compensate", 1)]


def test_orders_beyond_the_horizon_are_named(spark):
    rows = spark.createDataFrame([_order("a", "2024-01-05 00:00:00"), _order("b", "2026-01-05 00:00:00"), _order("c", None)],
                                 "order_id string, order_status string, purchase_ts string, d string, estimated_delivery_ts string")
    rows = rows.selectExpr("order_id", "order_status", "cast(purchase_ts as timestamp_ntz) as purchase_ts", "cast(estimated_delivery_ts as timestamp_ntz) as estimated_delivery_ts")
    assert [r["order_id"] for r in beyond_horizon(rows).collect()] == ["b"]


def test_overdue_stream_equals_batch(spark, fixture_tables):
    t = fixture_tables
    root = _scratch(spark)
    as_of = t.orders.agg(F.max("purchase_ts").alias("as_of"))
    last = as_of.first()[0]
    columns = [f.split()[0] for f in ORDERS.split(", ")]
    orders = _texts(t.orders.withColumn("c", F.year("purchase_ts")), columns, "c")
    deliveries = t.orders.filter("delivered_customer_ts is not null").select("order_id", "delivered_customer_ts")
    arrived = _texts(deliveries.withColumn("c", F.year("delivered_customer_ts")), ["order_id", "delivered_customer_ts"], "c")
    batches = [{k: v[y] for k, v in (("orders", orders), ("deliveries", arrived)) if y in v} for y in sorted({*orders, *arrived}) if y <= str(last.year)]
    # The clock stands at the as-of instant; deliveries after it are known to the batch report, but not to the stream.
    batches[-1]["deliveries"] = [r for r in batches[-1]["deliveries"] if r[1] <= str(last)]
    clock = [("-1", str(last + dt.timedelta(days=1)))]
    batches += [{"orders": [_order("-1", "2100-01-01 00:00:00", bought="2099-12-01 00:00:00")], "deliveries": clock}] * 2
    events = _play(spark, root, NUMBERED, batches, _overdue, "overdue-all", restarts=False)
    _same(current_alerts(events, deliveries, as_of), R["ext_delay_alerts"].run(t).filter(
        "is_open = 1 or date_add(estimated_delivery_ts, 2) <= (select max(purchase_ts) from o)".replace("(select max(purchase_ts) from o)", f"timestamp_ntz'{last}'")))


def _priority(streams):
    return installment_priority_stream(streams["orders"], streams["payments"])


def test_payments_before_after_and_in_parts(spark):
    root = _scratch(spark)
    done = [_order("end", "2024-09-01 00:00:00", bought="2024-06-01 00:00:00")], [("end", "2024-06-01 00:00:00", "1")]
    batches = [
        {"orders": [_order("after", "2024-01-09 00:00:00"), _order("parts", "2024-01-09 00:00:00")], "payments": [("before", "2024-01-01 09:00:00", "8")]},
        {"orders": [_order("before", "2024-01-09 00:00:00", bought="2024-01-02 10:00:00"), _order("few", "2024-01-09 00:00:00")],
         "payments": [("parts", "2024-01-02 00:00:00", "3"), ("few", "2024-01-03 00:00:00", "5")]},
        {"payments": [("after", "2024-01-04 00:00:00", "6"), ("parts", "2024-01-03 12:00:00", "7"), ("parts", "2024-01-04 00:00:00", "2")]},
        {"payments": [("nobody", "2024-01-05 00:00:00", "12")]},
        {"orders": done[0], "payments": done[1]}, {"orders": done[0], "payments": done[1]},
    ]
    got = _play(spark, root, {"orders": ORDERS, "payments": PAYMENTS}, batches, _priority, "priority")
    assert sorted((r["order_id"], r["max_installments"]) for r in got.collect()) == [("after", 6), ("before", 8), ("parts", 7)]


def test_installment_priority_stream_equals_batch(spark, fixture_tables):
    """Payments come up to three weeks after their order, or a day before it."""
    t = fixture_tables
    root = _scratch(spark)
    columns = [f.split()[0] for f in ORDERS.split(", ")]
    paid = t.payments.join(t.orders.select("order_id", "purchase_ts"), "order_id").withColumn(
        "paid_ts", F.col("purchase_ts") + F.make_dt_interval(F.pmod(F.xxhash64("order_id", "payment_type", "payment_installments"), F.lit(22)).cast("int") - 1))
    orders = _texts(t.orders.withColumn("c", F.year("purchase_ts")), columns, "c")
    payments = _texts(paid.withColumn("c", F.year("paid_ts")), ["order_id", "paid_ts", "payment_installments"], "c")
    batches = [{k: v[y] for k, v in (("orders", orders), ("payments", payments)) if y in v} for y in sorted({*orders, *payments})]
    batches += [{"orders": [_order("-1", None, bought="2100-01-01 00:00:00")], "payments": [("-1", "2100-01-01 00:00:00", "1")]}] * 2
    got = _play(spark, root, {"orders": NUMBERED["orders"], "payments": PAYMENTS.replace("order_id string", "order_id bigint")}, batches,
                lambda s: installment_priority_stream(s["orders"], s["payments"], watermark="2 days"), "priority-all", restarts=False)
    _same(got, R["ext_installment_priority"].run(t))


FLUSH = "2100-01-01"  # a day far ahead moves the watermark past everything before it


def _repeat(spark, root, rows, restarts=False, **options):
    """Alerts of (customer, day, day of arrival) rows, one file and micro-batch for each arrival."""
    src, out, name = os.path.join(root, "src"), os.path.join(root, "out"), f"repeat-{os.path.basename(root)}"
    arrivals = sorted({a for _, _, a in rows}) + ["flush"]
    for i, a in enumerate(arrivals):
        part = [(c, d) for c, d, x in rows if x == a] or [("nobody", FLUSH)]
        (spark.createDataFrame(part, "customer_unique_id string, d string")
         .selectExpr("customer_unique_id", "cast(d as timestamp_ntz) as review_created_ts")
         .coalesce(1).write.mode("append").parquet(src))
        if restarts or a == "flush":
            events = (spark.readStream.schema("customer_unique_id string, review_created_ts timestamp_ntz")
                      .option("maxFilesPerTrigger", 1).parquet(src))
            q = start_repeat_trigger(events, out, name, available_now=True, **options)
            q.awaitTermination()
    return sorted((r[0], r[1], r[2]) for r in spark.read.parquet(out).select("customer_unique_id", "alert_date", "detractor_reviews_12m").collect())


def _want(rows, window=365, threshold=2):
    days = sorted({(c, dt.date.fromisoformat(d)) for c, d, _ in rows})
    out = []
    for c, day in days:
        n = sum(x == c and 0 <= (day - dt.date.fromisoformat(d)).days < window for x, d, _ in rows)
        if n >= threshold:
            out.append((c, day, n))
    return out


def test_repeat_trigger_day_split_over_batches(spark):
    rows = [("a", "2024-01-01", 1), ("a", "2024-01-01", 2), ("a", "2024-01-01", 3), ("b", "2024-01-01", 1)]
    assert _repeat(spark, _scratch(spark), rows) == _want(rows) == [("a", dt.date(2024, 1, 1), 3)]


def test_repeat_trigger_out_of_order_and_restarts(spark):
    rows = [("a", "2023-06-01", 1), ("a", "2024-05-10", 2), ("a", "2024-05-02", 3), ("a", "2024-05-29", 3),
            ("b", "2024-05-05", 3), ("b", "2024-05-01", 4), ("c", "2024-05-20", 2), ("c", "2025-05-19", 5), ("c", "2025-05-20", 5)]
    assert _repeat(spark, _scratch(spark), rows, restarts=True, watermark="60 days") == _want(rows)


def test_repeat_trigger_stream_equals_batch(spark, fixture_tables):
    t = fixture_tables
    root = _scratch(spark)
    order_customers = t.orders.join(t.customers, "customer_id").select("order_id", "customer_unique_id")
    rows = detractor_events(t.reviews, order_customers).filter("customer_unique_id is not null").collect()
    rows = [(str(r[0]), str(r[1].date()), r[1].year) for r in rows]
    got = _repeat(spark, root, rows)
    want = R["ext_repeat_trigger_12m"].run(t).filter("customer_unique_id is not null").collect()
    assert got == sorted((str(r[0]), r[1], r[2]) for r in want) and got


def test_delay_alerts_parquet_sink(spark, fixture_tables):
    t = fixture_tables
    root = _scratch(spark)
    as_of = t.orders.agg(F.max("purchase_ts").alias("as_of"))
    stream = delay_alert_stream(_replay(spark, t.orders, "purchase_ts", root), as_of)
    out = os.path.join(root, "alerts")
    q = start_parquet_sink(stream, out, f"delay_sink_{os.path.basename(root).replace('-', '_')}")
    try:
        q.processAllAvailable()
    finally:
        q.stop()
    _same(spark.read.parquet(out), R["ext_delay_alerts"].run(t))
