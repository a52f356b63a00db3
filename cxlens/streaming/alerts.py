"""Streaming versions of the alerting rules (Structured Streaming).

All state is that of built-in operators, kept under a watermark and dropped
behind it; batches may split, repeat or reorder rows within the watermark, and a
restart goes on from the checkpoint under ``spark.checkpoint.dir``.

* ``overdue_stream``: orders and deliveries in, one event out for each order
  and alert level whose deadline passes without a delivery. A left-outer
  stream-stream join: an order waits in the state until the watermark passes
  its deadline; the unmatched side that comes out then is the alert.
  ``current_alerts`` folds the events into the rows of the batch report.
* ``installment_priority_stream``: orders and payments in. The two streams are
  joined within the days in which a payment may come, before or after its order; the
  payments of an order are then summed up in a second stateful operator, which hands
  the order on once, when no more of them can come.
* ``start_repeat_trigger``: detractor reviews in, (customer, day) alerts out
  when a customer reaches the threshold within the trailing window. Detractors
  are counted per customer and day in a watermarked aggregate, which emits a day
  once, when no more of it can come; a stream-stream join then pairs the day with
  the customer's days of the trailing window (at most ``window_days`` each). All
  partners of a day are final with it, so each micro-batch holds complete sums.
* ``delay_alert_stream``: the stateless projection of order snapshots that already
  carry their delivery, with the as-of instant from a one-row static frame.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cxlens.plans.extensions import (ALERT_DAYS, COMPENSATE_DAYS, MIN_INSTALLMENTS, REPEAT_WINDOW_DAYS,
                                     delay_alerts, priority_row)

#: Days from purchase to the last deadline within which an order can be followed.
HORIZON_DAYS = 365


def delay_alert_stream(orders: DataFrame, as_of: DataFrame, alert_days: int = ALERT_DAYS,
                       compensate_days: int = COMPENSATE_DAYS) -> DataFrame:
    return delay_alerts(orders, as_of, alert_days, compensate_days)


def _zoned(ts: str) -> Column:
    """Event time: watermarks need a zoned timestamp; the session zone is UTC, so instants keep their days."""
    return F.col(ts).cast("timestamp")


def _deadline(days: Column) -> Column:
    """The first instant that is ``days`` days overdue."""
    return F.date_trunc("day", _zoned("estimated_delivery_ts")) + F.make_dt_interval(days)


def beyond_horizon(orders: DataFrame, compensate_days: int = COMPENSATE_DAYS, horizon_days: int = HORIZON_DAYS) -> DataFrame:
    """Orders that ``overdue_stream`` does not follow: promised so late that their state would outlive the horizon."""
    return orders.filter(_deadline(F.lit(compensate_days)) > _zoned("purchase_ts") + F.make_dt_interval(F.lit(horizon_days)))


def overdue_stream(orders: DataFrame, deliveries: DataFrame, watermark: str = "1 day", alert_days: int = ALERT_DAYS,
                   compensate_days: int = COMPENSATE_DAYS, horizon_days: int = HORIZON_DAYS) -> DataFrame:
    """Events (order_id, estimated_delivery_ts, order_status, alert_level, due_ts) of orders not delivered in time.

    ``orders``: a stream of order rows, with any or no delivery time, which is not read. ``deliveries``: a stream of
    (order_id, delivered_customer_ts). An event comes when the watermark, the lesser of both
    streams', reaches the deadline; rows behind the watermark are late and dropped by Spark. Orders without an
    estimate cannot be overdue. Orders promised beyond the horizon (``beyond_horizon``) are left out: a
    delivery is kept in the state for ``horizon_days`` only. An order sent twice gives its events twice; ``current_alerts`` takes them once.
    """
    levels = F.array(F.struct(F.lit("alert").alias("alert_level"), F.lit(alert_days).alias("days")),
                     F.struct(F.lit("compensate").alias("alert_level"), F.lit(compensate_days).alias("days")))
    due = (orders.filter(F.col("estimated_delivery_ts").isNotNull())
           .filter(F.coalesce(_deadline(F.lit(compensate_days)) <= _zoned("purchase_ts") + F.make_dt_interval(F.lit(horizon_days)), F.lit(True)))
           .select("order_id", "estimated_delivery_ts", "order_status", F.explode(levels).alias("l"))
           .select("order_id", "estimated_delivery_ts", "order_status", "l.alert_level", _deadline(F.col("l.days")).alias("due_ts"))
           .withWatermark("due_ts", watermark))
    done = (deliveries.filter(F.col("delivered_customer_ts").isNotNull())
            .select(F.col("order_id").alias("done_id"), _zoned("delivered_customer_ts").alias("done_ts"))
            .withWatermark("done_ts", watermark))
    met = due.join(done, F.expr(f"""order_id = done_id AND done_ts < due_ts AND done_ts >= due_ts - INTERVAL {horizon_days} DAYS"""), "left_outer")
    return met.filter("done_id IS NULL").drop("done_id", "done_ts")


def current_alerts(events: DataFrame, deliveries: DataFrame, as_of: DataFrame, alert_days: int = ALERT_DAYS,
                   compensate_days: int = COMPENSATE_DAYS) -> DataFrame:
    """The batch report's rows from the events written so far (static frames).

    An order counts once however often its events were sent. Orders delivered since carry their delivery;
    canceled ones stay only if they were delivered, late.
    """
    orders = events.groupBy("order_id", "estimated_delivery_ts").agg(F.max("order_status").alias("order_status"))
    delivered = deliveries.groupBy("order_id").agg(F.min("delivered_customer_ts").alias("delivered_customer_ts"))
    return delay_alerts(orders.join(delivered, "order_id", "left"), as_of, alert_days, compensate_days)


def installment_priority_stream(orders: DataFrame, payments: DataFrame, watermark: str = "1 day", days_before: int = 7,
                                days_after: int = 30, min_installments: int = MIN_INSTALLMENTS) -> DataFrame:
    """Orders with ``min_installments`` or more, each once, when its payments are complete.

    ``payments``: a stream of (order_id, paid_ts, payment_installments). A payment counts from
    ``days_before`` days before its order's purchase to ``days_after`` days after it; the order comes out when the watermark has
    passed that, so payments that follow their order, precede it or come in several batches give the rows of the
    batch report. Orders without a purchase time are not followed.
    """
    placed = (orders.filter(F.col("purchase_ts").isNotNull())
              .select(F.struct(*[F.col(c) for c in orders.columns]).alias("o"), _zoned("purchase_ts").alias("order_ts"))
              .withWatermark("order_ts", watermark))
    paid = (payments.select(F.col("order_id").alias("paid_id"), "payment_installments", _zoned("paid_ts").alias("pay_ts"))
            .filter(F.col("pay_ts").isNotNull()).withWatermark("pay_ts", watermark))
    met = placed.join(paid, F.expr(f"""o.order_id = paid_id AND pay_ts >= order_ts - INTERVAL {days_before} DAYS
        AND pay_ts <= order_ts + INTERVAL {days_after} DAYS"""))
    sums = met.select("o", "order_ts", "payment_installments").groupBy("o", "order_ts").agg(F.max("payment_installments").alias("max_installments"))
    return priority_row(sums.filter(F.col("max_installments") >= min_installments).select("o.*", "max_installments"))


def start_batches(stream: DataFrame, path: str, name: str, available_now: bool = False):
    """Write each micro-batch of a stream to ``path/batch=<id>``.

    A batch that runs again after a failure replaces its own folder, so every
    row is there exactly once. The checkpoint lies under ``spark.checkpoint.dir``.
    """
    def write(rows: DataFrame, batch: int) -> None:
        rows.write.mode("overwrite").parquet(f"{path.rstrip('/')}/batch={batch}")

    return _start(stream.writeStream.foreachBatch(write), stream, name, available_now)


def _start(writer, stream: DataFrame, name: str, available_now: bool):
    from cxlens.session import ensure_checkpoint_dir
    ckpt = f"{ensure_checkpoint_dir(stream.sparkSession).rstrip('/')}/streams/{name}"
    w = writer.outputMode("append").queryName(name).option("checkpointLocation", ckpt)
    return (w.trigger(availableNow=True) if available_now else w).start()


def detractor_events(reviews: DataFrame, order_customers: DataFrame) -> DataFrame:
    """Detractor reviews (stream) tagged with the buying customer (static lookup)."""
    return (reviews.filter(F.col("review_score") <= 2)
            .join(order_customers.select("order_id", "customer_unique_id"), "order_id", "left")
            .select("customer_unique_id", "review_created_ts"))


def daily_detractors(events: DataFrame, watermark: str) -> DataFrame:
    """(customer_unique_id, day, n) of a (customer_unique_id, review_created_ts) stream, each day once."""
    # Watermarks need a zoned timestamp; the session zone is UTC, so days keep their bounds.
    daily = (events.filter(F.col("review_created_ts").isNotNull() & F.col("customer_unique_id").isNotNull())
             .withColumn("event_ts", F.col("review_created_ts").cast("timestamp"))
             .withWatermark("event_ts", watermark)
             .groupBy("customer_unique_id", F.window("event_ts", "1 day").alias("w"))
             .agg(F.count(F.lit(1)).alias("n")))
    return daily.select("customer_unique_id", F.window_time("w").alias("day"), "n")


def repeat_pairs_stream(events: DataFrame, window_days: int = REPEAT_WINDOW_DAYS,
                        watermark: str = "30 days") -> DataFrame:
    """Each day of a customer with each of the customer's days in the trailing window.

    The second side reads the stream again; both take their watermark from the
    same rows.
    """
    days = daily_detractors(events, watermark)
    left = days.toDF("customer", "day", "own")
    right = days.toDF("other_customer", "other_day", "n")
    return left.join(right, F.expr(f"""customer = other_customer AND other_day <= day
        AND other_day > day - INTERVAL {window_days} DAYS""")).select("customer", "day", "n")


def repeat_alerts(pairs: DataFrame, threshold: int = 2) -> DataFrame:
    """Alerts of one micro-batch of pairs; it holds every partner of its days."""
    return (pairs.groupBy("customer", "day").agg(F.sum("n").alias("detractor_reviews_12m"))
            .filter(F.col("detractor_reviews_12m") >= threshold)
            .select(F.col("customer").alias("customer_unique_id"), F.to_date("day").alias("alert_date"),
                    "detractor_reviews_12m"))


def start_repeat_trigger(events: DataFrame, path: str, name: str, window_days: int = REPEAT_WINDOW_DAYS,
                         threshold: int = 2, watermark: str = "30 days", available_now: bool = False):
    """Write the alerts of each micro-batch to ``path/batch=<id>``.

    A batch that runs again after a failure replaces its own folder, so every
    alert is there exactly once. The checkpoint lies under ``spark.checkpoint.dir``.
    """
    def write(pairs: DataFrame, batch: int) -> None:
        repeat_alerts(pairs, threshold).write.mode("overwrite").parquet(f"{path.rstrip('/')}/batch={batch}")

    pairs = repeat_pairs_stream(events, window_days, watermark)
    return _start(pairs.writeStream.foreachBatch(write), pairs, name, available_now)


def start_parquet_sink(alerts: DataFrame, path: str, name: str,
                       trigger_seconds: int | None = None):
    """Append an alert stream to Parquet (exactly-once file sink).

    The checkpoint lives under ``spark.checkpoint.dir`` (a shared folder on a
    cluster), so a restarted query resumes where it stopped.
    """
    from cxlens.session import ensure_checkpoint_dir
    ckpt = f"{ensure_checkpoint_dir(alerts.sparkSession).rstrip('/')}/streams/{name}"
    w = (alerts.writeStream.format("parquet").outputMode("append").queryName(name)
         .option("path", path).option("checkpointLocation", ckpt))
    if trigger_seconds:
        w = w.trigger(processingTime=f"{trigger_seconds} seconds")
    return w.start()
