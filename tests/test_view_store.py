"""Incremental view: the rows of a full rebuild, only the months touched rewritten."""

import tempfile
from collections import Counter

import pytest
from pyspark.sql import functions as F

from cxlens.plans.order_view import VIEW_COLUMNS, order_analysis
from cxlens.plans.view_store import NO_MONTH, ViewStore


def _rows(df):
    return Counter(tuple(r) for r in df.select(*VIEW_COLUMNS).collect())


@pytest.fixture(scope="module")
def tables(spark, fixture_tables):
    """The fixture tables, held so that each refresh reads them cheaply."""
    return fixture_tables.replace(**{n: fixture_tables[n].cache() for n in fixture_tables})


@pytest.fixture(scope="module")
def store(spark, tables):
    s = ViewStore(spark, tempfile.mkdtemp(prefix="view-", dir=spark.conf.get("spark.checkpoint.dir")))
    s.refresh(tables)
    return s


def _month(t, order_id):
    return t.orders.filter(F.col("order_id") == order_id).select(F.date_format("purchase_ts", "yyyy-MM")).first()[0]


def test_first_build_and_no_change(store, tables):
    assert _rows(store.read()) == _rows(order_analysis(tables))
    before = store.months()
    again = store.refresh(tables)
    assert (again.rebuilt, again.dropped) == ([], []) and store.months() == before and len(before) > 50


def test_changes_additions_and_removals(spark, store, tables):
    t = tables
    ids = [r[0] for r in t.orders.filter("delivered_customer_ts is not null").select("order_id").orderBy("order_id").limit(400).collect()]
    reviewed = t.reviews.filter("order_id > 0 and review_score <= 2").orderBy("order_id").first()["order_id"]
    status, gone, paid, moved = ids[10], ids[150], ids[250], ids[350]
    col = F.col("order_id")
    orders = (t.orders.filter(col != gone).withColumn("order_status", F.when(col == status, "returned").otherwise(F.col("order_status")))
              .withColumn("purchase_ts", F.when(col == moved, F.lit("2031-03-05 10:00:00").cast("timestamp_ntz")).otherwise(F.col("purchase_ts"))))
    new = orders.filter(col == status).withColumn("order_id", F.lit(-5).cast("long")).withColumn("purchase_ts", F.lit(None).cast("timestamp_ntz"))
    payments = t.payments.union(t.payments.limit(1).withColumn("order_id", F.lit(paid)).withColumn("payment_installments", F.lit(24).cast(t.payments.schema["payment_installments"].dataType)))
    reviews = t.reviews.withColumn("review_message", F.when(col == reviewed, "changed: fell apart").otherwise(F.col("review_message")))
    u = t.replace(orders=orders.unionByName(new), payments=payments.select(t.payments.columns), reviews=reviews)
    before = store.months()
    done = store.refresh(u)
    assert _rows(store.read()) == _rows(order_analysis(u))
    assert set(done.rebuilt) == {_month(t, x) for x in (status, gone, paid, moved, reviewed)} | {"2031-03", NO_MONTH}
    after = store.months()
    assert {m: p for m, p in after.items() if m not in done.rebuilt} == {m: p for m, p in before.items() if m not in done.rebuilt}
    assert all(after[m] != before.get(m) for m in done.rebuilt)
    # And back: the months that only the changed tables had go.
    back = store.refresh(t)
    assert back.dropped == ["2031-03", NO_MONTH] and _rows(store.read()) == _rows(order_analysis(t))


def test_a_dimension_change_touches_its_orders(spark, store, tables):
    t = tables
    some = t.customers.orderBy("customer_id").first()["customer_id"]
    u = t.replace(customers=t.customers.withColumn("customer_state", F.when(F.col("customer_id") == some, "ZZ").otherwise(F.col("customer_state"))))
    done = store.refresh(u)
    want = {r[0] for r in t.orders.filter(F.col("customer_id") == some).select(F.date_format("purchase_ts", "yyyy-MM")).collect()}
    assert set(done.rebuilt) == want and _rows(store.read()) == _rows(order_analysis(u))
    store.refresh(t)


def test_a_failed_refresh_leaves_the_old_view(spark, store, tables):
    t = tables
    want, broken = _rows(store.read()), t.replace(orders=t.orders.withColumn("order_status", F.lit("x")))
    write, store._write = store._write, None
    try:
        with pytest.raises(TypeError):
            store.refresh(broken)
    finally:
        store._write = write
    assert _rows(store.read()) == want


def test_empty_tables(spark, tables):
    s = ViewStore(spark, tempfile.mkdtemp(prefix="view-", dir=spark.conf.get("spark.checkpoint.dir")))
    with pytest.raises(FileNotFoundError):
        s.read()
    s.refresh(tables.replace(orders=tables.orders.limit(0)))
    assert s.read().count() == 0 and s.read().columns == VIEW_COLUMNS
