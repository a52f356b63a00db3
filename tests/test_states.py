"""Reports merged from stored daily states equal the direct ones."""

import datetime as dt
import tempfile

import pytest
from pyspark.sql import functions as F

from cxlens.operators.states import StateStore, count_ids, id_sets
from cxlens.plans import all_reports
from cxlens.plans import daily_states as S

R = all_reports()


def _same(a, b):
    cols = sorted(a.columns)
    assert sorted(b.columns) == cols
    key = lambda r: tuple((v is None, str(v)) for v in r)
    ra, rb = (sorted((tuple(r) for r in x.select(cols).collect()), key=key) for x in (a, b))
    assert ra == rb and ra


def _store(spark):
    return StateStore(spark, tempfile.mkdtemp(prefix="states-", dir=spark.conf.get("spark.checkpoint.dir")))


def _days(states):
    return [r[0] for r in states.select("day").distinct().collect()]


def _check(t, orders, late):
    _same(S.date_coverage(orders.read()), R["dq_date_coverage"].run(t))
    _same(S.review_coverage(orders.read()), R["dq_review_coverage"].run(t))
    _same(S.late_trend(late.read()), R["late_monthly_trend"].run(t))


def test_reports_from_states_equal_the_direct_ones(spark, fixture_tables):
    """Built in two halves, then with some days computed again after their orders changed."""
    t = fixture_tables
    stores = _store(spark), _store(spark)
    for store, build in zip(stores, (S.order_states, S.late_states)):
        states = build(t).cache()
        days = sorted(_days(states), key=str)
        store.commit(states, days[:len(days) // 2])
        store.commit(states, days[len(days) // 2:])
    _check(t, *stores)
    # Orders of one day change their status, another day loses all of its orders.
    day, gone = [r[0] for r in t.orders.select(F.to_date("purchase_ts")).distinct().orderBy(F.to_date("purchase_ts")).limit(30).collect()][10:12]
    on = F.to_date("purchase_ts")
    u = t.replace(orders=t.orders.filter(on.isNull() | (on != gone)).withColumn("order_status", F.when(on == day, "lost").otherwise(F.col("order_status"))))
    for store, build in zip(stores, (S.order_states, S.late_states)):
        store.commit(build(u), [day, gone])
    _check(u, *stores)


def test_an_uncommitted_part_does_not_count(spark, fixture_tables):
    store = _store(spark)
    with pytest.raises(FileNotFoundError):
        store.read()
    states = S.late_states(fixture_tables)
    day = next(d for d in _days(states) if d is not None)
    store.commit(states, [day])
    states.write.parquet(f"{store.path}/parts/unfinished/rows")
    assert {r["day"] for r in store.read().collect()} == {day}


def test_sets_of_ids(spark):
    rows = [(d, i) for d in range(4) for i in range(0, 100_000, 7 + d)] + [(0, None), (1, 0), (1, 0), (2, 5_000_000_000)]
    df = spark.createDataFrame(rows, "day int, id long")
    sets = id_sets(df, ["day"], "id", {"all": F.lit(True), "even": F.col("id") % 2 == 0})
    ids = {i for _, i in rows if i is not None}
    assert tuple(count_ids(sets, [], ["all", "even"]).first()) == (len(ids), sum(i % 2 == 0 for i in ids))
    per = {r["day"]: r["all"] for r in count_ids(sets, ["day"], ["all"]).collect()}
    assert per == {d: len({i for x, i in rows if x == d and i is not None}) for d in range(4)}
    assert sets.agg(F.max(F.length("all"))).first()[0] <= 4096  # bytes of a bitmap, however many ids


def test_no_date_but_dates(spark):
    """Days are dates; rows without one are a day of their own."""
    store = _store(spark)
    df = spark.createDataFrame([(dt.date(2024, 1, 1), 5), (None, 7)], "day date, n int")
    store.commit(df, [None])
    assert [tuple(r) for r in store.read().collect()] == [(None, 7)]
    store.commit(df.withColumn("n", F.col("n") + 1), [dt.date(2024, 1, 1), None])
    assert sorted(r["n"] for r in store.read().collect()) == [6, 8]
