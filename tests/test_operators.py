import datetime as dt
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from cxlens.operators import (event_sequence, exact_quantile, first_event_then_next,
                              running_share, share_of_total)


def test_share_of_total_sums_to_100(spark):
    df = spark.createDataFrame([("a", 1), ("b", 2), ("c", 3), ("a2", 7)], "k string, n long")
    out = share_of_total(df, "n", "pct").collect()
    assert abs(sum(r.pct for r in out) - 100) < 0.2
    within = share_of_total(df.withColumn("g", F.substring("k", 1, 1)), "n", "p", within=["g"])
    assert {r.k: r.p for r in within.collect()} == {"a": 12.5, "a2": 87.5, "b": 100.0, "c": 100.0}


def test_running_share_peers(spark):
    df = spark.createDataFrame([(1, 10), (2, 30), (3, 60)], "s int, n long")
    assert [r.c for r in running_share(df, "n", "s", "c").orderBy("s").collect()] == [10.0, 40.0, 100.0]


@pytest.mark.parametrize("q", [0.0, 0.1, 0.5, 0.9, 0.999, 1.0])
def test_exact_quantile_matches_numpy(spark, q):
    rng = random.Random(7)
    vals = [rng.choice([5, 5, 5, 17, 10**9]) if i % 3 == 0 else rng.randint(-1000, 10**6)
            for i in range(4001)]
    df = spark.createDataFrame([(v,) for v in vals] + [(None,)], "v long")
    got = exact_quantile(df, "v", q)
    assert got == pytest.approx(float(np.quantile(np.array(vals, dtype=np.float64), q)), rel=1e-12)


def test_exact_quantile_even_median_is_exact_midpoint(spark):
    df = spark.createDataFrame([(1,), (2,), (7,), (100,)], "v long")
    assert exact_quantile(df, "v", 0.5) == 4.5


def _brute_next(rows):
    out = {}
    for e in {r[0] for r in rows}:
        mine = [r for r in rows if r[0] == e]
        ev = [r[1] for r in mine if r[2]]
        if not ev:
            continue
        c = min(ev)
        later = [r[1] for r in mine if r[1] > c]
        out[e] = (c, min(later) if later else None)
    return out


def test_first_event_then_next_vs_brute_force(spark):
    rng = random.Random(3)
    base = dt.datetime(2024, 1, 1)
    rows = [(f"u{rng.randint(0, 40)}", base + dt.timedelta(days=rng.randint(0, 60)), rng.random() < 0.3)
            for _ in range(500)]
    # Hot entity, and a later order at the same timestamp as the complaint (not a return).
    rows += [("hot", base + dt.timedelta(days=i % 90), i % 7 == 0) for i in range(300)]
    rows += [("tie", base, True), ("tie", base, False)]
    df = spark.createDataFrame(rows, "e string, ts timestamp_ntz, ev boolean")
    got = {r.e: (r.event_ts, r.next_ts)
           for r in first_event_then_next(df, "e", "ts", F.col("ev")).collect()}
    assert got == _brute_next(rows)
    assert got["tie"] == (base, None)


def test_event_sequence_first_k_with_tiebreak(spark):
    rows = [("u1", 3, "c"), ("u1", 1, "a"), ("u1", 2, "b"), ("u1", 4, "d"), ("u2", 1, "z")]
    df = spark.createDataFrame(rows, "u string, t int, tag string")
    out = event_sequence(df, "u", ["t", "tag"], 3, "seq").collect()
    assert sorted((r.u, r.seq, r.tag) for r in out) == [
        ("u1", 1, "a"), ("u1", 2, "b"), ("u1", 3, "c"), ("u2", 1, "z")]


def test_with_quantile(spark):
    from cxlens.operators import with_quantile
    stats = spark.createDataFrame([(f"s{i}", i / 10.0) for i in range(11)] + [("n", None)], "k string, rate double")
    (p,) = {r.p for r in with_quantile(stats, "rate", 0.9, "p").collect()}
    assert p == pytest.approx(0.9)


@pytest.mark.parametrize("accuracy", [10, 10_000])
def test_exact_quantile_with_an_outlier(spark, monkeypatch, accuracy):
    """Outliers do no harm; a coarse sketch leaves many values in the bracket."""
    from cxlens.operators import quantiles
    monkeypatch.setattr(quantiles, "ACCURACY", accuracy)
    rng = np.random.default_rng(3)
    vals = [*rng.integers(0, 5_000_000, 3_000).tolist(), 10 ** 15, -(10 ** 15), (1 << 63) - 1, -(1 << 63)]
    df = spark.createDataFrame([(int(v),) for v in vals], "v bigint")
    for q in (0.0, 0.25, 0.9):
        a = sorted(vals)
        pos = (len(a) - 1) * q
        lo, hi = a[int(np.floor(pos))], a[int(np.ceil(pos))]
        assert quantiles.exact_quantile(df, "v", q) == pytest.approx(lo + (hi - lo) * (pos % 1), rel=1e-12)
    assert quantiles.exact_quantile(df.filter("false"), "v", 0.5) is None


@pytest.mark.parametrize("accuracy", [20, 10_000])
def test_exact_quantile_of_doubles(spark, monkeypatch, accuracy):
    from cxlens.operators import exact_quantile, quantiles
    monkeypatch.setattr(quantiles, "ACCURACY", accuracy)
    rng = np.random.default_rng(4)
    vals = np.concatenate([rng.random(5000), np.full(3000, 0.25), [0.0, 1.0, 0.25 + 2 ** -54, np.nextafter(0.25, 1)]])
    df = spark.createDataFrame([(float(v),) for v in vals], "v double")
    for q in (0.1, 0.3, 0.9):
        assert exact_quantile(df, "v", q) == pytest.approx(float(np.quantile(vals, q)), abs=1e-15)


def test_next_event_of_a_hot_entity_is_split(spark, tmp_path):
    """90% of the rows in one key: no task of the join reads most of them (from Spark's own counts)."""
    from cxlens.operators import first_event_then_next
    rows = spark.range(20_000).selectExpr("if(id % 10 = 0, id, 0) as u", "id as t", "id = 70 or id % 900 = 0 as e")
    out = first_event_then_next(rows, "u", "t", F.col("e"), "e0", "n0", salts=16)
    got = {r.u: (r.e0, r.n0) for r in out.collect()}
    assert got[0] == (0, 1) and got[70] == (70, None)
    salted = rows.select("u", F.pmod(F.xxhash64("t"), F.lit(16)).alias("s")).groupBy("u", "s").count().agg(F.max("count")).first()[0]
    assert salted < 18_000 / 16 * 1.3


def test_rate_table(spark):
    from cxlens.operators import rate_table
    df = spark.createDataFrame([("a", 1), ("a", 3), ("b", 5)], "k string, v int")
    assert [tuple(r) for r in rate_table(df, ["k"], 2, "n", [F.sum("v").alias("s")]).collect()] == [("a", 2, 4)]


def test_fk_orphans_counts_rows(spark):
    from cxlens.operators import fk_orphans
    child = spark.createDataFrame([(1,), (1,), (2,), (None,), (9,), (9,)], "k int")
    parent = spark.createDataFrame([(1,), (2,)], "id int")
    assert fk_orphans(child, "k", parent, "id", "n").first()[0] == 3
    assert fk_orphans(child.filter("false"), "k", parent, "id", "n").first()[0] == 0


@pytest.mark.parametrize("q", [0.0, 0.1, 0.5, 0.9, 0.999, 1.0])
def test_quantile_of_every_group(spark, q):
    """Groups of one value, of two, of ties over a third of the rows, of 40,000 values, and a null group."""
    from cxlens.operators import quantile_rows
    rng = np.random.default_rng(5)
    groups = {"one": [3.5], "two": [1.0, 2.0], "ties": [7.0] * 500 + rng.random(1000).tolist(), "many": rng.normal(size=40_000).tolist(), None: [4.0, 9.0, 1.0], "few": rng.random(7).tolist()}
    import pandas as pd
    frame = pd.DataFrame([(g, v) for g, vs in groups.items() for v in vs], columns=["g", "v"])
    df = spark.createDataFrame(frame, "g string, v double").union(spark.createDataFrame([("none", None), ("one", None)], "g string, v double"))
    got = {r["g"]: r["quantile"] for r in quantile_rows(df, "v", q, ["g"]).collect()}
    assert set(got) == set(groups)
    for g, vs in groups.items():
        assert got[g] == pytest.approx(float(np.quantile(vs, q)), rel=1e-12, abs=1e-15), g


def test_quantiles_run_no_job_when_built(spark):
    from cxlens.operators import with_quantile
    df = spark.range(1000).withColumn("v", F.raise_error(F.lit("evaluated")).cast("double"))
    with_quantile(df, "v", 0.9, "p")  # would fail if it read a row


def test_percentile_cohort(spark):
    from cxlens.operators import percentile_cohort
    rows = [(f"s{i}", f"r{i % 2}", float(j < i)) for i in range(10) for j in range(10)] + [("few", "r0", 1.0)]
    df = spark.createDataFrame(rows, "seller string, region string, bad double")
    got = {r["seller"]: (r["rows"], r["rate"], r["cohort"]) for r in percentile_cohort(df, "seller", F.avg("bad").alias("rate"), 0.9, min_rows=5).collect()}
    assert len(got) == 10 and {k for k, v in got.items() if v[2] == "problem"} == {"s9"}  # P90 is 0.81
    two = percentile_cohort(df, ["seller", "region"], F.avg("bad").alias("rate"), 0.5, labels=("high", "low"), out="half")
    assert two.columns == ["seller", "region", "rows", "rate", "half"] and two.filter("half = 'high'").count() == 6


@pytest.mark.parametrize("bucket", [3600, 86_400, 10**9])
@pytest.mark.parametrize("strict", [True, False])
def test_next_event_of_every_row(spark, bucket, strict):
    """A hot entity, ties between rows and events, buckets without events, entities without events, and nulls."""
    from cxlens.operators import next_event
    rng = random.Random(11)
    base = dt.datetime(2024, 1, 1)

    def some(n, entities):
        return [(rng.choice(entities), base + dt.timedelta(hours=rng.randint(0, 2000) // 3 * 3)) for _ in range(n)]

    rows = some(900, ["hot"] * 6 + ["a", "b", "c", "rows only"]) + [(None, base), ("hot", None), ("a", base), ("a", base)]
    events = some(120, ["hot"] * 3 + ["a", "b", "events only"]) + [(None, base), ("hot", None), ("a", base + dt.timedelta(days=500)), ("a", base + dt.timedelta(days=500))]
    got = next_event(spark.createDataFrame(rows, "k string, t timestamp_ntz"), spark.createDataFrame(events, "k string, at timestamp_ntz"),
                     "k", "t", "at", "n", bucket, strict).collect()

    def brute(k, t):
        later = [x for e, x in events if e is not None and e == k and x is not None and t is not None and (x > t if strict else x >= t)]
        return min(later, default=None)

    key = lambda r: tuple((x is None, str(x)) for x in r)
    assert sorted([tuple(r) for r in got], key=key) == sorted([(k, t, brute(k, t)) for k, t in rows], key=key)


def test_next_event_holds_buckets_not_entities(spark):
    """One entity with all rows: no window partition is larger than its times of a day, or its days."""
    from cxlens.operators import next_event
    rows = spark.range(50_000).select(F.lit("hot").alias("k"), (F.timestamp_seconds(F.col("id") * 600)).cast("timestamp_ntz").alias("t"))
    out = next_event(rows, rows, "k", "t", "t")
    plan = out._jdf.queryExecution().optimizedPlan().toString()
    assert "_b" in plan and out.filter("next_ts = t + INTERVAL 600 SECONDS").count() == 49_999
    assert rows.groupBy("k", F.to_date("t")).count().agg(F.max("count")).first()[0] == 144


def test_running_total_of_a_large_domain(spark):
    """10^6 rows, a tie over a third of them and nulls, against DuckDB; every range has a share of the rows, and no exchange has one task."""
    import duckdb
    from cxlens.operators import running_total
    df = spark.range(1_000_000).select(
        F.when(F.col("id") % 3 == 0, 77).when(F.col("id") % 1000 == 1, F.lit(None)).otherwise(F.pmod(F.xxhash64("id"), F.lit(900_000))).alias("k"),
        F.when(F.col("id") % 7 == 0, F.lit(None)).otherwise(F.col("id") % 100).cast("decimal(18,2)").alias("v"))
    out = running_total(df, "k", {"n": F.lit(1), "v": F.col("v")}, parts=16)
    initial = out._jdf.queryExecution().executedPlan().toString()
    assert "SinglePartition" not in initial
    con = duckdb.connect()
    con.register("got", out.toArrow())
    con.register("src", df.toArrow())
    con.execute("""CREATE TABLE want AS SELECT k, n, v, SUM(n) OVER w AS running_n, COALESCE(SUM(v) OVER w, 0) AS running_v
                   FROM (SELECT k, COUNT(*) AS n, SUM(v) AS v FROM src GROUP BY k) WINDOW w AS (ORDER BY k NULLS LAST)""")
    n_got, n_want, n_diff = con.execute("""SELECT (SELECT COUNT(*) FROM got), (SELECT COUNT(*) FROM want),
        (SELECT COUNT(*) FROM (SELECT k, n, v, running_n, running_v FROM got EXCEPT SELECT k, n, v, running_n, running_v FROM want))""").fetchall()[0]
    assert n_got == n_want > 400_000 and n_diff == 0


def test_running_total_of_nothing(spark):
    from cxlens.operators import running_total
    assert running_total(spark.range(0), "id", {"n": F.lit(1)}).count() == 0


def test_fk_audit_scans_each_table_once(spark, tmp_path):
    from cxlens.operators import fk_audit
    frames = {"items": [(1, "p"), (2, "q"), (2, None), (9, "z"), (9, "z")], "reviews": [(1, "x"), (None, "x")], "orders": [(1, ""), (2, "")], "products": [(0, "p"), (0, "q")], "none": []}
    tables = {}
    for name, rows in frames.items():
        spark.createDataFrame(rows, "id long, text string").coalesce(1).write.parquet(str(tmp_path / name))
        tables[name] = spark.read.parquet(str(tmp_path / name))
    edges = [("items-orders", "items", "id", "orders", "id"), ("items-products", "items", "text", "products", "text"),
             ("reviews-orders", "reviews", "id", "orders", "id"), ("none-orders", "none", "id", "orders", "id")]
    out = fk_audit(tables, edges, "edge", "orphans")
    assert [tuple(r) for r in out.collect()] == [("items-orders", 2), ("items-products", 3), ("reviews-orders", 1), ("none-orders", 0)]
    assert out._jdf.queryExecution().optimizedPlan().toString().count("Relation ") == 5  # five tables, once each


def test_relative_hotspots_of_any_key(spark):
    from cxlens.operators import relative_hotspots
    rows = [("A", 1, int(i < 40)) for i in range(100)] + [("B", 1, 0)] * 400 + [("C", 2, int(i < 20)) for i in range(100)] + [("D", 2, 1)] * 5 + [("C", 2, None)] * 10
    df = spark.createDataFrame(rows, "state string, area int, late int")
    got = {r["state"]: (r["rows"], r["cohort"]) for r in relative_hotspots(df, "state", "late", min_rows=50, factor=1.8).collect()}
    assert got == {"A": (100, "hotspot"), "B": (400, "standard"), "C": (110, "hotspot")}  # overall 65 of 605, small D included
    two = relative_hotspots(df, ["area", "state"], F.col("late"), aggregates=[F.max("late").alias("worst")], labels=("hot", "cold"), out="kind")
    assert two.columns == ["area", "state", "rows", "worst", "rate", "overall_rate", "kind"]
