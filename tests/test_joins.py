"""Skewed outer join and co-partitioned order tables."""

import glob
import json
import os
import subprocess
import sys
import tempfile
import textwrap
from collections import Counter

import pytest
from pyspark.sql import functions as F

from cxlens.operators.joins import heavy_keys, salted_left_join
from cxlens.plans.order_view import VIEW_COLUMNS, order_analysis
from cxlens.sources.bucketed import bucket_count, read_bucketed, single_file_buckets, write_bucketed

REPO = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))


def _rows(df):
    return Counter(tuple(r) for r in df.collect())


def _skewed(spark, n=6000):
    left = spark.range(1500).select(F.when(F.col("id") == 7, F.lit(None)).otherwise(F.col("id")).alias("k"), F.concat(F.lit("l"), "id").alias("l"))
    left = left.union(left.filter("k in (1, 3)"))  # repeated outer rows
    key = F.when(F.col("id") % 3 == 0, 1).when(F.col("id") % 5 == 0, 2).when(F.col("id") % 97 == 0, F.lit(None)).otherwise(F.pmod(F.col("id") * 31, F.lit(4000)))
    return left, spark.range(n).select(key.alias("k"), F.col("id").alias("r"), F.lit(True).alias("_flag"))


@pytest.mark.parametrize("parts", [1, 4, 50, 100_000])
def test_salted_left_join_equals_the_plain_one(spark, parts):
    left, right = _skewed(spark)
    got = salted_left_join(left, right, "k", parts)
    assert got.columns == left.join(right, "k", "left").columns
    assert _rows(got) == _rows(left.join(right, "k", "left"))


def test_empty_sides(spark):
    left, right = _skewed(spark)
    assert _rows(salted_left_join(left, right.limit(0), "k", 8)) == _rows(left.join(right.limit(0), "k", "left"))
    assert salted_left_join(left.limit(0), right, "k", 8).count() == 0


def test_heavy_keys_are_few(spark):
    _, right = _skewed(spark)
    got = {r["k"]: r["fanout"] for r in heavy_keys(right, "k", 30).collect()}
    assert set(got) == {1, 2} and len(got) <= 30 and got[1] >= 10


def test_salted_view_equals_the_view(spark, fixture_tables):
    t = fixture_tables
    hot = t.orders.agg(F.min("order_id")).first()[0]
    t = t.replace(reviews=t.reviews.withColumn("order_id", F.when(F.pmod(F.xxhash64("review_id"), F.lit(3)) == 0, F.lit(hot)).otherwise(F.col("order_id"))))
    assert _rows(order_analysis(t, salted=True)) == _rows(order_analysis(t))


def test_no_join_task_holds_the_hot_order(tmp_path):
    """One order with a third of all reviews: by the event log, no task of the join reads more than a tenth of the rows."""
    events = tempfile.mkdtemp(dir=tmp_path)
    job = textwrap.dedent(f"""
        from pyspark.sql import functions as F
        from cxlens.session import local_session
        from cxlens.operators.joins import salted_left_join
        spark = local_session(4, 32, extra={{"spark.eventLog.enabled": "true", "spark.eventLog.dir": "file://{events}", "spark.eventLog.compress": "false", "spark.eventLog.rolling.enabled": "false",
            "spark.sql.autoBroadcastJoinThreshold": "-1", "spark.sql.adaptive.coalescePartitions.enabled": "false"}})
        orders = spark.range(20000).select(F.col("id").alias("order_id"))
        reviews = spark.range(60000).select(F.when(F.col("id") % 3 == 0, 5).otherwise(F.pmod(F.col("id") * 7, F.lit(25000))).alias("order_id"), F.col("id").alias("review_id"))
        out = salted_left_join(orders, reviews, "order_id")
        spark.sparkContext.setJobDescription("salted")
        out.write.format("noop").mode("overwrite").save()
        spark.sparkContext.setJobDescription("plain")
        orders.join(reviews, "order_id", "left").write.format("noop").mode("overwrite").save()
        spark.stop()
    """)
    subprocess.run([sys.executable, "-c", job], check=True, cwd=REPO, timeout=300, env=os.environ | {"PYTHONPATH": REPO}, capture_output=True)
    stage_of, read = {}, {"salted": [], "plain": []}
    for line in open(glob.glob(f"{events}/*")[0]):
        e = json.loads(line)
        if e["Event"] == "SparkListenerJobStart":
            name = e["Properties"].get("spark.job.description")
            stage_of.update({s: name for s in e["Stage IDs"] if s not in stage_of})
        elif e["Event"] == "SparkListenerTaskEnd" and stage_of.get(e["Stage ID"]) in read:
            read[stage_of[e["Stage ID"]]].append(e["Task Metrics"]["Shuffle Read Metrics"]["Total Records Read"])
    assert max(read["plain"]) > 20000  # what the operator is for
    assert max(read["salted"]) <= 8000


@pytest.fixture(scope="module")
def bucketed(spark, fixture_tables):
    path = tempfile.mkdtemp(prefix="buckets-", dir=spark.conf.get("spark.checkpoint.dir")) + "/copy"
    write_bucketed(fixture_tables, path, 8, "cx_buckets")
    return path


def test_bucketed_view_equals_the_view_without_an_exchange(spark, fixture_tables, bucketed):
    t = read_bucketed(spark, bucketed, "cx_buckets", fixture_tables)
    keep = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")  # as if no table were small
    try:
        view = order_analysis(t)
        plan = view._jdf.queryExecution().executedPlan().toString()
        assert "Exchange" not in plan and "SortMergeJoin" in plan and "Bucketed: true" in plan
        assert view.columns == VIEW_COLUMNS
        assert _rows(view) == _rows(order_analysis(fixture_tables))
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", keep)


def test_a_copy_is_found_by_another_session(spark, fixture_tables, bucketed):
    assert single_file_buckets(spark, bucketed)
    t = read_bucketed(spark, bucketed, "cx_buckets_again", fixture_tables)
    assert _rows(t.payments) == _rows(fixture_tables.payments)
    assert "Bucketed: true" in t.payments.groupBy("order_id").count()._jdf.queryExecution().executedPlan().toString()


def test_an_incomplete_copy_is_refused(spark, fixture_tables, tmp_path):
    with pytest.raises(FileNotFoundError):
        read_bucketed(spark, str(tmp_path), "cx_none", fixture_tables)


def test_bucket_count():
    assert bucket_count(100 << 40, 8000) == 409_600 and bucket_count(1, 16) == 16
