"""Quality cascade and extendible-hash sharding."""

from collections import Counter

import pytest
from pyspark.sql import functions as F

from cxlens.llm import quality, sharding
from tests.llm import brute, odd


def plan(df):
    return df._jdf.queryExecution().toString()


def test_quality_equals_brute_force(spark):
    rows = odd.texts()
    got = quality.quality_report(odd.frame(spark, rows)).collect()
    assert len(got) == len(rows)
    want = brute.quality([(i, t) for i, (_, t) in enumerate(rows)])
    assert Counter((r["n_words"], r["word_chars"], r["n_symbols"], r["n_dup_lines"], r["n_repeat_words"], r["base_failed"]) for r in got) == Counter(want.values())
    assert all(not r["kept"] for r in got if r["base_failed"])


def test_quality_order_does_not_change_the_verdict(spark):
    df = odd.frame(spark)
    results = []
    for rules in (quality.RULES, quality.RULES[::-1]):
        results.append(Counter(r["kept"] for r in df.select(quality.cascade(rules, F.col("text")).alias("kept")).collect()))
    assert results[0] == results[1]


def test_quality_orders_by_rejection_per_cost():
    a, b, c = (quality.Rule(n, None) for n in "abc")
    assert quality.ordered([(a, 1.0, 0.1), (b, 0.1, 0.05), (c, 1.0, 0.0)]) == [b, a, c]


def test_quality_keeps_columns_and_clean_text(spark):
    kept = quality.keep_documents(odd.frame(spark))
    assert kept.columns == odd.frame(spark).columns
    ids = [r["doc_id"] for r in kept.select("doc_id").collect()]
    assert ids.count(1) == 1 and ids.count(2) == 2 and 4 not in ids and 20 not in ids


@pytest.mark.parametrize("run", [quality.quality_report, lambda d: sharding.shard_documents(d, 100)])
def test_empty_table(spark, run):
    assert run(odd.frame(spark, [])).count() == 0


def test_native_plans_run_no_python(spark):
    df = odd.frame(spark)
    for out in (quality.quality_report(df), quality.keep_documents(df), sharding.shard_documents(df, 2000)):
        assert not any(w in plan(out) for w in ("Python", "Arrow", "Pandas"))


@pytest.mark.parametrize("limit", [1, 300, 5000, 1 << 30])
def test_shards_fit_their_limit(spark, limit):
    rows = odd.texts()
    got = sharding.shard_documents(odd.frame(spark, rows), limit).collect()
    assert Counter((r["doc_id"], r["n_bytes"]) for r in got) == Counter((d, len((t or "").encode())) for d, t in rows)
    size, docs = Counter(), Counter()
    for r in got:
        size[r["shard"]] += r["n_bytes"]
        docs[r["shard"]] += 1
    for r in got:
        assert (r["shard_bytes"], r["shard_docs"], r["depth"]) == (size[r["shard"]], docs[r["shard"]], len(r["shard"]))
        assert r["oversize"] == (size[r["shard"]] > limit) and (size[r["shard"]] <= limit or docs[r["shard"]] == 1)
    # Prefix-free, and only oversized buckets were split.
    names = sorted(size)
    assert not any(b.startswith(a) for a in names for b in names if a != b)
    for a in names:
        if a:
            assert sum(v for k, v in size.items() if k.startswith(a[:-1])) > limit


def test_equal_rows_split(spark):
    got = sharding.shard_documents(odd.frame(spark, [(1, "x" * 100)] * 50), 1000).collect()
    sizes = Counter(r["shard"] for r in got)
    assert sum(sizes.values()) == 50 and max(sizes.values()) <= 10


def test_write_shards(spark, tmp_path):
    df = odd.frame(spark, [(i, "x" * 50) for i in range(40)])
    shards = sharding.shard_documents(df, 500)
    sharding.write_shards(df.select("doc_id", "text"), shards, str(tmp_path / "out"))
    assert spark.read.parquet(str(tmp_path / "out")).count() == 40
    assert sharding.directory(shards).agg(F.sum("n_docs")).first()[0] == 40
