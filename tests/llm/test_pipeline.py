"""The registered queries and the pipeline's stages."""

from collections import Counter

import duckdb
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from cxlens.llm.oracles import ORACLES
from cxlens.llm.queries import QUERIES, tokenizer_path
from tests.llm import brute, odd
from tests.llm.test_tokens import check_packing

SF = "/root/testdata/sf0.001"


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_oracle(spark, name):
    con = duckdb.connect()
    for t in ("documents", "pages", "benchmark"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    df = QUERIES[name](spark, SF)
    columns = sorted(df.columns)
    want = con.execute(f"SELECT {', '.join(columns)} FROM ({ORACLES[name]})").fetchall()
    assert Counter(map(tuple, df.select(*columns).collect())) == Counter(want) and len(want) > 0


def test_one_query_for_each_operator():
    import __spark_entry__
    names = list(__spark_entry__.queries())
    assert [n.split("_")[0] for n in QUERIES] == [f"op{i}" for i in range(1, 14)]
    assert set(QUERIES) <= set(names) and "pipeline" in names


def test_stages_one_by_one(spark):
    docs = odd.frame(spark)
    ids = lambda df: Counter(r["doc_id"] for r in df.select("doc_id").collect())
    quality, language, simhash, suffix, packing = (f for _, f in corpus_pipeline.STAGES)
    kept = quality(spark, docs, "")
    assert kept.columns == docs.columns and {1, 2, 3} <= set(ids(kept)) and not {4, 6, 20} & set(ids(kept))
    assert 23 not in ids(language(spark, docs.withColumn("lang", F.when(F.length("text") > 20, "en")), ""))
    want = brute.simhash([(r["doc_id"], r["text"]) for r in docs.collect()])
    firsts = {d for d, _, c in want if d == c}
    assert set(ids(simhash(spark, docs, ""))) == firsts and simhash(spark, docs, "").columns == docs.columns
    cut = suffix(spark, docs, "")
    assert ids(cut) == ids(docs) and cut.columns == docs.columns
    from cxlens.llm.bpe import bpe
    check_packing(packing(spark, docs, "").collect(), odd.texts(), bpe(tokenizer_path()), 2048)


def test_run(spark):
    out = corpus_pipeline.run(spark, SF)
    assert out.count() > 0 and {"doc_id", "sequence_id", "offset"} <= set(out.columns)


def test_empty_documents(spark):
    docs = odd.frame(spark, [])
    for _, stage in corpus_pipeline.STAGES:
        assert stage(spark, docs, "").count() == 0


def test_batches_of_texts_are_bounded(spark):
    import pyarrow as pa

    from cxlens.llm import common, language_id, packing, simhash, suffix_dedup
    key = "spark.sql.execution.arrow.maxBytesPerBatch"
    docs = spark.range(0, 40, 1, 1).selectExpr("id doc_id", "repeat(cast(id % 10 as string), 1 << 20) text", "'en' lang")

    def sizes(batches):
        for batch in batches:
            yield pa.RecordBatch.from_arrays([pa.array([batch.nbytes])], ["n"])

    model = language_id.fit([("some plain words", "en"), ("quelques mots", "fr")])
    calls = (lambda: language_id.keep_identified(docs, 0.5, model), lambda: simhash.fingerprints(docs, 4),
             lambda: suffix_dedup.remove_repeats(docs.limit(1)), lambda: packing.pieces_of(docs, "none.json", 2048))
    before = spark.conf.get(key, None)
    try:
        for call in calls:
            spark.conf.unset(key)
            call()
            found = [r[0] for r in docs.select("text").mapInArrow(sizes, "n long").collect()]
            assert max(found) <= common.BATCH_BYTES + (2 << 20) and sum(found) > 40 << 20  # 42 MB in one batch before
        spark.conf.set(key, "1m")
        common.bounded_batches(spark)
        assert spark.conf.get(key) == "1m"
    finally:
        spark.conf.unset(key) if before is None else spark.conf.set(key, before)
