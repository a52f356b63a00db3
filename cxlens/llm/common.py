"""Helpers that several operators share: written tables, payload packing, components."""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from cxlens.session import ensure_checkpoint_dir

#: The white space that separates words in every contract here.
WORD_BREAK = r"[\x20\x09-\x0D]+"
#: Bytes of an Arrow batch; with a row on top it stays under slots.PART_BYTES as a rule.
BATCH_BYTES = 7 << 20
_BATCH = "spark.sql.execution.arrow.maxBytesPerBatch"


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


def scratch_path(spark: SparkSession, name: str) -> str:
    """A fresh folder under the shared checkpoint folder."""
    return f"{ensure_checkpoint_dir(spark).rstrip('/')}/cxlens-llm/{name}-{uuid.uuid4().hex}"


def written(df: DataFrame, name: str, options: dict[str, str] | None = None) -> DataFrame:
    """Write a frame to the shared folder and read it back: lineage ends there.

    A lost executor then costs a re-read of its files, never a recomputation
    of the stages before, and later passes see the same rows in each attempt.
    ``options``: of the Parquet writer.
    """
    path = scratch_path(df.sparkSession, name)
    df.write.options(**(options or {})).parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def bounded_batches(spark: SparkSession) -> None:
    """Texts go to Python workers in Arrow batches of about BATCH_BYTES, from here on in this session.

    Spark's own bounds are 10,000 rows and 64 MB, and each running task holds a batch several times: where the
    executor fills it, in the Python worker, and as what the worker makes of it. A setting of the caller's stays.
    """
    if spark.conf.get(_BATCH, None) is None:
        spark.conf.set(_BATCH, str(BATCH_BYTES))


def let(value: Column, body) -> Column:
    """Evaluate ``value`` once and use it many times inside ``body``."""
    return F.transform(F.array(value), body)[0]


def words_of(text: Column) -> Column:
    """Words of a text (null: none), in order."""
    return F.filter(F.split(F.coalesce(text, F.lit("")), WORD_BREAK), lambda w: w != "")


def components(edges: DataFrame, name: str, max_rounds: int = 60) -> DataFrame:
    """Smallest reachable id of every id that has a link: rows (id, component).

    ``edges`` has long columns ``a`` and ``b``; direction, repeats and loops do
    not matter, an empty frame gives an empty result. Alternates large-star
    and small-star steps; each step is one grouped minimum (combined before
    its shuffle, so a star centre with many links stays cheap) and one join
    that AQE can split. Every round is written to the shared folder.
    """
    e = edges.where("a <> b").select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct()
    e = written(e, f"{name}-edges")
    if e.isEmpty():
        return e.select(F.col("u").alias("id"), F.col("v").alias("component"))
    before = None
    for _ in range(max_rounds):
        # large star: every larger neighbour of u moves to u's smallest neighbour
        both = e.union(e.select("v", "u")).toDF("u", "v")
        low = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        e = (both.where("v > u").join(low, "u").select(F.col("v").alias("u"), F.col("m").alias("v"))
             .distinct())
        # small star: u and its smaller neighbours move to the smallest of them
        low = e.groupBy("u").agg(F.min("v").alias("m"))
        e = (e.join(low, "u").select(F.explode(F.array(
                F.struct(F.col("u"), F.col("m").alias("v")), F.struct(F.col("v").alias("u"), F.col("m").alias("v")))).alias("x"))
             .select("x.*").where("u <> v").distinct())
        e = written(e, f"{name}-round")
        now = e.agg(F.count("*"), F.sum(F.hash("u", "v").cast("long")), F.sum(F.xxhash64("v", "u") % 1000003)).first()
        if now == before:
            break
        before = now
    else:
        raise RuntimeError(f"components not settled after {max_rounds} rounds")
    roots = e.select(F.col("v").alias("id"), F.col("v").alias("component")).distinct()
    return e.select(F.col("u").alias("id"), F.col("v").alias("component")).union(roots)
