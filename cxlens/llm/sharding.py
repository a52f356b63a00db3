"""Sharding by extendible hashing, in built-in Spark expressions only.

A document's key is 60 bits of md5(doc_id), followed (where those are all
equal, as for repeated ids) by 60 bits of md5 of a row number that is fixed
once by writing it. The directory is indexed by the leading bits of the key.
A bucket over the byte limit splits on one more bit; all others stay. Sizes
are counted for ``STEP`` bits at a time over the buckets still open: a grid of
at most 2**STEP cells per open bucket, summed up the prefix tree.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from cxlens.llm.common import written

KEY_BITS = 60
STEP = 12


def _bits(value: Column) -> Column:
    """The first 60 bits of an md5 as a long."""
    return F.conv(F.substring(F.md5(value), 1, 15), 16, 10).cast("long")


def shard_documents(docs: DataFrame, max_bytes: int, key: str = "doc_id", text: str = "text") -> DataFrame:
    """One row per document: doc_id, n_bytes, shard (its key prefix), depth, shard_docs, shard_bytes, oversize.

    Every shard holds at most ``max_bytes`` of UTF-8 text, except that a
    single document over the limit is a shard of its own (``oversize`` true).
    Null texts have 0 bytes; null and repeated ids share their first 60 bits
    and are told apart by the row number if they must be; an empty table
    gives an empty result; other columns are not read.
    """
    rows = docs.select(F.col(key).alias("doc_id"),
                       F.coalesce(F.octet_length(F.col(text).cast("string")), F.lit(0)).cast("long").alias("n_bytes"))
    rows = rows.withColumn("rid", F.monotonically_increasing_id())
    rows = written(rows.select("doc_id", "n_bytes",
                               _bits(F.coalesce(F.col("doc_id").cast("string"), F.lit(""))).alias("k0"),
                               _bits(F.col("rid").cast("string")).alias("k1")), "shard-keys")
    leaves, rest, base = [], rows.withColumn("base", F.lit("")), 0
    while base < 2 * KEY_BITS:
        k = F.col(f"k{base // KEY_BITS}")
        cell = F.lpad(F.bin(F.shiftright(k, KEY_BITS - base % KEY_BITS - STEP).bitwiseAND((1 << STEP) - 1)), STEP, "0")
        rest = rest.withColumn("cell", cell)
        grid = rest.groupBy("base", "cell").agg(F.sum("n_bytes").alias("b"), F.count("*").alias("c"))
        # Sums of every prefix of the cell; one exchange by base serves them all.
        for d in range(STEP + 1):
            w = Window.partitionBy("base", F.substring("cell", 1, d)) if d else Window.partitionBy("base")
            grid = grid.withColumn(f"s{d}", F.struct(F.sum("b").over(w).alias("bytes"), F.sum("c").over(w).alias("docs")))
        fits = [F.when((F.col(f"s{d}.bytes") <= max_bytes) | (F.col(f"s{d}.docs") == 1),
                       F.struct(F.concat("base", F.substring("cell", 1, d)).alias("shard"), F.col(f"s{d}.docs").alias("docs"),
                                F.col(f"s{d}.bytes").alias("bytes"))) for d in range(STEP + 1)]
        grid = written(grid.select("base", "cell", F.coalesce(*fits).alias("leaf")), "shard-grid")
        placed = rest.join(grid, ["base", "cell"])
        leaves.append(placed.where("leaf is not null").select("doc_id", "n_bytes", "leaf.*"))
        if grid.where("leaf is null").isEmpty():
            break
        rest = written(placed.where("leaf is null").select("doc_id", "n_bytes", "k0", "k1", F.concat("base", "cell").alias("base")), "shard-rest")
        base += STEP
    else:
        raise RuntimeError("keys do not separate the rows")
    out = leaves[0]
    for x in leaves[1:]:
        out = out.unionByName(x)
    return out.select("doc_id", "n_bytes", "shard", F.length("shard").cast("int").alias("depth"),
                      F.col("docs").alias("shard_docs"), F.col("bytes").alias("shard_bytes"),
                      (F.col("bytes") > max_bytes).alias("oversize"))


def directory(shards: DataFrame) -> DataFrame:
    """The directory: one row per shard with its depth (the global depth is the greatest)."""
    return shards.groupBy("shard").agg(F.first("depth").alias("depth"), F.first("shard_docs").alias("n_docs"),
                                       F.first("shard_bytes").alias("n_bytes"))


def write_shards(docs: DataFrame, shards: DataFrame, path: str) -> None:
    """Write the documents to one folder per shard (``shard=<prefix>``).

    Joined on doc_id, which must be unique here. A shard is bounded by the byte
    limit, so one task per shard is bounded too.
    """
    tagged = docs.join(shards.select("doc_id", F.concat(F.lit("p"), "shard").alias("shard")), "doc_id")
    tagged.repartition(F.col("shard")).write.partitionBy("shard").parquet(path)
