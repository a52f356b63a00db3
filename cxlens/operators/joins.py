"""Outer join with a skewed inner side.

Spark can split the preserved side of an outer join at run time, not the other
one: all its rows of one key meet in one task. ``salted_left_join`` deals the
rows of heavy keys over several tasks and repeats the outer row in each.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


#: Salts for each share that a heavy key fills: small cells spread evenly over the tasks.
CELLS = 4


def heavy_keys(rows: DataFrame, key: str, parts: int) -> DataFrame:
    """(key, fanout) of keys with more than 1 / ``parts`` of all rows; ``parts`` rows at most, so it may be broadcast.

    Counted by key, combined before the shuffle; ``fanout`` is CELLS for each such share a key fills.
    """
    counts = rows.filter(F.col(key).isNotNull()).groupBy(key).agg(F.count(F.lit(1)).alias("_n"))
    total = counts.agg(F.sum("_n").alias("_total"))
    heavy = counts.crossJoin(F.broadcast(total)).filter(F.col("_n") * parts > F.col("_total"))
    return heavy.select(key, F.ceil(F.col("_n") * (CELLS * parts) / F.col("_total")).cast("int").alias("fanout"))


def salted_left_join(left: DataFrame, right: DataFrame, key: str, parts: int | None = None, spread: Sequence[str] = ()) -> DataFrame:
    """``left.join(right, key, "left")``, where one key may hold a large share of ``right``.

    A key with more than 1 / ``parts`` of the right rows (default: the session's shuffle partitions) has a
    fanout: each of its right rows takes one of that many salts by a hash of the ``spread`` columns (default:
    all of ``right``), and its left rows come once for each salt. So a task joins about one share of the
    right rows at most, unless rows equal in all ``spread`` columns are more. A heavy key has right rows by
    definition; a copy of its left row that meets none has only drawn an empty salt and goes. Every other left row
    without a partner stays, once. Null keys match nothing and stay. The counts are part of the plan; building it runs no job.
    """
    parts = parts or int(left.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    heavy = F.broadcast(heavy_keys(right, key, parts).withColumnRenamed(key, "_heavy"))
    salt = F.pmod(F.xxhash64(*[F.col(c) for c in spread or right.columns]), F.coalesce("fanout", F.lit(1))).cast("int")
    dealt = (right.join(heavy, F.col(key) == F.col("_heavy"), "left").withColumn("_salt", salt)
             .select(key, "_salt", F.lit(True).alias("_met"), *[c for c in right.columns if c != key]))
    copies = (left.join(heavy, F.col(key) == F.col("_heavy"), "left").withColumn("_many", F.coalesce("fanout", F.lit(1)) > 1)
              .withColumn("_salt", F.explode(F.sequence(F.lit(0), F.coalesce("fanout", F.lit(1)) - 1))).drop("_heavy", "fanout"))
    out = copies.join(dealt, [key, "_salt"], "left").filter(F.coalesce("_met", F.lit(False)) | ~F.col("_many"))
    return out.select(*left.columns, *[c for c in right.columns if c != key])
