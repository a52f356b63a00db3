"""Per-entity event sequences without collecting an entity's rows in one place.

* ``first_event_then_next``: first event time per entity, then the first
  strictly later activity. The rows of entities with more than 1 / ``SALTS`` of
  all rows are salted, and their first events repeated for each salt, so a hot
  entity's rows meet it in several tasks; both minima are aggregated before
  they are shuffled.
* ``event_sequence``: the first ``k`` events per entity. ``row_number() <= k``
  lets Spark insert a partial per-partition top-k before the shuffle
  (WindowGroupLimit), so a hot entity ships at most k rows per map task.
  The ordering is total (tie-break columns) so recomputation is stable.
* ``next_event``: for every row the next event of its entity (an as-of join
  that looks ahead). Times are cut into buckets: within a bucket a window finds
  the next event, and a second window over one row per (entity, bucket) carries
  the first event of the next bucket that has one back over the border. No task
  holds more of an entity than a bucket of distinct times, or its buckets.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from cxlens.operators.joins import heavy_keys

#: An entity with more than this share (1 / SALTS) of the rows is split.
SALTS = 32


def first_event_then_next(df: DataFrame, entity: str, ts: str, is_event: Column,
                          event_out: str = "event_ts", next_out: str = "next_ts",
                          salts: int = SALTS) -> DataFrame:
    """One row per entity with an event: first event time and first strictly later time."""
    firsts = df.filter(is_event).groupBy(entity).agg(F.min(ts).alias(event_out))
    # Times are collapsed first: an entity has as many rows as distinct times.
    rows = df.select(entity, ts).distinct()
    heavy = F.broadcast(heavy_keys(rows, entity, salts).withColumnRenamed(entity, "_heavy"))
    fanout = F.coalesce("fanout", F.lit(1))
    # The salt follows the row's time, so that a recomputed task deals out the same rows.
    salted = rows.join(heavy, F.col(entity) == F.col("_heavy"), "left").select(entity, ts, F.pmod(F.xxhash64(ts), fanout).cast("int").alias("_salt"))
    every = (firsts.join(heavy, F.col(entity) == F.col("_heavy"), "left")
             .select(entity, event_out, F.explode(F.sequence(F.lit(0), fanout - 1)).alias("_salt")))
    later = (salted.join(every, [entity, "_salt"]).filter(F.col(ts) > F.col(event_out))
             .groupBy(entity, "_salt").agg(F.min(ts).alias(next_out))
             .groupBy(entity).agg(F.min(next_out).alias(next_out)))
    return firsts.join(later, entity, "left")


def event_sequence(df: DataFrame, entity: str, order_by: Sequence[str | Column], k: int,
                   out: str = "seq") -> DataFrame:
    """Rows numbered 1.. within each entity in ``order_by`` order, keeping the first ``k``."""
    w = Window.partitionBy(entity).orderBy(*order_by)
    return df.withColumn(out, F.row_number().over(w)).filter(F.col(out) <= k)


def next_event(rows: DataFrame, events: DataFrame, entity: str, ts: str, event_ts: str, out: str = "next_ts",
               bucket_seconds: int = 86_400, strict: bool = True) -> DataFrame:
    """``rows`` with ``out``, the time of the earliest event of the same entity after the row's time (``strict``: not at it).

    ``events`` has the entity and ``event_ts``. Rows without an entity or time, or without a later event, get NULL; all rows
    stay, repeated ones too. Choose ``bucket_seconds`` so that a bucket of one entity's distinct times fits a task.
    """
    e = F.col("_e")
    points = (rows.select(entity, F.col(ts).alias("_t"), F.lit(0).alias("_e"))
              .union(events.select(entity, F.col(event_ts).alias("_t"), F.lit(1).alias("_e")))
              .filter(F.col(entity).isNotNull() & F.col("_t").isNotNull()).distinct()
              .withColumn("_b", F.floor(F.unix_micros(F.col("_t").cast("timestamp")) / (bucket_seconds * 1_000_000))))
    # Backwards in time, a row sees the events passed so far; at equal times it comes before its event if strict.
    back = Window.partitionBy(entity, "_b").orderBy(F.desc("_t"), F.asc("_e") if strict else F.desc("_e")).rowsBetween(Window.unboundedPreceding, -1)
    inside = points.withColumn("_in", F.min(F.when(e == 1, F.col("_t"))).over(back)).filter(e == 0).select(entity, "_t", "_b", "_in")
    over = Window.partitionBy(entity).orderBy(F.desc("_b")).rowsBetween(Window.unboundedPreceding, -1)
    borders = (points.groupBy(entity, "_b").agg(F.min(F.when(e == 1, F.col("_t"))).alias("_first"))
               .withColumn("_later", F.min("_first").over(over)).select(entity, "_b", "_later"))
    found = inside.join(borders, [entity, "_b"]).select(F.col(entity).alias("_k"), "_t", F.coalesce("_in", "_later").alias(out))
    return rows.join(found, (F.col(entity) == F.col("_k")) & (F.col(ts) == F.col("_t")), "left").drop("_k", "_t")
