"""Data-quality audits: row counts, conditional null counts, orphan keys."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def row_counts(frames: Mapping[str, DataFrame], names: Sequence[str], label: str,
               count: str) -> DataFrame:
    """One row per table: its name and row count (scans run as one job)."""
    parts = [frames[n].agg(F.count(F.lit(1)).alias(count)).select(F.lit(n).alias(label), count)
             for n in names]
    return reduce(DataFrame.unionByName, parts)


def null_audit(df: DataFrame, total: str, rules: Mapping[str, Column]) -> DataFrame:
    """Single pass: total rows plus, per rule, how many rows satisfy it."""
    return df.agg(F.count(F.lit(1)).alias(total),
                  *[F.count_if(F.coalesce(cond, F.lit(False))).alias(name)
                    for name, cond in rules.items()])


def fk_orphans(child: DataFrame, child_key: str, parent: DataFrame, parent_key: str, out: str) -> DataFrame:
    """One row: how many child rows have a key without a parent (a NULL key is an orphan).

    The child is counted by key before it is shuffled, so a hot key is one row
    of each map task.
    """
    keys = parent.select(F.col(parent_key).alias("__pk"))
    counted = child.groupBy(F.col(child_key).alias("__fk")).agg(F.count(F.lit(1)).alias("__n"))
    orphans = counted.join(keys, F.col("__fk") == F.col("__pk"), "left_anti")
    return orphans.agg(F.coalesce(F.sum("__n"), F.lit(0)).cast("bigint").alias(out))


def fk_audit(tables: Mapping[str, DataFrame], edges: Sequence[tuple[str, str, str, str, str]], label: str, out: str) -> DataFrame:
    """Orphans of several edges (label, child, child key, parent, parent key), one row each in the given order.

    Every table is read once: a child hands on (edge, key, count) rows for all its keys at a time, counted
    before they are shuffled, the parents' keys are stacked, and one outer join finds what has no parent. A NULL key is an
    orphan. Keys are compared as text.
    """
    parents = list(dict.fromkeys((parent, pk) for *_, parent, pk in edges))

    def stacked(names: Sequence[tuple[int, str]], df: DataFrame) -> DataFrame:
        one = F.array(*[F.struct(F.lit(no).alias("no"), F.col(col).cast("string").alias("key")) for no, col in names])
        return df.select(F.explode(one).alias("x")).select("x.*")

    children: dict[str, list[tuple[int, str]]] = {}
    for no, (_, child, key, *_) in enumerate(edges):
        children.setdefault(child, []).append((no, key))
    keys: dict[str, list[tuple[int, str]]] = {}
    for no, (parent, pk) in enumerate(parents):
        keys.setdefault(parent, []).append((no, pk))
    counts = reduce(DataFrame.unionByName, [stacked(names, tables[child]).groupBy("no", "key").agg(F.count(F.lit(1)).alias("n"))
                                            for child, names in children.items()])
    known = reduce(DataFrame.unionByName, [stacked(names, tables[parent]) for parent, names in keys.items()]).withColumnRenamed("no", "parent")
    parent_of = F.get(F.array(*[F.lit(parents.index((parent, pk))) for *_, parent, pk in edges]), F.col("no"))
    # Not an anti join: Spark would push it below the stacked children and read every parent once for each of them.
    found = counts.withColumn("parent", parent_of).join(known.distinct().withColumn("known", F.lit(True)), ["parent", "key"], "left")
    orphans = found.filter(F.col("known").isNull()).groupBy("no").agg(F.sum("n").alias(out))
    names = F.array(*[F.struct(F.lit(no).alias("no"), F.lit(e[0]).alias(label)) for no, e in enumerate(edges)])
    every = tables[edges[0][1]].sparkSession.range(1).select(F.explode(names).alias("x")).select("x.*")
    return every.join(F.broadcast(orphans), "no", "left").orderBy("no").select(label, F.coalesce(out, F.lit(0)).cast("bigint").alias(out))
