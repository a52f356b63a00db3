"""Running totals over a large ordered domain.

A window without a partition sorts everything in one task. Here equal order
values become one row (peers share one total), the rows are dealt into ranges
of the order value, each range is summed, the sums of the ranges before it are
its offset, and a window inside the range does the rest. The ranges are
written to the shared folder: the bounds of a range exchange are sampled, and
totals and rows must come from the same ones, also when a task runs again.
"""

from __future__ import annotations

from collections.abc import Mapping
from decimal import Decimal

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from cxlens.session import written


def running_total(df: DataFrame, order_by: str, sums: Mapping[str, Column], parts: int | None = None, prefix: str = "running_") -> DataFrame:
    """One row per value of ``order_by``, ascending with NULL last: each of ``sums`` (name -> summed expression) and its running total.

    Totals include the row's own value and all before it. A sum without any value counts as 0 in the running total. ``parts``: ranges
    (default: the session's shuffle partitions). This writes a table; one row a range goes to the driver.
    """
    spark = df.sparkSession
    n = parts or int(spark.conf.get("spark.sql.shuffle.partitions"))
    peers = df.groupBy(order_by).agg(*[F.sum(e).alias(name) for name, e in sums.items()])
    dealt = written(peers.repartitionByRange(n, F.col(order_by).asc_nulls_last()).withColumn("_range", F.spark_partition_id()), "running")
    totals = dealt.groupBy("_range").agg(*[F.sum(name).alias(name) for name in sums]).collect()  # one row a range
    seen, rows = {name: 0 for name in sums}, []
    for t in sorted(totals, key=lambda r: r["_range"]):
        rows.append((t["_range"], *seen.values()))
        seen = {name: seen[name] + (t[name] or 0) for name in sums}
    kinds = {f.name: f.dataType.simpleString() for f in dealt.schema}
    wide = {name: "decimal(38," + k.split(",")[1] if (k := kinds[name]).startswith("decimal") else k for name in sums}
    rows = [(r[0], *[Decimal(x) if wide[name].startswith("decimal") else float(x) if wide[name] == "double" else x for name, x in zip(sums, r[1:])]) for r in rows]
    offsets = spark.createDataFrame(rows, ", ".join(["_range int", *[f"_before_{name} {wide[name]}" for name in sums]]))
    inside = Window.partitionBy("_range").orderBy(F.col(order_by).asc_nulls_last()).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    out = dealt.join(F.broadcast(offsets), "_range")
    return out.select(order_by, *sums, *[(F.col(f"_before_{name}") + F.coalesce(F.sum(name).over(inside), F.lit(0))).cast(wide[name]).alias(prefix + name) for name in sums])
