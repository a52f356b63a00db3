"""Shares of a total over already-aggregated rows.

These windows run on the output of a group-by (a few rows per key value),
never on raw rows, so an unpartitioned window here moves a small, bounded
table into one task.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from cxlens.functions import round_half


def share_of_total(df: DataFrame, value: str, out: str, within: Sequence[str] = (),
                   digits: int = 1) -> DataFrame:
    """``value * 100 / sum(value)`` over all rows, or within groups of ``within``."""
    w = Window.partitionBy(*within) if within else Window.partitionBy()
    total = F.sum(value).over(w).cast("double")
    return df.withColumn(out, round_half(F.col(value).cast("double") * 100.0 / total, digits))


def running_share(df: DataFrame, value: str, order_by: str, out: str, digits: int = 1) -> DataFrame:
    """Cumulative share in ``order_by`` order; peers with equal keys share one value."""
    running = (Window.orderBy(F.col(order_by).asc_nulls_last())
               .rangeBetween(Window.unboundedPreceding, Window.currentRow))
    total = F.sum(value).over(Window.partitionBy()).cast("double")
    return df.withColumn(out, round_half(F.sum(value).over(running).cast("double") * 100.0 / total,
                                         digits))


def order_rank(col: str, order: Sequence[str]) -> Column:
    """Sort key placing the labels of ``order`` first, in that order, then the rest."""
    out = None
    for i, label in enumerate(order):
        out = (F.when(F.col(col) == label, i) if out is None else out.when(F.col(col) == label, i))
    return out.otherwise(len(order))
