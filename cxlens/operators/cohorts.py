"""Threshold cohorts over per-entity statistics.

The input is always an aggregate (one row per seller, per state, ...). The
threshold is the exact, linearly interpolated quantile as one more part of the plan
(``operators.quantiles``): one row, joined by broadcast to the entity rows.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cxlens.operators.quantiles import quantile_rows


def with_quantile(rows: DataFrame, metric: str | Column, q: float, out: str) -> DataFrame:
    """Attach the ``q`` quantile of ``metric`` over all rows (NULL metrics ignored)."""
    return rows.crossJoin(F.broadcast(quantile_rows(rows, metric, q, out=out)))


def percentile_cohort(df: DataFrame, entity: str | Sequence[str], metric: Column, q: float = 0.9, min_rows: int = 0, rows: str = "rows",
                      aggregates: Sequence[Column] = (), labels: tuple[str, str] = ("problem", "standard"), out: str = "cohort") -> DataFrame:
    """One row per entity: its row count, ``metric`` (an aliased aggregate), the further aggregates, and its cohort.

    Entities with fewer than ``min_rows`` rows are left out. The first label is for those whose metric is at or above the ``q`` quantile of all
    that are left; an entity without a metric gets the second.
    """
    from cxlens.operators.rates import rate_table

    keys = [entity] if isinstance(entity, str) else list(entity)
    stats = rate_table(df, keys, min_rows, rows, [metric, *aggregates])
    name = stats.columns[len(keys) + 1]
    at = with_quantile(stats, name, q, "_threshold")
    flag = F.when(F.col(name) >= F.col("_threshold"), F.lit(labels[0])).otherwise(F.lit(labels[1]))
    return at.withColumn(out, flag).drop("_threshold")
