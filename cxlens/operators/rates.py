"""The shared roll-up of the rate reports: rows, flag rates and money by key."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def rate_table(df: DataFrame, keys: Sequence[str | Column], min_rows: int = 0, rows: str = "rows",
               aggregates: Sequence[Column] = ()) -> DataFrame:
    """One row per key: the row count (named ``rows``) and the aggregates, for keys with ``min_rows`` rows.

    A plain group-by, so it is aggregated before its shuffle whatever the skew.
    """
    out = df.groupBy(*keys).agg(F.count(F.lit(1)).alias(rows), *aggregates)
    return out.filter(F.col(rows) >= min_rows) if min_rows else out
