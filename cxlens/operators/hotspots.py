"""Groups whose rate is out of line with the rate over everything."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from cxlens.functions import ratio


def relative_hotspots(df: DataFrame, region: str | Sequence[str], flag: str | Column, min_rows: int = 0, factor: float = 2.0,
                      rows: str = "rows", aggregates: Sequence[Column] = (), labels: tuple[str, str] = ("hotspot", "standard"),
                      rate: str = "rate", overall: str = "overall_rate", out: str = "cohort") -> DataFrame:
    """One row per region: its rows, its rate of a 0/1 flag, the rate over all rows, the further aggregates, and its cohort.

    A region is a hotspot from ``factor`` times the overall rate on. That rate covers every region; regions with fewer
    than ``min_rows`` rows are left out afterwards. Rows without a flag do not count in either rate. The input is
    scanned once into one row a region, and the overall rate is a window over those.
    """
    keys = [region] if isinstance(region, str) else list(region)
    hit = F.col(flag) if isinstance(flag, str) else flag
    per = df.groupBy(*keys).agg(F.count(F.lit(1)).alias(rows), F.sum(hit).alias("_hits"), F.count(hit).alias("_known"), *aggregates)
    everything = Window.partitionBy()  # a row a region
    per = per.withColumn(rate, ratio("_hits", "_known")).withColumn(overall, ratio(F.sum("_hits").over(everything), F.sum("_known").over(everything)))
    cohort = F.when(F.col(rate) >= F.col(overall) * factor, F.lit(labels[0])).otherwise(F.lit(labels[1]))
    return per.filter(F.col(rows) >= min_rows).withColumn(out, cohort).drop("_hits", "_known")
