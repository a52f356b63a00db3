"""Stored aggregate states that can be merged.

A state table has one row for each day and group: sums, counts, smallest and
largest values, and sets of ids as bitmaps (one row for each bitmap bucket, so
no row grows with the table). Coarser figures (a month, a status, everything)
are merged from it without the rows it was made of: sums add up, bitmaps are
or-ed and counted. A day is replaced as a whole by a newer version of it, so days can be
computed again when late rows come.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from cxlens.sources.files import commit_set, fresh_folder, join_path


def id_sets(rows: DataFrame, keys: Sequence[str], ident: str, sets: dict[str, Column]) -> DataFrame:
    """(keys, bucket, one bitmap for each of ``sets``) of the integer ids for which its condition holds; null ids are in no set."""
    at = rows.filter(F.col(ident).isNotNull()).withColumn("bucket", F.bitmap_bucket_number(ident)).withColumn("_bit", F.bitmap_bit_position(ident))
    return at.groupBy(*keys, "bucket").agg(*[F.bitmap_construct_agg(F.when(when, F.col("_bit"))).alias(name) for name, when in sets.items()])


def count_ids(states: DataFrame, keys: Sequence[str], names: Sequence[str]) -> DataFrame:
    """How many different ids each set has for every value of ``keys``."""
    merged = states.groupBy(*keys, "bucket").agg(*[F.bitmap_or_agg(n).alias(n) for n in names])
    return merged.groupBy(*keys).agg(*[F.sum(F.bitmap_count(n)).alias(n) for n in names])


class StateStore:
    """States by day in a folder; each commit brings new versions of some days."""

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path

    def _log(self) -> DataFrame | None:
        try:
            return self.spark.read.parquet(join_path(self.path, "log"))
        except AnalysisException as e:
            if e.getCondition() == "PATH_NOT_FOUND":
                return None
            raise

    def commit(self, states: DataFrame, days: Sequence) -> None:
        """Replace ``days`` (dates, None for rows without one) by ``states`` (column ``day``); days that it has no rows of become empty."""
        folder = fresh_folder(join_path(self.path, "parts"))
        day = F.col("day")
        listed = day.isin([d for d in days if d is not None])
        states.filter((listed | day.isNull()) if None in days else listed).write.parquet(join_path(folder, "rows"))
        self.spark.createDataFrame([(d,) for d in days], "day date").coalesce(1).write.parquet(join_path(folder, "days"))
        commit_set(self.spark, join_path(self.path, "log"), folder)

    def read(self) -> DataFrame:
        """The states of every day in its latest committed version."""
        log = self._log()
        if log is None:
            raise FileNotFoundError(f"{self.path} holds no states")
        folders = [r["folder"] for r in log.orderBy("at", "folder").collect()]  # one row a commit
        rows = days = None
        for version, folder in enumerate(folders):
            r = self.spark.read.parquet(join_path(folder, "rows")).withColumn("_version", F.lit(version))
            d = self.spark.read.parquet(join_path(folder, "days")).withColumn("_version", F.lit(version))
            rows, days = (r, d) if rows is None else (rows.unionByName(r), days.unionByName(d))
        latest = days.groupBy(F.col("day").alias("_day")).agg(F.max("_version").alias("_latest"))
        return rows.join(latest, F.col("day").eqNullSafe(F.col("_day")) & (F.col("_version") == F.col("_latest")), "left_semi").drop("_version")
