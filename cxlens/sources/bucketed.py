"""Co-partitioned copies of the order tables, so that the view joins without a shuffle.

The four tables that carry ``order_id`` are written bucketed and sorted by it,
with the same number of buckets, one file a bucket. What the view looks up by
other keys is joined once, at load: orders carry their customer's columns,
items their product's and category's. Spark then plans every join and roll-up on
``order_id`` over a bucket each, and reads of the view exchange nothing.

A copy is a folder that lists its bucket count and columns in ``layout``, written last; ``read_bucketed``
registers the tables of a complete copy in the session's catalog, as external tables
over those files. Choose the buckets so that one fits a task (``bucket_count``).
"""

from __future__ import annotations

import json

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from cxlens.sources.files import join_path
from cxlens.sources.tables import Tables

KEY = "order_id"
BUCKETED = ("orders", "order_items", "payments", "reviews")
CUSTOMER_COLUMNS = ("customer_unique_id", "customer_state")
PRODUCT_COLUMNS = ("category_id", "weight_grams", "category_name")


def bucket_count(input_bytes: int, cores: int, target_bytes: int = 256 << 20) -> int:
    """Buckets for tables of so many bytes: a target size each, and no fewer than the cores."""
    return max(cores, -(-input_bytes // target_bytes))


def enriched(t: Tables) -> dict[str, DataFrame]:
    """The four tables with what the view looks up for them; no column that is there already is replaced."""
    def missing(df: DataFrame, names) -> list[str]:
        return [c for c in names if c not in df.columns]

    orders, items = t.orders, t.order_items
    if more := missing(orders, CUSTOMER_COLUMNS):
        orders = orders.join(t.customers.select("customer_id", *more), "customer_id", "left").select(*orders.columns, *more)
    if more := missing(items, PRODUCT_COLUMNS):
        products = t.products.select("product_id", "category_id", "weight_grams").join(
            t.product_categories.select("category_id", "category_name"), "category_id", "left")
        items = items.join(products.select("product_id", *more), "product_id", "left").select(*items.columns, *more)
    return {"orders": orders, "order_items": items, "payments": t.payments, "reviews": t.reviews}


def write_bucketed(t: Tables, path: str, buckets: int, database: str) -> None:
    """Write the four tables to a fresh folder and register them (``read_bucketed`` does so in other sessions)."""
    spark = t.orders.sparkSession
    spark.sql(f"CREATE DATABASE IF NOT EXISTS {database}")
    for name, df in enriched(t).items():
        # Dealt like the buckets first, so that each bucket is one file of one task.
        (df.repartition(buckets, KEY).write.format("parquet").bucketBy(buckets, KEY).sortBy(KEY)
         .option("path", join_path(path, name)).saveAsTable(f"{database}.{name}"))
    rows = [(name, buckets, spark.table(f"{database}.{name}").schema.json()) for name in BUCKETED]
    spark.createDataFrame(rows, "name string, buckets int, schema string").coalesce(1).write.parquet(join_path(path, "layout"))


def read_bucketed(spark: SparkSession, path: str, database: str, others: Tables) -> Tables:
    """The tables of a copy as ``Tables``; those it does not hold are taken from ``others``.

    Registers them under ``database`` first if this session does not know them.
    """
    try:
        layout = spark.read.parquet(join_path(path, "layout")).collect()  # four rows
    except AnalysisException as e:
        raise FileNotFoundError(f"{path} is no complete bucketed copy") from e
    spark.sql(f"CREATE DATABASE IF NOT EXISTS {database}")
    frames = {}
    for r in layout:
        table = f"{database}.{r['name']}"
        if not spark.catalog.tableExists(table):
            columns = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in StructType.fromJson(json.loads(r["schema"])))
            spark.sql(f"CREATE TABLE {table} ({columns}) USING parquet CLUSTERED BY ({KEY}) SORTED BY ({KEY}) INTO {r['buckets']} BUCKETS "
                      f"LOCATION '{join_path(path, r['name'])}'")
        frames[r["name"]] = spark.table(table)
    return others.replace(**frames)


def single_file_buckets(spark: SparkSession, path: str) -> bool:
    """Whether each bucket of every table is one file at most, as the sort order inside a bucket needs."""
    for name in BUCKETED:
        files = spark.read.parquet(join_path(path, name)).select(F.input_file_name().alias("f")).distinct()
        bucket = F.regexp_extract("f", r"_(\d+)\.c\d+", 1)
        if not files.groupBy(bucket).count().filter("count > 1").isEmpty():
            return False
    return True
