"""File sources and sinks.

A CSV file is bound by its header: every column is read as a string, the
columns of the schema are picked by name and cast, and any others stay as
strings. A missing column is an error, and so is a cell that is not empty but
does not fit its type; nothing becomes NULL unless it was empty. Only review
text may hold line breaks, so the other files split into many tasks; the load
converts everything to Parquet once and the reports read that copy.
"""

from __future__ import annotations

import uuid
from concurrent.futures import ThreadPoolExecutor

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructField, StructType

from cxlens.sources.schemas import SCHEMAS
from cxlens.sources.tables import TABLE_NAMES, Tables

#: Tables whose quoted fields may span lines (such a file is one task).
MULTI_LINE = frozenset({"reviews"})


class CsvLoadError(ValueError):
    """A source file that does not fit its schema."""


def join_path(*parts: str) -> str:
    """Path or URI joined with slashes (``os.path`` knows only local paths)."""
    return "/".join([parts[0].rstrip("/"), *(p.strip("/") for p in parts[1:])])


def read_raw_csv(spark: SparkSession, path: str, multi_line: bool = False) -> DataFrame:
    """All columns of a CSV file as strings, under the names of its header."""
    return (spark.read.option("header", True).option("multiLine", multi_line)
            .option("escape", '"').option("enforceSchema", False)
            .option("mode", "FAILFAST").csv(path))


def _q(name: str) -> Column:
    return F.col("`" + name.replace("`", "``") + "`")


def _bad(field: StructField) -> Column:
    return _q(field.name).isNotNull() & _q(field.name).try_cast(field.dataType).isNull()


def bind(raw: DataFrame, schema: StructType, name: str) -> DataFrame:
    """The schema's columns by name and type, then the file's other columns as strings."""
    missing = [f.name for f in schema if f.name not in raw.columns]
    if missing:
        raise CsvLoadError(f"{name}: the file has no column {missing}; it has {raw.columns}")
    typed = [F.when(_bad(f), F.raise_error(F.concat(F.lit(f"{name}.{f.name}: not a {f.dataType.simpleString()}: "), _q(f.name))))
             .otherwise(_q(f.name).try_cast(f.dataType)).alias(f.name) for f in schema]
    return raw.select(*typed, *[_q(c) for c in raw.columns if c not in schema.names])


def bad_cells(raw: DataFrame, schema: StructType) -> dict[str, int]:
    """Per column, how many cells are not empty and do not fit the type (one scan)."""
    row = raw.agg(*[F.count_if(_bad(f)).alias(f.name) for f in schema]).first()
    return {k: n for k, n in row.asDict().items() if n}


def read_csv_table(spark: SparkSession, path: str, schema: StructType, multi_line: bool = True,
                   name: str = "table") -> DataFrame:
    return bind(read_raw_csv(spark, path, multi_line), schema, name)


def load_csv_tables(spark: SparkSession, data_dir: str, schemas=None,
                    files: dict | None = None) -> Tables:
    """Registry name -> file. Counts the cells that do not fit and raises if there are any."""
    schemas = schemas or SCHEMAS
    files = files or {n: f"{n}.csv" for n in TABLE_NAMES}
    raw = {n: read_raw_csv(spark, join_path(data_dir, files[n]), n in MULTI_LINE) for n in TABLE_NAMES}
    tables = Tables({n: bind(raw[n], schemas[n], n) for n in TABLE_NAMES})
    with ThreadPoolExecutor(max_workers=4) as pool:
        bad = dict(zip(TABLE_NAMES, pool.map(lambda n: bad_cells(raw[n], schemas[n]), TABLE_NAMES)))
    bad = {n: b for n, b in bad.items() if b}
    if bad:
        raise CsvLoadError(f"cells that do not fit their type, by table and column: {bad}")
    return tables


def write_tables(tables: Tables, path: str, mode: str = "errorifexists",
                 partition_by: dict | None = None, concurrent_jobs: int = 1) -> None:
    """Write every table as Parquet under ``path/<name>``, a folder of its own (``replace_tables`` replaces).

    ``concurrent_jobs > 1`` submits the table writes as concurrent Spark jobs
    (small dimension writes then share the cluster with the large ones).
    """
    partition_by = partition_by or {}

    def write(name: str) -> None:
        w = tables[name].write.mode(mode)
        if name in partition_by:
            w = w.partitionBy(*partition_by[name])
        w.parquet(join_path(path, name))

    if concurrent_jobs <= 1:
        for name in tables:
            write(name)
        return
    with ThreadPoolExecutor(max_workers=concurrent_jobs) as pool:
        for f in [pool.submit(write, n) for n in tables]:
            f.result()


def replace_tables(tables: Tables, path: str, concurrent_jobs: int = 1) -> str:
    """Create or replace all tables of ``path`` at once; returns their folder.

    They are written beside the ones that count now and count from when all nine are complete, so a reader
    (``read_tables``) sees the old tables or the new ones, and a failed write changes nothing. Tables may be replaced by what was read from them.
    """
    folder = fresh_folder(join_path(path, "sets"))
    write_tables(tables, folder, concurrent_jobs=concurrent_jobs)
    commit_set(next(iter(tables.values())).sparkSession, join_path(path, "log"), folder)
    return folder


def read_tables(spark: SparkSession, path: str) -> Tables:
    """The tables that ``replace_tables`` completed last."""
    folder = latest_set(spark, join_path(path, "log"))
    if folder is None:
        raise FileNotFoundError(f"{path} holds no complete tables")
    return read_parquet_tables(spark, folder)


def read_parquet_tables(spark: SparkSession, path: str) -> Tables:
    return Tables({n: spark.read.parquet(join_path(path, n)) for n in TABLE_NAMES})


def commit_set(spark: SparkSession, log: str, folder: str) -> None:
    """Record a completely written folder. Written last, so a set without a record is never read."""
    spark.range(1).select(F.lit(folder).alias("folder"), F.current_timestamp().alias("at")).write.mode("append").parquet(log)


def latest_set(spark: SparkSession, log: str) -> str | None:
    """The folder recorded last, or None before the first."""
    try:
        return spark.read.parquet(log).agg(F.max_by("folder", F.struct("at", "folder"))).first()[0]
    except AnalysisException as e:
        if e.getCondition() == "PATH_NOT_FOUND":
            return None
        raise


def fresh_folder(base: str) -> str:
    return join_path(base, uuid.uuid4().hex)


def file_statuses(spark: SparkSession, path: str) -> list[tuple[str, int, int]]:
    """(path, bytes, modification time) of the files at a path, by Hadoop's file systems; [] if there is none."""
    hadoop = spark._jvm.org.apache.hadoop.fs.Path(path)
    fs = hadoop.getFileSystem(spark._jsc.hadoopConfiguration())
    if not fs.exists(hadoop):
        return []
    files, out = fs.listFiles(hadoop, True), []
    while files.hasNext():
        s = files.next()
        out.append((s.getPath().toString(), s.getLen(), s.getModificationTime()))
    return sorted(out)
