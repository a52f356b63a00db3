"""Sources and sinks: the nine marketplace tables from CSV, Parquet or the test fixtures."""

from cxlens.sources.files import (load_csv_tables, read_csv_table, read_parquet_tables, read_tables,
                                  replace_tables, write_tables)
from cxlens.sources.fixtures import derive_marketplace
from cxlens.sources.schemas import SCHEMAS
from cxlens.sources.tables import TABLE_NAMES, Tables

__all__ = ["SCHEMAS", "TABLE_NAMES", "Tables", "derive_marketplace", "load_csv_tables",
           "read_csv_table", "read_parquet_tables", "read_tables", "replace_tables", "write_tables"]
