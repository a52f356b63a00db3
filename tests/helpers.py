"""Tiny hand-made marketplace tables for semantic tests."""

from __future__ import annotations

import datetime as dt
from decimal import Decimal

from cxlens.sources.schemas import SCHEMAS
from cxlens.sources.tables import TABLE_NAMES, Tables

D = Decimal
T = dt.datetime


def make_tables(spark, **rows) -> Tables:
    """Tables from lists of tuples in schema column order; missing tables are empty."""
    return Tables({n: spark.createDataFrame(rows.get(n, []), SCHEMAS[n]) for n in TABLE_NAMES})


def order(oid, purchase, delivered=None, estimated=None, status="delivered", cust=None):
    return (oid, cust or f"c{oid}", status, purchase, None, None, delivered, estimated)


def review(rid, oid, score, message=None, answered=None):
    return (rid, oid, score, None, message, None, answered)
