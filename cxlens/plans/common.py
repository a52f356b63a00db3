"""Aggregate expressions and filters shared by the view reports."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from cxlens.functions import avg_money, rate_pct, round_half, round_money

c = F.col

def reviewed() -> Column:
    return c("review_score").isNotNull()

def delivered() -> Column:
    return c("is_late").isNotNull()

def detractor() -> Column:
    return c("is_detractor") == 1



def n_rows(name: str) -> Column:
    return F.count(F.lit(1)).alias(name)


def pct_of(flag_col: str, name: str) -> Column:
    """Rounded percent of rows whose 0/1 flag is 1."""
    return rate_pct(flag_col).alias(name)


def avg2(col: str, name: str) -> Column:
    return round_half(F.avg(col), 2).alias(name)


def money0(expr: Column, name: str) -> Column:
    """Rounded (whole units) sum of a decimal expression, as double."""
    return round_money(F.sum(expr), 0).alias(name)


def detractor_gmv(name: str) -> Column:
    return money0(F.when(detractor(), c("order_gmv")).otherwise(F.lit(0)), name)


def mean_money(expr: Column, digits: int, name: str) -> Column:
    return round_half(avg_money(expr), digits).alias(name)


def sum_long(expr, name: str) -> Column:
    e = c(expr) if isinstance(expr, str) else expr
    return F.sum(e).cast("bigint").alias(name)
