"""Scalar column helpers shared by the reports.

Rounding: reports round doubles as ``round(x * 10^n) / 10^n`` with halves away
from zero on the binary value, which is what SQL engines that round doubles
natively do; ``F.round(x, n)`` on a double first re-reads the shortest decimal
text of ``x`` and so rounds e.g. 2.675 up where the binary value is below it.
Money stays decimal until the final rounding, so sums do not depend on row
order.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F


def _c(x) -> Column:
    return F.col(x) if isinstance(x, str) else x


def round_half(x, n: int) -> Column:
    """Round a double to ``n`` decimals, halves away from zero."""
    scale = float(10 ** n)
    return F.round(_c(x).cast("double") * scale, 0) / scale


def round_money(x, n: int) -> Column:
    """Round an exact decimal to ``n`` places (half up) and hand it out as double."""
    return F.round(_c(x), n).cast("double")


def ratio(num, den) -> Column:
    """num / den as double, NULL when den is 0 or NULL."""
    return _c(num).cast("double") / F.nullif(_c(den).cast("double"), F.lit(0.0))


def pct(num, den) -> Column:
    """num * 100 / den as double, NULL for a zero denominator."""
    return _c(num).cast("double") * 100.0 / F.nullif(_c(den).cast("double"), F.lit(0.0))


def rate_pct(flag_col, n: int = 1) -> Column:
    """Aggregate: share of rows where a 0/1 flag is 1, in percent, rounded."""
    return round_half(F.avg(_c(flag_col)) * 100, n)


def avg_money(x) -> Column:
    """Aggregate: mean of a decimal as double (exact sum, then one division)."""
    return F.sum(_c(x)).cast("double") / F.count(_c(x))


def flag(cond: Column) -> Column:
    """1 when ``cond`` is true, else 0 (NULL counts as false)."""
    return F.when(cond, 1).otherwise(0)


def day_diff(start, end) -> Column:
    """Number of day boundaries between two timestamps (end - start, in days)."""
    return F.datediff(_c(end), _c(start)).cast("bigint")


def month_start(ts) -> Column:
    """First instant of the month, kept as a zone-less timestamp."""
    return F.date_trunc("month", _c(ts)).cast("timestamp_ntz")


def year_of(ts) -> Column:
    return F.year(_c(ts)).cast("bigint")


def month_of(ts) -> Column:
    return F.month(_c(ts)).cast("bigint")


def dow_sunday0(ts) -> Column:
    """Day of week with Sunday = 0 ... Saturday = 6."""
    return (F.dayofweek(_c(ts)) - 1).cast("bigint")


def tier(x, cuts: Sequence[tuple[str, Column | None]]) -> Column:
    """Ordered labels: ``cuts`` is [(label, condition), ...]; a None condition is the else."""
    out = None
    for label, cond in cuts:
        if cond is None:
            return (out.otherwise(F.lit(label)) if out is not None else F.lit(label))
        out = F.when(cond, F.lit(label)) if out is None else out.when(cond, F.lit(label))
    return out
