"""Exact quantiles as part of the plan, over all rows or for every group.

``percentile``/``median`` gather every distinct value of a group in one task.
Here a sketch of bounded size (``percentile_approx``, merged before its
shuffle) says between which two values the quantile must lie; only the values
between them, collapsed to (value, count), and their nearest neighbours outside
are then gathered, and the ranks below are counted. The result is
interpolated on the exact values at the two ranks around ``(n - 1) * q``:
``v1 + (v2 - v1) * frac``. The sketch is off by ``n / ACCURACY`` ranks at most
and the bracket is twice as wide, so a group gathers ``4 / ACCURACY`` of its
values; ties are one row however many they are. If a rank should ever lie outside the bracket, the
query fails; it never returns a wrong value. Building the plan runs no job.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Accuracy of the sketch: its ranks are right within 1 / ACCURACY of the rows.
ACCURACY = 10_000


def _let(value: Column, body) -> Column:
    """Evaluate ``value`` once and use it several times inside ``body``."""
    return F.transform(F.array(value), body)[0]


def _at_rank(values: Column, base: Column, rank: Column) -> Column:
    """The value at a rank; ``values`` are sorted (value, count) pairs behind ``base`` rows."""
    none = F.lit(None).cast("double")
    start = F.struct(base.alias("seen"), F.when(rank < base, F.lit(True)).otherwise(F.lit(False)).alias("lost"), none.alias("value"))

    def step(a: Column, v: Column) -> Column:
        seen = a["seen"] + v["_c"]
        here = ~a["lost"] & a["value"].isNull() & (seen > rank)
        return F.struct(seen.alias("seen"), a["lost"].alias("lost"), F.when(here, v["_x"]).otherwise(a["value"]).alias("value"))

    return F.aggregate(values, start, step, lambda a: a["value"])


def quantile_rows(df: DataFrame, value: str | Column, q: float, by: Sequence[str] = (), out: str = "quantile",
                  accuracy: int | None = None) -> DataFrame:
    """The columns ``by`` and the exact ``q`` quantile of each group; one row over all rows if ``by`` is empty.

    NULLs are ignored; a group without a value has no row, and all rows without a value give NULL. Values are taken as doubles.
    """
    accuracy = accuracy or ACCURACY
    x = (F.col(value) if isinstance(value, str) else value).cast("double")
    rows = df.select(*by, x.alias("_x")).filter(F.col("_x").isNotNull())
    near = F.percentile_approx("_x", F.array(F.lit(max(0.0, q - 2 / accuracy)), F.lit(min(1.0, q + 2 / accuracy))), accuracy)
    bracket = rows.groupBy(*by).agg(near.alias("_near")).select(
        *[F.col(c).alias(f"_by{i}") for i, c in enumerate(by)], F.col("_near")[0].alias("_low"), F.col("_near")[1].alias("_high"))
    vals = rows.groupBy(*by, "_x").agg(F.count(F.lit(1)).alias("_c"))
    if by:
        same = [F.col(c).eqNullSafe(F.col(f"_by{i}")) for i, c in enumerate(by)]
        vals = vals.join(bracket, same)
    else:
        vals = vals.crossJoin(F.broadcast(bracket))  # one row
    below, above, pair = F.col("_x") < F.col("_low"), F.col("_x") > F.col("_high"), F.struct("_x", "_c")
    found = vals.groupBy(*by).agg(
        F.sum("_c").alias("_n"), F.sum(F.when(below, F.col("_c"))).alias("_below"), F.max(F.when(below, pair)).alias("_prev"),
        F.min(F.when(above, pair)).alias("_next"), F.collect_list(F.when(~below & ~above, pair)).alias("_mid"))
    values = F.filter(F.concat(F.array("_prev"), F.sort_array("_mid"), F.array("_next")), lambda v: v.isNotNull())
    base = F.coalesce("_below", F.lit(0)) - F.coalesce("_prev._c", F.lit(0))
    position = (F.col("_n") - 1).cast("double") * q
    missed = F.raise_error(F.lit("a rank outside the bracket of the sketch")).cast("double")

    def interpolated(v: Column) -> Column:
        ends = F.struct(_at_rank(v, base, F.floor(position)).alias("a"), _at_rank(v, base, F.ceil(position)).alias("b"))
        return _let(ends, lambda e: F.coalesce(e["a"] + (e["b"] - e["a"]) * (position - F.floor(position)), missed))

    return found.select(*by, F.when(F.col("_n").isNotNull(), _let(values, interpolated)).alias(out))


def exact_quantile(df: DataFrame, value: str | Column, q: float) -> float | None:
    """The quantile over all rows as a number (this runs the plan; None without values)."""
    return quantile_rows(df, value, q).first()[0]
