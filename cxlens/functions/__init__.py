"""Column -> Column helpers (built-in Spark expressions only, no Python UDFs)."""

from cxlens.functions.scalar import (avg_money, day_diff, dow_sunday0, flag, month_start,
                                     pct, rate_pct, ratio, round_half, round_money, tier,
                                     year_of, month_of)
from cxlens.functions.taxonomy import ROOT_CAUSE_RULES, classify

__all__ = ["ROOT_CAUSE_RULES", "avg_money", "classify", "day_diff", "dow_sunday0", "flag",
           "month_of", "month_start", "pct", "rate_pct", "ratio", "round_half", "round_money",
           "tier", "year_of"]
