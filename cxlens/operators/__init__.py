"""Reusable DataFrame operators the reports are composed of."""

from cxlens.operators.audit import fk_audit, fk_orphans, null_audit, row_counts
from cxlens.operators.quantiles import exact_quantile, quantile_rows
from cxlens.operators.cohorts import percentile_cohort, with_quantile
from cxlens.operators.hotspots import relative_hotspots
from cxlens.operators.joins import salted_left_join
from cxlens.operators.rates import rate_table
from cxlens.operators.sequences import event_sequence, first_event_then_next, next_event
from cxlens.operators.running import running_total
from cxlens.operators.shares import running_share, share_of_total

__all__ = [
    "event_sequence", "exact_quantile", "first_event_then_next", "fk_audit", "fk_orphans", "next_event",
    "null_audit", "percentile_cohort", "quantile_rows", "rate_table", "relative_hotspots", "row_counts",
    "running_share", "running_total", "salted_left_join", "share_of_total", "with_quantile",
]
