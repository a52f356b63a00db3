"""Report plans: the order view and the named reports built on it."""

from cxlens.plans.order_view import VIEW_COLUMNS, order_analysis
from cxlens.plans.registry import Report, all_reports

__all__ = ["Report", "VIEW_COLUMNS", "all_reports", "order_analysis"]
