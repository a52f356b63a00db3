"""Named reports: name -> function, and how to feed it.

A report reads either the tables (audits) or the order view. View reports
declare the view columns they use, so a lazily built view only carries the
joins those columns need; a materialised view can be passed instead.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence
from dataclasses import dataclass

from pyspark.sql import DataFrame

from cxlens.sources.tables import Tables


@dataclass(frozen=True)
class Report:
    name: str
    fn: Callable[..., DataFrame]
    uses: tuple[str, ...] | None  # view columns; None = reads the tables

    def run(self, tables: Tables, view: DataFrame | None = None) -> DataFrame:
        if self.uses is None:
            return self.fn(tables)
        if view is None:
            from cxlens.plans.order_view import order_analysis
            view = order_analysis(tables, self.uses)
        return self.fn(view)


REPORTS: dict[str, Report] = {}


def report(name: str, uses: Sequence[str] | None = None):
    def deco(fn):
        if name in REPORTS:
            raise ValueError(f"duplicate report {name}")
        REPORTS[name] = Report(name, fn, tuple(uses) if uses is not None else None)
        return fn
    return deco


def all_reports() -> dict[str, Report]:
    # Importing the modules registers their reports.
    from cxlens.plans import (audit, extensions, installments, late_delivery,  # noqa: F401
                              regions, repeat, root_cause, sellers)
    return dict(REPORTS)
