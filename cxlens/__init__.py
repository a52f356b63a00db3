"""cxlens: marketplace customer-experience diagnostics on Spark.

Sources build the nine marketplace tables, ``plans.order_view`` builds the
wide order-level frame, and ``plans.*`` answer the report questions on top
of it with DataFrame operators from ``operators`` and column helpers from
``functions``.
"""

from cxlens.sources.tables import TABLE_NAMES, Tables

__all__ = ["TABLE_NAMES", "Tables"]
