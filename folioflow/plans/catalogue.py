"""All queries of the library over the driver's tables, each with its SQL where SQL can say it."""

from __future__ import annotations

from folioflow.plans import layout_queries, pdf_queries, report_queries, span_queries, text_queries

MODULES = (text_queries, span_queries, layout_queries, report_queries, pdf_queries)


def queries() -> dict:
    return {name: f for m in MODULES for name, f in m.QUERIES.items()}


def oracle_sql() -> dict[str, str]:
    return {name: sql for m in MODULES for name, sql in m.ORACLES.items()}
