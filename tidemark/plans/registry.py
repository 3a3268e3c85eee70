"""All registered queries and their SQL."""

from __future__ import annotations

from tidemark.plans import ledgers, operations, reports
from tidemark.plans.reports import Report

__all__ = ["ledgers", "operations", "oracle_sql", "queries"]


def queries() -> dict[str, Report]:
    return dict(reports.REPORTS)


def oracle_sql() -> dict[str, str]:
    return dict(reports.ORACLES)
