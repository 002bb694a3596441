"""Small shared helpers for column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def col_of(c) -> Column:
    """Accept a column name or a Column."""
    return F.col(c) if isinstance(c, str) else c


def once(c) -> Column:
    """Evaluate ``c`` once per row behind a generator barrier.

    A one-element ``explode_outer`` yields a new attribute: Catalyst can
    neither inline the expression into every later use (CollapseProject,
    filter pushdown) nor infer a filter that re-evaluates it. Use it for
    costly per-row work (regex scans, URL resolution, JSON parsing) whose
    result several later expressions read.
    """
    return F.explode_outer(F.array(col_of(c)))
