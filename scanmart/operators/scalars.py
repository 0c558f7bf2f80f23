"""Attach dataset-wide scalars (1-row aggregates) to every row of a frame."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def attach(df: DataFrame, one_row: DataFrame) -> DataFrame:
    """Columns of ``one_row`` added to every row of ``df``.

    ``one_row`` must be an aggregate without grouping keys (or a ``limit(1)``): it has
    exactly one row whatever the input size, so broadcasting it is bounded by
    construction, and the plan is a broadcast nested-loop join against that single
    row - a per-row projection, not a product. A scalar subquery (``.scalar()``) would
    express the same, but Spark plans it as a separate query that re-runs the whole
    upstream plan (the marts) instead of sharing its exchanges; measured at sf0.1 the
    scored accounts took 5.0 s that way against 3.2 s here.
    """
    return df.crossJoin(F.broadcast(one_row))
