"""Columns that are computed exactly once per row."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def with_computed(df: DataFrame, **columns: Column) -> DataFrame:
    """Add columns whose (dear) expressions must not be copied into later steps.

    The optimizer substitutes a projected expression into filters and join
    conditions above it, which repeats array work many times. A one-element
    ``inline`` yields the same columns as generated values, which later steps can
    only refer to.
    """
    fields = F.struct(*[c.alias(name) for name, c in columns.items()])
    kept = [F.col(c) for c in df.columns if c not in columns]
    return df.select(*kept, F.inline(F.array(fields)))


def bind(value: Column, body) -> Column:
    """``body(value)`` with ``value`` evaluated once, for use inside expressions."""
    return F.get(F.transform(F.array(value), body), 0)
