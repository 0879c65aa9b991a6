"""Evaluate costly expressions exactly once per row."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def with_once(df: DataFrame, **columns: Column) -> DataFrame:
    """Add columns whose expressions later filters and projections must not repeat.

    The optimizer pushes filters below a projection by copying its expressions,
    which would, say, parse a JSON text once per field that is read. Emitting
    the values through a one-row generator keeps them computed once; the row
    count does not change.
    """
    kept = [c for c in df.columns if c not in columns]
    return df.select(*kept, F.inline(F.array(F.struct(*[e.alias(n) for n, e in columns.items()]))))
