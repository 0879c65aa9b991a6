"""Ordered per-key work that stays parallel when one key holds much of the data.

A plain window puts a whole key into one task. These helpers cut every key into
slices along the order (for example calendar days), work inside the slices, and
bridge the slices with one summary row each. Results equal the plain window.
``slice_by`` must not decrease along the order.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

SLICE = "_slice"


def day(ts: str) -> Column:
    return F.date_trunc("day", F.col(ts))


def _sliced(df: DataFrame, slice_by: Column) -> DataFrame:
    return df.withColumn(SLICE, slice_by)


def with_previous(
    df: DataFrame,
    keys: Sequence[str],
    order: Sequence[str],
    columns: Sequence[str],
    slice_by: Column,
    name: str = "previous",
) -> DataFrame:
    """Add the preceding row of the key as a struct; null on the first row."""
    rows = _sliced(df, slice_by)
    payload = F.struct(*[F.col(c) for c in columns])
    inside = Window.partitionBy(*keys, SLICE).orderBy(*order)
    lasts = rows.groupBy(*keys, SLICE).agg(F.max_by(payload, F.struct(*order)).alias("_last"))
    bridge = lasts.select(
        *keys, SLICE, F.lag("_last").over(Window.partitionBy(*keys).orderBy(SLICE)).alias("_before")
    )
    joined = rows.withColumn("_inside", F.lag(payload).over(inside)).join(bridge, [*keys, SLICE], "left")
    return joined.withColumn(name, F.coalesce("_inside", "_before")).drop("_inside", "_before", SLICE)


def with_rank(
    df: DataFrame, keys: Sequence[str], order: Sequence[str], slice_by: Column, name: str = "rank"
) -> DataFrame:
    """Add the 1-based position of each row inside its key."""
    rows = _sliced(df, slice_by)
    sizes = rows.groupBy(*keys, SLICE).agg(F.count(F.lit(1)).alias("_n"))
    earlier = Window.partitionBy(*keys).orderBy(SLICE).rowsBetween(Window.unboundedPreceding, -1)
    offsets = sizes.select(*keys, SLICE, F.coalesce(F.sum("_n").over(earlier), F.lit(0)).alias("_offset"))
    inside = Window.partitionBy(*keys, SLICE).orderBy(*order)
    return (
        rows.withColumn("_inside", F.row_number().over(inside))
        .join(offsets, [*keys, SLICE])
        .withColumn(name, F.col("_inside") + F.col("_offset"))
        .drop("_inside", "_offset", SLICE)
    )


def with_last_known(
    df: DataFrame,
    keys: Sequence[str],
    order: Sequence[str],
    value: str,
    slice_by: Column,
    name: str = "last_known",
) -> DataFrame:
    """Add the latest non-null ``value`` at or before each row of the key (as-of fill)."""
    rows = _sliced(df, slice_by)
    known = F.when(F.col(value).isNotNull(), F.struct(*order))
    lasts = rows.groupBy(*keys, SLICE).agg(F.max_by(F.col(value), known).alias("_last"))
    earlier = Window.partitionBy(*keys).orderBy(SLICE).rowsBetween(Window.unboundedPreceding, -1)
    bridge = lasts.select(*keys, SLICE, F.last("_last", ignorenulls=True).over(earlier).alias("_before"))
    upto = (
        Window.partitionBy(*keys, SLICE).orderBy(*order).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    )
    return (
        rows.withColumn("_inside", F.last(value, ignorenulls=True).over(upto))
        .join(bridge, [*keys, SLICE], "left")
        .withColumn(name, F.coalesce("_inside", "_before"))
        .drop("_inside", "_before", SLICE)
    )
