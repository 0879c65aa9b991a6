"""Equi-join that cuts hot keys into a grid of bounded pieces."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def _pieces(df: DataFrame, keys: Sequence[str], rows: int, name: str) -> DataFrame:
    counts = df.groupBy(*keys).agg(F.count(F.lit(1)).alias("_n"))
    return counts.where(F.col("_n") > rows).select(*keys, F.ceil(F.col("_n") / rows).cast("int").alias(name))


def grid_join(
    left: DataFrame, right: DataFrame, keys: Sequence[str], left_id: str, right_id: str, piece_rows: int = 20_000
) -> DataFrame:
    """Inner equi-join of two tables whose keys may be hot on both sides.

    A key with more than ``piece_rows`` rows on a side is split there by a hash
    of the row id; the other side is copied once per piece. Every pair still
    meets exactly once, in a task that holds at most one piece of each side.
    """
    keys = list(keys)
    hot_left = _pieces(left, keys, piece_rows, "_left_n")
    hot_right = _pieces(right, keys, piece_rows, "_right_n")
    hot = hot_left.join(hot_right, keys, "full_outer").select(
        *keys, F.coalesce("_left_n", F.lit(1)).alias("_left_n"), F.coalesce("_right_n", F.lit(1)).alias("_right_n")
    )

    def cut(df: DataFrame, own: str, other: str, own_piece: str, other_piece: str, row_id: str) -> DataFrame:
        sized = df.join(hot, keys, "left")
        n_own, n_other = F.coalesce(own, F.lit(1)), F.coalesce(other, F.lit(1))
        return (
            sized.withColumn(own_piece, F.pmod(F.xxhash64(row_id), n_own).cast("int"))
            .withColumn(other_piece, F.explode(F.sequence(F.lit(0), n_other - 1)))
            .drop("_left_n", "_right_n")
        )

    return cut(left, "_left_n", "_right_n", "_i", "_j", left_id).join(
        cut(right, "_right_n", "_left_n", "_j", "_i", right_id), [*keys, "_i", "_j"]
    ).drop("_i", "_j")
