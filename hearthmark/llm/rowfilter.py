"""Leave out rows that a join would drop, before their texts are shuffled.

The ids to keep are hashed into a bit field of fixed size, built by Spark's
bitmap aggregates.  It lets some other rows through, never stops a row that
counts, and only gets less selective as the data grow.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from hearthmark.llm import textops

#: Bits of the field: four megabytes, whatever the data.
BITS = 1 << 25


def slot(key: str | Column) -> Column:
    """Place of a key in the field; null for a null key."""
    key = F.col(key) if isinstance(key, str) else key
    return F.when(key.isNotNull(), F.pmod(F.xxhash64(key), F.lit(BITS)))


def field(keys: DataFrame, key: str) -> Callable[[], np.ndarray]:
    """A broadcast bit field with the slots of all keys."""
    place = F.col("_slot")
    rows = (
        keys.select((slot(key) + 1).alias("_slot"))  # Spark's bitmaps count from one
        .where(place.isNotNull())
        .groupBy(F.bitmap_bucket_number(place).alias("bucket"))
        .agg(F.bitmap_construct_agg(F.bitmap_bit_position(place)).alias("bits"))
        .collect()  # at most BITS / 32768 rows of 4 KB
    )
    bits = np.zeros(BITS, bool)
    for row in rows:
        part = np.unpackbits(np.frombuffer(bytes(row["bits"]), np.uint8), bitorder="little")
        start = (row["bucket"] - 1) * len(part)
        bits[start : start + len(part)] = part
    packed = keys.sparkSession.sparkContext.broadcast(np.packbits(bits))
    kept: list[np.ndarray] = []

    def get() -> np.ndarray:
        if not kept:
            kept.append(np.unpackbits(packed.value).astype(bool))
        return kept[0]

    return get


def passing(slots: pa.Array, bits: np.ndarray) -> np.ndarray:
    """Which rows may be among the keys, by their slots."""
    place = pc.fill_null(slots, 0).to_numpy(zero_copy_only=False)
    return bits[place] & slots.is_valid().to_numpy(zero_copy_only=False)


def possible(df: DataFrame, key: str, bits: Callable[[], np.ndarray]) -> DataFrame:
    """Rows of ``df`` whose key may be among those of the field."""
    schema = df.schema

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            chosen = passing(batch.column(batch.num_columns - 1), bits())
            if chosen.any():
                yield pa.RecordBatch.from_arrays(batch.filter(pa.array(chosen)).columns[:-1], names=schema.names)

    return df.withColumn(textops.free_names(df.columns, "slot")[0], slot(key)).mapInArrow(run, schema)


def without(df: DataFrame, keys: DataFrame, key: str) -> DataFrame:
    """Rows of ``df`` whose key is not among the keys; rows without a key stay.

    Only the few rows that may be among the keys are shuffled.
    """
    bits, schema = field(keys, key), df.schema

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rest = batch.filter(pa.array(~passing(batch.column(batch.num_columns - 1), bits())))
            yield pa.RecordBatch.from_arrays(rest.columns[:-1], names=schema.names)

    clear = df.withColumn(textops.free_names(df.columns, "slot")[0], slot(key)).mapInArrow(run, schema)
    return clear.unionByName(possible(df, key, bits).join(keys.select(key), key, "left_anti").select(df.columns))
