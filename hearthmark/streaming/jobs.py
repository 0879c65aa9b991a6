"""Incremental ingest, price change points and dispatch-once as streaming queries.

Price points and dispatched notifications follow from one value per key, which
Spark's state store keeps and recovers (``use_rocksdb`` puts it on disk).  The
ingest has tables as its state; a :class:`~hearthmark.sources.store.Store` of
buckets keeps those, and a batch that is run again finds itself committed or
writes the same files again.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming import DataStreamWriter, StreamingQuery
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from hearthmark.plans.ingest import State, commit_batch, ingest_store, last_per_key, start_store


def use_rocksdb(spark: SparkSession) -> None:
    """Keep streaming state on disk with a log of changes, so that it need not fit in memory; set it before the first start."""
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    spark.conf.set("spark.sql.streaming.stateStore.rocksdb.changelogCheckpointing.enabled", "true")


def _start(stream: DataFrame, folder: str, handle: Callable[[DataFrame, int], None], trigger: dict | None) -> StreamingQuery:
    writer: DataStreamWriter = stream.writeStream.foreachBatch(handle).option("checkpointLocation", f"{folder}/progress")
    return writer.trigger(**(trigger or {"availableNow": True})).start()


def price_change_stream(
    versions: DataFrame,
    folder: str,
    key: str = "listing_id",
    ts: str = "captured_at",
    tiebreak: str = "tiebreak",
    trigger: dict | None = None,
) -> StreamingQuery:
    """Append a price point below ``points`` when a price differs from the last one of its listing.

    Spark's state store keeps the last price of every listing, so a batch reads
    and writes the prices of its own listings only.  Rows of one batch go by
    (``ts``, ``tiebreak``); a batch follows the one before whatever the clock
    says.  Rows without a listing or a price are skipped.
    """
    fields = {f.name: f for f in versions.schema}
    out = T.StructType([fields[key], T.StructField("observed_at", fields[ts].dataType), fields[tiebreak], T.StructField("price", T.DoubleType())])

    def changes(who: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        rows = pd.concat(list(frames)).sort_values([ts, tiebreak], kind="stable")
        before = state.get[0] if state.exists else None
        prices = rows["price"]
        changed = prices != prices.shift()
        changed.iloc[0] = before is None or prices.iloc[0] != before
        state.update((float(prices.iloc[-1]),))
        yield rows.loc[changed, [key, ts, tiebreak, "price"]].rename(columns={ts: "observed_at"})

    known = versions.where(F.col("price").isNotNull() & F.col(key).isNotNull()).select(key, ts, tiebreak, F.col("price").cast("double"))
    points = known.groupBy(key).applyInPandasWithState(changes, out, "price double", "append", GroupStateTimeout.NoTimeout)
    return _append(points, folder, "points", trigger)


def dispatch_once_stream(
    notifications: DataFrame, folder: str, now: Callable[[], Column] = F.current_timestamp, trigger: dict | None = None
) -> StreamingQuery:
    """Let every notification leave exactly once: ``dispatched`` lists what has left.

    The ids that have left are keys of Spark's state store, without a limit in
    time; a batch looks up its own ids only.  A batch that is run again after a
    failure writes nothing twice, as the folder keeps a log of its batches.
    """
    waiting = notifications.where(F.col("dispatched_at").isNull()).drop("dispatched_at")
    left = waiting.dropDuplicates(["notification_id"]).withColumn("dispatched_at", now())
    return _append(left, folder, "dispatched", trigger)


def _append(rows: DataFrame, folder: str, name: str, trigger: dict | None) -> StreamingQuery:
    """Write a stream as Parquet files that count once their batch is in the log of the folder."""
    writer = rows.writeStream.format("parquet").outputMode("append").option("path", f"{folder}/{name}")
    return writer.option("checkpointLocation", f"{folder}/progress").trigger(**(trigger or {"availableNow": True})).start()


def start_ingest_stream(
    incoming: DataFrame,
    initial: State,
    folder: str,
    now: Callable[[int], Column],
    searches: DataFrame | None = None,
    position: str = "id",
    tenant: tuple[str, ...] = ("user_id",),
    trigger: dict | None = None,
) -> StreamingQuery:
    """Plan and apply every micro-batch of listings on the state the batch before left.

    The tables live in an ``ingest_store`` below ``folder``; version ``n + 1`` is the state
    after batch ``n``, version 0 the initial one.  A batch reads the listings of
    its own tenants and sources, and writes the listings, edges, versions and
    notifications that it makes or changes.
    """
    key = [*tenant, "source_id", "external_id"]
    store = ingest_store(incoming.sparkSession, f"{folder}/state", tenant)

    def handle(rows: DataFrame, batch: int) -> None:
        if not store.versions():
            start_store(store, initial)
        commit_batch(store, batch + 1, last_per_key(rows, key, position), searches, now(batch), tenant)

    return _start(incoming, folder, handle, trigger)
