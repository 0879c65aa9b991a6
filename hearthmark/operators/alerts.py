"""Notification queues, delivery outcomes and read state."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from hearthmark.operators.ordered import with_last_known


def unread(notifications: DataFrame) -> DataFrame:
    return notifications.where(F.col("read_at").isNull())


def dispatch_queue(notifications: DataFrame, limit: int | None = None) -> DataFrame:
    """Notifications that never left, oldest first; the first ``limit`` of them if one is given."""
    waiting = notifications.where(F.col("dispatched_at").isNull()).orderBy("created_at", "notification_id")
    return waiting if limit is None else waiting.limit(limit)


def delivery_outcomes(
    notifications: DataFrame,
    preferences: DataFrame,
    subscriptions: DataFrame,
    attempts: DataFrame,
    push_ready: bool = True,
) -> DataFrame:
    """Delivery status per notification and channel from the reported attempts."""
    accepted = F.col("status_code").between(200, 299)

    def of(channel: str) -> Column:
        return F.col("channel") == channel

    tally = attempts.groupBy("notification_id").agg(
        F.count_if(of("webhook") & accepted).alias("_hook_ok"),
        F.count_if(of("push") & accepted).alias("_sent"),
        F.count_if(of("push") & ~accepted).alias("_failed"),
    )
    owned = subscriptions.groupBy("user_id").agg(F.count(F.lit(1)).alias("_subs"))
    rows = (
        notifications.join(preferences, "user_id", "left").join(owned, "user_id", "left").join(tally, "notification_id", "left")
    )
    pushing = F.lit(push_ready) & F.coalesce("webpush_enabled", F.lit(False))
    subscribed = pushing & (F.coalesce("_subs", F.lit(0)) > 0)
    sent = F.when(subscribed, F.coalesce("_sent", F.lit(0))).otherwise(F.lit(0))
    failed = F.when(subscribed, F.coalesce("_failed", F.lit(0))).otherwise(F.lit(0))
    webhook = F.when(
        F.coalesce("has_webhook", F.lit(False)),
        F.when(F.coalesce("_hook_ok", F.lit(0)) > 0, "sent").otherwise("failed"),
    ).otherwise("skipped")
    push = (
        F.when(~pushing, "skipped")
        .when(~subscribed, "no_subscription")
        .when(failed == 0, "sent")
        .when(sent == 0, "failed")
        .otherwise("partial")
    )
    return rows.select(
        *notifications.columns,
        webhook.alias("webhook"),
        push.alias("push"),
        sent.cast("bigint").alias("push_sent"),
        failed.cast("bigint").alias("push_failed"),
    )


def expired_subscriptions(attempts: DataFrame) -> DataFrame:
    """Push subscriptions that the receiver reported as gone."""
    gone = attempts.where((F.col("channel") == "push") & F.col("status_code").isin(404, 410))
    return gone.select("subscription_id").distinct()


def stamp_dispatched(outcomes: DataFrame, now: Column) -> DataFrame:
    """Stamp the dispatch time and the nested delivery record."""
    delivery = F.struct(
        now.alias("at"),
        F.struct("webhook", "push").alias("channels"),
        "push_sent",
        "push_failed",
    )
    return outcomes.withColumns({"dispatched_at": now, "delivery": delivery}).drop(
        "webhook", "push", "push_sent", "push_failed"
    )


def _before_log(notifications: DataFrame, log: DataFrame) -> DataFrame:
    """Last log entry of the user before each notification was created."""
    nothing = F.lit(None).cast("bigint")
    entries = log.select("user_id", nothing.alias("notification_id"), "at", "seq", F.lit(1).alias("_kind"))
    born = notifications.select("user_id", "notification_id", F.col("created_at").alias("at"), nothing.alias("seq"), F.lit(0).alias("_kind"))
    known = with_last_known(entries.unionByName(born), ["user_id"], ["at", "_kind", "seq"], "seq", F.date_trunc("day", "at"), "_born")
    return known.where("_kind = 0").select("user_id", "notification_id", "_born")


def fold_read_state(log: DataFrame, slice_rows: int = 100_000, notifications: DataFrame | None = None) -> DataFrame:
    """Current read time per (user, notification) after a log of read actions.

    The first read after the latest ``unread`` counts; ``read_all`` reads every
    notification of the user that exists by then. With ``notifications(user_id,
    notification_id, created_at, read_at)`` these are the notifications that
    exist, each from its creation on; an earlier read time stays until an
    ``unread``. Without, only those exist that the log names.
    """
    keys = ["user_id", "notification_id"]
    own = log.where(F.col("action") != "read_all")
    state = own.groupBy(*keys).agg(
        F.min("seq").alias("_first"), F.max(F.when(F.col("action") == "unread", F.col("seq"))).alias("_unread")
    )
    if notifications is not None:
        born = _before_log(notifications, log)
        earliest = F.lit(-(2**62))
        state = born.join(state.drop("_first"), keys, "left").select(*keys, F.coalesce(F.col("_born") + 1, earliest).alias("_first"), "_unread")
    reads = (
        own.where(F.col("action") == "read")
        .join(state, keys)
        .where(F.col("_unread").isNull() | (F.col("seq") > F.col("_unread")))
        .groupBy(*keys)
        .agg(F.min(F.struct("seq", "at")).alias("_read"))
    )
    # next read_all of the user after the barrier: an as-of lookup along -seq
    barrier = state.select(
        *keys, F.greatest("_first", F.coalesce("_unread", "_first")).alias("seq"), F.lit(None).cast("struct<seq:bigint,at:timestamp>").alias("_all")
    )
    sweeps = log.where(F.col("action") == "read_all").select(
        "user_id", F.lit(None).cast("bigint").alias("notification_id"), "seq", F.struct("seq", "at").alias("_all")
    )
    timeline = barrier.unionByName(sweeps).withColumns(
        {"_back": -F.col("seq"), "_is_barrier": F.col("notification_id").isNotNull().cast("int")}
    )
    swept = with_last_known(
        timeline, ["user_id"], ["_back", "_is_barrier"], "_all", F.floor(F.col("_back") / slice_rows), "_swept"
    ).where(F.col("notification_id").isNotNull())
    folded = swept.select(*keys, "_swept").join(reads, keys, "left").select(*keys, F.least("_read", "_swept")["at"].alias("read_at"))
    if notifications is None:
        return folded
    untouched = state.where(F.col("_unread").isNull()).select(*keys, F.lit(True).alias("_kept"))
    had = notifications.where(F.col("read_at").isNotNull()).select(*keys, F.col("read_at").alias("_had"))
    return (
        folded.join(had, keys, "left")
        .join(untouched, keys, "left")
        .select(*keys, F.coalesce(F.when(F.col("_kept"), F.col("_had")), F.col("read_at")).alias("read_at"))
    )
