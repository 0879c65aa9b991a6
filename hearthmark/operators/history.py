"""Version history and price series."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from hearthmark.functions.numbers import percent_change
from hearthmark.operators.ordered import SLICE, day, with_previous, with_rank

NUMERIC_FIELDS = ("surface_m2", "rooms", "bedrooms", "media_count")


def version_deltas(
    versions: DataFrame, key: str = "listing_id", ts: str = "captured_at", tiebreak: str = "tiebreak"
) -> DataFrame:
    """Structured difference between each version and the one before it."""
    fields = ["price", *NUMERIC_FIELDS, "title", "description", "source_status"]
    rows = with_previous(versions, [key], [ts, tiebreak], fields, day(ts)).where(F.col("previous").isNotNull())
    before = {f: F.col("previous")[f] for f in fields}

    def differs(field: str) -> Column:
        return ~before[field].eqNullSafe(F.col(field))

    def moved(field: str) -> Column:
        return F.when(differs(field), F.struct(before[field].alias("from"), F.col(field).alias("to")))

    def text_differs(field: str) -> Column:
        blank = F.lit("")
        return F.coalesce(before[field], blank) != F.coalesce(F.col(field), blank)

    changed = differs("price") | text_differs("title") | text_differs("description") | text_differs("source_status")
    for field in NUMERIC_FIELDS:
        changed = changed | differs(field)
    price = F.when(
        differs("price"),
        F.struct(
            before["price"].alias("from"),
            F.col("price").alias("to"),
            percent_change(before["price"], F.col("price")).alias("pct"),
        ),
    )
    status = F.when(
        text_differs("source_status"),
        F.struct(before["source_status"].alias("from"), F.col("source_status").alias("to")),
    )
    return rows.select(
        key,
        ts,
        tiebreak,
        changed.alias("changed"),
        price.alias("price"),
        *[moved(f).alias(f) for f in NUMERIC_FIELDS],
        text_differs("title").alias("title_changed"),
        text_differs("description").alias("description_changed"),
        status.alias("status"),
    )


def price_change_points(
    versions: DataFrame, key: str = "listing_id", ts: str = "captured_at", tiebreak: str = "tiebreak"
) -> DataFrame:
    """Versions whose price differs from the last known price; null prices are skipped."""
    known = versions.where(F.col("price").isNotNull()).select(key, ts, tiebreak, "price")
    rows = with_previous(known, [key], [ts, tiebreak], ["price"], day(ts))
    return rows.where(
        F.col("previous").isNull() | (F.col("previous")["price"] != F.col("price"))
    ).select(key, F.col(ts).alias("observed_at"), tiebreak, "price")


def price_summary(
    points: DataFrame, key: str = "listing_id", ts: str = "observed_at", price: str = "price", tiebreak: str = "tiebreak"
) -> DataFrame:
    """First, last, extremes, change, direction and number of drops per price series.

    Days are summarised first, so a series of any length is combined from one
    row per day.
    """
    order = F.struct(ts, tiebreak)
    inside = Window.partitionBy(key, SLICE).orderBy(ts, tiebreak)
    days = (
        points.withColumn(SLICE, day(ts))
        .withColumn("_drop", (F.col(price) < F.lag(price).over(inside)).cast("bigint"))
        .groupBy(key, SLICE)
        .agg(
            F.min_by(price, order).alias("_first"),
            F.max_by(price, order).alias("_last"),
            F.min(price).alias("_min"),
            F.max(price).alias("_max"),
            F.coalesce(F.sum("_drop"), F.lit(0)).alias("_drops"),
        )
    )
    along = Window.partitionBy(key).orderBy(SLICE)
    bridged = days.withColumn("_bridge", (F.col("_first") < F.lag("_last").over(along)).cast("bigint"))
    change = percent_change(F.col("first"), F.col("last"))
    return (
        bridged.groupBy(key)
        .agg(
            F.min_by("_first", SLICE).alias("first"),
            F.max_by("_last", SLICE).alias("last"),
            F.min("_min").alias("min"),
            F.max("_max").alias("max"),
            (F.sum("_drops") + F.coalesce(F.sum("_bridge"), F.lit(0))).alias("drops"),
        )
        .withColumn("change_pct", change)
        .withColumn(
            "direction",
            F.when(F.col("change_pct") < 0, "down").when(F.col("change_pct") > 0, "up").otherwise("flat"),
        )
    )


def first_last(points: DataFrame, key: str, ts: str, value: str, tiebreak: str) -> DataFrame:
    """First and last value by time, combined on the map side."""
    order = F.struct(ts, tiebreak)
    return points.groupBy(key).agg(
        F.min_by(value, order).alias("first_value"), F.max_by(value, order).alias("last_value")
    )


def drop_counts(points: DataFrame, key: str, ts: str, value: str, tiebreak: str) -> DataFrame:
    """How often a value is below its predecessor."""
    rows = with_previous(points, [key], [ts, tiebreak], [value], day(ts))
    return rows.groupBy(key).agg(F.count_if(F.col(value) < F.col("previous")[value]).alias("drops"))


def latest_row(log: DataFrame, keys: list[str], order: list[str]) -> DataFrame:
    """Latest row per key as one aggregate (partial results combine before the shuffle)."""
    rest = [c for c in log.columns if c not in keys]
    best = log.groupBy(*keys).agg(F.max_by(F.struct(*rest), F.struct(*order)).alias("_row"))
    return best.select(*keys, "_row.*")


def scaled_series(
    points: DataFrame, key: str, ts: str, value: str, tiebreak: str, width: float = 100.0, height: float = 30.0
) -> DataFrame:
    """Chart coordinates: equal steps in x, min-max scaled y; single-point series are left out."""
    ranked = with_rank(points.select(key, ts, tiebreak, value), [key], [ts, tiebreak], day(ts), "position")
    spans = points.groupBy(key).agg(
        F.count(F.lit(1)).alias("_n"), F.min(value).alias("_low"), F.max(value).alias("_high")
    )
    span = F.when(F.col("_high") == F.col("_low"), F.lit(1.0)).otherwise(F.col("_high") - F.col("_low"))
    return (
        ranked.join(spans.where(F.col("_n") >= 2), key)
        .withColumn("x", (F.col("position") - 1) * (F.lit(width) / (F.col("_n") - 1)))
        .withColumn("y", F.lit(height) - (F.col(value) - F.col("_low")) / span * F.lit(height))
        .drop("_n", "_low", "_high")
    )


def nested_history(
    points: DataFrame,
    key: str = "listing_id",
    ts: str = "observed_at",
    value: str = "price",
    tiebreak: str = "tiebreak",
    page_rows: int = 1000,
) -> DataFrame:
    """Sorted points nested per key in pages of ``page_rows``; page 0 holds the oldest.

    Short series fill one page. Paging bounds the size of every array, however
    long a series grows, and keeps all points.
    """
    ranked = with_rank(points.select(key, ts, tiebreak, value), [key], [ts, tiebreak], day(ts), "_pos")
    paged = ranked.withColumn("page", F.floor((F.col("_pos") - 1) / page_rows).cast("int"))
    return paged.groupBy(key, "page").agg(
        F.transform(
            F.array_sort(F.collect_list(F.struct(ts, tiebreak, value))),
            lambda p: F.struct(p[ts].alias(ts), p[value].alias(value)),
        ).alias("points")
    )


def with_history(listings: DataFrame, points: DataFrame, key: str = "listing_id", **names: str) -> DataFrame:
    """Listings with their nested price history; a listing without points keeps an empty page."""
    return listings.join(nested_history(points, key, **names), key, "left").withColumns(
        {"page": F.coalesce("page", F.lit(0)), "points": F.coalesce("points", F.array())}
    )
