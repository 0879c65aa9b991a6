"""Listing search, sort orders, recent changes and lookups for readers."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def sorted_listings(listings: DataFrame, order: str = "recent") -> DataFrame:
    """Sort orders of the list view; missing prices go last, missing relevance counts as 0."""
    by = {
        "relevance": F.desc(F.coalesce("relevance_score", F.lit(0))) if "relevance_score" in listings.columns else None,
        "price_asc": F.asc_nulls_last("price"),
        "price_desc": F.desc_nulls_last("price"),
        "recent": F.desc("last_changed_at"),
    }[order]
    return listings.orderBy(by, "id")


def search_listings(
    listings: DataFrame, statuses: DataFrame, query: str = "", status: str = "", order: str = "recent"
) -> DataFrame:
    """Listings whose title or city contains the query, optionally with one user status."""
    found = listings
    needle = query.strip().lower()
    if needle:
        text = F.concat(F.coalesce("title", F.lit("")), F.lit(" "), F.coalesce("city", F.lit("")))
        found = found.where(F.contains(F.lower(text), F.lit(needle)))
    if status:
        found = found.join(
            statuses.where(F.col("status") == status).select(F.col("listing_id").alias("id")), "id", "left_semi"
        )
    return sorted_listings(found, order)


def recent_changes(listings: DataFrame, limit: int = 4) -> DataFrame:
    return listings.orderBy(F.desc("last_changed_at"), "id").limit(limit)


def similar_listings(edges: DataFrame, listings: DataFrame) -> DataFrame:
    """For every listing the other ends of its edges, dangling edges dropped."""
    both = edges.select(F.col("a").alias("listing_id"), F.col("b").alias("id"), "score", "bucket").unionByName(
        edges.select(F.col("b").alias("listing_id"), F.col("a").alias("id"), "score", "bucket")
    )
    return both.join(listings, "id")


def ordered_distinct(df: DataFrame, keys: list[str], position: str) -> DataFrame:
    """Distinct keys with the first position at which each appeared."""
    return df.groupBy(*keys).agg(F.min(position).alias(position))
