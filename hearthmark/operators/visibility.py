"""Rows a viewer may read: own, shared with them, or public."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def readable_searches(searches: DataFrame, shares: DataFrame, viewer: Column) -> DataFrame:
    """Ids of searches that are public or shared with the viewer."""
    public = searches.where("is_public").select("search_id")
    shared = shares.where(F.col("shared_with") == viewer).select("search_id")
    return public.unionByName(shared).distinct()


def visible_searches(searches: DataFrame, shares: DataFrame, viewer: Column) -> DataFrame:
    """Own rows plus semi-joined readable rows; the two parts do not overlap."""
    own = searches.where(F.col("user_id") == viewer)
    others = searches.where(F.col("user_id") != viewer)
    return own.unionByName(others.join(readable_searches(searches, shares, viewer), "search_id", "left_semi"))


def visible_listings(listings: DataFrame, searches: DataFrame, shares: DataFrame, viewer: Column) -> DataFrame:
    own = listings.where(F.col("user_id") == viewer)
    others = listings.where((F.col("user_id") != viewer) & F.col("search_id").isNotNull())
    return own.unionByName(others.join(readable_searches(searches, shares, viewer), "search_id", "left_semi"))


def visible_via_listing(
    rows: DataFrame, listing_column: str, listings: DataFrame, searches: DataFrame, viewer: Column
) -> DataFrame:
    """Price points or edges: own rows, or rows of a listing under a public search."""
    public = searches.where("is_public").select("search_id")
    public_ids = listings.join(public, "search_id", "left_semi").select(F.col("id").alias(listing_column))
    own = rows.where(F.col("user_id") == viewer)
    others = rows.where(F.col("user_id") != viewer)
    return own.unionByName(others.join(public_ids, listing_column, "left_semi"))


def shares_of_searches(shares: DataFrame, users: DataFrame, searches: DataFrame, viewer: Column) -> DataFrame:
    """Who the viewer's searches are shared with, with e-mail, oldest share first."""
    owned = searches.where(F.col("user_id") == viewer).select("search_id")
    return (
        shares.join(owned, "search_id", "left_semi")
        .join(users.select(F.col("user_id").alias("shared_with"), "email"), "shared_with")
        .select("search_id", "shared_with", "email", "role", "created_at")
        .orderBy("search_id", "created_at")
    )


def match_email(requests: DataFrame, users: DataFrame) -> DataFrame:
    """Users by e-mail, ignoring case and outer blanks of the request."""
    known = users.select("user_id", F.lower("email").alias("_email"))
    return requests.withColumn("_email", F.lower(F.trim("email"))).join(known, "_email").drop("_email")


def connectors_for_searches(connectors: DataFrame, searches: DataFrame) -> DataFrame:
    """Enabled API connectors of the owner, limited to the sources of the search unless it names none."""
    usable = connectors.where(F.col("enabled") & (F.col("mode") == "authorized_api"))
    wanted = searches.select("search_id", "user_id", F.explode_outer("source_ids").alias("_source"))
    named = wanted.where(F.col("_source").isNotNull()).join(
        usable.withColumn("_source", F.col("source_id")), ["user_id", "_source"]
    )
    unnamed = wanted.where(F.col("_source").isNull()).drop("_source").join(usable, "user_id")
    return named.drop("_source").unionByName(unnamed).dropDuplicates(["search_id", "connector_id"])


def shared_connectors(connectors: DataFrame, searches: DataFrame) -> DataFrame:
    """Connectors behind public searches: owner set times source set, no sources meaning all."""
    public = searches.where("is_public")
    owners = public.select("user_id").distinct()
    sources = public.select(F.explode("source_ids").alias("source_id")).distinct()
    owned = connectors.join(owners, "user_id", "left_semi")
    named = sources.agg(F.count(F.lit(1)) > 0).scalar()
    flagged = owned.join(sources.withColumn("_listed", F.lit(True)), "source_id", "left")
    config = F.try_parse_json("config")
    return flagged.where(F.coalesce("_listed", F.lit(False)) | ~named).select(
        "connector_id",
        "source_id",
        "label",
        "enabled",
        F.coalesce(F.try_variant_get(config, "$.kind", "string"), F.lit("json_api")).alias("kind"),
        F.coalesce(
            F.try_variant_get(config, "$.departments", "array<string>"), F.array().cast("array<string>")
        ).alias("departments"),
    )
