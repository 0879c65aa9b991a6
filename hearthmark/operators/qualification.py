"""User qualification of listings and audit events."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

# Status names set by rules.
TO_REVIEW, VERIFIED, SUSPECT = "a_revoir", "verifiee", "suspecte"


def toggled_tags(log: DataFrame) -> DataFrame:
    """Tags that are on after all toggles: an odd number of toggles."""
    counts = log.where(F.col("action") == "tag").groupBy("listing_id", "tag").agg(F.count(F.lit(1)).alias("_n"))
    return counts.where(F.col("_n") % 2 == 1).select("listing_id", "tag")


def fold_qualification(log: DataFrame) -> DataFrame:
    """Current status and tags per listing from status, tag and verification actions."""
    promoted = F.when(F.col("verified"), F.lit(VERIFIED)).when(F.col("anomaly_count") > 0, F.lit(SUSPECT))
    status = F.when(F.col("action") == "status", F.col("status")).when(F.col("action") == "verification", promoted)
    steps = log.withColumn("_status", status)
    touched = F.col("_status").isNotNull() | (F.col("action") == "tag")
    current = (
        steps.where(touched)
        .groupBy("listing_id")
        .agg(F.max_by("_status", F.when(F.col("_status").isNotNull(), F.col("seq"))).alias("_status"))
    )
    tags = toggled_tags(log).groupBy("listing_id").agg(F.array_sort(F.collect_list("tag")).alias("tags"))
    return current.join(tags, "listing_id", "left").select(
        "listing_id",
        F.coalesce("_status", F.lit(TO_REVIEW)).alias("status"),
        F.coalesce("tags", F.array().cast("array<string>")).alias("tags"),
    )


def search_audit(before: DataFrame, after: DataFrame) -> DataFrame:
    """Audit events of created, switched and deleted searches between two snapshots."""
    old = before.select("search_id", *[F.col(c).alias(f"_old_{c}") for c in ("user_id", "name", "active")])
    new = after.select("search_id", "user_id", "name", "active", F.lit(True).alias("_present"))
    rows = old.withColumn("_was", F.lit(True)).join(new, "search_id", "full_outer")
    created = F.col("_was").isNull()
    deleted = F.col("_present").isNull()
    switched = F.col("_old_active") != F.col("active")
    action = (
        F.when(created, "search.create").when(deleted, "search.delete").when(switched, "search.toggle")
    )
    name = F.coalesce("name", "_old_name")
    # fixed values: the texts are part of the result
    outcome = (
        F.when(created, "créée").when(deleted, "supprimée").when(F.col("active"), "activée").otherwise("désactivée")
    )
    return (
        rows.withColumn("action", action)
        .where(F.col("action").isNotNull())
        .select(
            F.coalesce("user_id", "_old_user_id").alias("user_id"),
            "action",
            F.lit("saved_search").alias("target_type"),
            F.col("search_id").cast("string").alias("target_id"),
            F.concat(F.lit("Recherche « "), name, F.lit(" » "), outcome, F.lit(".")).alias("summary"),
        )
    )


def status_audit(log: DataFrame, user: str = "user_id") -> DataFrame:
    """One audit event for every written status."""
    return log.select(
        F.col(user).alias("user_id"),
        F.lit("listing.status").alias("action"),
        F.lit("listing").alias("target_type"),
        F.col("listing_id").cast("string").alias("target_id"),
        F.concat(F.lit("Statut → "), F.col("status"), F.lit(".")).alias("summary"),
    )
