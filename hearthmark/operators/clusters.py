"""Duplicate clusters: connected components of the strong similarity edges."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from hearthmark.session import checkpointed

# Smallest score of a cluster edge; buckets from weak to strong.
MIN_SCORE = 78
BUCKET_ORDER = ("different", "similaire", "probable_identique", "doublon_exact")


def _signature(links: DataFrame) -> tuple:
    """Row count and hash total: two numbers that tell whether a round changed anything."""
    row = links.agg(
        F.count(F.lit(1)).alias("n"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)")).alias("h")
    ).first()
    return row["n"], row["h"]


def components(edges: DataFrame) -> DataFrame:
    """Label every node of ``edges(a, b)`` with the smallest node of its component.

    Alternating large-star and small-star rounds; a round never holds more
    links than the one before plus the nodes, and the number of rounds grows
    with the logarithm of the component size.
    """
    links = checkpointed(
        edges.where(F.col("a") != F.col("b"))
        .select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v"))
        .distinct()
    )
    seen = _signature(links)
    while True:
        both = links.unionByName(links.select(F.col("v").alias("u"), F.col("u").alias("v")))
        lowest = both.groupBy("u").agg(F.min("v").alias("m")).withColumn("m", F.least("u", "m"))
        large = both.join(lowest, "u").where(F.col("v") > F.col("u")).select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        down = large.groupBy("u").agg(F.min("v").alias("m"))
        small = (
            large.join(down, "u")
            .where(F.col("v") != F.col("m"))
            .select(F.col("v").alias("u"), F.col("m").alias("v"))
            .unionByName(down.select("u", F.col("m").alias("v")))
            .distinct()
        )
        links = checkpointed(small)
        now = _signature(links)
        if now == seen:
            break
        seen = now
    stars = links.groupBy("u").agg(F.min("v").alias("v"))
    roots = stars.select("v").distinct()
    return stars.select(F.col("u").alias("node"), F.col("v").alias("component")).unionByName(
        roots.select(F.col("v").alias("node"), F.col("v").alias("component"))
    )


def cluster_summary(edges: DataFrame, membership: DataFrame) -> DataFrame:
    """Per component: members, best score and strongest bucket (at least ``similaire``)."""
    rank = F.array_position(F.array(*[F.lit(b) for b in BUCKET_ORDER]), F.col("bucket"))
    strength = (
        edges.join(membership.withColumnRenamed("node", "a"), "a")
        .groupBy("component")
        .agg(F.max("score").alias("max_score"), F.greatest(F.lit(2), F.max(rank).cast("int")).alias("_rank"))
    )
    sizes = membership.groupBy("component").agg(F.count(F.lit(1)).alias("members"))
    kind = F.element_at(F.array(*[F.lit(b) for b in BUCKET_ORDER]), F.col("_rank"))
    return strength.join(sizes, "component").withColumn("kind", kind).drop("_rank")


def build_clusters(edges: DataFrame, min_score: int = MIN_SCORE) -> tuple[DataFrame, DataFrame]:
    """Membership ``(node, component)`` and summary of clusters with two members or more.

    Members stay one row each: a cluster may hold any number of listings.
    """
    kept = edges.where((F.col("score") >= min_score) & (F.col("a") != F.col("b")))
    membership = checkpointed(components(kept.select("a", "b")))
    return membership, cluster_summary(kept, membership)
