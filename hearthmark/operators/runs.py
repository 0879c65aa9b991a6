"""Collection runs, due searches and dashboard counts."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from hearthmark.functions.numbers import half_up

# Re-run ages and the manual refresh gap.
HOURLY_AGE, DAILY_AGE, REFRESH_GAP = "55 minutes", "23 hours", "10 minutes"


def due_searches(searches: DataFrame, now: Column) -> DataFrame:
    """Active searches whose last run is missing or too old for their frequency."""

    def older(age: str) -> Column:
        return F.col("last_run_at").isNull() | (F.col("last_run_at") < now - F.expr(f"INTERVAL {age}"))

    hourly = (F.col("frequency") == "hourly") & older(HOURLY_AGE)
    daily = (F.col("frequency") == "daily") & older(DAILY_AGE)
    return searches.where(F.col("active") & (hourly | daily)).select(
        "search_id", "user_id", "name", "frequency", "last_run_at"
    )


def refresh_gate(searches: DataFrame, now: Column) -> DataFrame:
    """Public active searches with the decision to run or to skip a refresh."""
    recent = F.col("last_run_at").isNotNull() & (now - F.expr(f"INTERVAL {REFRESH_GAP}") < F.col("last_run_at"))
    return searches.where(F.col("is_public") & F.col("active")).withColumn(
        "status", F.when(recent, F.lit("too-recent")).otherwise(F.lit("run"))
    )


def normalise_runs(rows: DataFrame) -> DataFrame:
    """Server run rows in the shape of the local log."""
    zero = F.lit(0)
    return rows.select(
        "run_id",
        F.coalesce("finished_at", "started_at", "created_at").alias("at"),
        F.when(F.col("run_trigger") == "manual", F.lit("manual")).otherwise(F.lit("schedule")).alias("run_trigger"),
        F.when(F.col("status").isin("success", "error"), F.col("status")).otherwise(F.lit("partial")).alias("status"),
        F.coalesce("added", zero).alias("added"),
        F.coalesce("updated", zero).alias("updated"),
        F.coalesce("warnings", zero).alias("warnings"),
    )


def run_metrics(runs: DataFrame, keys: tuple[str, ...] = ()) -> DataFrame:
    """Totals, counts per status, success rate over finished runs, sums and last time."""

    def counted(status: str) -> Column:
        return F.count_if(F.col("status") == status)

    def summed(name: str) -> Column:
        return F.coalesce(F.sum(F.coalesce(F.col(name), F.lit(0))), F.lit(0))

    done = F.col("success") + F.col("partial") + F.col("error")
    return (
        runs.groupBy(*keys)
        .agg(
            F.count(F.lit(1)).alias("total"),
            counted("success").alias("success"),
            counted("partial").alias("partial"),
            counted("error").alias("error"),
            summed("added").alias("total_added"),
            summed("updated").alias("total_updated"),
            summed("warnings").alias("total_warnings"),
            F.max("at").alias("last_at"),
        )
        .withColumn("success_rate", F.when(done > 0, half_up(F.col("success") / done * F.lit(100.0))))
    )


def newest_runs(runs: DataFrame, limit: int) -> DataFrame:
    return runs.orderBy(F.desc("at"), F.desc("run_id")).limit(limit)


def all_runs(local: DataFrame, server: DataFrame) -> DataFrame:
    return local.unionByName(server)


def event_counts(events: DataFrame) -> DataFrame:
    return events.groupBy("run_id", "level", "step").agg(F.count(F.lit(1)).alias("events"))


def plan_counters(
    fetched: DataFrame, upserts: DataFrame, similarities: DataFrame, notifications: DataFrame, warnings: DataFrame,
    key: str = "search_id",
) -> DataFrame:
    """Counters and final status of each run from the parts of its plan.

    Every part is reduced to counts per run before the parts meet.
    """
    zero = F.lit(0).cast("bigint")

    def part(df: DataFrame, **counts: Column) -> DataFrame:
        columns = ("fetched", "added", "updated", "similarities", "notifications", "warnings")
        return df.groupBy(key).agg(*[counts.get(c, F.sum(F.lit(0))).cast("bigint").alias(c) for c in columns])

    n = F.count(F.lit(1))
    parts = [
        part(fetched, fetched=n),
        part(upserts, added=F.count_if(F.col("kind") == "insert"), updated=F.count_if(F.col("kind") == "update")),
        part(similarities, similarities=n),
        part(notifications, notifications=n),
        part(warnings, warnings=n),
    ]
    merged = parts[0]
    for other in parts[1:]:
        merged = merged.unionByName(other)
    names = [c for c in merged.columns if c != key]
    return (
        merged.groupBy(key)
        .agg(*[F.coalesce(F.sum(c), zero).alias(c) for c in names])
        .withColumn("status", F.when(F.col("warnings") > 0, "partial").otherwise("success"))
    )


def dashboard(listings: DataFrame, searches: DataFrame, notifications: DataFrame, edges: DataFrame) -> DataFrame:
    """Number of listings, active searches, unread alerts and duplicate edges."""
    counts = (
        (listings, "listings", F.count(F.lit(1))),
        (searches, "active_searches", F.count_if("active")),
        (notifications, "unread", F.count_if(F.col("read_at").isNull())),
        (edges, "duplicates", F.count_if(F.col("bucket").isin("doublon_exact", "probable_identique"))),
    )
    rows = None
    for df, name, count in counts:
        row = df.agg(count.alias("value")).select(F.lit(name).alias("kpi"), "value")
        rows = row if rows is None else rows.unionByName(row)
    return rows
