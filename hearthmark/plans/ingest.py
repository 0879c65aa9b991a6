"""Planning and applying an ingestion batch."""

from __future__ import annotations

from collections.abc import Callable, Sequence
from dataclasses import dataclass
from functools import cached_property

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from hearthmark.functions.listing import fingerprint
from hearthmark.functions.numbers import number_text
from hearthmark.functions.scoring import PRICE_DROP_PCT, PROBABLE_SCORE, change_detail, change_kind, price_drop, republication
from hearthmark.operators.matching import best_matches, canonical_edges
from hearthmark.operators.relevance import prepare_searches, score_relevance
from hearthmark.session import checkpointed, snapshot
from hearthmark.sources.store import Facts, Keyed, Store

# Relevance from which a listing is worth an alert; alert titles.
MIN_RELEVANCE = 50
TITLES = {
    "new_listing": "Nouvelle annonce",
    "price_drop": "Baisse de prix",
    "recycled": "Annonce recyclée probable",
    "important_change": "Modification importante",
    "probable_duplicate": "Doublon probable",
}


class Plan:
    """Upserts of a batch; matching runs when similarities or notifications are first asked for."""

    def __init__(self, upserts: DataFrame, judge: Callable[[], tuple[DataFrame, DataFrame]]):
        self.upserts = upserts
        self._judge = judge

    @cached_property
    def _judged(self) -> tuple[DataFrame, DataFrame]:
        return self._judge()

    @property
    def similarities(self) -> DataFrame:
        return self._judged[0]

    @property
    def notifications(self) -> DataFrame:
        return self._judged[1]


def last_per_key(incoming: DataFrame, keys: Sequence[str], position: str) -> DataFrame:
    """A key repeated in one batch counts once, with its last row."""
    rest = [c for c in incoming.columns if c not in keys]
    last = incoming.groupBy(*keys).agg(F.max_by(F.struct(*rest), F.col(position)).alias("_row"))
    return last.select(*keys, "_row.*")


def with_fingerprint(listings: DataFrame) -> DataFrame:
    parts = [F.col(c) for c in ("price", "surface_m2", "rooms", "title", "description")]
    return listings.withColumn("fingerprint", fingerprint(*parts))


def _alert(kind: str, body: Column, payload: Column) -> list[Column]:
    return [
        F.lit(kind).alias("type"),
        F.lit(TITLES[kind]).alias("title"),
        body.alias("body"),
        F.concat_ws(":", "source_id", "external_id").alias("subject_key"),
        F.to_json(payload).alias("payload"),
    ]


def plan_ingestion(
    incoming: DataFrame,
    existing: DataFrame,
    searches: DataFrame | None = None,
    tenant: Sequence[str] = ("user_id",),
    price_drop_pct: float = PRICE_DROP_PCT,
    min_relevance: int = MIN_RELEVANCE,
    probable: int = PROBABLE_SCORE,
    mode: str = "blocked",
) -> Plan:
    """Upserts, similarity edges and notifications of a batch.

    ``incoming`` holds canonical listings with a unique ``id`` and the tenant
    columns, one row per (tenant, source, external id); ``existing`` adds
    ``fingerprint``, ``source_status`` and ``disappeared``. Searches are joined
    on ``search_id``. Alerts about price drops, recycled and duplicate listings
    do not depend on relevance.
    """
    tenant = list(tenant)
    key = [*tenant, "source_id", "external_id"]
    stored = existing.select(
        *key,
        F.col("id").alias("matched_id"),
        F.struct("price", "fingerprint", F.col("source_status").alias("status")).alias("_before"),
    )
    # by its key, as the last rows per key are spread already; later steps move no texts
    rows = incoming.join(stored, key, "left")
    if searches is None:
        rated = rows.withColumns({"relevance": F.lit(100), "excluded": F.lit(False)})
    else:
        # kept, so that Spark knows the size of the criteria and sends few of them to the listings instead of moving all listings
        criteria = snapshot(prepare_searches(searches))
        rated = score_relevance(rows.join(criteria, "search_id", "left")).drop("_criteria")
        rated = rated.withColumns({"excluded": F.col("relevance.excluded"), "relevance": F.col("relevance.score")})
    rated = with_fingerprint(rated)
    given = [c for c in rated.columns if c not in (*key, "matched_id", "_before")]
    planned = snapshot(
        rated.select(*key, *given, "matched_id", "_before").withColumn("kind", F.when(F.col("matched_id").isNull(), "insert").otherwise("update"))
    )
    kept = ["id", *tenant, *(["search_id"] if "search_id" in incoming.columns else [])]

    def judge() -> tuple[DataFrame, DataFrame]:
        alerts = _update_alerts(planned, kept, price_drop_pct, min_relevance)
        similarities, more = _insert_alerts(planned, existing, tenant, kept, min_relevance, probable, mode)
        return similarities, alerts.unionByName(more)

    return Plan(planned.drop("_before"), judge)


def _relevant(min_relevance: int) -> Column:
    return ~F.col("excluded") & (F.col("relevance") >= min_relevance)


def _update_alerts(planned: DataFrame, kept: list[str], price_drop_pct: float, min_relevance: int) -> DataFrame:
    """Known listings: a price drop first, else any notable change of a relevant one."""
    shown = F.coalesce("title", F.lit("Annonce"))
    before = {f: F.col("_before")[f] for f in ("price", "fingerprint", "status")} | {"media_count": F.lit(None).cast("int")}
    after = {
        "price": F.col("price"),
        "fingerprint": F.col("fingerprint"),
        "status": F.lit("active"),
        "media_count": F.lit(None).cast("int"),
    }
    updates = (
        planned.where(F.col("kind") == "update")
        .withColumns(
            {
                "_drop": price_drop(before["price"], after["price"], price_drop_pct),
                "_change": change_kind(before, after, price_drop_pct),
            }
        )
        .withColumn("_detail", change_detail(F.col("_change"), before, after))
    )
    drops = updates.where("_drop.dropped").select(
        *kept,
        *_alert(
            "price_drop",
            F.concat(
                shown, F.format_string(" : %.1f", "_drop.delta_pct"), F.lit(" % ("), number_text(F.col("_drop.delta_abs")), F.lit(" €)")
            ),
            F.struct("_drop.delta_pct", "_drop.delta_abs", F.col("price").alias("new_price")),
        ),
    )
    changes = updates.where(~F.col("_drop.dropped") & (F.col("_change") != "none") & _relevant(min_relevance)).select(
        *kept,
        *_alert(
            "important_change",
            F.concat(shown, F.lit(" : "), F.col("_detail")),
            F.struct(F.col("_change").alias("change"), F.col("_detail").alias("detail")),
        ),
    )
    return drops.unionByName(changes)


def _insert_alerts(
    planned: DataFrame, existing: DataFrame, tenant: list[str], kept: list[str], min_relevance: int, probable: int, mode: str
) -> tuple[DataFrame, DataFrame]:
    """New listings: edges to their best stored match and the alerts that follow."""
    shown = F.coalesce("title", F.lit("Annonce"))
    inserts = planned.where(F.col("kind") == "insert")
    matches = checkpointed(best_matches(inserts, existing, scope=tenant, mode=mode, stored=True))
    twins = existing.select(F.col("id").alias("with_id"), F.col("external_id").alias("_twin"), F.coalesce("disappeared", F.lit(False)).alias("_gone"))
    judged = (
        inserts.join(matches, "id")
        .join(twins, "with_id")
        .withColumn("_again", republication(F.col("_gone"), F.col("_twin") != F.col("external_id"), F.col("score"), probable))
    )
    similarities = judged.select(
        "id", *tenant, F.concat_ws(":", "source_id", "external_id").alias("subject_key"), "with_id", "score", "bucket"
    )
    recycled = judged.where("_again.recycled").select(
        *kept,
        *_alert(
            "recycled",
            F.col("_again.reason"),
            F.struct("with_id", "score", F.col("_again.confidence").alias("confidence")),
        ),
    )
    doubles = judged.where("not _again.recycled").select(
        *kept,
        *_alert(
            "probable_duplicate",
            F.concat(F.lit("Proche d'une annonce déjà suivie ("), F.col("score").cast("string"), F.lit("/100).")),
            F.struct("with_id", "score"),
        ),
    )
    news = inserts.where(_relevant(min_relevance)).join(matches.select("id"), "id", "left_anti").select(
        *kept,
        *_alert(
            "new_listing",
            # fixed value: the form of the text is part of the result
            F.concat(shown, F.coalesce(F.concat(F.lit(" — "), number_text(F.col("price")), F.lit(" €")), F.lit(""))),
            F.struct("relevance"),
        ),
    )
    return similarities, recycled.unionByName(doubles).unionByName(news)


@dataclass
class State:
    listings: DataFrame
    versions: DataFrame
    edges: DataFrame
    notifications: DataFrame


# Columns a batch may set on a stored listing.
CARRIED = (
    "search_id url title description price currency surface_m2 rooms bedrooms property_type floor dpe charges agency_fees "
    "lat lng postal_code city address_approx is_pro contact_name published_at source_updated_at media_urls phashes"
).split()


def apply_plan(state: State, plan: Plan, now: Column) -> State:
    """New state after a plan; the stored tables are never changed in place.

    Updated listings keep their id and first-seen time, their last change moves
    only with the fingerprint. Every upsert appends a version, edges are
    replaced per pair, notifications are appended.
    """
    stored = state.listings
    carried = [c for c in CARRIED if c in stored.columns and c in plan.upserts.columns]
    fresh = plan.upserts.where(F.col("kind") == "update").select(
        F.col("matched_id").alias("id"),
        F.struct(*carried, "fingerprint", F.col("relevance").alias("relevance_score")).alias("_new"),
    )
    hit = F.col("_new").isNotNull()
    changed = hit & ~F.col("_new.fingerprint").eqNullSafe(F.col("fingerprint"))
    updated = {c: F.when(hit, F.col(f"_new.{c}")).otherwise(F.col(c)) for c in [*carried, "fingerprint", "relevance_score"]}
    merged = (
        stored.join(fresh, "id", "left")
        .withColumns(
            {
                "last_seen_at": F.when(hit, now).otherwise(F.col("last_seen_at")),
                "last_changed_at": F.when(changed, now).otherwise(F.col("last_changed_at")),
                **updated,
            }
        )
        .drop("_new")
    )
    inserts = plan.upserts.where(F.col("kind") == "insert").withColumns(
        {
            "relevance_score": F.col("relevance"),
            "source_status": F.lit("active"),
            "disappeared": F.lit(False),
            "first_seen_at": now,
            "last_seen_at": now,
            "last_changed_at": now,
        }
    )
    known = [c for c in stored.columns if c in inserts.columns]
    listings = merged.unionByName(inserts.select(*known), allowMissingColumns=True)

    versions = plan.upserts.select(
        F.coalesce("matched_id", "id").alias("listing_id"),
        now.alias("captured_at"),
        *[c for c in ("price", "surface_m2", "rooms", "bedrooms", "title", "description") if c in plan.upserts.columns],
        F.lit("active").alias("source_status"),
        (F.size("media_urls") if "media_urls" in plan.upserts.columns else F.lit(0)).alias("media_count"),
        F.col("fingerprint").alias("content_hash"),
    )
    edges = plan.similarities.select(F.col("id").alias("a"), F.col("with_id").alias("b"), "score", "bucket")
    both = state.edges.select("a", "b", "score", "bucket", F.lit(0).alias("_age")).unionByName(edges.withColumn("_age", F.lit(1)))
    subjects = plan.upserts.select("id", F.coalesce("matched_id", "id").alias("listing_id"))
    alerts = plan.notifications.join(subjects, "id").drop("id").withColumns(
        {"created_at": now, "read_at": F.lit(None).cast("timestamp"), "dispatched_at": F.lit(None).cast("timestamp")}
    )
    return State(
        listings,
        state.versions.unionByName(versions, allowMissingColumns=True),
        canonical_edges(both, "_age").drop("_age"),
        state.notifications.unionByName(alerts, allowMissingColumns=True),
    )


def ingest_store(spark: SparkSession, folder: str, tenant: Sequence[str] = ("user_id",)) -> Store:
    """The tables of an ingest: listings by tenant and source, edges by pair, versions and notifications as facts."""
    scope = (*tenant, "source_id")
    tables = {"listings": Keyed((*scope, "external_id"), scope), "edges": Keyed(("a", "b")), "versions": Facts(), "notifications": Facts()}
    return Store(spark, folder, tables)


def start_store(store: Store, initial: State) -> None:
    """Version 0 of the tables."""
    store.commit(0, {name: getattr(initial, name) for name in store.tables})


def commit_batch(
    store: Store, version: int, incoming: DataFrame, searches: DataFrame | None, now: Column, tenant: Sequence[str] = ("user_id",), **options: int
) -> None:
    """Plan a batch on the version before it and commit what it makes or changes.

    Only listings of the tenants and sources of the batch are read; only changed
    and new listings, the batch's edges and its facts are written.  A version
    that is committed already stays as it is.
    """
    if version in store.versions():
        return
    incoming = snapshot(incoming)
    listings = store.read("listings", version - 1, like=incoming)
    empty = {name: store.read(name, version - 1).where(F.lit(False)) for name in ("versions", "edges", "notifications")}
    plan = plan_ingestion(incoming, listings, searches, tenant, **options)
    after = apply_plan(State(listings, **empty), plan, now)
    touched = plan.upserts.select(F.coalesce("matched_id", "id").alias("id"))
    changed = after.listings.join(touched, "id", "left_semi")
    store.commit(version, {"listings": changed, "edges": after.edges, "versions": after.versions, "notifications": after.notifications})
