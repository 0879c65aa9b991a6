"""Collecting for many searches in one job."""

from __future__ import annotations

import re
from collections.abc import Sequence
from dataclasses import dataclass

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from hearthmark.functions import html as page
from hearthmark.operators.once import with_once
from hearthmark.operators.runs import plan_counters
from hearthmark.operators.visibility import connectors_for_searches
from hearthmark.plans.extraction import STRATEGIES, api_items, as_fields, discover, extract_pages
from hearthmark.plans.ingest import Plan, plan_ingestion
from hearthmark.plans.normalise import normalize_listings
from hearthmark.session import checkpointed
from hearthmark.sources.feeds import explode_items, map_fields
from hearthmark.sources.tables import scan_for_batch

# Kinds that read items instead of pages, kinds that can leave out rentals, and texts of the run log.
JSON_API, TERM_API = "json_api", "wordpress_rest"
SALE_ONLY_KINDS = ("sitemap_html",)
UNKNOWN_KIND = "Type de connecteur de site inconnu : « %s »."
NO_CONNECTOR = "Aucun connecteur autorisé configuré — pas de collecte automatique."
COLLECTED = "Connecteur %s : %d annonce(s) récupérée(s)."
LEFT_OUT = "Connecteur %s ignoré : %s"
BAD_PATTERN = "detailUrlPattern invalide : %s"
NO_SITEMAP = "sitemap %s : %s"
#: Kinds that take the addresses of their sitemap only, and never those of linked pages.
SITEMAP_ONLY_KINDS = ("netty",)


@dataclass
class Collected:
    """Canonical listings and warnings per search, and the log events of the runs."""

    listings: DataFrame
    warnings: DataFrame
    events: DataFrame


def connector_settings(connectors: DataFrame) -> DataFrame:
    """The options that a run reads from each connector's own configuration."""
    rows = with_once(connectors, _config=F.try_parse_json("config"))

    def option(name: str, kind: str) -> Column:
        return F.try_variant_get("_config", f"$.{name}", kind)

    named = F.schema_of_variant(F.try_variant_get("_config", "$.kind", "variant")) == "STRING"
    return rows.select(
        "connector_id",
        "source_id",
        F.when(named, option("kind", "string")).otherwise(F.lit(JSON_API)).alias("_kind"),
        F.nullif(F.coalesce(option("departments", "array<string>"), F.array().cast("array<string>")), F.array().cast("array<string>")).alias("_departments"),
        option("maxListings", "int").alias("_most"),
        F.coalesce(option("saleOnly", "boolean"), F.lit(False)).alias("_sale_only"),
        F.coalesce(option("listPath", "string"), F.lit("")).alias("_list_path"),
        option("map", "map<string,string>").alias("_map"),
        F.coalesce(option("taxonomies", "map<string,string>"), F.create_map().cast("map<string,string>")).alias("_taxonomies"),
        F.coalesce(option("sitemapUrls", "array<string>"), F.array_compact(F.array(option("sitemapUrl", "string")))).alias("_sitemaps"),
        option("detailUrlPattern", "string").alias("_detail"),
        option("crawlSeedPattern", "string").alias("_seed"),
        option("baseUrl", "string").alias("_base_url"),
    )


@F.pandas_udf(T.StringType())
def _pattern_error(patterns: pd.Series) -> pd.Series:
    """What is wrong with a pattern, one per connector; null if nothing is."""

    def wrong(pattern: str | None) -> str | None:
        if pattern is None:
            return None
        try:
            re.compile(pattern)
        except re.error as error:
            return str(error)
        # known here, not where the pattern is used
        return "unknown group" if re.search(r"\(\?(P[<=>]|\()", pattern) else None

    return patterns.map(wrong)


def discovered(docs: DataFrame, settings: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Pages of the connectors that name a sitemap, in the order of discovery, and warnings.

    ``docs(url, body)`` holds every fetched document once: sitemaps, the pages
    that they list and detail pages. A pattern that is none, and a sitemap that
    was not fetched, are warnings.
    """
    sites = settings.where(F.col("_kind").isin(*STRATEGIES) & F.col("_detail").isNotNull() & (F.size("_sitemaps") > 0))
    # a few columns per connector, and the patterns are looked at once
    sites = checkpointed(sites.select("connector_id", "_kind", "_sitemaps", "_detail", "_seed", "_base_url").withColumns(
        {"_wrong": _pattern_error("_detail"), "_wrong_seed": _pattern_error("_seed")}
    ))
    roots = sites.where("_wrong is null and _wrong_seed is null").select(
        F.col("connector_id").alias("connector"), "_kind", "_detail", "_seed", "_base_url", F.posexplode("_sitemaps").alias("_nth", "sitemap_url")
    )
    absent = roots.join(docs.select(F.col("url").alias("sitemap_url")), "sitemap_url", "left_anti")
    warnings = (
        sites.where("_wrong is not null").select("connector_id", F.format_string(BAD_PATTERN, "_wrong").alias("message"))
        .unionByName(
            sites.where("_wrong is null and _wrong_seed is not null")
            .select("connector_id", F.format_string(NO_SITEMAP, F.col("_sitemaps")[0], F.col("_wrong_seed")).alias("message"))
        )
        .unionByName(absent.select(F.col("connector").alias("connector_id"), F.format_string(NO_SITEMAP, "sitemap_url", F.lit("absent")).alias("message")))
    )
    crawls = ~F.col("_kind").isin(*SITEMAP_ONLY_KINDS)
    found = discover(docs, roots, F.col("_detail"), F.col("_seed"), base=F.col("_base_url"), crawls=crawls)
    pages = found.join(docs.select("url", F.col("body").alias("html")), "url")
    return pages.select(F.col("connector").alias("connector_id"), "url", "html", "position"), warnings


def _inside(text: Column) -> Column:
    """Whether a text names no department or one of the connector's own."""
    code = page.department(text)
    return F.col("_departments").isNull() | code.isNull() | F.array_contains("_departments", code)


def _within_limits(pages: DataFrame) -> DataFrame:
    """Pages of the wanted departments; of connectors that name a maximum the first ones."""
    rows = pages.where(_inside(F.col("url")))
    place = [F.col("position")] if "position" in pages.columns else []
    order = Window.partitionBy("connector_id").orderBy(*place, "url")
    # only addresses are sorted, the bodies stay where they are
    listed = rows.where(F.col("_most").isNotNull()).select("connector_id", "url", "_most", *place)
    first = listed.withColumn("_rank", F.row_number().over(order)).where(F.col("_rank") <= F.col("_most"))
    capped = rows.where(F.col("_most").isNotNull()).join(first.select("connector_id", "url"), ["connector_id", "url"], "left_semi")
    return rows.where(F.col("_most").isNull()).unionByName(capped)


_OWN = ["connector_id", "source_id", "_departments"]


def _from_pages(pages: DataFrame, settings: DataFrame) -> list[tuple[DataFrame, DataFrame | None]]:
    """Raw rows and warnings of every page strategy, by each connector's own options."""
    sourced = _within_limits(pages.join(settings, "connector_id"))
    found = []
    for kind in STRATEGIES:
        for sale_only in (False, True) if kind in SALE_ONLY_KINDS else (False,):
            wanted = F.col("_kind") == kind
            if kind in SALE_ONLY_KINDS:
                wanted &= F.col("_sale_only") == sale_only
            own = sourced.where(wanted).select(*_OWN, "url", "html")
            extracted = extract_pages(own, kind, {"saleOnly": sale_only})
            warned = extracted.warnings if "connector_id" in extracted.warnings.columns else None
            found.append((as_fields(extracted.raws), warned))
    return found


def _from_payloads(payloads: DataFrame, settings: DataFrame) -> DataFrame:
    """Raw rows of the JSON answers, by each connector's list path and field map."""
    # departments restrict sites, not feeds
    own = settings.where(F.col("_kind") == JSON_API).withColumn("_departments", F.lit(None).cast("array<string>"))
    rows = payloads.join(own.select(*_OWN, "_list_path", "_map"), "connector_id")
    items = explode_items(rows, "payload", F.col("_list_path"))
    return map_fields(items, "item", F.col("_map")).select(*_OWN, "fields")


def _from_terms(payloads: DataFrame, terms: DataFrame, pages: DataFrame, settings: DataFrame) -> DataFrame:
    """Raw rows of API items whose fields are terms, by each connector's taxonomies; detail pages add price and surface."""
    own = settings.where(F.col("_kind") == TERM_API)
    rows = payloads.join(own.select("connector_id", "_most", "_taxonomies"), "connector_id")
    items = explode_items(rows, "payload").where(F.col("_most").isNull() | (F.col("pos") < F.col("_most")))
    details = pages.join(own.select("connector_id"), "connector_id", "left_semi").select("url", "html").dropDuplicates(["url"])
    raws = api_items(items.drop("_most").withColumnRenamed("connector_id", "connector"), terms, "_taxonomies", details)
    named = as_fields(raws).withColumnRenamed("connector", "connector_id").join(own.select(*_OWN), "connector_id")
    return named.select(*_OWN, "fields")


def collect_pages(
    searches: DataFrame,
    connectors: DataFrame,
    pages: DataFrame,
    payloads: DataFrame | None = None,
    terms: DataFrame | None = None,
    docs: DataFrame | None = None,
    failures: DataFrame | None = None,
) -> Collected:
    """Extract and normalise what was fetched for all usable connectors.

    ``pages(connector_id, url, html[, position])`` serve the kinds that read
    pages, ``payloads(connector_id, payload)`` the JSON answers of the others and
    ``terms(connector, taxonomy, term_id, name)`` their term names. With
    ``docs(url, body)`` connectors that name a sitemap find their pages
    themselves (see :func:`discovered`). ``failures(connector_id, message)``
    names connectors whose fetch failed: they are left out with a warning. Every
    connector's configuration picks its kind and options; an unknown kind is a
    warning. Extraction runs once per connector; the result is then joined to
    every search that uses it.
    """
    chosen = connectors_for_searches(connectors, searches)
    working = chosen if failures is None else chosen.join(failures.select("connector_id"), "connector_id", "left_anti").select(*chosen.columns)
    settings = connector_settings(working.dropDuplicates(["connector_id"]))
    parts = _from_pages(pages, settings)
    if docs is not None:
        found, missed = discovered(docs, settings)
        parts += _from_pages(found, settings)
        parts.append((None, missed))
    if payloads is not None:
        parts.append((_from_payloads(payloads, settings), None))
        if terms is not None:
            parts.append((_from_terms(payloads, terms, pages, settings), None))
    unknown = settings.where(~F.col("_kind").isin(*STRATEGIES, JSON_API, TERM_API))
    warnings = unknown.select("connector_id", F.format_string(UNKNOWN_KIND, "_kind").alias("message"))
    raws = None
    for fields, warned in parts:
        if fields is not None:
            rows = fields.select(*_OWN, "fields")
            raws = rows if raws is None else raws.unionByName(rows)
        if warned is not None:
            warnings = warnings.unionByName(warned.select("connector_id", "message"))
    code = F.try_variant_get(F.try_element_at("fields", F.lit("postalCode")), "$", "string")
    # pages are read once, whatever is asked of a run
    scoped = checkpointed(raws.where(_inside(code)).drop("_departments").withColumnRenamed("source_id", "_source"))
    good, errors = normalize_listings(scoped, source="_source")
    good, warnings = checkpointed(good), checkpointed(warnings.unionByName(errors.select("connector_id", "message")))
    per_search = chosen.select("search_id", "user_id", "connector_id")
    listings = good.drop("_source").join(per_search, "connector_id")
    warned = warnings.join(per_search, "connector_id").withColumn("_step", F.lit("normalize"))
    if failures is not None:
        failed = chosen.join(failures.select("connector_id", "message"), "connector_id")
        failed = failed.select("connector_id", F.format_string(LEFT_OUT, "source_id", "message").alias("message"), "search_id", "user_id", F.lit("collect").alias("_step"))
        warned = warned.unionByName(failed)
    return Collected(listings, warned.drop("_step"), _events(searches, chosen, working, listings, warned))


def _events(searches: DataFrame, chosen: DataFrame, working: DataFrame, listings: DataFrame, warnings: DataFrame) -> DataFrame:
    """Log events ``(search_id, user_id, level, step, message)`` of the runs."""

    def event(rows: DataFrame, level: str, step: str | Column, message: Column) -> DataFrame:
        step = F.lit(step) if isinstance(step, str) else step
        return rows.select("search_id", "user_id", F.lit(level).alias("level"), step.alias("step"), message.alias("message"))

    counts = listings.groupBy("search_id", "connector_id").agg(F.count(F.lit(1)).alias("_n"))
    used = working.join(counts, ["search_id", "connector_id"], "left")
    idle = searches.join(chosen.select("search_id").distinct(), "search_id", "left_anti")
    return (
        event(used, "info", "collect", F.format_string(COLLECTED, "source_id", F.coalesce("_n", F.lit(0))))
        .unionByName(event(warnings, "warn", F.col("_step"), F.col("message")))
        .unionByName(event(idle, "info", "collect", F.lit(NO_CONNECTOR)))
    )


def run_rows(searches: DataFrame, connectors: DataFrame, counters: DataFrame, trigger: str, now: Column) -> DataFrame:
    """One finished run per search, also for searches without connector or data."""
    served = connectors_for_searches(connectors, searches).select("search_id").distinct().withColumn("_served", F.lit(True))
    zero = F.lit(0).cast("bigint")
    counts = [c for c in counters.columns if c not in ("search_id", "status")]
    outcome = (
        F.when(F.col("_served").isNull(), "no-connector").when(F.coalesce("fetched", zero) == 0, "no-data").otherwise("ok")
    )
    return (
        searches.select("search_id", "user_id")
        .join(served, "search_id", "left")
        .join(counters, "search_id", "left")
        .select(
            "search_id",
            "user_id",
            F.lit(trigger).alias("run_trigger"),
            now.alias("finished_at"),
            outcome.alias("outcome"),
            F.coalesce("status", F.lit("success")).alias("status"),
            *[F.coalesce(c, zero).alias(c) for c in counts],
        )
    )


def mark_run(searches: DataFrame, now: Column) -> DataFrame:
    """The searches after their runs: every one of them has run at ``now``."""
    return searches.withColumn("last_run_at", now)


@dataclass
class Runs:
    """What the runs of a job leave: the plan, run rows, log events and the searches."""

    plan: Plan
    runs: DataFrame
    events: DataFrame
    searches: DataFrame
    collected: Collected


def _new_ids(existing: DataFrame, key: list[str]) -> Column:
    """Ids from the key: a digest where stored ids are texts, else a 64-bit hash."""
    if isinstance(existing.schema["id"].dataType, T.StringType):
        return F.sha2(F.to_json(F.array(*[F.col(c).cast("string") for c in key])), 256)
    return F.xxhash64(*key)


def run_searches(
    searches: DataFrame,
    connectors: DataFrame,
    pages: DataFrame,
    existing: DataFrame,
    now: Column,
    payloads: DataFrame | None = None,
    terms: DataFrame | None = None,
    trigger: str = "schedule",
    tenant: Sequence[str] = ("user_id",),
    docs: DataFrame | None = None,
    failures: DataFrame | None = None,
) -> Runs:
    """Plan, run rows and log of all given searches (see :func:`hearthmark.operators.runs.due_searches`).

    The searches of a tenant count as run one after the other by their id: a
    listing that several collect is new (or changed) for the first one, which
    gets its alerts, and known to the others.  Listings are matched with stored
    ones of their own tenants and sources.
    """
    collected = collect_pages(searches, connectors, pages, payloads, terms, docs, failures)
    key = [*tenant, "source_id", "external_id"]
    rest = [c for c in collected.listings.columns if c not in key]
    first = collected.listings.groupBy(*key).agg(F.min_by(F.struct(*rest), "search_id").alias("_row")).select(*key, "_row.*")
    batch = checkpointed(first.withColumn("id", _new_ids(existing, key)))
    plan = plan_ingestion(batch, scan_for_batch(existing, batch, tenant), searches, tenant)
    subjects = plan.upserts.select("id", "search_id")
    met = collected.listings.select("search_id", *key).distinct()
    kinds = plan.upserts.select(*key, F.col("search_id").alias("_first"), F.col("kind").alias("_kind"))
    again = F.when(F.col("search_id") == F.col("_first"), F.col("_kind")).otherwise("update")
    upserts = met.join(kinds, key).withColumn("kind", again)
    counters = plan_counters(collected.listings, upserts, plan.similarities.join(subjects, "id"), plan.notifications, collected.warnings)
    runs = run_rows(searches, connectors, counters, trigger, now)
    return Runs(plan, runs, collected.events, mark_run(searches, now), collected)
