"""SRC, NORM-1, NORM-4, PIPE and AGG-8: feeds, normalisation and ingestion plans."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import functions as F

from catalog.analytics import NOW, now, text_of
from catalog.joins import relevance_sql, searches_of
from catalog.matching import BEST_SQL, with_hashes
from catalog.registry import fnv_sql, fold_sql, half_up_sql, number_text_sql, parse_number_sql, register, squash_sql
from hearthmark.functions import listing, urls
from hearthmark.operators import market, runs, visibility
from hearthmark.operators.matching import canonical_edges
from hearthmark.plans import export, ingest, normalise
from hearthmark.sources import feeds, tables, transactions

FIELD_MAP = {
    "externalId": "ref",
    "title": "head.title",
    "city": "head.tags.0",
    "price": "price",
    "surface": "area",
    "rooms": "rooms",
    "type": "kind",
    "currency": "currency",
    "url": "link",
}

register(
    "SRC-1",
    lambda t: feeds.explode_items(t("feeds"), "payload", "data.pages.0.items").select(
        "item_id", "pos", F.schema_of_variant("item").startswith("OBJECT").alias("is_object"), F.try_variant_get("item", "$.head.title", "string").alias("title")
    ),
    """with node as (select item_id, case when item_id % 6 = 5 then null else json_extract(payload, '$.data.pages[0].items') end as n from feeds),
       lists as (select item_id, case when n is null or json_type(n) = 'NULL' then [] when json_type(n) = 'ARRAY' then from_json(n, '["JSON"]') else [n] end as items from node)
       select item_id, cast(pos - 1 as int) as pos, coalesce(json_type(item) = 'OBJECT', false) as is_object, item ->> '$.head.title' as title
       from (select item_id, unnest(items) as item, unnest(range(1, len(items) + 1)) as pos from lists) x""",
    "feeds",
)


def _mapped(t):
    items = t("raw_items").withColumn("item", F.try_parse_json("item"))
    return feeds.map_fields(items, "item", FIELD_MAP)


def _text(name):
    return F.try_variant_get(F.try_element_at("fields", F.lit(name)), "$", "string")


register(
    "SRC-2",
    lambda t: _mapped(t).select(
        "item_id", F.array_join(F.array_sort(F.map_keys("fields")), ",").alias("present"), _text("title").alias("title"), _text("city").alias("city")
    ),
    """select item_id, case when json_exists(item, '$.currency') then 'city,currency,externalId,price,rooms,surface,title,type,url'
              else 'city,externalId,price,rooms,surface,title,type,url' end as present,
              item ->> '$.head.title' as title, item ->> '$.head.tags[0]' as city from raw_items""",
    "raw_items",
)
register(
    "SRC-3",
    lambda t: feeds.listings_from_urls(t("pages").select(F.concat(F.lit("  "), F.col("url")).alias("line")), "line").select(
        "url", "source_id", "external_id", "currency"
    ),
    """select url, 'import_generique' as source_id, coalesce(nullif(regexp_extract(url, '(\\d{5,})', 1), ''),
              regexp_replace(lower(regexp_extract(url, '^https?://([^/?#:]+)', 1)) || coalesce(nullif(regexp_extract(url, '^https?://[^/?#]+([^?#]*)', 1), ''), '/'), '/$', '')) as external_id,
              'EUR' as currency
       from pages where regexp_matches(url, '^https?://')""",
)
register(
    "NORM-4",
    lambda t: t("pages")
    .unionByName(t("listings").select(F.col("id").alias("page_id"), F.col("title").alias("url"), F.col("description").alias("html")))
    .select(
        "page_id",
        F.coalesce(
            urls.external_id(F.col("url")), listing.content_id(F.col("html"), F.col("url"), F.col("page_id").cast("double"))
        ).alias("external_id"),
    ),
    f"""select page_id, coalesce(nullif(regexp_extract(url, '(\\d{{5,}})', 1), ''),
               case when regexp_matches(url, '^[A-Za-z][A-Za-z0-9+.-]*://[^/?#]+') then
                 regexp_replace(lower(regexp_extract(url, '^[A-Za-z][A-Za-z0-9+.-]*://([^/?#:]+)', 1)) || coalesce(nullif(regexp_extract(url, '^[A-Za-z][A-Za-z0-9+.-]*://[^/?#]+([^?#]*)', 1), ''), '/'), '/$', '') end,
               'imp-' || {fnv_sql("html || '|' || url || '|' || page_id")}) as external_id
        from (select page_id, url, html from pages union all select id, title, description from listings) p""",
    "listings",
)


def _normalised(t):
    return normalise.normalize_listings(_mapped(t), source="source")


def _json_number(path):
    raw = f"(item ->> '{path}')"
    return f"(case when json_type(item -> '{path}') = 'VARCHAR' then {parse_number_sql(raw)} when json_type(item -> '{path}') <> 'NULL' then cast({raw} as double) end)"


_TYPE_RULES = " ".join(
    f"when regexp_matches({fold_sql('kind')}, '{p}') then '{n}'" for p, n in listing.PROPERTY_TYPES
)
_ITEM_SQL = f"""
    item as (select item_id, source as source_id, trim(item ->> '$.ref') as ref, nullif(trim(item ->> '$.head.title'), '') as title, item ->> '$.head.tags[0]' as city,
             case when json_type(item -> '$.price') <> 'BOOLEAN' then {_json_number('$.price')} end as price, json_type(item -> '$.price') = 'BOOLEAN' as bad_price,
             {_json_number('$.area')} as surface_m2, cast(floor({_json_number('$.rooms')} + 0.5) as int) as rooms,
             nullif(trim(item ->> '$.kind'), '') as kind, coalesce(json_type(item -> '$.currency') not in ('VARCHAR'), false) as bad_currency,
             coalesce(item ->> '$.currency', 'EUR') as currency, item ->> '$.link' as url from raw_items)"""
register(
    "NORM-1",
    lambda t: _normalised(t)[0].select(
        "item_id", "source_id", "external_id", "url", "title", "price", "currency", F.round("surface_m2", 6).alias("surface_m2"), "rooms", "property_type", "city"
    ),
    f"""with {_ITEM_SQL}
        select item_id, source_id, coalesce(ref, nullif(regexp_extract(url, '(\\d{{5,}})', 1), ''),
                 case when url is not null then regexp_replace(lower(regexp_extract(url, '^https?://([^/?#:]+)', 1)) || regexp_extract(url, '^https?://[^/?#]+([^?#]*)', 1), '/$', '') end,
                 'imp-' || {fnv_sql("coalesce(title, '') || '|' || coalesce(url, '') || '|' || coalesce(" + number_text_sql('price') + ", '')")}) as external_id,
               url, title, price, currency, round(surface_m2, 6) as surface_m2, rooms,
               case when kind is null then null {_TYPE_RULES} else 'autre' end as property_type, city
        from item where not bad_price and not bad_currency""",
    "raw_items",
)
register(
    "NORM-1.errors",
    lambda t: _normalised(t)[1].select("item_id", "message"),
    f"""with {_ITEM_SQL} select item_id, case when bad_price and bad_currency then 'price: Invalid input, currency: Invalid input'
               when bad_price then 'price: Invalid input' else 'currency: Invalid input' end as message
        from item where bad_price or bad_currency""",
    "raw_items",
)


def _preview(t):
    items = feeds.explode_items(t("feeds"), "payload", "data.pages.0.items")
    counts, sample, errors = normalise.preview(items, "item_id", FIELD_MAP)
    n_sample = sample.groupBy("item_id").agg(F.count(F.lit(1)).alias("sampled"), F.max("title").alias("title"))
    n_errors = errors.groupBy("item_id").agg(F.count(F.lit(1)).alias("errors"))
    zero = F.lit(0)
    return (
        counts.join(n_sample, "item_id", "left")
        .join(n_errors, "item_id", "left")
        .withColumns({"sampled": F.coalesce("sampled", zero), "errors": F.coalesce("errors", zero)})
    )


register(
    "PIPE-4",
    _preview,
    # the null entry of a list maps to an empty row that is still a valid listing
    """with shape as (select f.item_id, case f.item_id % 6 when 0 then 3 when 1 then 1 when 4 then 1 else 0 end as n,
              case f.item_id % 6 when 0 then 2 when 1 then 1 when 4 then 1 else 0 end as real_items,
              r.item_id % 5 = 4 or r.item_id % 7 = 3 as bad, nullif(trim(r.item ->> '$.head.title'), '') as title
         from feeds f join raw_items r on r.item_id = f.item_id)
       select item_id, cast(n as bigint) as count, cast(n - case when bad then real_items else 0 end as bigint) as sampled,
              case when not bad then title end as title, cast(case when bad then real_items else 0 end as bigint) as errors
       from shape where n > 0""",
    "feeds",
    "raw_items",
)
register(
    "SRC-4",
    lambda t: tables.scan_for_batch(t("existing"), t("incoming")).select("id", "user_id", "source_id", "price"),
    """select id, user_id, source_id, price from existing e where exists (
         select 1 from incoming i where i.user_id = e.user_id and i.source_id = e.source_id)""",
    "existing",
    "incoming",
)


def _csv_reference(t):
    """Sales written as CSV with quoted fields and some rows of the wrong width, then read and summarised."""
    sales = t("transactions")
    spark = sales.sparkSession
    quoted = F.concat(F.lit('"'), F.col("type_local"), F.lit(', dit ""'), F.col("type_local"), F.lit('"""'))
    number = F.col("value").cast("decimal(18,2)").cast("string")
    cells = [F.lit("m"), number, F.col("area").cast("string"), quoted, F.col("surface").cast("int").cast("string")]
    broken = F.col("value") % 7 < 1
    line = F.when(broken, F.concat_ws(",", *cells, F.lit("extra"))).otherwise(F.concat_ws(",", *cells))
    folder = tables.shared_folder(spark)
    header = "id_mutation,valeur_fonciere,code_commune,type_local,surface_reelle_bati"
    # every CSV part carries the header line that the reader expects
    lines = sales.select(line.alias(header))
    lines.write.option("header", True).option("quote", "").option("sep", "\x01").csv(folder)
    return market.market_reference(transactions.read_transactions(spark, folder))


register(
    "SRC-5",
    _csv_reference,
    """with sales as (select cast(area as varchar) as area, type_local || ', dit "' || type_local || '"' as type_local,
                             cast(cast(value as decimal(18, 2)) as double) as value, cast(cast(surface as int) as double) as surface
                      from transactions where not (value % 7 < 1)),
            r as (select area, type_local, value / surface as ppm, row_number() over (partition by area, type_local order by value / surface) as rn,
                         count(*) over (partition by area, type_local) as n
                  from sales where surface > 5 and value / surface between 200 and 50000)
       select k.area, k.type_local, coalesce(max(n), 0) as count,
              cast(floor(max(ppm) filter (rn - 1 = least(n - 1, cast(floor(0.5 * n) as bigint))) + 0.5) as bigint) as median,
              cast(floor(max(ppm) filter (rn - 1 = least(n - 1, cast(floor(0.25 * n) as bigint))) + 0.5) as bigint) as p25,
              cast(floor(max(ppm) filter (rn - 1 = least(n - 1, cast(floor(0.75 * n) as bigint))) + 0.5) as bigint) as p75
       from (select distinct area, type_local from sales) k left join r on r.area = k.area and r.type_local = k.type_local group by 1, 2""",
    "transactions",
)

# ---------------------------------------------------------------- ingestion plans


def stored_listings(t):
    rows = ingest.with_fingerprint(with_hashes(t("existing")))
    # stored rows of every fourth listing carry the fingerprint of an older text
    return rows.withColumns(
        {
            "fingerprint": F.when(F.col("id") % 4 == 2, F.reverse("fingerprint")).otherwise(F.col("fingerprint")),
            "source_status": F.when(F.col("id") % 20 == 14, F.lit("vendu")).otherwise(F.col("source_status")),
        }
    )


def plan_of(t):
    batch = ingest.last_per_key(with_hashes(t("incoming")), ["user_id", "source_id", "external_id"], "id")
    return ingest.plan_ingestion(batch, stored_listings(t), searches_of(t))


_LINE_SQL = "concat_ws('|', {0}, {1}, {2}, {3}, {4})".format(
    *[f"coalesce({number_text_sql(c)}, '')" for c in ("price", "surface_m2", "rooms")],
    squash_sql(fold_sql("title")),
    squash_sql(fold_sql("description")),
)
PLAN_SQL = (
    relevance_sql("incoming")
    + f""", prints as (select id, {fnv_sql('line')} as fingerprint from (select id, {_LINE_SQL} as line from incoming) l),
    old_prints as (select id, case when id % 4 = 2 then reverse({fnv_sql('line')}) else {fnv_sql('line')} end as fingerprint from (select id, {_LINE_SQL} as line from existing) l),
    planned as (select i.id, i.user_id, i.source_id, i.external_id, i.title, i.price, e.id as matched_id, e.price as old_price, p.fingerprint, o.fingerprint as old_fingerprint,
                       case when e.id % 20 = 14 then 'vendu' else 'active' end as old_status, s.score as relevance, s.excluded
                from incoming i join prints p on p.id = i.id join scored s on s.id = i.id
                left join existing e on e.source_id = i.source_id and e.external_id = i.external_id and e.user_id = i.user_id
                left join old_prints o on o.id = e.id)"""
)
ALERT_SQL = """
    changed as (select id, case when old_price > 0 and (price - old_price) / old_price * 100 <= -3 then 'price_drop'
                  when (old_status <> 'active' or price > old_price or fingerprint <> old_fingerprint) and not excluded and relevance >= 50 then 'important_change' end as type
                from planned where matched_id is not null),
    judged as (select b.id, case when e.external_id <> p.external_id and b.score >= 78 then 'recycled' else 'probable_duplicate' end as type
               from best b join planned p on p.id = b.id join existing e on e.id = b.with_id),
    alerts as (select id, type from changed where type is not null union all select id, type from judged
               union all select id, 'new_listing' from planned where matched_id is null and not excluded and relevance >= 50 and id not in (select id from best))"""

register(
    "PIPE-1.upserts",
    lambda t: plan_of(t).upserts.select("id", "kind", "matched_id", "fingerprint", "relevance", "excluded"),
    "with " + PLAN_SQL + """ select id, case when matched_id is null then 'insert' else 'update' end as kind, matched_id, fingerprint, relevance, excluded from planned""",
    "incoming",
    "existing",
    "searches",
    "vertices",
)
register(
    "PIPE-1.similarities",
    lambda t: plan_of(t).similarities.select("id", "subject_key", "with_id", "score", "bucket"),
    "with "
    + BEST_SQL
    + " select b.id, i.source_id || ':' || i.external_id as subject_key, with_id, score, bucket from best b join incoming i on i.id = b.id",
    "listings",
    "incoming",
    "existing",
)
# the scored relevance and the scored pairs share a CTE name, so one is renamed
_PLAN_ALONE = PLAN_SQL.replace("scored", "rated")
register(
    "PIPE-1.notifications",
    lambda t: plan_of(t).notifications.select("id", "type", "subject_key"),
    "with "
    + BEST_SQL
    + ", "
    + _PLAN_ALONE
    + ", "
    + ALERT_SQL
    + " select a.id, a.type, p.source_id || ':' || p.external_id as subject_key from alerts a join planned p on p.id = a.id",
    "listings",
    "incoming",
    "existing",
    "searches",
    "vertices",
)


def state_of(t):
    listings = stored_listings(t).drop("phash").withColumns(
        {
            "relevance_score": F.lit(0),
            "first_seen_at": F.lit("2023-12-01 00:00:00").cast("timestamp"),
            "last_seen_at": F.lit("2023-12-02 00:00:00").cast("timestamp"),
        }
    )
    versions = listings.select(
        F.col("id").alias("listing_id"), F.col("last_seen_at").alias("captured_at"), "price", "title", F.col("fingerprint").alias("content_hash")
    )
    edges = canonical_edges(t("edges"), "seq").select("a", "b", "score", "bucket")
    return ingest.State(listings, versions, edges, t("notifications").select("listing_id", "user_id", F.col("event_type").alias("type"), "created_at"))


def _applied(t):
    return ingest.apply_plan(state_of(t), plan_of(t), now())


#: Edges after a batch: those of the batch, and stored ones of other pairs.
EDGES_SQL = """, stored as (select a, b, score, bucket from (select least(a, b) as a, greatest(a, b) as b, score, bucket,
              row_number() over (partition by least(a, b), greatest(a, b) order by seq desc) as rn from edges where a <> b) x where rn = 1),
           fresh_edges as (select least(id, with_id) as a, greatest(id, with_id) as b, score, bucket from best)
         select a, b, score, bucket from fresh_edges
         union all select a, b, score, bucket from stored s where not exists (select 1 from fresh_edges f where f.a = s.a and f.b = s.b)"""

register(
    "PIPE-2.listings",
    lambda t: text_of(_applied(t).listings, "first_seen_at", "last_seen_at", "last_changed_at").select(
        "id", "source_id", "external_id", "price", "fingerprint", "relevance_score", "first_seen_at", "last_seen_at", "last_changed_at"
    ),
    "with "
    + PLAN_SQL
    + f""" select e.id, e.source_id, e.external_id, coalesce(p.price, e.price) as price, coalesce(p.fingerprint, o.fingerprint) as fingerprint,
              cast(coalesce(p.relevance, 0) as int) as relevance_score, '2023-12-01 00:00:00' as first_seen_at,
              case when p.id is null then '2023-12-02 00:00:00' else '{NOW}' end as last_seen_at,
              case when p.fingerprint <> o.fingerprint then '{NOW}' else cast(e.last_changed_at as varchar) end as last_changed_at
       from existing e join old_prints o on o.id = e.id left join planned p on p.matched_id = e.id
       union all
       select id, source_id, external_id, price, fingerprint, relevance, '{NOW}', '{NOW}', '{NOW}' from planned where matched_id is null""",
    "incoming",
    "existing",
    "searches",
    "vertices",
)
register(
    "PIPE-2.versions",
    lambda t: _applied(t).versions.groupBy("listing_id").agg(F.count(F.lit(1)).alias("versions"), F.max_by("price", "captured_at").alias("price")),
    """select id as listing_id, count(*) as versions, arg_max(price, at_) as price from (
         select id, price, 0 as at_ from existing union all select id, price, 1 from incoming) v group by 1""",
    "incoming",
    "existing",
)
register(
    "PIPE-2.edges",
    lambda t: _applied(t).edges.select("a", "b", "score", "bucket"),
    "with "
    + BEST_SQL
    + EDGES_SQL,
    "listings",
    "incoming",
    "existing",
    "edges",
)


def _run_counters(t):
    plan = plan_of(t)
    batch = t("incoming")
    subjects = plan.upserts.select("id", "search_id")
    warnings = batch.where(F.col("contact_name").isNull()).select("search_id")
    return runs.plan_counters(batch, plan.upserts, plan.similarities.join(subjects, "id"), plan.notifications, warnings)


register(
    "AGG-8",
    _run_counters,
    "with "
    + BEST_SQL
    + ", "
    + _PLAN_ALONE
    + ", "
    + ALERT_SQL
    + """ select i.search_id, count(*) as fetched, count(*) filter (p.matched_id is null) as added, count(*) filter (p.matched_id is not null) as updated,
              count(b.id) as similarities, count(a.id) as notifications, count(*) filter (i.contact_name is null) as warnings,
              case when count(*) filter (i.contact_name is null) > 0 then 'partial' else 'success' end as status
       from incoming i join planned p on p.id = i.id left join best b on b.id = i.id left join alerts a on a.id = i.id group by 1""",
    "listings",
    "incoming",
    "existing",
    "searches",
    "vertices",
)


# a batch is matched with the stored listings of its own tenants and sources
_IN_BATCH = " and exists (select 1 from incoming b where b.user_id = e.user_id and b.source_id = e.source_id)"
_SCOPED_BEST_SQL = BEST_SQL.replace("join existing e on e.user_id = f.user_id)", f"join existing e on e.user_id = f.user_id{_IN_BATCH})")


def _stored(t):
    """The state as version 0 of bucketed tables, and the batch committed as version 1."""
    spark = t("listings").sparkSession
    store = ingest.ingest_store(spark, tables.shared_folder(spark))
    ingest.start_store(store, state_of(t))
    ingest.commit_batch(store, 1, with_hashes(t("incoming")), searches_of(t), now())
    return store


register(
    "SRC-6",
    lambda t: _stored(t).read("listings").groupBy("source_id").agg(F.count(F.lit(1)).alias("listings"), F.sum("price").alias("price")),
    """select source_id, count(*) as listings, sum(price) as price from (
         select e.source_id, coalesce(i.price, e.price) as price from existing e left join incoming i on i.source_id = e.source_id and i.external_id = e.external_id
         union all select i.source_id, i.price from incoming i left join existing e on i.source_id = e.source_id and i.external_id = e.external_id where e.id is null) x
       group by 1""",
    "incoming",
    "existing",
)
register(
    "SRC-6.versions",
    lambda t: _stored(t).read("versions").groupBy("listing_id").agg(F.count(F.lit(1)).alias("versions"), F.max_by("price", "captured_at").alias("price")),
    """select id as listing_id, count(*) as versions, arg_max(price, at_) as price from (
         select id, price, 0 as at_ from existing union all select id, price, 1 from incoming) v group by 1""",
    "incoming",
    "existing",
)
register(
    "SRC-6.edges",
    lambda t: _stored(t).read("edges").select("a", "b", "score", "bucket"),
    "with "
    + _SCOPED_BEST_SQL
    + EDGES_SQL,
    "listings",
    "incoming",
    "existing",
    "edges",
)
register(
    "SRC-6.notifications",
    lambda t: _stored(t).read("notifications").where("title is not null").select("listing_id", "type", "subject_key"),
    "with "
    + _SCOPED_BEST_SQL
    + ", "
    + _PLAN_ALONE
    + ", "
    + ALERT_SQL
    + " select coalesce(p.matched_id, p.id) as listing_id, a.type, p.source_id || ':' || p.external_id as subject_key from alerts a join planned p on p.id = a.id",
    "listings",
    "incoming",
    "existing",
    "searches",
    "vertices",
)


_VIEWER = 2
_PUBLIC = "(select search_id from searches where is_public)"
_READABLE = f"(select search_id from searches where is_public union select search_id from shares where shared_with = {_VIEWER})"
_BY_LISTING = f"in (select id from listings where search_id in {_PUBLIC})"
_EXPORT_RULES = {
    "searches": f"user_id = {_VIEWER} or search_id in {_READABLE}",
    "listings": f"user_id = {_VIEWER} or search_id in {_READABLE}",
    "shares": f"owner_id = {_VIEWER} or shared_with = {_VIEWER}",
    "price_points": f"user_id = {_VIEWER} or listing_id {_BY_LISTING}",
    "edges": f"user_id = {_VIEWER} or a {_BY_LISTING}",
    "versions": f"listing_id in (select id from listings where user_id = {_VIEWER})",
    **dict.fromkeys(("notifications", "run_rows", "connectors", "preferences", "subscriptions"), f"user_id = {_VIEWER}"),
    "qualification_log": f"listing_id in (select id from listings where user_id = {_VIEWER})",
}
# every column of every table in its order; fractions end in #
_EXPORTED = {
    "searches": "search_id user_id name price_min# price_max# surface_min# surface_max# rooms_min rooms_max property_types keywords_required "
    "keywords_excluded center_lat# center_lng# radius_km# has_polygon frequency active last_run_at is_public source_ids",
    "listings": "id user_id search_id source_id external_id url title description price# surface_m2# rooms property_type lat# lng# "
    "contact_name postal_code city phash last_changed_at",
    "shares": "share_id search_id owner_id shared_with role created_at",
    "price_points": "listing_id observed_at price# tiebreak user_id",
    "edges": "a b score bucket seq user_id",
    "versions": "listing_id captured_at tiebreak price# surface_m2# rooms bedrooms title description media_count source_status",
    "notifications": "notification_id user_id event_type created_at listing_id dispatched_at read_at title",
    "run_rows": "run_id search_id user_id run_trigger status created_at started_at finished_at added updated warnings",
    "connectors": "connector_id user_id source_id label enabled mode config",
    "preferences": "user_id has_webhook webpush_enabled",
    "subscriptions": "subscription_id user_id",
    "qualification_log": "seq listing_id at action status tag verified anomaly_count",
}


def _export(t):
    """Export of all tables that one user may read, read back; a row is the digest of all its columns."""
    given = {n: t(n) for n in _EXPORTED}
    given["price_points"] = given["price_points"].withColumn("user_id", F.col("listing_id") % 5)
    given["edges"] = given["edges"].withColumn("user_id", F.col("a") % 5)
    spark = given["listings"].sparkSession
    folder = tables.shared_folder(spark)
    export.export_tenant(given, F.lit(_VIEWER), folder)
    parts = []
    for name, rows in export.read_export(spark, folder).items():
        shown = [F.col(f.name).cast("decimal(24,6)") if f.dataType.typeName() == "double" else F.col(f.name) for f in rows.schema]
        line = F.concat_ws("|", *[F.coalesce(c.cast("string"), F.lit("~")) for c in shown])
        parts.append(rows.select(F.lit(name).alias("table_name"), F.md5(line).alias("row_md5")))
    return reduce(lambda a, b: a.unionByName(b), parts)


def _export_sql(name, columns):
    shown = [f"cast({c[:-1]} as decimal(24,6))" if c.endswith("#") else f'"{c}"' for c in columns.split()]
    line = ", ".join(f"coalesce(cast({c} as varchar), '~')" for c in shown)
    owner = {"price_points": ", listing_id % 5 as user_id", "edges": ", a % 5 as user_id"}.get(name, "")
    return f"select '{name}' as table_name, md5(concat_ws('|', {line})) as row_md5 from (select *{owner} from {name}) x where {_EXPORT_RULES[name]}"


register("SRC-7", _export, " union all ".join(_export_sql(n, c) for n, c in _EXPORTED.items()), *_EXPORTED)
