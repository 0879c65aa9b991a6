"""JOIN, VIS and SCO-1: relevance, zones, lookups and visibility."""

from __future__ import annotations

from pyspark.sql import functions as F

from catalog.analytics import _OUTCOME_COLUMNS, _OUTCOME_SQL, NOW, _outcomes, now, text_of
from catalog.normalisation import LIST_SQL
from catalog.registry import fold_sql, haversine_sql, register
from hearthmark.operators import alerts, history, market, reports, visibility, zones
from hearthmark.operators.relevance import criteria_rows, relevance, with_polygons


def searches_of(t):
    return with_polygons(criteria_rows(t("searches")).drop("polygon"), t("vertices"))


# even-odd rule over the ring edges of each (listing, search) pair
INSIDE_SQL = """
    select p.id, p.search_id, sum(case when (v.lat > p.lat) <> (u.lat > p.lat)
             and p.lng < (u.lng - v.lng) * (p.lat - v.lat) / (u.lat - v.lat + 2.220446049250313e-16) + v.lng then 1 else 0 end) % 2 = 1 as inside
    from {pairs} p join vertices v on v.search_id = p.search_id
    join vertices u on u.search_id = v.search_id and u.pos = case when v.pos = 1 then 5 else v.pos - 1 end
    group by 1, 2"""

_KEYWORD_FRACTION = f"""
    select l.id, count(*) as n, count(*) filter (contains(hay, trim({fold_sql('word')}))) as found
    from hay l join (select search_id, unnest({LIST_SQL.format('keywords_required')}) as word from searches) w on w.search_id = l.search_id
    group by 1"""
_BANNED = f"""
    select distinct l.id from hay l
    join (select search_id, unnest({LIST_SQL.format('keywords_excluded')}) as word from searches) w on w.search_id = l.search_id
    where contains(hay, trim({fold_sql('word')}))"""


def _fit(value: str, low: str, high: str, margin: str) -> str:
    return (
        f"case when {low} is not null and {value} < {low} then greatest(0, 1 - ({low} - {value}) / greatest(1, abs({low}) * {margin})) "
        f"when {high} is not null and {value} > {high} then greatest(0, 1 - ({value} - {high}) / greatest(1, abs({high}) * {margin})) else 1.0::double end"
    )


def relevance_sql(listings: str) -> str:
    """CTEs ending in ``scored(id, search_id, score, excluded)`` for the rows of ``listings``."""
    return f"""
    hay as (select id, search_id, {fold_sql("coalesce(title, '') || ' ' || coalesce(description, '')")} as hay from {listings}),
    located as (select id, search_id, lat, lng from {listings} where lat is not null and lng is not null),
    inside as ({INSIDE_SQL.format(pairs='located')}),
    wanted_words as ({_KEYWORD_FRACTION}),
    banned as ({_BANNED}),
    factors as (
      select l.id, s.search_id, s.search_id is null as free,
             b.id is not null or (case when l.lat is null or l.lng is null then false when i.inside is not null then not i.inside
               when s.radius_km is not null then {haversine_sql('s.center_lat', 's.center_lng', 'l.lat', 'l.lng')} > s.radius_km * 1000 else false end) as excluded,
             case when l.price is not null then floor({_fit('l.price', 's.price_min', 's.price_max', '0.25::double')} * 30 * 10 + 0.5) / 10 end as c1,
             case when l.surface_m2 is not null then floor({_fit('l.surface_m2', 's.surface_min', 's.surface_max', '0.25::double')} * 20 * 10 + 0.5) / 10 end as c2,
             case when l.rooms is not null then floor({_fit('cast(l.rooms as double)', 'cast(s.rooms_min as double)', 'cast(s.rooms_max as double)', '0.5::double')} * 15 * 10 + 0.5) / 10 end as c3,
             case when l.property_type <> '' and len({LIST_SQL.format('s.property_types')}) > 0
                  then case when list_contains({LIST_SQL.format('s.property_types')}, l.property_type) then 15.0::double else 0.0::double end end as c4,
             case when w.n > 0 then floor(w.found / w.n * 20 * 10 + 0.5) / 10 end as c5
      from {listings} l left join searches s on s.search_id = l.search_id
      left join inside i on i.id = l.id left join wanted_words w on w.id = l.id left join banned b on b.id = l.id),
    scored as (
      select id, search_id, coalesce(excluded and not free, false) as excluded,
             cast(case when free then 100 when excluded then 0
               when c1 is null and c2 is null and c3 is null and c4 is null and c5 is null then 50
               else floor((coalesce(c1, 0) + coalesce(c2, 0) + coalesce(c3, 0) + coalesce(c4, 0) + coalesce(c5, 0))
                 / (case when c1 is null then 0 else 30 end + case when c2 is null then 0 else 20 end + case when c3 is null then 0 else 15 end
                    + case when c4 is null then 0 else 15 end + case when c5 is null then 0 else 20 end) * 100 + 0.5) end as int) as score,
             c1, c2, c3, c4, c5 from factors)"""


def _flat_relevance(t):
    scored = relevance(t("listings"), searches_of(t))

    def part(name):
        return F.try_element_at(F.filter("relevance.factors", lambda f: f["factor"] == name), F.lit(1))["contribution"]

    return scored.select(
        "id",
        F.col("relevance.score").alias("score"),
        F.col("relevance.excluded").alias("excluded"),
        *[part(n).alias(a) for n, a in (("prix", "c1"), ("surface", "c2"), ("pièces", "c3"), ("type", "c4"), ("mots-clés", "c5"))],
    )


register(
    "SCO-1",
    _flat_relevance,
    "with "
    + relevance_sql("listings")
    + " "
    + ", ".join(["select id, score, excluded"] + [f"case when excluded or search_id is null then null else c{i} end as c{i}" for i in range(1, 6)])
    + " from scored",
    "listings",
    "searches",
    "vertices",
)
register(
    "JOIN-3",
    lambda t: relevance(t("listings"), searches_of(t))
    .groupBy("search_id")
    .agg(
        F.count(F.lit(1)).alias("listings"),
        F.count_if("relevance.excluded").alias("excluded"),
        F.count_if(F.col("relevance.score") >= 50).alias("relevant"),
        F.max("relevance.score").alias("best"),
    ),
    "with "
    + relevance_sql("listings")
    + """ select l.search_id, count(*) as listings, count(*) filter (excluded) as excluded, count(*) filter (score >= 50) as relevant,
                max(score) as best from scored join listings l using (id) group by 1""",
    "listings",
    "searches",
    "vertices",
)
register(
    "JOIN-1",
    lambda t: t("incoming")
    .select("id", "source_id", "external_id")
    .join(t("existing").select("source_id", "external_id", F.col("id").alias("matched_id")), ["source_id", "external_id"], "left")
    .select("id", "matched_id", F.when(F.col("matched_id").isNull(), "insert").otherwise("update").alias("kind")),
    """select i.id, e.id as matched_id, case when e.id is null then 'insert' else 'update' end as kind
       from incoming i left join existing e on e.source_id = i.source_id and e.external_id = i.external_id""",
    "incoming",
    "existing",
)
register(
    "JOIN-4",
    lambda t: zones.radius_join(
        t("listings").select("id", "lat", "lng"), t("searches").select("search_id", "center_lat", "center_lng", "radius_km"), 0.02
    ).select("id", "search_id", F.round("distance_m", 3).alias("distance_m")),
    f"""select id, s.search_id, round({haversine_sql('s.center_lat', 's.center_lng', 'l.lat', 'l.lng')}, 3) as distance_m
        from listings l join searches s on {haversine_sql('s.center_lat', 's.center_lng', 'l.lat', 'l.lng')} <= s.radius_km * 1000
        where l.lat is not null and l.lng is not null""",
    "listings",
    "searches",
)
register(
    "JOIN-5",
    lambda t: zones.polygon_join(t("listings").select("id", "lat", "lng"), searches_of(t).select("search_id", "polygon"), 0.02).select(
        "id", "search_id"
    ),
    "with located as (select l.id, s.search_id, l.lat, l.lng from listings l, searches s where l.lat is not null and s.has_polygon), inside as ("
    + INSIDE_SQL.format(pairs="located")
    + ") select id, search_id from inside where inside",
    "listings",
    "searches",
    "vertices",
)
register(
    "JOIN-6",
    lambda t: reports.similar_listings(t("edges"), t("listings").select("id", "title", "price")),
    """select listing_id, e.id, score, bucket, title, price from (
         select a as listing_id, b as id, score, bucket from edges union all select b, a, score, bucket from edges) e
       join listings l on l.id = e.id""",
    "edges",
    "listings",
)


def _via_public(t):
    searches = t("searches").select("search_id", "is_public")
    public = searches.where("is_public").select("search_id")
    return (
        t("listings").join(public, "search_id", "left_semi").groupBy("search_id").agg(F.count(F.lit(1)).alias("listings"))
    )


register(
    "JOIN-7",
    _via_public,
    """select search_id, count(*) as listings from listings l
       where exists (select 1 from searches s where s.search_id = l.search_id and s.is_public) group by 1""",
    "listings",
    "searches",
)
register(
    "JOIN-8",
    lambda t: _outcomes(t)
    .join(t("listings").select(F.col("id").alias("listing_id"), F.col("title").alias("listing_title")), "listing_id", "left")
    .select("notification_id", "listing_id", "listing_title", "webhook"),
    f"""select notification_id, o.listing_id, l.title as listing_title, webhook
        from (select notification_id, listing_id, {_OUTCOME_COLUMNS} from ({_OUTCOME_SQL}) x) o left join listings l on l.id = o.listing_id""",
    "notifications",
    "preferences",
    "subscriptions",
    "attempts",
    "listings",
)
register(
    "JOIN-9",
    lambda t: market.resolve_area(t("listings").select("id", "postal_code", "city"), t("communes")).select("id", "area", "department"),
    f"""with cand as (select l.id, c.code, c.population, {fold_sql('c.name')} = {fold_sql('l.city')} as named
                      from listings l join communes c on c.postal_code = l.postal_code),
             pick as (select id, code from (select *, row_number() over (partition by id order by coalesce(named, false) desc,
                        case when coalesce(named, false) then 0 else -coalesce(population, 0) end, code) as rn from cand) x where rn = 1),
             res as (select l.id, case when try_cast(postal_code as int) between 75001 and 75020 then cast(75100 + try_cast(postal_code as int) - 75000 as varchar)
                        when try_cast(postal_code as int) between 69001 and 69009 then cast(69380 + try_cast(postal_code as int) - 69000 as varchar)
                        when try_cast(postal_code as int) between 13001 and 13016 then cast(13200 + try_cast(postal_code as int) - 13000 as varchar)
                        else p.code end as area from listings l left join pick p on p.id = l.id)
        select id, area, case when area like '97%' then substr(area, 1, 3) else substr(area, 1, 2) end as department from res""",
    "listings",
    "communes",
)
register(
    "JOIN-10",
    lambda t: history.with_history(
        t("listings").select(F.col("id").alias("listing_id"), "title"), t("price_points"), page_rows=50
    ).select(
        "listing_id",
        "page",
        F.array_join(F.transform("points", lambda p: F.round(p["price"] * 100).cast("bigint").cast("string")), ",").alias("prices"),
    ),
    """select l.id as listing_id, cast(coalesce(page, 0) as int) as page, coalesce(prices, '') as prices from listings l left join (
         select listing_id, (rn - 1) // 50 as page, string_agg(cast(round(price * 100) as bigint), ',' order by rn) as prices
         from (select *, row_number() over (partition by listing_id order by observed_at, tiebreak) as rn from price_points) x group by 1, 2) p
       on p.listing_id = l.id""",
    "listings",
    "price_points",
)
register(
    "JOIN-11",
    lambda t: visibility.connectors_for_searches(t("connectors"), criteria_rows(t("searches"))).select("search_id", "connector_id"),
    f"""select s.search_id, c.connector_id from searches s join connectors c on c.user_id = s.user_id
        where c.enabled and c.mode = 'authorized_api' and (len({LIST_SQL.format('s.source_ids')}) = 0
          or list_contains({LIST_SQL.format('s.source_ids')}, c.source_id))""",
    "searches",
    "connectors",
)
register(
    "JOIN-12",
    lambda t: visibility.shared_connectors(t("connectors"), criteria_rows(t("searches"))).withColumn(
        "departments", F.array_join("departments", ",")
    ),
    f"""with pub as (select * from searches where is_public),
             src as (select distinct unnest({LIST_SQL.format('source_ids')}) as source_id from pub)
        select connector_id, source_id, label, enabled, coalesce(config ->> '$.kind', 'json_api') as kind,
               coalesce(array_to_string(from_json(config -> '$.departments', '["VARCHAR"]'), ','), '') as departments
        from connectors c where user_id in (select user_id from pub)
          and ((select count(*) from src) = 0 or source_id in (select source_id from src))""",
    "searches",
    "connectors",
)
VIEWER = 3
register(
    "JOIN-13",
    lambda t: text_of(
        visibility.shares_of_searches(t("shares"), t("users"), t("searches"), F.lit(VIEWER)), "created_at"
    ),
    f"""select sh.search_id, sh.shared_with, u.email, sh.role, cast(sh.created_at as varchar) as created_at
        from shares sh join users u on u.user_id = sh.shared_with
        where sh.search_id in (select search_id from searches where user_id = {VIEWER})""",
    "shares",
    "users",
    "searches",
)
register(
    "JOIN-13.email",
    lambda t: visibility.match_email(
        t("customer").select(
            F.col("c_custkey").alias("request_id"),
            F.concat(F.lit(" "), F.lower("c_mktsegment"), F.lit("."), F.col("c_custkey").cast("string"), F.lit("@EXAMPLE.com  ")).alias("email"),
        ),
        t("users").withColumn("email", F.trim("email")),
    ).select("request_id", "user_id"),
    """select c_custkey as request_id, u.user_id from customer c
       join users u on lower(trim(u.email)) = lower(trim(' ' || lower(c_mktsegment) || '.' || c_custkey || '@EXAMPLE.com  '))""",
    "users",
)

_READABLE = f"(select search_id from searches where is_public union select search_id from shares where shared_with = {VIEWER})"
register(
    "VIS-1.searches",
    lambda t: visibility.visible_searches(t("searches"), t("shares"), F.lit(VIEWER)).select("search_id", "user_id", "name"),
    f"select search_id, user_id, name from searches where user_id = {VIEWER} or search_id in {_READABLE}",
    "searches",
    "shares",
)
register(
    "VIS-1.listings",
    lambda t: visibility.visible_listings(t("listings"), t("searches"), t("shares"), F.lit(VIEWER)).select("id", "user_id", "search_id"),
    f"select id, user_id, search_id from listings where user_id = {VIEWER} or search_id in {_READABLE}",
    "listings",
    "searches",
    "shares",
)


def _owned_points(t):
    return t("price_points").withColumn("user_id", F.col("listing_id") % 5)


register(
    "VIS-1.prices",
    lambda t: visibility.visible_via_listing(_owned_points(t), "listing_id", t("listings"), t("searches"), F.lit(VIEWER)).select(
        "listing_id", "tiebreak", "price"
    ),
    f"""select listing_id, tiebreak, price from price_points where listing_id % 5 = {VIEWER}
          or listing_id in (select id from listings l join searches s using (search_id) where is_public)""",
    "price_points",
    "listings",
    "searches",
)
register(
    "VIS-1.edges",
    lambda t: visibility.visible_via_listing(
        t("edges").withColumn("user_id", F.col("a") % 5), "a", t("listings"), t("searches"), F.lit(VIEWER)
    ).select("a", "b", "seq"),
    f"""select a, b, seq from edges where a % 5 = {VIEWER}
          or a in (select id from listings l join searches s using (search_id) where is_public)""",
    "edges",
    "listings",
    "searches",
)
register(
    "SET-3",
    lambda t: visibility.readable_searches(t("searches"), t("shares"), F.lit(VIEWER))
    .unionByName(t("searches").where(F.col("user_id") == VIEWER).select("search_id"))
    .distinct(),
    f"select search_id from searches where user_id = {VIEWER} union select search_id from {_READABLE} r",
    "searches",
    "shares",
)
register(
    "PIPE-5",
    lambda t: text_of(
        alerts.stamp_dispatched(_outcomes(t).where(F.col("dispatched_at").isNull()), now()).select(
            "notification_id",
            "dispatched_at",
            F.col("delivery.channels.webhook").alias("webhook"),
            F.col("delivery.channels.push").alias("push"),
            F.col("delivery.push_sent").alias("push_sent"),
            F.col("delivery.push_failed").alias("push_failed"),
        ),
        "dispatched_at",
    ),
    f"select notification_id, '{NOW}' as dispatched_at, {_OUTCOME_COLUMNS} from ({_OUTCOME_SQL}) o where dispatched_at is null",
    "notifications",
    "preferences",
    "subscriptions",
    "attempts",
)
