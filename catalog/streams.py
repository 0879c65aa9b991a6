"""STR and PIPE-3: streaming jobs run to completion over the driver tables, and collection runs."""

from __future__ import annotations

from pyspark.sql import functions as F

from catalog.analytics import NOW, now, text_of
from catalog.extraction import _PAGE_SQL as PAGE_SQL
from catalog.extraction import _SITEMAP_SQL as SITEMAP_SQL
from catalog.extraction import _SOLD_SQL as SOLD_SQL
from catalog.extraction import KEY_SQL, SLUG_SQL, URL_CODE, text_code_sql
from catalog.ingestion import state_of, stored_listings
from catalog.joins import searches_of
from catalog.matching import with_hashes
from catalog.normalisation import LIST_SQL
from catalog.registry import register
from hearthmark.operators.relevance import criteria_rows
from hearthmark.plans import collect
from hearthmark.plans.ingest import ingest_store
from hearthmark.sources.tables import shared_folder
from hearthmark.streaming import jobs


def as_stream(df, order: str, parts: int = 3):
    """Write the rows in ``parts`` consecutive steps of two files each and read them back one step per micro-batch."""
    spark = df.sparkSession
    folder = shared_folder(spark)
    low, high = df.agg(F.min(order), F.max(order)).first()
    width = (high - low) / parts
    for part in range(parts):
        below = F.lit(True) if part == parts - 1 else F.col(order) < F.lit(low + width * (part + 1))
        rows = df.where((F.col(order) >= F.lit(low + width * part)) & below)
        dealt = rows.repartition(2).write.mode("append")
        dealt.parquet(folder)
    return spark.readStream.schema(df.schema).option("maxFilesPerTrigger", 2).parquet(folder)


def _finished(query):
    query.awaitTermination()
    if query.exception() is not None:
        raise query.exception()


def _price_stream(t):
    points = t("price_points").withColumnRenamed("observed_at", "captured_at").withColumn("price", F.round(F.col("price") / 20))
    folder = shared_folder(points.sparkSession)
    _finished(jobs.price_change_stream(as_stream(points, "captured_at"), folder))
    return text_of(points.sparkSession.read.parquet(f"{folder}/points"), "observed_at").select("listing_id", "observed_at", "tiebreak", "price")


register(
    "STR-2",
    _price_stream,
    """select listing_id, cast(observed_at as varchar) as observed_at, tiebreak, price from (
         select listing_id, observed_at, tiebreak, round(price / 20) as price,
                lag(round(price / 20)) over (partition by listing_id order by observed_at, tiebreak) as p from price_points) x
       where p is null or p <> price""",
    "price_points",
)


def _dispatch_stream(t):
    rows = t("notifications").select("notification_id", "user_id", "created_at", "dispatched_at")
    # an at-least-once feed: a third of the notifications arrives a second time
    repeated = rows.unionByName(rows.where("notification_id % 3 = 1").withColumn("created_at", F.expr("created_at + interval 200 hours")))
    folder = shared_folder(rows.sparkSession)
    _finished(jobs.dispatch_once_stream(as_stream(repeated, "created_at"), folder, now))
    left = rows.sparkSession.read.parquet(f"{folder}/dispatched")
    return left.groupBy("notification_id").agg(F.count(F.lit(1)).alias("times"), F.max(F.col("dispatched_at").cast("string")).alias("dispatched_at"))


register(
    "STR-3",
    _dispatch_stream,
    f"select notification_id, cast(1 as bigint) as times, '{NOW}' as dispatched_at from notifications where dispatched_at is null",
    "notifications",
)


def _ingest_stream(t):
    state = state_of(t)
    incoming = with_hashes(t("incoming"))
    folder = shared_folder(incoming.sparkSession)
    _finished(jobs.start_ingest_stream(as_stream(incoming, "id", 2), state, folder, lambda batch: now(), searches_of(t)))
    return ingest_store(incoming.sparkSession, f"{folder}/state")


register(
    "STR-1",
    lambda t: _ingest_stream(t).read("listings").select("id", "source_id", "external_id", "price", (F.col("last_seen_at") == now()).alias("seen")),
    """select e.id, e.source_id, e.external_id, coalesce(i.price, e.price) as price, i.id is not null as seen
       from existing e left join incoming i on i.source_id = e.source_id and i.external_id = e.external_id
       union all select i.id, i.source_id, i.external_id, i.price, true from incoming i
         left join existing e on i.source_id = e.source_id and i.external_id = e.external_id where e.id is null""",
    "incoming",
    "existing",
)

register(
    "STR-1.versions",
    lambda t: _ingest_stream(t).read("versions").groupBy("listing_id").agg(F.count(F.lit(1)).alias("versions"), F.max_by("price", "captured_at").alias("price")),
    """select id as listing_id, count(*) as versions, arg_max(price, at_) as price from (
         select id, price, 0 as at_ from existing union all select id, price, 1 from incoming) v group by 1""",
    "incoming",
    "existing",
)


def _fetched(t):
    return t("ad_pages").select((F.col("page_id") % 100 + 1).alias("connector_id"), "url", "html")


def _collected(t):
    return collect.collect_pages(searches_of(t), t("connectors"), _fetched(t))


def _collection_runs(t):
    done = collect.run_searches(searches_of(t), t("connectors"), _fetched(t), stored_listings(t).drop("phash"), now())
    return done.runs.select("search_id", "outcome", "status", "fetched", "added", "updated", "warnings")


def _department_sql(x: str) -> str:
    return f"substr(nullif(regexp_extract(coalesce({x}, ''), '(^|[^0-9])(\\d{{5}})([^0-9]|$)', 2), ''), 1, 2)"


_IN_SCOPE = "({0} is null or {0} = department or {0} = '63')"
COLLECT_SQL = f"""with {PAGE_SQL}, {SLUG_SQL},
    chosen as (select s.search_id, s.user_id, c.connector_id, c.source_id, coalesce(c.config ->> '$.kind', 'json_api') as kind, c.config ->> '$.departments[0]' as department
        from searches s join connectors c on c.user_id = s.user_id
        where c.enabled and c.mode = 'authorized_api' and (len({LIST_SQL.format('s.source_ids')}) = 0 or list_contains({LIST_SQL.format('s.source_ids')}, c.source_id))),
    found as (select page_id % 100 + 1 as connector_id, 'sitemap_html' as kind, {KEY_SQL} as external_id, {_department_sql('url')} as d1,
            {_department_sql(f"coalesce({text_code_sql('title')}, {URL_CODE})")} as d2 from base
        union all select page_id % 100 + 1, 'netty', coalesce(ref, url), null, null from base join slug using (page_id, url) where not {SOLD_SQL}),
    kept as (select search_id, user_id, source_id, connector_id, trim(external_id) as external_id from chosen join found using (connector_id, kind)
        where department is null or ({_IN_SCOPE.format('d1')} and {_IN_SCOPE.format('d2')}))"""

register(
    "PIPE-3",
    _collection_runs,
    COLLECT_SQL
    + """, n as (select search_id, count(*) as fetched from kept group by 1),
        firsts as (select user_id, source_id, external_id, min(search_id) as first_id from kept group by 1, 2, 3),
        keys as (select distinct k.search_id, k.user_id, k.source_id, k.external_id, k.search_id = f.first_id as first_time
            from kept k join firsts f using (user_id, source_id, external_id)),
        planned as (select k.search_id, count(*) filter (e.id is null and first_time) as added, count(*) filter (e.id is not null or not first_time) as updated
            from keys k left join existing e on e.user_id = k.user_id and e.source_id = k.source_id and e.external_id = k.external_id group by 1)
        select s.search_id, case when s.search_id not in (select search_id from chosen) then 'no-connector' when coalesce(fetched, 0) = 0 then 'no-data' else 'ok' end as outcome,
               'success' as status, coalesce(fetched, 0) as fetched, coalesce(added, 0) as added, coalesce(updated, 0) as updated, cast(0 as bigint) as warnings
        from searches s left join n using (search_id) left join planned using (search_id)""",
    "searches",
    "connectors",
    "ad_pages",
    "existing",
)
register(
    "PIPE-3.listings",
    lambda t: _collected(t).listings.select("search_id", "connector_id", "source_id", "external_id"),
    COLLECT_SQL + " select search_id, connector_id, source_id, external_id from kept",
    "searches",
    "connectors",
    "ad_pages",
)
register(
    "PIPE-3.events",
    lambda t: _collected(t).events.select("search_id", "level", "step", "message"),
    COLLECT_SQL
    + f""" select c.search_id, 'info' as level, 'collect' as step, 'Connecteur ' || c.source_id || ' : ' || count(k.external_id) || ' annonce(s) récupérée(s).' as message
        from chosen c left join kept k on k.search_id = c.search_id and k.connector_id = c.connector_id group by c.search_id, c.connector_id, c.source_id
        union all select search_id, 'info', 'collect', '{collect.NO_CONNECTOR}' from searches where search_id not in (select search_id from chosen)""",
    "searches",
    "connectors",
    "ad_pages",
)


def _sites(t):
    """One connector per sitemap root; every third one has a pattern that is none, and one sitemap was never fetched."""
    config = F.to_json(
        F.struct(
            F.lit("sitemap_network").alias("kind"),
            F.col("sitemap_url").alias("sitemapUrl"),
            F.when(F.col("n") % 3 == 2, "/(en|fr").otherwise("/(en|fr|de|es)/[0-9]+").alias("detailUrlPattern"),
        )
    )
    roots = t("site_roots").select("connector", "sitemap_url", (F.col("connector") + 1).cast("long").alias("n"))
    return roots.select(
        "n", F.col("n").alias("connector_id"), F.concat(F.lit("src"), F.col("n").cast("string")).alias("source_id"), "connector", config.alias("config")
    )


def _discovered(t):
    return collect.discovered(t("site_docs"), collect.connector_settings(_sites(t)))


_ROOTS_SQL = " ranked as (select connector, sitemap_url, connector + 1 as n from site_roots)"

register(
    "PIPE-3.discovered",
    lambda t: _discovered(t)[0].select("connector_id", "url", F.sha2("html", 256).alias("html_sha256")),
    "with "
    + SITEMAP_SQL.format(children=1000000, detail="/(en|fr|de|es)/[0-9]+")
    + ", "
    + _ROOTS_SQL
    + """, seeds as (select connector, sitemap_url, unnest(locs) as url from (select l.*, r.sitemap_url from located l join site_roots r using (connector)) x
             where not exists (select 1 from direct d where d.connector = x.connector)),
        hrefs as (select s.connector, regexp_extract(s.sitemap_url, '^[a-z]+://[^/]+') as base, unnest(regexp_extract_all(p.body, '(?i)href=["'']([^"'']+)["'']', 1)) as href
             from seeds s join site_docs p on p.url = s.url),
        found as (select connector, url from direct union select connector, case when href like 'http%' then href when href like '/%' then base || href else base || '/' || href end
             from hrefs where regexp_matches(case when href like 'http%' then href when href like '/%' then base || href else base || '/' || href end, '/(en|fr|de|es)/[0-9]+'))
        select r.n as connector_id, f.url, sha256(d.body) as html_sha256 from found f join ranked r using (connector) join site_docs d on d.url = f.url where r.n % 3 <> 2""",
    "site_roots",
    "sitemap_docs",
    "site_docs",
)
register(
    "PIPE-3.warnings",
    lambda t: _discovered(t)[1].select("connector_id", F.split("message", " : ")[0].alias("message")),
    f"with {_ROOTS_SQL} select n as connector_id, case when n % 3 = 2 then 'detailUrlPattern invalide' else 'sitemap ' || sitemap_url end as message "
    "from ranked where n % 3 = 2 or sitemap_url not in (select url from sitemap_docs)",
    "site_roots",
    "sitemap_docs",
)
