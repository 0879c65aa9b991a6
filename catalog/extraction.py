"""EXT and SET-2: page, sitemap and API extraction."""

from __future__ import annotations

from pyspark.sql import functions as F

from catalog.registry import parse_number_sql, register
from hearthmark.functions import html, urls
from hearthmark.operators import reports
from hearthmark.plans import extraction

S = "[\\s\\x{00A0}\\x{202F}]"
NUM = "[\\d.\\x{0020}\\x{00A0}\\x{202F}]"
TEXT_SQL = "regexp_replace(html, '<[^>]+>', ' ', 'g')"
SEG_SQL = "list_filter(string_split(regexp_extract(url, '^[a-z]+://[^/?#]+([^?#]*)', 1), '/'), lambda s: s <> '')"


def got(x: str, pattern: str, group: int = 1) -> str:
    return f"(case when regexp_matches({x}, '{pattern}') then regexp_extract({x}, '{pattern}', {group}) end)"


def price_sql(x: str) -> str:
    labelled = parse_number_sql(got(x, f"(?i)prix[^0-9€]{{0,40}}?(\\d{NUM}{{3,}}){S}*€"))
    amounts = f"list_transform(regexp_extract_all({x}, '(\\d{NUM}{{3,}}){S}*€', 1), lambda m: {parse_number_sql('m')})"
    return f"(case when {labelled} >= 1000 then {labelled} else list_filter({amounts}, lambda n: n between 10000 and 20000000)[1] end)"


def surface_sql(x: str) -> str:
    labelled = parse_number_sql(got(x, f"(?i)surface[^0-9]{{0,40}}?(\\d+(?:[.,]\\d+)?){S}*m(?:²|2)(?:[^A-Za-z0-9_]|$)"))
    return f"(case when {labelled} > 0 then {labelled} else {parse_number_sql(got(x, f'(?i)(\\d+(?:[.,]\\d+)?){S}*m(?:²|2)(?:[^A-Za-z0-9_]|$)'))} end)"


def rooms_sql(x: str) -> str:
    return parse_number_sql(got(x, f"(?i)(\\d+){S}*pi[èe]ces?"))


_FULL_TITLE = f"nullif(trim(regexp_replace({got('html', '(?is)<title[^>]*>(.*?)</title>')}, '{S}+', ' ', 'g')), '')"
TITLE_SQL = f"coalesce(nullif(trim(split_part({_FULL_TITLE}, '|', 1)), ''), {_FULL_TITLE})"


def meta_sql(name: str) -> str:
    key = f"(?:property|name)=[\"'']{name}[\"'']"
    content = "content=[\"'']([^\"'']*)[\"'']"
    return f"coalesce({got('html', f'(?i)<meta[^>]+{key}[^>]+{content}')}, {got('html', f'(?i)<meta[^>]+{content}[^>]+{key}')})"


def capital_sql(w: str) -> str:
    return f"upper(substr({w}, 1, 1)) || substr({w}, 2)"


_PLACE_SEG = f"list_filter({SEG_SQL}, lambda s: regexp_matches(s, '^(.+)-(\\d{{5}})$'))[1]"
URL_CITY = f"array_to_string(list_transform(string_split(regexp_extract({_PLACE_SEG}, '^(.+)-(\\d{{5}})$', 1), '-'), lambda w: {capital_sql('w')}), ' ')"
URL_CODE = f"regexp_extract({_PLACE_SEG}, '^(.+)-(\\d{{5}})$', 2)"
_IN_TEXT = f"(\\p{{L}}(?:\\p{{L}}|{S}|[''’-])*?){S}+(\\d{{5}})(?:[^0-9]|$)"
_STOPS = ", ".join(f"'{w}'" for w in html.CITY_STOP)


def text_city_sql(x: str) -> str:
    words = f"list_filter(regexp_split_to_array({got(x, _IN_TEXT, 1)}, '{S}+'), lambda w: w <> '' and not regexp_matches(w, '^\\d+$') and lower(w) not in ({_STOPS}))"
    shaped = f"list_transform({words}, lambda w: case when length(w) <= 3 and w = upper(w) then w else upper(substr(w, 1, 1)) || lower(substr(w, 2)) end)"
    return f"nullif(array_to_string({shaped}, ' '), '')"


def text_code_sql(x: str) -> str:
    return got(x, _IN_TEXT, 2)


SALE_CITY = "nullif(trim(" + got("title", f"(?i)vente{S}+\\p{{L}}+{S}+(\\p{{L}}(?:\\p{{L}}|{S}|[''’-])*?){S}+\\d") + "), '')"
KEY_SQL = f"{SEG_SQL}[-1]"

# ---------------------------------------------------------------- single fields
DETAIL = "/(vente|fr|en|de|es)/"


def _discovered(t):
    return extraction.sitemap_urls(t("site_docs"), t("site_roots"), "/vente/")


_SITEMAP_SQL = """
    located as (select r.connector, d.body, regexp_matches(d.body, '(?i)<sitemapindex[\\s>]') as idx,
                       regexp_extract_all(d.body, '(?i)<loc>\\s*([^<\\s]+)\\s*</loc>', 1) as locs from site_roots r join sitemap_docs d on d.url = r.sitemap_url),
    flat as (select connector, 0 as parent, unnest(range(0, len(locs))) as at_, unnest(locs) as url from located where not idx),
    kids as (select connector, unnest(range(0, len(locs))) as parent, unnest(locs) as url from located where idx),
    nested as (select k.connector, k.parent, regexp_extract_all(d.body, '(?i)<loc>\\s*([^<\\s]+)\\s*</loc>', 1) as locs
               from kids k join sitemap_docs d on d.url = k.url where k.parent < {children}),
    every as (select * from flat union all select connector, parent, unnest(range(0, len(locs))), unnest(locs) from nested),
    direct as (select connector, url, min(parent * 1000 + at_) as ord from every where regexp_matches(url, '{detail}') group by 1, 2)"""

register(
    "EXT-1",
    lambda t: _discovered(t).select("connector", "url", (F.col("position._parent") * 1000 + F.col("position._at")).cast("bigint").alias("ord")),
    "with " + _SITEMAP_SQL.format(children=1000, detail="/vente/") + " select connector, url, cast(ord as bigint) as ord from direct",
    "site_roots",
    "sitemap_docs",
)
register(
    "SET-2",
    lambda t: reports.ordered_distinct(
        t("listings").select(F.substring_index("url", "/", 4).alias("url"), F.col("id").alias("position")), ["url"], "position"
    ),
    """select array_to_string(string_split(url, '/')[1:4], '/') as url, min(id) as position from listings group by 1""",
    "listings",
)


def _harvested(t):
    roots = t("site_roots")
    direct = extraction.sitemap_urls(t("site_docs"), roots, "/vente/")
    without = roots.join(direct.select("connector").distinct(), "connector", "left_anti")
    return extraction.harvest_links(t("site_docs"), without, "/[a-z]+$", base="https://m.example.net")


register(
    "EXT-2",
    lambda t: _harvested(t).select("connector", "url"),
    "with "
    + _SITEMAP_SQL.format(children=30, detail="/vente/")
    + """, seeds as (select connector, unnest(locs[1:20]) as url from located l where not exists (select 1 from direct d where d.connector = l.connector)),
       hrefs as (select s.connector, unnest(regexp_extract_all(p.html, '(?i)href=["'']([^"'']+)["'']', 1)) as href
                 from seeds s join (select distinct url, html from pages) p on p.url = s.url),
       abs_ as (select distinct connector, case when regexp_matches(href, '^[A-Za-z][A-Za-z0-9+.-]*:') then href when href like '//%' then 'https:' || href
                  when href like '/%' then 'https://m.example.net' || href when href like '#%' or href like '?%' then 'https://m.example.net' || href
                  else 'https://m.example.net/' || href end as url from hrefs)
       select connector, url from abs_ where regexp_matches(url, '/[a-z]+$')""",
    "site_roots",
    "sitemap_docs",
)
register(
    "EXT-3",
    lambda t: t("ad_pages")
    .where(html.in_departments(F.col("url"), ["63", "33"]))
    .select("page_id", html.department(F.col("url")).alias("department")),
    """select page_id, substr(d, 1, 2) as department from (
         select page_id, case when regexp_matches(url, '(^|[^0-9])(\\d{5})([^0-9]|$)') then regexp_extract(url, '(^|[^0-9])(\\d{5})([^0-9]|$)', 2) end as d from ad_pages) x
       where d is null or substr(d, 1, 2) in ('63', '33')""",
    "ad_pages",
)
register(
    "EXT-4",
    lambda t: t("ad_pages")
    .withColumn("text", html.strip_tags(F.col("html")))
    .select(
        "page_id",
        html.price_of(F.col("text")).alias("price"),
        html.surface_of(F.col("text")).alias("surface"),
        html.rooms_of(F.col("html")).alias("rooms"),
    ),
    f"""select page_id, {price_sql('text')} as price, {surface_sql('text')} as surface, {rooms_sql('html')} as rooms
        from (select page_id, html, {TEXT_SQL} as text from ad_pages) p""",
    "ad_pages",
)
register(
    "EXT-5",
    lambda t: t("ad_pages")
    .select("page_id", "html")
    .unionByName(t("pages").select((-F.col("page_id") - 1).alias("page_id"), "html"))
    .select(
        "page_id",
        html.title_tag(F.col("html")).alias("title"),
        html.meta(F.col("html"), "og:title").alias("og_title"),
        html.meta(F.col("html"), "product:price:amount").alias("amount"),
    ),
    f"""select page_id, {TITLE_SQL} as title, {meta_sql('og:title')} as og_title, {meta_sql('product:price:amount')} as amount
        from (select page_id, html from ad_pages union all select -page_id - 1, html from pages) p""",
    "ad_pages",
)


def _places(t):
    rows = t("ad_pages").withColumn("title", html.title_tag(F.col("html")))
    return rows.select(
        "page_id",
        html.place_from_url(F.col("url")).alias("u"),
        html.place_from_text(F.col("title")).alias("t"),
        html.split_location(F.col("title")).alias("l"),
        html.city_from_title(F.col("title")).alias("title_city"),
        html.city_from_sale_title(F.col("title")).alias("sale_city"),
    ).select(
        "page_id",
        F.col("u.city").alias("url_city"),
        F.col("u.postal_code").alias("url_code"),
        F.col("t.city").alias("text_city"),
        F.col("t.postal_code").alias("text_code"),
        F.col("l.city").alias("split_city"),
        F.col("l.postal_code").alias("split_code"),
        "title_city",
        "sale_city",
    )


register(
    "EXT-6",
    _places,
    f"""select page_id, {URL_CITY} as url_city, {URL_CODE} as url_code, {text_city_sql('title')} as text_city, {text_code_sql('title')} as text_code,
               nullif(trim(regexp_split_to_array(title, '{S}[-–]{S}')[1]), '') as split_city, {got('title', '(\\d{5})')} as split_code,
               trim({got('title', f'(?i)^à{S}+([^,]+),')}) as title_city, {SALE_CITY} as sale_city
        from (select page_id, url, {TITLE_SQL} as title from ad_pages) p""",
    "ad_pages",
)
register(
    "EXT-7",
    lambda t: t("pages").select("page_id", urls.last_segment(F.col("url")).alias("key")),
    f"select page_id, {KEY_SQL} as key from pages",
)
_SOLD_SQL = "(regexp_matches(text, '(?i)(^|[^A-Za-z0-9_])vendue?([^A-Za-z0-9_]|$)') and not regexp_matches(text, '(?i)en vente|disponible|sous (compromis|offre)'))"
_RENTAL_SQL = f"regexp_matches(text, '(?i)(^|[^A-Za-z0-9_])(loyer|mensuel)([^A-Za-z0-9_]|$)|\\d(\\d|{S})*€{S}*(cc|hc|charges comprises)?{S}*/{S}*mois')"
register(
    "EXT-8",
    lambda t: t("ad_pages")
    .withColumn("text", html.strip_tags(F.col("html")))
    .select(
        "page_id",
        html.is_sold(F.col("text")).alias("sold"),
        html.is_rental(F.col("text")).alias("rental"),
        html.is_for_sale(F.concat(F.lit("Etat "), html.title_tag(F.col("html")))).alias("for_sale"),
    ),
    f"""select page_id, {_SOLD_SQL} as sold, {_RENTAL_SQL} as rental,
               not contains(lower('Etat ' || title), 'vendu') and regexp_matches(lower('Etat ' || title), 'vendre|offre|compromis|disponible|vente') as for_sale
        from (select page_id, {TEXT_SQL} as text, {TITLE_SQL} as title from ad_pages) p""",
    "ad_pages",
)
_LAST = "coalesce(list_filter(string_split(regexp_replace(regexp_extract(url, '^[a-z]+://[^/?#]+([^?#]*)', 1), '(?i)\\.htm$', ''), '/'), lambda s: s <> '')[-1], '')"
_SLUG_STOP_SQL = html.SLUG_STOP
SLUG_SQL = f"""
    slugs as (select page_id, url, last_, list_filter(regexp_split_to_array(regexp_replace(last_, '(?i)[,_][a-z]{{1,3}}\\d{{3,}}$', ''), '[-_,]'), lambda w: w <> '') as words
              from (select page_id, url, {_LAST} as last_ from ad_pages) x),
    slug as (select page_id, url, words[1] as type,
             coalesce(try_cast(substr(list_filter(words, lambda w: regexp_matches(w, '(?i)^[tf]\\d+$'))[1], 2) as int),
               case when list_position(list_transform(words, lambda w: regexp_matches(w, '(?i)^pi[èe]ces?$')), true) > 1
                    and regexp_matches(words[list_position(list_transform(words, lambda w: regexp_matches(w, '(?i)^pi[èe]ces?$')), true) - 1], '^\\d+$')
                    then cast(words[list_position(list_transform(words, lambda w: regexp_matches(w, '(?i)^pi[èe]ces?$')), true) - 1] as int) end) as rooms,
             nullif(array_to_string(list_transform(list_filter(words[2:], lambda w: not regexp_matches(w, '{_SLUG_STOP_SQL}')), lambda w: {capital_sql('w')}), ' '), '') as city,
             list_filter(words, lambda w: regexp_matches(w, '^\\d{{5}}$'))[1] as postal_code,
             coalesce({got('last_', '(?i)[,_]([a-z]{1,3}\\d{3,})$')}, {got('last_', '(?i)(?:^|[^A-Za-z0-9_])([a-z]{1,3}\\d{3,})(?:[^A-Za-z0-9_]|$)')}) as ref from slugs)"""
register(
    "EXT-9",
    lambda t: t("ad_pages").select("page_id", html.slug_fields(F.col("url")).alias("s")).select("page_id", "s.*"),
    f"with {SLUG_SQL} select page_id, type, rooms, city, postal_code, ref from slug",
    "ad_pages",
)

# ---------------------------------------------------------------- JSON-LD
LD_SQL = """
    blocks as (select page_id, url, unnest(regexp_extract_all(html, '(?is)<script[^>]+type=["'']application/ld\\+json["''][^>]*>(.*?)</script>', 1)) as b,
                      generate_subscripts(regexp_extract_all(html, '(?is)<script[^>]+type=["'']application/ld\\+json["''][^>]*>(.*?)</script>', 1), 1) as n from ad_pages),
    parsed as (select page_id, url, n, cast(trim(b, chr(10) || ' ') as json) as j from blocks where json_valid(trim(b, chr(10) || ' '))),
    tops as (select page_id, url, n, case when json_type(j) = 'ARRAY' then from_json(j, '["JSON"]') when json_exists(j, '$."@graph"') then from_json(j -> '$."@graph"', '["JSON"]') else [j] end as js from parsed),
    objs as (select page_id, url, n, unnest(js) as o, generate_subscripts(js, 1) as m from tops),
    typed as (select page_id, url, o, n * 100 + m as ord, case when json_type(o -> '$."@type"') = 'ARRAY' then array_to_string(from_json(o -> '$."@type"', '["VARCHAR"]'), '|') else o ->> '$."@type"' end as kinds
              from objs where json_exists(o, '$."@type"'))"""
register(
    "EXT-10",
    lambda t: extraction.json_ld_objects(t("ad_pages")).select(
        "page_id",
        F.posexplode("objects").alias("pos", "o"),
    ).select("page_id", "pos", F.try_variant_get("o", "$.name", "string").alias("name")),
    "with " + LD_SQL + " select page_id, cast(row_number() over (partition by page_id order by ord) - 1 as int) as pos, o ->> '$.name' as name from typed",
    "ad_pages",
)


def _num(x: str) -> str:
    """Number of a JSON value, possibly wrapped one level."""
    inner = f"(case when json_type({x}) = 'OBJECT' then coalesce({x} -> '$.value', {x} -> '$.\"@value\"', {x} -> '$.minPrice', {x} -> '$.price') else {x} end)"
    text = f"({inner} ->> '$')"
    return f"(case when json_type({inner}) = 'VARCHAR' then {parse_number_sql(text)} when json_type({inner}) in ('UBIGINT', 'BIGINT', 'DOUBLE') then cast({text} as double) end)"


PAGE_LD_SQL = (
    LD_SQL
    + """, place as (select page_id, arg_min(o, ord) as p, arg_min(kinds, ord) as pk from typed where regexp_matches(kinds, '(?i)apartment|house|residence|villa|place|product|realestatelisting|accommodation|land|terrain') group by 1),
    offer as (select page_id, arg_min(o, ord) as f from typed where regexp_matches(kinds, '(?i)unitpricespecification|pricespecification|offer') group by 1),
    both_ as (select a.page_id, a.url as page_url, p, pk, f, p -> '$.price' as pp, f -> '$.price' as fp, p -> '$.numberOfRooms' as r, p -> '$.floorSize' as s,
                     p -> '$.geo.latitude' as la, p -> '$.geo.longitude' as lo, p ->> '$.address.addressLocality' as loc
              from ad_pages a left join place using (page_id) left join offer using (page_id))"""
)
_LD_COLUMNS = f"""coalesce(p ->> '$.url', f ->> '$.url', page_url) as url, p ->> '$.name' as title,
    case when p is null then null when regexp_matches(pk, '(?i)apartment|flat') then 'appartement' when regexp_matches(pk, '(?i)house|residence|villa') then 'maison'
         when regexp_matches(pk, '(?i)land|terrain') then 'terrain' else p ->> '$.name' end as type,
    {_num('r')} as rooms, {_num('s')} as surface, coalesce({_num('fp')}, {_num('pp')}) as price, coalesce(f ->> '$.priceCurrency', 'EUR') as currency,
    nullif(trim(regexp_replace(loc, '\\s*\\d{{5}}.*$', '')), '') as city, coalesce(p ->> '$.address.postalCode', {got('loc', '(\\d{5})')}) as "postalCode",
    {_num('la')} as lat, {_num('lo')} as lng"""
_LD_NAMES = ["page_id", "url", "title", "type", "rooms", "surface", "price", "currency", "city", "postalCode", "lat", "lng"]


def _ld(t):
    return extraction.extract_pages(t("ad_pages"), "jsonld_sitemap")


register(
    "EXT-11",
    lambda t: _ld(t).raws.select("page_id", "type", "rooms", "surface", "price", "city", "postalCode", "lat", "lng"),
    "with " + PAGE_LD_SQL + f""" select page_id, type, rooms, surface, price, city, "postalCode", lat, lng
        from (select page_id, {_LD_COLUMNS} from both_ where p is not null or f is not null) x""",
    "ad_pages",
)
register(
    "EXT-15",
    lambda t: _ld(t).raws.select(*_LD_NAMES),
    "with " + PAGE_LD_SQL + f" select page_id, {_LD_COLUMNS} from both_ where p is not null or f is not null",
    "ad_pages",
)
register(
    "EXT-15.warnings",
    lambda t: _ld(t).warnings,
    "with " + PAGE_LD_SQL + " select page_url as url, 'pas de JSON-LD exploitable : ' || page_url as message from both_ where p is null and f is null",
    "ad_pages",
)

# ---------------------------------------------------------------- strategies
_PAGE_SQL = f"""
    base as (select page_id, url, html, {TEXT_SQL} as text, {TITLE_SQL} as title, {meta_sql('og:title')} as og, {meta_sql('product:price:amount')} as amount from ad_pages)"""
register(
    "EXT-12",
    lambda t: extraction.extract_pages(t("ad_pages"), "sitemap_html", {"saleOnly": True}).raws.select(
        "page_id", "id", "title", "price", "surface", "rooms", "city", "postalCode"
    ),
    f"""with {_PAGE_SQL} select page_id, {KEY_SQL} as id, title,
          coalesce({price_sql("coalesce(title, '')")}, {price_sql('text')}) as price, coalesce({surface_sql("coalesce(title, '')")}, {surface_sql('text')}) as surface,
          coalesce({rooms_sql("coalesce(title, '')")}, {rooms_sql('html')}) as rooms, coalesce({SALE_CITY}, {text_city_sql('title')}, {URL_CITY}) as city,
          coalesce({text_code_sql('title')}, {URL_CODE}) as "postalCode"
        from base where not {_RENTAL_SQL}""",
    "ad_pages",
)
_OG_PRICE = f"""coalesce({price_sql("coalesce(og, '')")}, {price_sql("coalesce(amount, '')")}, {price_sql('text')})"""
_OG_SURFACE = f"""coalesce({surface_sql("coalesce(og, '')")}, {surface_sql('text')})"""
_OG_ROOMS = f"""coalesce({rooms_sql("coalesce(og, '')")}, {rooms_sql('html')})"""
_OG_SQL = f"""with {_PAGE_SQL}, og as (select page_id, url, {KEY_SQL} as id, og as title, {_OG_PRICE} as price, {_OG_SURFACE} as surface, {_OG_ROOMS} as rooms,
          coalesce({URL_CITY}, {text_city_sql('og')}) as city, coalesce({URL_CODE}, {text_code_sql('og')}) as "postalCode" from base)"""


def _og(t):
    return extraction.extract_pages(t("ad_pages"), "sitemap_network")


register(
    "EXT-13",
    lambda t: _og(t).raws.select("page_id", "id", "title", "price", "surface", "rooms", "city", "postalCode"),
    _OG_SQL
    + """ select page_id, id, title, price, surface, rooms, city, "postalCode" from og where price is not null or surface is not null or rooms is not null""",
    "ad_pages",
)
register(
    "EXT-13.warnings",
    lambda t: _og(t).warnings,
    _OG_SQL
    + """ select url, 'page sans données (rendu client ?) : ' || url as message from og where price is null and surface is null and rooms is null""",
    "ad_pages",
)
register(
    "EXT-14",
    lambda t: extraction.extract_pages(t("ad_pages"), "netty").raws.select(
        "page_id", "id", "title", "type", "rooms", "city", "postalCode", "price", "surface"
    ),
    f"""with {_PAGE_SQL}, {SLUG_SQL} select page_id, coalesce(ref, url) as id,
          nullif(concat_ws(' ', nullif({capital_sql('type')}, ''), case when rooms <> 0 then rooms || ' pièces' end, city), '') as title,
          type, cast(rooms as double) as rooms, city, postal_code as "postalCode", {price_sql('text')} as price, {surface_sql('text')} as surface
        from base join slug using (page_id, url) where not {_SOLD_SQL}""",
    "ad_pages",
)
TAXONOMIES = {"propertyType": "types", "location": "places", "rooms": "sizes", "status": "states"}


def _api(t):
    items = t("api_rows").withColumn("item", F.try_parse_json("item"))
    return extraction.api_items(items.select("connector", "pos", "item"), t("api_terms"), TAXONOMIES, t("ad_pages").select("url", "html"))


register(
    "EXT-16",
    lambda t: _api(t).select("connector", "pos", "id", "url", "type", "city", "postalCode", "rooms", "price", "surface"),
    f"""with ids as (select connector, pos, role, unnest(l) as term_id, generate_subscripts(l, 1) as n from (
             select connector, pos, unnest(['types', 'places', 'states', 'sizes']) as role, unnest([from_json(item::json -> '$.types', '["BIGINT"]'), from_json(item::json -> '$.places', '["BIGINT"]'),
               from_json(item::json -> '$.states', '["BIGINT"]'), from_json(item::json -> '$.sizes', '["BIGINT"]')]) as l from api_rows) x),
           named as (select i.connector, pos, role, arg_min(name, n) as name from ids i join api_terms t on t.connector = i.connector and t.taxonomy = role and t.term_id = i.term_id where name <> '' group by 1, 2, 3),
           wide as (select r.connector, r.pos, r.item::json as j, max(name) filter (role = 'types') as ty, max(name) filter (role = 'places') as pl, max(name) filter (role = 'states') as st, max(name) filter (role = 'sizes') as sz
                    from api_rows r left join named n on n.connector = r.connector and n.pos = r.pos group by 1, 2, 3)
        select connector, pos, j ->> '$.id' as id, j ->> '$.link' as url, coalesce(ty, j ->> '$.title.rendered') as type,
               coalesce(nullif(trim(split_part(pl, ' - ', 1)), ''), {got("(j ->> '$.title.rendered')", '(?i)^à\\s+([^,]+),')}) as city, {got('pl', '(\\d{5})')} as "postalCode",
               coalesce({parse_number_sql('sz')}, {parse_number_sql(got("(j ->> '$.title.rendered')", '(?i)(\\d+)\\s*pi[èe]ce'))}) as rooms, price, surface
        from wide left join (select url, {price_sql('text')} as price, {surface_sql('text')} as surface from (select url, {TEXT_SQL} as text from ad_pages) x) d on d.url = j ->> '$.link'
        where st is null or (not contains(lower(st), 'vendu') and regexp_matches(lower(st), 'vendre|offre|compromis|disponible|vente'))""",
    "api_rows",
    "api_terms",
    "ad_pages",
)


def _capped(t):
    found = t("ad_pages").select(
        urls.host(F.col("url")).alias("connector"), "url", F.struct(F.lit(0).alias("_parent"), F.col("page_id").cast("int").alias("_at")).alias("position")
    )
    return extraction.first_listings(found, limit=60)


register(
    "EXT-17",
    lambda t: _capped(t).select("connector", "url"),
    """select connector, url from (select regexp_extract(url, '^https?://([^/]+)', 1) as connector, url,
         row_number() over (partition by regexp_extract(url, '^https?://([^/]+)', 1) order by page_id, url) as rn from ad_pages) x where rn <= 60""",
    "ad_pages",
)
register(
    "EXT-18",
    lambda t: extraction.captured_pages(t("ad_pages").select("url", "html", "page_id")).withColumn("mediaUrls", F.array_join("mediaUrls", ",")),
    f"""select 'import_generique' as source, url, coalesce(nullif({meta_sql('og:title')}, ''), nullif(regexp_extract(html, '(?is)<title[^>]*>(.*?)</title>', 1), '')) as title,
          nullif({meta_sql('og:description')}, '') as description,
          coalesce(nullif({meta_sql('og:price:amount')}, ''), nullif({meta_sql('product:price:amount')}, ''), {got(TEXT_SQL, f'([0-9][0-9 .\\x{{00A0}}]{{3,}}){S}*€')}) as price,
          coalesce(nullif({meta_sql('og:image')}, ''), '') as "mediaUrls" from ad_pages""",
    "ad_pages",
)
register(
    "EXT-19",
    lambda t: extraction.geocoded(t("geo_responses"), "body"),
    """select doc_id, lat, lng, label, postcode, city, score from (
         select doc_id, case when json_type(f -> '$.geometry.coordinates[1]') in ('DOUBLE', 'UBIGINT') then cast(f ->> '$.geometry.coordinates[1]' as double) end as lat,
                case when json_type(f -> '$.geometry.coordinates[0]') in ('DOUBLE', 'UBIGINT') then cast(f ->> '$.geometry.coordinates[0]' as double) end as lng,
                coalesce(f ->> '$.properties.label', '') as label, f ->> '$.properties.postcode' as postcode, f ->> '$.properties.city' as city,
                coalesce(cast(f ->> '$.properties.score' as double), 0) as score
         from (select doc_id, json_extract(body, '$.features[0]') as f from geo_responses) g) x where lat is not null and lng is not null""",
    "geo_responses",
)
