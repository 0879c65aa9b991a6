"""Listing-shaped views over the driver tables.

Each view is one SELECT that both Spark and DuckDB understand, so a query and
its oracle start from the same rows. Views read whole tables.
"""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession


TABLES = (
    "region nation customer supplier part orders lineitem events "
    "documents embeddings pages benchmark labels conversations"
).split()


VIEWS: dict[str, str] = {
    # 16 hex digits from the signs of the 64 embedding floats
    "phashes": {
        "spark": """
            select vec_id, lpad(lower(conv(array_join(
                     transform(embedding, x -> if(x > 0, '1', '0')), ''), 2, 16)), 16, '0') as phash
            from {embeddings}""",
        "duckdb": """
            select vec_id, array_to_string(list_transform(range(0, 16), lambda i: substr('0123456789abcdef',
                     1 + 8 * cast(embedding[4*i+1] > 0 as int) + 4 * cast(embedding[4*i+2] > 0 as int)
                       + 2 * cast(embedding[4*i+3] > 0 as int) + cast(embedding[4*i+4] > 0 as int), 1)), '') as phash
            from {embeddings}""",
    },
    "listings": """
        select d.doc_id as id,
               cast(substr(d.source, 4) as int) % 3 as user_id,
               cast(d.n_chars % 26 as int) as search_id,
               d.source as source_id,
               cast(d.doc_id as string) as external_id,
               concat('https://ads.example.com/', d.source, '/annonce-', d.doc_id) as url,
               split_part(d.text, chr(10), 1) as title,
               substr(d.text, length(split_part(d.text, chr(10), 1)) + 2) as description,
               cast(100 * d.n_chars as double) as price,
               20 + cast(d.n_chars as double) / 50 as surface_m2,
               cast(1 + least(floor(d.n_chars / 1000), 5) as int) as rooms,
               case d.n_chars % 5 when 0 then 'appartement' when 1 then 'maison' when 2 then 'terrain'
                    when 3 then 'local' else '' end as property_type,
               case when d.n_chars % 7 <> 0 then 45.5 + cast(d.n_chars % 101 as double) / 1000 end as lat,
               case when d.n_chars % 7 <> 0 then 4.8 + cast(d.n_chars % 53 as double) / 1000 end as lng,
               case when d.n_chars % 9 <> 0 then concat('Agence ', d.source) end as contact_name,
               case when d.n_chars % 11 = 0 then cast(75001 + d.n_chars % 20 as string)
                    when d.n_chars % 13 <> 0 then cast(63000 + d.n_chars % 40 as string) end as postal_code,
               case d.n_chars % 4 when 0 then 'Lyon' when 1 then 'Mâcon' when 2 then 'Clermont-Ferrand' end as city,
               h.phash as phash,
               timestamp '2024-01-01 00:00:00' + (d.n_chars % 2000) * interval '1' hour as last_changed_at
        from {documents} d left join {phashes} h on h.vec_id = d.doc_id""",
    # every listing plays a part: even ids are known already, odd ids are new,
    # and a fifth of the known ones come back with another price
    "existing": """
        select *, 'active' as source_status, id % 8 = 0 as disappeared
        from {listings} where id % 2 = 0""",
    "incoming": """
        select id, user_id, search_id, source_id, external_id, url, title, description,
               case when id % 10 = 0 then floor(price * 9 / 10) when id % 10 = 4 then floor(price * 21 / 20)
                    else price end as price,
               surface_m2, rooms, property_type, lat, lng, contact_name, postal_code, city, phash
        from {listings} where id % 2 = 1 or id % 10 in (0, 4)""",
    # neighbouring ids form the pairs of the similarity functions
    "pairs": """
        select a.id as a, b.id as b from {listings} a join {listings} b on b.id = a.id + 1""",
    "searches": """
        select n_nationkey as search_id,
               n_nationkey % 7 as user_id,
               concat('Recherche ', n_name) as name,
               cast(20000 + 8000 * n_nationkey as double) as price_min,
               case when n_nationkey % 8 <> 5 then cast(170000 + 8000 * n_nationkey as double) end as price_max,
               cast(20 + 2 * n_nationkey as double) as surface_min,
               cast(120 + 4 * n_nationkey as double) as surface_max,
               1 + n_nationkey % 3 as rooms_min,
               3 + n_nationkey % 3 as rooms_max,
               case n_nationkey % 5 when 0 then 'appartement, maison' when 1 then 'maison' when 2 then ''
                    when 3 then 'terrain,local' else 'immeuble, ,parking' end as property_types,
               case n_nationkey % 4 when 0 then 'the' when 1 then ' ,Dé la, que' when 2 then ''
                    else 'ouverture, and' end as keywords_required,
               case n_nationkey % 6 when 0 then 'zzz' when 1 then 'tionthe, ÉCHQUE' else '' end as keywords_excluded,
               45.5 + cast(n_nationkey as double) / 250 as center_lat,
               4.8 + cast(n_nationkey as double) / 500 as center_lng,
               case when n_nationkey % 9 <> 8 then cast(2 + n_nationkey % 4 as double) end as radius_km,
               n_nationkey % 2 = 1 as has_polygon,
               case n_nationkey % 3 when 0 then 'hourly' when 1 then 'daily' else 'manual' end as frequency,
               n_nationkey % 4 <> 3 as active,
               case when n_nationkey % 5 <> 0
                    then timestamp '2024-01-10 00:00:00' - n_nationkey * n_nationkey * interval '3' minute
               end as last_run_at,
               n_nationkey % 10 = 0 as is_public,
               case when n_nationkey % 3 = 0 then ''
                    else concat('src', n_nationkey % 20, ',src', (n_nationkey + 1) % 20) end as source_ids
        from {nation}""",
    # ring vertices of the searches that have a drawn zone
    "vertices": """
        select search_id, 1 as pos, center_lng - 0.02 as lng, center_lat - 0.03 as lat from {searches} where has_polygon
        union all select search_id, 2, center_lng + 0.03, center_lat - 0.02 from {searches} where has_polygon
        union all select search_id, 3, center_lng + 0.01, center_lat + 0.005 from {searches} where has_polygon
        union all select search_id, 4, center_lng + 0.02, center_lat + 0.04 from {searches} where has_polygon
        union all select search_id, 5, center_lng - 0.03, center_lat + 0.02 from {searches} where has_polygon""",
    "shares": """
        select c.c_custkey as share_id, s.search_id, s.user_id as owner_id, c.c_custkey as shared_with,
               case when c.c_custkey % 5 = 0 then 'editor' else 'viewer' end as role,
               timestamp '2024-01-01 00:00:00' + c.c_custkey * interval '1' minute as created_at
        from {customer} c join {searches} s on s.search_id = c.c_nationkey
        where c.c_custkey <> s.user_id""",
    "users": """
        select c_custkey as user_id, concat('  ', upper(c_mktsegment), '.', c_custkey, '@Example.com ') as email
        from {customer}""",
    "price_points": """
        select user_id as listing_id, ts as observed_at, value as price, event_id as tiebreak from {events}""",
    "versions": """
        select conv_id as listing_id,
               timestamp '2024-01-01 00:00:00' + turn * interval '1' hour as captured_at,
               turn as tiebreak,
               case when length(text) % 13 <> 0 then cast(100 * floor(length(text) / 40) as double) end as price,
               cast(20 + turn % 2 as double) as surface_m2,
               cast(1 + length(text) % 4 as int) as rooms,
               cast(case when turn % 4 <> 2 then turn % 2 end as int) as bedrooms,
               substr(text, 1, 12) as title,
               text as description,
               cast(turn % 3 as int) as media_count,
               role as source_status
        from {conversations}""",
    "transactions": """
        select s.s_nationkey as area, p.p_type as type_local, l.l_extendedprice as value, l.l_quantity as surface,
               2022 + cast(l.l_linenumber as int) % 3 as year
        from {lineitem} l join {supplier} s on s.s_suppkey = l.l_suppkey join {part} p on p.p_partkey = l.l_partkey""",
    "run_rows": """
        select o_orderkey as run_id, o_custkey % 25 as search_id, o_custkey % 11 as user_id,
               case when o_orderkey % 3 = 0 then 'manual' else 'cron' end as run_trigger,
               case o_orderstatus when 'F' then 'success' when 'P' then 'running' else 'error' end as status,
               o_orderdate as created_at,
               case when o_orderkey % 4 <> 0 then o_orderdate + interval '5' minute end as started_at,
               case when o_orderstatus <> 'P' and o_orderkey % 4 = 1 then o_orderdate + interval '9' minute end as finished_at,
               case when o_orderkey % 6 <> 0 then o_orderkey % 5 end as added,
               o_custkey % 7 as updated,
               case when o_orderstatus = 'P' then o_custkey % 3 end as warnings
        from {orders}""",
    "notifications": """
        select event_id as notification_id, user_id % 40 as user_id, event_type, ts as created_at,
               case when event_id % 3 = 0 then user_id end as listing_id,
               case when event_id % 4 = 0 then ts + interval '1' hour end as dispatched_at,
               case when event_id % 5 = 1 then ts + interval '2' hour end as read_at,
               concat('Alerte ', event_type) as title
        from {events}""",
    "preferences": """
        select user_id, user_id % 3 <> 0 as has_webhook, user_id % 4 <> 1 as webpush_enabled
        from (select distinct user_id % 40 as user_id from {events}) u where user_id % 10 <> 7""",
    "subscriptions": """
        select concat('sub-', user_id, '-', k) as subscription_id, user_id
        from (select distinct user_id % 40 as user_id, event_id % 3 as k from {events}) u where k < user_id % 4""",
    # one attempt per notification and channel target that the sender reported
    "attempts": """
        select n.notification_id, 'webhook' as channel, cast(null as string) as subscription_id,
               case when n.notification_id % 5 = 2 then 500 else 200 end as status_code
        from {notifications} n join {preferences} p on p.user_id = n.user_id where p.has_webhook
        union all
        select n.notification_id, 'push', s.subscription_id,
               case (n.notification_id + length(s.subscription_id) + ascii(substr(s.subscription_id, length(s.subscription_id), 1))) % 5
                    when 3 then 410 when 4 then 503 else 201 end
        from {notifications} n join {preferences} p on p.user_id = n.user_id
             join {subscriptions} s on s.user_id = n.user_id where p.webpush_enabled""",
    "qualification_log": """
        select event_id as seq, user_id as listing_id, ts as at,
               case event_type when 'click' then 'status' when 'purchase' then 'status' when 'view' then 'tag'
                    when 'signup' then 'verification' else 'note' end as action,
               case event_type when 'click' then 'a_visiter' when 'purchase' then 'contactee' end as status,
               case when event_type = 'view' then concat('tag', event_id % 4) end as tag,
               case when event_type = 'signup' then value > 20 end as verified,
               case when event_type = 'signup' then cast(event_id % 3 as int) end as anomaly_count
        from {events}""",
    "read_log": """
        select event_id as seq, event_id % 500 as notification_id, user_id % 10 as user_id, ts as at,
               case event_type when 'click' then 'read' when 'view' then 'read' when 'purchase' then 'unread'
                    when 'error' then 'noop' else case when event_id % 97 = 0 then 'read_all' else 'noop' end end as action
        from {events}""",
    "edges": """
        select user_id as a, (user_id * 7 + event_id) % 150 as b, cast(event_id % 101 as int) as score,
               case when event_id % 101 >= 92 then 'doublon_exact' when event_id % 101 >= 78 then 'probable_identique'
                    when event_id % 101 >= 55 then 'similaire' else 'different' end as bucket,
               event_id as seq
        from {events}""",
    "connectors": """
        select s_suppkey as connector_id, s_nationkey % 7 as user_id, concat('src', s_suppkey % 20) as source_id,
               s_name as label, s_suppkey % 5 <> 0 as enabled,
               case when s_suppkey % 3 = 0 then 'manual_import' else 'authorized_api' end as mode,
               case s_suppkey % 4 when 0 then null when 1 then concat('{{"kind":"sitemap_html","departments":["', s_nationkey, '","63"]}}')
                    when 2 then '{{"url":"https://api.example.com/v1"}}' else '{{"kind":"netty"}}' end as config
        from {supplier}""",
    "number_texts": """
        select o_orderkey as id,
               case o_orderkey % 8
                 when 0 then concat(cast(floor(o_totalprice / 1000) as bigint), ' ', lpad(cast(o_orderkey % 1000 as string), 3, '0'), ' €')
                 when 1 then concat(cast(floor(o_totalprice / 1000) as bigint), '.', lpad(cast(o_orderkey % 1000 as string), 3, '0'), ',50')
                 when 2 then concat(o_orderkey % 200, ',5 m²')
                 when 3 then concat('1,', lpad(cast(o_orderkey % 1000 as string), 3, '0'), ',000.25')
                 when 4 then concat(o_orderkey % 200, ' m2')
                 when 5 then concat('1.', lpad(cast(o_orderkey % 1000 as string), 3, '0'), '.000')
                 when 6 then concat('-', o_custkey, chr(160), '000')
                 else '—' end as text
        from {orders}""",
    "type_texts": """
        select p_partkey as id,
               case p_size % 16 when 0 then null when 1 then concat('Appartement T3 ', p_name)
                 when 2 then concat('Studio meublé ', p_name) when 3 then concat('Belle VILLA ', p_name)
                 when 4 then 'Terrains' when 5 then 'Box fermé' when 6 then 'Péniche' when 7 then 'Corps de ferme'
                 when 8 then 'Immeubles de rapport' when 9 then 'Local commercial' when 10 then ''
                 when 11 then concat('Maison avec garage ', p_brand) when 12 then 'Propriété' when 13 then 'F4'
                 when 14 then concat(p_type, ' entrepôt') else p_name end as text
        from {part}""",
    # one payload per document: a list of two items, a single item, null, nothing or broken JSON
    "feeds": """
        select item_id, source,
               case item_id % 6 when 0 then concat('{{"data":{{"pages":[{{"items":[', item, ',null,', item, ']}}]}}}}')
                    when 1 then concat('{{"data":{{"pages":[{{"items":', item, '}}]}}}}') when 2 then '{{"data":{{"pages":[{{"items":null}}]}}}}'
                    when 3 then concat('{{"data":', item, '}}') when 4 then concat('{{"data":{{"pages":[{{"items":[', item, ']}}', ',{{"items":[1]}}]}}}}')
                    else concat('{{"data":', item) end as payload
        from {raw_items}""",
    "raw_items": """
        select doc_id as item_id, source,
               concat('{{"ref":', case when doc_id % 6 <> 0 then concat('"', doc_id, '"') else 'null' end,
                      ',"head":{{"title":"', replace(replace(replace(replace(split_part(text, chr(10), 1), chr(34), ''), chr(92), ''), chr(9), ' '), chr(13), ' '),
                      '","tags":["', lang, '","', source, '"]}}',
                      ',"price":', case doc_id % 5 when 0 then concat('"', 100 * n_chars, ' €"') when 1 then cast(100 * n_chars as string)
                                     when 2 then 'null' when 3 then concat('"', n_chars, ',5"') else 'true' end,
                      ',"area":', case doc_id % 3 when 0 then concat('"', 20 + n_chars % 90, ' m²"') else cast(20 + n_chars % 90 as string) end,
                      ',"rooms":', case doc_id % 4 when 0 then '"2,5"' when 1 then '3.5' when 2 then '4' else 'null' end,
                      ',"kind":"', case n_chars % 4 when 0 then 'Appartement' when 1 then 'Maisons' when 2 then ' ' else 'Péniche' end, '"',
                      case when doc_id % 7 = 3 then ',"currency":12' when doc_id % 7 = 4 then ',"currency":"CHF"' else '' end,
                      ',"link":', case when doc_id % 4 = 1 then 'null' else concat('"https://www.', case n_chars % 4 when 0 then 'seloger.com' when 1 then 'pap.fr' when 2 then 'LeBonCoin.fr' else 'example.org' end, '/ad/', case when n_chars % 3 = 0 then cast(100000 + doc_id as string) else concat('x', doc_id) end, '/"') end,
                      '}}') as item
        from {documents}""",
    # listing pages: every document becomes one page in one of several site styles
    "ad_pages": """
        select doc_id as page_id,
               case doc_id % 5
                 when 0 then concat('https://agence-a.example.com/vente/appartement-t', 1 + doc_id % 6, '-', 1 + doc_id % 6, '-pieces-clermont-ferrand-', 63000 + doc_id % 40, ',VA', 1000 + doc_id)
                 when 1 then concat('https://agence-b.example.com/maison-', 2 + doc_id % 7, '-pieces-chamalieres-vente-fr_VM', 2000 + doc_id, '.htm')
                 when 2 then concat('https://agence-c.example.com/annonces/le-puy-en-velay-', 43000 + doc_id % 9, '/ref-', doc_id, '?x=1#top')
                 when 3 then concat('https://agence-d.example.com/vente/terrain-', lang, '-lezoux-', 63100 + doc_id % 50)
                 else concat('https://agence-e.example.com/biens/', doc_id) end as url,
               concat('<!DOCTYPE html><html><head>',
                 case doc_id % 6 when 0 then concat('<title>Vente maison Bertignat ', 1 + doc_id % 6, ' pièces ', 40 + doc_id % 150, 'm² ', 100000 + doc_id, '€ | Agence</title>')
                   when 1 then concat('<TITLE lang="fr">Maison à vendre / acheter saint-avensan ', 33400 + doc_id % 99, '</TITLE>')
                   when 2 then concat('<title>  À Coudes,', chr(10), ' Maison de   village | Site</title>')
                   when 3 then '<title></title>'
                   when 4 then concat('<title>', split_part(text, chr(10), 1), '</title>')
                   else concat('<title>Appartement T2 LYON de 69007 - ', 100 + doc_id % 300, chr(160), lpad(cast(doc_id % 1000 as string), 3, '0'), ' €</title>') end,
                 case doc_id % 4 when 0 then concat('<meta property="og:title" content="Vente de maison ', 1 + doc_id % 9, ' pièces à Margency ', 95500 + doc_id % 90, ' : ', 50 + doc_id % 200, 'm², prix ', 100 + doc_id % 700, ' 000 €. Réf. : ', doc_id, '">')
                   when 1 then concat('<meta content="Villa ', lang, '" data-x="1" name="og:title"><meta property="product:price:amount" content="', 200000 + doc_id, ' €">')
                   when 2 then '<meta property="og:title" content=""><meta property="og:image" content="https://img.example.com/a.jpg">' else '' end,
                 '<meta name="og:description" content="Ref ', doc_id, '">',
                 case doc_id % 7
                   when 0 then concat('<script type="application/ld+json">{{"@type":"Apartment","name":"T2 ', doc_id, '","numberOfRooms":{{"value":"', 1 + doc_id % 5, '"}},"floorSize":{{"@type":"QuantitativeValue","value":', 30 + doc_id % 90, '.5}},"address":{{"addressLocality":"Riom ', 63200 + doc_id % 9, '"}},"geo":{{"latitude":"45,', doc_id % 90, '","longitude":3.1}}}}</script><script type="application/ld+json">{{"@type":["Thing","Offer"],"price":"', 100 + doc_id % 300, ' 000","priceCurrency":"CHF"}}</script>')
                   when 1 then concat('<script id="x" type="application/ld+json">', chr(10), '{{"@context":"https://schema.org","@graph":[{{"@type":"WebSite","name":"site"}},{{"@type":"SingleFamilyResidence","name":"Maison ', doc_id, '","url":"https://ads.example.com/m/', doc_id, '","description":"d","address":{{"postalCode":"63', 100 + doc_id % 800, '","addressLocality":"Thiers"}},"price":', 90000 + doc_id, '}}]}}</script>')
                   when 2 then concat('<script type="application/ld+json">[{{"@type":"BreadcrumbList"}},{{"@type":"UnitPriceSpecification","price":{{"minPrice":', 70000 + doc_id, '}},"url":"https://ads.example.com/o/', doc_id, '"}},{{"@type":"Product","name":"Terrain plat"}}]</script>')
                   when 3 then '<script type="application/ld+json">{{"@type":"House", broken</script>'
                   when 4 then concat('<script type="application/ld+json">{{"@type":"AggregateOffer","price":null}}</script>')
                   when 5 then '<script type="application/ld+json">{{"@type":"WebPage","name":"rien"}}</script>' else '' end,
                 '</head><body><p>Taxe 1 347 € · ',
                 case doc_id % 5 when 0 then concat('Prix <b>', 100 + doc_id % 800, ' ', lpad(cast(doc_id % 1000 as string), 3, '0'), ' €</b>')
                   when 1 then concat(100000 + doc_id, '€ honoraires 9 ', lpad(cast(doc_id % 1000 as string), 3, '0'), ' €')
                   when 2 then concat('PRIX de vente : 7', lpad(cast(doc_id % 100 as string), 2, '0'), ' € puis 2 218000 €') else 'sur demande' end, '</p><div>',
                 case doc_id % 8 when 0 then concat('Surface habitable : 131,', 10 + doc_id % 80, ' m²') when 1 then concat('terrain 400m2x, ', 20 + doc_id % 99, 'm2.')
                   when 2 then 'loyer 650 €/mois' when 3 then 'bien VENDU' when 4 then 'Vendue, sous offre' when 5 then concat('charges 120 € CC / mois, ', 1 + doc_id % 4, ' PIÈCES') else '' end,
                 '</div><p>', text, '</p><a href="/vente/bien-', doc_id, '">x</a><a href=', chr(39), 'https://www.example.org/vente/bien-', doc_id % 50, chr(39), '>y</a><a HREF="page/', doc_id % 3, '">z</a></body></html>') as html
        from {documents}""",
    # sitemaps: one document per page, every fifth an index over the next four
    "sitemap_docs": """
        select concat('https://maps.example.com/sm-', page_id, '.xml') as url,
               case when page_id % 5 = 0 then concat('<?xml version="1.0"?><sitemapindex xmlns="x"><sitemap><loc> https://maps.example.com/sm-', page_id + 1, '.xml </loc></sitemap><sitemap><loc>https://maps.example.com/sm-', page_id + 2,
                        '.xml</loc></sitemap><sitemap><loc>https://maps.example.com/sm-', page_id + 3, '.xml</loc></sitemap><sitemap><loc>https://maps.example.com/missing.xml</loc></sitemap></sitemapindex>')
                    when page_id % 5 = 4 then concat('<urlset><url><LOC>', url, '</LOC></url><url><loc>https://maps.example.com/contact</loc></url></urlset>')
                    else concat('<urlset><url><loc>https://ads.example.com/vente/bien-63', 100 + page_id % 300, '/', page_id, '</loc></url><url><loc>https://ads.example.com/vente/bien-03', 100 + page_id % 300, '/', page_id % 7,
                        '</loc></url><url><loc>https://ads.example.com/contact</loc></url></urlset>') end as body
        from {pages}""",
    "site_docs": """
        select url, body from {sitemap_docs} union all select url, html as body from (select distinct url, html from {pages}) p""",
    "site_roots": """
        select page_id as connector, concat('https://maps.example.com/sm-', page_id, '.xml') as sitemap_url from {pages}""",
    "api_rows": """
        select cast(doc_id % 12 as int) as connector, cast(doc_id as int) as pos,
               concat('https://agence-e.example.com/biens/', doc_id) as link,
               concat('{{"id":', doc_id, case when doc_id % 9 <> 4 then concat(',"link":"https://agence-e.example.com/biens/', doc_id, '"') else '' end,
                      ',"title":{{"rendered":"', case doc_id % 3 when 0 then 'À Coudes, Maison 4 pièces' when 1 then 'Appartement 3 pieces Vic' else 'Terrain' end, '"}},"content":{{"rendered":"<p>', lang, '</p>"}},"types":[',
                      doc_id % 4, ',', doc_id % 3 + 1, '],"places":[', 10 + doc_id % 8, '],"states":[', 20 + doc_id % 5, '],"sizes":[', case when doc_id % 2 = 0 then cast(30 + doc_id % 4 as string) else '' end, ']}}') as item
        from {documents}""",
    "api_terms": """
        select c.c_custkey % 12 as connector, case n.n_nationkey % 4 when 0 then 'types' when 1 then 'places' when 2 then 'states' else 'sizes' end as taxonomy,
               cast(case n.n_nationkey % 4 when 0 then 1 + n.n_nationkey / 4 when 1 then 10 + (n.n_nationkey - 1) / 4 when 2 then 20 + (n.n_nationkey - 2) / 4 else 30 + (n.n_nationkey - 3) / 4 end as bigint) as term_id,
               case n.n_nationkey % 4 when 0 then case n.n_nationkey % 3 when 0 then 'Maisons' when 1 then '' else 'Terrains' end
                 when 1 then concat('Coudes - ', 63100 + n.n_nationkey) when 2 then case n.n_nationkey % 3 when 0 then 'Vendu' when 1 then 'A vendre' else 'Archive' end
                 else concat(n.n_nationkey, ' pièces et +') end as name
        from (select distinct c_custkey % 12 as c_custkey, c_nationkey from {customer}) c join {nation} n on n.n_nationkey = c.c_nationkey""",
    "geo_responses": """
        select doc_id, concat('{{"type":"FeatureCollection","features":[', case doc_id % 5 when 0 then '' when 1 then '{{"geometry":{{"coordinates":["4.8",45.7]}}}}'
               else concat('{{"geometry":{{"coordinates":[4.', 100 + doc_id % 900, ',45.', 100 + n_chars % 900, ']}},"properties":{{"label":"', doc_id, ' rue X","postcode":"69', 100 + doc_id % 800, '"',
                    case when doc_id % 3 = 0 then ',"city":"Lyon","score":0.5' else '' end, '}}}},{{"geometry":{{"coordinates":[1.5,2.5]}}}}') end, ']}}') as body
        from {documents}""",
    "communes": """
        select cast(63000 + c_custkey % 40 as string) as postal_code,
               concat('C', c_custkey) as code,
               case c_custkey % 9 when 0 then 'LYON' when 1 then 'macon' when 2 then 'Clermont-Ferrand'
                    else c_name end as name,
               cast(floor(c_acctbal) as bigint) as population
        from {customer}""",
}


def _sql(name: str, dialect: str) -> str:
    body = VIEWS[name]
    return body if isinstance(body, str) else body[dialect]


def _needs(name: str, dialect: str) -> list[str]:
    return list(dict.fromkeys(re.findall(r"(?<!\{)\{(\w+)\}", _sql(name, dialect))))


def load(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A driver table or a view over it as a DataFrame."""
    if name in TABLES:
        return spark.read.parquet(f"{sf_dir}/{name}.parquet")
    parts = {dep: load(spark, sf_dir, dep) for dep in _needs(name, "spark")}
    return spark.sql(_sql(name, "spark"), **parts)


def with_views(body: str, *names: str) -> str:
    """Prefix a DuckDB query with the views it uses, dependencies first."""
    ordered: list[str] = []

    def add(name: str) -> None:
        if name in TABLES or name in ordered:
            return
        for dep in _needs(name, "duckdb"):
            add(dep)
        ordered.append(name)

    for name in names:
        add(name)
    rendered = [
        f"{name} as ({_sql(name, 'duckdb').format(**{d: d for d in _needs(name, 'duckdb')})})" for name in ordered
    ]
    extra = body.strip()
    for opening in ("with recursive ", "with "):
        if extra.lower().startswith(opening):
            return opening + ", ".join([*rendered, extra[len(opening) :]])
    return ("with " + ", ".join(rendered) + " " if rendered else "") + extra
