"""Collection runs: every kind of connector, each with its own options."""

import json

from pyspark.sql import functions as F

from hearthmark.operators.relevance import CRITERIA
from hearthmark.plans import collect

TITLE = "<html><head><title>Vente maison {city} {n} pièces 90m² {price}€ | Agence</title></head><body>{price} €</body></html>"


def test_all_kinds_by_their_own_options(spark):
    configs = {
        1: {"kind": "sitemap_html", "departments": ["63"], "maxListings": 1},
        2: {"listPath": "data.rows", "map": {"id": "ref", "title": "head.0.t", "price": "cost"}},
        3: {"kind": "mystery"},
        4: {"kind": "wordpress_rest", "taxonomies": {"propertyType": "kind_of", "location": "where"}, "maxListings": 2},
        5: {"kind": "sitemap_html", "saleOnly": True},
        6: {"url": "https://api.example.com/items"},
        7: {"kind": "netty"},
    }
    connectors = spark.createDataFrame(
        [(i, 9, f"s{i}", True, "authorized_api", json.dumps(c)) for i, c in configs.items()] + [(8, 9, "s8", False, "authorized_api", "{}")],
        "connector_id int, user_id int, source_id string, enabled boolean, mode string, config string",
    )
    searches = spark.createDataFrame([(100, 9, []), (101, 9, ["s1", "s3"]), (102, 4, [])], "search_id int, user_id int, source_ids array<string>")
    pages = spark.createDataFrame(
        [
            (1, "https://a.fr/vente/x-63000/11111", TITLE.format(city="Thiers 63300", n=3, price=120000)),
            (1, "https://a.fr/vente/y-63000/22222", TITLE.format(city="Thiers 63300", n=3, price=130000)),
            (1, "https://a.fr/vente/a-75000/33333", TITLE.format(city="Paris 75001", n=3, price=140000)),
            (3, "https://c.fr/1", "x"),
            (5, "https://e.fr/vente/44444", TITLE.format(city="Lyon 69001", n=2, price=150000)),
            (5, "https://e.fr/louer/55555", "<title>Location appartement</title> 700 € par mois loyer"),
        ],
        "connector_id int, url string, html string",
    )
    posts = [{"id": k, "link": f"https://d.fr/{k}", "title": {"rendered": f"Bien {k}"}, "kind_of": [7], "where": [8]} for k in range(3)]
    payloads = spark.createDataFrame(
        [
            (2, json.dumps({"data": {"rows": [{"ref": "r1", "head": [{"t": "Un"}], "cost": "100 000 €"}, {"ref": "r2", "cost": True}]}})),
            (4, json.dumps(posts)),
            (6, json.dumps([{"id": "own", "title": "Sans plan", "price": 5}])),
        ],
        "connector_id int, payload string",
    )
    terms = spark.createDataFrame([(4, "kind_of", 7, "Villa"), (4, "where", 8, "Thiers 63300")], "connector int, taxonomy string, term_id long, name string")
    got = collect.collect_pages(searches, connectors, pages, payloads, terms)
    rows = {(r["search_id"], r["connector_id"], r["external_id"]): r for r in got.listings.collect()}
    mine = {k[1:] for k in rows if k[0] == 100}
    assert mine == {(1, "11111"), (2, "r1"), (4, "0"), (4, "1"), (5, "44444"), (6, "own")}
    assert {k[1:] for k in rows if k[0] == 101} == {(1, "11111")}
    assert rows[100, 2, "r1"]["title"] == "Un" and rows[100, 2, "r1"]["price"] == 100000.0
    assert rows[100, 4, "0"]["property_type"] == "maison" and rows[100, 4, "0"]["source_id"] == "s4"
    warned = sorted((r["search_id"], r["connector_id"], r["message"]) for r in got.warnings.collect())
    assert warned == [
        (100, 2, "price: Invalid input"),
        (100, 3, "Type de connecteur de site inconnu : « mystery »."),
        (101, 3, "Type de connecteur de site inconnu : « mystery »."),
    ]
    events = {(r["search_id"], r["level"], r["message"]) for r in got.events.collect()}
    assert (102, "info", collect.NO_CONNECTOR) in events
    assert (100, "info", "Connecteur s4 : 2 annonce(s) récupérée(s).") in events
    assert (100, "info", "Connecteur s7 : 0 annonce(s) récupérée(s).") in events
    assert (100, "warn", "price: Invalid input") in events and len(events) == 7 + 2 + 1 + 3
    after = collect.mark_run(searches, F.lit("2024-01-01").cast("timestamp"))
    assert after.where("last_run_at is null").isEmpty()


CONNECTOR = "connector_id int, user_id int, source_id string, enabled boolean, mode string, config string"
LISTING = "id long, user_id int, source_id string, external_id string, search_id int, title string, description string, price double, surface_m2 double, rooms int, property_type string, lat double, lng double, contact_name string, phashes array<string>, fingerprint string, source_status string, disappeared boolean"


def locs(*urls):
    return "<urlset>" + "".join(f"<loc>{u}</loc>" for u in urls) + "</urlset>"


def test_discovery_inside_a_run(spark):
    site = {"kind": "sitemap_html", "detailUrlPattern": "/vente/"}
    configs = {
        1: site | {"sitemapUrl": "https://a.fr/map.xml", "departments": ["63"], "maxListings": 2},
        2: site | {"sitemapUrl": "https://b.fr/map.xml", "crawlSeedPattern": "/liste", "baseUrl": "https://b.fr/x/"},
        3: site | {"sitemapUrl": "https://a.fr/map.xml", "detailUrlPattern": "/vente/("},
        4: site | {"sitemapUrl": "https://gone.fr/map.xml"},
        5: {"kind": "netty", "sitemapUrl": "https://b.fr/map.xml", "detailUrlPattern": "/vente/"},
        6: {"departments": ["63"]},
        7: site | {"sitemapUrl": "https://a.fr/map.xml"},
        8: {"kind": "wordpress_rest", "taxonomies": {"location": "where"}},
    }
    connectors = spark.createDataFrame([(i, 9, f"s{i}", True, "authorized_api", json.dumps(c)) for i, c in configs.items()], CONNECTOR)
    searches = spark.createDataFrame([(100, 9, []), (101, 9, ["s1", "s6"])], "search_id int, user_id int, source_ids array<string>")
    for name in CRITERIA:
        kind = "array<string>" if name in ("property_types", "keywords_required", "keywords_excluded") else "array<struct<lng:double,lat:double>>" if name == "polygon" else "double"
        searches = searches.withColumn(name, F.lit(None).cast(kind))
    title = TITLE.format(city="Thiers 63300", n=3, price=120000)
    details = {f"https://a.fr/vente/x-{code}/{key}": title for code, key in ((63000, "11111"), (75000, "22222"), (63100, "33333"), (63200, "44444"))}
    docs = {
        "https://a.fr/map.xml": "<sitemapindex >" + locs("https://a.fr/one.xml", "https://a.fr/two.xml"),
        "https://a.fr/one.xml": locs(*list(details)[:2]),
        "https://a.fr/two.xml": locs(*list(details)[2:], "https://a.fr/about"),
        "https://b.fr/map.xml": locs("https://b.fr/liste", "https://b.fr/other"),
        "https://b.fr/liste": '<a href="vente/55555">x</a>',
        "https://b.fr/other": '<a href="/vente/66666">x</a>',
        "https://b.fr/x/vente/55555": title,
        "https://b.fr/vente/55555": title,
        "https://b.fr/vente/66666": title,
        **details,
    }
    docs = spark.createDataFrame(list(docs.items()), "url string, body string")
    pages = spark.createDataFrame([(8, "https://w.fr/1", "Prix : 99 000 € pour 45 m²")], "connector_id int, url string, html string")
    items = [{"id": "p", "postalCode": "75001", "price": 7}, {"id": "q", "postalCode": "63000", "price": 8}]
    post = [{"id": 1, "link": "https://w.fr/1", "title": {"rendered": "Bien"}}]
    payloads = spark.createDataFrame([(6, json.dumps(items)), (8, json.dumps(post))], "connector_id int, payload string")
    terms = spark.createDataFrame([(8, "where", 8, "Thiers 63300")], "connector int, taxonomy string, term_id long, name string")
    failures = spark.createDataFrame([(7, "HTTP 500")], "connector_id int, message string")
    existing = spark.createDataFrame([], LISTING)
    done = collect.run_searches(searches, connectors, pages, existing, F.lit("2024-01-01").cast("timestamp"), payloads, terms, docs=docs, failures=failures)
    got = {(r["search_id"], r["connector_id"], r["external_id"]) for r in done.collected.listings.collect()}
    # departments before the maximum, the first sitemap before the second; items of a feed are not restricted
    assert {g[1:] for g in got if g[0] == 101} == {(1, "11111"), (1, "33333"), (6, "p"), (6, "q")}
    assert {g[1:] for g in got if g[0] == 100} == {(1, "11111"), (1, "33333"), (6, "p"), (6, "q"), (2, "55555"), (8, "1")}
    post = done.collected.listings.where("connector_id = 8").first()
    assert (post["price"], post["surface_m2"]) == (99000.0, 45.0)
    warned = {(r["connector_id"], r["message"].split(" : ")[0]) for r in done.collected.warnings.where("search_id = 100").collect()}
    assert warned == {(3, "detailUrlPattern invalide"), (4, "sitemap https://gone.fr/map.xml"), (7, "Connecteur s7 ignoré")}
    steps = {(r["step"], r["message"]) for r in done.events.where("level = 'warn'").collect()}
    assert ("collect", "Connecteur s7 ignoré : HTTP 500") in steps
    assert not any("Connecteur s7 :" in r["message"] for r in done.events.collect())
    runs = {r["search_id"]: r for r in done.runs.collect()}
    # the second search meets what the first one has just brought in
    assert (runs[100]["fetched"], runs[100]["added"], runs[100]["updated"], runs[100]["warnings"]) == (6, 6, 0, 3)
    assert (runs[101]["fetched"], runs[101]["added"], runs[101]["updated"], runs[101]["warnings"]) == (4, 0, 4, 0)
    assert runs[100]["status"] == "partial" and runs[101]["status"] == "success"


def test_bodies_stay_where_they_are(spark):
    """Joins of the link graph see addresses only."""
    from hearthmark.plans import extraction

    docs = spark.createDataFrame([("https://a.fr/m.xml", locs("https://a.fr/ad/1") + "x" * 1000)], "url string, body string")
    roots = spark.createDataFrame([("c", "https://a.fr/m.xml")], "connector string, sitemap_url string")
    found = extraction.discover(docs, roots, "/ad/")
    plan = found._jdf.queryExecution().optimizedPlan().toString()
    joins = [line for line in plan.splitlines() if "Join" in line]
    assert joins and found.count() == 1
    below = found._jdf.queryExecution().executedPlan().toString()
    exchanged = [line for line in below.splitlines() if "Exchange" in line and "hashpartitioning" in line]
    assert not any("body" in line for line in exchanged)
