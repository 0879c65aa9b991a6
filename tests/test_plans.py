"""Feeds, normalisation, extraction, ingestion plans and streams."""

from datetime import datetime

import pytest
from pyspark.sql import functions as F

from hearthmark.plans import extraction, ingest, normalise
from hearthmark.session import snapshot
from hearthmark.sources import feeds, transactions
from hearthmark.streaming import jobs


def now():
    return F.lit("2024-05-01 00:00:00").cast("timestamp")


def items(spark, *texts, path=None):
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "feed int, payload string")
    return feeds.explode_items(df, "payload", path)


def test_feed_shapes(spark):
    rows = items(spark, '{"a":{"b":[{"c":1},{"c":2}]}}', '{"a":{"b":{"c":3}}}', '{"a":{"b":null}}', '{"a":{}}', "broken", path="a.b")
    got = [(r["feed"], r["pos"], r["c"]) for r in rows.select("feed", "pos", F.try_variant_get("item", "$.c", "int").alias("c")).collect()]
    assert sorted(got) == [(0, 0, 1), (0, 1, 2), (1, 0, 3)]


def test_field_map_keeps_nulls_and_drops_missing(spark):
    rows = feeds.map_fields(items(spark, '{"a":{"b":[{"c":42}]},"n":null}'), "item", {"x": "a.b.0.c", "y": "n", "z": "nope"})
    row = rows.select(F.map_keys("fields").alias("k"), F.try_variant_get(F.col("fields")["x"], "$", "int").alias("x")).first()
    assert (sorted(row["k"]), row["x"]) == (["x", "y"], 42)


def test_normalise_accepts_aliases_and_reports_errors(spark):
    raw = items(
        spark,
        '[{"source":"leboncoin","id":123456,"title":" T3 ","price":"245 000 €","surface":"68 m²","rooms":"2,5","type":"Appartement"},'
        '{"price":true},{"url":"https://www.pap.fr/annonce/r99/"},{"title":"x","currency":null},7]',
    )
    good, errors = normalise.normalize_listings(feeds.map_fields(raw))
    rows = {r["pos"]: r for r in good.collect()}
    first = rows[0]
    assert (first["source_id"], first["external_id"], first["title"], first["price"], first["surface_m2"], first["rooms"], first["property_type"]) == (
        "leboncoin", "123456", "T3", 245000.0, 68.0, 3, "appartement",
    )
    assert rows[2]["external_id"] == "www.pap.fr/annonce/r99" and rows[2]["source_id"] == "import_generique"
    assert {r["pos"]: r["message"] for r in errors.collect()} == {1: "price: Invalid input", 3: "currency: Invalid input", 4: ": Invalid input"}


def test_csv_drops_rows_of_wrong_width(spark, tmp_path):
    (tmp_path / "sales.csv").write_text(
        "id_mutation,valeur_fonciere,code_commune,type_local,surface_reelle_bati\n"
        'a,200000,63113,"Maison, jumelée",100\nb,1,63113\nc,300000,63113,Maison,100,x\nd,,63113,Maison,100\n'
    )
    rows = transactions.read_transactions(spark, str(tmp_path)).collect()
    assert sorted((r["type_local"], r["value"]) for r in rows) == [("Maison", None), ("Maison, jumelée", 200000.0)]


def test_extraction_strategies(spark):
    url = "https://x.fr/vente/maison-5-pieces-chamalieres-63400,VM2325"
    html = (
        '<title>Vente maison Bertignat 4 pièces 140m² 140000€ | Site</title><meta property="og:title" content="Vente de maison 7 pièces à Margency 95580 : 193m², prix 750 000 €">'
        '<script type="application/ld+json">{"@graph":[{"@type":"House","name":"M","floorSize":{"value":"99,5"},"address":{"addressLocality":"Riom 63200"}},'
        '{"@type":"Offer","price":{"price":"180 000"}}]}</script><body>disponible</body>'
    )
    pages = spark.createDataFrame([(url, html), ("https://x.fr/b", "<p>bien vendu</p>")], "url string, html string")

    def raws(kind, **config):
        return {r["url"]: r for r in extraction.extract_pages(pages, kind, config).raws.collect()}

    dense = raws("sitemap_html")[url]
    assert (dense["price"], dense["surface"], dense["rooms"], dense["city"], dense["postalCode"]) == (140000.0, 140.0, 4.0, "Bertignat", None)
    og = raws("sitemap_network")
    assert list(og) == [url] and (og[url]["price"], og[url]["surface"], og[url]["rooms"], og[url]["postalCode"]) == (750000.0, 193.0, 7.0, "95580")
    slug = raws("netty")
    assert list(slug) == [url] and (slug[url]["id"], slug[url]["title"]) == ("VM2325", "Maison 5 pièces Chamalieres")
    ld = raws("jsonld_sitemap")
    assert list(ld) == [url] and (ld[url]["surface"], ld[url]["price"], ld[url]["city"], ld[url]["type"]) == (99.5, 180000.0, "Riom", "maison")
    assert extraction.extract_pages(pages, "jsonld_sitemap").warnings.count() == 1
    listings, errors = normalise.normalize_listings(extraction.as_fields(extraction.extract_pages(pages, "netty").raws))
    assert errors.count() == 0 and listings.first()["property_type"] == "maison"
    with pytest.raises(ValueError):
        extraction.extract_pages(pages, "unknown")


def test_long_titles_are_scanned_once(spark):
    """A title of 200,000 characters neither overflows the matcher nor takes quadratic time."""
    from hearthmark.functions import html

    long = spark.createDataFrame([("mot " * 50_000 + "Riom 63200",)], "t string")
    place = long.select(html.place_from_text(F.col("t")).alias("p"), html.city_from_sale_title(F.col("t")).alias("s")).first()
    assert place["p"]["postal_code"] == "63200" and place["s"] is None


def test_geocoder(spark):
    body = '{"features":[{"geometry":{"coordinates":[4.846,45.748]},"properties":{"label":"Lyon"}}]}'
    df = spark.createDataFrame([(1, body), (2, '{"features":[]}'), (3, "no")], "k int, body string")
    rows = extraction.geocoded(df, "body").collect()
    assert [(r["k"], r["lat"], r["lng"]) for r in rows] == [(1, 45.748, 4.846)]


LISTING = "id long, user_id int, search_id int, source_id string, external_id string, title string, description string, price double, surface_m2 double, rooms int, property_type string, lat double, lng double, contact_name string, phashes array<string>"


def rows_of(spark, *rows):
    base = dict(id=0, user_id=1, search_id=1, source_id="s", external_id="e", title="Appartement T3 lumineux", description="Bel appartement de 68 m2 avec balcon",
                price=250000.0, surface_m2=68.0, rooms=3, property_type="appartement", lat=45.748, lng=4.846, contact_name=None, phashes=None)
    return spark.createDataFrame([tuple({**base, **r}.values()) for r in rows], LISTING)


def stored(spark, *rows):
    return ingest.with_fingerprint(rows_of(spark, *rows)).withColumns({"source_status": F.lit("active"), "disappeared": F.col("id") == 2})


def test_plan_rules(spark):
    known = stored(spark, dict(id=1, external_id="A"), dict(id=2, external_id="B", title="Maison de village", description="jardin clos et cave", property_type="maison", lat=45.2, price=99000.0))
    batch = rows_of(
        spark,
        dict(id=11, external_id="A", price=235000.0),
        dict(id=12, external_id="N", title="Maison de village", description="jardin clos et cave", property_type="maison", lat=45.2, price=99000.0),
        dict(id=13, external_id="M", title="Terrain", description="constructible", property_type="terrain", lat=43.0, lng=1.0, price=10.0, surface_m2=900.0, rooms=None),
    )
    plan = ingest.plan_ingestion(batch, known)
    assert {r["id"]: (r["kind"], r["matched_id"]) for r in plan.upserts.collect()} == {11: ("update", 1), 12: ("insert", None), 13: ("insert", None)}
    assert {r["id"]: r["type"] for r in plan.notifications.collect()} == {11: "price_drop", 12: "recycled", 13: "new_listing"}
    assert [(r["id"], r["with_id"], r["bucket"]) for r in plan.similarities.collect()] == [(12, 2, "doublon_exact")]
    assert '"confidence":100' in plan.notifications.where("type = 'recycled'").first()["payload"]


def test_listings_do_not_move_to_meet_their_search(spark, monkeypatch):
    """The texts of a batch are dealt once, by their key, however large the searches look before they are made."""
    columns = "search_id int, price_min double, price_max double, surface_min double, surface_max double, rooms_min int, rooms_max int, property_types array<string>, keywords_required array<string>, keywords_excluded array<string>, center_lat double, center_lng double, radius_km double, polygon array<struct<lng:double,lat:double>>"
    one = spark.createDataFrame([(1, None, 300000.0, None, None, None, None, [], ["lumineux"], ["cave"], None, None, None, None)], columns)
    # one row, which the optimizer takes for a million
    searches = one.crossJoin(spark.range(1_000_000).where("id = 7").select())
    kept = []
    monkeypatch.setattr(ingest, "snapshot", lambda rows: kept.append(rows) or snapshot(rows))
    batch = ingest.last_per_key(
        rows_of(spark, dict(id=10, external_id="A", price=1.0), dict(id=11, external_id="A", price=235000.0), dict(id=12, external_id="N", search_id=None, description="cave")),
        ["user_id", "source_id", "external_id"],
        "id",
    )
    plan = ingest.plan_ingestion(batch, stored(spark, dict(id=1, external_id="A")), searches)
    got = sorted((r["id"], r["kind"], r["matched_id"], r["relevance"], r["excluded"]) for r in plan.upserts.collect())
    assert got == [(11, "update", 1, 100, False), (12, "insert", None, 100, False)]
    dealt = kept[-1]._jdf.queryExecution().executedPlan().toString()
    assert dealt.count("hashpartitioning(search_id") == 0 and dealt.count("hashpartitioning(user_id") == 2


def state_of(spark, known):
    listings = known.withColumns({"relevance_score": F.lit(0), "last_seen_at": now(), "last_changed_at": now(), "first_seen_at": now()})
    versions = listings.select(F.col("id").alias("listing_id"), F.col("last_seen_at").alias("captured_at"), "price")
    edges = spark.createDataFrame([], "a long, b long, score int, bucket string")
    alerts = spark.createDataFrame([], "listing_id long, type string")
    return ingest.State(listings, versions, edges, alerts)


def test_applying_the_same_batch_twice_changes_nothing_more(spark):
    known = stored(spark, dict(id=1, external_id="A"))
    batch = rows_of(spark, dict(id=11, external_id="A", price=235000.0), dict(id=13, external_id="M", title="Terrain nu", price=10.0, lat=43.0))
    later = F.lit("2024-06-01 00:00:00").cast("timestamp")
    once = ingest.apply_plan(state_of(spark, known), ingest.plan_ingestion(batch, known), later)
    twice = ingest.apply_plan(once, ingest.plan_ingestion(batch, once.listings), later)
    keep = ["id", "external_id", "price", "fingerprint", "last_changed_at"]
    assert sorted(map(tuple, once.listings.select(*keep).collect())) == sorted(map(tuple, twice.listings.select(*keep).collect()))
    assert {r["id"] for r in once.listings.collect()} == {1, 13}
    assert twice.versions.count() == once.versions.count() + 2


def write_parts(spark, folder, schema, *parts):
    for part in parts:
        spark.createDataFrame(part, schema).coalesce(1).write.mode("append").parquet(str(folder))
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(str(folder))


def test_price_stream(spark, tmp_path):
    def at(day):
        return datetime(2024, 1, day)

    schema = "listing_id string, captured_at timestamp, tiebreak long, price double"
    parts = [[("a", at(1), 1, 5.0), ("b", at(1), 2, 7.0)], [("a", at(2), 3, 5.0)], [("a", at(3), 4, 6.0), ("a", at(3), 5, None)], [("b", at(4), 6, 7.0), ("b", at(5), 7, 8.0)]]
    stream = write_parts(spark, tmp_path / "in", schema, *parts)
    query = jobs.price_change_stream(stream, str(tmp_path / "out"))
    query.awaitTermination()
    got = sorted((r["listing_id"], r["tiebreak"], r["price"]) for r in spark.read.parquet(str(tmp_path / "out" / "points")).collect())
    assert got == [("a", 1, 5.0), ("a", 4, 6.0), ("b", 2, 7.0), ("b", 7, 8.0)]


def test_dispatch_stream_never_repeats(spark, tmp_path):
    schema = "notification_id long, dispatched_at timestamp"
    stream = write_parts(spark, tmp_path / "in", schema, [(1, None), (2, None)], [(2, None), (3, datetime(2024, 1, 1))], [(1, None), (4, None)])
    jobs.dispatch_once_stream(stream, str(tmp_path / "out"), now).awaitTermination()
    got = sorted(r["notification_id"] for r in spark.read.parquet(str(tmp_path / "out" / "dispatched")).collect())
    assert got == [1, 2, 4]
