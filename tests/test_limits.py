"""No silent limits: sitemaps, crawled pages, listings, queues and nesting of any size."""

import json
import subprocess
import sys

from pyspark.sql import functions as F

from hearthmark.operators import alerts
from hearthmark.plans import extraction


def loc(urls):
    return "".join(f"<loc>{u}</loc>" for u in urls)


def test_all_children_pages_and_listings(spark):
    children = [f"https://a.fr/map{i}.xml" for i in range(31)]
    docs = [("https://a.fr/index.xml", "<sitemapindex >" + loc(children))]
    docs += [(c, "<urlset>" + loc([f"https://a.fr/ad/{i}-{k}" for k in range(7)])) for i, c in enumerate(children)]
    pages = spark.createDataFrame(docs, "url string, body string")
    roots = spark.createDataFrame([("c", "https://a.fr/index.xml")], "connector string, sitemap_url string")
    found = extraction.sitemap_urls(pages, roots, "/ad/")
    assert found.count() == 31 * 7
    assert extraction.sitemap_urls(pages, roots, "/ad/", max_children=2).count() == 14
    assert extraction.first_listings(found).count() == 31 * 7
    assert extraction.first_listings(found, max_listings=201).count() == 201
    listing_pages = [f"https://a.fr/list/{i}" for i in range(21)]
    crawl = [("https://a.fr/index.xml", "<urlset>" + loc(listing_pages))] + [(u, f'<a href="../ad/{i}">') for i, u in enumerate(listing_pages)]
    links = extraction.harvest_links(spark.createDataFrame(crawl, "url string, body string"), roots, "/ad/", base="https://a.fr/list/")
    assert links.count() == 21


def test_whole_queue(spark):
    waiting = spark.range(250).select(F.col("id").alias("notification_id"), F.timestamp_seconds("id").alias("created_at"), F.lit(None).cast("timestamp").alias("dispatched_at"))
    assert alerts.dispatch_queue(waiting).count() == 250
    assert [r[0] for r in alerts.dispatch_queue(waiting, 2).collect()] == [0, 1]


def test_json_ld_of_any_depth(spark):
    deep = {"@type": "House", "name": "Deep", "floorSize": {"value": {"value": {"value": {"value": {"value": 80}}}}}}
    for k in range(7):
        deep = {"@graph": [deep]} if k % 2 else [deep]
    void = [{"@type": None, "name": "none"}, {"@type": "", "name": "blank"}, {"@type": []}]
    html = "".join(f'<script type="application/ld+json">{json.dumps(x)}</script>' for x in (deep, void))
    rows = spark.createDataFrame([("https://a.fr/1", html)], "url string, html string")
    objects = extraction.json_ld_objects(rows).select(F.transform("objects", lambda o: F.to_json(o)).alias("o")).first()["o"]
    assert [json.loads(o).get("name") for o in objects] == ["Deep", None]
    raw = extraction.json_ld_pages(rows, {}).raws.first()
    assert (raw["title"], raw["surface"]) == ("Deep", 80.0)


def test_executors_need_no_repository(tmp_path):
    """Python functions reach workers that start anywhere, through the shipped archive."""
    code = f"""
import sys
sys.path.insert(0, {str(extraction.__file__.rsplit('/', 3)[0])!r})
from hearthmark.session import local_session, ship_package
from hearthmark.functions.listing import fnv1a_hex
from pyspark.sql import functions as F
spark = local_session(1, "elsewhere")
ship_package(spark)
print("GOT", spark.range(1).select(fnv1a_hex(F.lit("abc"))).first()[0])
"""
    out = subprocess.run([sys.executable, "-c", code], cwd=tmp_path, capture_output=True, text=True, timeout=120, check=False)
    assert "GOT 1a47e90b" in out.stdout, out.stderr[-2000:]
