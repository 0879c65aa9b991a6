import math

import pytest
from pyspark.sql import functions as F

from hearthmark.functions import geo, html, images, listing, numbers, scoring, text, urls
from hearthmark.operators import matching



@pytest.mark.parametrize(
    "raw, number",
    [
        ("245 000 €", 245000.0),
        ("72,5 m²", 72.5),
        ("1.250.000,50", 1250000.5),
        ("1,250,000.50", 1250000.5),
        ("245.000", 245.0),
        ("1.250.000", None),
        ("68 m2", 682.0),
        ("—", None),
        ("", None),
    ],
)
def test_parse_number(one, raw, number):
    assert one(numbers.parse_number(F.col("v")), v=raw) == number


@pytest.mark.parametrize(
    "raw, kind",
    [
        ("Appartement T3", "appartement"),
        ("Studio meublé", "appartement"),
        ("Belle villa", "maison"),
        ("Box fermé", "parking"),
        ("Terrains", "terrain"),
        ("Péniche", "autre"),
        ("", None),
    ],
)
def test_property_type(one, raw, kind):
    assert one(listing.property_type(F.col("v")), v=raw) == kind


def test_fold_and_tokens(one):
    assert one(text.fold(F.col("v")), v="Élégant à Mâcon") == "elegant a macon"
    assert one(text.fold(F.col("v")), v="é œ ß") == "e œ ß"
    assert one(text.tokens(F.col("v")), v="Un bel appartement à Lyon") == ["bel", "appartement", "lyon"]
    assert one(text.trigram_set(F.col("v")), v="") == ["   "]
    assert one(text.squash(F.col("v")), v=" a  b \n c ") == "a b c"


def test_overlaps(one):
    left, right = F.array(F.lit("a"), F.lit("b")), F.array(F.lit("b"), F.lit("c"))
    empty = F.array().cast("array<string>")
    assert one(text.jaccard(left, right)) == pytest.approx(1 / 3)
    assert one(text.jaccard(empty, empty), text.jaccard(left, empty), text.dice(left, left)) == (1.0, 0.0, 1.0)


def test_keywords(one):
    assert one(text.contains_keyword(F.col("v"), F.lit(" MACON ")), v="Élégant à Mâcon") is True
    assert one(text.contains_keyword(F.col("v"), F.lit("  ")), v="abc") is False
    assert one(text.split_keywords(F.col("v")), v=" a, ,b ,") == ["a", "b"]


def test_fnv_matches_published_vectors(one):
    # published FNV-1a 32-bit test vectors
    assert one(listing.fnv1a_hex(F.col("v")), v="") == "811c9dc5"
    assert one(listing.fnv1a_hex(F.col("v")), v="a") == "e40c292c"
    assert one(listing.fnv1a_hex(F.col("v")), v="foobar") == "bf9cf968"


def test_fingerprint_ignores_case_and_spacing(one):
    def print_of(price, title):
        return listing.fingerprint(F.lit(price), F.lit(72.5), F.lit(3), F.lit(title), F.lit(None).cast("string"))

    a, b, c = one(print_of(200000.0, "Bel  Appart"), print_of(200000.0, "bel appart "), print_of(199000.0, "bel appart"))
    assert a == b != c


def test_surrogates_in_fingerprint(one):
    def python_fnv(value):
        state = 2166136261
        units = value.encode("utf-16-le")
        for i in range(0, len(units), 2):
            state = ((state ^ int.from_bytes(units[i : i + 2], "little")) * 16777619) & 0xFFFFFFFF
        return f"{state:08x}"

    assert one(listing.fnv1a_hex(F.col("v")), v="été 😀") == python_fnv("été 😀")


def test_number_text(one):
    values = [200000.0, 72.5, 12345678.25, 0.0001, 97.32, -3.0]
    assert [one(numbers.number_text(F.col("v")), v=v) for v in values] == ["200000", "72.5", "12345678.25", "0.0001", "97.32", "-3"]


def test_geo(one):
    paris, marseille = (48.8566, 2.3522), (43.2965, 5.3698)
    distance = one(geo.haversine_m(*[F.lit(x) for x in (*paris, *marseille)]))
    assert 650_000 < distance < 720_000
    assert one(geo.haversine_m(F.lit(1.0), F.lit(None).cast("double"), F.lit(1.0), F.lit(1.0))) is None
    square = F.array(*[F.struct(F.lit(x).alias("lng"), F.lit(y).alias("lat")) for x, y in ((0.0, 0.0), (10.0, 0.0), (10.0, 10.0), (0.0, 10.0))])
    inside = [one(geo.in_polygon(F.lit(x), F.lit(x), square)) for x in (5.0, 20.0)]
    assert inside == [True, False]
    assert one(geo.in_polygon(F.lit(5.0), F.lit(5.0), F.slice(square, 1, 2))) is False


def test_image_hashes(one):
    assert one(images.hamming(F.lit("00"), F.lit("ff"))) == 8
    assert one(images.hamming(F.lit("00"), F.lit("fff"))) is None
    assert one(images.hamming(F.lit("0" * 20), F.lit("f" + "0" * 19))) == 4

    def codes(*hashes):
        return images.hash_codes(F.array(*[F.lit(h) for h in hashes]).cast("array<string>"))

    assert one(images.image_similarity(codes("ffffffffffffffff", "0000000000000001"), codes("0000000000000000"))) > 0.95
    assert one(images.image_similarity(codes(), codes("00"))) is None
    assert one(images.dhash(F.expr("transform(sequence(0, 71), i -> 72 - i)"))) == "0" * 16
    assert one(images.dhash(F.expr("transform(sequence(0, 71), i -> i)"))) == "f" * 16


def test_price_and_change_rules(one):
    def drop(a, b):
        return one(scoring.price_drop(F.lit(a).cast("double"), F.lit(b).cast("double")))

    assert drop(250000.0, 235000.0)["dropped"] is True
    assert drop(250000.0, 249000.0)["dropped"] is False
    assert drop(None, 1.0)["delta_abs"] == 0

    def kind(before, after):
        def side(values):
            types = {"price": "double", "fingerprint": "string", "media_count": "int", "status": "string"}
            return {k: F.lit(values.get(k)).cast(t) for k, t in types.items()}

        return one(scoring.change_kind(side(before), side(after)))

    assert kind({"status": "active", "price": 1.0}, {"status": "sold", "price": 1.0}) == "status_change"
    assert kind({"price": 250000.0}, {"price": 235000.0}) == "price_drop"
    assert kind({"price": 100.0}, {"price": 101.0}) == "price_rise"
    assert kind({"media_count": 1}, {"media_count": 2}) == "media_change"
    assert kind({"fingerprint": "a"}, {"fingerprint": "b"}) == "text_change"
    assert kind({"price": 100.0}, {"price": 100.0}) == "none"


def test_scores(one):
    now = F.lit("2024-01-04 00:00:00").cast("timestamp")
    fresh, old = one(scoring.freshness(now, now), scoring.freshness(F.lit("2024-01-01 00:00:00").cast("timestamp"), now))
    assert (fresh, old) == (100, math.floor(100 * math.exp(-1) + 0.5))
    again = one(scoring.republication(F.lit(True), F.lit(True), F.lit(85)))
    assert (again["recycled"], again["confidence"]) == (True, 95)
    assert one(scoring.republication(F.lit(True), F.lit(False), F.lit(85)))["recycled"] is False
    gap = one(scoring.market_delta(F.lit(11000.0), F.lit(10000.0)))
    assert (gap["pct"], gap["over"]) == (10, True)
    assert one(scoring.market_delta(F.lit(0.0), F.lit(10000.0))) is None
    assert one(numbers.half_up(F.lit(-2.5))) == -2


@pytest.mark.parametrize(
    "body, price",
    [
        ("Taxe 1 347 € · Prix 219 400 €", 219400.0),
        ("191400€ charges 2 218000 €", 191400.0),
        ("<b>Prix</b> : 245.000,00 €", None),
        ("loyer 650 €", None),
    ],
)
def test_page_price(one, body, price):
    assert one(html.price_of(html.strip_tags(F.col("v"))), v=body) == price


def test_page_fields(one):
    assert one(html.surface_of(F.col("v")), v="Surface habitable : 131,80 m²") == 131.8
    assert one(html.rooms_of(F.col("v")), v="maison 4 Pièces") == 4.0
    assert one(html.title_tag(F.col("v")), v="<title> A  b | Site</title>") == "A b"
    assert one(html.meta(F.col("v"), "og:title"), v='<meta content="x" property="og:title">') == "x"
    assert one(html.meta(F.col("v"), "og:title"), v='<meta content="x" property="og:type">') is None
    assert tuple(one(html.place_from_text(F.col("v")), v="à vendre / acheter avensan 33480")) == ("Avensan", "33480")
    assert tuple(one(html.place_from_text(F.col("v")), v="Maison 0m² 23000 €")) == (None, None)
    assert tuple(one(html.split_location(F.col("v")), v="Coudes - 63114")) == ("Coudes", "63114")
    assert one(html.city_from_title(F.col("v")), v="À Coudes, Maison") == "Coudes"
    assert one(html.city_from_sale_title(F.col("v")), v="Vente maison Bertignat 4 pièces") == "Bertignat"
    assert [one(html.is_for_sale(F.col("v")), v=s) for s in ("A vendre", "Vendu", "Archive")] == [True, False, False]
    assert [one(html.department(F.col("v")), v=s) for s in ("63000", "/168309", "x")] == ["63", None, None]
    assert one(html.in_departments(F.col("v"), ["63"]), v="/168309") is True


def test_slug(one):
    slug = one(html.slug_fields(F.col("v")), v="https://x.fr/v/appartement-t2-2-pieces-clermont-ferrand-63000,VA1904")
    assert tuple(slug) == ("appartement", 2, "Clermont Ferrand", "63000", "VA1904")
    slug = one(html.slug_fields(F.col("v")), v="https://x.fr/maison-5-pieces-chamalieres-vente-fr_VM2325.htm")
    assert tuple(slug) == ("maison", 5, "Chamalieres", None, "VM2325")


def test_urls(one):
    assert one(urls.external_id(F.col("v")), v="https://x.fr/a/1234567/b") == "1234567"
    assert one(urls.external_id(F.col("v")), v="https://www.X.fr/a/b/") == "www.x.fr/a/b"
    assert one(urls.external_id(F.col("v")), v="not a url") is None
    base = F.lit("https://x.fr/a/b.html?q=1")
    resolved = [one(urls.resolve(F.col("v"), base), v=h) for h in ("/c", "c", "//y.fr/d", "https://z.fr/", "mailto:x", "?p=2", "#t")]
    assert resolved == [
        "https://x.fr/c",
        "https://x.fr/a/c",
        "https://y.fr/d",
        "https://z.fr/",
        "mailto:x",
        "https://x.fr/a/b.html?p=2",
        "https://x.fr/a/b.html?q=1#t",
    ]


def test_links_with_dots(one):
    from hearthmark.functions import urls

    base = F.lit("https://a.fr/x/y/page.html?q=1")
    links = ["../z", "./z", "../../../z?a=../b", "/k/./l/../m", "z/..", "plain", "//b.fr/c/../d", "#top"]
    assert one(*[urls.resolve(F.lit(h), base) for h in links]) == (
        "https://a.fr/x/z",
        "https://a.fr/x/y/z",
        "https://a.fr/z?a=../b",
        "https://a.fr/k/m",
        "https://a.fr/x/y/",
        "https://a.fr/x/y/plain",
        "https://b.fr/d",
        "https://a.fr/x/y/page.html?q=1#top",
    )


def test_fingerprints_in_pieces(monkeypatch):
    import pandas as pd

    from hearthmark.functions import listing

    texts = pd.Series(["abc", None, "", "x" * 50, "é😀", "abc"] * 4)
    whole = listing._fnv1a(texts).tolist()
    monkeypatch.setattr(listing, "FNV_UNITS", 7)
    assert listing._fnv1a(texts).tolist() == whole
    assert whole[0] == "1a47e90b" and whole[1] is None


def test_gram_codes_are_those_of_the_trigram_set(spark):
    """The codes come from one batch step, as a plan without any string per trigram shows."""
    texts = ["", " ", "a", "ab", "Été à  la MER", "aaaaaa", "x\U0001F600y", "\U0001F600\U0001F601", "\U0001F600", "é\u0301\U00010400\U00010400z ", "a \t b\n\nc\td \r", "\xa0x \u2003y\x85", None]
    rows = spark.createDataFrame([(t,) for t in texts], "v string")
    both = rows.select(F.array_sort(text.packed(text.trigram_set(F.col("v")))).alias("plain"), text.gram_codes(text.fold(F.coalesce("v", F.lit("")))).alias("batch")).collect()
    assert all(r.plain == r.batch for r in both), both
    joined = F.concat(F.coalesce("v", F.lit("")), F.lit(" "), F.coalesce("v", F.lit("")))
    ends = rows.select(text.trim_blank(joined).alias("plain"), text.listing_text(F.col("v"), F.col("v")).alias("quick")).collect()
    assert all(r.plain == r.quick for r in ends), ends
    listing = "title string, description string, contact_name string, property_type string, phashes array<string>"
    done = matching.comparable(spark.createDataFrame([("Été", "à la mer", None, "", None)], listing))
    plan = done._jdf.queryExecution().optimizedPlan().toString()
    assert "_gram_codes" in plan and "(?=(.{3}))" not in plan


def test_fingerprint_squashes_texts_outside_of_spark(spark):
    """The same line as the column expressions make, without a pattern that steps through the text."""
    texts = ["", None, "   ", " ́abc é", "a  b  c\td", "İstanbul ÀÉÎ", "|", "\x1c a\x85b\x0b\x0c", "\r\n a \r\n", "﻿abc　", "😀 b"]
    rows = spark.createDataFrame([(t, d) for t in texts for d in texts], "title string, description string")
    line = F.concat_ws("|", F.lit("5"), F.lit(""), F.lit("2"), *[text.squash(text.fold(F.coalesce(c, F.lit("")))) for c in ("title", "description")])
    made = listing.fingerprint(F.lit(5.0), F.lit(None).cast("double"), F.lit(2), F.col("title"), F.col("description"))
    assert rows.where(~made.eqNullSafe(listing.fnv1a_hex(line))).count() == 0
    plan = rows.select(made)._jdf.queryExecution().optimizedPlan().toString()
    assert "{FEFF}]+," not in plan
