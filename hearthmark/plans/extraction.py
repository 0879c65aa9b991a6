"""Page tables, sitemaps and API items to raw listings."""

from __future__ import annotations

from collections.abc import Callable, Mapping
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from hearthmark.functions import html as page
from hearthmark.functions import urls
from hearthmark.functions.listing import source_of_host
from hearthmark.functions.numbers import parse_number
from hearthmark.functions.text import blank_to_null, capitalise, trim_blank
from hearthmark.operators.once import with_once

RAW_FIELDS = "id url title description type rooms city postalCode price surface currency lat lng".split()


# ---------------------------------------------------------------- discovery


def _matches(text: Column, pattern: str | Column) -> Column:
    return text.rlike(pattern) if isinstance(pattern, str) else F.rlike(text, pattern)


def _addresses(docs: DataFrame) -> DataFrame:
    """What joins need of fetched documents: addresses and the ones they name, not the bodies."""
    return docs.select(
        "url",
        F.col("body").rlike(page.SITEMAP_INDEX).alias("_index"),
        F.regexp_extract_all("body", F.lit(page.LOC), F.lit(1)).alias("_locs"),
        F.regexp_extract_all("body", F.lit(page.HREF), F.lit(1)).alias("_hrefs"),
    )


def _own(roots: DataFrame) -> list[str]:
    """Columns of the roots that patterns may refer to."""
    return [c for c in roots.columns if c not in ("connector", "sitemap_url")]


def _first_places(found: DataFrame) -> DataFrame:
    """Every URL of a connector with its first place; ``_nth`` orders several sitemaps of one connector."""
    nth = ["_nth"] if "_nth" in found.columns else []
    return found.groupBy("connector", "url").agg(F.min(F.struct(*nth, "_parent", "_at")).alias("position"))


def sitemap_urls(docs: DataFrame, roots: DataFrame, detail: str | Column, max_children: int | None = None) -> DataFrame:
    """Detail URLs of each connector's sitemap, an index being followed one level.

    ``docs(url, body)`` are fetched documents, ``roots(connector, sitemap_url)``
    the entry points; a pattern may be a column of the roots. The result keeps
    the first position of every URL. All children of an index are followed
    unless ``max_children`` is given. Only addresses are joined.
    """
    named, own = _addresses(docs), _own(roots)
    located = roots.join(named.select(F.col("url").alias("sitemap_url"), "_index", "_locs"), "sitemap_url").select(
        "connector", *own, "_index", F.posexplode("_locs").alias("_at", "url")
    )
    flat = located.where(~F.col("_index")).select("connector", *own, F.lit(0).alias("_parent"), "_at", "url")
    within = F.lit(True) if max_children is None else F.col("_at") < max_children
    children = located.where(F.col("_index") & within)
    nested = children.select("connector", *own, F.col("_at").alias("_parent"), "url").join(named.select("url", "_locs"), "url").select(
        "connector", *own, "_parent", F.posexplode("_locs").alias("_at", "url")
    )
    return _first_places(flat.unionByName(nested).where(_matches(F.col("url"), detail)))


def harvest_links(
    docs: DataFrame,
    roots: DataFrame,
    detail: str | Column,
    seed: str | Column | None = None,
    max_pages: int | None = None,
    base: str | Column | None = None,
) -> DataFrame:
    """Detail links on the pages that a sitemap lists (all that pass ``seed``, or the first ``max_pages`` of them).

    Where a pattern or base column is null, all pages pass and the sitemap's origin is the base.
    """
    named, own, locs = _addresses(docs), _own(roots), F.col("_locs")
    if seed is not None:
        locs = F.filter(locs, lambda u: F.coalesce(_matches(u, seed), F.lit(True)))
    origin = urls.origin(F.col("sitemap_url"))
    root = origin if base is None else F.lit(base) if isinstance(base, str) else F.coalesce(base, origin)
    listed = roots.join(named.select(F.col("url").alias("sitemap_url"), "_locs"), "sitemap_url").select(
        "connector", *own, root.alias("_base"), F.posexplode(locs if max_pages is None else F.slice(locs, 1, max_pages)).alias("_parent", "url")
    )
    links = listed.join(named.select("url", "_hrefs"), "url").select("connector", *own, "_base", "_parent", F.posexplode("_hrefs").alias("_at", "_href"))
    return _first_places(links.withColumn("url", urls.resolve(F.col("_href"), F.col("_base"))).where(_matches(F.col("url"), detail)))


def discover(
    docs: DataFrame,
    roots: DataFrame,
    detail: str | Column,
    seed: str | Column | None = None,
    departments: list[str] | None = None,
    max_pages: int | None = None,
    base: str | Column | None = None,
    max_children: int | None = None,
    crawls: Column | None = None,
) -> DataFrame:
    """Sitemap URLs, or harvested links for connectors whose sitemap names no detail page.

    ``crawls`` says which roots may be harvested; all may by default.
    """
    direct = sitemap_urls(docs, roots, detail, max_children)
    without = roots.join(direct.select("connector").distinct(), "connector", "left_anti")
    if crawls is not None:
        without = without.where(crawls)
    found = direct.unionByName(harvest_links(docs, without, detail, seed, max_pages, base))
    return found.where(page.in_departments(F.col("url"), departments))


def first_listings(found: DataFrame, limit: int | None = None, max_listings: int | None = None) -> DataFrame:
    """The first URLs of each connector up to the smaller of the given caps; all of them without a cap."""
    caps = [c for c in (limit, max_listings) if c is not None]
    if not caps:
        return found
    cap = min(caps)
    order = Window.partitionBy("connector").orderBy("position", "url")
    return found.withColumn("_rank", F.row_number().over(order)).where(F.col("_rank") <= cap).drop("_rank")


# ---------------------------------------------------------------- page strategies


@dataclass(frozen=True)
class Extracted:
    raws: DataFrame
    warnings: DataFrame


def _warning(rows: DataFrame, text: str) -> DataFrame:
    kept = [c for c in rows.columns if c in ("connector_id", "url")]
    return rows.select(*kept, F.concat(F.lit(f"{text} : "), F.col("url")).alias("message"))


def _nothing(pages: DataFrame) -> DataFrame:
    return _warning(pages, "").where(F.lit(False))


def _with_text(pages: DataFrame) -> DataFrame:
    return with_once(pages, _text=page.strip_tags(F.col("html")))


def _raws(rows: DataFrame, passed: list[str], **columns: Column) -> DataFrame:
    return rows.select(*passed, *[c.alias(n) for n, c in columns.items()])


def dense_titles(pages: DataFrame, config: Mapping) -> Extracted:
    """Fields from a dense page title, the body filling the gaps."""
    passed = [c for c in pages.columns if c not in ("url", "html")]
    rows = _with_text(pages)
    if config.get("saleOnly"):
        rows = rows.where(~page.is_rental(F.col("_text")))
    rows = with_once(rows, title=page.title_tag(F.col("html")))
    title = F.coalesce("title", F.lit(""))
    rows = with_once(
        rows,
        _heading=page.strip_tags(title),
        _said=page.place_from_text(F.col("title")),
        _path=page.place_from_url(F.col("url")),
    )
    raws = _raws(
        rows,
        passed,
        id=urls.last_segment(F.col("url")),
        url=F.col("url"),
        title=F.col("title"),
        type=F.col("title"),
        price=F.coalesce(page.price_of(F.col("_heading")), page.price_of(F.col("_text"))),
        surface=F.coalesce(page.surface_of(F.col("_heading")), page.surface_of(F.col("_text"))),
        rooms=F.coalesce(page.rooms_of(title), page.rooms_of(F.col("html"))),
        city=F.coalesce(page.city_from_sale_title(F.col("title")), F.col("_said.city"), F.col("_path.city")),
        postalCode=F.coalesce("_said.postal_code", "_path.postal_code"),
    )
    return Extracted(raws, _nothing(pages))


def og_titles(pages: DataFrame, config: Mapping) -> Extracted:
    """Fields from ``og:title``, then from the body; empty shells become warnings."""
    passed = [c for c in pages.columns if c not in ("url", "html")]
    rows = with_once(_with_text(pages), title=page.meta(F.col("html"), "og:title"), _amount=page.meta(F.col("html"), "product:price:amount"))
    source = F.coalesce("title", F.lit(""))
    rows = with_once(rows, _heading=page.strip_tags(source), _priced=page.strip_tags(F.coalesce("_amount", F.lit(""))))
    rows = with_once(
        rows,
        price=F.coalesce(*[page.price_of(F.col(c)) for c in ("_heading", "_priced", "_text")]),
        surface=F.coalesce(page.surface_of(F.col("_heading")), page.surface_of(F.col("_text"))),
        rooms=F.coalesce(page.rooms_of(source), page.rooms_of(F.col("html"))),
        _said=page.place_from_text(F.col("title")),
        _path=page.place_from_url(F.col("url")),
    )
    empty = F.col("price").isNull() & F.col("surface").isNull() & F.col("rooms").isNull()
    raws = _raws(
        rows.where(~empty),
        passed,
        id=urls.last_segment(F.col("url")),
        url=F.col("url"),
        title=F.col("title"),
        type=F.col("title"),
        rooms=F.col("rooms"),
        price=F.col("price"),
        surface=F.col("surface"),
        city=F.coalesce("_path.city", "_said.city"),
        postalCode=F.coalesce("_path.postal_code", "_said.postal_code"),
    )
    return Extracted(raws, _warning(rows.where(empty), "page sans données (rendu client ?)"))


def slug_pages(pages: DataFrame, config: Mapping) -> Extracted:
    """Fields from the URL slug, price and surface from the body; sold pages are dropped."""
    passed = [c for c in pages.columns if c not in ("url", "html")]
    rows = _with_text(pages)
    rows = with_once(rows.where(~page.is_sold(F.col("_text"))), _slug=page.slug_fields(F.col("url")))
    slug = F.col("_slug")
    title = F.concat_ws(
        " ",
        F.nullif(capitalise(slug["type"]), F.lit("")),
        F.when(slug["rooms"] != 0, F.concat(slug["rooms"].cast("string"), F.lit(" pièces"))),
        slug["city"],
    )
    raws = _raws(
        rows,
        passed,
        id=F.coalesce(slug["ref"], F.col("url")),
        url=F.col("url"),
        title=F.nullif(title, F.lit("")),
        type=slug["type"],
        rooms=slug["rooms"].cast("double"),
        city=slug["city"],
        postalCode=slug["postal_code"],
        price=page.price_of(F.col("_text")),
        surface=page.surface_of(F.col("_text")),
    )
    return Extracted(raws, _nothing(pages))


# Script tag, type patterns of places and prices, French type names.
LD_SCRIPT = r"""(?is)<script[^>]+type=["']application/ld\+json["'][^>]*>(.*?)</script>"""
PLACE_TYPE = (
    "(?i)apartment|house|residence|villa|place|product|realestatelisting|accommodation|land|terrain|singlefamilyresidence"
)
PRICE_TYPE = "(?i)unitpricespecification|pricespecification|offer"
TYPE_NAMES = (
    ("(?i)apartment|flat", "appartement"),
    ("(?i)(?:single.?family)?house|residence|villa", "maison"),
    ("(?i)land|terrain", "terrain"),
)


def _variants(node: Column, path: str) -> Column:
    return F.try_variant_get(node, path, "array<variant>")


def _is(node: Column, kind: str) -> Column:
    return F.schema_of_variant(node).startswith(kind)


def _unfold(entry: Column) -> Column:
    """One step of flattening: list elements, graph members, then the object itself."""
    node = entry["node"]

    def inner(nodes: Column) -> Column:
        return F.transform(nodes, lambda n: F.struct(n.alias("node"), F.lit(False).alias("done")))

    itself = F.array(F.struct(node.alias("node"), F.lit(True).alias("done")))
    graph = F.try_variant_get(node, "$['@graph']", "variant")
    members = F.when(_is(graph, "ARRAY"), inner(_variants(node, "$['@graph']"))).otherwise(F.slice(itself, 1, 0))
    return (
        F.when(entry["done"], F.array(entry))
        .when(_is(node, "ARRAY"), inner(_variants(node, "$")))
        .when(_is(node, "OBJECT"), F.concat(members, itself))
        .otherwise(F.slice(itself, 1, 0))
    )


def _types(node: Column) -> Column:
    kind = F.try_variant_get(node, "$['@type']", "variant")
    return F.when(_is(kind, "ARRAY"), F.filter(F.transform(_variants(node, "$['@type']"), lambda v: F.when(_is(v, "STRING"), F.try_variant_get(v, "$", "string"))), lambda s: s.isNotNull())).when(
        _is(kind, "STRING"), F.array(F.try_variant_get(kind, "$", "string"))
    ).otherwise(F.array().cast("array<string>"))


def json_ld_objects(pages: DataFrame) -> DataFrame:
    """Add ``objects``: every typed JSON-LD object of a page in document order."""
    blocks = F.regexp_extract_all("html", F.lit(LD_SCRIPT), F.lit(1))
    nodes = F.filter(F.transform(blocks, lambda b: F.try_parse_json(trim_blank(b))), lambda n: n.isNotNull())
    entries = F.transform(nodes, lambda n: F.struct(n.alias("node"), F.lit(False).alias("done")))
    # every step opens a list, and a text has no more nested lists than opening brackets
    lists = F.aggregate(blocks, F.lit(1), lambda n, b: n + F.length(b) - F.length(F.replace(b, F.lit("["), F.lit(""))))
    rows = with_once(pages, _nodes=entries, _steps=lists)

    def step(found: Column, _: Column) -> Column:
        return F.when(F.forall(found, lambda e: e["done"]), found).otherwise(F.flatten(F.transform(found, _unfold)))

    rows = with_once(rows, _nodes=F.aggregate(F.sequence(F.lit(0), F.col("_steps")), F.col("_nodes"), step)).drop("_steps")
    named = lambda e: _member(e["node"], "$['@type']").isNotNull() & ~F.equal_null(_string(e["node"], "$['@type']"), F.lit(""))
    kind = F.filter("_nodes", lambda e: e["done"] & named(e))
    return with_once(rows, objects=F.transform(kind, lambda e: e["node"])).drop("_nodes")


def _first(objects: Column, pattern: str) -> Column:
    return F.try_element_at(F.filter(objects, lambda o: F.exists(_types(o), lambda t: t.rlike(pattern))), F.lit(1))


def _string(node: Column, path: str) -> Column:
    return F.try_variant_get(node, path, "string")


def _member(node: Column, path: str) -> Column:
    """Member of an object; JSON null counts as missing."""
    inside = F.try_variant_get(node, path, "variant")
    return F.when(~F.is_variant_null(inside), inside)


def _unwrapped(value: Column) -> Column:
    """Content of an object that wraps a quantity or a price; other values stay."""
    content = F.coalesce(*[_member(value, p) for p in ("$.value", "$['@value']", "$.minPrice", "$.price")])
    return F.when(_is(value, "OBJECT"), content).otherwise(value)


def _innermost(value: Column) -> Column:
    """Unwrap as often as the value has objects."""
    text = F.coalesce(F.to_json(value), F.lit(""))
    objects = F.length(text) - F.length(F.replace(text, F.lit("{"), F.lit("")))
    return F.aggregate(F.sequence(F.lit(0), objects), value, lambda inner, _: _unwrapped(inner))


def _amount(value: Column) -> Column:
    kind = F.schema_of_variant(value)
    return F.when(kind == "STRING", parse_number(F.try_variant_get(value, "$", "string"))).when(
        kind.rlike("^(BIGINT|DOUBLE|FLOAT|DECIMAL)"), F.try_variant_get(value, "$", "double")
    )


def json_ld_pages(pages: DataFrame, config: Mapping) -> Extracted:
    """Fields from the first place and the first price object of each page."""
    passed = [c for c in pages.columns if c not in ("url", "html")]
    rows = json_ld_objects(pages)
    rows = with_once(rows, _place=_first(F.col("objects"), PLACE_TYPE), _offer=_first(F.col("objects"), PRICE_TYPE)).drop("objects")
    usable = F.col("_place").isNotNull() | F.col("_offer").isNotNull()
    good = rows.where(usable)
    place, offer = F.col("_place"), F.col("_offer")
    amounts = {
        "_rooms": _member(place, "$.numberOfRooms"),
        "_surface": _member(place, "$.floorSize"),
        "_price": F.coalesce(_member(offer, "$.price"), _member(place, "$.price")),
        "_lat": _member(place, "$.geo.latitude"),
        "_lng": _member(place, "$.geo.longitude"),
    }
    good = with_once(good, _locality=_string(place, "$.address.addressLocality"), **amounts)
    good = with_once(good, **{n: _innermost(F.col(n)) for n in amounts})
    name = _string(place, "$.name")
    first_named = F.try_element_at(
        F.filter(
            F.transform(
                _types(place),
                lambda t: F.coalesce(*[F.when(t.rlike(p), F.lit(n)) for p, n in TYPE_NAMES]),
            ),
            lambda n: n.isNotNull(),
        ),
        F.lit(1),
    )
    kind = F.when(place.isNotNull(), F.coalesce(first_named, name))
    raws = _raws(
        good,
        passed,
        url=F.coalesce(_string(place, "$.url"), _string(offer, "$.url"), F.col("url")),
        title=name,
        description=_string(place, "$.description"),
        type=kind,
        rooms=_amount(F.col("_rooms")),
        surface=_amount(F.col("_surface")),
        price=_amount(F.col("_price")),
        currency=F.coalesce(_string(offer, "$.priceCurrency"), F.lit("EUR")),
        city=blank_to_null(F.regexp_replace("_locality", rf"(?s){page.WS}*\d{{5}}.*$", "")),
        postalCode=F.coalesce(_string(place, "$.address.postalCode"), page.matched(F.col("_locality"), r"(\d{5})")),
        lat=_amount(F.col("_lat")),
        lng=_amount(F.col("_lng")),
    )
    return Extracted(raws, _warning(rows.where(~usable), "pas de JSON-LD exploitable"))


def api_items(
    items: DataFrame, terms: DataFrame, taxonomies: Mapping[str, str] | str, pages: DataFrame | None = None
) -> DataFrame:
    """Raw listings of API items whose fields are term ids.

    ``items(connector, pos, item)``, ``terms(connector, taxonomy, term_id,
    name)``; the first id of a taxonomy that resolves to a name counts. The
    taxonomy of each role is given once for all, or by a map column of the items. With
    ``pages(url, html)`` price and surface come from the detail page.
    """
    keys = ["connector", "pos"]
    by_row = isinstance(taxonomies, str)
    roles = [r for r in ("propertyType", "location", "rooms", "status") if by_row or taxonomies.get(r)]

    def taxonomy(role: str) -> Column:
        return F.try_element_at(taxonomies, F.lit(role)) if by_row else F.lit(taxonomies[role])

    def ids_of(role: str) -> Column:
        path = F.concat(F.lit("$['"), taxonomy(role), F.lit("']"))
        return F.try_variant_get("item", path, "array<bigint>")

    ids = F.array(*[F.struct(F.lit(r).alias("role"), taxonomy(r).alias("taxonomy"), ids_of(r).alias("ids")) for r in roles])
    rows = with_once(items, item=F.col("item"))
    wanted = (
        rows.select(*keys, F.explode(ids).alias("_tax"))
        .select(*keys, "_tax.role", "_tax.taxonomy", F.posexplode("_tax.ids").alias("_at", "term_id"))
        .join(terms.where(F.col("name") != ""), ["connector", "taxonomy", "term_id"])
    )
    named = wanted.groupBy(*keys).agg(
        *[F.min_by("name", F.when(F.col("role") == r, F.col("_at"))).alias(f"_{r}") for r in roles]
    )
    rows = rows.select(
        *keys,
        *[_string(F.col("item"), p).alias(n) for n, p in (("_id", "$.id"), ("url", "$.link"), ("title", "$.title.rendered"), ("description", "$.content.rendered"))],
    ).join(named, keys, "left")
    for role in ("propertyType", "location", "rooms", "status"):
        if role not in roles:
            rows = rows.withColumn(f"_{role}", F.lit(None).cast("string"))
    rows = rows.where(F.col("_status").isNull() | page.is_for_sale(F.col("_status")))
    place = page.split_location(F.col("_location"))
    counted = parse_number(page.matched(F.col("title"), rf"(?iu)(\d+){page.WS}*pi[èe]ce"))
    raws = rows.select(
        *keys,
        F.col("_id").alias("id"),
        "url",
        "title",
        "description",
        F.coalesce("_propertyType", "title").alias("type"),
        F.coalesce(place["city"], page.city_from_title(F.col("title"))).alias("city"),
        place["postal_code"].alias("postalCode"),
        F.coalesce(parse_number(F.col("_rooms")), counted).alias("rooms"),
    )
    if pages is None:
        return raws
    details = _with_text(pages).select("url", page.price_of(F.col("_text")).alias("price"), page.surface_of(F.col("_text")).alias("surface"))
    return raws.join(details, "url", "left")


def captured_pages(pages: DataFrame) -> DataFrame:
    """Raw listings of pages captured in a reader's browser."""
    rows = _with_text(pages)
    html = F.col("html")

    def tag(name: str) -> Column:
        return F.nullif(page.meta(html, name), F.lit(""))

    image = tag("og:image")
    return rows.select(
        source_of_host(F.coalesce(urls.host(F.col("url")), F.lit(""))).alias("source"),
        "url",
        F.coalesce(tag("og:title"), F.nullif(F.regexp_extract(html, page.TITLE_TAG, 1), F.lit(""))).alias("title"),
        tag("og:description").alias("description"),
        F.coalesce(tag("og:price:amount"), tag("product:price:amount"), page.matched(F.col("_text"), page.CAPTURE_AMOUNT)).alias("price"),
        F.when(image.isNotNull(), F.array(image)).otherwise(F.array().cast("array<string>")).alias("mediaUrls"),
    )


def geocoded(responses: DataFrame, body: str) -> DataFrame:
    """Coordinates of the first feature of each geocoder response."""
    kept = [c for c in responses.columns if c != body]
    rows = with_once(responses, _feature=F.try_variant_get(F.try_parse_json(F.col(body)), "$.features[0]", "variant"))

    def number(path: str) -> Column:
        value = F.try_variant_get("_feature", path, "variant")
        return F.when(F.schema_of_variant(value).rlike("^(BIGINT|DOUBLE|FLOAT|DECIMAL)"), F.try_variant_get(value, "$", "double"))

    def string(name: str) -> Column:
        return F.try_variant_get("_feature", f"$.properties.{name}", "string")

    found = rows.select(
        *kept,
        number("$.geometry.coordinates[1]").alias("lat"),
        number("$.geometry.coordinates[0]").alias("lng"),
        F.coalesce(string("label"), F.lit("")).alias("label"),
        string("postcode").alias("postcode"),
        string("city").alias("city"),
        F.coalesce(F.try_variant_get("_feature", "$.properties.score", "double"), F.lit(0.0)).alias("score"),
    )
    return found.where(F.col("lat").isNotNull() & F.col("lng").isNotNull())


# ---------------------------------------------------------------- dispatch

STRATEGIES: dict[str, Callable[[DataFrame, Mapping], Extracted]] = {
    "sitemap_html": dense_titles,
    "sitemap_network": og_titles,
    "netty": slug_pages,
    "jsonld_sitemap": json_ld_pages,
}


def extract_pages(pages: DataFrame, kind: str, config: Mapping | None = None) -> Extracted:
    """Raw listings and warnings of fetched pages ``(url, html, ...)`` by connector kind."""
    if kind not in STRATEGIES:
        raise ValueError(f"unknown connector kind: {kind}")
    config = config or {}
    extracted = STRATEGIES[kind](pages, config)
    if config.get("departments"):
        kept = extracted.raws.where(page.in_departments(F.col("postalCode"), list(config["departments"])))
        return Extracted(kept, extracted.warnings)
    return extracted


def as_fields(raws: DataFrame) -> DataFrame:
    """Raw columns as the field map that normalisation reads; nulls leave no entry."""
    present = [c for c in RAW_FIELDS if c in raws.columns]
    values = F.map_from_arrays(
        F.array(*[F.lit(c) for c in present]), F.array(*[F.col(c).cast("variant") for c in present])
    )
    others = [c for c in raws.columns if c not in RAW_FIELDS]
    return raws.select(*others, F.map_filter(values, lambda _, v: v.isNotNull()).alias("fields"))
