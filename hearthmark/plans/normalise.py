"""Raw listings to canonical listings plus an error table."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from hearthmark.functions import urls
from hearthmark.functions.listing import GENERIC_SOURCE, content_id, property_type
from hearthmark.functions.numbers import half_up, number_text, parse_number
from hearthmark.functions.text import blank_to_null
from hearthmark.operators.once import with_once

# Accepted field names by kind of value.
TEXT_FIELDS = (
    "externalId id url title description propertyType type floor dpe postalCode city contactName publishedAt"
).split()
NUMBER_FIELDS = "price surfaceM2 surface rooms bedrooms charges agencyFees lat lng".split()
NAME_FIELDS = ("sourceId", "source")
LIST_FIELDS = ("mediaUrls", "phashes")
CURRENCY = "EUR"

CANONICAL = (
    "source_id external_id url title description price currency surface_m2 rooms bedrooms property_type floor dpe "
    "charges agency_fees lat lng postal_code city address_approx is_pro contact_name published_at source_updated_at "
    "media_urls phashes"
).split()


def _value(name: str) -> Column:
    return F.col(f"_v_{name}")


def _kind(name: str) -> Column:
    """Type name of a present value; missing values give null."""
    return F.col(f"_k_{name}")


def _is_number(kind: Column) -> Column:
    return kind.rlike("^(BIGINT|INT|SMALLINT|TINYINT|DOUBLE|FLOAT|DECIMAL)")


def _bad(name: str) -> Column:
    """Whether a field holds a value of a type the schema rejects."""
    kind = _kind(name)
    if name in NAME_FIELDS:
        fine = (kind == "STRING") & (F.try_variant_get(_value(name), "$", "string") != "")
    elif name == "currency":
        fine = kind == "STRING"
    elif name == "isPro":
        fine = kind.isin("BOOLEAN", "VOID")
    elif name in LIST_FIELDS:
        fine = kind.isin("ARRAY<STRING>", "ARRAY<VOID>") & ~F.exists(
            F.try_variant_get(_value(name), "$", "array<variant>"), lambda v: F.is_variant_null(v)
        )
    else:
        fine = (kind == "STRING") | (kind == "VOID") | _is_number(kind)
    return _value(name).isNotNull() & ~F.coalesce(fine, F.lit(False))


def _text(name: str) -> Column:
    return F.col(f"_t_{name}")


def _number(name: str) -> Column:
    return F.col(f"_n_{name}")


def _read_text(name: str) -> Column:
    value = _value(name)
    number = number_text(F.try_variant_get(value, "$", "double"))
    return blank_to_null(F.when(_is_number(_kind(name)), number).otherwise(F.try_variant_get(value, "$", "string")))


def _read_number(name: str) -> Column:
    value = _value(name)
    return F.when(_is_number(_kind(name)), F.try_variant_get(value, "$", "double")).when(
        _kind(name) == "STRING", parse_number(F.try_variant_get(value, "$", "string"))
    )


def _whole(name: str) -> Column:
    return half_up(_number(name)).cast("int")


def _strings(name: str) -> Column:
    return F.coalesce(F.try_variant_get(_value(name), "$", "array<string>"), F.array().cast("array<string>"))


def normalize_listings(raws: DataFrame, source: str | None = None) -> tuple[DataFrame, DataFrame]:
    """Split raw rows into canonical listings and errors.

    ``raws`` holds ``fields`` (map of field name to variant, see
    :func:`hearthmark.sources.feeds.map_fields`); other columns pass through.
    ``source`` names a column that overrides the source of every row.
    """
    checked = [n for n in (*NAME_FIELDS, *TEXT_FIELDS, *NUMBER_FIELDS, "currency", "isPro", *LIST_FIELDS)]
    if source is not None:
        checked = [n for n in checked if n != "sourceId"]
    problems = F.filter(
        F.array(*[F.when(_bad(n), F.lit(f"{n}: Invalid input")) for n in checked]), lambda p: p.isNotNull()
    )
    passed = [c for c in raws.columns if c not in ("fields", *CANONICAL)]
    names = (*NAME_FIELDS, *TEXT_FIELDS, *NUMBER_FIELDS, "currency", "isPro", *LIST_FIELDS)
    values = {f"_v_{n}": F.try_element_at(F.col("fields"), F.lit(n)) for n in names}
    rows = with_once(raws, **values, _missing=F.col("fields").isNull())
    rows = with_once(rows, **{f"_k_{n}": F.schema_of_variant(_value(n)) for n in names})
    rows = with_once(
        rows,
        _problems=F.when(F.col("_missing"), F.array(F.lit(": Invalid input"))).otherwise(problems),
        **{f"_t_{n}": _read_text(n) for n in TEXT_FIELDS},
        **{f"_n_{n}": _read_number(n) for n in NUMBER_FIELDS},
    )
    errors = rows.where(F.size("_problems") > 0).select(*passed, F.array_join("_problems", ", ").alias("message"))

    own_source = F.coalesce(
        F.try_variant_get(_value("sourceId"), "$", "string"), F.try_variant_get(_value("source"), "$", "string"), F.lit(GENERIC_SOURCE)
    )
    nothing = F.lit(None)
    columns = {
        "source_id": F.col(source) if source is not None else own_source,
        "external_id": F.coalesce(
            _text("externalId"),
            _text("id"),
            urls.external_id(_text("url")),
            content_id(_text("title"), _text("url"), _number("price")),
        ),
        "url": _text("url"),
        "title": _text("title"),
        "description": _text("description"),
        "price": _number("price"),
        "currency": F.coalesce(F.try_variant_get(_value("currency"), "$", "string"), F.lit(CURRENCY)),
        "surface_m2": F.coalesce(_number("surfaceM2"), _number("surface")),
        "rooms": _whole("rooms"),
        "bedrooms": _whole("bedrooms"),
        "property_type": property_type(F.coalesce(_text("propertyType"), _text("type"))),
        "floor": _text("floor"),
        "dpe": _text("dpe"),
        "charges": _number("charges"),
        "agency_fees": _number("agencyFees"),
        "lat": _number("lat"),
        "lng": _number("lng"),
        "postal_code": _text("postalCode"),
        "city": _text("city"),
        "address_approx": nothing.cast("string"),
        "is_pro": F.try_variant_get(_value("isPro"), "$", "boolean"),
        "contact_name": _text("contactName"),
        "published_at": _text("publishedAt"),
        "source_updated_at": nothing.cast("timestamp"),
        "media_urls": _strings("mediaUrls"),
        "phashes": _strings("phashes"),
    }
    good = rows.where(F.size("_problems") == 0)
    listings = good.select(*[c for c in passed if c not in columns], *[e.alias(n) for n, e in columns.items()])
    return listings, errors


def preview(items: DataFrame, feed: str, field_map: dict[str, str] | None = None, sample: int = 5):
    """Dry run of a feed: item count, first normalised rows and their errors, nothing written."""
    from hearthmark.sources.feeds import map_fields

    counts = items.groupBy(feed).agg(F.count(F.lit(1)).alias("count"))
    head = map_fields(items.where(F.col("pos") < sample), "item", field_map).withColumn("_source", F.lit("test"))
    listings, errors = normalize_listings(head, source="_source")
    return counts, listings.select(feed, "pos", "external_id", "title", "price", "city", "surface_m2"), errors
