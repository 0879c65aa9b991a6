"""Field extraction from page texts, titles and URLs by pattern."""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F

from hearthmark.functions import urls
from hearthmark.functions.numbers import parse_number
from hearthmark.functions.text import WHITESPACE, blank_to_null, capitalise, squash, trim_blank

WS = WHITESPACE
BLANKS = WHITESPACE[1:-1]
# a plain class, not a group of alternatives: those recurse once per character
NAME_CHARS = rf"[\p{{L}}{BLANKS}'’-]"

# Money, surface, room, place, status and link patterns.
AMOUNT = rf"(\d[\d.\x20\xA0\x{{202F}}]{{3,}}){WS}*€"
LABELLED_PRICE = rf"(?i)prix[^0-9€]{{0,40}}?{AMOUNT}"
LABELLED_MIN, PLAUSIBLE_MIN, PLAUSIBLE_MAX = 1_000.0, 10_000.0, 20_000_000.0
SURFACE = rf"(\d+(?:[.,]\d+)?){WS}*m(?:²|2)(?![A-Za-z0-9_])"
LABELLED_SURFACE = rf"surface[^0-9]{{0,40}}?{SURFACE}"
ROOMS = rf"(?iu)(\d+){WS}*pi[èe]ces?"
TITLE_TAG = r"(?is)<title[^>]*>(.*?)</title>"
# anchored at the start of a run of name characters, so a long text is scanned once
PLACE_IN_TEXT = rf"(?<!{NAME_CHARS})[{BLANKS}'’-]*+(\p{{L}}{NAME_CHARS}*?){WS}+(\d{{5}})(?!\d)"
SALE_TITLE_CITY = rf"(?iu)vente{WS}+\p{{L}}+{WS}+(\p{{L}}{NAME_CHARS}*?){WS}+\d"
TITLE_CITY = rf"(?iu)^à{WS}+([^,]+),"
SLUG_PLACE = r"^(.+)-(\d{5})$"
DEPARTMENT = r"(?<!\d)(\d{5})(?!\d)"
SOLD_STATUS = "vendu"
OFFERED_STATUS = "vendre|offre|compromis|disponible|vente"
SOLD_PAGE = r"(?i)(?<![A-Za-z0-9_])vendue?(?![A-Za-z0-9_])"
STILL_OFFERED = "(?i)en vente|disponible|sous (?:compromis|offre)"
RENTAL_PAGE = (
    r"(?i)(?<![A-Za-z0-9_])(?:loyer|mensuel)(?![A-Za-z0-9_])"
    rf"|\d[\d{BLANKS}]*€{WS}*(?:cc|hc|charges comprises)?{WS}*/{WS}*mois"
)
HREF = r"""(?i)href=["']([^"']+)["']"""
LOC = rf"(?i)<loc>{WS}*([^<{BLANKS}]+){WS}*</loc>"
SITEMAP_INDEX = rf"(?i)<sitemapindex(?:{WS}|>)"
CAPTURE_AMOUNT = rf"([0-9][0-9 .\xA0]{{3,}}){WS}*€"

# Fixed value: words that are not part of a city name.
CITY_STOP = (
    "a à de du des la le les et en au aux sur vente vendre achat acheter location louer prix piece pieces pièce pièces "
    "m m2 m² maison maisons appartement appartements appart studio terrain terrains villa immeuble local parking garage "
    "box duplex loft propriete fermette grange chalet mas pavillon longere bureau commerce"
).split()

# Parts of listing slugs.
SLUG_STOP = (
    r"(?i)^(appartement|appart|appt|maison|villa|pavillon|terrain|immeuble|local|commerce|bureau|parking|garage|box|studio|"
    r"duplex|loft|propriete|grange|fermette|mas|chalet|longere|[tf]\d+|\d+|pi[èe]ces?|vente|location|achat|louer|acheter|fr|"
    r"neuf|neuve|ancien|ancienne|plain|pied|a|de|la|le|les|du|des)$"
)
SLUG_REF_END = r"(?i)[,_]([a-z]{1,3}\d{3,})$"
SLUG_REF_ANY = r"(?i)(?<![A-Za-z0-9_])([a-z]{1,3}\d{3,})(?![A-Za-z0-9_])"


def matched(text: Column, pattern: str, group: int = 1) -> Column:
    """Group of the first match; null when the pattern does not occur."""
    return F.when(text.rlike(pattern), F.regexp_extract(text, pattern, group))


def strip_tags(html: Column) -> Column:
    return F.regexp_replace(html, "<[^>]+>", " ")


def price_of(text: Column) -> Column:
    """Amount after the word "prix", else the first plausible amount, of a tag-free text."""
    labelled = parse_number(matched(text, LABELLED_PRICE))
    amounts = F.transform(F.regexp_extract_all(text, F.lit(AMOUNT), F.lit(1)), parse_number)
    plausible = F.filter(amounts, lambda n: n.between(PLAUSIBLE_MIN, PLAUSIBLE_MAX))
    return F.when(labelled >= LABELLED_MIN, labelled).otherwise(F.try_element_at(plausible, F.lit(1)))


def surface_of(text: Column) -> Column:
    labelled = parse_number(matched(text, "(?i)" + LABELLED_SURFACE))
    return F.when(labelled > 0, labelled).otherwise(parse_number(matched(text, "(?i)" + SURFACE)))


def rooms_of(text: Column) -> Column:
    return parse_number(matched(text, ROOMS))


def title_tag(html: Column) -> Column:
    """Title up to the first bar."""
    full = F.nullif(squash(matched(html, TITLE_TAG)), F.lit(""))
    return F.coalesce(blank_to_null(F.substring_index(full, "|", 1)), full)


def meta(html: Column, name: str) -> Column:
    """Content of a meta tag named by ``property`` or ``name``, attributes in either order."""
    key = rf"""(?:property|name)=["']{re.escape(name)}["']"""
    content = r"""content=["']([^"']*)["']"""
    first = rf"(?i)<meta[^>]+{key}[^>]+{content}"
    second = rf"(?i)<meta[^>]+{content}[^>]+{key}"
    return F.coalesce(matched(html, first), matched(html, second))


def _titled(words: Column) -> Column:
    return F.array_join(F.transform(words, capitalise), " ")


def place_from_url(url: Column) -> Column:
    """Struct of city and postal code from the first path segment like ``name-63000``."""
    segment = F.try_element_at(F.filter(urls.segments(url), lambda s: s.rlike(SLUG_PLACE)), F.lit(1))
    return F.struct(
        _titled(F.split(F.regexp_extract(segment, SLUG_PLACE, 1), "-")).alias("city"),
        F.regexp_extract(segment, SLUG_PLACE, 2).alias("postal_code"),
    )


def clean_city(raw: Column) -> Column:
    words = F.filter(
        F.split(raw, f"{WS}+"), lambda w: (w != "") & ~w.rlike(r"^\d+$") & ~F.lower(w).isin(CITY_STOP)
    )
    shaped = F.transform(
        words,
        lambda w: F.when((F.length(w) <= 3) & (w == F.upper(w)), w).otherwise(
            F.concat(F.upper(F.substring(w, 1, 1)), F.lower(F.substring(w, 2, 1 << 30)))
        ),
    )
    return F.nullif(F.array_join(shaped, " "), F.lit(""))


def place_from_text(text: Column) -> Column:
    """Struct of city and postal code where letters precede a five-digit code."""
    return F.struct(
        clean_city(matched(text, PLACE_IN_TEXT, 1)).alias("city"), matched(text, PLACE_IN_TEXT, 2).alias("postal_code")
    )


def split_location(name: Column) -> Column:
    """``City - 63114`` as a struct of city and postal code."""
    return F.struct(
        blank_to_null(F.get(F.split(name, f"{WS}[-–]{WS}"), F.lit(0))).alias("city"),
        matched(name, r"(\d{5})").alias("postal_code"),
    )


def city_from_title(title: Column) -> Column:
    return trim_blank(matched(trim_blank(title), TITLE_CITY))


def city_from_sale_title(title: Column) -> Column:
    return blank_to_null(matched(title, SALE_TITLE_CITY))


def is_for_sale(status: Column) -> Column:
    lowered = F.lower(status)
    return ~lowered.rlike(SOLD_STATUS) & lowered.rlike(OFFERED_STATUS)


def is_sold(text: Column) -> Column:
    return text.rlike(SOLD_PAGE) & ~text.rlike(STILL_OFFERED)


def is_rental(text: Column) -> Column:
    return text.rlike(RENTAL_PAGE)


def department(text: Column) -> Column:
    return F.substring(matched(text, DEPARTMENT), 1, 2)


def in_departments(text: Column, departments: list[str] | None) -> Column:
    """Kept without a list, without any code in the text, or with a listed department."""
    if not departments:
        return F.lit(True)
    code = department(text)
    return code.isNull() | code.isin(*departments)


def slug_fields(url: Column) -> Column:
    """Type, rooms, city, postal code and reference from the last URL segment."""
    trimmed = F.regexp_replace(urls.path(url), r"(?i)\.htm$", "")
    last = F.when(
        urls.path(url).isNotNull(),
        F.coalesce(F.try_element_at(F.filter(F.split(trimmed, "/"), lambda s: s != ""), F.lit(-1)), F.lit("")),
    )
    words = F.filter(F.split(F.regexp_replace(last, r"(?i)[,_][a-z]{1,3}\d{3,}$", ""), "[-_,]"), lambda w: w != "")

    def first(pattern: str) -> Column:
        return F.try_element_at(F.filter(words, lambda w: w.rlike(pattern)), F.lit(1))

    sized = F.substring(first(r"(?i)^[tf]\d+$"), 2, 1 << 30).try_cast("int")
    flags = F.transform(words, lambda w: w.rlike("(?iu)^pi[èe]ces?$"))
    place = F.array_position(flags, F.lit(True))
    before = F.when(place > 1, F.try_element_at(words, place.cast("int") - 1))
    counted = F.when(before.rlike(r"^\d+$"), before.try_cast("int"))
    city_words = F.filter(words, lambda w, i: (i > 0) & ~w.rlike(SLUG_STOP))
    return F.struct(
        F.try_element_at(words, F.lit(1)).alias("type"),
        F.coalesce(sized, counted).alias("rooms"),
        F.nullif(_titled(city_words), F.lit("")).alias("city"),
        first(r"^\d{5}$").alias("postal_code"),
        F.coalesce(matched(last, SLUG_REF_END), matched(last, SLUG_REF_ANY)).alias("ref"),
    )
