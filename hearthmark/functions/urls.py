"""Lenient URL parts by pattern; malformed URLs give null instead of an error."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

_ABSOLUTE = r"^[A-Za-z][A-Za-z0-9+.-]*://"


def _part(url: Column, pattern: str, group: int) -> Column:
    return F.when(url.rlike(pattern), F.regexp_extract(url, pattern, group))


def host(url: Column) -> Column:
    return F.lower(_part(url, r"^[A-Za-z][A-Za-z0-9+.-]*://(?:[^/?#@]*@)?([^/?#:]+)", 1))


def origin(url: Column) -> Column:
    return _part(url, r"^([A-Za-z][A-Za-z0-9+.-]*://[^/?#]+)", 1)


def path(url: Column) -> Column:
    """Path of an absolute URL, ``/`` when it has none."""
    raw = _part(url, r"^[A-Za-z][A-Za-z0-9+.-]*://[^/?#]+([^?#]*)", 1)
    return F.when(raw == "", F.lit("/")).otherwise(raw)


def segments(url: Column) -> Column:
    return F.filter(F.split(path(url), "/"), lambda s: s != "")


def last_segment(url: Column) -> Column:
    return F.try_element_at(segments(url), F.lit(-1))


def is_http(text: Column) -> Column:
    return text.rlike("(?i)^https?://")


def _without_dots(url: Column) -> Column:
    """Drop ``.`` segments and let ``..`` take the folder before it, within the path."""
    head = F.regexp_extract(url, r"^([A-Za-z][A-Za-z0-9+.-]*://[^/?#]*)", 1)
    rest = F.substring(url, F.length(head) + 1, F.lit(2147483647))
    way = F.regexp_extract(rest, r"^([^?#]*)", 1)
    tail = F.substring(rest, F.length(way) + 1, F.lit(2147483647))
    parts = F.split(way, "/")

    def step(kept: Column, part: Column) -> Column:
        up = F.slice(kept, 1, F.greatest(F.lit(1), F.size(kept) - 1))
        return F.when(part == "..", up).when(part == ".", kept).otherwise(F.concat(kept, F.array(part)))

    kept = F.aggregate(F.slice(parts, 2, F.greatest(F.lit(0), F.size(parts) - 1)), F.slice(parts, 1, 1), step)
    final = F.when(way.rlike(r"/\.{1,2}$"), F.lit("/")).otherwise(F.lit(""))
    return F.when(way.rlike(r"/\.{1,2}(/|$)"), F.concat(head, F.array_join(kept, "/"), final, tail)).otherwise(url)


def resolve(href: Column, base: Column) -> Column:
    """Absolute form of a link found on a page of ``base``."""
    scheme = F.regexp_extract(base, r"^([A-Za-z][A-Za-z0-9+.-]*:)", 1)
    folder = F.regexp_replace(F.regexp_replace(base, r"[?#].*$", ""), r"(?<!/)/[^/]*$", "/")
    folder = F.when(folder.rlike(_ABSOLUTE + r"[^/]+$"), F.concat(folder, F.lit("/"))).otherwise(folder)
    return (
        F.when(href.rlike(r"^[A-Za-z][A-Za-z0-9+.-]*:"), href)
        .when(href.startswith("//"), _without_dots(F.concat(scheme, href)))
        .when(href.startswith("/"), _without_dots(F.concat(origin(base), href)))
        .when(href.startswith("#"), F.concat(F.regexp_replace(base, r"#.*$", ""), href))
        .when(href.startswith("?"), F.concat(F.regexp_replace(base, r"[?#].*$", ""), href))
        .when(base.rlike(_ABSOLUTE), _without_dots(F.concat(folder, href)))
    )


def external_id(url: Column) -> Column:
    """First run of five digits or more, else host and path without a final slash."""
    digits = F.nullif(F.regexp_extract(url, r"(\d{5,})", 1), F.lit(""))
    return F.coalesce(digits, F.regexp_replace(F.concat(host(url), path(url)), "/$", ""))
