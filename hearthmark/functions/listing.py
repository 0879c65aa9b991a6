"""Listing-level rules: property types, identifiers, fingerprints, market fields."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

from hearthmark.functions.numbers import number_text
from hearthmark.functions.text import fold, squashed

# Patterns tried in order on the folded type text; first match wins.
PROPERTY_TYPES = (
    (r"\b(appartement|appart|appt|studio|t[1-9]|f[1-9]|duplex|loft)s?\b", "appartement"),
    (
        r"\b(maison|villa|pavillon|longere|mas|chalet|propriete|fermette|grange|corps de ferme)s?\b",
        "maison",
    ),
    (r"\b(terrain|parcelle|foncier)s?\b", "terrain"),
    (r"\b(parking|garage|box)s?\b", "parking"),
    (r"\b(immeuble)s?\b", "immeuble"),
    (r"\b(local|commerce|bureau|entrepot|hangar)s?\b", "local"),
)
OTHER_TYPE = "autre"

# Host fragments of known portals, tried in order.
PORTALS = (
    ("leboncoin", "leboncoin"),
    ("seloger", "seloger"),
    ("bienici", "bienici"),
    ("pap.fr", "pap"),
)
GENERIC_SOURCE = "import_generique"

# Offset basis and prime of the 32-bit FNV-1a hash.
FNV_BASIS, FNV_PRIME = 2166136261, 16777619


def property_type(text: Column) -> Column:
    folded = fold(text)
    rule = F.when(text.isNull() | (text == ""), F.lit(None).cast("string"))
    for pattern, name in PROPERTY_TYPES:
        rule = rule.when(folded.rlike(pattern), F.lit(name))
    return rule.otherwise(F.lit(OTHER_TYPE))


def market_type(kind: Column) -> Column:
    lowered = F.lower(kind)
    return F.when(F.contains(lowered, F.lit("appart")), F.lit("Appartement")).when(
        F.contains(lowered, F.lit("maison")), F.lit("Maison")
    )


def source_of_host(host: Column) -> Column:
    bare = F.regexp_replace(host, r"^www\.", "")
    rule = None
    for fragment, name in PORTALS:
        hit = F.contains(bare, F.lit(fragment))
        rule = F.when(hit, F.lit(name)) if rule is None else rule.when(hit, F.lit(name))
    return rule.otherwise(F.lit(GENERIC_SOURCE))


#: UTF-16 units that are hashed at once.
FNV_UNITS = 1 << 22


def _fnv1a(texts: pd.Series) -> pd.Series:
    """FNV-1a of a batch, in pieces of bounded size; a longer text is a piece of its own."""
    parts, begin, held = [], 0, 0
    for k, text in enumerate(texts):
        size = len(text) if isinstance(text, str) else 0
        if held and held + size > FNV_UNITS:
            parts.append(_fnv1a_piece(texts.iloc[begin:k]))
            begin, held = k, 0
        held += size
    parts.append(_fnv1a_piece(texts.iloc[begin:]))
    return pd.concat(parts)


def _fnv1a_piece(texts: pd.Series) -> pd.Series:
    """One vector step per character position over all texts that reach it."""
    present = texts.notna().to_numpy()
    units = [np.frombuffer(t.encode("utf-16-le", "surrogatepass"), dtype="<u2") for t in texts[present]]
    lengths = np.array([len(u) for u in units], dtype=np.int64)
    order = np.argsort(-lengths, kind="stable")
    flat = np.concatenate([units[i] for i in order]).astype(np.uint32) if len(units) else np.empty(0, np.uint32)
    sorted_lengths = lengths[order]
    starts = np.concatenate([[0], np.cumsum(sorted_lengths)[:-1]]).astype(np.int64) if len(units) else lengths
    state = np.full(len(units), FNV_BASIS, dtype=np.uint32)
    reach = np.searchsorted(-sorted_lengths, -np.arange(sorted_lengths[0] if len(units) else 0), side="left")
    prime = np.uint32(FNV_PRIME)
    for position, active in enumerate(reach):
        state[:active] = (state[:active] ^ flat[starts[:active] + position]) * prime
    digits = np.empty(len(units), dtype=object)
    digits[order] = [f"{value:08x}" for value in state]
    out = pd.Series([None] * len(texts), dtype=object, index=texts.index)
    out[present] = digits
    return out


def fnv1a_hex(text: Column) -> Column:
    """32-bit FNV-1a over UTF-16 code units, eight hex digits.

    Each step depends on the one before, which Catalyst can only express as an
    interpreted fold over single characters; the Arrow batch version hashes
    many texts side by side and is several times faster on long texts.
    """
    return F.pandas_udf(_fnv1a, "string")(text)


def fingerprint(price: Column, surface: Column, rooms: Column, title: Column, description: Column) -> Column:
    """Content hash that ignores case, accents and spacing."""
    blank = F.lit("")

    def printed(number: Column) -> Column:
        return F.coalesce(number_text(number.cast("double")), blank)

    numbers = F.concat_ws("|", printed(price), printed(surface), printed(rooms))
    return F.pandas_udf(_fingerprint, "string")(numbers, fold(F.coalesce(title, blank)), fold(F.coalesce(description, blank)))


def _fingerprint(numbers: pd.Series, titles: pd.Series, descriptions: pd.Series) -> pd.Series:
    # spacing is told apart here: a pattern in Spark would step through the whole text
    lines = [f"{n}|{squashed(t)}|{squashed(d)}" for n, t, d in zip(numbers, titles, descriptions, strict=True)]
    return _fnv1a(pd.Series(lines, dtype=object))


def content_id(title: Column, url: Column, price: Column) -> Column:
    """Fallback identifier: equal imports without an id share it."""
    blank = F.lit("")
    return F.concat(
        F.lit("imp-"),
        fnv1a_hex(
            F.concat_ws(
                "|", F.coalesce(title, blank), F.coalesce(url, blank), F.coalesce(number_text(price), blank)
            )
        ),
    )


def price_per_m2(price: Column, surface: Column) -> Column:
    return F.when(surface > 0, price / surface)


def score_band(score: Column) -> Column:
    return (
        F.when(score.isNull(), F.lit(None).cast("string"))
        .when(score >= 75, F.lit("high"))
        .when(score >= 50, F.lit("mid"))
        .otherwise(F.lit("low"))
    )
