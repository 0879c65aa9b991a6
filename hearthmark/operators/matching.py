"""Explainable similarity of listing pairs and best match per new listing."""

from __future__ import annotations

import itertools
from collections.abc import Mapping, Sequence
from dataclasses import dataclass, replace
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from hearthmark.functions.geo import METRES_PER_DEGREE, NEAR_M, closeness, haversine_m
from hearthmark.functions.images import hash_codes, image_similarity
from hearthmark.functions.numbers import half_up, number_text, one_decimal, proximity
from hearthmark.functions.text import (
    TRIGRAM_SHARE,
    WHITESPACE,
    WORD_SHARE,
    dice,
    fold,
    folded_overlaps,
    folded_words,
    gram_codes,
    jaccard,
    listing_text,
    squash,
    text_similarity,
)
from hearthmark.operators.bounds import outlines, pairs_within
from hearthmark.operators.once import with_once
from hearthmark.operators.relevance import top_details
from hearthmark.operators.skew import grid_join
from hearthmark.session import checkpointed, snapshot

# Factor weights, bucket thresholds, image and position limits of
# the promotion rule, factor names and bucket labels.
WEIGHTS = {
    "text": 0.3,
    "price": 0.12,
    "surface": 0.12,
    "rooms": 0.06,
    "property_type": 0.06,
    "geo": 0.18,
    "image": 0.12,
    "contact": 0.04,
}
THRESHOLDS = {"doublon_exact": 92, "probable_identique": 78, "similaire": 55}
PROMOTED_IMAGE, PROMOTED_GEO = 0.95, 0.5
FACTOR_NAMES = {
    "text": "texte",
    "price": "prix",
    "surface": "surface",
    "rooms": "pièces",
    "property_type": "type",
    "geo": "géo",
    "image": "images",
    "contact": "contact",
}
LABELS = {
    "doublon_exact": "Doublon exact",
    "probable_identique": "Probablement identique",
    "similaire": "Similaire",
    "different": "Différente",
}
HASH_BITS = 64

NUMBERS = ("price", "surface_m2", "rooms", "lat", "lng")
SLIM = (*NUMBERS, "property_type", "_contact", "_hashes", "_blank", "_n_words", "_n_grams")
FULL = (*SLIM, "_words", "_grams")
FOLDED = (*NUMBERS, "property_type", "_contact", "_hashes", "_blank", "_folded")


def comparable(listings: DataFrame) -> DataFrame:
    """Add what the pair score needs: folded contact, token set and trigram set."""
    full = listing_text(F.col("title"), F.col("description"))
    rows = with_once(
        listings,
        _text=full,
        _contact=F.nullif(squash(fold(F.col("contact_name"))), F.lit("")),
        property_type=F.nullif("property_type", F.lit("")),
        _hashes=hash_codes(F.col("phashes")),
    )
    rows = with_once(rows, _folded=fold(F.col("_text"))).withColumn("_grams", gram_codes(F.col("_folded")))
    rows = with_once(rows, _blank=F.col("_text") == "", _words=folded_words(F.col("_folded")))
    return rows.withColumns({"_n_words": F.size("_words"), "_n_grams": F.size("_grams")}).drop("_text", "_folded")


def folded_rows(listings: DataFrame) -> DataFrame:
    """Add what an outline needs: folded contact and text; white space at the ends of a text makes no words and no trigrams."""
    joined = F.concat(F.coalesce("title", F.lit("")), F.lit(" "), F.coalesce("description", F.lit("")))
    rows = with_once(
        listings,
        _joined=joined,
        _contact=F.nullif(squash(fold(F.col("contact_name"))), F.lit("")),
        property_type=F.nullif("property_type", F.lit("")),
        _hashes=hash_codes(F.col("phashes")),
    )
    return rows.withColumns({"_folded": fold(F.col("_joined")), "_blank": ~F.col("_joined").rlike(f"[^{WHITESPACE[1:]}")}).drop("_joined")


def _side(prefix: str, name: str) -> Column:
    return F.col(f"{prefix}{name}")


def _renamed(df: DataFrame, columns: Sequence[str], prefix: str, extra: Sequence[Column] = ()) -> DataFrame:
    return df.select(*extra, *[F.col(c).alias(f"{prefix}{c}") for c in columns])


def attribute_similarities(a: str, b: str, geo_tolerance_m: float = NEAR_M) -> dict[str, Column]:
    """Similarity of everything but the text; null where one side lacks the value."""
    rooms_gap = F.abs(_side(a, "rooms") - _side(b, "rooms"))
    distance = haversine_m(_side(a, "lat"), _side(a, "lng"), _side(b, "lat"), _side(b, "lng"))
    return {
        "price": proximity(_side(a, "price"), _side(b, "price")),
        "surface": proximity(_side(a, "surface_m2"), _side(b, "surface_m2")),
        "rooms": F.when(rooms_gap == 0, F.lit(1.0)).when(rooms_gap == 1, F.lit(0.5)).when(rooms_gap > 1, F.lit(0.0)),
        "property_type": (_side(a, "property_type") == _side(b, "property_type")).cast("double"),
        "geo": closeness(distance, geo_tolerance_m),
        "image": image_similarity(_side(a, "_hashes"), _side(b, "_hashes"), HASH_BITS),
        "contact": (_side(a, "_contact") == _side(b, "_contact")).cast("double"),
    }


def _text_of_pair(a: str, b: str) -> Column:
    return text_similarity(
        _side(a, "_blank"),
        _side(b, "_blank"),
        jaccard(_side(a, "_words"), _side(b, "_words")),
        dice(_side(a, "_grams"), _side(b, "_grams")),
    )


def _bucket(score: Column, image: Column, geo: Column, thresholds: Mapping[str, int]) -> Column:
    promoted = (image >= PROMOTED_IMAGE) & (geo.isNull() | (geo >= PROMOTED_GEO))
    rule = F.when(F.coalesce(promoted, F.lit(False)), F.lit("doublon_exact"))
    for name in ("doublon_exact", "probable_identique", "similaire"):
        rule = rule.when(score >= thresholds[name], F.lit(name))
    return rule.otherwise(F.lit("different"))


SIMILARITIES = ("text", "price", "surface", "rooms", "property_type", "geo", "image", "contact")


def with_score(rows: DataFrame, weights: Mapping[str, float] = WEIGHTS, thresholds: Mapping[str, int] = THRESHOLDS) -> DataFrame:
    """Add ``score`` and ``bucket`` from the ``_sim_*`` columns; absent factors carry no weight."""
    total, earned = F.lit(0.0), F.lit(0.0)
    for name in SIMILARITIES:
        total = total + F.when(_side("_sim_", name).isNotNull(), F.lit(weights[name])).otherwise(F.lit(0.0))
    rows = rows.withColumn("_total", total)
    for name in SIMILARITIES:
        share = F.lit(weights[name]) / F.col("_total") * _side("_sim_", name) * F.lit(100.0)
        earned = earned + F.coalesce(share, F.lit(0.0))
    return rows.withColumn(
        "score", F.when(F.col("_total") > 0, half_up(earned)).otherwise(F.lit(0)).cast("int")
    ).withColumn("bucket", _bucket(F.col("score"), F.col("_sim_image"), F.col("_sim_geo"), thresholds))


def with_explanation(rows: DataFrame, weights: Mapping[str, float] = WEIGHTS, a: str = "a_", b: str = "b_") -> DataFrame:
    """Add ``factors`` (one struct per comparable factor) and ``reason`` to scored pairs."""

    def versus(left: Column, right: Column, unit: str = "") -> Column:
        return F.concat(left, F.lit(f"{unit} vs "), right, F.lit(unit))

    def percent(label: str, name: str, tail: str = "") -> Column:
        return F.concat(F.lit(label), half_up(_side("_sim_", name) * 100).cast("string"), F.lit(f" %{tail}"))

    # fixed values: the texts are part of the result
    details = {
        "text": percent("titre + description ", "text", " similaires"),
        "price": versus(number_text(_side(a, "price")), number_text(_side(b, "price")), " €"),
        "surface": versus(number_text(_side(a, "surface_m2")), number_text(_side(b, "surface_m2")), " m²"),
        "rooms": F.concat(versus(_side(a, "rooms").cast("string"), _side(b, "rooms").cast("string")), F.lit(" pièces")),
        "property_type": versus(_side(a, "property_type"), _side(b, "property_type")),
        "geo": percent("proximité géographique ", "geo"),
        "image": percent("similarité visuelle ", "image"),
        "contact": F.when(_side("_sim_", "contact") == 1, "même contact/agence").otherwise("contacts différents"),
    }
    factors = F.filter(
        F.array(
            *[
                F.when(
                    _side("_sim_", name).isNotNull(),
                    F.struct(
                        F.lit(FACTOR_NAMES[name]).alias("factor"),
                        F.lit(weights[name]).alias("weight"),
                        _side("_sim_", name).alias("similarity"),
                        one_decimal(F.lit(weights[name]) / F.col("_total") * _side("_sim_", name) * F.lit(100.0)).alias("contribution"),
                        details[name].alias("detail"),
                    ),
                )
                for name in SIMILARITIES
            ]
        ),
        lambda f: f.isNotNull(),
    )
    label = F.create_map(*[F.lit(x) for pair in LABELS.items() for x in pair])[F.col("bucket")]
    return rows.withColumn("factors", factors).withColumn(
        "reason", F.concat(label, F.lit(" ("), F.col("score").cast("string"), F.lit("/100) — "), top_details(F.col("factors")))
    )


def score_pairs(
    pairs: DataFrame,
    left: DataFrame,
    right: DataFrame,
    weights: Mapping[str, float] = WEIGHTS,
    thresholds: Mapping[str, int] = THRESHOLDS,
    geo_tolerance_m: float = NEAR_M,
    explain: bool = True,
) -> DataFrame:
    """Score ``pairs(a, b)`` of ids of ``comparable`` tables, or of ``folded_rows``, whose sets are made pair by pair."""
    folded = "_folded" in left.columns
    columns = FOLDED if folded else FULL
    rows = pairs.join(_renamed(left, columns, "a_", [F.col("id").alias("a")]), "a").join(
        _renamed(right, columns, "b_", [F.col("id").alias("b")]), "b"
    )
    sims = {f"_sim_{n}": s for n, s in attribute_similarities("a_", "b_", geo_tolerance_m).items()}
    if folded:
        rows = rows.withColumn("_overlaps", folded_overlaps(F.col("a__folded"), F.col("b__folded"))).drop("a__folded", "b__folded")
        text = text_similarity(F.col("a__blank"), F.col("b__blank"), F.col("_overlaps.words"), F.col("_overlaps.grams"))
    else:
        text = _text_of_pair("a_", "b_")
    rows = with_score(with_once(rows, _sim_text=text, **sims), weights, thresholds)
    if explain:
        rows = with_explanation(rows, weights)
    kept = [*pairs.columns, "score", "bucket", *[f"_sim_{n}" for n in SIMILARITIES]]
    return rows.select(*kept, *(["factors", "reason"] if explain else []))


# ---------------------------------------------------------------------------------
# Candidate pairs. A pair reaches score s only while its total loss
# sum(w * (1 - sim)) stays within (1 - s/100) * W, W being the weight of its
# comparable factors. Every rule below follows from that budget.
# ---------------------------------------------------------------------------------

# Word overlap from which pairs are found by words; below it their attributes have to agree.
OVERLAP = 0.5
# Price or surface ratios and distances that block keys are cut for; a tier takes the next wider one.
RATIOS = (0.94, 0.88, 0.82, 0.75, 0.67, 0.58, 0.48, 0.36, 0.22, 0.1)
NEAR_RATIO = 0.58
REACHES_M = (250.0, 400.0, 600.0, 850.0, 1150.0, 1550.0, NEAR_M)
EPSILON = 1e-9
# Scores at which the search for better partners of promoted pairs stops in turn.
LEVELS = (68, 56, 44)


def _word_floor(text_sim: float) -> float:
    """Smallest Jaccard index of a pair whose text similarity is at least ``text_sim``."""
    return max(0.0, (text_sim - TRIGRAM_SHARE) / WORD_SHARE)


def _loss(name: str) -> Column:
    return F.coalesce(F.lit(WEIGHTS[name]) * (F.lit(1.0) - _side("_sim_", name)), F.lit(0.0))


def _overlap_bound(kind: str) -> Column:
    """Number of common elements is at most the smaller set."""
    return F.least(f"a__n_{kind}", f"b__n_{kind}")


def _text_bound(common_words: Column) -> Column:
    """Best text similarity that set sizes and a bound on the common words allow."""
    words = F.when((F.col("a__n_words") == 0) & (F.col("b__n_words") == 0), F.lit(1.0)).otherwise(
        F.coalesce(common_words / (F.col("a__n_words") + F.col("b__n_words") - common_words), F.lit(0.0))
    )
    grams = F.lit(2.0) * _overlap_bound("grams") / (F.col("a__n_grams") + F.col("b__n_grams"))
    blended = F.lit(WORD_SHARE) * words + F.lit(TRIGRAM_SHARE) * grams
    return F.when(F.col("a__blank") != F.col("b__blank"), F.lit(0.0)).otherwise(blended)


def _within_budget(rows: DataFrame, floor: Column, least_text_loss: float = 0.0) -> DataFrame:
    """Drop pairs that cannot reach ``floor`` even with the best text overlap their sizes allow.

    The cheap attributes decide first; images are compared on what is left.
    ``_room`` keeps the loss the text may still cause.  A route that other
    routes relieve of pairs with much common text gives the loss of the rest.
    """
    sims = attribute_similarities("a_", "b_")
    image = sims.pop("image")
    cheap = [n for n in SIMILARITIES[1:] if n != "image"]
    rows = with_once(rows, **{f"_sim_{n}": sims[n] for n in cheap})
    compares_images = (F.size("a__hashes") > 0) & (F.size("b__hashes") > 0)
    weight = F.lit(WEIGHTS["text"]) + F.when(compares_images, F.lit(WEIGHTS["image"])).otherwise(F.lit(0.0))
    loss = F.lit(0.0)
    for name in cheap:
        weight = weight + F.when(_side("_sim_", name).isNotNull(), F.lit(WEIGHTS[name])).otherwise(F.lit(0.0))
        loss = loss + _loss(name)
    room = (F.lit(1.0) - floor / F.lit(100.0)) * weight - loss + F.lit(EPSILON)
    text_loss = F.greatest(F.lit(least_text_loss), F.lit(WEIGHTS["text"]) * (F.lit(1.0) - _text_bound(_overlap_bound("words"))))
    rows = with_once(rows, _room=room - text_loss, _text_loss=text_loss).where(F.col("_room") >= 0)
    rows = with_once(rows.drop(*[f"_sim_{n}" for n in cheap]), _sim_image=image)
    # hashes of different lengths do not compare: then the image carries no weight either
    void = F.when(compares_images & F.col("_sim_image").isNull(), (F.lit(1.0) - floor / F.lit(100.0)) * F.lit(WEIGHTS["image"]))
    left_over = F.col("_room") - _loss("image") - F.coalesce(void, F.lit(0.0))
    rows = with_once(rows, _room=left_over + F.col("_text_loss")).drop("_sim_image")
    return rows.where(F.col("_room") >= F.col("_text_loss"))


def _rarest_first(rows: DataFrame, frequencies: DataFrame, scope: Sequence[str]) -> DataFrame:
    """Words of every row from rare to common; a row without words holds the empty word."""
    words = rows.select("id", F.explode_outer("_words").alias("_word"), *scope).withColumn(
        "_word", F.coalesce("_word", F.lit(""))
    )
    counted = words.join(frequencies, [*scope, "_word"], "left")
    entry = F.struct(F.coalesce("_df", F.lit(0)).alias("df"), F.col("_word").alias("word"))
    ordered = counted.groupBy("id").agg(F.array_sort(F.collect_list(entry)).alias("_ordered"))
    return rows.select("id", *scope, "_n_words").join(
        ordered.select("id", F.transform("_ordered", lambda e: e["word"]).alias("_ordered")), "id"
    )


def _word_keys(index: DataFrame, scope: Sequence[str], overlap: float, side: str) -> DataFrame:
    """The rarest words of each row with their places, enough that a partner with Jaccard >= ``overlap`` shares one."""
    needed = F.col("_n_words") - F.ceil(F.lit(overlap) * F.col("_n_words") - F.lit(EPSILON)) + 1
    prefix = F.slice("_ordered", 1, F.greatest(F.lit(1), needed.cast("int")))
    return index.select(
        F.col("id").alias(side), F.col("_n_words").alias(f"{side}_n"), *scope, F.posexplode(prefix).alias(f"{side}_at", "_word")
    )


def _words_suffice(overlap: float) -> Column:
    """What follows the first common word can still make up the overlap that the sizes of both sets ask for."""
    after = F.least(F.col("a_n") - F.col("a_at"), F.col("b_n") - F.col("b_at"))
    return after >= F.ceil(F.lit(overlap / (1.0 + overlap)) * (F.col("a_n") + F.col("b_n")) - F.lit(EPSILON))


def _grid_cells(rows: DataFrame, probe: bool, reach_m: Column) -> DataFrame:
    """Grid cells at least ``reach_m`` wide; the probe side visits the eight neighbours too."""
    located = rows.withColumn("_height", reach_m / F.lit(METRES_PER_DEGREE) * F.lit(1.0001))
    height = F.col("_height")
    own_row = F.floor(F.col("lat") / height)
    steps = [-1, 0, 1] if probe else [0]
    rows_of = located.withColumn("_row", F.explode(F.array(*[own_row + s for s in steps])))
    widest = (F.greatest(F.abs("_row"), F.abs(F.col("_row") + 1)) + 1) * height
    shrink = F.cos(F.radians(F.least(widest, F.lit(89.9))))
    columns = F.greatest(F.lit(1), F.floor(F.lit(360.0) / height * shrink * F.lit(0.99))).cast("bigint")
    columns = F.when(shrink < 0.02, F.lit(1)).otherwise(columns)
    rows_of = rows_of.withColumn("_columns", columns)
    own_column = F.floor((F.col("lng") + 180) / (F.lit(360.0) / F.col("_columns")))
    return rows_of.withColumn(
        "_column", F.explode(F.array_distinct(F.array(*[F.pmod(own_column + s, F.col("_columns")) for s in steps])))
    ).drop("_columns", "_height")


# ---------------------------------------------------------------------------------
# Attribute tiers. For pairs with little common text a tier fixes how each attribute
# stands: equal (E), different (D), lacking on the probe side (L) or only on the
# other side (R). What the budget leaves after the losses of the tier bounds price,
# surface and distance, and these bounds become the tier's block key, so that no
# value has to meet everything.
# ---------------------------------------------------------------------------------


@dataclass(frozen=True)
class Tier:
    kind: str  # E, D, L or R
    contact: str
    place: str  # N: near each other, F: far apart, L or R
    price: str  # P: on both sides, L or R
    surface: str  # P, L or R; * where it does not matter
    rooms: str
    images: bool  # on both sides; other tiers leave the images out of the weights
    number: str  # the attribute that bands are cut from, if any
    ratio: float
    reach_m: float
    steps: int  # how many rooms apart, 9 if that does not matter

    @property
    def keyed(self) -> bool:
        return bool(self.number) or "E" in (self.kind, self.contact) or self.place == "N" or self.steps < 9


#: What decides whether a row can be in a tier.
ABSENT = ("property_type", "_contact", "lat", "price", "surface_m2", "rooms")


def attribute_tiers(
    floor: float, overlap: float, lacking_left: set[str], lacking_right: set[str], never: frozenset[str] = frozenset()
) -> list[Tier]:
    """All feasible tiers of pairs with Jaccard below ``overlap`` that reach ``floor``.

    The sets name the attributes that some row of the side lacks, and those
    that no pair has on both sides.
    """
    budget = 1.0 - floor / 100.0

    def ways(name: str, present: str) -> list[str]:
        both = present if name not in never else ""
        return [*both, *(["L"] if name in lacking_left else []), *(["R"] if name in lacking_right else [])]

    names = {"kind": "property_type", "contact": "contact", "place": "geo", "price": "price", "surface": "surface", "rooms": "rooms"}

    def tier(states: dict[str, str], images: bool) -> Tier | None:
        """The tier of these states; ``*`` stands for any, with the weight of a value on both sides."""
        weight = WEIGHTS["text"] + (WEIGHTS["image"] if images else 0.0)
        weight += sum(WEIGHTS[names[k]] for k, v in states.items() if v not in "LR")
        room = budget * weight - _text_loss(overlap) + EPSILON
        room -= sum(WEIGHTS[names[k]] for k, v in states.items() if v in "DF")
        if room < 0:
            return None
        reach = min(r for r in REACHES_M if r >= min(1.0, room / WEIGHTS["geo"]) * NEAR_M - EPSILON) if states["place"] == "N" else 0.0
        number, ratio = "", 1.0
        for name in ("price", "surface"):
            least = 1.0 - room / WEIGHTS[name]
            # cells are a key already; wide bands beside them would only multiply it
            if not number and states[name] == "P" and least >= (RATIOS[-1] if states["place"] != "N" else NEAR_RATIO):
                number, ratio = name, max(x for x in RATIOS if x <= least)
        steps = 9
        if states["rooms"] == "P" and not number and room < WEIGHTS["rooms"]:
            steps = 0 if room < WEIGHTS["rooms"] / 2 else 1
        return Tier(**states, images=images, number=number, ratio=ratio, reach_m=reach, steps=steps)

    found = []
    for kind, contact, place, images in itertools.product(
        ways("property_type", "ED"), ways("_contact", "ED"), ways("lat", "NF"), (False, True)
    ):
        for price in ways("price", "P"):
            # the attributes that a key can do without need not be told apart
            for surface in ["*"] if price == "P" else ways("surface_m2", "P"):
                for rooms in ["*"] if "P" in (price, surface) else ways("rooms", "P"):
                    states = {"kind": kind, "contact": contact, "place": place, "price": price, "surface": surface, "rooms": rooms}
                    found.append(tier(states, images))
    found = [t for t in found if t is not None]
    plain = {replace(t, images=True) for t in found if not t.images}
    return [t for t in found if not t.images or t not in plain]


def _text_loss(overlap: float) -> float:
    """Least loss of a pair whose word sets have a Jaccard index below ``overlap``."""
    return WEIGHTS["text"] * (1.0 - TRIGRAM_SHARE - WORD_SHARE * overlap)


def _tiers_by_pattern(spark: SparkSession, tiers: Sequence[Tier], probe: bool, lacking: set[str]) -> DataFrame:
    """The tiers that a row can be in, by the attributes that it lacks; at most 128 patterns."""
    rows = []
    for missing in itertools.chain.from_iterable(itertools.combinations(sorted(lacking), k) for k in range(len(lacking) + 1)):
        for images in (False, True):
            pattern = sum(1 << ABSENT.index(name) for name in missing) + (images << len(ABSENT))
            for n, t in enumerate(tiers):
                states = zip(ABSENT, (t.kind, t.contact, t.place, t.price, t.surface, t.rooms), strict=True)
                # L wants the probe side to lack the value; R wants the other side to lack it, and the probe side to have it
                unfit = {True: "PEDNFR" if probe else "PEDNF", False: "L" if probe else "R"}
                if (images or not t.images) and not any(state in unfit[name in missing] for name, state in states):
                    rows.append((pattern, n, t.kind == "E", t.contact == "E", t.place == "N", t.number, t.ratio, t.reach_m, t.steps))
    schema = "_pattern int, _tier int, same_kind boolean, same_contact boolean, near boolean, number string, ratio double, reach_m double, steps int"
    return spark.createDataFrame(rows, schema)


def _tier_keys(rows: DataFrame, tiers: Sequence[Tier], probe: bool, prefix: str, lacking: set[str]) -> DataFrame:
    """The rows with one ``_key`` per tier that they can be in, neighbours included on the probe side."""
    missing = {name: _side(prefix, name).isNull() for name in ABSENT}
    missing["lat"] = missing["lat"] | _side(prefix, "lng").isNull()
    pattern = F.when(F.size(_side(prefix, "_hashes")) > 0, F.lit(1 << len(ABSENT))).otherwise(F.lit(0))
    for i, name in enumerate(ABSENT):
        pattern = pattern + F.when(missing[name], F.lit(1 << i)).otherwise(F.lit(0))
    columns = rows.columns
    listed = _tiers_by_pattern(rows.sparkSession, tiers, probe, lacking)
    rows = rows.withColumn("_pattern", pattern).join(F.broadcast(listed), "_pattern")
    t = {name: F.col(name) for name in listed.columns}
    value = F.when(t["number"] == "price", _side(prefix, "price")).when(t["number"] == "surface", _side(prefix, "surface_m2"))
    band = F.floor(F.log(F.abs(value)) / -F.log(t["ratio"])).cast("bigint")
    around = F.array(band - 1, band, band + 1) if probe else F.array(band)
    sign = F.signum(value).cast("int").cast("string")
    bands = (
        F.when(t["number"] == "", F.array(F.lit("")))
        .when(value == 0, F.array(F.lit("0")))
        .otherwise(F.transform(around, lambda n: F.concat_ws(":", sign, n.cast("string"))))
    )
    rooms = _side(prefix, "rooms").cast("bigint")
    near_rooms = F.array(rooms - 1, rooms, rooms + 1) if probe else F.array(rooms)
    levels = (
        F.when(t["steps"] == 9, F.array(F.lit("")))
        .when(t["steps"] == 0, F.array(rooms.cast("string")))
        .otherwise(F.transform(near_rooms, lambda n: n.cast("string")))
    )
    rows = rows.withColumn("_band", F.explode(bands)).withColumn("_level", F.explode(levels))
    near = t["near"]
    spots = rows.where(near).withColumns({"lat": _side(prefix, "lat"), "lng": _side(prefix, "lng")})
    spots = _grid_cells(spots, probe, t["reach_m"]).drop("lat", "lng")
    rest = rows.where(~near).withColumns({"_row": F.lit(0).cast("bigint"), "_column": F.lit(0).cast("bigint")})
    kind = F.when(t["same_kind"], _side(prefix, "property_type")).otherwise("")
    contact = F.when(t["same_contact"], _side(prefix, "_contact")).otherwise("")
    key = F.struct(t["_tier"].alias("tier"), kind.alias("kind"), contact.alias("contact"), "_band", "_level", "_row", "_column")
    return spots.unionByName(rest).select(*columns, key.alias("_key"))


def _hash_chunks(rows: DataFrame) -> DataFrame:
    """Four quarters of every hash; hashes at most three bits apart share one of them."""
    codes = rows.select("*", F.explode("phashes").alias("_code")).withColumn("_code", F.lower("_code"))
    quarter = F.ceil(F.length("_code") / 4).cast("int")
    chunks = F.transform(
        F.sequence(F.lit(0), F.lit(3)),
        lambda i: F.struct(i.alias("part"), F.substr(F.col("_code"), i * quarter + 1, quarter).alias("chunk")),
    )
    return (
        codes.withColumn("_length", F.length("_code"))
        .withColumn("_chunk", F.explode(chunks))
        .withColumns({"_part": F.col("_chunk.part"), "_quarter": F.col("_chunk.chunk")})
        .drop("_code", "_chunk")
    )


def _lacking(rows: DataFrame) -> tuple[set[str], set[str]]:
    """Attributes that some row lacks, and those that all rows lack."""
    missing = {name: F.col(name).isNull() for name in ABSENT} | {"lat": F.col("lat").isNull() | F.col("lng").isNull()}
    found = rows.agg(
        *[F.max(m.cast("int")).alias(f"some_{name}") for name, m in missing.items()],
        *[F.min(m.cast("int")).alias(f"all_{name}") for name, m in missing.items()],
    ).first()
    return {n for n in ABSENT if found[f"some_{n}"]}, {n for n in ABSENT if found[f"all_{n}"]}


class _Sides:
    """Attribute tables of both sides and their words in order of rarity."""

    def __init__(self, left: DataFrame, right: DataFrame, scope: Sequence[str], index: tuple[DataFrame, DataFrame] | None = None):
        self.left, self.right, self.scope = left, right, list(scope)
        self.lacks: tuple[set[str], set[str], frozenset[str]] | None = None
        self.a = _renamed(left, SLIM, "a_", [F.col("id").alias("a"), *scope])
        self.b = _renamed(right, SLIM, "b_", [F.col("id").alias("b"), *scope])
        if index is None:
            words = right.select(*scope, F.explode("_words").alias("_word"))
            frequencies = words.groupBy(*scope, "_word").agg(F.count(F.lit(1)).alias("_df"))
            index = (
                checkpointed(_rarest_first(left, frequencies, scope)),
                checkpointed(_rarest_first(right, frequencies, scope)),
            )
        self.index = index

    def without(self, settled: DataFrame) -> _Sides:
        """The same sides after taking out settled probe rows."""
        done = settled.select(F.col("a").alias("id"))
        left_index = self.index[0].join(done, "id", "left_anti")
        return _Sides(self.left.join(done, "id", "left_anti"), self.right, self.scope, (left_index, self.index[1]))

    def only(self, rows: DataFrame) -> _Sides:
        """The same sides with no other probe rows than these."""
        wanted = rows.select(F.col("a").alias("id"))
        left_index = self.index[0].join(wanted, "id", "left_semi")
        return _Sides(self.left.join(wanted, "id", "left_semi"), self.right, self.scope, (left_index, self.index[1]))

    def by_words(self, overlap: float, floor: Column) -> DataFrame:
        left, right = (_word_keys(x, self.scope, overlap, side) for x, side in zip(self.index, "ab", strict=True))
        met = grid_join(left, right, [*self.scope, "_word"], "a", "b").where(_words_suffice(overlap))
        return self.kept(met.select("a", "b").distinct(), floor)

    def kept(self, met: DataFrame, floor: Column) -> DataFrame:
        rows = met.join(self.a.drop(*self.scope), "a").join(self.b.drop(*self.scope), "b")
        return _within_budget(rows, floor).select("a", "b", "_room")

    def enough_words(self, pairs: DataFrame) -> DataFrame:
        """Drop pairs whose real word overlap leaves too little, before any trigram moves."""
        columns = ["_words", "_n_words", "_n_grams", "_blank"]
        rows = pairs.join(_renamed(self.left, columns, "a_", [F.col("id").alias("a")]), "a").join(
            _renamed(self.right, columns, "b_", [F.col("id").alias("b")]), "b"
        )
        rows = with_once(rows, _common=F.size(F.array_intersect("a__words", "b__words")))
        loss = F.lit(WEIGHTS["text"]) * (F.lit(1.0) - _text_bound(F.col("_common")))
        return rows.where(loss <= F.col("_room")).select("a", "b")

    def tiers(self, floor: float, overlap: float) -> list[Tier]:
        if self.lacks is None:
            (left, none_left), (right, none_right) = _lacking(self.left), _lacking(self.right)
            self.lacks = left, right, frozenset(none_left | none_right)
        return attribute_tiers(floor, overlap, *self.lacks)

    def by_attributes(self, tiers: Sequence[Tier], overlap: float, floor: float) -> DataFrame:
        """Pairs with little common text, by the tiers of their attributes."""
        a, b = _tier_keys(self.a, tiers, True, "a_", self.lacks[0]), _tier_keys(self.b, tiers, False, "b_", self.lacks[1])
        met = grid_join(a, b, [*self.scope, "_key"], "a", "b")
        return _within_budget(met, F.lit(floor), _text_loss(overlap)).select("a", "b", "_room")

    def by_images(self) -> DataFrame:
        """Pairs whose image and position promote them whatever their score."""
        a = _hash_chunks(self.left.select("id", *self.scope, "phashes")).select(F.col("id").alias("a"), *self.scope, "_length", "_part", "_quarter")
        b = _hash_chunks(self.right.select("id", *self.scope, "phashes")).select(F.col("id").alias("b"), *self.scope, "_length", "_part", "_quarter")
        met = grid_join(a, b, [*self.scope, "_length", "_part", "_quarter"], "a", "b").select("a", "b").distinct()
        rows = met.join(self.a.drop(*self.scope), "a").join(self.b.drop(*self.scope), "b")
        sims = attribute_similarities("a_", "b_")
        return rows.where(
            (sims["image"] >= PROMOTED_IMAGE) & (sims["geo"].isNull() | (sims["geo"] >= PROMOTED_GEO))
        ).select("a", "b")


def tight_candidates(sides: _Sides, floor: float) -> DataFrame:
    """Pairs that can reach a floor so high that their texts must nearly agree."""
    text_floor = 1.0 - (1.0 - floor / 100.0) / WEIGHTS["text"]
    return sides.by_words(_word_floor(text_floor), F.lit(floor)).select("a", "b")


def candidates(sides: _Sides, floor: float, overlap: float = OVERLAP) -> tuple[DataFrame, bool]:
    """Pairs that can reach ``floor`` (77.5 for a probable match), and whether these are all.

    Pairs with a word overlap of ``overlap`` or more are found by words, the
    others by attribute tiers.  From 75 upwards every tier has a key, or asks for
    images so close that :meth:`_Sides.by_images` finds them; at a low floor
    some tiers have none, and pairs of these are left out.
    """
    tiers = sides.tiers(floor, overlap)
    keyed = [t for t in tiers if t.keyed]
    found = sides.by_words(overlap, F.lit(floor))
    if keyed:
        found = found.unionByName(sides.by_attributes(keyed, overlap, floor))
    whole = all(t.keyed or _images_decide(t, floor, overlap) for t in tiers)
    return sides.enough_words(found.groupBy("a", "b").agg(F.max("_room").alias("_room"))), whole


def _images_decide(tier: Tier, floor: float, overlap: float) -> bool:
    """Whether a tier without key leaves so little room that images differ in three bits at most."""
    if not tier.images or tier.place in "NF":
        return False
    states = {"property_type": tier.kind, "contact": tier.contact, "price": tier.price, "surface": tier.surface, "rooms": tier.rooms}
    weight = WEIGHTS["text"] + WEIGHTS["image"] + sum(WEIGHTS[n] for n, s in states.items() if s not in "LR")
    room = (1.0 - floor / 100.0) * weight - _text_loss(overlap) - sum(WEIGHTS[n] for n, s in states.items() if s == "D")
    return room / WEIGHTS["image"] * HASH_BITS < 4 - EPSILON


def _profiles(rows: DataFrame, scope: Sequence[str]) -> DataFrame:
    """Digest of everything the score looks at; equal digests are interchangeable."""
    fields = ["title", "description", "price", "surface_m2", "rooms", "property_type", "lat", "lng", "contact_name", "phashes"]
    return rows.withColumn("_profile", F.sha2(F.to_json(F.struct(*scope, *fields), {"ignoreNullFields": "false"}), 256))


def _best(scored: DataFrame) -> DataFrame:
    """Highest score per probe row, lowest partner id on ties; ids may be numbers or texts."""
    top = scored.groupBy("a", "score").agg(F.min_by(F.struct("b", "score", "bucket"), "_order").alias("_m"))
    return top.groupBy("a").agg(F.max_by("_m", "score").alias("_m")).select("a", "_m.*")


def best_matches(
    incoming: DataFrame,
    existing: DataFrame,
    scope: Sequence[str] = (),
    mode: str = "blocked",
    floor: int = THRESHOLDS["probable_identique"],
    stored: bool = False,
) -> DataFrame:
    """Best existing partner of every new listing, if it is an exact or probable match.

    Both inputs have an ``id``; pairs are formed within equal ``scope``
    columns. Ties go to the lowest existing id. ``exact`` scores every pair of
    a scope and serves as the yardstick of the others, which yield the same
    rows and compare copies once: ``blocked`` bounds the score of every pair from short rows
    and scores what can still win, ``keyed`` meets pairs by their rarest words
    and by attribute keys (see :func:`candidates`). ``stored`` says that the new
    listings come from files as they are, so that their texts are not kept again.
    """
    scope = list(scope)
    columns = ["id", *scope, "title", "description", *NUMBERS, "property_type", "contact_name", "phashes"]
    if mode == "blocked":
        # texts are read several times
        incoming, existing = incoming.select(*columns) if stored else snapshot(incoming.select(*columns)), snapshot(existing.select(*columns))
    wanted = _profiles(incoming, scope)
    known = _profiles(existing, scope)
    wanted_reps = wanted.groupBy("_profile").agg(F.min("id").alias("id"))
    known_reps = known.groupBy("_profile").agg(F.min("id").alias("id"))
    if mode == "blocked":
        left = snapshot(outlines(folded_rows(incoming), scope).join(wanted_reps.select("id"), "id", "left_semi"))
        right = snapshot(outlines(folded_rows(existing), scope).join(known_reps.select("id"), "id", "left_semi"))

        most = max(LEAST_SCORED, left.count() // 2)

        def scored_anew(pairs: DataFrame) -> DataFrame:
            # outlines hold no texts: those of the rows that pairs name are read again
            sides = (folded_rows(_named(rows, pairs.select(F.col(end).alias("id")))) for rows, end in ((incoming, "a"), (existing, "b")))
            return score_pairs(pairs.select("a", "b").distinct(), *sides, explain=False).select("a", "b", "score", "bucket", F.col("b").alias("_order"))

        def scored_in_turns(pairs: DataFrame) -> DataFrame:
            # pairs move the texts of both rows: as many at once as are in proportion to the rows
            turns = -(-pairs.count() // most)
            if turns < 2:
                return scored_anew(pairs)
            turn = F.pmod(F.xxhash64("a"), F.lit(turns))
            return reduce(DataFrame.unionByName, [checkpointed(_best(scored_anew(pairs.where(turn == n)))) for n in range(turns)]).withColumn("_order", F.col("b"))

        best = _bounded_best(left, right, scope, scored_in_turns, floor)
    else:
        left = checkpointed(comparable(incoming.select(*columns).join(wanted_reps.select("id"), "id", "left_semi")).drop("title", "description", "contact_name"))
        right = checkpointed(comparable(existing.select(*columns).join(known_reps.select("id"), "id", "left_semi")).drop("title", "description", "contact_name"))

        def scored(pairs: DataFrame) -> DataFrame:
            return score_pairs(pairs, left, right, explain=False).select(
                "a", "b", "score", "bucket", F.col("b").alias("_order")
            )

        if mode == "keyed":
            best = _keyed_best(left, right, scope, scored, floor)
        else:
            if scope:
                pairs = left.select(F.col("id").alias("a"), *scope).join(right.select(F.col("id").alias("b"), *scope), scope).select("a", "b")
            else:
                pairs = left.select(F.col("id").alias("a")).crossJoin(right.select(F.col("id").alias("b")))
            best = _best(scored(pairs)).where(F.col("bucket").isin("doublon_exact", "probable_identique"))
    members = wanted.select("id", "_profile").join(wanted_reps.withColumnRenamed("id", "a"), "_profile")
    return members.join(best, "a").select("id", F.col("b").alias("with_id"), "score", "bucket")


#: Pairs that are scored in one turn, at least.
LEAST_SCORED = 10_000

#: Classes of ids by which rows are kept from being shuffled; the list of classes that is sent around has no more entries.
ID_CLASSES = 1 << 20


def _named(rows: DataFrame, ids: DataFrame) -> DataFrame:
    """All rows with one of the ids, and a few others, without moving the rest."""
    classes = ids.select(F.pmod(F.xxhash64("id"), F.lit(ID_CLASSES)).alias("_class")).distinct()
    # an expression of the id alone, so that the optimizer can move it to where the rows are read
    return rows.join(F.broadcast(classes), F.pmod(F.xxhash64(rows["id"]), F.lit(ID_CLASSES)) == classes["_class"], "left_semi")


def _bounded_best(left: DataFrame, right: DataFrame, scope: list[str], scored, floor: int) -> DataFrame:
    """Best partners by falling bounds: of the few or likeliest pairs of each row first, then of all pairs that can beat them."""

    def reaching(least: Column, best: DataFrame | None = None, promoted: bool = False) -> DataFrame:
        none = F.lit(None)
        found = {"_own": none.cast(dict(right.dtypes)["id"]), "_score": none.cast("int")}
        probes = left.withColumns(found)
        if best is not None:
            probes = left.join(best.select(F.col("a").alias("id"), F.col("b").alias("_own"), F.col("score").alias("_score")), "id")
        probes = probes.withColumns({"_least": least.cast("double"), "_promoted": F.lit(promoted)})
        return pairs_within(probes, right, scope, WEIGHTS, PROMOTED_IMAGE, first=best is None)

    def improved(best: DataFrame, pairs: DataFrame) -> DataFrame:
        known = best.withColumn("_order", F.col("b"))
        return checkpointed(_best(scored(checkpointed(pairs.select("a", "b"))).unionByName(known)))

    found = checkpointed(reaching(F.lit(floor - 0.5), promoted=True))
    best = checkpointed(_best(scored(found.select("a", "b"))))
    # rows with more pairs than the first search returns: all that can beat the likeliest
    crowded = best.join(found.where("more").select("a").distinct(), "a", "left_semi")
    if not crowded.isEmpty():
        best = improved(best, reaching(F.lit(floor - 0.5), crowded, promoted=True))
    sure = [best.where(F.col("score") >= floor)]
    # a promoted pair below the floor counts only when no other pair beats it
    rest = best.where((F.col("score") < floor) & (F.col("bucket") == "doublon_exact"))
    for level in (*[x for x in LEVELS if x < floor], 0):
        if rest.isEmpty():
            break
        rest = improved(rest, reaching(F.greatest(F.lit(level), F.col("_score")) - 0.5, rest))
        sure.append(rest.where((F.col("score") >= level) & F.col("bucket").isin("doublon_exact", "probable_identique")))
        rest = rest.where(F.col("score") < level)
    return reduce(DataFrame.unionByName, sure)


def _keyed_best(left: DataFrame, right: DataFrame, scope: list[str], scored, floor: int) -> DataFrame:
    sides = _Sides(left, right, scope)
    perfect = 100
    tight = scored(tight_candidates(sides, perfect - 0.5)).where(F.col("score") >= perfect)
    settled = checkpointed(_best(tight))
    rest = sides.without(settled)
    pairs, whole = candidates(rest, floor - 0.5)
    if not whole:
        raise ValueError("the blocking bounds do not hold for this floor; use mode='exact'")
    # a promoted pair below the floor counts only when no other pair beats it
    reached = scored(pairs.unionByName(rest.by_images()).distinct()).where((F.col("score") >= floor) | (F.col("bucket") == "doublon_exact"))
    reached = checkpointed(_best(reached))
    sure = settled.unionByName(reached.where(F.col("score") >= floor))
    doubtful = reached.where(F.col("score") < floor)
    if doubtful.isEmpty():
        return sure
    return sure.unionByName(_unbeaten(rest, doubtful, scored, floor))


def _unbeaten(sides: _Sides, doubtful: DataFrame, scored, floor: int) -> DataFrame:
    """Promoted pairs below the floor that no other pair of their row beats.

    A row starts with the score of its promoted pair, and the search goes down
    level by level.  A row for which a level brings up a better pair is out; one
    whose own score lies above the level is settled when the level's blocks are
    complete.  Only rows without any better pair down to the last level are
    compared with all listings of their scope that could still beat them.
    """
    open_rows, kept = doubtful, []
    for level in LEVELS:
        if level >= floor:
            continue
        found, whole = candidates(sides.only(open_rows), level - 0.5)
        own = open_rows.select("a", F.col("b").alias("_b"), F.col("score").alias("_own"))
        better = (F.col("score") > F.col("_own")) | ((F.col("score") == F.col("_own")) & (F.col("b") < F.col("_b")))
        beaten = scored(found).join(own, "a").where(better).select("a").distinct()
        left = checkpointed(open_rows.join(beaten, "a", "left_anti"))
        if whole:
            kept.append(left.where(F.col("score") >= level))
            left = left.where(F.col("score") < level)
        if left.isEmpty():
            open_rows = None
            break
        open_rows = left
    if open_rows is not None:
        rivals = _best(scored(_rivals(sides.only(open_rows), open_rows)).unionByName(open_rows.withColumn("_order", F.col("b"))))
        kept.append(rivals.where(F.col("bucket").isin("doublon_exact", "probable_identique")))
    merged = kept[0]
    for part in kept[1:]:
        merged = merged.unionByName(part)
    return merged


def _rivals(sides: _Sides, doubtful: DataFrame) -> DataFrame:
    """All pairs of the last doubtful rows that could still reach their provisional score."""
    probes = sides.a.join(doubtful.select("a", F.col("score").alias("_reached")), "a").withColumn("_all", F.lit(0))
    met = grid_join(probes, sides.b.withColumn("_all", F.lit(0)), [*sides.scope, "_all"], "a", "b")
    return _within_budget(met, F.col("_reached") - 0.5).select("a", "b")


def canonical_edges(edges: DataFrame, order: str) -> DataFrame:
    """Undirected edges with the smaller end first, no loops, the last write per pair."""
    rest = [c for c in edges.columns if c not in ("a", "b")]
    ends = edges.where(F.col("a") != F.col("b")).select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b"), *rest)
    last = ends.groupBy("a", "b").agg(F.max_by(F.struct(*rest), F.col(order)).alias("_row"))
    return last.select("a", "b", "_row.*")
