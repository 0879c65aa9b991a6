"""Relevance of listings for the search that collected them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from hearthmark.functions.geo import haversine_m, in_polygon
from hearthmark.functions.numbers import half_up, number_text, one_decimal, range_fit
from hearthmark.functions.text import contains_folded, fold, split_keywords
from hearthmark.operators.once import with_once

# Factor weights, range margins, score without any factor.
WEIGHTS = {"prix": 30, "surface": 20, "pièces": 15, "type": 15, "mots-clés": 20}
MARGIN, ROOMS_MARGIN = 0.25, 0.5
NEUTRAL_SCORE = 50

CRITERIA = (
    "price_min price_max surface_min surface_max rooms_min rooms_max property_types "
    "keywords_required keywords_excluded center_lat center_lng radius_km polygon"
).split()


def criteria_rows(searches: DataFrame) -> DataFrame:
    """Stored searches as typed criteria: comma-separated words become arrays."""
    lists = {
        name: split_keywords(F.col(name))
        for name in ("property_types", "keywords_required", "keywords_excluded", "source_ids")
        if name in searches.columns
    }
    typed = searches.withColumns(lists)
    if "polygon" not in typed.columns:
        typed = typed.withColumn("polygon", F.lit(None).cast("array<struct<lng:double,lat:double>>"))
    return typed


def with_polygons(searches: DataFrame, vertices: DataFrame) -> DataFrame:
    """Attach the ordered ring of each drawn zone."""
    rings = vertices.groupBy("search_id").agg(
        F.transform(
            F.array_sort(F.collect_list(F.struct("pos", "lng", "lat"))),
            lambda v: F.struct(v["lng"].alias("lng"), v["lat"].alias("lat")),
        ).alias("polygon")
    )
    return searches.join(rings, "search_id", "left")


def prepare_searches(searches: DataFrame) -> DataFrame:
    """Criteria nested in one struct, keywords folded once per search."""
    return searches.select(
        "search_id",
        F.struct(
            *CRITERIA,
            F.transform("keywords_excluded", fold).alias("folded_excluded"),
            F.transform("keywords_required", fold).alias("folded_required"),
        ).alias("_criteria"),
    )


def _factor(name: str, present: Column, fit: Column, detail: Column) -> Column:
    weight = WEIGHTS[name]
    return F.when(
        present,
        F.struct(
            F.lit(name).alias("factor"),
            F.lit(weight).alias("weight"),
            one_decimal(fit * F.lit(float(weight))).alias("contribution"),
            (fit >= 0.5).alias("ok"),
            detail.alias("detail"),
        ),
    )


def top_details(factors: Column, order_field: str = "contribution") -> Column:
    """Details of the two strongest factors; equal ones keep their order."""
    keyed = F.transform(
        factors,
        lambda f, i: F.struct((-f[order_field]).alias("weakness"), i.alias("position"), f["detail"].alias("detail")),
    )
    return F.array_join(F.transform(F.slice(F.array_sort(keyed), 1, 2), lambda f: f["detail"]), " ; ")


def score_relevance(rows: DataFrame) -> DataFrame:
    """Add ``relevance`` to rows that carry a listing and ``_criteria``; null criteria score 100."""
    c = F.col("_criteria")
    hay = F.col("_haystack")
    rows = with_once(
        rows, _haystack=fold(F.concat(F.coalesce("title", F.lit("")), F.lit(" "), F.coalesce("description", F.lit(""))))
    )
    banned = F.filter(
        F.arrays_zip(c["keywords_excluded"].alias("word"), c["folded_excluded"].alias("folded")),
        lambda k: contains_folded(hay, k["folded"]),
    )
    found = F.size(F.filter(c["folded_required"], lambda k: contains_folded(hay, k)))
    required = F.size(c["keywords_required"])
    located = F.col("lat").isNotNull() & F.col("lng").isNotNull()
    drawn = F.coalesce(F.size(c["polygon"]) >= 3, F.lit(False))
    round_zone = c["center_lat"].isNotNull() & c["center_lng"].isNotNull() & c["radius_km"].isNotNull()
    distance = haversine_m(c["center_lat"], c["center_lng"], F.col("lat"), F.col("lng"))
    outside = (
        F.when(located & drawn, ~in_polygon(F.col("lng"), F.col("lat"), c["polygon"]))
        .when(located & round_zone, distance > c["radius_km"] * F.lit(1000.0))
        .otherwise(F.lit(False))
    )
    rooms = F.col("rooms").cast("double")
    kind = F.col("property_type")
    factors = F.filter(
        F.array(
            _factor(
                "prix",
                F.col("price").isNotNull(),
                range_fit(F.col("price"), c["price_min"], c["price_max"], MARGIN),
                F.concat(number_text(F.col("price")), F.lit(" €")),
            ),
            _factor(
                "surface",
                F.col("surface_m2").isNotNull(),
                range_fit(F.col("surface_m2"), c["surface_min"], c["surface_max"], MARGIN),
                F.concat(number_text(F.col("surface_m2")), F.lit(" m²")),
            ),
            _factor(
                "pièces",
                F.col("rooms").isNotNull(),
                range_fit(rooms, c["rooms_min"].cast("double"), c["rooms_max"].cast("double"), ROOMS_MARGIN),
                F.concat(F.col("rooms").cast("string"), F.lit(" pièces")),
            ),
            _factor(
                "type",
                (kind != "") & (F.size(c["property_types"]) > 0),
                F.array_contains(c["property_types"], kind).cast("double"),
                kind,
            ),
            _factor(
                "mots-clés",
                required > 0,
                found / required,
                F.concat(found.cast("string"), F.lit("/"), required.cast("string"), F.lit(" mots-clés requis")),
            ),
        ),
        lambda f: f.isNotNull(),
    )
    rows = with_once(rows, _banned=F.try_element_at(banned, F.lit(1))["word"], _outside=outside, _factors=factors)
    used = F.aggregate("_factors", F.lit(0), lambda total, f: total + f["weight"])
    earned = F.aggregate("_factors", F.lit(0.0), lambda total, f: total + f["contribution"])
    rows = rows.withColumn(
        "_score",
        F.when(used > 0, half_up(earned / used * F.lit(100.0)).cast("int")).otherwise(F.lit(NEUTRAL_SCORE)),
    )
    excluded = F.col("_banned").isNotNull() | F.col("_outside")
    best = F.coalesce(F.nullif(top_details(F.col("_factors")), F.lit("")), F.lit("critères limités"))
    rows = rows.withColumn(
        "relevance",
        F.when(
            c.isNull(),
            F.struct(
                F.lit(100).alias("score"),
                F.lit(False).alias("excluded"),
                F.array().cast("array<struct<factor:string,weight:int,contribution:double,ok:boolean,detail:string>>").alias("factors"),
                F.lit("Pas de critère").alias("reason"),
            ),
        ).otherwise(
            F.struct(
                F.when(excluded, F.lit(0)).otherwise(F.col("_score")).alias("score"),
                excluded.alias("excluded"),
                F.when(excluded, F.array().cast("array<struct<factor:string,weight:int,contribution:double,ok:boolean,detail:string>>"))
                .otherwise(F.col("_factors"))
                .alias("factors"),
                F.when(
                    F.col("_banned").isNotNull(),
                    F.concat(F.lit("Exclue : contient « "), F.col("_banned"), F.lit(" ».")),
                )
                .when(F.col("_outside"), F.lit("Exclue : hors de la zone surveillée."))
                .otherwise(F.concat(F.lit("Pertinence "), F.col("_score").cast("string"), F.lit("/100 — "), best))
                .alias("reason"),
            )
        ),
    )
    return rows.drop("_haystack", "_banned", "_outside", "_factors", "_score")


def relevance(listings: DataFrame, searches: DataFrame) -> DataFrame:
    """Score every listing against the search that collected it (equi-join on ``search_id``)."""
    joined = listings.join(prepare_searches(searches), "search_id", "left")
    return score_relevance(joined).drop("_criteria")
