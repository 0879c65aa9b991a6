"""Freshness, price drops, change classes and republication as Column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from hearthmark.functions.numbers import half_up, number_text

# Decay constant in hours, drop threshold in percent,
# probable-match threshold and the bonus of a vanished twin.
FRESHNESS_HOURS = 72.0
PRICE_DROP_PCT = 3.0
PROBABLE_SCORE = 78
VANISHED_BONUS = 10


def freshness(changed_at: Column, now: Column) -> Column:
    hours = F.greatest(F.lit(0.0), (F.unix_micros(now.cast("timestamp")) - F.unix_micros(changed_at.cast("timestamp"))) / F.lit(3.6e9))
    return half_up(F.lit(100.0) * F.exp(-hours / F.lit(FRESHNESS_HOURS))).cast("int")


def price_drop(before: Column, after: Column, threshold_pct: float = PRICE_DROP_PCT) -> Column:
    """Struct of flag, absolute and relative change; no drop without two usable prices."""
    usable = F.coalesce(before > 0, F.lit(False)) & after.isNotNull()
    delta = F.when(usable, after - before).otherwise(F.lit(0.0))
    pct = F.when(usable, (after - before) / before * F.lit(100.0)).otherwise(F.lit(0.0))
    return F.struct(
        (pct <= -threshold_pct).alias("dropped"), delta.alias("delta_abs"), pct.alias("delta_pct")
    )


def change_kind(
    before: dict[str, Column], after: dict[str, Column], threshold_pct: float = PRICE_DROP_PCT
) -> Column:
    """Main change between two states; both sides name price, fingerprint, media_count, status."""

    def truthy_change(field: str) -> Column:
        return (before[field] != "") & (after[field] != "") & (before[field] != after[field])

    drop = price_drop(before["price"], after["price"], threshold_pct)
    return (
        F.when(truthy_change("status"), F.lit("status_change"))
        .when(drop["dropped"], F.lit("price_drop"))
        .when(after["price"] > before["price"], F.lit("price_rise"))
        .when(before["media_count"] != after["media_count"], F.lit("media_change"))
        .when(truthy_change("fingerprint"), F.lit("text_change"))
        .otherwise(F.lit("none"))
    )


def change_detail(kind: Column, before: dict[str, Column], after: dict[str, Column]) -> Column:
    """Readable detail of the change class."""
    # fixed values: the texts are part of the result
    delta = after["price"] - before["price"]
    pct = delta / before["price"] * F.lit(100.0)
    return (
        F.when(kind == "status_change", F.concat_ws(" → ", before["status"], after["status"]))
        .when(
            kind == "price_drop",
            F.concat(F.format_string("%.1f", pct), F.lit(" % ("), number_text(delta), F.lit(" €)")),
        )
        .when(kind == "price_rise", F.concat(F.lit("+"), half_up(delta).cast("string"), F.lit(" €")))
        .when(
            kind == "media_change",
            F.concat(F.concat_ws(" → ", before["media_count"].cast("string"), after["media_count"].cast("string")), F.lit(" photos")),
        )
        .when(kind == "text_change", F.lit("contenu modifié"))
        .otherwise(F.lit("aucun changement notable"))
    )


def republication(
    vanished: Column, other_id_differs: Column, score: Column, probable: int = PROBABLE_SCORE
) -> Column:
    """Struct of flag, confidence and reason for a recycled listing."""
    recycled = other_id_differs & (score >= probable)
    confidence = (
        F.when(~other_id_differs, F.lit(0))
        .when(score < probable, score)
        .otherwise(F.least(F.lit(100), score + F.when(vanished, F.lit(VANISHED_BONUS)).otherwise(F.lit(0))))
    )
    # fixed values: the texts are part of the result
    near = F.concat(F.lit("Annonce quasi identique ("), score.cast("string"), F.lit("/100) "))
    reason = (
        F.when(~other_id_differs, F.lit("Même identifiant source."))
        .when(score < probable, F.concat(F.lit("Similarité insuffisante ("), score.cast("string"), F.lit("/100).")))
        .when(vanished, F.concat(near, F.lit("republiée après disparition de la précédente.")))
        .otherwise(F.concat(near, F.lit("sous un autre identifiant.")))
    )
    return F.struct(recycled.alias("recycled"), confidence.cast("int").alias("confidence"), reason.alias("reason"))


def market_delta(per_m2: Column, median: Column) -> Column:
    """Percent above or below the market median; null when either is missing or zero."""
    pct = F.when((per_m2 != 0) & (median != 0), half_up((per_m2 - median) / median * F.lit(100.0)).cast("int"))
    return F.when(pct.isNotNull(), F.struct(pct.alias("pct"), (pct > 0).alias("over")))
