"""Market reference prices per area and property type."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from hearthmark.functions.listing import market_type, price_per_m2
from hearthmark.functions.numbers import half_up
from hearthmark.functions.scoring import market_delta
from hearthmark.functions.text import fold

# Smallest surface and the plausible range of prices per m2.
MIN_SURFACE, MIN_PPM, MAX_PPM = 5.0, 200.0, 50_000.0
QUANTILES = (("median", 0.5), ("p25", 0.25), ("p75", 0.75))

# Postcode ranges of cities split into districts and the area
# code of district zero.
DISTRICT_CITIES = ((75001, 75020, 75100), (69001, 69009, 69380), (13001, 13016, 13200))


def plausible(transactions: DataFrame) -> DataFrame:
    ppm = F.col("value") / F.col("surface")
    kept = transactions.where((F.col("value") > 0) & (F.col("surface") > MIN_SURFACE))
    return kept.withColumn("ppm", ppm).where(F.col("ppm").between(MIN_PPM, MAX_PPM))


def rank_quantiles(df: DataFrame, keys: list[str], rounded: str, wanted=QUANTILES) -> DataFrame:
    """Value at zero-based rank ``min(n - 1, floor(p * n))`` of whole-number values.

    The values are counted first, so a group shrinks to its distinct values
    before anything is sorted; a group of any size stays small.
    """
    counts = df.groupBy(*keys, rounded).agg(F.count(F.lit(1)).alias("_n"))
    group = Window.partitionBy(*keys)
    upto = group.orderBy(rounded).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    steps = counts.withColumn("_upto", F.sum("_n").over(upto)).withColumn("_total", F.sum("_n").over(group))

    def at(p: float) -> Column:
        rank = F.least(F.col("_total") - 1, F.floor(F.lit(p) * F.col("_total")))
        return F.min(F.when(F.col("_upto") > rank, F.col(rounded)))

    return steps.groupBy(*keys).agg(
        F.max("_total").alias("count"), *[at(p).alias(name) for name, p in wanted]
    )


def market_reference(transactions: DataFrame, keys: tuple[str, ...] = ("area", "type_local")) -> DataFrame:
    """Count and rounded rank quantiles of the price per m2.

    Rounding keeps order, so the quantile of the rounded prices is the rounded
    quantile; at most about 50,000 distinct values remain per group. A group
    without plausible sales has count 0.
    """
    groups = transactions.select(*keys).distinct()
    rounded = plausible(transactions).withColumn("_ppm", half_up(F.col("ppm")))
    stats = rank_quantiles(rounded, list(keys), "_ppm")
    return groups.join(stats, list(keys), "left").withColumn("count", F.coalesce("count", F.lit(0)))


def latest_year(transactions: DataFrame, area: str = "area", years: tuple[int, ...] = (2024, 2023, 2022)) -> DataFrame:
    """Only the most recent available year of each area."""
    offered = transactions.where(F.col("year").isin(*years))
    newest = offered.groupBy(area).agg(F.max("year").alias("year"))
    return offered.join(newest, [area, "year"], "left_semi")


def resolve_area(listings: DataFrame, communes: DataFrame) -> DataFrame:
    """Area code of a postcode: district arithmetic, else same name, else most inhabitants."""
    number = F.col("postal_code").try_cast("int")
    well_formed = F.col("postal_code").rlike(r"^\d{5}$")
    district = F.lit(None).cast("string")
    for low, high, base in DISTRICT_CITIES:
        first = low - 1
        district = F.when(number.between(low, high), (F.lit(base - first) + number).cast("string")).otherwise(district)
    wanted = listings.withColumns(
        {"_district": F.when(well_formed, district), "_city": fold(F.col("city"))}
    )
    # one row per postcode, and one per postcode and folded name; both are small aggregates
    ranked = communes.withColumn("_pop", F.coalesce("population", F.lit(0)))
    by_population = ranked.groupBy("postal_code").agg(F.max("_pop").alias("_pop"))
    biggest = (
        ranked.join(by_population, ["postal_code", "_pop"]).groupBy("postal_code").agg(F.min("code").alias("_biggest"))
    )
    named = ranked.groupBy("postal_code", fold(F.col("name")).alias("_city")).agg(F.min("code").alias("_named"))
    resolved = F.coalesce("_district", F.when(well_formed, F.coalesce("_named", "_biggest")))
    return (
        wanted.join(named, ["postal_code", "_city"], "left")
        .join(biggest, "postal_code", "left")
        .withColumn("area", resolved)
        .withColumn(
            "department",
            F.when(F.col("area").startswith("97"), F.substring("area", 1, 3)).otherwise(F.substring("area", 1, 2)),
        )
        .drop("_district", "_city", "_named", "_biggest")
    )


def compare_to_market(listings: DataFrame, reference: DataFrame, area: str = "area") -> DataFrame:
    """Listings with price per m2, market median of their area and type, and the gap in percent."""
    typed = listings.withColumns(
        {"type_local": market_type(F.col("property_type")), "per_m2": price_per_m2(F.col("price"), F.col("surface_m2"))}
    )
    gap = market_delta(F.col("per_m2"), F.col("median"))
    return (
        typed.join(reference.select(area, "type_local", "median"), [area, "type_local"], "left")
        .withColumn("_gap", gap)
        .withColumns({"pct": F.col("_gap")["pct"], "over": F.col("_gap")["over"]})
        .drop("_gap")
    )
