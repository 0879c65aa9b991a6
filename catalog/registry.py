"""Collects the registered queries and their oracle SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from catalog.views import load, with_views

Query = Callable[[SparkSession, str], DataFrame]

QUERIES: dict[str, Query] = {}
ORACLES: dict[str, str] = {}


def register(key: str, build: Callable[[Callable[[str], DataFrame]], DataFrame], sql: str | None = None, *views: str) -> None:
    """``build`` gets a loader of tables and views by name; ``sql`` sees the named views."""

    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        return build(lambda name: load(spark, sf_dir, name))

    QUERIES[key] = run
    if sql is not None:
        ORACLES[key] = with_views(sql, *views)


# ---- SQL fragments for the oracles -------------------------------------------------

def fold_sql(x: str) -> str:
    return f"lower(strip_accents({x}))"


def squash_sql(x: str) -> str:
    return f"trim(regexp_replace({x}, '[\\s\\x{{00A0}}]+', ' ', 'g'))"


def half_up_sql(x: str) -> str:
    return f"floor(({x}) + 0.5)"


def one_decimal_sql(x: str) -> str:
    return f"(floor(({x}) * 10 + 0.5) / 10)"


def parse_number_sql(x: str) -> str:
    kept = f"regexp_replace({x}, '[^0-9.,-]', '', 'g')"
    comma = f"(case when contains({kept}, ',') then length({kept}) - strpos(reverse({kept}), ',') + 1 else 0 end)"
    dot = f"(case when contains({kept}, '.') then length({kept}) - strpos(reverse({kept}), '.') + 1 else 0 end)"
    french = f"regexp_replace(replace({kept}, '.', ''), ',', '.')"
    english = f"replace({kept}, ',', '')"
    return f"try_cast(case when {comma} > {dot} then {french} else {english} end as double)"


def number_text_sql(x: str) -> str:
    return f"(case when {x} = floor({x}) then cast(cast({x} as bigint) as varchar) else cast({x} as varchar) end)"


def fnv_sql(x: str) -> str:
    """FNV-1a of a text of characters below U+10000."""
    return (
        f"printf('%08x', list_reduce(list_prepend(2166136261::bigint, list_transform(string_split({x}, ''), "
        "lambda c: cast(unicode(c) as bigint))), lambda h, c: (xor(h, c) * 16777619) & 4294967295))"
    )


def haversine_sql(lat1: str, lng1: str, lat2: str, lng2: str) -> str:
    return (
        f"(2 * 6371000.0::double * asin(least(1.0::double, sqrt(pow(sin(radians({lat2} - {lat1}) / 2), 2) "
        f"+ pow(sin(radians({lng2} - {lng1}) / 2), 2) * cos(radians({lat1})) * cos(radians({lat2}))))))"
    )
