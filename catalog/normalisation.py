"""NORM, SRC: normalisation and feed queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from catalog.registry import fnv_sql, fold_sql, half_up_sql, number_text_sql, parse_number_sql, register, squash_sql
from hearthmark.functions import listing, numbers, text, urls
from hearthmark.operators.relevance import criteria_rows
from hearthmark.operators.runs import normalise_runs

register(
    "NORM-2",
    lambda t: t("number_texts").select("id", numbers.parse_number(F.col("text")).alias("number")),
    f"select id, {parse_number_sql('text')} as number from number_texts",
    "number_texts",
)

_PATTERNS_SQL = " ".join(
    f"when regexp_matches({fold_sql('text')}, '{pattern}') then '{name}'" for pattern, name in listing.PROPERTY_TYPES
)
register(
    "NORM-3",
    lambda t: t("type_texts").select("id", listing.property_type(F.col("text")).alias("property_type")),
    f"select id, case when text is null or text = '' then null {_PATTERNS_SQL} else 'autre' end as property_type from type_texts",
    "type_texts",
)

register(
    "NORM-5",
    lambda t: t("pages")
    .select("page_id", urls.host(F.col("url")).alias("host"))
    .withColumn("source_id", listing.source_of_host(F.col("host"))),
    """select page_id, host, case when contains(h, 'leboncoin') then 'leboncoin' when contains(h, 'seloger') then 'seloger'
              when contains(h, 'bienici') then 'bienici' when contains(h, 'pap.fr') then 'pap' else 'import_generique' end as source_id
       from (select page_id, host, regexp_replace(host, '^www\\.', '') as h
             from (select page_id, lower(regexp_extract(url, '^[a-zA-Z]+://([^/?#:]+)', 1)) as host from pages) a) b""",
)

register(
    "NORM-6",
    lambda t: t("documents").select("doc_id", text.squash(text.fold(F.col("text"))).alias("folded")),
    f"select doc_id, {squash_sql(fold_sql('text'))} as folded from documents",
)

_NUMBERS = ", ".join(f"coalesce({number_text_sql(c)}, '')" for c in ("price", "surface_m2", "rooms"))
register(
    "NORM-7",
    lambda t: t("listings").select(
        "id",
        listing.fingerprint(*[F.col(c) for c in ("price", "surface_m2", "rooms", "title", "description")]).alias("fingerprint"),
    ),
    f"""select id, {fnv_sql('line')} as fingerprint from (
          select id, concat_ws('|', {_NUMBERS}, {squash_sql(fold_sql('title'))}, {squash_sql(fold_sql('description'))}) as line
          from listings) l""",
    "listings",
)

register(
    "NORM-8",
    lambda t: t("listings").select("id", listing.market_type(F.col("property_type")).alias("type_local")),
    """select id, case when lower(property_type) like '%appart%' then 'Appartement'
                       when lower(property_type) like '%maison%' then 'Maison' end as type_local from listings""",
    "listings",
)
register(
    "NORM-9",
    lambda t: t("listings")
    .withColumn("per_m2", listing.price_per_m2(F.col("price"), F.col("surface_m2")))
    .select("id", F.round("per_m2", 6).alias("per_m2"), numbers.half_up(F.col("per_m2")).alias("shown")),
    f"""select id, round(per_m2, 6) as per_m2, cast({half_up_sql('per_m2')} as bigint) as shown
        from (select id, case when surface_m2 > 0 then price / surface_m2 end as per_m2 from listings) l""",
    "listings",
)
register(
    "NORM-10",
    lambda t: t("edges").select(
        "seq", listing.score_band(F.when(F.col("seq") % 10 != 3, F.col("score"))).alias("band")
    ),
    """select seq, case when seq % 10 = 3 then null when score >= 75 then 'high' when score >= 50 then 'mid' else 'low' end as band
       from edges""",
    "edges",
)
register(
    "NORM-11",
    lambda t: normalise_runs(t("run_rows")).withColumn("at", F.col("at").cast("string")),
    """select run_id, cast(coalesce(finished_at, started_at, created_at) as varchar) as "at",
              case when run_trigger = 'manual' then 'manual' else 'schedule' end as run_trigger,
              case when status in ('success', 'error') then status else 'partial' end as status,
              coalesce(added, 0) as added, coalesce(updated, 0) as updated, coalesce(warnings, 0) as warnings
       from run_rows""",
    "run_rows",
)

LIST_SQL = "list_filter(list_transform(string_split({0}, ','), lambda p: trim(p)), lambda p: p <> '')"
register(
    "NORM-12",
    lambda t: criteria_rows(t("searches")).select(
        "search_id",
        *[F.array_join(c, "|").alias(c) for c in ("property_types", "keywords_required", "keywords_excluded", "source_ids")],
        F.size("keywords_required").alias("n_required"),
    ),
    "select search_id, "
    + ", ".join(
        f"array_to_string({LIST_SQL.format(c)}, '|') as {c}"
        for c in ("property_types", "keywords_required", "keywords_excluded", "source_ids")
    )
    + f", cast(len({LIST_SQL.format('keywords_required')}) as integer) as n_required from searches",
    "searches",
)
