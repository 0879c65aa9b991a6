"""JSON feeds and URL lists."""

from __future__ import annotations

from collections.abc import Mapping
from itertools import product

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from hearthmark.functions import urls
from hearthmark.functions.listing import source_of_host
from hearthmark.functions.text import trim_blank
from hearthmark.operators.once import with_once


def _paths(dotted: str) -> list[str]:
    """JSON paths of a dotted path; a whole number is an array index or an object key."""
    choices = []
    for part in dotted.split("."):
        quoted = "['" + part.replace("\\", "\\\\").replace("'", "\\'") + "']"
        choices.append([f"[{int(part)}]", quoted] if part.isdigit() else [quoted])
    return ["$" + "".join(combination) for combination in product(*choices)]


def _step(node: Column, part: Column) -> Column:
    """Member of a variant under one part of a dotted path that is a column."""
    quoted = F.concat(F.lit("$['"), F.regexp_replace(part, r"(['\\\\])", r"\\\\$1"), F.lit("']"))
    index = F.when(part.rlike("^[0-9]+$"), F.try_variant_get(node, F.concat(F.lit("$["), part, F.lit("]")), "variant"))
    return F.coalesce(index, F.try_variant_get(node, quoted, "variant"))


def dotted_get(item: Column, dotted: str | Column) -> Column:
    """Variant found under a dotted path; SQL null when the path is missing. The path may differ by row."""
    if isinstance(dotted, Column):
        return F.when(dotted == "", item).otherwise(F.aggregate(F.split(dotted, r"\."), item, _step))
    if not dotted:
        return item
    return F.coalesce(*[F.try_variant_get(item, path, "variant") for path in _paths(dotted)])


def explode_items(df: DataFrame, payload: str, list_path: str | Column | None = None) -> DataFrame:
    """One row per item of a JSON payload with its position.

    An array gives one row per element, a single value one row, a missing or
    null node (and invalid JSON) none.
    """
    parsed = with_once(df, _payload=F.try_parse_json(F.col(payload)))
    rows = parsed.withColumn("_node", dotted_get(F.col("_payload"), "" if list_path is None else list_path))
    many = F.try_variant_get("_node", "$", "array<variant>")
    items = (
        F.when(F.col("_node").isNull() | F.is_variant_null("_node"), F.array().cast("array<variant>"))
        .when(F.schema_of_variant("_node").startswith("ARRAY"), many)
        .otherwise(F.array("_node"))
    )
    kept = [c for c in df.columns if c != payload]
    return rows.select(*kept, F.posexplode(items).alias("pos", "item"))


def map_fields(df: DataFrame, item: str = "item", field_map: Mapping[str, str] | Column | None = None) -> DataFrame:
    """Replace an item by a map of target field to value; missing paths leave no entry.

    The field map may be a map column; rows where it is null keep their own fields.
    """
    df = with_once(df, **{item: F.col(item)})
    own = F.when(F.schema_of_variant(item).startswith("OBJECT"), F.try_variant_get(item, "$", "map<string,variant>"))
    if isinstance(field_map, Column):
        mapped = F.map_filter(F.transform_values(field_map, lambda _, path: dotted_get(F.col(item), path)), lambda _, v: v.isNotNull())
        fields = F.when(field_map.isNotNull() & (F.cardinality(field_map) > 0), mapped).otherwise(own)
    elif field_map:
        names = F.array(*[F.lit(n) for n in field_map])
        values = F.array(*[dotted_get(F.col(item), path) for path in field_map.values()])
        fields = F.map_filter(F.map_from_arrays(names, values), lambda _, v: v.isNotNull())
    else:
        fields = own
    return with_once(df, fields=fields).drop(item)


def listings_from_urls(df: DataFrame, line: str) -> DataFrame:
    """Minimal listings of the lines that hold an http(s) URL."""
    rows = df.withColumn("url", trim_blank(F.col(line))).where(urls.is_http(F.col("url")))
    return rows.withColumns(
        {
            "source_id": source_of_host(F.coalesce(urls.host(F.col("url")), F.lit(""))),
            "external_id": F.coalesce(urls.external_id(F.col("url")), F.col("url")),
            "currency": F.lit("EUR"),
        }
    )
