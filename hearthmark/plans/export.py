"""Full export of what one user may read: every table by its own rule, in one job and one layout."""

from __future__ import annotations

import json
from collections.abc import Iterator
from contextlib import contextmanager
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from hearthmark.operators import visibility

LAYOUT = 1
CONTENTS = "tables"
#: Spark's own default drops what is finer than milliseconds.
JSON = {"timestampFormat": "yyyy-MM-dd'T'HH:mm:ss.SSSSSSXXX", "timestampNTZFormat": "yyyy-MM-dd'T'HH:mm:ss.SSSSSS"}
WRITERS = "spark.sql.maxConcurrentOutputFileWriters"
#: Tables whose rows are public with their listing, and the column that names it.
PUBLIC_BY_LISTING = {"price_points": "listing_id", "edges": "a"}


def _of_listings(rows: DataFrame, column: str, listings: DataFrame, viewer: Column) -> DataFrame:
    """Rows of the viewer's own listings, for tables that do not name their user."""
    own = listings.where(F.col("user_id") == viewer).select(F.col("id").alias(column))
    return rows.join(own, column, "left_semi").select(rows.columns)


def _readable(name: str, rows: DataFrame, tables: dict[str, DataFrame], viewer: Column) -> DataFrame:
    searches, listings = tables["searches"], tables["listings"]
    if name == "searches":
        return visibility.visible_searches(rows, tables["shares"], viewer)
    if name == "listings":
        return visibility.visible_listings(rows, searches, tables["shares"], viewer)
    if name == "shares":
        return rows.where((F.col("owner_id") == viewer) | (F.col("shared_with") == viewer))
    if name in PUBLIC_BY_LISTING:
        return visibility.visible_via_listing(rows, PUBLIC_BY_LISTING[name], listings, searches, viewer)
    if "user_id" in rows.columns:
        return rows.where(F.col("user_id") == viewer)
    if "listing_id" in rows.columns:
        return _of_listings(rows, "listing_id", listings, viewer)
    raise ValueError(f"no rule says who may read the rows of {name}")


def readable_tables(tables: dict[str, DataFrame], viewer: Column) -> dict[str, DataFrame]:
    """The rows of every table that the viewer may read, with all columns.

    ``searches``, ``listings`` and ``shares`` have to be among the tables.
    Searches and listings are readable if owned, shared or public, price points
    and edges if owned or under a public search, shares by both sides, all else
    by its user or by the user of its listing.
    """
    if CONTENTS in tables:
        raise ValueError(f"the name {CONTENTS} is that of the list of tables")
    return {name: _readable(name, rows, tables, viewer).select(rows.columns) for name, rows in tables.items()}


@contextmanager
def _open_files(spark: SparkSession, most: int) -> Iterator[None]:
    """Let a task keep a file open per table: Spark would otherwise sort all rows of a task by their folder first."""
    before = spark.conf.get(WRITERS)
    spark.conf.set(WRITERS, most)
    try:
        yield
    finally:
        spark.conf.set(WRITERS, before)


def export_tenant(tables: dict[str, DataFrame], viewer: Column, path: str) -> None:
    """Write what the viewer may read as JSON lines below ``path/v=1/table=<name>``.

    One write job covers all tables, so the export is whole once its commit is
    there.  Null values are written, times keep their microseconds.  A further
    table ``tables`` names every exported table, also one without readable
    rows, with its schema.
    """
    options, spark = {**JSON, "ignoreNullFields": "false"}, tables["listings"].sparkSession
    contents = spark.createDataFrame([(n, df.schema.json()) for n, df in tables.items()], "name string, columns string")
    lines = [
        rows.select(F.to_json(F.struct(*rows.columns), options).alias("value"), F.lit(LAYOUT).alias("v"), F.lit(name).alias("table"))
        for name, rows in {**readable_tables(tables, viewer), CONTENTS: contents}.items()
    ]
    with _open_files(spark, max(len(lines), int(spark.conf.get(WRITERS)))):
        reduce(DataFrame.unionByName, lines).write.mode("overwrite").partitionBy("v", "table").text(path)


def read_export(spark: SparkSession, path: str) -> dict[str, DataFrame]:
    """All tables of an export with the columns that they had."""
    lines = spark.read.schema("value string, v int, table string").text(path).where(F.col("v") == LAYOUT)

    def table(name: str, schema: T.StructType | str) -> DataFrame:
        return lines.where(F.col("table") == name).select(F.from_json("value", schema, JSON).alias("row")).select("row.*")

    contents = table(CONTENTS, "name string, columns string").collect()  # one row per table
    return {r.name: table(r.name, T.StructType.fromJson(json.loads(r.columns))) for r in contents}
