"""Open price-transaction files (CSV with a header)."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

# Column names of the public transaction files.
VALUE, SURFACE, TYPE, AREA = "valeur_fonciere", "surface_reelle_bati", "type_local", "code_commune"


def read_transactions(spark: SparkSession, path: str, year_from: str | None = None) -> DataFrame:
    """Typed transactions; rows whose width differs from the header are dropped.

    Column pruning is off for this reader, otherwise rows of the wrong width
    would pass when only some columns are read.
    """
    reader = spark.read.option("columnPruning", "false")
    raw = reader.csv(path, header=True, quote='"', escape='"', mode="DROPMALFORMED")
    typed = raw.select(
        F.col(AREA).alias("area"),
        F.col(TYPE).alias("type_local"),
        F.col(VALUE).try_cast("double").alias("value"),
        F.col(SURFACE).try_cast("double").alias("surface"),
        *([F.col(year_from).cast("int").alias("year")] if year_from else []),
    )
    return typed
