"""State tables: scoped scans and shared folders."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession


def scan_for_batch(listings: DataFrame, incoming: DataFrame, tenant: str | Sequence[str] = "user_id", source: str = "source_id") -> DataFrame:
    """Stored listings of the tenants and sources that occur in a batch."""
    scope = [*([tenant] if isinstance(tenant, str) else tenant), source]
    return listings.join(incoming.select(*scope).distinct(), scope, "left_semi")


def shared_folder(spark: SparkSession) -> str:
    """Folder every executor can reach, a machine-local one only for local sessions."""
    base = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if base is None:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder every executor can reach")
        base = tempfile.mkdtemp(prefix="hearthmark-")
    return f"{base}/{uuid.uuid4()}"
