"""Session defaults and durable checkpoints."""

from __future__ import annotations

import tempfile
import uuid
import zipfile
from collections.abc import Iterator
from contextlib import contextmanager
from pathlib import Path

from pyspark import SparkContext
from pyspark.sql import DataFrame, SparkSession

_SHIPPED: set[str] = set()


def ship_package(spark: SparkSession) -> None:
    """Let the executors import this package wherever they start; once per application.

    The archive is a file of the driver that Spark's own file service hands out.
    """
    context = spark.sparkContext
    if context.applicationId in _SHIPPED:
        return
    root = Path(__file__).resolve().parent
    archive = Path(tempfile.mkdtemp(prefix="hearthmark-package-")) / "hearthmark_package.zip"
    with zipfile.ZipFile(archive, "w") as out:
        for source in sorted(root.rglob("*.py")):
            out.write(source, source.relative_to(root.parent))
    context.addPyFile(str(archive))
    _SHIPPED.add(context.applicationId)


def local_session(cores: int | str = 8, name: str = "hearthmark", **conf: str) -> SparkSession:
    """A session for tests and single-machine runs; clusters bring their own."""
    builder = (
        SparkSession.builder.master(f"local[{cores}]")
        .appName(name)
        .config("spark.sql.shuffle.partitions", "8")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.driver.memory", "12g")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.sql.adaptive.enabled", "true")
    )
    for key, value in conf.items():
        builder = builder.config(key, value)
    spark = builder.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    return spark


def _shared_context(df: DataFrame) -> SparkContext:
    """The context with a checkpoint folder that every executor can reach.

    The folder comes from ``spark.checkpoint.dir``; only a local session that
    names none falls back to a temporary folder of this machine.
    """
    context = df.sparkSession.sparkContext
    if context.getCheckpointDir() is None:
        shared = df.sparkSession.conf.get("spark.checkpoint.dir", None)
        if shared is None and not context.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder every executor can reach")
        context.setCheckpointDir(shared or tempfile.mkdtemp(prefix="hearthmark-checkpoint-"))
    return context


#: With this setting Spark deletes the shuffle files of an action when it ends, not when the driver collects garbage.
_CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"

#: Rows that Spark hands to a Python worker at once, at most; with texts and their trigrams its default takes hundreds of MB a worker.
BATCH_ROWS = 1_000
_BATCH = "spark.sql.execution.arrow.maxRecordsPerBatch"


@contextmanager
def _set(spark: SparkSession, key: str, value: str) -> Iterator[None]:
    before = spark.conf.get(key, None)
    spark.conf.set(key, value)
    try:
        yield
    finally:
        if before is None:
            spark.conf.unset(key)
        else:
            spark.conf.set(key, before)


@contextmanager
def shuffles_freed(spark: SparkSession) -> Iterator[None]:
    """Actions on tables made inside leave no shuffle files, so that a job of many steps holds those of one step.

    They hand rows to Python in small batches, so that the memory of a worker does not follow the size of a scan split.
    """
    rows = int(spark.conf.get(_BATCH))
    with _set(spark, _CLEANUP, "true"), _set(spark, _BATCH, str(min(rows, BATCH_ROWS) if rows > 0 else BATCH_ROWS)):
        yield


def checkpointed(df: DataFrame) -> DataFrame:
    """Cut the lineage through the shared checkpoint folder."""
    _shared_context(df)
    with shuffles_freed(df.sparkSession):
        # planned anew, as the setting counts when a table is made
        return df.select("*").checkpoint(eager=True)


def snapshot(df: DataFrame) -> DataFrame:
    """Like :func:`checkpointed` for rows with texts: compressed, and filters of later reads reach the files."""
    context = _shared_context(df)
    if any(kind in df.schema.simpleString() for kind in ("void", "interval")):
        return checkpointed(df)  # Parquet has no such columns
    folder = f"{context.getCheckpointDir()}/{uuid.uuid4()}"
    with shuffles_freed(df.sparkSession):
        df.write.option("compression", "zstd").parquet(folder)
    return df.sparkSession.read.schema(df.schema).parquet(folder)
