"""What checkpoints and snapshots leave behind."""

import pandas as pd
from pyspark.sql import functions as F

from hearthmark.session import BATCH_ROWS, checkpointed, snapshot


def shuffle_files(spark):
    files = spark._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager().getAllFiles()
    return {files.apply(i).getName() for i in range(files.size()) if files.apply(i).getName().startswith("shuffle_")}


def test_kept_tables_leave_no_shuffle_files(spark):
    sums = spark.range(5000).groupBy((F.col("id") % 100).alias("key")).agg(F.sum("id").alias("total"))
    name = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
    before, given = shuffle_files(spark), spark.conf.get(name)
    kept = checkpointed(sums), snapshot(sums)
    assert not shuffle_files(spark) - before
    assert spark.conf.get(name) == given
    assert [x.count() for x in kept] == [100, 100]
    assert kept[0].exceptAll(kept[1]).isEmpty()


def test_snapshot_of_columns_that_files_cannot_hold(spark):
    rows = spark.range(3).withColumn("nothing", F.lit(None))
    assert [tuple(r) for r in snapshot(rows).orderBy("id").collect()] == [(0, None), (1, None), (2, None)]


def test_steps_hand_rows_to_python_in_small_batches(spark):
    sizes = F.pandas_udf(lambda ids: pd.Series(len(ids), index=ids.index), "long")
    rows = spark.range(0, 3 * BATCH_ROWS, 1, 1).select("id", sizes("id").alias("size"))
    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    before = spark.conf.get(key)
    for keep in (checkpointed, snapshot):
        assert [tuple(r) for r in keep(rows).agg(F.max("size"), F.count("id")).collect()] == [(BATCH_ROWS, 3 * BATCH_ROWS)]
    assert spark.conf.get(key) == before
