"""State tables that a batch changes in part: buckets, deltas and a manifest that is written last.

A keyed table is cut into buckets by a hash of its scope (what a batch looks
up together, such as tenant and source) and of its key.  A commit writes the
new rows of the buckets that it touches, nothing else; a bucket with many
deltas is rewritten as one.  A table of facts only grows; its batches are
joined in powers of ``MERGE``, so that a reader opens few folders.  A state is
what its manifest lists: one small file for all tables, written after their
data, so a reader sees all of a batch or nothing, and a batch that is run again
finds itself committed or writes the same folders again.
"""

from __future__ import annotations

import json
from collections.abc import Iterable, Mapping
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from hearthmark.session import shuffles_freed

#: Batches of facts that are joined into one.
MERGE = 8


@dataclass(frozen=True)
class Keyed:
    """A table with one row per key; rows are looked up by their scope, if there is one."""

    key: tuple[str, ...]
    scope: tuple[str, ...] = ()
    buckets: int = 64
    #: Parts of the rows of one scope, so that a large scope is spread.
    parts: int = 4
    most_deltas: int = 8

    def home(self) -> Column:
        return F.pmod(F.xxhash64(*(self.scope or self.key)), F.lit(self.buckets)).cast("int")

    def bucket(self) -> Column:
        part = F.pmod(F.xxhash64(*[F.col(c).cast("string") for c in self.key]), F.lit(self.parts)).cast("int")
        return self.home() * self.parts + part


class Facts:
    """A table that only grows."""


class Store:
    """Tables below a shared folder, by version."""

    def __init__(self, spark: SparkSession, folder: str, tables: Mapping[str, Keyed | Facts]) -> None:
        self.spark, self.folder, self.tables = spark, folder, dict(tables)

    # ---- manifests ------------------------------------------------------------------

    def _files(self, pattern: str) -> list[str]:
        path = self.spark._jvm.org.apache.hadoop.fs.Path(f"{self.folder}/{pattern}")
        found = path.getFileSystem(self.spark._jsc.hadoopConfiguration()).globStatus(path)
        return [str(f.getPath()) for f in found] if found else []

    def versions(self) -> list[int]:
        """Committed versions in rising order."""
        return sorted(int(p.split("/version=")[1].split("/")[0]) for p in self._files("manifest/version=*/_SUCCESS"))

    def latest(self) -> int | None:
        return max(self.versions(), default=None)

    def manifest(self, version: int | None = None) -> dict:
        version = self.latest() if version is None else version
        return json.loads(self.spark.read.text(f"{self.folder}/manifest/version={version}", wholetext=True).first()[0])

    # ---- reading --------------------------------------------------------------------

    def read(self, name: str, version: int | None = None, like: DataFrame | None = None) -> DataFrame:
        """A table as of a version; with ``like``, the rows that share a scope with a row of it."""
        table, entry = self.tables[name], self.manifest(version)[name]
        if isinstance(table, Facts):
            return self._files_of(name, entry, [f"_v={v}/_c={c}" for v, c, _ in entry["runs"]])
        held = {int(b): runs for b, runs in entry["buckets"].items()}
        if like is not None:
            asked = like.select(table.home().alias("home")).distinct()
            homes = {r["home"] for r in asked.collect()}  # at most one row per bucket
            held = {b: runs for b, runs in held.items() if b // table.parts in homes}
        rows = self._merged(name, entry, held)
        if like is None:
            return rows
        # buckets hold other scopes too
        return rows.join(like.select(*table.scope).distinct(), list(table.scope), "left_semi").select(*rows.columns)

    def _files_of(self, name: str, entry: dict, parts: Iterable[str]) -> DataFrame:
        schema, paths = T.StructType.fromJson(entry["schema"]), [f"{self.folder}/{name}/{p}" for p in parts]
        if not paths:
            return self.spark.createDataFrame([], schema)
        return self.spark.read.schema(schema).option("basePath", f"{self.folder}/{name}").parquet(*paths).select(*schema.names)

    def _merged(self, name: str, entry: dict, held: Mapping[int, list]) -> DataFrame:
        """Whole buckets as they are, and of buckets with deltas the newest row per key."""
        table, schema = self.tables[name], T.StructType.fromJson(entry["schema"])
        whole = [f"_v={runs[0][0]}/_c={runs[0][1]}/_bucket={b}" for b, runs in held.items() if len(runs) == 1]
        changed = [f"{self.folder}/{name}/_v={v}/_c={c}/_bucket={b}" for b, runs in held.items() if len(runs) > 1 for v, c in runs]
        rows = self._files_of(name, entry, whole)
        if not changed:
            return rows
        deltas = self.spark.read.schema(schema).option("basePath", f"{self.folder}/{name}").parquet(*changed)
        rest = [c for c in schema.names if c not in table.key]
        newest = deltas.groupBy(*table.key).agg(F.max_by(F.struct(*rest), F.struct("_v", "_c")).alias("_row"))
        return rows.unionByName(newest.select(*table.key, "_row.*").select(*schema.names))

    # ---- writing --------------------------------------------------------------------

    def commit(self, version: int, changes: Mapping[str, DataFrame]) -> None:
        """Add the rows of a batch to the tables: new or newer rows of keyed tables, facts.

        The manifest is the last thing written.  A version that is committed already is left alone.
        """
        done = self.versions()
        if version in done:
            return
        before = max((v for v in done if v < version), default=None)
        state = self.manifest(before) if before is not None else {}
        after = {}
        for name, table in self.tables.items():
            entry = state.get(name) or {"schema": json.loads(changes[name].schema.json()), "buckets": {}, "runs": []}
            after[name] = entry
            if name in changes:
                schema = self._widened(T.StructType.fromJson(entry["schema"]), changes[name].schema)
                rows = self._shaped(changes[name], schema)
                add = self._add_facts if isinstance(table, Facts) else self._add_rows
                after[name] = add(name, entry | {"schema": json.loads(schema.json())}, rows, version)
        one = self.spark.createDataFrame([(json.dumps(after),)], "value string").coalesce(1)
        one.write.mode("overwrite").text(f"{self.folder}/manifest/version={version}")

    @staticmethod
    def _widened(schema: T.StructType, new: T.StructType) -> T.StructType:
        """A column that a batch brings along is absent in the rows before."""
        every = [*schema, *[f for f in new if f.name not in schema.names]]
        return T.StructType([T.StructField(f.name, f.dataType, True) for f in every])

    @staticmethod
    def _shaped(rows: DataFrame, schema: T.StructType) -> DataFrame:
        return rows.select(*[(F.col(f.name) if f.name in rows.columns else F.lit(None)).cast(f.dataType).alias(f.name) for f in schema])

    def _write(self, rows: DataFrame, name: str, version: int, compacted: int, *by: str) -> str:
        path = f"{self.folder}/{name}/_v={version}/_c={compacted}"
        with shuffles_freed(self.spark):
            rows.write.mode("overwrite").partitionBy(*by).parquet(path) if by else rows.write.mode("overwrite").parquet(path)
        return path

    def _add_rows(self, name: str, entry: dict, rows: DataFrame, version: int) -> dict:
        table = self.tables[name]
        self._write(rows.withColumn("_bucket", table.bucket()).repartition("_bucket"), name, version, 0, "_bucket")
        buckets = {b: list(runs) for b, runs in entry["buckets"].items()}
        for b in self._buckets(name, version, 0):
            buckets.setdefault(b, []).append([version, 0])
        full = {int(b): runs for b, runs in buckets.items() if len(runs) > table.most_deltas}
        if full:
            merged = self._merged(name, entry, full).withColumn("_bucket", table.bucket())
            self._write(merged.repartition("_bucket"), name, version, 1, "_bucket")
            buckets |= {b: [[version, 1]] for b in self._buckets(name, version, 1)}
        return entry | {"buckets": buckets}

    def _buckets(self, name: str, version: int, compacted: int) -> list[str]:
        return [p.rsplit("_bucket=", 1)[1] for p in self._files(f"{name}/_v={version}/_c={compacted}/_bucket=*")]

    def _add_facts(self, name: str, entry: dict, rows: DataFrame, version: int) -> dict:
        self._write(rows, name, version, 0)
        runs = [*entry["runs"], [version, 0, 0]]
        step = 0
        while len(runs) >= MERGE and len({level for *_, level in runs[-MERGE:]}) == 1:
            step += 1
            level = runs[-1][2] + 1
            merged = self._files_of(name, entry, [f"_v={v}/_c={c}" for v, c, _ in runs[-MERGE:]])
            self._write(merged, name, version, step)
            runs = [*runs[:-MERGE], [version, step, level]]
        return entry | {"runs": runs}
