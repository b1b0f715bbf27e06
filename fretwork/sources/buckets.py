"""Keyed table in buckets: a sorted base with one row per key, and a short log of what came since.

The base lies in folders, one per bucket of the key's hash; a manifest names the folder of each bucket. An update is appended to the
log and costs as much as its own size. ``compact`` merges the log into the buckets that it touches, writes those to new folders and
publishes a new manifest; all other buckets keep their files. The manifest also names the parts of the log that it holds. Nothing that a
reader may look at is ever changed, so a compaction that is lost anywhere leaves the table as it was, and may simply be run again.

A read streams the base past the log: the keys of a log of proven size are broadcast, and the base is not shuffled. A log that
has grown beyond ``LOG_ROWS`` is joined as Spark sees fit, with the same result; compact it. The highest version of a key counts (NULL
loses); at an equal version what was appended later wins. NULL is a key like any other.
"""

from __future__ import annotations

import uuid
from collections.abc import Sequence
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from fretwork.sources.keyed import latest
from fretwork.sources.pointers import files_of, names_in, point_to, pointers, remove

LOG_ROWS = 100_000
MANIFEST = "bucket int, folder string, merged array<string>"


@dataclass(frozen=True)
class BucketTable:
    """``keys`` and ``version`` name columns of ``schema``; ``buckets`` must stay the same for the life of the table."""

    spark: SparkSession
    path: str
    schema: T.StructType
    keys: Sequence[str]
    version: Sequence[str]
    buckets: int = 64

    def bucket(self) -> Column:
        return F.pmod(F.xxhash64(*self.keys), F.lit(self.buckets)).cast("int")

    def manifest(self) -> tuple[dict[int, str], set[str]]:
        """The folder of each bucket that has rows, and the parts of the log that they hold."""
        current = pointers(self.spark, f"{self.path}/published")
        if not current:
            return {}, set()
        rows = self.spark.read.schema(MANIFEST).parquet(f"{self.path}/manifests/{current[-1][1]}").collect()
        merged = {part for r in rows for part in r["merged"] or []}
        return {r["bucket"]: r["folder"] for r in rows if r["bucket"] is not None}, merged

    def append(self, rows: DataFrame) -> None:
        """Add rows to the log. They are written aside and appear by one rename, under a number that tells their order."""
        earlier = names_in(self.spark, f"{self.path}/log")
        number = int(earlier[-1].split("-")[0]) + 1 if earlier else 1
        name = f"{number:08d}-{uuid.uuid4().hex}"
        rows.select(*self.schema.names).write.option("compression", "zstd").parquet(f"{self.path}/log/_{name}")
        draft, files = files_of(self.spark, f"{self.path}/log/_{name}")
        if not files.rename(draft, files_of(self.spark, f"{self.path}/log/{name}")[0]):
            raise OSError(f"could not add {name} to the log of {self.path}")

    def last_appended(self) -> DataFrame:
        """The rows of the last ``append``, as they stand in the log."""
        return self.spark.read.schema(self.schema).parquet(f"{self.path}/log/{names_in(self.spark, f'{self.path}/log')[-1]}")

    def _base(self, folders: dict[int, str]) -> DataFrame:
        paths = [f"{self.path}/base/{folder}/bucket={b}" for b, folder in sorted(folders.items())]
        return self.spark.read.schema(self.schema).parquet(*paths) if paths else self.spark.createDataFrame([], self.schema)

    def _log(self, parts: Sequence[str]) -> DataFrame:
        if not parts:
            return self.spark.createDataFrame([], self.schema)
        rows = self.spark.read.schema(self.schema).parquet(*[f"{self.path}/log/{p}" for p in sorted(parts)])
        part = F.regexp_extract("_metadata.file_path", "/log/(\\d+)-", 1)
        return latest(rows.withColumn("_part", part), self.keys, [*self.version, "_part"]).drop("_part")

    def _open_parts(self, merged: set[str]) -> list[str]:
        return [p for p in names_in(self.spark, f"{self.path}/log") if p not in merged]

    def _same_key(self, left: DataFrame, right: DataFrame) -> Column:
        return reduce(lambda a, b: a & b, [left[k].eqNullSafe(right[k]) for k in self.keys])

    def read(self, among: DataFrame | None = None) -> DataFrame:
        """The newest row of every key; with ``among`` (the key columns) only of those keys, from their buckets alone."""
        folders, merged = self.manifest()
        parts = self._open_parts(merged)
        log = self._log(parts)
        if among is not None:
            wanted = {r["bucket"] for r in among.select(self.bucket().alias("bucket")).distinct().collect()}
            folders = {b: f for b, f in folders.items() if b in wanted}
            log = log.join(among, self._same_key(log, among), "left_semi")
        base = self._base(folders)
        if among is not None:
            base = base.join(among, self._same_key(base, among), "left_semi")
        if not parts:
            return base
        short = sum(self.spark.read.parquet(f"{self.path}/log/{p}").count() for p in parts) <= LOG_ROWS
        hint = F.broadcast if short else lambda rows: rows
        newer = log.select(F.struct(*self.keys).alias("_key"), F.struct(*[F.col(v).isNotNull() for v in self.version], *self.version).alias("_new"))
        own = F.struct(*[F.col(v).isNotNull() for v in self.version], *self.version)
        # Base rows that the log does not replace, and log rows that no base row outlives: the first is a pass over the base,
        # the second needs of the base only the few keys that hold against the log.
        paired = base.join(hint(newer), F.struct(*self.keys).eqNullSafe(F.col("_key")), "left")
        stays = F.col("_key").isNull() | (own > F.col("_new"))
        old = paired.where(stays).select(*self.schema.names)
        outlived = paired.where(F.col("_key").isNotNull() & stays).select(*self.keys)
        return old.unionByName(log.join(hint(outlived), self._same_key(log, outlived), "left_anti"))

    def compact(self) -> list[int]:
        """Merge the log into the buckets it touches; returns their numbers."""
        folders, merged = self.manifest()
        parts = self._open_parts(merged)
        if not parts:
            return []
        log = self._log(parts).withColumn("_side", F.lit(1))
        touched = sorted(r["bucket"] for r in log.select(self.bucket().alias("bucket")).distinct().collect())
        base = self._base({b: folders[b] for b in touched if b in folders}).withColumn("_side", F.lit(0))
        name = uuid.uuid4().hex
        rows = latest(base.unionByName(log), self.keys, [*self.version, "_side"]).drop("_side").withColumn("bucket", self.bucket())
        rows.repartition(max(1, len(touched)), "bucket").sortWithinPartitions("bucket", *self.keys).write.option("compression", "zstd").partitionBy("bucket").parquet(f"{self.path}/base/{name}")
        self._publish({**folders, **dict.fromkeys(touched, name)}, merged | {*parts})
        return touched

    def _publish(self, folders: dict[int, str], merged: set[str]) -> None:
        still = merged & {*names_in(self.spark, f"{self.path}/log")}
        rows = [(None, None, sorted(still)), *((b, f, None) for b, f in sorted(folders.items()))]
        name = uuid.uuid4().hex
        self.spark.createDataFrame(rows, MANIFEST).coalesce(1).write.parquet(f"{self.path}/manifests/{name}")
        point_to(self.spark, f"{self.path}/published", name)

    def clean(self) -> list[str]:
        """Remove merged parts of the log and folders that the current manifest does not name; returns their paths.

        Run it when no reader holds an older manifest and no compaction is under way.
        """
        folders, merged = self.manifest()
        if not pointers(self.spark, f"{self.path}/published"):
            return []
        used = {f"{self.path}/base/{f}/bucket={b}" for b, f in folders.items()}
        old = [f"{self.path}/base/{f}/{b}" for f in names_in(self.spark, f"{self.path}/base") for b in names_in(self.spark, f"{self.path}/base/{f}")]
        gone = [p for p in old if p not in used] + [f"{self.path}/log/{p}" for p in names_in(self.spark, f"{self.path}/log") if p in merged]
        for path in gone:
            remove(self.spark, path)
        return gone
