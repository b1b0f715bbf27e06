"""Keyed tables on plain Parquet: later versions of a row replace earlier ones.

Writers only append, so a repeated or lost task never harms rows already there, and an update costs as
much as its own size. Readers keep the latest version per key. ``rewrite`` folds a grown table into a
new folder from time to time.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from fretwork.functions.ranking import first_per_key


def latest(rows: DataFrame, keys: Sequence[str], version: Sequence[str]) -> DataFrame:
    """The row with the highest version per key (NULL versions lose)."""
    return first_per_key(rows, keys, [F.col(v).desc_nulls_last() for v in version])


def upsert(existing: DataFrame, updates: DataFrame, keys: Sequence[str], version: Sequence[str]) -> DataFrame:
    """Table content after ``updates``; at an equal version the update wins."""
    both = existing.withColumn("_side", F.lit(0)).unionByName(updates.withColumn("_side", F.lit(1)))
    return latest(both, keys, [*version, "_side"]).drop("_side")


def with_defaults(rows: DataFrame, schema: T.StructType, defaults: dict[str, Column]) -> DataFrame:
    """Rows in the declared column order; missing columns become NULL, NULLs take their default."""
    present = set(rows.columns)
    columns = []
    for field in schema:
        col = F.col(field.name) if field.name in present else F.lit(None)
        if field.name in defaults:
            col = F.coalesce(col, defaults[field.name])
        columns.append(col.cast(field.dataType).alias(field.name))
    return rows.select(*columns)


def create_if_absent(spark: SparkSession, path: str, schema: T.StructType) -> None:
    spark.createDataFrame([], schema).write.mode("ignore").parquet(path)


def append(rows: DataFrame, path: str) -> None:
    rows.write.mode("append").parquet(path)


def read(spark: SparkSession, path: str, schema: T.StructType, keys: Sequence[str], version: Sequence[str]) -> DataFrame:
    return latest(spark.read.schema(schema).parquet(path), keys, version)


def rewrite(
    spark: SparkSession, path: str, target: str, schema: T.StructType, keys: Sequence[str], version: Sequence[str]
) -> None:
    """Write the latest rows to a new folder; the caller then points its readers there."""
    read(spark, path, schema, keys, version).write.mode("errorifexists").parquet(target)
