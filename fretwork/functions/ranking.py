"""Ranks and positions that do not gather a large group in one task."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def top_k(df: DataFrame, by: Sequence[str], order: Sequence[Column], k: int, rank: str = "rank") -> DataFrame:
    """First ``k`` rows per key.

    Spark puts a group limit in front of the shuffle, so each task sends at most ``k`` rows per key
    and a hot key stays small.
    """
    ranked = df.withColumn(rank, F.row_number().over(Window.partitionBy(*by).orderBy(*order)))
    return ranked.where(F.col(rank) <= k)


def first_per_key(df: DataFrame, keys: Sequence[str], order: Sequence[Column]) -> DataFrame:
    return top_k(df, keys, order, 1, "_first").drop("_first")


def running_total(
    df: DataFrame, keys: Sequence[str], position: str, weight: str, out: str, ties: Sequence[Column] = (), bits: int = 16
) -> DataFrame:
    """Running sum of ``weight`` per key in the order of the integer column ``position``.

    The order is cut into bands of ``2**bits`` positions. Each band is summed on its own and the sums of
    the bands before it are added, so no task holds more than one band of one key.
    """
    keys = list(keys)
    banded = df.withColumn("_band", F.shiftright(F.col(position), bits))
    inside = (
        Window.partitionBy(*keys, "_band")
        .orderBy(F.col(position), *ties)
        .rowsBetween(Window.unboundedPreceding, Window.currentRow)
    )
    before = Window.partitionBy(*keys).orderBy("_band").rowsBetween(Window.unboundedPreceding, -1)
    sums = banded.groupBy(*keys, "_band").agg(F.sum(weight).alias("_sum"))
    offsets = sums.select(*keys, "_band", F.coalesce(F.sum("_sum").over(before), F.lit(0)).alias("_before"))
    local = banded.withColumn("_inside", F.sum(weight).over(inside))
    return (
        local.join(offsets, [*keys, "_band"])
        .withColumn(out, F.col("_inside") + F.col("_before"))
        .drop("_band", "_inside", "_before")
    )
