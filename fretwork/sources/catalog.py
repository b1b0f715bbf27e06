"""Synthetic catalogue: base items, then priced-up bundles of them up to the size asked for."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from fretwork.schemas import RAW

# What a bundle adds to its base item.
BUNDLE_FACTOR = "1.05"
BUNDLE_NAME = " Bundle"
BUNDLE_TEXT = " — includes accessories bundle"


# Base items up to this number are sent to every task; a larger base is joined by shuffle. Also the rows of one numbering band.
BAND_ROWS = 100_000


def numbered(base: DataFrame, n_base: int) -> DataFrame:
    """``base`` with ``_number`` from 1 in the order of ``position``.

    Quantiles cut the positions into bands of about ``BAND_ROWS`` rows, each numbered in its own task.
    """
    n_bands = -(-n_base // BAND_ROWS)
    cuts = base.approxQuantile("position", [i / n_bands for i in range(1, n_bands)], 0.1 / n_bands) if n_bands > 1 else []
    edges = F.array(*[F.lit(float(c)) for c in sorted(set(cuts))]).cast("array<double>")
    banded = base.withColumn("_band", F.size(F.filter(edges, lambda e: e < F.col("position"))))
    sizes = banded.groupBy("_band").agg(F.count(F.lit(1)).alias("_n"))
    before = F.coalesce(F.sum("_n").over(Window.orderBy("_band").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    inside = F.row_number().over(Window.partitionBy("_band").orderBy("position"))
    both = banded.withColumn("_inside", inside).join(sizes.select("_band", before.alias("_before")), "_band")
    return both.withColumn("_number", F.col("_inside") + F.col("_before")).drop("_band", "_inside", "_before")


def generate_catalog(base: DataFrame, n: int, brand_urls: DataFrame | None = None) -> DataFrame:
    """``n`` raw product rows.

    ``base``: position (unique whole number that gives the order), brand, model, category, subcategory,
    price, skill_level, use_case, description. Base items come first, numbered in order; then the same
    items again and again as bundles, until there are ``n`` rows. ``brand_urls``: brand, url.
    """
    n_base = base.count()
    items = numbered(base, n_base)
    if n_base <= BAND_ROWS:
        items = F.broadcast(items)
    ids = base.sparkSession.range(1, n + 1).select(
        F.col("id").alias("_id"), F.expr(f"(id - 1) div {n_base}").alias("_copy"), ((F.col("id") - 1) % n_base + 1).alias("_number")
    )
    rows = ids.join(items, "_number")
    if brand_urls is not None:
        rows = rows.join(brand_urls.select("brand", F.col("url").alias("_url")), "brand", "left")
    else:
        rows = rows.withColumn("_url", F.lit(None).cast("string"))
    bundle = F.col("_copy") > 0
    price = F.col("price").cast("decimal(10,2)")
    dearer = F.round(price * F.lit(BUNDLE_FACTOR).cast("decimal(3,2)"), 2).cast("decimal(10,2)")
    name = F.concat_ws(" ", "brand", "model")
    return rows.select(
        F.format_string("P%04d", "_id").alias("product_id"),
        F.when(bundle, F.concat(name, F.lit(BUNDLE_NAME))).otherwise(name).alias("name"),
        "brand",
        "category",
        "subcategory",
        F.when(bundle, dearer).otherwise(price).cast("string").alias("price"),
        F.when(bundle, F.concat("description", F.lit(BUNDLE_TEXT))).otherwise(F.col("description")).alias("description"),
        "skill_level",
        "use_case",
        F.lit("true").alias("in_stock"),
        F.coalesce("_url", F.lit("")).alias("manufacturer_url"),
    ).select(*RAW["products"].fieldNames())
