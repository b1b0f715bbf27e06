"""Staging views: rename and cast raw text columns."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from fretwork.functions.money import line_total


def stg_products(raw: DataFrame) -> DataFrame:
    return raw.select(
        "product_id",
        F.col("name").alias("product_name"),
        "brand",
        "category",
        "subcategory",
        F.col("price").cast("decimal(10,2)").alias("price"),
        "description",
        "skill_level",
        "use_case",
        F.col("in_stock").cast("boolean").alias("in_stock"),
        "manufacturer_url",
    )


def stg_customers(raw: DataFrame) -> DataFrame:
    return raw.select(
        "customer_id",
        "first_name",
        "last_name",
        F.concat("first_name", F.lit(" "), "last_name").alias("full_name"),
        "email",
        "skill_level",
        "primary_instrument",
        F.col("years_playing").cast("int").alias("years_playing"),
        "use_case",
        "budget_range",
        F.col("created_at").cast("date").alias("created_at"),
    )


def stg_orders(raw: DataFrame) -> DataFrame:
    quantity = F.col("quantity").cast("int")
    unit_price = F.col("unit_price").cast("decimal(10,2)")
    return raw.select(
        "order_id",
        "customer_id",
        "product_id",
        quantity.alias("quantity"),
        unit_price.alias("unit_price"),
        line_total(quantity, unit_price).alias("line_total"),
        F.col("order_date").cast("date").alias("order_date"),
        "status",
    )
