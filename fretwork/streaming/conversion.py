"""Conversion as the events come in: recommendations against later orders, both as streams."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from fretwork.plans.analytics import PAIR
from fretwork.streaming.files import append_stream

ASK = [*PAIR, "created_at"]


def conversions(recommendations: DataFrame, orders: DataFrame, horizon: str, delay: str) -> DataFrame:
    """Orders of a recommended product within ``horizon`` after the recommendation, a row each; ``ordered_at`` is NULL where none came.

    ``recommendations``: customer_id, product_id, created_at; ``orders``: customer_id, product_id, order_date. Rows may be up to ``delay`` late.
    Repeated rows count once. A recommendation leaves the state when the watermark has passed its horizon, and gives its row without
    an order then; an order leaves it when no recommendation from before it can still come. Rows without a time take no part.
    """
    asked = recommendations.select(*ASK).where("created_at is not null").withWatermark("created_at", delay).dropDuplicates(ASK)
    bought = orders.select(*[F.col(c).alias(f"_{c}") for c in PAIR], F.col("order_date").cast("timestamp").alias("ordered_at"))
    bought = bought.where("ordered_at is not null").withWatermark("ordered_at", delay)
    bought = bought.dropDuplicates([*[f"_{c}" for c in PAIR], "ordered_at"])
    in_time = F.col("ordered_at").between(F.col("created_at"), after(F.col("created_at"), horizon))
    pair = (F.col("customer_id") == F.col("_customer_id")) & (F.col("product_id") == F.col("_product_id"))
    return asked.join(bought, pair & in_time, "left_outer").select(*ASK, "ordered_at")


def after(time: Column, interval: str) -> Column:
    return time + F.expr(f"interval {interval}")


def stream_conversions(recommendations: DataFrame, orders: DataFrame, horizon: str, delay: str, path: str, checkpoint: str) -> None:
    """Append conversions to a folder, each row exactly once. Read them with ``first_conversions``."""
    append_stream(conversions(recommendations, orders, horizon, delay), path, checkpoint)


def first_conversions(table: DataFrame) -> DataFrame:
    """Each recommendation that has converted or whose horizon has passed, with the day of the first order, or NULL."""
    return table.groupBy(*ASK).agg(F.to_date(F.min("ordered_at")).alias("converted_on"))


def settled_before(recommendations: DataFrame, orders: DataFrame, horizon: str, delay: str) -> DataFrame:
    """One row: up to which time recommendations are final, once a stream has seen these rows."""
    last_asked = recommendations.agg(F.max("created_at").alias("_a"))
    last_bought = orders.agg(F.max(F.col("order_date").cast("timestamp")).alias("_b"))
    ends = last_asked.unionByName(last_bought.select(F.col("_b").alias("_a"))).agg(F.min("_a").alias("_end"), F.count("_a").alias("_n"))
    # The slower of both streams counts; without rows in one of them nothing is final.
    return ends.select(F.when(F.col("_n") == 2, F.col("_end") - F.expr(f"interval {delay}") - F.expr(f"interval {horizon}")).alias("settled"))
