"""Questions across marts: unowned recommendations, conversion."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

PAIR = ["customer_id", "product_id"]


def not_owned(recommendations: DataFrame, owned: DataFrame) -> DataFrame:
    """Recommendations (customer_id, product_id, ...) of products that the customer has not bought."""
    return recommendations.join(owned.select(*PAIR).distinct(), PAIR, "left_anti")


def conversion(recommendations: DataFrame, orders: DataFrame) -> DataFrame:
    """Recommendations with the date of the customer's first order of that product from then on, or NULL.

    ``recommendations``: customer_id, product_id, created_at. Both sides are reduced to distinct days per
    customer and product first. A window over these days then finds the next order, so no pairs are formed
    and a group never exceeds the days of the calendar.
    """
    created_on = F.to_date("created_at")
    starts_at_midnight = F.col("created_at") == created_on.cast("timestamp")
    asked = recommendations.withColumn("_from", F.when(starts_at_midnight, created_on).otherwise(F.date_add(created_on, 1)))
    none = F.lit(None).cast("date")
    asks = asked.select(*PAIR, F.col("_from").alias("_day"), none.alias("_ordered")).distinct()
    buys = orders.select(*PAIR, F.col("order_date").alias("_day"), F.col("order_date").alias("_ordered")).distinct()
    from_here = Window.partitionBy(*PAIR).orderBy("_day").rangeBetween(Window.currentRow, Window.unboundedFollowing)
    next_order = asks.unionByName(buys).withColumn("converted_on", F.min("_ordered").over(from_here))
    answers = next_order.where(F.col("_ordered").isNull()).select(*PAIR, F.col("_day").alias("_from"), "converted_on")
    return asked.join(answers, [*PAIR, "_from"], "left").drop("_from")
