"""Prices, tiers and stock labels."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

# Upper bounds (exclusive) of the price tiers, and the tier above all bounds.
TIER_BOUNDS = [(100, "budget"), (500, "entry"), (1500, "mid-range")]
TOP_TIER = "premium"

# Cents stand for prices in sort and lookup keys; a missing price sorts behind every real one.
NO_PRICE = (1 << 62) - 1


def price_tier(price: Column, bounds: Sequence[tuple[float, str]] = TIER_BOUNDS, top: str = TOP_TIER) -> Column:
    """Tier of a price; a NULL price falls through to the top tier."""
    (limit, name), *rest = bounds
    tier = F.when(price < F.lit(limit), F.lit(name))
    for limit, name in rest:
        tier = tier.when(price < F.lit(limit), F.lit(name))
    return tier.otherwise(F.lit(top))


def line_total(quantity: Column, unit_price: Column) -> Column:
    """Exact decimal product; sums of it do not depend on the order of the rows."""
    return (quantity * unit_price).cast("decimal(18,2)")


def money_text(price: Column) -> Column:
    """``1,234.50``; a missing price counts as zero."""
    return F.format_number(F.coalesce(price, F.lit(0)).cast("decimal(18,2)"), 2)


def stock_label(quantity: Column) -> Column:
    return (
        F.when(quantity.isNull() | (quantity == 0), F.lit("Out of Stock"))
        .when(quantity == 1, F.lit("Last One!"))
        .when(quantity < 10, F.format_string("Only %d left", quantity))
        .otherwise(F.format_string("%d in stock", quantity))
    )


def price_cents(price: Column) -> Column:
    """Sort key of a DECIMAL(_,2) price; NULL prices come last."""
    return F.coalesce((price * 100).cast("bigint"), F.lit(NO_PRICE))
