"""Mart tables: products, customers, recommendations, inventory."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from fretwork.functions.jsonio import canonical_json
from fretwork.functions.money import price_tier
from fretwork.functions.ranking import first_per_key
from fretwork.session import materialize

# Products on one page of a customer's list, about.
PAGE_PRODUCTS = 10_000


def dim_products(products: DataFrame) -> DataFrame:
    """One row per (name, price), the lowest id wins; adds the price tier and the list of skill levels."""
    kept = first_per_key(products, ["product_name", "price"], [F.col("product_id").asc_nulls_last()])
    return kept.select(
        "product_id",
        "product_name",
        "brand",
        "category",
        "subcategory",
        "price",
        "description",
        "skill_level",
        "use_case",
        "in_stock",
        price_tier(F.col("price")).alias("price_tier"),
        F.split("skill_level", "\\-").alias("skill_levels_array"),
        "manufacturer_url",
    )


def order_items(orders: DataFrame) -> DataFrame:
    """Order lines summed per customer, order and product: what both customer tables are made from."""
    return orders.groupBy("customer_id", "order_id", "product_id").agg(
        F.sum("line_total").alias("total"), F.max("order_date").alias("last"), F.min("order_date").alias("first")
    )


def customer_products(orders: DataFrame) -> DataFrame:
    """Bridge table: the distinct products that each customer bought."""
    return orders.select("customer_id", "product_id").distinct()


def page_counts(bought: DataFrame, page_products: int = PAGE_PRODUCTS) -> DataFrame:
    """Pages over which a customer's products are dealt: customer_id, n_pages."""
    return bought.groupBy("customer_id").agg(F.ceil(F.count(F.lit(1)) / page_products).alias("n_pages"))


def product_pages(bought: DataFrame, page_products: int = PAGE_PRODUCTS) -> DataFrame:
    """The whole list of bought products per customer, in pages: customer_id, page_no, n_pages, product_ids (sorted).

    ``bought``: the bridge table. A customer with up to ``page_products`` products has all of them on page 0; a larger list
    (a reseller, a shared account) is dealt out over pages of about that size by a digest of the product id, so
    no row and no task holds it whole. A NULL product id stays a member of the list.
    """
    dealt = bought.join(page_counts(bought, page_products), "customer_id").withColumn("page_no", F.pmod(F.xxhash64("product_id"), F.col("n_pages")))
    pages = dealt.groupBy("customer_id", "page_no", "n_pages").agg(
        F.sort_array(F.collect_list(F.struct("product_id"))).alias("_products")
    )
    ids = F.transform("_products", lambda p: p["product_id"])
    return pages.select("customer_id", "page_no", "n_pages", ids.alias("product_ids"))


def customer_stats(items: DataFrame) -> DataFrame:
    """Order totals per customer, from ``order_items``.

    Grouping by order first replaces ``count(distinct)`` and spreads a customer with very many orders
    over all tasks; the second step only sees one row per order.
    """
    per_order = items.groupBy("customer_id", "order_id").agg(
        F.sum("total").alias("_total"), F.max("last").alias("_last"), F.min("first").alias("_first")
    )
    return per_order.groupBy("customer_id").agg(
        F.count("order_id").alias("total_orders"),
        F.sum("_total").alias("lifetime_value"),
        F.max("_last").alias("last_order_date"),
        F.min("_first").alias("first_order_date"),
    )


def dim_customers(customers: DataFrame, orders: DataFrame, page_products: int = PAGE_PRODUCTS) -> DataFrame:
    """Customers with order totals and the sorted list of bought products.

    Order lines are read once: their sums and the pages made from them are written in between.
    """
    items = materialize(order_items(orders), "order-items")
    pages = materialize(product_pages(customer_products(items), page_products), "product-pages")
    return customer_mart(customers, items, pages)


def customer_mart(customers: DataFrame, items: DataFrame, pages: DataFrame) -> DataFrame:
    """Customers with the totals of ``order_items`` and page 0 of ``product_pages``.

    Page 0 is the whole list for any ordinary customer; the further pages are rows of ``product_pages``, which the warehouse build
    writes as a mart of its own. A row says how many pages there are.
    """
    first = pages.where("page_no = 0").select("customer_id", "product_ids")
    return (
        customers.join(customer_stats(items), "customer_id", "left")
        .join(pages.select("customer_id", "n_pages").distinct(), "customer_id", "left")
        .join(first, "customer_id", "left")
        .select(
            "customer_id",
            "full_name",
            "email",
            "skill_level",
            "primary_instrument",
            "years_playing",
            "use_case",
            "budget_range",
            "created_at",
            F.coalesce("total_orders", F.lit(0)).alias("total_orders"),
            F.coalesce(F.col("lifetime_value").cast("double"), F.lit(0.0)).alias("lifetime_value"),
            "last_order_date",
            "first_order_date",
            F.coalesce("product_ids", F.array().cast("array<string>")).alias("purchased_product_ids"),
            F.coalesce("n_pages", F.lit(0)).alias("n_product_pages"),
        )
    )


def fct_recommendations(handoffs: DataFrame) -> DataFrame:
    return handoffs.select(
        "handoff_id",
        "session_id",
        canonical_json(F.col("customer_snapshot")).alias("customer_snapshot"),
        canonical_json(F.col("recommended_products")).alias("recommended_products"),
        "conversation_summary",
        "priority",
        F.col("created_at").cast("timestamp").alias("created_at"),
        "assigned_se",
    )


def inventory(raw: DataFrame) -> DataFrame:
    return raw.select("product_id", F.col("quantity").cast("int").alias("quantity"))
