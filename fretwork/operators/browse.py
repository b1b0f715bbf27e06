"""Browsing by category, product cards by id, product details."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from fretwork.functions.money import price_cents
from fretwork.functions.ranking import top_k

# Prices are DECIMAL(10,2), so their cents lie within this distance of zero, and 35 levels cover them.
SHIFT = 10**10
LEVELS = 35

# The output columns that callers of the browse functions rely on.
CARD_COLUMNS = [
    "product_id", "product_name", "brand", "category", "price", "description", "skill_level", "use_case",
    "price_tier", "manufacturer_url", "in_stock", "quantity",
]
DETAIL_COLUMNS = [
    "product_name", "brand", "category", "subcategory", "price", "description", "skill_level", "use_case",
    "price_tier", "in_stock", "manufacturer_url",
]


def with_stock(products: DataFrame, inventory: DataFrame) -> DataFrame:
    return products.join(inventory, "product_id", "left")


def block_name(level: Column, number: Column) -> Column:
    return F.concat_ws(":", level.cast("string"), number.cast("string"))


def blocks_around(cents: Column) -> Column:
    """The blocks of 1, 2, 4, ... cents that hold a price, one per level."""
    return F.transform(
        F.sequence(F.lit(0), F.lit(LEVELS)), lambda i: block_name(i, F.call_function("shiftright", cents, i))
    )


def blocks_up_to(cents: Column) -> Column:
    """Blocks that together cover the prices from 0 to ``cents`` exactly once, at most one per level."""
    n = cents + 1
    bit = lambda i: F.call_function("shiftright", n, i)
    levels = F.filter(F.sequence(F.lit(0), F.lit(LEVELS)), lambda i: bit(i).bitwiseAND(F.lit(1)) == 1)
    return F.transform(levels, lambda i: block_name(i, bit(i) - 1))


def browse(
    catalog: DataFrame, inventory: DataFrame, requests: DataFrame, k: int = 3, hidden_text: str = "Bundle"
) -> DataFrame:
    """First ``k`` products per request by category, then price.

    ``requests``: request_id, categories (exact names; NULL or empty means all), max_price. Products whose
    name contains ``hidden_text`` are left out. Only the ``k`` cheapest products of a category can be
    shown, so the catalogue is cut down to these first. A request for all categories then reads the
    price blocks below its limit, of which each keeps only its own first ``k`` rows.
    """
    shown = catalog.where(~F.contains("product_name", F.lit(hidden_text)) & F.col("price").isNotNull())
    cents = price_cents(F.col("price")) + F.lit(SHIFT)
    slim = shown.select("product_id", F.col("category").alias("_category"), cents.alias("_cents"))
    by_price = [F.col("_cents"), F.col("product_id")]
    cheapest = top_k(slim, ["_category"], by_price, k, "_rn").drop("_rn")

    limit = F.floor(F.col("max_price").cast("decimal(18,4)") * 100).cast("bigint") + F.lit(SHIFT)
    limit = F.when(limit.isNotNull(), F.least(limit, F.lit((1 << LEVELS) - 1)))
    names = F.array_sort(F.array_distinct("categories"))
    asked = requests.select(
        "request_id",
        names.alias("_categories"),
        limit.alias("_limit"),
        F.concat_ws("|", limit.cast("string"), F.to_json(names)).alias("_question"),
    ).where(F.col("_limit") >= 0)
    questions = asked.select("_question", "_categories", "_limit").distinct()
    everything = F.coalesce(F.size("_categories"), F.lit(0)) <= 0

    named = (
        questions.where(~everything)
        .select("_question", "_limit", F.explode("_categories").alias("_category"))
        .join(cheapest, "_category")
        .where(F.col("_cents") <= F.col("_limit"))
        .select("_question", "_category", "_cents", "product_id")
    )
    order = [F.col("_category").asc_nulls_last(), *by_price]
    blocks = top_k(cheapest.withColumn("_block", F.explode(blocks_around(F.col("_cents")))), ["_block"], order, k, "_rn")
    all_of_them = (
        questions.where(everything)
        .select("_question", F.explode(blocks_up_to(F.col("_limit"))).alias("_block"))
        .join(blocks, "_block")
        .select("_question", "_category", "_cents", "product_id")
    )
    winners = top_k(named.unionByName(all_of_them), ["_question"], order, k).select("_question", "product_id", "rank")
    answered = asked.select("request_id", "_question").join(winners, "_question").drop("_question")
    cards = with_stock(catalog, inventory).select(*[c for c in CARD_COLUMNS if c != "manufacturer_url"])
    return answered.join(cards, "product_id")


def products_by_ids(catalog: DataFrame, inventory: DataFrame, id_lists: DataFrame) -> DataFrame:
    """Product cards of each list in list order, the first mention of an id counts; unknown ids drop out.

    ``id_lists``: list_id, product_ids (array).
    """
    wanted = id_lists.select("list_id", F.posexplode(F.array_distinct("product_ids")).alias("position", "product_id"))
    return wanted.join(with_stock(catalog, inventory).select(*CARD_COLUMNS), "product_id")


def product_details(catalog: DataFrame, ids: DataFrame) -> DataFrame:
    """All details per asked ``product_id``; an unknown id gets NULLs and an error text."""
    known = catalog.select("product_id", *DETAIL_COLUMNS, F.lit(True).alias("_known"))
    miss = F.concat(F.lit("Product "), "product_id", F.lit(" not found"))
    return ids.join(known, "product_id", "left").select(
        "product_id", *DETAIL_COLUMNS, F.when(F.col("_known").isNull(), miss).alias("error")
    )
