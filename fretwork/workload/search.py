"""Catalogue search, browsing and lookups over the given tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from fretwork.functions.money import money_text, stock_label
from fretwork.functions.ranking import top_k
from fretwork.functions.text import head, or_default
from fretwork.operators import browse as browsing
from fretwork.operators.search import catalog_search
from fretwork.plans import marts, staging
from fretwork.session import materialize
from fretwork.workload import shop


def catalog_mart(spark, sf_dir):
    """The product mart as a written table, which is what searches read."""
    return materialize(marts.dim_products(staging.stg_products(shop.raw_products(spark, sf_dir))), "dim_products")


def inventory_mart(spark, sf_dir):
    return marts.inventory(shop.raw_inventory(spark, sf_dir))


def requests(spark, sf_dir):
    """One search request per customer; every filter is present for some and absent for others."""
    balance = F.expr("CAST(c_acctbal AS DECIMAL(12,2))")
    nation = F.col("c_nationkey")
    segment = F.col("c_mktsegment")
    return shop.table(spark, sf_dir, "customer").select(
        F.col("c_custkey").alias("request_id"),
        F.when(segment == "HOUSEHOLD", "econ")
        .when(segment == "MACHINERY", "gear")
        .when(segment == "FURNITURE", "")
        .when(segment == "BUILDING", "Promo")
        .alias("category"),
        F.when(nation < 8, "beginner").when(nation < 12, "Intermediate").alias("skill_level"),
        F.when(nation == 13, "studio").when(nation.between(14, 16), "home").alias("use_case"),
        F.when(nation >= 20, "brand#1").alias("brand"),
        F.when(balance > 8000, balance * F.expr("0.05BD")).alias("min_price"),
        F.when(balance > 3000, balance * F.expr("0.30BD")).alias("max_price"),
        F.when(balance > 0, balance * F.expr("0.25BD")).alias("target_price"),
    )


REQUESTS_SQL = """requests AS (
  SELECT c_custkey AS request_id,
         CASE c_mktsegment WHEN 'HOUSEHOLD' THEN 'econ' WHEN 'MACHINERY' THEN 'gear' WHEN 'FURNITURE' THEN ''
                           WHEN 'BUILDING' THEN 'Promo' END AS category,
         CASE WHEN c_nationkey < 8 THEN 'beginner' WHEN c_nationkey < 12 THEN 'Intermediate' END AS skill_level,
         CASE WHEN c_nationkey = 13 THEN 'studio' WHEN c_nationkey BETWEEN 14 AND 16 THEN 'home' END AS use_case,
         CASE WHEN c_nationkey >= 20 THEN 'brand#1' END AS brand,
         CASE WHEN b > 8000 THEN b * 0.05 END AS min_price, CASE WHEN b > 3000 THEN b * 0.30 END AS max_price,
         CASE WHEN b > 0 THEN b * 0.25 END AS target_price
  FROM (SELECT *, CAST(c_acctbal AS DECIMAL(12,2)) AS b FROM customer))"""

FITS_SQL = """p.in_stock
     AND (coalesce(r.category, '') = '' OR contains(lower(p.category), lower(r.category))
          OR contains(lower(p.subcategory), lower(r.category)))
     AND (coalesce(r.skill_level, '') = '' OR contains(lower(p.skill_level), lower(r.skill_level)))
     AND (coalesce(r.use_case, '') = '' OR contains(lower(p.use_case), lower(r.use_case)))
     AND (coalesce(r.brand, '') = '' OR contains(lower(p.brand), lower(r.brand)))
     AND (r.min_price IS NULL OR p.price >= r.min_price) AND (r.max_price IS NULL OR p.price <= r.max_price)"""

RESULT_SQL = """SELECT request_id, rank, product_id, product_name, brand, subcategory, price, skill_level, use_case, price_tier
  FROM hits WHERE rank <= 3"""


def _search_sql(order: str, source: str = "requests r JOIN dim_products p ON true", more: str = "") -> str:
    return f"""{shop.with_sql("dim_products", *(["stg_orders"] if "candidates" in more else []))}, {REQUESTS_SQL} {more},
  hits AS (SELECT r.request_id, p.product_id, p.product_name, p.brand, p.subcategory, CAST(p.price AS DOUBLE) AS price,
                  p.skill_level, p.use_case, p.price_tier,
                  row_number() OVER (PARTITION BY r.request_id ORDER BY {order}, p.product_id) AS rank
           FROM {source} WHERE {FITS_SQL}) {RESULT_SQL}"""


CANDIDATES_SQL = """, candidates AS (
  SELECT request_id, product_id, row_number() OVER (PARTITION BY request_id ORDER BY spent DESC, product_id) AS candidate_rank
  FROM (SELECT CAST(substr(customer_id, 2) AS BIGINT) AS request_id, product_id, sum(line_total) AS spent
        FROM stg_orders WHERE {condition} GROUP BY ALL)
  QUALIFY candidate_rank <= 20)"""


def _result(hits):
    return hits.withColumns({"rank": F.col("rank").cast("bigint"), "price": F.col("price").cast("double")})


def search_target_price(spark, sf_dir):
    return _result(catalog_search(catalog_mart(spark, sf_dir), requests(spark, sf_dir)))


def search_cheapest(spark, sf_dir):
    return _result(catalog_search(catalog_mart(spark, sf_dir), requests(spark, sf_dir).drop("target_price")))


def candidates(spark, sf_dir, condition=None):
    """Candidate list of a customer's request: the twenty products with the highest spend."""
    orders = staging.stg_orders(shop.raw_orders(spark, sf_dir))
    if condition:
        orders = orders.where(condition)
    spent = orders.groupBy("customer_id", "product_id").agg(F.sum("line_total").alias("spent"))
    order = [F.col("spent").desc(), F.col("product_id")]
    ranked = top_k(spent, ["customer_id"], order, 20, "candidate_rank").select(
        F.substring("customer_id", 2, 12).cast("bigint").alias("request_id"), "product_id", "candidate_rank"
    )
    return materialize(ranked, "candidates")


def search_semantic_rank(spark, sf_dir):
    """Requests without a target price: candidates in rank order, after the filters."""
    asked = requests(spark, sf_dir).drop("target_price")
    return _result(catalog_search(catalog_mart(spark, sf_dir), asked, candidates(spark, sf_dir)))


def search_empty_candidates(spark, sf_dir):
    """Only large orders make candidates here: customers without any search the whole catalogue."""
    some = candidates(spark, sf_dir, "status = 'returned' and quantity >= 48")
    return _result(catalog_search(catalog_mart(spark, sf_dir), requests(spark, sf_dir), some))


def browse_requests(spark, sf_dir):
    """One browse request per supplier: none, one or two categories and a price limit."""
    nation = F.col("s_nationkey")
    none = F.array().cast("array<string>")
    return shop.table(spark, sf_dir, "supplier").select(
        F.col("s_suppkey").alias("request_id"),
        F.when(nation < 5, none)
        .when(nation < 8, F.lit(None).cast("array<string>"))
        .when(nation < 15, F.array(F.lit("PROMO")))
        .when(nation < 20, F.array(F.lit("SMALL"), F.lit("LARGE"), F.lit("SMALL")))
        .otherwise(F.array(F.lit("promo"), F.lit("ECONOMY")))
        .alias("categories"),
        F.expr("CAST(s_acctbal AS DECIMAL(12,2)) * 0.5BD").alias("max_price"),
    )


def browse_by_category(spark, sf_dir):
    hits = browsing.browse(
        catalog_mart(spark, sf_dir), inventory_mart(spark, sf_dir), browse_requests(spark, sf_dir), hidden_text="widget"
    )
    return _result(hits)


def product_details_lookup(spark, sf_dir):
    """Details for the product of every order line, known or unknown to the mart."""
    lines = shop.table(spark, sf_dir, "lineitem").select("l_partkey", "l_returnflag").distinct()
    shown = F.when(F.col("l_returnflag") == "R", F.col("l_partkey")).otherwise(F.col("l_partkey") * 3)
    ids = lines.select(shop.product_key(shown).alias("product_id")).distinct()
    found = browsing.product_details(catalog_mart(spark, sf_dir), ids)
    return found.withColumn("price", F.col("price").cast("double"))


def products_by_ids_ordered(spark, sf_dir):
    """Cards for the ids that each handoff names, some of them twice or unknown."""
    key, cust = F.col("o_orderkey"), F.col("o_custkey")
    lists = shop.table(spark, sf_dir, "orders").select(
        key.alias("list_id"),
        F.array(*[shop.product_key(k) for k in (cust, F.floor(key / 8), cust, F.floor(cust / 2))]).alias("product_ids"),
    )
    cards = browsing.products_by_ids(catalog_mart(spark, sf_dir), inventory_mart(spark, sf_dir), lists)
    return cards.select(
        "list_id", F.col("position").cast("bigint").alias("position"), "product_id", "product_name",
        F.col("price").cast("double").alias("price"), "price_tier", "quantity",
    )


def inventory_stock_label(spark, sf_dir):
    """Text of every product tile."""
    products = marts.dim_products(staging.stg_products(shop.raw_products(spark, sf_dir)))
    tiles = browsing.with_stock(products, inventory_mart(spark, sf_dir))
    return tiles.select(
        "product_id",
        "quantity",
        stock_label(F.col("quantity")).alias("stock"),
        money_text(F.col("price")).alias("price_text"),
        head(F.col("description"), 12).alias("short_text"),
        or_default(F.col("manufacturer_url"), "none").alias("link"),
    )


QUERIES = {
    "search_target_price": search_target_price,
    "search_cheapest": search_cheapest,
    "search_semantic_rank": search_semantic_rank,
    "search_empty_candidates": search_empty_candidates,
    "browse_by_category": browse_by_category,
    "product_details_lookup": product_details_lookup,
    "products_by_ids_ordered": products_by_ids_ordered,
    "inventory_stock_label": inventory_stock_label,
}

_BY_TARGET = "CASE WHEN r.target_price IS NULL THEN p.price ELSE abs(p.price - r.target_price) END"
_WITH_CANDIDATES = """requests r JOIN dim_products p ON true LEFT JOIN candidates c
             ON c.request_id = r.request_id AND c.product_id = p.product_id
             LEFT JOIN (SELECT DISTINCT request_id FROM candidates) h ON h.request_id = r.request_id"""

ORACLE = {
    "search_target_price": _search_sql(_BY_TARGET),
    "search_cheapest": _search_sql("p.price"),
    "search_semantic_rank": _search_sql(
        "coalesce(c.candidate_rank, 0), p.price", _WITH_CANDIDATES, CANDIDATES_SQL.format(condition="true")
    ).replace("p.in_stock\n", "p.in_stock AND (h.request_id IS NULL OR c.product_id IS NOT NULL)\n"),
    "search_empty_candidates": _search_sql(
        """CASE WHEN r.target_price IS NOT NULL THEN abs(p.price - r.target_price)
                ELSE coalesce(c.candidate_rank, p.price) END""",
        _WITH_CANDIDATES,
        CANDIDATES_SQL.format(condition="status = 'returned' AND quantity >= 48"),
    ).replace("p.in_stock\n", "p.in_stock AND (h.request_id IS NULL OR c.product_id IS NOT NULL)\n"),
    "browse_by_category": shop.with_sql("dim_products", "inventory")
    + """, asked AS (
      SELECT s_suppkey AS request_id, CAST(s_acctbal AS DECIMAL(12,2)) * 0.5 AS max_price,
             CASE WHEN s_nationkey < 8 THEN [] WHEN s_nationkey < 15 THEN ['PROMO']
                  WHEN s_nationkey < 20 THEN ['SMALL', 'LARGE'] ELSE ['promo', 'ECONOMY'] END AS categories
      FROM supplier)
      SELECT r.request_id, p.product_id, p.product_name, p.brand, p.category, CAST(p.price AS DOUBLE) AS price,
             p.description, p.skill_level, p.use_case, p.price_tier, p.in_stock, i.quantity,
             row_number() OVER (PARTITION BY r.request_id ORDER BY p.category, p.price, p.product_id) AS rank
      FROM asked r JOIN dim_products p ON p.price <= r.max_price
       AND (len(r.categories) = 0 OR list_contains(r.categories, p.category))
      LEFT JOIN inventory i USING (product_id)
      WHERE p.product_name NOT LIKE '%widget%' QUALIFY rank <= 3""",
    "product_details_lookup": shop.with_sql("dim_products")
    + f""", ids AS (SELECT DISTINCT {shop.sql_product_key("CASE WHEN l_returnflag = 'R' THEN l_partkey ELSE l_partkey * 3 END")}
                    AS product_id FROM lineitem)
      SELECT i.product_id, product_name, brand, category, subcategory, CAST(price AS DOUBLE) AS price, description,
             skill_level, use_case, price_tier, in_stock, manufacturer_url,
             CASE WHEN p.product_id IS NULL THEN 'Product ' || i.product_id || ' not found' END AS error
      FROM ids i LEFT JOIN dim_products p ON p.product_id = i.product_id""",
    "products_by_ids_ordered": shop.with_sql("dim_products", "inventory")
    + f""", lists AS (
      SELECT o_orderkey AS list_id, unnest([o_custkey, o_orderkey // 8, o_custkey, o_custkey // 2]) AS id,
             unnest([0, 1, 2, 3]) AS pos FROM orders),
      firsts AS (SELECT list_id, id, min(pos) AS pos FROM lists GROUP BY ALL),
      placed AS (SELECT list_id, {shop.sql_product_key("id")} AS product_id,
                        row_number() OVER (PARTITION BY list_id ORDER BY pos) - 1 AS position FROM firsts)
      SELECT list_id, position, p.product_id, product_name, CAST(price AS DOUBLE) AS price, price_tier, quantity
      FROM placed JOIN dim_products p USING (product_id) LEFT JOIN inventory USING (product_id)""",
    "inventory_stock_label": shop.with_sql("dim_products", "inventory")
    + """ SELECT product_id, quantity,
             CASE WHEN quantity IS NULL OR quantity = 0 THEN 'Out of Stock' WHEN quantity = 1 THEN 'Last One!'
                  WHEN quantity < 10 THEN 'Only ' || CAST(quantity AS VARCHAR) || ' left'
                  ELSE CAST(quantity AS VARCHAR) || ' in stock' END AS stock,
             format('{:,.2f}', CAST(price AS DOUBLE)) AS price_text, description[1:12] AS short_text,
             CASE WHEN manufacturer_url = '' THEN 'none' ELSE manufacturer_url END AS link
      FROM dim_products LEFT JOIN inventory USING (product_id)""",
}
