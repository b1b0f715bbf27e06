"""Staging, marts, generator and load audit over the given tables."""

from __future__ import annotations

from functools import partial

from pyspark.sql import functions as F

from fretwork.functions.jsonio import customer_snapshot, id_list
from fretwork.functions.money import price_tier
from fretwork.functions.text import levels_overlap
from fretwork.plans import marts, staging, warehouse
from fretwork.plans.increments import CustomerTotals
from fretwork.schemas import RAW
from fretwork.session import materialize, run_together, scratch_dir
from fretwork.sources import variants
from fretwork.sources.catalog import generate_catalog
from fretwork.sources.raw_files import read_csv, write_csv
from fretwork.workload import shop

TABLES = [
    "region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events",
    "documents", "embeddings", "pages", "benchmark", "labels", "conversations",
]


def as_text(name: str):
    return F.col(name).cast("string").alias(name)


def as_double(name: str):
    return F.col(name).cast("double").alias(name)


def stg_products(spark, sf_dir):
    return staging.stg_products(shop.raw_products(spark, sf_dir)).withColumn("price", as_double("price"))


def stg_customers(spark, sf_dir):
    return staging.stg_customers(shop.raw_customers(spark, sf_dir)).withColumn("created_at", as_text("created_at"))


def stg_orders_typed(spark, sf_dir):
    typed = staging.stg_orders(shop.raw_orders(spark, sf_dir))
    return typed.select(
        "order_id", "customer_id", "product_id", "quantity", as_double("unit_price"), as_double("line_total"),
        as_text("order_date"), "status",
    )


def _dim_products(spark, sf_dir):
    return marts.dim_products(staging.stg_products(shop.raw_products(spark, sf_dir)))


def dim_products_dedup(spark, sf_dir):
    return _dim_products(spark, sf_dir).select(
        "product_id", "product_name", "brand", "category", "subcategory", as_double("price"), "price_tier",
        "in_stock", "manufacturer_url",
    )


def skill_array(spark, sf_dir):
    return _dim_products(spark, sf_dir).select(
        "product_id",
        F.size("skill_levels_array").cast("bigint").alias("n_levels"),
        F.array_join("skill_levels_array", "|").alias("levels"),
    )


def skill_overlap(spark, sf_dir):
    """Products of each skill range that suit an intermediate player."""
    suits = levels_overlap(F.col("skill_level"), F.lit("intermediate"))
    products = _dim_products(spark, sf_dir)
    return products.groupBy("skill_level").agg(F.count(F.lit(1)).alias("n_products"), F.count_if(suits).alias("n_suitable"))


def csv_round_trip(spark, sf_dir):
    """Raw products written as CSV with a header and read back under the declared schema."""
    path = scratch_dir(spark, "products_csv")
    write_csv(shop.raw_products(spark, sf_dir), path, "products")
    rows = read_csv(spark, path, "products")  # no cell holds a line break, so files are split
    return rows.withColumn("manufacturer_url", F.coalesce("manufacturer_url", F.lit("")))


def _write_raw(spark, sf_dir, data):
    run_together(*[partial(write_csv, getattr(shop, f"raw_{name}")(spark, sf_dir), f"{data}/{name}.csv", name, packed=True) for name in RAW])


def warehouse_build(spark, sf_dir):
    """All raw files written as CSV, loaded, staged and built to marts: rows per table."""
    data, out = scratch_dir(spark, "raw"), scratch_dir(spark, "warehouse")
    _write_raw(spark, sf_dir, data)
    audit = warehouse.build(spark, data, out)
    for name in warehouse.MARTS:
        rows = warehouse.read_mart(spark, out, name).agg(F.count(F.lit(1)).alias("row_count"))
        audit = audit.unionByName(rows.select(F.lit(name).alias("table_name"), "row_count"))
    return audit


def _built(spark, sf_dir):
    data, out = scratch_dir(spark, "raw"), scratch_dir(spark, "warehouse")
    _write_raw(spark, sf_dir, data)
    warehouse.build(spark, data, out)
    return data, out


def built_products(spark, sf_dir):
    """The product mart as read back from a build out of CSV files, cell by cell."""
    _, out = _built(spark, sf_dir)
    return warehouse.read_mart(spark, out, "dim_products").select(
        "product_id", "product_name", "brand", "category", "subcategory", as_double("price"), "description", "skill_level",
        "use_case", "in_stock", "price_tier", F.array_join("skill_levels_array", "|").alias("levels"),
        F.coalesce("manufacturer_url", F.lit("")).alias("manufacturer_url"),
    )


def built_customers(spark, sf_dir):
    """The customer mart as read back from a build out of CSV files, cell by cell."""
    _, out = _built(spark, sf_dir)
    return _customer_columns(warehouse.read_mart(spark, out, "dim_customers"))


def build_once(spark, sf_dir):
    """A second build that may not replace: it returns the first audit and leaves raw tables and marts as they are."""
    data, out = _built(spark, sf_dir)
    write_csv(shop.raw_products(spark, sf_dir).limit(0), f"{data}/products.csv", "products")
    audit = warehouse.build(spark, data, out, replace=False)
    for name in ("raw_products", "dim_products"):
        rows = warehouse.read_table(spark, out, name).agg(F.count(F.lit(1)).alias("row_count"))
        audit = audit.unionByName(rows.select(F.lit(f"{name} after").alias("table_name"), "row_count"))
    return audit


def staging_views(spark, sf_dir):
    """The three staging views, read by name."""
    raw = {name: getattr(shop, f"raw_{name}")(spark, sf_dir) for name in ("products", "customers", "orders")}
    warehouse.create_staging_views(raw)
    return spark.sql("""
        SELECT 'products' AS view, count(*) AS n, cast(sum(price) AS double) AS total FROM stg_products
        UNION ALL SELECT 'customers', count(*), cast(sum(years_playing) AS double) FROM stg_customers
        UNION ALL SELECT 'orders', count(*), cast(sum(line_total) AS double) FROM stg_orders""")


def price_tiers(spark, sf_dir):
    price = F.col("o_totalprice").cast("decimal(12,2)")
    bounds = [(50000, "budget"), (150000, "entry"), (400000, "mid-range")]
    return (
        shop.table(spark, sf_dir, "orders")
        .groupBy(price_tier(price, bounds).alias("price_tier"))
        .agg(F.count(F.lit(1)).alias("n_orders"), F.sum(price).cast("double").alias("total"))
    )


def dim_customers_mart(spark, sf_dir):
    mart = marts.dim_customers(
        staging.stg_customers(shop.raw_customers(spark, sf_dir)), staging.stg_orders(shop.raw_orders(spark, sf_dir))
    )
    return _customer_columns(mart)


def _customer_columns(mart):
    return mart.select(
        "customer_id", "full_name", "email", "skill_level", "primary_instrument", "years_playing", "use_case",
        "budget_range", as_text("created_at"), "total_orders", "lifetime_value", as_text("last_order_date"),
        as_text("first_order_date"), F.array_join("purchased_product_ids", ",").alias("purchased_product_ids"), "n_product_pages",
    )


def customer_product_pages(spark, sf_dir):
    """Product lists in pages of about 20: pages, products and digest of all ids per customer."""
    bought = marts.customer_products(staging.stg_orders(shop.raw_orders(spark, sf_dir)))
    pages = marts.product_pages(bought, 20)
    rows = pages.select("customer_id", "page_no", "n_pages", F.explode("product_ids").alias("product_id"))
    return rows.groupBy("customer_id").agg(
        F.max("n_pages").alias("n_pages"),
        F.count(F.lit(1)).alias("n_products"),
        F.min("product_id").alias("first_id"),
        F.max("product_id").alias("last_id"),
        F.sum(F.substring("product_id", 2, 12).cast("bigint")).alias("id_sum"),
    )


def returned_order_stats(spark, sf_dir):
    """Customers against their large returned lines (45 pieces and more) only, so that some customers have no match."""
    orders = staging.stg_orders(shop.raw_orders(spark, sf_dir)).where("status = 'returned' and quantity >= 45")
    mart = marts.dim_customers(staging.stg_customers(shop.raw_customers(spark, sf_dir)), orders)
    return mart.select(
        "customer_id", "total_orders", "lifetime_value", as_text("last_order_date"),
        F.size("purchased_product_ids").cast("bigint").alias("n_products"),
    )


def incremental_customers(spark, sf_dir):
    """All order lines in three deliveries (half, three tenths, a fifth); lines of one order come in several, so many are late.

    The totals after each delivery are made from that delivery and the rows it touches.
    """
    lines = staging.stg_orders(shop.raw_orders(spark, sf_dir))
    lines = materialize(lines.select("customer_id", "order_id", "product_id", "line_total", "order_date"), "order-lines")
    tenth = F.pmod(F.xxhash64("order_id", "product_id"), F.lit(10))
    totals = CustomerTotals(spark, scratch_dir(spark, "customer-totals"), buckets=16)
    for delta, (low, high) in enumerate([(0, 5), (5, 8), (8, 10)], start=1):
        totals.apply(lines.where((tenth >= low) & (tenth < high)), delta)
        if delta == 1:
            totals.compact()
    return totals.totals().select(
        "customer_id", "total_orders", "n_products", as_double("lifetime_value"), as_text("last_order_date"), as_text("first_order_date")
    )


def inventory_mart(spark, sf_dir):
    return marts.inventory(shop.raw_inventory(spark, sf_dir))


def fct_recommendations(spark, sf_dir):
    facts = marts.fct_recommendations(shop.raw_se_handoffs(spark, sf_dir))
    return facts.withColumn("created_at", F.date_format("created_at", "yyyy-MM-dd HH:mm:ss"))


def json_snapshot(spark, sf_dir):
    facts = marts.fct_recommendations(shop.raw_se_handoffs(spark, sf_dir))
    typed = facts.withColumn("s", customer_snapshot(F.col("customer_snapshot"))).withColumn(
        "ids", id_list(F.col("recommended_products"))
    )
    return typed.select(
        "handoff_id", "s.name", "s.skill", "s.instrument", "s.budget",
        F.size("ids").cast("bigint").alias("n_ids"), F.try_element_at("ids", F.lit(1)).alias("first_id"),
    )


def variant_snapshots(spark, sf_dir):
    """Handoffs loaded with both JSON cells parsed once; the typed snapshot and the ids read by path."""
    loaded = variants.load_json(shop.raw_se_handoffs(spark, sf_dir), ["customer_snapshot", "recommended_products"], scratch_dir(spark, "handoff-json"))
    rows = variants.snapshots(loaded)
    return rows.select(
        "handoff_id", "name", "skill", "instrument", "budget",
        F.size("ids").cast("bigint").alias("n_ids"), F.try_element_at("ids", F.lit(1)).alias("first_id"),
    )


def load_audit(spark, sf_dir):
    """Rows per loaded table; every count is one pass that needs no column."""
    audit = None
    for name in TABLES:
        rows = shop.table(spark, sf_dir, name).agg(F.count(F.lit(1)).alias("row_count"))
        rows = rows.select(F.lit(f"raw_{name}").alias("table_name"), "row_count")
        audit = rows if audit is None else audit.unionAll(rows)
    return audit


def catalog_generator(spark, sf_dir):
    """Catalogue of five times the parts: the parts themselves, then four rounds of bundles less one row."""
    parts = shop.table(spark, sf_dir, "part")
    base = parts.select(
        F.col("p_partkey").alias("position"),
        F.col("p_brand").alias("brand"),
        F.col("p_name").alias("model"),
        F.col("p_type").alias("category"),
        F.col("p_type").alias("subcategory"),
        F.col("p_retailprice").alias("price"),
        shop.pick(shop.SKILL_LEVELS, F.col("p_size")).alias("skill_level"),
        shop.pick(shop.USE_CASES, F.col("p_size")).alias("use_case"),
        F.col("p_name").alias("description"),
    )
    urls = parts.groupBy("p_brand").agg(F.min("p_size").alias("s")).where("s <= 1")
    urls = urls.select(F.col("p_brand").alias("brand"), F.concat(F.lit("https://"), F.lower("p_brand")).alias("url"))
    return generate_catalog(base, 5 * parts.count() - 1, urls)


QUERIES = {
    "stg_products": stg_products,
    "stg_customers": stg_customers,
    "stg_orders_typed": stg_orders_typed,
    "dim_products_dedup": dim_products_dedup,
    "skill_array": skill_array,
    "skill_overlap": skill_overlap,
    "csv_round_trip": csv_round_trip,
    "warehouse_build": warehouse_build,
    "built_products": built_products,
    "built_customers": built_customers,
    "build_once": build_once,
    "staging_views": staging_views,
    "price_tiers": price_tiers,
    "dim_customers_mart": dim_customers_mart,
    "customer_product_pages": customer_product_pages,
    "returned_order_stats": returned_order_stats,
    "incremental_customers": incremental_customers,
    "inventory_mart": inventory_mart,
    "fct_recommendations": fct_recommendations,
    "json_snapshot": json_snapshot,
    "variant_snapshots": variant_snapshots,
    "load_audit": load_audit,
    "catalog_generator": catalog_generator,
}

_FACTS = f"""WITH facts AS (
  SELECT 'H' || CAST(o_orderkey AS VARCHAR) AS handoff_id, 'S' || CAST(o_custkey AS VARCHAR) AS session_id,
         CAST(json('{{ "name": "Customer ' || CAST(o_custkey AS VARCHAR)
              || '", "skill": "beginner", "instrument" : "guitar",  "budget": '
              || CAST(CAST(floor(o_totalprice) AS BIGINT) AS VARCHAR) || ' }}') AS VARCHAR) AS customer_snapshot,
         CAST(json('[ "' || {shop.sql_product_key("o_custkey")} || '" , "' || {shop.sql_product_key("o_orderkey // 10")}
              || '" ]') AS VARCHAR) AS recommended_products,
         'Order ' || CAST(o_orderkey AS VARCHAR) || ', total $' || CAST(o_totalprice AS VARCHAR) AS conversation_summary,
         {shop._sql_map(shop.HANDOFF_PRIORITY, "o_orderpriority")} AS priority,
         strftime(o_orderdate, '%Y-%m-%d %H:%M:%S') AS created_at,
         'Engineer ' || CAST(o_custkey % 7 AS VARCHAR) AS assigned_se
  FROM orders)"""

_CUSTOMER_MART = """
  SELECT c.customer_id, c.first_name || ' ' || c.last_name AS full_name, c.email, c.skill_level, c.primary_instrument,
         CAST(c.years_playing AS INTEGER) AS years_playing, c.use_case, c.budget_range, c.created_at,
         coalesce(s.total_orders, 0) AS total_orders, CAST(coalesce(s.lifetime_value, 0) AS DOUBLE) AS lifetime_value,
         CAST(s.last_order_date AS VARCHAR) AS last_order_date, CAST(s.first_order_date AS VARCHAR) AS first_order_date,
         coalesce(s.ids, []) AS ids
  FROM raw_customers c LEFT JOIN (
    SELECT customer_id, count(DISTINCT order_id) AS total_orders, sum(line_total) AS lifetime_value,
           max(order_date) AS last_order_date, min(order_date) AS first_order_date,
           list_sort(array_agg(DISTINCT product_id)) AS ids
    FROM stg_orders WHERE {condition} GROUP BY customer_id) s USING (customer_id)"""

ORACLE = {
    "stg_products": shop.with_sql("stg_products") + " SELECT * REPLACE (CAST(price AS DOUBLE) AS price) FROM stg_products",
    "stg_customers": shop.with_sql("raw_customers")
    + """ SELECT * REPLACE (CAST(years_playing AS INTEGER) AS years_playing),
                 first_name || ' ' || last_name AS full_name FROM raw_customers""",
    "stg_orders_typed": shop.with_sql("stg_orders")
    + """ SELECT * REPLACE (CAST(unit_price AS DOUBLE) AS unit_price, CAST(line_total AS DOUBLE) AS line_total,
                            CAST(order_date AS VARCHAR) AS order_date) FROM stg_orders""",
    "dim_products_dedup": shop.with_sql("dim_products")
    + """ SELECT product_id, product_name, brand, category, subcategory, CAST(price AS DOUBLE) AS price, price_tier,
                 in_stock, manufacturer_url FROM dim_products""",
    "skill_array": shop.with_sql("dim_products")
    + """ SELECT product_id, len(skill_levels_array) AS n_levels,
                 array_to_string(skill_levels_array, '|') AS levels FROM dim_products""",
    "skill_overlap": shop.with_sql("dim_products")
    + """ SELECT skill_level, count(*) AS n_products, count(*) FILTER (
             list_contains(skill_levels_array, 'intermediate') OR skill_level = 'beginner-advanced') AS n_suitable
          FROM dim_products GROUP BY skill_level""",
    "csv_round_trip": shop.with_sql("raw_products") + " SELECT * FROM raw_products",
    "warehouse_build": shop.with_sql("dim_products")
    + """ SELECT * FROM (VALUES ('raw_products', (SELECT count(*) FROM part)), ('raw_customers', (SELECT count(*) FROM customer)),
             ('raw_orders', (SELECT count(*) FROM lineitem WHERE l_orderkey IN (SELECT o_orderkey FROM orders))),
             ('raw_inventory', (SELECT count(DISTINCT l_partkey) FROM lineitem)),
             ('raw_se_handoffs', (SELECT count(*) FROM orders)), ('dim_products', (SELECT count(*) FROM dim_products)),
             ('dim_customers', (SELECT count(*) FROM customer)), ('fct_recommendations', (SELECT count(*) FROM orders)),
             ('inventory', (SELECT count(DISTINCT l_partkey) FROM lineitem))) t(table_name, row_count)""",
    "built_products": shop.with_sql("dim_products")
    + """ SELECT product_id, product_name, brand, category, subcategory, CAST(price AS DOUBLE) AS price, description, skill_level,
                 use_case, in_stock, price_tier, array_to_string(skill_levels_array, '|') AS levels, manufacturer_url FROM dim_products""",
    "build_once": shop.with_sql("dim_products")
    + """ SELECT * FROM (VALUES ('raw_products', (SELECT count(*) FROM part)), ('raw_customers', (SELECT count(*) FROM customer)),
             ('raw_orders', (SELECT count(*) FROM lineitem WHERE l_orderkey IN (SELECT o_orderkey FROM orders))),
             ('raw_inventory', (SELECT count(DISTINCT l_partkey) FROM lineitem)),
             ('raw_se_handoffs', (SELECT count(*) FROM orders)), ('raw_products after', (SELECT count(*) FROM part)),
             ('dim_products after', (SELECT count(*) FROM dim_products))) t(table_name, row_count)""",
    "staging_views": shop.with_sql("stg_products", "raw_customers", "stg_orders")
    + """ SELECT 'products' AS view, count(*) AS n, CAST(sum(price) AS DOUBLE) AS total FROM stg_products
          UNION ALL SELECT 'customers', count(*), CAST(sum(CAST(years_playing AS INTEGER)) AS DOUBLE) FROM raw_customers
          UNION ALL SELECT 'orders', count(*), CAST(sum(line_total) AS DOUBLE) FROM stg_orders""",
    "price_tiers": """
      SELECT CASE WHEN p < 50000 THEN 'budget' WHEN p < 150000 THEN 'entry' WHEN p < 400000 THEN 'mid-range'
                  ELSE 'premium' END AS price_tier, count(*) AS n_orders, CAST(sum(p) AS DOUBLE) AS total
      FROM (SELECT CAST(o_totalprice AS DECIMAL(12,2)) AS p FROM orders) GROUP BY 1""",
    "dim_customers_mart": shop.with_sql("raw_customers", "stg_orders")
    + f" SELECT * EXCLUDE (ids), array_to_string(ids, ',') AS purchased_product_ids, CAST(len(ids) > 0 AS BIGINT) AS n_product_pages FROM ({_CUSTOMER_MART.format(condition='true')})",
    "customer_product_pages": shop.with_sql("stg_orders")
    + """ SELECT customer_id, CAST(ceil(count(*) / 20) AS BIGINT) AS n_pages, count(*) AS n_products, min(product_id) AS first_id,
                 max(product_id) AS last_id, CAST(sum(CAST(substr(product_id, 2) AS BIGINT)) AS BIGINT) AS id_sum
          FROM (SELECT DISTINCT customer_id, product_id FROM stg_orders) GROUP BY customer_id""",
    "returned_order_stats": shop.with_sql("raw_customers", "stg_orders")
    + f""" SELECT customer_id, total_orders, lifetime_value, last_order_date, len(ids) AS n_products
           FROM ({_CUSTOMER_MART.format(condition="status = 'returned' AND quantity >= 45")})""",
    "incremental_customers": shop.with_sql("stg_orders")
    + """ SELECT customer_id, count(DISTINCT order_id) AS total_orders, count(DISTINCT product_id) AS n_products,
                 CAST(sum(line_total) AS DOUBLE) AS lifetime_value, CAST(max(order_date) AS VARCHAR) AS last_order_date,
                 CAST(min(order_date) AS VARCHAR) AS first_order_date FROM stg_orders GROUP BY customer_id""",
    "inventory_mart": shop.with_sql("inventory") + " SELECT * FROM inventory",
    "fct_recommendations": _FACTS + " SELECT * FROM facts",
    "json_snapshot": _FACTS
    + """ SELECT handoff_id, customer_snapshot->>'$.name' AS name, customer_snapshot->>'$.skill' AS skill,
                 customer_snapshot->>'$.instrument' AS instrument,
                 CAST(customer_snapshot->>'$.budget' AS DOUBLE) AS budget,
                 CAST(json_array_length(recommended_products) AS BIGINT) AS n_ids,
                 recommended_products->>'$[0]' AS first_id FROM facts""",
    "load_audit": " UNION ALL ".join(
        f"SELECT 'raw_{t}' AS table_name, count(*) AS row_count FROM {t}" for t in TABLES
    ),
    "catalog_generator": f"""
      WITH base AS (SELECT *, row_number() OVER (ORDER BY p_partkey) AS num, count(*) OVER () AS n FROM part),
           urls AS (SELECT p_brand, 'https://' || lower(p_brand) AS url FROM part GROUP BY 1 HAVING min(p_size) <= 1),
           copies AS (SELECT base.*, c, c * n + num AS id FROM base, range(5) r(c) WHERE c * n + num <= 5 * n - 1)
      SELECT 'P' || CASE WHEN id < 10000 THEN lpad(CAST(id AS VARCHAR), 4, '0') ELSE CAST(id AS VARCHAR) END AS product_id,
             p_brand || ' ' || p_name || CASE WHEN c > 0 THEN ' Bundle' ELSE '' END AS name, p_brand AS brand,
             p_type AS category, p_type AS subcategory,
             CAST(CASE WHEN c > 0 THEN CAST(round(CAST(p_retailprice AS DECIMAL(10,2)) * 1.05, 2) AS DECIMAL(10,2))
                       ELSE CAST(p_retailprice AS DECIMAL(10,2)) END AS VARCHAR) AS price,
             p_name || CASE WHEN c > 0 THEN ' — includes accessories bundle' ELSE '' END AS description,
             {shop._sql_list(shop.SKILL_LEVELS)}[p_size % 6 + 1] AS skill_level,
             {shop._sql_list(shop.USE_CASES)}[p_size % 4 + 1] AS use_case,
             'true' AS in_stock, coalesce(url, '') AS manufacturer_url
      FROM copies LEFT JOIN urls USING (p_brand)""",
}
ORACLE["built_customers"] = ORACLE["dim_customers_mart"]
ORACLE["variant_snapshots"] = ORACLE["json_snapshot"]
