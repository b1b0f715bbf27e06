"""The given tables seen as a shop: raw products, customers, order lines, handoffs, chat calls.

Every frame has the columns of the raw file or app table of the same name, and ``CTE`` holds the same
derivation as SQL. No rows are left out: each given row becomes one row here.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

# Skill levels, instruments and use cases of the shop.
SKILL_LEVELS = [
    "beginner",
    "beginner-intermediate",
    "intermediate",
    "intermediate-advanced",
    "advanced",
    "beginner-advanced",
]
INSTRUMENTS = ["guitar", "drums", "keys", "vocals"]
USE_CASES = ["practice", "live performance", "studio recording", "home studio"]

HANDOFF_PRIORITY = {
    "1-URGENT": "high",
    "2-HIGH": "high",
    "3-MEDIUM": "medium",
    "4-NOT SPECIFIED": "low",
    "5-LOW": "low",
}
HANDOFF_STATUS = {"O": "new", "P": "claimed", "F": "closed"}


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


def product_key(key: Column) -> Column:
    return F.concat(F.lit("P"), F.lpad(key.cast("string"), 12, "0"))


def customer_key(key: Column) -> Column:
    return F.concat(F.lit("C"), F.lpad(key.cast("string"), 12, "0"))


def pick(values: list[str], number: Column) -> Column:
    return F.element_at(F.array(*[F.lit(v) for v in values]), (number % len(values) + 1).cast("int"))


def raw_products(spark: SparkSession, sf_dir: str) -> DataFrame:
    spread = (F.col("p_retailprice").cast("decimal(10,2)") - 900) * F.col("p_size")
    dollars = F.floor(spread / 25) * 25
    price = F.when(dollars == 0, F.lit("0.00")).otherwise(F.concat(dollars.cast("string"), F.lit(".99")))
    size = F.col("p_size")
    return table(spark, sf_dir, "part").select(
        product_key(F.col("p_partkey")).alias("product_id"),
        F.col("p_name").alias("name"),
        F.col("p_brand").alias("brand"),
        F.col("p_type").alias("category"),
        F.concat_ws(" ", "p_type", F.split_part("p_name", F.lit(" "), F.lit(2))).alias("subcategory"),
        price.alias("price"),
        F.concat(F.col("p_name"), F.lit(", size "), size.cast("string"), F.lit(", by "), F.col("p_brand")).alias(
            "description"
        ),
        pick(SKILL_LEVELS, size).alias("skill_level"),
        pick(USE_CASES, size).alias("use_case"),
        F.when(size % 10 == 0, F.lit("false")).otherwise(F.lit("true")).alias("in_stock"),
        F.when(size < 10, F.lit("")).otherwise(F.concat(F.lit("https://shop.example/"), F.lower("p_type"))).alias(
            "manufacturer_url"
        ),
    )


def raw_customers(spark: SparkSession, sf_dir: str) -> DataFrame:
    balance = F.col("c_acctbal")
    nation = F.col("c_nationkey")
    budget = F.when(balance < 500, "0-500").when(balance < 2000, "500-2000").otherwise("2000+")
    return table(spark, sf_dir, "customer").select(
        customer_key(F.col("c_custkey")).alias("customer_id"),
        F.split_part("c_name", F.lit("#"), F.lit(1)).alias("first_name"),
        F.split_part("c_name", F.lit("#"), F.lit(2)).alias("last_name"),
        F.concat(F.lit("c"), F.col("c_custkey").cast("string"), F.lit("@mail.example")).alias("email"),
        pick(SKILL_LEVELS, nation).alias("skill_level"),
        F.lower("c_mktsegment").alias("primary_instrument"),
        nation.alias("years_playing"),
        pick(USE_CASES, nation).alias("use_case"),
        budget.alias("budget_range"),
        F.date_add(F.lit("2024-01-01").cast("date"), nation).cast("string").alias("created_at"),
    )


def raw_orders(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One row per order line, with the buyer and the date of its order."""
    lines = table(spark, sf_dir, "lineitem")
    orders = table(spark, sf_dir, "orders")
    return lines.join(orders, lines["l_orderkey"] == orders["o_orderkey"]).select(
        F.concat(F.lit("O"), F.col("l_orderkey").cast("string")).alias("order_id"),
        customer_key(F.col("o_custkey")).alias("customer_id"),
        product_key(F.col("l_partkey")).alias("product_id"),
        F.col("l_quantity").cast("int").alias("quantity"),
        F.col("l_extendedprice").cast("decimal(10,2)").alias("unit_price"),
        F.col("o_orderdate").cast("date").alias("order_date"),
        F.when(F.col("l_returnflag") == "R", F.lit("returned")).otherwise(F.lit("completed")).alias("status"),
    )


def raw_inventory(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Stock per part: units that came back minus a fixed share of it; small numbers occur on purpose."""
    back = F.sum(F.when(F.col("l_returnflag") == "R", F.col("l_quantity")).otherwise(F.lit(0)))
    return (
        table(spark, sf_dir, "lineitem")
        .groupBy("l_partkey")
        .agg(back.alias("units"))
        .select(
            product_key(F.col("l_partkey")).alias("product_id"),
            F.floor(F.col("units") / 25).alias("quantity"),
        )
    )


def raw_se_handoffs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One handoff per order, its JSON cells written with blanks between the tokens."""
    key, cust = F.col("o_orderkey"), F.col("o_custkey")
    snapshot = F.concat(
        F.lit('{ "name": "Customer '),
        cust.cast("string"),
        F.lit('", "skill": "beginner", "instrument" : "guitar",  "budget": '),
        F.floor("o_totalprice").cast("string"),
        F.lit(" }"),
    )
    products = F.concat(
        F.lit('[ "'), product_key(cust), F.lit('" , "'), product_key(F.floor(key / 10)), F.lit('" ]')
    )
    return table(spark, sf_dir, "orders").select(
        F.concat(F.lit("H"), key.cast("string")).alias("handoff_id"),
        F.concat(F.lit("S"), cust.cast("string")).alias("session_id"),
        snapshot.alias("customer_snapshot"),
        products.alias("recommended_products"),
        F.concat(F.lit("Order "), key.cast("string"), F.lit(", total $"), F.col("o_totalprice").cast("string")).alias(
            "conversation_summary"
        ),
        priority().alias("priority"),
        F.col("o_orderdate").cast("string").alias("created_at"),
        F.concat(F.lit("Engineer "), (cust % 7).cast("string")).alias("assigned_se"),
    )


def priority() -> Column:
    pairs = [F.lit(x) for item in HANDOFF_PRIORITY.items() for x in item]
    return F.element_at(F.create_map(*pairs), F.col("o_orderpriority"))


def agent_handoffs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The app's queue table: one row per order."""
    statuses = [F.lit(x) for item in HANDOFF_STATUS.items() for x in item]
    status = F.element_at(F.create_map(*statuses), F.col("o_orderstatus"))
    key, cust, total = F.col("o_orderkey"), F.col("o_custkey"), F.col("o_totalprice")
    claimed = F.when(F.col("o_orderstatus") != "O", F.concat(F.lit("Engineer "), (cust % 7).cast("string")))
    ids = F.concat(F.lit('["'), product_key(cust), F.lit('","'), product_key(F.floor(key / 10)), F.lit('"]'))
    return table(spark, sf_dir, "orders").select(
        F.concat(F.lit("H"), key.cast("string")).alias("handoff_id"),
        F.concat(F.lit("S"), cust.cast("string")).alias("session_id"),
        F.when(cust % 10 != 0, F.concat(F.lit("Customer "), cust.cast("string"))).alias("customer_name"),
        pick(SKILL_LEVELS, cust).alias("skill_level"),
        pick(INSTRUMENTS, cust).alias("primary_instrument"),
        pick(USE_CASES, cust).alias("use_case"),
        F.when(total < 100000, "0-500").when(total < 300000, "500-2000").otherwise("2000+").alias("budget_range"),
        F.when(F.col("o_orderpriority") == "5-LOW", F.lit("")).otherwise(F.lit("old amp")).alias("existing_gear"),
        F.when(F.col("o_orderpriority") == "4-NOT SPECIFIED", F.lit("not json")).otherwise(ids).alias(
            "recommended_products"
        ),
        F.concat(F.lit("Order "), key.cast("string"), F.lit(" of customer "), cust.cast("string")).alias(
            "conversation_summary"
        ),
        priority().alias("priority"),
        status.alias("status"),
        claimed.alias("claimed_by"),
        F.when(claimed.isNotNull(), F.col("o_orderdate")).alias("claimed_at"),
        F.col("o_orderdate").alias("created_at"),
    )


def _sql_list(values: list[str]) -> str:
    return "[" + ", ".join(f"'{v}'" for v in values) + "]"


def _sql_map(table: dict[str, str], key: str) -> str:
    return "CASE " + key + " " + " ".join(f"WHEN '{k}' THEN '{v}'" for k, v in table.items()) + " END"


def sql_product_key(expr: str) -> str:
    return f"'P' || lpad(CAST({expr} AS VARCHAR), 12, '0')"


def sql_customer_key(expr: str) -> str:
    return f"'C' || lpad(CAST({expr} AS VARCHAR), 12, '0')"


# The same derivations as SQL, to be put in front of an oracle query.
CTE = {
    "raw_products": f"""raw_products AS (
  SELECT {sql_product_key("p_partkey")} AS product_id, p_name AS name, p_brand AS brand, p_type AS category,
         p_type || ' ' || split_part(p_name, ' ', 2) AS subcategory,
         CASE WHEN dollars = 0 THEN '0.00' ELSE CAST(dollars AS VARCHAR) || '.99' END AS price,
         p_name || ', size ' || CAST(p_size AS VARCHAR) || ', by ' || p_brand AS description,
         {_sql_list(SKILL_LEVELS)}[p_size % 6 + 1] AS skill_level,
         {_sql_list(USE_CASES)}[p_size % 4 + 1] AS use_case,
         CASE WHEN p_size % 10 = 0 THEN 'false' ELSE 'true' END AS in_stock,
         CASE WHEN p_size < 10 THEN '' ELSE 'https://shop.example/' || lower(p_type) END AS manufacturer_url
  FROM (SELECT *, CAST(floor((CAST(p_retailprice AS DECIMAL(10,2)) - 900) * p_size / 25.0) AS BIGINT) * 25 AS dollars
        FROM part))""",
    "stg_products": """stg_products AS (
  SELECT product_id, name AS product_name, brand, category, subcategory, CAST(price AS DECIMAL(10,2)) AS price,
         description, skill_level, use_case, CAST(in_stock AS BOOLEAN) AS in_stock, manufacturer_url
  FROM raw_products)""",
    "dim_products": """dim_products AS (
  SELECT *, CASE WHEN price < 100 THEN 'budget' WHEN price < 500 THEN 'entry'
                 WHEN price < 1500 THEN 'mid-range' ELSE 'premium' END AS price_tier,
         string_split(skill_level, '-') AS skill_levels_array
  FROM stg_products QUALIFY row_number() OVER (PARTITION BY product_name, price ORDER BY product_id) = 1)""",
    "raw_customers": f"""raw_customers AS (
  SELECT {sql_customer_key("c_custkey")} AS customer_id, split_part(c_name, '#', 1) AS first_name,
         split_part(c_name, '#', 2) AS last_name, 'c' || CAST(c_custkey AS VARCHAR) || '@mail.example' AS email,
         {_sql_list(SKILL_LEVELS)}[c_nationkey % 6 + 1] AS skill_level, lower(c_mktsegment) AS primary_instrument,
         CAST(c_nationkey AS VARCHAR) AS years_playing, {_sql_list(USE_CASES)}[c_nationkey % 4 + 1] AS use_case,
         CASE WHEN c_acctbal < 500 THEN '0-500' WHEN c_acctbal < 2000 THEN '500-2000' ELSE '2000+' END AS budget_range,
         CAST(DATE '2024-01-01' + c_nationkey AS VARCHAR) AS created_at
  FROM customer)""",
    "stg_orders": f"""stg_orders AS (
  SELECT 'O' || CAST(l_orderkey AS VARCHAR) AS order_id, {sql_customer_key("o_custkey")} AS customer_id,
         {sql_product_key("l_partkey")} AS product_id, CAST(l_quantity AS INTEGER) AS quantity,
         CAST(l_extendedprice AS DECIMAL(10,2)) AS unit_price,
         CAST(CAST(l_quantity AS INTEGER) * CAST(l_extendedprice AS DECIMAL(10,2)) AS DECIMAL(18,2)) AS line_total,
         CAST(o_orderdate AS DATE) AS order_date,
         CASE WHEN l_returnflag = 'R' THEN 'returned' ELSE 'completed' END AS status
  FROM lineitem JOIN orders ON l_orderkey = o_orderkey)""",
    "inventory": f"""inventory AS (
  SELECT {sql_product_key("l_partkey")} AS product_id,
         CAST(floor(sum(CASE WHEN l_returnflag = 'R' THEN l_quantity ELSE 0 END) / 25) AS INTEGER) AS quantity
  FROM lineitem GROUP BY l_partkey)""",
    "agent_handoffs": f"""agent_handoffs AS (
  SELECT 'H' || CAST(o_orderkey AS VARCHAR) AS handoff_id, 'S' || CAST(o_custkey AS VARCHAR) AS session_id,
         CASE WHEN o_custkey % 10 <> 0 THEN 'Customer ' || CAST(o_custkey AS VARCHAR) END AS customer_name,
         {_sql_list(SKILL_LEVELS)}[o_custkey % 6 + 1] AS skill_level,
         {_sql_list(INSTRUMENTS)}[o_custkey % 4 + 1] AS primary_instrument,
         {_sql_list(USE_CASES)}[o_custkey % 4 + 1] AS use_case,
         CASE WHEN o_totalprice < 100000 THEN '0-500' WHEN o_totalprice < 300000 THEN '500-2000' ELSE '2000+'
         END AS budget_range,
         CASE WHEN o_orderpriority = '5-LOW' THEN '' ELSE 'old amp' END AS existing_gear,
         CASE WHEN o_orderpriority = '4-NOT SPECIFIED' THEN 'not json'
              ELSE '["' || {sql_product_key("o_custkey")} || '","' || {sql_product_key("o_orderkey // 10")} || '"]'
         END AS recommended_products,
         'Order ' || CAST(o_orderkey AS VARCHAR) || ' of customer ' || CAST(o_custkey AS VARCHAR) AS conversation_summary,
         {_sql_map(HANDOFF_PRIORITY, "o_orderpriority")} AS priority,
         {_sql_map(HANDOFF_STATUS, "o_orderstatus")} AS status,
         CASE WHEN o_orderstatus <> 'O' THEN 'Engineer ' || CAST(o_custkey % 7 AS VARCHAR) END AS claimed_by,
         CASE WHEN o_orderstatus <> 'O' THEN o_orderdate END AS claimed_at,
         o_orderdate AS created_at
  FROM orders)""",
}

_NEEDS = {
    "stg_products": ["raw_products"],
    "dim_products": ["raw_products", "stg_products"],
}


def with_sql(*names: str) -> str:
    """``WITH`` clause that defines the named shop tables (and what they need), in order."""
    wanted = {n for name in names for n in [*_NEEDS.get(name, []), name]}
    return "WITH " + ",\n".join(sql for name, sql in CTE.items() if name in wanted)
