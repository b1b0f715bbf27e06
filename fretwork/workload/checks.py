"""Transcript checks, contracts and cross-mart questions over the given tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from fretwork.operators import checks
from fretwork.plans import analytics, marts, staging
from fretwork.session import materialize
from fretwork.workload import shop


def _products(spark, sf_dir):
    return marts.dim_products(staging.stg_products(shop.raw_products(spark, sf_dir)))


def scenario_turns(spark, sf_dir):
    """Every assistant turn of every conversation as a judged turn."""
    conv, turn = F.col("conv_id"), F.col("turn")
    ids = F.array(shop.product_key(conv % 97), shop.product_key(turn * 11), shop.product_key(conv % 97))
    return shop.table(spark, sf_dir, "conversations").where("role = 'assistant'").select(
        conv.alias("scenario"),
        "turn",
        F.concat("text", F.lit(" $"), (conv * 10 + turn).cast("string"), F.lit(".50")).alias("reply"),
        F.when(turn % 4 == 3, F.array().cast("array<string>")).otherwise(ids).alias("rec_ids"),
        (turn > 3).alias("handoff_logged"),
        (F.length("text") > 1500).alias("error"),
    )


def scenario_rules(spark, sf_dir):
    """Every check for each of these turns, with its arguments; some for turns and scenarios that never took place."""
    args = F.array(
        *[
            F.struct(
                F.lit(check).alias("check"),
                F.array(*[F.lit(p) for p in phrases]).cast("array<string>").alias("phrases"),
                F.lit(lo).cast("double").alias("lo"),
                F.lit(hi).cast("double").alias("hi"),
                F.lit(category).cast("string").alias("category"),
            )
            for check, phrases, lo, hi, category in RULES
        ]
    )
    scenario = F.col("conv_id")
    places = [F.when(scenario % 10 == 0, F.struct(scenario.alias("scenario"), (F.col("turn") + 1000).alias("turn")))]
    places += [F.when(scenario % 25 == 0, F.struct((-scenario - 1).alias("scenario"), F.col("turn")))]
    places = F.filter(F.array(F.struct(scenario.alias("scenario"), F.col("turn")), *places), lambda p: p.isNotNull())
    keys = shop.table(spark, sf_dir, "conversations").where("role = 'assistant'").select(F.explode(places).alias("at"))
    keys = keys.select("at.*", F.posexplode(args).alias("n", "rule"))
    name = F.concat_ws("-", F.col("scenario").cast("string"), F.col("turn").cast("string"), F.col("n").cast("string"))
    return keys.select(name.alias("rule_id"), "scenario", "turn", "rule.*")


RULES = [
    ("price_range", [], 100, 700, None),
    ("no_price_range", [], 400, 500, None),
    ("contains", ["la", "er"], None, None, None),
    ("any_contains", ["ment", "heit", "person"], None, None, None),
    ("not_contains", ["the the", "zu"], None, None, None),
    ("handoff_logged", [], None, None, None),
    ("no_handoff", [], None, None, None),
    ("recommended_category", [], None, None, "promo"),
    ("recommended_prices", [], 300, 1500, None),
]


def _judged(spark, sf_dir):
    """The turns, written once since they are read several times, and the verdicts on them."""
    turns = materialize(scenario_turns(spark, sf_dir), "turns")
    rules = materialize(scenario_rules(spark, sf_dir), "rules")
    return turns, checks.evaluate(turns, rules, _products(spark, sf_dir))


def scenario_checks(spark, sf_dir):
    return _judged(spark, sf_dir)[1]


def scenario_rollup(spark, sf_dir):
    return checks.scenario_results(*_judged(spark, sf_dir))


def run_summary(spark, sf_dir):
    return checks.run_summary(scenario_rollup(spark, sf_dir), "1")


def rec_price_check(spark, sf_dir):
    """Every order as a turn whose products are judged by category and price."""
    lines = shop.table(spark, sf_dir, "lineitem").select(
        F.col("l_orderkey").alias("scenario"), F.lit(0).alias("turn"), F.array(shop.product_key(F.col("l_partkey"))).alias("rec_ids")
    )
    rules = []
    orders = shop.table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("scenario"), F.lit(0).alias("turn"))
    for check, lo, hi, category in [("recommended_category", None, None, "SMALL"), ("recommended_prices", 0, 80, None)]:
        rules.append(
            orders.select(
                F.concat(F.lit(check + "-"), F.col("scenario").cast("string")).alias("rule_id"), "scenario", "turn",
                F.lit(check).alias("check"), F.lit(lo).cast("double").alias("lo"), F.lit(hi).cast("double").alias("hi"),
                F.lit(category).cast("string").alias("category"),
            )
        )
    return checks.product_verdicts(lines, rules[0].unionAll(rules[1]), _products(spark, sf_dir))


def mart_contracts(spark, sf_dir):
    orders = staging.stg_orders(shop.raw_orders(spark, sf_dir))
    return checks.mart_contracts(
        materialize(_products(spark, sf_dir), "dim_products"),
        staging.stg_customers(shop.raw_customers(spark, sf_dir)),
        orders,
        shop.agent_handoffs(spark, sf_dir),
        marts.inventory(shop.raw_inventory(spark, sf_dir)),
    )


def table_contracts(spark, sf_dir):
    t = {n: shop.table(spark, sf_dir, n) for n in ["customer", "orders", "lineitem", "part", "events", "labels", "documents"]}
    return checks.contract_report(
        {
            "customer key": checks.duplicate_keys(t["customer"], ["c_custkey"]),
            "line key": checks.duplicate_keys(t["lineitem"].select("l_orderkey", "l_linenumber"), ["l_orderkey", "l_linenumber"]),
            "event type": checks.unexpected_values(t["events"], "event_type", ["view", "click", "purchase"]),
            "order customer": checks.orphans(t["orders"], "o_custkey", t["customer"], "c_custkey"),
            "line order": checks.orphans(t["lineitem"], "l_orderkey", t["orders"], "o_orderkey"),
            "label document": checks.orphans(t["labels"], "doc_id", t["documents"], "doc_id"),
        }
    )


def recommendations(spark, sf_dir):
    """A recommendation per order: to its customer, for the part with the customer's or the order's number."""
    orders = shop.table(spark, sf_dir, "orders")
    n_lines = shop.table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("o_orderkey"), "l_partkey")
    return orders.join(n_lines, "o_orderkey").select(
        shop.customer_key(F.col("o_custkey")).alias("customer_id"),
        shop.product_key(F.when(F.col("o_orderstatus") == "O", F.col("l_partkey")).otherwise(F.col("l_partkey") + 1)).alias("product_id"),
        (F.col("o_orderdate").cast("timestamp") + F.expr("INTERVAL 1 HOUR")).alias("created_at"),
    ).distinct()


def not_owned(spark, sf_dir):
    bought = marts.customer_products(staging.stg_orders(shop.raw_orders(spark, sf_dir)))
    left = analytics.not_owned(recommendations(spark, sf_dir).select("customer_id", "product_id").distinct(), bought)
    return left


def rec_conversion(spark, sf_dir):
    orders = staging.stg_orders(shop.raw_orders(spark, sf_dir))
    found = analytics.conversion(recommendations(spark, sf_dir), orders)
    return found.select(
        "customer_id", "product_id", F.date_format("created_at", "yyyy-MM-dd").alias("created_on"),
        F.col("converted_on").cast("string").alias("converted_on"),
    )


QUERIES = {
    "scenario_checks": scenario_checks,
    "scenario_rollup": scenario_rollup,
    "run_summary": run_summary,
    "rec_price_check": rec_price_check,
    "mart_contracts": mart_contracts,
    "table_contracts": table_contracts,
    "not_owned": not_owned,
    "rec_conversion": rec_conversion,
}

_TURNS = f"""{shop.with_sql("dim_products")}, turns AS (
  SELECT conv_id, turn, text || ' $' || CAST(conv_id * 10 + turn AS VARCHAR) || '.50' AS reply,
         CASE WHEN turn % 4 = 3 THEN [] ELSE [{shop.sql_product_key("conv_id % 97")}, {shop.sql_product_key("turn * 11")}] END AS ids,
         turn > 3 AS logged, length(text) > 1500 AS error
  FROM conversations WHERE role = 'assistant'),
 prices AS (SELECT *, list_transform(regexp_extract_all(reply, '\\$(\\d[\\d,]*(?:\\.\\d+)?)', 1),
                                     lambda x: CAST(replace(x, ',', '') AS DOUBLE)) AS p FROM turns),
 recs AS (SELECT conv_id, turn, bool_or(contains(lower(category), 'promo') OR contains(lower(subcategory), 'promo')) AS cat_ok,
                 bool_or(CAST(price AS DOUBLE) BETWEEN 300 AND 1500) AS price_ok
          FROM (SELECT DISTINCT conv_id, turn, unnest(ids) AS product_id FROM turns) JOIN dim_products USING (product_id)
          GROUP BY ALL),
 one AS (SELECT t.*, coalesce(cat_ok, false) AS cat_ok, coalesce(price_ok, false) AS price_ok,
                contains(lower(reply), 'la') AS a, contains(lower(reply), 'er') AS b,
                contains(lower(reply), 'the the') AS c, contains(lower(reply), 'zu') AS d
         FROM prices t LEFT JOIN recs USING (conv_id, turn)),
 verdicts AS (
  SELECT conv_id, turn, unnest(range(9)) AS n,
         unnest(['price_range', 'no_price_range', 'contains', 'any_contains', 'not_contains', 'handoff_logged', 'no_handoff',
                 'recommended_category', 'recommended_prices']) AS check_name,
         unnest([len(list_filter(p, lambda x: x BETWEEN 100 AND 700)) > 0, len(list_filter(p, lambda x: x BETWEEN 400 AND 500)) = 0,
                 a AND b, contains(lower(reply), 'ment') OR contains(lower(reply), 'heit') OR contains(lower(reply), 'person'),
                 NOT c AND NOT d, logged, NOT logged, cat_ok, price_ok]) AS passed,
         unnest(['', '', concat_ws(', ', CASE WHEN NOT a THEN 'la' END, CASE WHEN NOT b THEN 'er' END), '',
                 concat_ws(', ', CASE WHEN c THEN 'the the' END, CASE WHEN d THEN 'zu' END), '', '', '', '']) AS detail
  FROM one),
 absent AS (
  SELECT conv_id, turn, n, check_name, false AS passed, 'no such turn' AS detail FROM (
    SELECT conv_id, turn + 1000 AS turn, n, check_name FROM verdicts WHERE conv_id % 10 = 0
    UNION ALL SELECT -conv_id - 1, turn, n, check_name FROM verdicts WHERE conv_id % 25 = 0)),
 every AS (SELECT * FROM verdicts UNION ALL SELECT * FROM absent),
 results AS (
  SELECT coalesce(t.conv_id, v.conv_id) AS scenario, coalesce(n_turns, 0) AS n_turns, coalesce(n_failed, 0) AS n_failed,
         coalesce(n_failed, 0) = 0 AND NOT coalesce(had_error, false) AS passed
  FROM (SELECT conv_id, count(*) AS n_turns, bool_or(error) AS had_error FROM turns GROUP BY 1) t
  FULL JOIN (SELECT conv_id, count(*) FILTER (NOT passed) AS n_failed FROM every GROUP BY 1) v ON t.conv_id = v.conv_id)"""

RECS_SQL = f""", recs AS (
  SELECT DISTINCT {shop.sql_customer_key("o_custkey")} AS customer_id,
         {shop.sql_product_key("CASE WHEN o_orderstatus = 'O' THEN l_partkey ELSE l_partkey + 1 END")} AS product_id,
         o_orderdate + INTERVAL 1 HOUR AS created_at
  FROM orders JOIN lineitem ON l_orderkey = o_orderkey)"""

ORACLE = {
    "scenario_checks": _TURNS
    + """ SELECT concat_ws('-', conv_id, turn, n) AS rule_id, conv_id AS scenario, turn, check_name AS "check", passed, detail
          FROM every""",
    "scenario_rollup": _TURNS + " SELECT * FROM results",
    "run_summary": _TURNS
    + """ SELECT count(*) FILTER (passed) AS passed, count(*) FILTER (NOT passed) AS failed FROM results
          WHERE contains(CAST(scenario AS VARCHAR), '1')""",
    "rec_price_check": shop.with_sql("dim_products")
    + f""", known AS (SELECT l_orderkey, bool_or(contains(lower(category), 'small') OR contains(lower(subcategory), 'small')) AS fits,
                             bool_or(price BETWEEN 0 AND 80) AS cheap
                      FROM lineitem JOIN dim_products p ON p.product_id = {shop.sql_product_key("l_partkey")} GROUP BY l_orderkey)
      SELECT 'recommended_category-' || CAST(o_orderkey AS VARCHAR) AS rule_id, coalesce(fits, false) AS passed
      FROM orders LEFT JOIN known ON l_orderkey = o_orderkey
      UNION ALL SELECT 'recommended_prices-' || CAST(o_orderkey AS VARCHAR), coalesce(cheap, false)
      FROM orders LEFT JOIN known ON l_orderkey = o_orderkey""",
    "mart_contracts": shop.with_sql("dim_products", "raw_customers", "stg_orders", "agent_handoffs", "inventory")
    + """ SELECT 'dim_products.product_id unique' AS contract, count(*) AS n_violations
            FROM (SELECT 1 FROM dim_products GROUP BY product_id HAVING count(*) > 1)
          UNION ALL SELECT 'dim_products.name_price unique', count(*)
            FROM (SELECT 1 FROM dim_products GROUP BY product_name, price HAVING count(*) > 1)
          UNION ALL SELECT 'dim_products.price_tier accepted', count(*) FROM dim_products
            WHERE price_tier NOT IN ('budget', 'entry', 'mid-range', 'premium')
          UNION ALL SELECT 'dim_customers.customer_id unique', count(*)
            FROM (SELECT 1 FROM raw_customers GROUP BY customer_id HAVING count(*) > 1)
          UNION ALL SELECT 'stg_orders.customer_id known', count(*) FROM stg_orders
            WHERE customer_id NOT IN (SELECT customer_id FROM raw_customers)
          UNION ALL SELECT 'stg_orders.product_id known', count(*) FROM stg_orders
            WHERE product_id NOT IN (SELECT product_id FROM dim_products)
          UNION ALL SELECT 'agent_handoffs.handoff_id unique', count(*)
            FROM (SELECT 1 FROM agent_handoffs GROUP BY handoff_id HAVING count(*) > 1)
          UNION ALL SELECT 'agent_handoffs.status accepted', count(*) FROM agent_handoffs
            WHERE status IS NULL OR status NOT IN ('new', 'claimed', 'closed')
          UNION ALL SELECT 'agent_handoffs.priority accepted', count(*) FROM agent_handoffs
            WHERE priority IS NULL OR priority NOT IN ('high', 'medium', 'low')
          UNION ALL SELECT 'inventory.product_id known', count(*) FROM inventory
            WHERE product_id NOT IN (SELECT product_id FROM dim_products)""",
    "table_contracts": """
      SELECT 'customer key' AS contract, count(*) AS n_violations FROM (SELECT 1 FROM customer GROUP BY c_custkey HAVING count(*) > 1)
      UNION ALL SELECT 'line key', count(*) FROM (SELECT 1 FROM lineitem GROUP BY l_orderkey, l_linenumber HAVING count(*) > 1)
      UNION ALL SELECT 'event type', count(*) FROM events WHERE event_type NOT IN ('view', 'click', 'purchase')
      UNION ALL SELECT 'order customer', count(*) FROM orders WHERE o_custkey NOT IN (SELECT c_custkey FROM customer)
      UNION ALL SELECT 'line order', count(*) FROM lineitem WHERE l_orderkey NOT IN (SELECT o_orderkey FROM orders)
      UNION ALL SELECT 'label document', count(*) FROM labels WHERE doc_id NOT IN (SELECT doc_id FROM documents)""",
    "not_owned": shop.with_sql("stg_orders")
    + RECS_SQL
    + """ SELECT DISTINCT customer_id, product_id FROM recs
          WHERE (customer_id, product_id) NOT IN (SELECT customer_id, product_id FROM stg_orders)""",
    "rec_conversion": shop.with_sql("stg_orders")
    + RECS_SQL
    + """ SELECT r.customer_id, r.product_id, strftime(r.created_at, '%Y-%m-%d') AS created_on,
             CAST(min(s.order_date) AS VARCHAR) AS converted_on
          FROM recs r LEFT JOIN stg_orders s ON s.customer_id = r.customer_id AND s.product_id = r.product_id
           AND s.order_date >= r.created_at GROUP BY r.customer_id, r.product_id, r.created_at""",
}
