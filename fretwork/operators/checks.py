"""Checks of chat transcripts, driven by a table of rules, and contracts of the marts."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from fretwork.functions.text import contains_ci, found_phrases, quoted_prices

TURN = ["scenario", "turn"]
TEXT_CHECKS = ["price_range", "no_price_range", "contains", "any_contains", "not_contains", "handoff_logged", "no_handoff"]
PRODUCT_CHECKS = ["recommended_category", "recommended_prices"]
NO_TURN = "no such turn"


def price_in_range(text: Column, low: Column, high: Column) -> Column:
    """Some quoted price lies in the range; a text without prices fails."""
    return F.exists(quoted_prices(F.coalesce(text, F.lit(""))), lambda p: p.between(low, high))


def _missing() -> Column:
    return F.filter("phrases", lambda p: ~F.array_contains("_found", p))


def text_verdict() -> Column:
    """Outcome of a check that needs only the turn itself, from the phrases ``_found`` in it; NULL for other checks."""
    check = F.col("check")
    quoted = price_in_range(F.col("reply"), F.col("lo"), F.col("hi"))
    return (
        F.when(check == "price_range", quoted)
        .when(check == "no_price_range", ~quoted)
        .when(check == "contains", F.size(_missing()) == 0)
        .when(check == "any_contains", F.size("_found") > 0)
        .when(check == "not_contains", F.size("_found") == 0)
        .when(check == "handoff_logged", F.coalesce("handoff_logged", F.lit(False)))
        .when(check == "no_handoff", ~F.coalesce("handoff_logged", F.lit(False)))
    )


def text_detail() -> Column:
    """Phrases at fault, for the report."""
    return (
        F.when(F.col("check") == "contains", F.array_join(_missing(), ", "))
        .when(F.col("check") == "not_contains", F.array_join("_found", ", "))
        .otherwise(F.lit(""))
    )


def product_verdicts(turns: DataFrame, rules: DataFrame, products: DataFrame) -> DataFrame:
    """Outcome of the checks on recommended products, one row per rule: rule_id, passed.

    Category: some known recommended product matches category or subcategory. Prices: not all known products
    lie outside the range. Without any known product a rule fails.
    """
    asked = rules.where(F.col("check").isin(PRODUCT_CHECKS))
    listed = turns.select(*TURN, F.explode(F.array_distinct("rec_ids")).alias("product_id"))
    known = listed.join(products.select("product_id", "category", "subcategory", "price"), "product_id")
    categories = known.select(*TURN, F.explode(F.array("category", "subcategory")).alias("_text")).distinct()
    prices = known.select(*TURN, F.col("price").cast("double").alias("_price")).distinct()
    by_category = asked.where(F.col("check") == PRODUCT_CHECKS[0]).join(categories, TURN)
    by_price = asked.where(F.col("check") == PRODUCT_CHECKS[1]).join(prices, TURN)
    good = by_category.where(contains_ci(F.col("_text"), F.col("category"))).select("rule_id").unionAll(
        by_price.where(F.col("_price").between(F.col("lo"), F.col("hi"))).select("rule_id")
    )
    met = good.distinct().withColumn("_good", F.lit(True))
    return asked.select("rule_id").join(met, "rule_id", "left").select("rule_id", F.coalesce("_good", F.lit(False)).alias("passed"))


def evaluate(turns: DataFrame, rules: DataFrame, products: DataFrame) -> DataFrame:
    """One row per rule: rule_id, scenario, turn, check, passed, detail.

    ``turns``: scenario, turn, reply, rec_ids, handoff_logged. ``rules``: rule_id, scenario, turn, check,
    phrases, lo, hi, category. A rule for a turn that never took place fails, whatever it asks for.
    """
    there = turns.select(*TURN, "reply", "handoff_logged", F.lit(True).alias("_there"))
    both = rules.join(there, TURN, "left").withColumn("_found", found_phrases(F.col("reply"), F.col("phrases")))
    judged = both.select(
        "rule_id", *TURN, "check", "_there", text_verdict().alias("_text"), text_detail().alias("_detail")
    )
    by_products = product_verdicts(turns, rules, products).withColumnRenamed("passed", "_passed")
    outcome = F.when(F.col("_there"), F.coalesce("_text", "_passed", F.lit(False))).otherwise(False)
    detail = F.when(F.col("_there"), F.col("_detail")).otherwise(NO_TURN)
    return judged.join(by_products, "rule_id", "left").select("rule_id", *TURN, "check", outcome.alias("passed"), detail.alias("detail"))


def scenario_results(turns: DataFrame, verdicts: DataFrame) -> DataFrame:
    """Per scenario of turns or rules: passed, failed checks. A turn that ended in an error fails its scenario."""
    errors = turns.groupBy("scenario").agg(
        F.count(F.lit(1)).alias("n_turns"), F.bool_or(F.coalesce("error", F.lit(False))).alias("had_error")
    )
    checks = verdicts.groupBy("scenario").agg(F.count_if(~F.col("passed")).alias("n_failed"))
    failed = F.coalesce("n_failed", F.lit(0))
    return errors.join(checks, "scenario", "full").select(
        "scenario", F.coalesce("n_turns", F.lit(0)).alias("n_turns"), failed.alias("n_failed"),
        ((failed == 0) & ~F.coalesce("had_error", F.lit(False))).alias("passed"),
    )


def run_summary(results: DataFrame, name_filter: str = "") -> DataFrame:
    """Passed and failed scenarios among those whose name contains the filter."""
    chosen = results.where(contains_ci(F.col("scenario").cast("string"), F.lit(name_filter)))
    return chosen.agg(F.count_if("passed").alias("passed"), F.count_if(~F.col("passed")).alias("failed"))


def duplicate_keys(df: DataFrame, keys: list[str]) -> DataFrame:
    return df.groupBy(*keys).agg(F.count(F.lit(1)).alias("n_rows")).where("n_rows > 1")


def unexpected_values(df: DataFrame, column: str, allowed: list[str]) -> DataFrame:
    return df.where(F.col(column).isNull() | ~F.col(column).isin(allowed))


def orphans(df: DataFrame, column: str, parent: DataFrame, parent_column: str) -> DataFrame:
    """Rows whose (non-NULL) reference has no parent row."""
    keys = parent.select(F.col(parent_column).alias(column)).distinct()
    return df.where(F.col(column).isNotNull()).join(keys, column, "left_anti")


def contract_report(violations: dict[str, DataFrame]) -> DataFrame:
    """Number of violating rows per contract, also where there is none."""
    counts = [
        rows.agg(F.count(F.lit(1)).alias("n_violations")).select(F.lit(name).alias("contract"), "n_violations")
        for name, rows in violations.items()
    ]
    return reduce(DataFrame.unionAll, counts)


def key_and_values(df: DataFrame, keys: list[str], accepted: dict[str, list[str]], names: list[str]) -> DataFrame:
    """Contracts of one table in one pass: unique ``keys``, then the accepted values of each column; ``names`` in that order."""
    bad = {c: F.count_if(F.col(c).isNull() | ~F.col(c).isin(allowed)).alias(f"_{c}") for c, allowed in accepted.items()}
    per_key = df.groupBy(*keys).agg(F.count(F.lit(1)).alias("_n"), *bad.values())
    sums = per_key.agg(F.count_if(F.col("_n") > 1).alias("_keys"), *[F.coalesce(F.sum(f"_{c}"), F.lit(0)).alias(f"_{c}") for c in accepted])
    return _as_report(sums, dict(zip(names, ["_keys", *[f"_{c}" for c in accepted]], strict=True)))


def references(df: DataFrame, parents: dict[str, tuple[DataFrame, str]], names: list[str]) -> DataFrame:
    """Orphans of several reference columns of one table, from one pass that counts its distinct combinations."""
    rows = df.groupBy(*parents).agg(F.count(F.lit(1)).alias("_n"))
    for column, (parent, key) in parents.items():
        known = parent.select(F.col(key).alias(column)).distinct().withColumn(f"_{column}", F.lit(True))
        rows = rows.join(known, column, "left")
    missing = {c: F.coalesce(F.sum(F.when(F.col(c).isNotNull() & F.col(f"_{c}").isNull(), F.col("_n"))), F.lit(0)).alias(f"_{c}") for c in parents}
    return _as_report(rows.agg(*missing.values()), dict(zip(names, [f"_{c}" for c in parents], strict=True)))


def _as_report(sums: DataFrame, columns: dict[str, str]) -> DataFrame:
    rows = F.array(*[F.struct(F.lit(name).alias("contract"), F.col(c).alias("n_violations")) for name, c in columns.items()])
    return sums.select(F.explode(rows).alias("r")).select("r.*")


def mart_contracts(
    products: DataFrame, customers: DataFrame, orders: DataFrame, handoffs: DataFrame, stock: DataFrame
) -> DataFrame:
    """Keys, accepted values and references of the marts, each table read once per kind of contract."""
    tiers = {"price_tier": ["budget", "entry", "mid-range", "premium"]}
    states = {"status": ["new", "claimed", "closed"], "priority": ["high", "medium", "low"]}
    parents = {"customer_id": (customers, "customer_id"), "product_id": (products, "product_id")}
    parts = [
        key_and_values(products, ["product_id"], tiers, ["dim_products.product_id unique", "dim_products.price_tier accepted"]),
        key_and_values(products, ["product_name", "price"], {}, ["dim_products.name_price unique"]),
        key_and_values(customers, ["customer_id"], {}, ["dim_customers.customer_id unique"]),
        references(orders, parents, ["stg_orders.customer_id known", "stg_orders.product_id known"]),
        key_and_values(
            handoffs, ["handoff_id"], states,
            ["agent_handoffs.handoff_id unique", "agent_handoffs.status accepted", "agent_handoffs.priority accepted"],
        ),
        references(stock, {"product_id": (products, "product_id")}, ["inventory.product_id known"]),
    ]
    return reduce(DataFrame.unionAll, parts)
