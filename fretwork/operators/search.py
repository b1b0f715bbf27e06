"""Catalogue search for a whole table of requests at once.

A request gives optional texts (category, skill_level, use_case, brand), price bounds and a target
price, and gets its best ``k`` products in stock. Products are ordered by distance to the target price,
else by the rank of the request's candidate list, else cheapest first.

Requests with candidates join the catalogue by product id. All others go through *price ladders*, so
that neither a cross join nor a scan of all products per request is needed:

1. Text filters are matched once against the distinct facet values, through an equi-join on short grams.
   Products are grouped into cells of equal facet values, and each distinct combination of filter texts
   selects its cells among those that exist, through its most selective text.
2. The ladder of a filter combination has one rung per price with the first ``k`` product ids there (no
   other product can win). The rungs are numbered by price.
3. The bounds and the target of a request become ladder positions. Its winners lie on at most ``k`` rungs
   on each side of the target, or on the first ``k`` rungs from its lower bound; these are equi-joined.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from fretwork.functions.money import NO_PRICE, price_cents
from fretwork.functions.ranking import running_total, top_k
from fretwork.functions.text import optional_contains
from fretwork.session import materialize

TEXT_FILTERS = ["category", "skill_level", "use_case", "brand"]
PRICE_FILTERS = ["min_price", "max_price", "target_price"]
RESULT_COLUMNS = [
    "product_id", "product_name", "brand", "subcategory", "price", "skill_level", "use_case", "price_tier",
]
GRAM = 3
MARKS = ["_below", "_up_to", "_target"]
LOWEST = -(1 << 60)


def normalize_requests(requests: DataFrame) -> DataFrame:
    """Requests with all filter columns; texts in lower case with '' for "no filter", prices as decimals."""
    present = set(requests.columns)
    texts = [
        (F.lower(F.coalesce(F.col(f), F.lit(""))) if f in present else F.lit("")).alias(f) for f in TEXT_FILTERS
    ]
    prices = [
        (F.col(p) if p in present else F.lit(None)).cast("decimal(18,4)").alias(p) for p in PRICE_FILTERS
    ]
    return requests.select("request_id", *texts, *prices)


def grams_of(text: Column, n: int) -> Column:
    """All runs of ``n`` characters; a text without that many gives itself cut short."""
    last = F.greatest(F.length(text) - (n - 1), F.lit(1))
    return F.transform(F.sequence(F.lit(1), last), lambda i: text.substr(i, F.lit(n)))


def contains_matches(patterns: DataFrame, values: DataFrame) -> DataFrame:
    """Rows (field, pattern, value) where the text of a value contains the pattern, ignoring case.

    ``patterns``: field and distinct lower-case pattern; ``values``: field, value, text. A pattern is looked up
    by that of its grams which the fewest values have, and then checked in full; patterns that all start
    alike do not meet all values that way. The empty pattern stands for "no filter" and pairs with the
    empty value.
    """
    text = F.lower("text")
    every = F.array_distinct(F.concat(*[grams_of(text, n) for n in range(1, GRAM + 1)]))
    by_gram = values.select("field", "value", text.alias("_text"), F.explode(every).alias("_gram"))
    spread = by_gram.groupBy("field", "_gram").agg(F.count(F.lit(1)).alias("_n"))
    asked = patterns.where("pattern <> ''").select("field", "pattern", F.explode(grams_of(F.col("pattern"), GRAM)).alias("_gram"))
    rarest = F.min(F.struct(F.coalesce("_n", F.lit(0)), "_gram"))["_gram"].alias("_gram")
    keyed = asked.join(spread, ["field", "_gram"], "left").groupBy("field", "pattern").agg(rarest)
    hits = keyed.join(by_gram, ["field", "_gram"]).where(F.contains("_text", F.col("pattern")))
    blank = patterns.where("pattern = ''").select("field", "pattern", F.lit("").alias("value"))
    return hits.select("field", "pattern", "value").unionByName(blank).distinct()


def in_stock_facets(catalog: DataFrame) -> DataFrame:
    """Facet values and price of the products in stock; the category facet is the pair with subcategory."""
    return catalog.where(F.col("in_stock")).select(
        "product_id",
        price_cents(F.col("price")).alias("_cents"),
        F.to_json(F.array("category", "subcategory")).alias("_category"),
        *[F.coalesce(F.col(f), F.lit("")).alias(f"_{f}") for f in TEXT_FILTERS[1:]],
        "category",
        "subcategory",
    )


def facet_values(reduced: DataFrame) -> DataFrame:
    """Distinct values of all facets with the texts that a filter may match: field, value, text."""
    texts = [("category", "category"), ("category", "subcategory"), *[(f, f"_{f}") for f in TEXT_FILTERS[1:]]]
    entries = [
        F.struct(F.lit(f).alias("field"), F.col(f"_{f}").alias("value"), F.coalesce(F.col(t), F.lit("")).alias("text"))
        for f, t in texts
    ]
    return reduced.select(F.explode(F.array(*entries)).alias("e")).select("e.*").distinct()


def filter_patterns(questions: DataFrame) -> DataFrame:
    """Distinct filter texts of all questions: field, pattern."""
    entries = [F.struct(F.lit(f).alias("field"), F.col(f).alias("pattern")) for f in TEXT_FILTERS]
    return questions.select(F.explode(F.array(*entries)).alias("e")).select("e.*").distinct()


def filter_mask() -> Column:
    """Bit set of the text filters that a request uses."""
    bits = [F.when(F.col(f) != "", F.lit(1 << i)).otherwise(F.lit(0)) for i, f in enumerate(TEXT_FILTERS)]
    return sum(bits[1:], bits[0])


def cell_key() -> Column:
    """Name of the cell: the mask and the values of the facets in it."""
    values = [
        F.when(F.col("_mask").bitwiseAND(1 << i) != 0, F.col(f"_{f}")).otherwise(F.lit(""))
        for i, f in enumerate(TEXT_FILTERS)
    ]
    return F.to_json(F.array(F.col("_mask").cast("string"), *values))


def first_ids(facets: DataFrame, k: int) -> DataFrame:
    """The catalogue reduced to ``k`` ids per facet combination and price: no other product can win."""
    keys = [*[f"_{f}" for f in TEXT_FILTERS], "_cents"]
    return top_k(facets, keys, [F.col("product_id").asc_nulls_last()], k, "_rn").drop("_rn")


def price_points(reduced: DataFrame, masks: DataFrame, k: int) -> DataFrame:
    """Products of the cells of all masks in use, at most ``k`` per cell and price.

    There are at most 16 masks, so that side is always small enough to broadcast.
    """
    all_masks = F.sequence(F.lit(0), F.lit((1 << len(TEXT_FILTERS)) - 1))
    repeated = reduced.withColumn("_mask", F.explode(all_masks)).join(F.broadcast(masks), "_mask", "left_semi")
    cells = repeated.select(cell_key().alias("_cell"), "_cents", "product_id")
    return top_k(cells, ["_cell", "_cents"], [F.col("product_id").asc_nulls_last()], k, "_rn").drop("_rn")


def existing_cells(reduced: DataFrame, masks: DataFrame) -> DataFrame:
    """Every combination of facet values that some product has, under each mask in use: _mask, _cell and the values."""
    values = [
        F.when(F.col("_mask").bitwiseAND(1 << i) != 0, F.col(f"_{f}")).otherwise(F.lit("")).alias(f"_{f}")
        for i, f in enumerate(TEXT_FILTERS)
    ]
    facets = reduced.select(*[f"_{f}" for f in TEXT_FILTERS]).distinct()
    all_masks = F.sequence(F.lit(0), F.lit((1 << len(TEXT_FILTERS)) - 1))
    repeated = facets.withColumn("_mask", F.explode(all_masks)).join(F.broadcast(masks), "_mask", "left_semi")
    return repeated.select("_mask", *values).distinct().withColumn("_cell", cell_key())


def matching_cells(questions: DataFrame, reduced: DataFrame) -> DataFrame:
    """The existing cells that each distinct combination of filter texts selects.

    Of the filters in use the one whose values stand in the fewest cells leads to the cells; the other filters are then checked
    on those. So the work follows the cells that exist, not the product of the facets' values.
    """
    wanted = questions.select("_filter", "_mask", *TEXT_FILTERS).distinct()
    hits = materialize(contains_matches(filter_patterns(questions), facet_values(reduced)).where("pattern <> ''"), "search_matches")
    cells = materialize(existing_cells(reduced, questions.select("_mask").distinct()), "search_cells")
    entry = F.explode(F.filter(F.array(*[F.struct(F.lit(f).alias("field"), F.col(f"_{f}").alias("value")) for f in TEXT_FILTERS]), lambda e: e["value"] != ""))
    by_value = cells.select("_mask", "_cell", *[f"_{f}" for f in TEXT_FILTERS], entry.alias("_e")).select("*", "_e.field", "_e.value").drop("_e")
    sizes = by_value.groupBy("_mask", "field", "value").agg(F.count(F.lit(1)).alias("_n"))
    weights = hits.join(sizes, ["field", "value"]).groupBy("_mask", "field", "pattern").agg(F.sum("_n").alias("_n"))

    used = F.filter(F.array(*[F.struct(F.lit(f).alias("field"), F.col(f).alias("pattern")) for f in TEXT_FILTERS]), lambda e: e["pattern"] != "")
    asked = wanted.select("_filter", "_mask", F.explode(used).alias("_u")).select("_filter", "_mask", "_u.*")
    weighed = asked.join(weights, ["_mask", "field", "pattern"], "left")
    fewest = F.min(F.struct(F.coalesce("_n", F.lit(0)).alias("n"), "field", "pattern"))
    lead = weighed.groupBy("_filter", "_mask").agg(fewest.alias("_l")).select("_filter", "_mask", "_l.field", "_l.pattern")
    found = lead.join(hits, ["field", "pattern"]).join(by_value, ["_mask", "field", "value"])
    found = found.select("_filter", "_cell", *[f"_{f}" for f in TEXT_FILTERS]).join(wanted.select("_filter", *TEXT_FILTERS), "_filter")
    for name in TEXT_FILTERS:
        fits = hits.where(F.col("field") == name).select(F.col("pattern").alias(name), F.col("value").alias(f"_{name}"))
        # A filter that is not used has '' on both sides.
        found = found.join(fits.unionByName(_blank(hits.sparkSession, name)), [name, f"_{name}"], "left_semi")
    free = wanted.where("_mask = 0").join(cells.where("_mask = 0").select("_mask", "_cell"), "_mask")
    return found.select("_filter", "_cell").unionByName(free.select("_filter", "_cell"))


def _blank(spark: SparkSession, name: str) -> DataFrame:
    return spark.createDataFrame([("", "")], f"{name} string, _{name} string")


def filter_rungs(cells: DataFrame, points: DataFrame, k: int) -> DataFrame:
    """One row per filter combination and price, with the first ``k`` product ids of all its cells."""
    rows = cells.join(points, "_cell").select("_filter", "_cents", "product_id")
    kept = top_k(rows, ["_filter", "_cents"], [F.col("product_id").asc_nulls_last()], k, "_rn")
    return kept.groupBy("_filter", "_cents").agg(F.sort_array(F.collect_list("product_id")).alias("_ids"))


def ladder_bounds() -> list[Column]:
    """Bounds and target as "up to this many cents" values.

    A product without a price stands on the last rung, and only a request without price bounds gets there.
    """
    cents = {p: F.col(p) * 100 for p in PRICE_FILTERS}
    below_min = F.coalesce(F.ceil(cents["min_price"]).cast("bigint") - 1, F.lit(LOWEST))
    no_bounds = F.col("min_price").isNull() & F.col("max_price").isNull()
    up_to = F.coalesce(
        F.floor(cents["max_price"]).cast("bigint"),
        F.when(no_bounds, F.lit(NO_PRICE)).otherwise(F.lit(NO_PRICE - 1)),
    )
    target = F.floor(cents["target_price"]).cast("bigint")
    return [below_min.alias("_below"), up_to.alias("_up_to"), target.alias("_target")]


def wanted_rungs(k: int) -> Column:
    """Rungs that can hold winners: around the target, or from the lower bound upwards."""
    first, last = F.col("_rung_below") + 1, F.col("_rung_up_to")
    near = F.col("_rung_target")
    start = F.when(near.isNull(), first).otherwise(F.greatest(first, F.least(near, last) - (k - 1)))
    stop = F.when(near.isNull(), F.least(last, first + (k - 1))).otherwise(
        F.least(last, F.greatest(near + 1, first) + (k - 1))
    )
    return F.when(start <= stop, F.sequence(start, stop))


def ladder_search(catalog: DataFrame, requests: DataFrame, k: int) -> DataFrame:
    """Winners (request_id, product_id, rank) of normalized requests without candidates.

    Equal requests are answered once. Tables that later steps read several times are written out first.
    """
    texts = [F.col(c) for c in TEXT_FILTERS]
    prices = [F.col(c).cast("string") for c in PRICE_FILTERS]
    asked = requests.withColumn("question", F.to_json(F.array(*texts, *prices)))
    questions = materialize(
        asked.select("question", *TEXT_FILTERS, *PRICE_FILTERS)
        .distinct()
        .select("*", F.to_json(F.array(*texts)).alias("_filter"), filter_mask().alias("_mask"), *ladder_bounds()),
        "search_questions",
    )
    reduced = materialize(first_ids(in_stock_facets(catalog), k), "search_products")
    points = price_points(reduced, questions.select("_mask").distinct(), k)
    rungs = materialize(filter_rungs(matching_cells(questions, reduced), points, k), "search_rungs")
    rungs = rungs.withColumn("_is_rung", F.lit(1))

    # Number the prices of each ladder, and find how many of them lie at or below each bound.
    marks = questions.select("_filter", F.explode(F.array(*MARKS)).alias("_cents")).where(F.col("_cents").isNotNull())
    lookups = marks.distinct().select("*", F.lit(None).alias("_ids"), F.lit(0).alias("_is_rung"))
    both = rungs.unionByName(lookups)
    numbered = materialize(
        running_total(both, ["_filter"], "_cents", "_is_rung", "_rung", ties=[F.col("_is_rung").desc()]),
        "search_ladders",
    )
    positions = numbered.where("_is_rung = 0")
    ladder = numbered.where("_is_rung = 1").select("_filter", "_rung", F.col("_cents").alias("_price"), "_ids")

    placed = questions
    for mark in MARKS:
        at = positions.select("_filter", F.col("_cents").alias(mark), F.col("_rung").alias(f"_rung{mark}"))
        placed = placed.join(at, ["_filter", mark], "left")
    steps = placed.select("question", "target_price", "_filter", F.explode(wanted_rungs(k)).alias("_rung"))
    distance = F.abs(F.col("_price") - F.col("target_price") * 100)
    candidates = steps.join(ladder, ["_filter", "_rung"]).select(
        "question",
        F.explode("_ids").alias("product_id"),
        F.when(F.col("_price") != NO_PRICE, F.coalesce(distance, F.col("_price"))).cast("decimal(24,4)").alias("_order"),
    )
    order = [F.col("_order").asc_nulls_last(), F.col("product_id").asc_nulls_last()]
    winners = top_k(candidates, ["question"], order, k).select("question", "product_id", "rank")
    return asked.select("request_id", "question").join(winners, "question").drop("question")


def candidate_search(catalog: DataFrame, requests: DataFrame, candidates: DataFrame, k: int) -> DataFrame:
    """Winners (request_id, product_id, rank) among each request's own candidate products."""
    products = catalog.where(F.col("in_stock")).select(
        "product_id", "price", *[F.col(c).alias(f"_{c}") for c in [*TEXT_FILTERS, "subcategory"]]
    )
    rows = candidates.join(products, "product_id").join(requests, "request_id")
    texts = optional_contains(F.col("category"), F.col("_category"), F.col("_subcategory"))
    for name in TEXT_FILTERS[1:]:
        texts = texts & optional_contains(F.col(name), F.col(f"_{name}"))
    fits = (
        texts
        & (F.col("min_price").isNull() | (F.col("price") >= F.col("min_price")))
        & (F.col("max_price").isNull() | (F.col("price") <= F.col("max_price")))
    )
    order = [
        F.abs(F.col("price") - F.col("target_price")).asc_nulls_last(),
        F.when(F.col("target_price").isNull(), F.col("candidate_rank")).asc_nulls_last(),
        F.col("product_id").asc_nulls_last(),
    ]
    return top_k(rows.where(fits), ["request_id"], order, k).select("request_id", "product_id", "rank")


def catalog_search(catalog: DataFrame, requests: DataFrame, candidates: DataFrame | None = None, k: int = 3) -> DataFrame:
    """Best ``k`` products per request, with their rank.

    ``catalog``: the product mart. ``requests``: request_id and any of the filter columns.
    ``candidates``: request_id, product_id, candidate_rank; a request without any row there is not
    restricted to candidates. Catalogue and candidates are read more than once: pass written tables.
    """
    asked = normalize_requests(requests)
    if candidates is None:
        winners = ladder_search(catalog, asked, k)
    else:
        listed = candidates.select("request_id").distinct()
        winners = candidate_search(catalog, asked, candidates, k)
        rest = asked.join(listed, "request_id", "left_anti")
        if not rest.isEmpty():
            winners = winners.unionByName(ladder_search(catalog, rest, k))
    return winners.join(catalog.select(*RESULT_COLUMNS), "product_id").select("request_id", "rank", *RESULT_COLUMNS)
