"""Search and browsing against a plain loop over all products."""

from __future__ import annotations

import random
from decimal import Decimal

import pytest

from fretwork.operators.browse import browse, product_details, products_by_ids
from fretwork.operators.search import catalog_search, contains_matches

CATALOG = (
    "product_id string, product_name string, brand string, category string, subcategory string, price decimal(10,2),"
    " description string, skill_level string, use_case string, in_stock boolean, price_tier string, manufacturer_url string"
)
REQUEST = (
    "request_id bigint, category string, skill_level string, use_case string, brand string, min_price decimal(12,3),"
    " max_price decimal(12,3), target_price decimal(12,3)"
)


def products(seed: int, n: int = 160):
    rng = random.Random(seed)
    rows = []
    for i in range(n):
        price = rng.choice([None, Decimal("0.00"), Decimal(rng.randrange(1, 40)) * 5, Decimal(rng.randrange(100000)) / 100])
        category = rng.choice(["Guitar", "Drums", "Keys_50%", None])
        rows.append(
            (
                f"P{i:04d}", rng.choice(["Axe", "Axe Bundle", "Kit"]), rng.choice(["Fen", "Fender", "A%b", "", None]), category,
                rng.choice(["Electric Guitar", "Kit", "İstanbul", None]), price, f"text {i}",
                rng.choice(["beginner", "beginner-advanced", "advanced", None]), rng.choice(["home studio", "live", None]),
                rng.choice([True, True, True, False, None]), "tier", "",
            )
        )
    return rows


def requests(seed: int, n: int = 300):
    rng = random.Random(seed)
    price = lambda: rng.choice([None, None, Decimal("0"), Decimal(rng.randrange(0, 250000)) / 1000, Decimal("15"), Decimal("-3")])
    return [
        (
            i, rng.choice([None, "", "guitar", "KIT", "%", "_", "zither", "keys_50%", "u"]),
            rng.choice([None, None, "", "beginner", "ADV", "-"]), rng.choice([None, None, "home", "studio", "live x"]),
            rng.choice([None, None, "fen", "fender", "%b"]), price(), price(), price(),
        )
        for i in range(n)
    ]


def has(text, *values):
    return not text or any(text.lower() in v.lower() for v in values if v is not None)


def brute(rows, request, ranked=None, k=3):
    _, category, skill, use, brand, low, high, target = request
    fits = []
    for p in rows:
        price = p[5]
        if p[9] is not True or not (has(category, p[3], p[4]) and has(skill, p[7]) and has(use, p[8]) and has(brand, p[2])):
            continue
        if (low is not None and (price is None or price < low)) or (high is not None and (price is None or price > high)):
            continue
        if ranked is not None and p[0] not in ranked:
            continue
        if target is not None:
            order = None if price is None else abs(price - target)
        else:
            order = ranked[p[0]] if ranked is not None else price
        fits.append((order is None, order or 0, p[0]))
    return [f[2] for f in sorted(fits)[:k]]


def found(df):
    lists = {}
    for r in df.orderBy("request_id", "rank").collect():
        lists.setdefault(r.request_id, []).append(r.product_id)
    return lists


@pytest.mark.parametrize("seed", [1, 2])
def test_ladder_search(spark, seed):
    rows, asked = products(seed), requests(seed)
    got = found(catalog_search(spark.createDataFrame(rows, CATALOG), spark.createDataFrame(asked, REQUEST)))
    for request in asked:
        assert got.get(request[0], []) == brute(rows, request), request


def test_candidates_restrict_only_their_own_requests(spark):
    rows, asked = products(3), requests(3)
    rng = random.Random(5)
    ranked = {
        r[0]: {p: i for i, p in enumerate(rng.sample([f"P{i:04d}" for i in range(200)], 20))} for r in asked if r[0] % 3
    }
    ranked[0] = {"P9999": 0}
    listed = [(r, p, i) for r, ids in ranked.items() for p, i in ids.items()]
    candidates = spark.createDataFrame(listed, "request_id bigint, product_id string, candidate_rank int")
    got = found(catalog_search(spark.createDataFrame(rows, CATALOG), spark.createDataFrame(asked, REQUEST), candidates))
    for request in asked:
        assert got.get(request[0], []) == brute(rows, request, ranked.get(request[0])), request


def test_requests_without_filter_columns(spark):
    rows = products(4)
    got = found(catalog_search(spark.createDataFrame(rows, CATALOG), spark.range(2).withColumnRenamed("id", "request_id"), k=5))
    assert got == {i: brute(rows, (i, *[None] * 7), k=5) for i in range(2)}


@pytest.mark.parametrize("seed", [1, 2])
def test_browse(spark, seed):
    rng = random.Random(seed)
    rows = [(*p[:5], -p[5] if p[5] and rng.random() < 0.1 else p[5], *p[6:]) for p in products(seed)]
    names = ["Guitar", "Drums", "Keys_50%", "guitar", "None"]
    asked = [
        (i, rng.choice([None, [], rng.sample(names, 2), ["Drums", "Drums"]]), rng.choice([-5.0, 0.0, 14.99, 200.0, 1e9]))
        for i in range(60)
    ]
    stock = spark.createDataFrame([("P0001", 4)], "product_id string, quantity int")
    got = found(
        browse(spark.createDataFrame(rows, CATALOG), stock, spark.createDataFrame(asked, "request_id int, categories array<string>, max_price double"))
    )
    for i, categories, limit in asked:
        fits = sorted(
            (p[3] is None, p[3] or "", p[5], p[0])
            for p in rows
            if "Bundle" not in p[1] and p[5] is not None and p[5] <= Decimal(str(limit)) and (not categories or p[3] in categories)
        )
        assert got.get(i, []) == [f[3] for f in fits[:3]], (i, categories, limit)


def test_lookups(spark):
    catalog = spark.createDataFrame(products(1), CATALOG)
    ids = spark.createDataFrame([("P0000",), ("P7777",)], "product_id string")
    details = {r.product_id: r for r in product_details(catalog, ids).collect()}
    assert details["P0000"].error is None and details["P0000"].product_name is not None
    assert details["P7777"].error == "Product P7777 not found" and details["P7777"].brand is None
    lists = spark.createDataFrame([(1, ["P0002", "P0001", "P0002", "P9999"]), (2, [])], "list_id int, product_ids array<string>")
    stock = spark.createDataFrame([("P0001", 4)], "product_id string, quantity int")
    cards = products_by_ids(catalog, stock, lists).orderBy("position").collect()
    assert [(c.list_id, c.product_id, c.quantity) for c in cards] == [(1, "P0002", None), (1, "P0001", 4)]


def test_contains_matches_with_many_like_patterns(spark):
    texts = [f"Brand#{i}" for i in range(60)] + ["", "a", "Ab", "abc ABC"]
    patterns = [f"brand#{i}" for i in range(0, 70, 3)] + ["", "a", "b", "ab", "bc a", "#5", "nd#5", "zzz", "abc abcd"]
    values = spark.createDataFrame([("f", t, t) for t in texts] + [("g", "x", "brand#1")], "field string, value string, text string")
    asked = spark.createDataFrame([("f", p) for p in patterns], "field string, pattern string")
    got = {(r.pattern, r.value) for r in contains_matches(asked, values).collect()}
    assert got == {(p, t) for p in patterns for t in texts if p and p in t.lower()} | {("", "")}


def test_only_existing_cells_are_selected(spark):
    """Filters that match every facet value of 200 products lead to 200 cells, not to the product of the values."""
    from fretwork.operators import search

    rows = [(f"P{i:04d}", f"cat{i}", f"sub{i}", f"brand{i}", Decimal(i)) for i in range(200)]
    catalog = spark.createDataFrame(rows, "product_id string, category string, subcategory string, brand string, price decimal(10,2)")
    catalog = catalog.selectExpr("*", "'beginner' as skill_level", "'live' as use_case", "true as in_stock")
    asked = spark.createDataFrame([(1, "cat", "brand"), (2, "cat7", ""), (3, "", "")], "request_id bigint, category string, brand string")
    texts = search.normalize_requests(asked)
    questions = texts.select("*", search.F.to_json(search.F.array(*search.TEXT_FILTERS)).alias("_filter"), search.filter_mask().alias("_mask"))
    cells = search.matching_cells(questions, search.first_ids(search.in_stock_facets(catalog), 3)).groupBy("_filter").count().collect()
    assert sorted(r["count"] for r in cells) == [1, 11, 200]
