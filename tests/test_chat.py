"""Transcripts, recommendation lists, checks and text expressions on small fixtures."""

from __future__ import annotations

from pyspark.sql import functions as F

from fretwork.functions import jsonio, text
from fretwork.operators import checks, recommendations, transcripts

TURNS = "session_id string, turn bigint, role string, content string, product_ids array<string>"


def one(spark, expression):
    return spark.range(1).select(expression).first()[0]


def test_quoted_prices(spark):
    found = one(spark, text.quoted_prices(F.lit("a $1,299.99 or $5, $ 5, $,5 and $7.")))
    assert found == [1299.99, 5.0, 7.0]


def test_json_texts(spark):
    cells = ['{"b": 1, "a" : "x  y \\" z"}', "[1, 2]", "{bad", None, "", "  [ ] ", '{"a":1, "a":2}']
    df = spark.createDataFrame([(c,) for c in cells], "c string")
    got = [r[0] for r in df.select(jsonio.canonical_json(df.c)).collect()]
    assert got == ['{"b":1,"a":"x  y \\" z"}', "[1,2]", None, None, None, "[]", '{"a":1,"a":2}']
    ids = spark.createDataFrame([(c,) for c in ['["a", "b"]', "{bad", None, ""]], "c string")
    assert [r[0] for r in ids.select(jsonio.id_text(ids.c)).collect()] == ["a, b", "", "", ""]


def test_display_defaults(spark):
    assert one(spark, text.or_default(F.lit(""), "—")) == "—"
    assert one(spark, text.lookup(F.lit("x"), {"a": "b"}, "?")) == "?"
    assert one(spark, text.lookup(F.lit(None).cast("string"), {"a": "b"}, "?")) == "?"
    assert one(spark, text.ellipsis(F.lit("x" * 120), 120)) == "x" * 120
    assert one(spark, text.ellipsis(F.lit("x" * 121), 120)) == "x" * 120 + "..."
    assert one(spark, text.head(F.lit(None).cast("string"), 120)) == ""


def test_escalation_words(spark):
    assert one(spark, text.asks_for_human(F.lit("Can you REPAIR it?"))) is True
    assert one(spark, text.asks_for_human(F.lit("Can you REPAIR it?"), whole_words=True)) is False
    assert one(spark, text.asks_for_human(F.lit(None).cast("string"))) is False


def test_escalation_state_changes_only_with_a_handoff(spark):
    rows = [(1, 0, "a human please", True), (1, 1, "hello", False), (2, 0, "rep", True), (2, 1, "hello", True), (3, 0, "human", False)]
    df = spark.createDataFrame(rows, "session_id int, turn int, message string, handoff_created boolean")
    got = {r.session_id: r.escalated for r in transcripts.escalation_state(df).collect()}
    assert got == {1: True, 2: False, 3: False}


def test_transcripts_round_trip_over_pages(spark):
    rows = [("s", t, ["user", "assistant", "system", "tool"][t % 4], f'say "{t}"\n', ["p"] if t % 4 == 1 else None) for t in range(23)]
    packed = transcripts.pack_messages(spark.createDataFrame(rows, TURNS), page_turns=10)
    assert [r.page_no for r in packed.orderBy("page_no").collect()] == [0, 1, 2]
    every = transcripts.unpack_messages(packed, all_roles=True).orderBy("page_no", "position").collect()
    assert [(r.role, r.content, r.product_ids) for r in every] == [(r[2], r[3], r[4]) for r in rows]
    assert {r.role for r in transcripts.unpack_messages(packed).collect()} == {"user", "assistant"}
    broken = spark.createDataFrame([("s", 0, "{"), ("t", 0, None)], "session_id string, page_no bigint, messages string")
    assert transcripts.unpack_messages(broken).count() == 0


def fold(calls, k=3):
    """The same list, call by call."""
    ids = []
    for _, op, found in sorted(calls):
        if op == "handoff":
            ids = list(found)
        elif op == "search":
            ids = list(dict.fromkeys(ids + found))[:k]
    return ids


def test_recommendation_lists_equal_the_step_by_step_fold(spark):
    import random

    rng = random.Random(4)
    turns = {}
    for t in range(120):
        turns[t] = [
            (n, rng.choice(["search", "search", "handoff", "details"]), [rng.choice("abcdef") for _ in range(rng.randrange(5))])
            for n in range(rng.randrange(1, 6))
        ]
    rows = [("s", t, n, op, ids) for t, calls in turns.items() for n, op, ids in calls]
    df = spark.createDataFrame(rows, "session_id string, turn int, call_no int, op string, ids array<string>")
    lists = recommendations.recommendation_lists(df)
    got = {r.turn: r.product_ids for r in lists.collect()}
    assert got == {t: fold(calls) for t, calls in turns.items()}
    cards = {r.turn: r for r in recommendations.turn_cards(lists).collect()}
    assert all(cards[t].has_duplicates == (len(set(ids)) != len(ids)) for t, ids in got.items())
    (session,) = recommendations.session_cards(recommendations.turn_cards(lists)).collect()
    assert session.total_cards == sum(len(set(ids)) for ids in got.values())


RULES = "rule_id string, scenario string, turn int, check string, phrases array<string>, lo double, hi double, category string"


def test_checks(spark):
    turns = spark.createDataFrame(
        [
            ("s1", 0, "It costs $450.00, from our Specialist", ["P1", "P2"], False, False),
            ("s1", 1, "nothing", [], True, False),
            ("s2", 0, "nothing", ["P9"], None, False),
            ("s3", 0, "fine", [], None, True),
        ],
        "scenario string, turn int, reply string, rec_ids array<string>, handoff_logged boolean, error boolean",
    )
    products = spark.createDataFrame(
        [("P1", "Guitar", None, 100.0), ("P2", None, "Amplifier", 900.0)], "product_id string, category string, subcategory string, price double"
    )
    cases = [
        ("s1", 0, "price_range", [], 400, 500, None, True),
        ("s1", 1, "price_range", [], 400, 500, None, False),
        ("s1", 0, "no_price_range", [], 400, 500, None, False),
        ("s1", 1, "no_price_range", [], 400, 500, None, True),
        ("s1", 0, "contains", ["specialist", "costs"], None, None, None, True),
        ("s1", 0, "contains", ["specialist", "free"], None, None, None, False),
        ("s1", 0, "any_contains", ["free", "SPECIALIST"], None, None, None, True),
        ("s1", 0, "any_contains", [], None, None, None, False),
        ("s1", 0, "not_contains", ["free"], None, None, None, True),
        ("s1", 0, "not_contains", ["costs"], None, None, None, False),
        ("s1", 0, "handoff_logged", [], None, None, None, False),
        ("s1", 1, "handoff_logged", [], None, None, None, True),
        ("s2", 0, "no_handoff", [], None, None, None, True),
        ("s1", 0, "recommended_category", [], None, None, "amp", True),
        ("s1", 0, "recommended_category", [], None, None, "drum", False),
        ("s1", 1, "recommended_category", [], None, None, "amp", False),
        ("s1", 0, "recommended_prices", [], 800, 1000, None, True),
        ("s1", 0, "recommended_prices", [], 200, 300, None, False),
        ("s2", 0, "recommended_prices", [], 0, 1e9, None, False),
        ("s9", 0, "no_handoff", [], None, None, None, False),
        ("s1", 7, "not_contains", ["free"], None, None, None, False),
        ("s9", 0, "no_price_range", [], 1, 2, None, False),
        ("s9", 1, "recommended_prices", [], 0, 1e9, None, False),
    ]
    rows = [(str(i), s, t, c, p, lo and float(lo), hi and float(hi), cat) for i, (s, t, c, p, lo, hi, cat, _) in enumerate(cases)]
    rows = [(*r[:5], 0.0 if r[3].endswith("prices") and r[5] in (0, None) else r[5], *r[6:]) for r in rows]
    verdicts = checks.evaluate(turns, spark.createDataFrame(rows, RULES), products)
    got = {int(r.rule_id): r for r in verdicts.collect()}
    wrong = [cases[i] for i, r in got.items() if r.passed != cases[i][-1]]
    assert not wrong and len(got) == len(cases)
    assert got[5].detail == "free" and got[9].detail == "costs"
    results = {r.scenario: r for r in checks.scenario_results(turns, verdicts).collect()}
    assert {s: (r.n_turns, r.n_failed, r.passed) for s, r in results.items()} == {"s1": (2, 10, False), "s2": (1, 1, False), "s3": (1, 0, False), "s9": (0, 3, False)}
    summary = checks.run_summary(spark.createDataFrame([("Ab", True), ("b", False)], "scenario string, passed boolean"), "B").first()
    assert (summary.passed, summary.failed) == (1, 1)


def test_contracts_find_violations(spark):
    rows = spark.createDataFrame([(1, "a"), (1, "b"), (2, None)], "id int, kind string")
    parents = spark.createDataFrame([(1,)], "key int")
    report = checks.contract_report(
        {
            "unique": checks.duplicate_keys(rows, ["id"]),
            "kind": checks.unexpected_values(rows, "kind", ["a"]),
            "parent": checks.orphans(rows, "id", parents, "key"),
            "none": checks.orphans(rows.where("id = 1"), "id", parents, "key"),
        }
    )
    assert {r.contract: r.n_violations for r in report.collect()} == {"unique": 1, "kind": 2, "parent": 1, "none": 0}
