from __future__ import annotations

import random
from itertools import combinations

from oracle import connect, difference

from fretwork.llm import decontamination as dc

DOCS = "doc_id long, text string"
ITEMS = "item_id long, text string"


def test_masks_find_every_window_with_two_replaced_words():
    for gone in combinations(range(dc.WINDOW), dc.SUBSTITUTED):
        assert any(not {at + o for o in mask} & set(gone) for mask in dc.MASKS for at in range(dc.WINDOW - max(mask)))


def brute(docs, items):
    def words(text):
        return "".join(c if c.isalnum() else " " for c in (text or "").lower()).split()

    out = []
    for doc, text in docs:
        have, hits = words(text), {}
        for item, wanted in items:
            want = words(wanted)
            width = min(len(want), dc.WINDOW)
            need = width if len(want) < dc.WINDOW else dc.WINDOW - dc.SUBSTITUTED
            for shift in range(-len(want), len(have) + 1) if want else ():
                equal = [0 <= j + shift < len(have) and have[j + shift] == w for j, w in enumerate(want)]
                n = sum(sum(equal[s : s + width]) >= need for s in range(len(want) - width + 1))
                if n:
                    hits[item] = hits.get(item, 0) + n
        out.append((doc, bool(hits), len(hits), min(hits, default=None), sum(hits.values())))
    return sorted(out, key=str)


def rows(spark, docs, items):
    found = dc.marked(spark.createDataFrame(docs, DOCS), spark.createDataFrame(items, ITEMS))
    return sorted((tuple(r) for r in found.select("doc_id", "contaminated", "n_items", "first_item", "n_windows").collect()), key=str)


def sample(seed=1):
    rng = random.Random(seed)
    vocabulary = [f"w{i}" for i in range(300)]
    items = [(i, " ".join(rng.choices(vocabulary, k=rng.choice([3, 8, 12, 13, 14, 20, 45])))) for i in range(40)]
    docs = []
    for i in range(150):
        text = rng.choices(vocabulary, k=rng.randrange(0, 120))
        if i % 2:
            passage = rng.choice(items)[1].split()
            for _ in range(rng.randrange(4)):
                passage[rng.randrange(len(passage))] = "other"
            at = rng.randrange(len(text) + 1)
            text[at:at] = passage[rng.randrange(3) :]
        docs.append((i, ", ".join(text)))
    return docs, items


def test_overlaps_equal_brute_force(spark, monkeypatch):
    docs, items = sample()
    want = brute(docs, items)
    assert rows(spark, docs, items) == want
    assert 20 < sum(r[1] for r in want) < 100
    monkeypatch.setattr(dc, "BROADCAST_SEEDS", 0)
    assert rows(spark, docs, items) == want


def test_edges(spark):
    passage = " ".join(f"p{i}" for i in range(14))
    docs = [(1, None), (2, ""), (3, passage.upper()), (3, passage.upper()), (None, f"x {passage}!"), (5, "the " * 5000), (6, "p0 p1")]
    items = [(1, passage), (2, passage), (3, None), (4, " - "), (5, "the the the"), (6, "absent")]
    got = rows(spark, docs, items)
    assert got == sorted(
        [(1, False, 0, None, 0), (2, False, 0, None, 0), *[(3, True, 2, 1, 2)] * 2, (None, True, 2, 1, 2), (5, True, 1, 5, 4998), (6, False, 0, None, 0)],
        key=str,
    )
    wide = spark.createDataFrame([(*d, i, "x") for i, d in enumerate(docs)], f"{DOCS}, shift int, codes string")
    kept = dc.clean(wide, spark.createDataFrame(items, ITEMS))
    assert kept.columns == wide.columns and sorted(r.doc_id for r in kept.collect()) == [1, 2, 6]
    assert rows(spark, [], items) == []
    assert not any(r[1] for r in rows(spark, docs, []))


def test_no_python_in_the_plan(spark):
    docs, items = sample()
    plan = dc.marked(spark.createDataFrame(docs, DOCS), spark.createDataFrame(items, ITEMS))._jdf.queryExecution().toString()
    assert "Python" not in plan and "Pandas" not in plan


def test_against_sql(spark):
    sf = "/root/testdata/sf0.001"
    assert difference(dc.query(spark, sf), connect(sf), dc.SQL) is None
