from __future__ import annotations

import random

from oracle import connect, difference

from fretwork.llm import mixing

SCHEMA = "doc_id long, text string, source string, target double, number int"


def docs_of(spark, rows):
    return spark.createDataFrame([(*r, 0.5, 1) for r in rows], SCHEMA)


def level_by_hand(sizes):
    """Targets by sharing again and again what is above a source's limit."""
    names = sorted(sizes, key=lambda s: (s is None, s or ""))
    weight = {s: (5, 2, 1)[i % 3] for i, s in enumerate(names)}
    total, full = sum(sizes.values()), set()
    while True:
        rest = total - sum(3 * sizes[s] for s in full)
        open_weight = sum(weight[s] for s in names if s not in full)
        target = {s: 3.0 * sizes[s] if s in full else rest * weight[s] / open_weight for s in names}
        over = {s for s in names if s not in full and target[s] > 3 * sizes[s]}
        if not over:
            return target
        full |= over


def test_targets(spark):
    rng = random.Random(2)
    for _ in range(4):
        sizes = {s: rng.choice([0, 1, 5, 100, 1000]) for s in ["a", "B", "b", "é", None, "z", "\U0001f600"]} | {"y": 50}
        frame = spark.createDataFrame(list(sizes.items()), "source string, size long")
        got = {r.source: r.target for r in mixing.targets(frame).collect()}
        want = level_by_hand(sizes)
        assert all(abs(got[s] - want[s]) < 1e-6 for s in want), (sizes, got, want)


def test_quotas_are_sainte_lague(spark):
    rng = random.Random(5)
    shares = [(i, float(rng.choice([1, 3, 50, 400, 7, 7]))) for i in range(9)] + [(9, 0.0)]
    frame = spark.createDataFrame(shares, "number int, target double")
    total = 137
    won = sorted((-t / (2 * j + 1), n) for n, t in shares for j in range(total) if t)[:total]
    got = {(r.number, r.shard): r.blocks for r in mixing.quotas(frame, total * 10, 4, 10).collect()}
    cut = [total * k // 4 for k in range(5)]
    for k in range(4):
        for n, _ in shares:
            assert got.get((n, k), 0) == sum(m == n for _, m in won[cut[k] : cut[k + 1]])


def test_mixture(spark):
    rng = random.Random(1)
    rows = [(i, "word " * rng.randrange(0, 90), rng.choice(["a"] * 20 + ["b", "c", "d", None])) for i in range(900)]
    got = mixing.mixture(docs_of(spark, rows), block_words=8).collect()
    assert len(got) == len(rows)
    total = sum(r.size for r in got)
    by = {}
    for r in got:
        assert 0 <= r.taken <= 3 * r.size and (r.shard is None) == (r.taken == 0)
        by.setdefault(r.source, []).append(r)
    want = level_by_hand({s: sum(r.size for r in rs) for s, rs in by.items()})
    for s, rs in by.items():
        assert abs(rs[0].target - want[s]) < 1e-6 and abs(sum(r.taken for r in rs) - want[s]) <= 8 * 4
    assert abs(sum(r.taken for r in got) - total) <= 8 * 5
    again = mixing.mixture(docs_of(spark, list(reversed(rows))).repartition(7), block_words=8).collect()
    assert sorted(map(str, again)) == sorted(map(str, got))


def test_stretches_fill_the_quotas(spark):
    """The words of each source in each shard, summed over all stretches and repeats, are its blocks there."""
    rng = random.Random(3)
    rows = [(i, "word " * rng.randrange(0, 200), rng.choice(["a"] * 20 + ["b", "c", "d", None])) for i in range(500)]
    docs = docs_of(spark, rows)
    got, words = mixing.mixture(docs, block_words=8, shards=5).collect(), {}
    for r in got:
        assert sum(s.words for s in r.stretches) == r.taken and (not r.stretches or r.stretches[0].shard == r.shard)
        assert all(s.words > 0 and 0 <= s["first"] and s["first"] + s.words <= r.size for s in r.stretches)
        for s in r.stretches:
            words[r.source, s.shard] = words.get((r.source, s.shard), 0) + s.words
    shares = mixing.targets(mixing.sized(docs))
    names, size = {r.number: r.source for r in shares.collect()}, {r.source: r.source_size for r in got}
    blocks = mixing.quotas(shares, sum(r.size for r in got), 5, 8).collect()
    want = {(names[q.number], q.shard): min((q.first_block + q.blocks) * 8, 3 * size[names[q.number]]) - q.first_block * 8 for q in blocks}
    assert words == {key: n for key, n in want.items() if n > 0} and len(words) > 15


def test_copies_follow_the_mixture(spark):
    rows = [(i, "w " * 10, "big") for i in range(60)] + [(100 + i, "v " * 10, "c") for i in range(4)] + [(200, "", "c"), (201, None, None)]
    rows += [(101, "v " * 10, "c")] * 2
    docs = docs_of(spark, rows)
    taken = {}
    for r in mixing.mixture(docs).collect():
        taken.setdefault(r.doc_id, []).append(-(-r.taken // r.size) if r.size else 0)
    out = mixing.mix(docs)
    assert out.columns == docs.columns
    counts = {}
    for r in out.collect():
        counts[r.doc_id] = counts.get(r.doc_id, 0) + 1
    assert counts == {d: sum(n) for d, n in taken.items() if sum(n)}


def test_empty(spark):
    assert mixing.mixture(docs_of(spark, [])).count() == 0
    assert mixing.mix(docs_of(spark, [(1, None, "a"), (None, " ", None)])).count() == 0


def test_no_python_in_the_plan(spark):
    plan = mixing.mixture(docs_of(spark, [(1, "a", "b")]))._jdf.queryExecution().toString()
    assert "Python" not in plan and "Pandas" not in plan and "Arrow" not in plan


def test_against_sql(spark):
    sf = "/root/testdata/sf0.001"
    assert difference(mixing.query(spark, sf), connect(sf), mixing.SQL) is None
