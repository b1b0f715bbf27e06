from __future__ import annotations

import random

import numpy as np
import pytest
import xxhash
from pyspark.sql import functions as F

from fretwork.llm import simhash
from fretwork.llm.components import connected


def plain_fingerprint(text, n=4):
    words = "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")
    for c in "\t\n\x0b\x0c\r":
        words = words.replace(c, " ")
    words = [w for w in words.split(" ") if w]
    if not words:
        return 0
    shingles = [" ".join(words[i : i + n]) for i in range(max(1, len(words) - n + 1))]
    hashes = [xxhash.xxh64_intdigest(s.encode(), 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def brute(rows, radius=4):
    """Components of all rows (doc_id, text) by comparing every pair."""
    codes = [plain_fingerprint(t) for _, t in rows]
    parent = list(range(len(rows)))

    def find(i):
        while parent[i] != i:
            i = parent[i]
        return i

    for i in range(len(rows)):
        for j in range(i):
            if (codes[i] ^ codes[j]).bit_count() <= radius:
                parent[find(i)] = find(j)
    names = {}
    for i, (doc, _) in enumerate(rows):
        names.setdefault(find(i), []).append(doc)
    first = {k: min((d for d in v if d is not None), default=None) for k, v in names.items()}
    return sorted(((d, f"{c:016x}", first[find(i)]) for i, ((d, _), c) in enumerate(zip(rows, codes, strict=True))), key=str)


def near_copies(n, seed=3):
    rng = random.Random(seed)
    vocabulary = [f"w{i}" for i in range(400)]
    rows = []
    for i in range(n):
        if rows and rng.random() < 0.5:
            text = list(rng.choice(rows)[1].split())
            if text:
                text[rng.randrange(len(text))] = rng.choice(vocabulary)
        else:
            text = rng.choices(vocabulary, k=rng.randrange(0, 400))
        rows.append((i, " ".join(text)))
    return rows


def result(spark, rows, **kwargs):
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    found = simhash.groups(docs, **kwargs).select("doc_id", F.lpad(F.lower(F.hex("fp")), 16, "0"), "component_id")
    return sorted(map(tuple, found.collect()), key=str)


@pytest.mark.parametrize("text", ["", " \n ", "One", "a b c", "A b\tc d", "é É x y z " * 30, "a b c d " * 20000])
def test_fingerprint(text):
    assert simhash.fingerprint(text) == plain_fingerprint(text)


def test_groups_equal_all_pairs(spark):
    rows = near_copies(400)
    got = result(spark, rows)
    assert got == brute(rows)
    assert len({r[2] for r in got}) < len(got)


@pytest.mark.parametrize("blocks", [5, 6, 8])
def test_large_shards_are_cut(spark, monkeypatch, blocks):
    monkeypatch.setattr(simhash, "PIECE", 3)
    rng = random.Random(1)
    centre = rng.getrandbits(64)
    codes = {centre ^ sum(1 << b for b in rng.sample(range(64), rng.randrange(7))) for _ in range(300)}
    table = spark.createDataFrame([(int(np.uint64(c).view(np.int64)),) for c in codes], "fp long")
    found = {r.vertex: r.root for r in connected(simhash.links(table, 4, blocks)).collect()}
    codes = sorted(codes)
    parent = {c: c for c in codes}

    def find(c):
        while parent[c] != c:
            c = parent[c]
        return c

    for i, c in enumerate(codes):
        for d in codes[:i]:
            if (c ^ d).bit_count() <= 4:
                parent[find(c)] = find(d)
    signed = {c: int(np.uint64(c).view(np.int64)) for c in codes}
    mine = {}
    for c in codes:
        mine.setdefault(found.get(signed[c], signed[c]), set()).add(c)
    theirs = {}
    for c in codes:
        theirs.setdefault(find(c), set()).add(c)
    assert sorted(map(sorted, mine.values())) == sorted(map(sorted, theirs.values()))


def test_nulls_repeats_and_clashing_columns(spark):
    rows = [(1, "a b c d e f g"), (1, "a b c d e f g"), (None, "a b c d e f g"), (7, None), (8, ""), (None, "only this text here now")]
    assert result(spark, rows) == brute(rows)
    wide = spark.createDataFrame([(*r, i, "x") for i, r in enumerate(rows)], "doc_id long, text string, fp long, root string")
    kept = simhash.one_per_group(wide)
    assert kept.columns == wide.columns
    assert sorted(((r.doc_id, r.text) for r in kept.collect()), key=str) == [
        (1, "a b c d e f g"), (7, None), (None, "only this text here now"),
    ]


def test_one_row_of_each_group_stays(spark):
    rows = near_copies(300, 5)
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    kept = sorted(r.doc_id for r in simhash.one_per_group(docs).collect())
    assert kept == sorted({r[2] for r in brute(rows)})


def test_empty(spark):
    assert result(spark, []) == []
    assert simhash.one_per_group(spark.createDataFrame([], "doc_id long, text string")).count() == 0


def test_long_chain_is_one_component(spark):
    edges = spark.range(500).selectExpr("id as u", "id + 1 as v")
    assert {r.root for r in connected(edges).collect()}.__len__() == 1
