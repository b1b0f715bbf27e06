from __future__ import annotations

import hashlib
import random
import re

import pytest
from oracle import connect, difference
from pyspark.sql import functions as F

from fretwork.llm import sketches

SCHEMA = "doc_id long, text string"


def sketch(text, width=5, fraction=8):
    lowered = "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")
    words = re.findall(r"[^\x20\x09-\x0D]+", lowered)
    shingles = [" ".join(words[i : i + width]) for i in range(max(len(words) - width, 0) + 1)]
    hashes = sorted({hashlib.md5(s.encode()).hexdigest()[:16] for s in shingles})
    return [h for h in hashes if int(h, 16) < 2**64 // fraction] or hashes[:1]


def brute(rows):
    """Rows without ties in doc_id, or repeated ones."""
    single = sorted(set(rows), key=lambda r: (r[0] is not None, r[0] or 0), reverse=True)
    out = {}
    for at, (doc, text) in enumerate(single):
        text, following = text or "", single[(at + 1) % len(single)][1] or ""
        half = len(text) // 2
        changed = text[: len(text) - half] + following[:half]
        own, new, other = sketch(text), sketch(changed), sketch(following)
        near = lambda a, b: len({*a} & {*b}) / len(a)
        out[doc, text] = (doc, len(text), hashlib.sha256(changed.encode()).hexdigest(), "".join(own), "".join(new), near(own, new), near(own, other))
    return sorted((out[doc, text or ""] for doc, text in rows), key=str)


def result(spark, tmp_path, rows, schema=SCHEMA, parts=3):
    folder = tmp_path / f"t{len(list(tmp_path.iterdir()))}"
    spark.createDataFrame(rows, schema).repartition(parts).write.parquet(f"{folder}/documents.parquet")
    return sorted(map(tuple, sketches.query(spark, str(folder)).collect()), key=str)


def text_of(rng, n):
    return " ".join(rng.choice(["Über", "to", "A", "word", "x" * rng.randrange(1, 9), "ß\n", "日本"]) for _ in range(n))


def test_random_texts(spark, tmp_path):
    rng = random.Random(2)
    rows = [(i * 7 - 300, text_of(rng, rng.choice([0, 1, 3, 5, 6, 40, 300]))) for i in range(150)]
    assert result(spark, tmp_path, rows) == brute(rows)


def test_nulls_repeats_and_empty(spark, tmp_path):
    rows = [(None, "no id"), (3, None), (2, ""), (1, " \n\t"), (5, "same text"), (5, "same text"), (5, "same text"), (9, "Same  Text"), (7, "one\x85two 😀😀")]
    got = result(spark, tmp_path, rows)
    assert got == brute(rows)
    assert len(got) == 9 and {r[3] for r in got if r[0] in (1, 2, 3)} == {hashlib.md5(b"").hexdigest()[:16]}
    assert result(spark, tmp_path, []) == []
    assert result(spark, tmp_path, [(4, "alone in the table")]) == brute([(4, "alone in the table")])
    wide = [(1, "a b c", 3, "x"), (2, "c d", 4, "y")]
    assert result(spark, tmp_path, wide, f"{SCHEMA}, copies int, block string") == brute([r[:2] for r in wide])


def test_one_doc_id_with_several_texts(spark, tmp_path):
    """Each row has exactly one next row, and is the next of exactly one."""
    texts = [f"text number {i}" for i in range(40)]
    rows = [(1, t) for t in texts] + [(0, "last")]
    docs = spark.createDataFrame(rows, SCHEMA).repartition(5)
    pairs = {r["text"]: r["next_text"] for r in sketches.beside_next(docs).collect()}
    assert sorted(pairs) == sorted(pairs.values()) == sorted([*texts, "last"])
    at, seen = "last", set()
    while at not in seen:
        seen.add(at)
        at = pairs[at]
    assert len(seen) == 41


def test_very_long_text(spark):
    rng = random.Random(1)
    text = " ".join(str(rng.randrange(10**6)) for _ in range(30_000))
    own = spark.createDataFrame([(text,)], "t string").select(sketches.sketch(F.col("t")).alias("s")).first()["s"]
    assert own == sketch(text)


def test_sketches_merge(spark):
    """The sketch of a union of shingles is that of the sketches' union, also where one of them holds a minimum only."""
    rng = random.Random(4)
    for n, m in [(400, 3), (3, 3), (3, 900), (50, 60)]:
        one, two = (" ".join(str(rng.randrange(10**6)) for _ in range(k)) for k in (n, m))
        df = spark.createDataFrame([(one, two)], "a string, b string")
        got = df.select(sketches.merged(sketches.sketch(F.col("a")), sketches.sketch(F.col("b"))).alias("s")).first()["s"]
        both = sorted({*sketch(one, fraction=1), *sketch(two, fraction=1)})
        assert got == ([h for h in both if int(h, 16) < 2**61] or both[:1])


def test_containment_of_unequal_documents(spark):
    """A short text inside one of ten times its length is found whole; its share of the long one is told from the other side."""
    rng = random.Random(8)
    words = [str(rng.randrange(10**7)) for _ in range(8000)]
    df = spark.createDataFrame([(" ".join(words), " ".join(words[3000:3800]))], "a string, b string")
    a, b = sketches.sketch(F.col("a")), sketches.sketch(F.col("b"))
    row = df.select(sketches.containment(b, a), sketches.containment(a, b), sketches.resemblance(a, b)).first()
    assert row[0] == 1.0 and row[1] == pytest.approx(0.1, abs=0.04) and row[2] == pytest.approx(0.1, abs=0.04)


def test_plan_is_native(spark):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    plan = sketches.edited(docs)._jdf.queryExecution().toString()
    assert "Python" not in plan and "Pandas" not in plan and "Arrow" not in plan


def test_against_sql(spark):
    sf = "/root/testdata/sf0.001"
    assert difference(sketches.query(spark, sf), connect(sf), sketches.SQL) is None
