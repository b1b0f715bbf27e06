from __future__ import annotations

import hashlib
import random
import re
import zlib

from oracle import connect, difference
from pyspark.sql import functions as F

from fretwork.llm import trie

SCHEMA = "conv_id long, turn long, role string, text string"


def words(text):
    return len(re.findall(r"[^\x20\x09-\x0D]+", text))


def brute(rows, block=trie.BLOCK, heads=trie.HEADS):
    own = {}
    for conv, turn, role, text in rows:
        if conv is not None:
            own.setdefault(conv, []).append((turn, role or "", text or ""))
    digest = lambda t: hashlib.md5(f"{len(t[1])}:{t[1]}{t[2]}".encode()).hexdigest()
    for turns in own.values():
        turns.sort(key=lambda t: (t[0] is not None, t[0] or 0, digest(t)))
    built = {}
    for conv, turns in own.items():
        h = zlib.crc32(str(conv).encode()) % heads
        base = own.get(conv - int(abs(conv) % block * (1 if conv >= 0 else -1)), [])
        built[conv] = tuple(t[1:] for t in base[:h] + turns[h:])
    nodes = {}
    for conv, seq in built.items():
        for d in range(len(seq) + 1):
            nodes.setdefault(seq[:d], []).append(conv)
    out = []
    for node, members in nodes.items():
        below = [n for n in nodes if n[: len(node)] == node]
        stops = ",".join(str(c) for c in sorted(c for c in members if built[c] == node))
        out.append(
            (
                min(members), len(node), min(nodes[node[:-1]]) if node else None, len(members),
                sum(len(n) == len(node) + 1 for n in below),
                sum(not any(len(m) == len(n) + 1 and m[: len(n)] == n for m in nodes) for n in below),
                sum((len(nodes[n]) - 1) * (words(n[-1][1]) if n else 0) for n in below),
                hashlib.sha256(stops.encode()).hexdigest(),
            )
        )
    return sorted(out, key=str)


def result(spark, tmp_path, rows, schema=SCHEMA):
    folder = tmp_path / f"t{len(list(tmp_path.iterdir()))}"
    spark.createDataFrame(rows, schema).write.parquet(f"{folder}/conversations.parquet")
    found = trie.query(spark, str(folder))
    assert found.columns == ["conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256"]
    return sorted(map(tuple, found.collect()), key=str)


def test_random_conversations(spark, tmp_path):
    rng = random.Random(3)
    texts = ["a b", "", "c", " \t", "a  b c"]
    rows = []
    for conv in [*range(-45, 130), 4000, 4001]:
        for turn in range(rng.randrange(1, 6)):
            rows.append((conv, turn, rng.choice(["user", "bot"]), rng.choice(texts)))
    want = brute(rows)
    assert result(spark, tmp_path, rows) == want
    assert any(r[5] > 1 and r[6] > 100 for r in want) and len(want) > 100


def test_nulls_ties_and_repeats(spark, tmp_path):
    rows = [(1, 5, "u", "x"), (1, None, None, "first"), (1, None, "u", None), (1, 5, "u", "x"), (1, 5, "u", "w"), (None, 0, "u", "gone"), (20, 0, None, None)]
    rows += [(21, t, "u", "x") for t in (2, 1, 1, 0)] + [(c, 0, "u", "same") for c in range(40, 60)]
    assert result(spark, tmp_path, rows) == brute(rows)


def test_turnless_and_empty(spark, tmp_path):
    alone = [c for c in range(1, 400) if c % 20 and zlib.crc32(str(c).encode()) % 4 >= 1][:9]
    rows = [(c, 0, "u", "lost") for c in alone]
    got = result(spark, tmp_path, rows)
    assert got == brute(rows)
    assert len(got) == 1 and got[0][1:6] == (0, None, 9, 0, 1)
    assert result(spark, tmp_path, []) == []


def test_one_long_conversation(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(trie, "BAND_BITS", 3)
    rows = [(0, t // 3, "u", f"turn {t % 5}") for t in range(200)] + [(7, t, "u", "short") for t in range(5)]
    assert result(spark, tmp_path, rows) == brute(rows)


def test_long_end_lists(spark, tmp_path):
    """Ids of several pieces, negative ones too, are hashed in numeric order."""
    ids = [c for c in range(-3000, 3000, 20)] + [c for c in range(100_000, 100_400, 20)]
    rows = [(c, 0, "u", "hello there") for c in ids]
    got = result(spark, tmp_path, rows)
    assert got == brute(rows)
    stops = spark.createDataFrame([(c, 1, 2, 3) for c in ids], "conv_id long, depth long, z1 long, z2 long")
    pieces = trie.end_pieces(stops, 64)
    assert pieces.count() > 50 and pieces.agg(F.max(F.size("ids"))).first()[0] <= 64
    want = hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest()
    assert [r["digest"] for r in trie.end_digests(pieces).collect()] == [want]


def test_other_columns_are_not_read(spark, tmp_path):
    rows = [(c, t, "u", f"w{t}", 1, "x") for c in range(3) for t in range(4)]
    assert result(spark, tmp_path, rows, f"{SCHEMA}, depth int, digest string") == brute([r[:4] for r in rows])


def test_leaves_are_no_proper_prefixes(spark):
    rows = [(0, 0, "u", "a"), (20, 0, "u", "a"), (20, 1, "u", "b"), (40, 0, "u", "a"), (60, 0, "u", "z")]
    convs, turns = trie.rebuilt(spark.createDataFrame(rows, SCHEMA))
    after = trie.prefixes(turns)
    found = {r["conv_id"]: (r["weight"], r["leaf"]) for r in trie.sequences(trie.ends(convs, after), after).collect()}
    assert found == {0: (2, 0), 20: (1, 1), 60: (1, 1)}


def test_against_sql(spark):
    sf = "/root/testdata/sf0.001"
    assert difference(trie.query(spark, sf), connect(sf), trie.SQL) is None
