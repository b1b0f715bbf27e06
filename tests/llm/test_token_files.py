from __future__ import annotations

import random
import struct
import zlib

import numpy as np
import public_tokenizers
import pytest
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from fretwork.llm import token_files as tf

FILE = public_tokenizers.path("byte_bpe_50k.json")
SCHEMA = "doc_id long, text string, start string"
TEXTS = [
    None, "", " ", "a", "a b", "a b c", "  a  b ", "a\nb c d", "x \n y z", "tab\t tab and more", "no break here now", "it's don't we'll 12 34",
    "<|endoftext|> a b <|endoftext|>x y", "é è ü ß 漢字 です か", "\x1c a \x1d b c", "word " * 20000, "a" * 50000 + " b c", "ab, cd. ef; É! éa? ñ:: Ωμ, Жд. ªº µ. ǅa ա漢字, a.b c,d x'.s y's. ...", "end space ", " start space x",
]


@pytest.fixture(scope="module")
def tokenizer():
    return Tokenizer.from_file(FILE)


def expected(rows, tokenizer):
    start, out = 0, []
    for doc, text in sorted(rows, key=lambda r: (r[0] is None, r[0] or 0)):
        ids = tokenizer.encode(text or "", add_special_tokens=False).ids + [0]
        out.append((doc, start, len(ids), zlib.crc32(struct.pack(f"<{len(ids)}I", *ids))))
        start += len(ids)
    return out


@pytest.mark.parametrize("text", [t for t in TEXTS if t is not None])
def test_encoder_equals_tokenizer(text, tokenizer):
    (got,) = tf.Encoder.of(FILE).encode([text])
    assert got.dtype == "<u2" and got.tolist() == tokenizer.encode(text, add_special_tokens=False).ids


@pytest.mark.parametrize("name", ["byte_bpe_50k.json", "word_bpe_49k.json"])
def test_random_texts(name, monkeypatch):
    for limit, value in [("BLOCK", 90), ("CUT", 40), ("KNOWN_WORDS", 60), ("KNOWN_PIECES", 20)]:
        monkeypatch.setattr(tf, limit, value)
    rng, path = random.Random(2), public_tokenizers.path(name)
    plain, odd = Tokenizer.from_file(path), "<|endoftext|>"
    for pool in (["ab ", "Ab\n", "é ", "1", ". ", "'s ", "c" * 70], [" ", "\n", "ab", "Ab", "é", "1", ".", "'s", "  ", "\xa0", odd, "\0", "\t"]):
        for _ in range(60):
            texts = ["".join(rng.choices(pool, k=rng.randrange(60))) + rng.choice(["", "x"]) for _ in range(8)]
            got = tf.Encoder.of(path).encode(texts)
            assert [g.tolist() for g in got] == [plain.encode(t, add_special_tokens=False).ids for t in texts]


def test_a_block_of_texts_is_worked_on_at_once(monkeypatch):
    """Texts that the tokenizer takes as they are come to it in blocks, not a whole batch of them."""
    monkeypatch.setattr(tf, "BLOCK", 100)
    encoder, sizes = tf.Encoder(FILE), []
    whole = encoder._whole
    monkeypatch.setattr(encoder, "_whole", lambda texts: sizes.append(sum(map(len, texts))) or whole(texts))
    texts = [f"odd  text number {i}\n\n" for i in range(50)]
    assert [ids.tolist() for ids in encoder.encode(texts)] == [ids.tolist() for ids in whole(texts)]
    assert len(sizes) > 5 and max(sizes) < 100 + max(map(len, texts))


def test_perfect_hash():
    rng = np.random.default_rng(1)
    for n in (0, 1, 2, 1000, 50000):
        keys = np.unique(rng.integers(-(1 << 62), 1 << 62, n))
        hashed = tf.PerfectHash.build(keys)
        assert sorted(hashed.slots(keys)) == list(range(len(keys)))


def docs_of(spark, rows):
    return spark.createDataFrame([(*r, "x") for r in rows], SCHEMA)


def test_files_hold_all_documents_in_order(spark, tokenizer):
    rng = random.Random(3)
    rows = [(i * 7 - 30, t) for i, t in enumerate(TEXTS)] + [((1 << 60) + i, " ".join(rng.choices("ab cd ef".split(), k=i))) for i in range(200)]
    rng.shuffle(rows)
    got = tf.round_trip(docs_of(spark, rows), FILE).orderBy("start").collect()
    assert [tuple(r)[:4] for r in got] == expected(rows, tokenizer)
    assert all(r.found for r in got)


def test_lookup(spark, tokenizer, tmp_path):
    rows = [(i * 3, f"text number {i}") for i in range(500)] + [(9, "again"), (None, "nameless")]
    path = str(tmp_path / "corpus")
    manifest = tf.write(docs_of(spark, rows), path, FILE)
    assert manifest.agg(F.sum("n_docs")).first()[0] == len(rows)
    asked = spark.createDataFrame([(9,), (10,), (0,), (1497,), (None,), (-5,), (9999,), (9,)], "doc_id long")
    got = sorted((r.doc_id, r.ids) for r in tf.lookup(asked, path, FILE).collect())
    want = [(d, tokenizer.encode(t, add_special_tokens=False).ids + [0]) for d, t in rows if d in (0, 9, 1497)]
    assert got == sorted(want)


def test_repeats_nulls_and_empty(spark, tokenizer):
    rows = [(5, "b"), (5, "a"), (5, "a"), (None, "x"), (None, None), ((1 << 62) + 1, "y")]
    got = tf.round_trip(docs_of(spark, rows), FILE).orderBy("start").collect()
    assert [r.doc_id for r in got] == [5, 5, 5, (1 << 62) + 1, None, None]
    assert sorted(r.ids_crc32 for r in got) == sorted(r[3] for r in expected(rows, tokenizer))
    assert [r.found for r in got] == [True] * 4 + [False] * 2
    assert tf.round_trip(docs_of(spark, []), FILE).count() == 0


def test_many_documents_of_one_key_and_of_none(spark, tokenizer, tmp_path):
    """They stand in several parts; each is found through its key, or without one."""
    rows = [(7, f"copy {i}") for i in range(300)] + [(i, f"text {i}") for i in range(100)] + [(None, f"nameless {i}") for i in range(300)]
    path = str(tmp_path / "corpus")
    manifest = tf.write(docs_of(spark, rows), path, FILE).orderBy("part").collect()
    assert len(manifest) > 2 and sum(r.first_id is None for r in manifest) > 0 and max(r.n_docs for r in manifest) < 350
    got = tf.round_trip(docs_of(spark, rows), FILE).orderBy("start").collect()
    assert [(r.doc_id, r.found) for r in got] == [(i, True) for i in range(7)] + [(7, True)] * 301 + [(i, True) for i in range(8, 100)] + [(None, False)] * 300
    assert [r.start for r in got] == [sum(r.n_tokens for r in got[:i]) for i in range(len(got))]
    assert sorted(r.ids_crc32 for r in got) == sorted(r[3] for r in expected(rows, tokenizer))
    asked = spark.createDataFrame([(7,), (99,)], "doc_id long")
    assert [r.doc_id for r in tf.fetch(asked, path, FILE).orderBy("doc_id").collect()] == [7] * 301 + [99]
