from __future__ import annotations

import random
import zlib

import numpy as np
import pytest

from fretwork.llm import language

SF = "/root/testdata/sf0.01"
WORDS = {"xx": "aba bab abab baba ab".split(), "yy": "kok oko koko okok ko".split(), "zz": "ini nin inin nini ni".split()}


def text_of(rng, langs, n):
    return " ".join(rng.choice(WORDS[rng.choice(langs)]) for _ in range(n))


def plain_grams(text):
    """Padded letter trigrams of all words, by hand."""
    words = "".join(c if c.isalpha() else " " for c in text.lower()).split()
    return [[f"\0{w}\0"[i : i + 3] for i in range(len(w))] for w in words]


def test_grams_by_hand():
    text = "Die Ärzte, 3 ña x ǅ 漢字!"
    buckets, words = language.word_grams(language._codes(text))
    want = plain_grams(text)
    assert np.bincount(words).tolist() == [len(w) for w in want]
    seen = {}
    for name, bucket in zip([g for w in want for g in w], buckets, strict=True):
        assert seen.setdefault(name, bucket) == bucket


def plain_em(scores, allowed, steps):
    share = np.array([1 / len(allowed)] * len(allowed))
    like = np.exp(scores[:, allowed])
    for _ in range(steps):
        part = like * share
        share = (part / part.sum(axis=1, keepdims=True)).mean(axis=0)
    return share, np.log((like * share).sum(axis=1)).sum()


def test_mixtures_by_hand():
    rng = np.random.default_rng(2)
    counts = np.array([5, 0, 40, 1, 25])
    scores = rng.normal(-5, 2, (counts.sum(), 4)).astype(np.float32)
    scores[5:45, 1] += 6
    got = language.mixtures(scores, counts)
    at = 0
    for n, row in zip(counts, got, strict=True):
        part, at = scores[at : at + n].astype(float), at + n
        if not n:
            assert not row.any()
            continue
        full, _ = plain_em(part, [0, 1, 2, 3], language.STEPS)
        order = list(np.argsort(-full, kind="stable"))
        chosen = order[:1]
        share, height = plain_em(part, chosen, language.STEPS)
        for k in range(1, 4):
            if full[order[k]] * n <= 0.5:
                break
            larger, reached = plain_em(part, order[: k + 1], language.STEPS)
            if reached - height <= 0.5 * np.log(n) + 1e-9:
                break
            chosen, share, height = order[: k + 1], larger, reached
        want = np.zeros(4)
        want[chosen] = share
        assert np.allclose(row, want, atol=1e-6)


def predict(spark, rows, docs, schema="doc_id long, text string"):
    langs, model = language.learn(spark.createDataFrame(rows, "text string, lang string"))
    return {r.doc_id: r for r in language.predict(spark.createDataFrame(docs, schema), langs, model).collect()}


def test_mixed_texts(spark):
    rng = random.Random(1)
    rows = [(text_of(rng, [lang], 30), lang) for lang in WORDS for _ in range(10)] + [(None, "xx"), ("aba", None)]
    docs = [(1, text_of(rng, ["xx"], 50)), (2, text_of(rng, ["xx", "yy", "yy", "yy"], 400)), (3, text_of(rng, list(WORDS), 600))]
    docs += [(4, None), (5, ""), (6, "123 !? \n"), (7, text_of(rng, ["zz"], 300_000)), (8, "KOK")]
    got = predict(spark, rows, docs)
    assert (got[1].lang_pred, got[1].score) == ("xx", 1.0) and got[1].langs == ["xx:1.0000"]
    assert got[2].lang_pred == "yy" and 0.65 < got[2].score < 0.85 and len(got[2].langs) == 2
    assert len(got[3].langs) == 3 and 0.3 < got[3].score < 0.45
    assert all((got[d].lang_pred, got[d].score) == ("und", 0.0) for d in (4, 5, 6))
    assert got[7].lang_pred == "zz" and got[8].lang_pred == "yy"


def test_nothing_learned_repeats_and_clashing_columns(spark):
    docs = [(1, "aba", "x"), (1, "aba", "x"), (None, "bab", None)]
    got = predict(spark, [(None, None)], docs, "doc_id long, text string, words string")
    assert {r.lang_pred for r in got.values()} == {"und"} and set(got) == {1, None}
    langs, model = language.learn(spark.createDataFrame([("aba", "xx")], "text string, lang string"))
    assert language.predict(spark.createDataFrame([], "doc_id long, text string"), langs, model).count() == 0


@pytest.mark.parametrize("size", [0, 1])
def test_piece_borders_change_nothing(monkeypatch, size):
    rng = random.Random(3)
    texts = [text_of(rng, list(WORDS), n) for n in (0, 3, 500, 40, 2000)]
    model = np.random.default_rng(1).normal(size=(1 << language.BITS, 3)).astype(np.float32)
    whole = language._word_scores(texts, model, language.BITS)
    monkeypatch.setattr(language, "PIECE", 64 + size)
    cut = language._word_scores(texts, model, language.BITS)
    assert (whole[1] == cut[1]).all() and np.allclose(whole[0], cut[0])


def test_held_out_accuracy(spark):
    docs = {r.doc_id: r for r in spark.read.parquet(f"{SF}/documents.parquet").collect()}
    got = language.query(spark, SF).collect()
    assert len(got) == len(docs)
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 5 == 0) and 0 <= r.score <= 1 for r in got)
    held = [r for r in got if r.held_out]
    assert sum(r.lang_pred == docs[r.doc_id].lang for r in held) / len(held) > 0.97


def test_many_languages_in_groups(spark):
    """Seventy languages of their own letters in several files: the mixtures are those of one file."""
    rng = random.Random(5)
    letters = [chr(0x4E00 + i) for i in range(210)]
    words = {f"l{i:02d}": ["".join(rng.choices(letters[3 * i : 3 * i + 3], k=4)) for _ in range(6)] for i in range(70)}

    def text(langs, n):
        return " ".join(rng.choice(words[rng.choice(langs)]) for _ in range(n))

    rows = [(text([lang], 60), lang) for lang in words] + [(None, "none"), ("", "none")]
    docs = [(i, text([lang], 30)) for i, lang in enumerate(words)]
    docs += [(100, text(["l00", "l37", "l69", "l69"], 400)), (101, None), (102, "1 2"), (103, text(["l11"], 90_000))]
    learned, asked = spark.createDataFrame(rows, "text string, lang string"), spark.createDataFrame(docs, "doc_id long, text string")

    def run(group):
        model = language.learn(learned, group=group)
        return len(model[0]), {r.doc_id: (r.lang_pred, round(r.score, 3), len(r.langs)) for r in language.predict(asked, *model).collect()}

    n_one, one = run(100)
    n_many, many = run(9)
    assert (n_one, n_many) == (1, 8) and one == many
    assert all(many[i][0] == lang for i, lang in enumerate(words))
    assert many[100][0] == "l69" and many[100][2] == 3 and many[101][0] == many[102][0] == "und" and many[103][0] == "l11"


def test_slices_keep_all_texts():
    texts = ["a" * n for n in (5, 0, 30, 1, 1)] + [None]
    assert [t for part in language._slices(texts, language.SCORED // 8) for t in part] == texts
