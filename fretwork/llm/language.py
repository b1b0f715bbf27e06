"""Language of documents, as a mixture of languages.

Model: per language the frequencies of the letter n-grams (``GRAM`` letters, word ends included) of words, hashed to ``2 ** BITS`` entries
and smoothed. The likelihood of a word in a language is that of its n-grams.

Inference: each word of a text comes from one language of a mixture. Expectation-maximisation estimates the proportions.
Languages join the mixture in the order of their proportions in the mixture of all; one more is accepted while it
raises the likelihood by more than half the logarithm of the number of words (BIC). The language with the largest
proportion is the prediction, its proportion the score.

A word is a run of letters, lower-cased. Long texts are worked off in pieces cut between words; per word only one number
per language is held. Model counts are added up per task before they are shuffled.

Any number of languages: the model stands in shared files of about ``GROUP`` languages each. Where there are several, a text goes
through them in turn; the languages of its mixture so far compete with those of the next file, and those that the rule
above accepts go on. So a task holds few files and the word scores of one text in ``GROUP`` languages, besides those of the
accepted ones. With one file all languages compete at once.

Nulls and ties: a text that is null or has no letters is `und` with score 0, and so is every text where nothing could be
learned. Ties go to the language name that sorts first. Rows without text or lang teach nothing. Rows that repeat get
equal results. An empty table gives an empty result.
"""

from __future__ import annotations

import functools
import io
import json
import os
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyarrow import fs
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from fretwork.llm.common import map_text, move_into_place, prepare, spread, table
from fretwork.session import scratch_dir

BITS = 16
GRAM = 3
# Languages of one file of the model, about, and files that a task keeps in memory.
GROUP = 32
OPEN_GROUPS = 4
# Characters times languages that are scored at once.
SCORED = 1 << 24
SMOOTHING = 0.5
STEPS = 12
UNKNOWN = "und"
PIECE = 1 << 19

_LETTER: list[np.ndarray] = []


def _letters() -> np.ndarray:
    """Per code point whether it is a letter."""
    if not _LETTER:
        _LETTER.append(np.array([chr(c).isalpha() for c in range(0x110000)]))
    return _LETTER[0]


def _codes(text: str) -> np.ndarray:
    return np.frombuffer(text.lower().encode("utf-32-le", "surrogatepass"), np.uint32)


def word_grams(codes: np.ndarray, bits: int = BITS) -> tuple[np.ndarray, np.ndarray]:
    """Buckets of the n-grams of all words, and the word of each. A word is padded by one mark on both sides."""
    inside = _letters()[codes]
    starts = np.flatnonzero(inside & np.concatenate(([True], ~inside[:-1])))
    if not len(starts):
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    ends = np.flatnonzero(inside & np.concatenate((~inside[1:], [True]))) + 1
    # Words one after the other, each between two zeros.
    sizes = ends - starts
    out_start = np.concatenate(([0], np.cumsum(sizes + 2)))
    padded = np.zeros(out_start[-1], np.uint64)
    word = np.repeat(np.arange(len(starts)), sizes)
    letters = np.flatnonzero(inside)
    padded[letters - starts[word] + out_start[word] + 1] = codes[letters]
    owner = np.repeat(np.arange(len(starts)), sizes + 2)
    rolling = padded
    with np.errstate(over="ignore"):
        for n in range(2, GRAM + 1):
            rolling = rolling[:-1] * np.uint64(0x100000001B3) + padded[n - 1 :]
        buckets = spread(rolling * np.uint64(0xFF51AFD7ED558CCD), bits)
    whole = owner[: len(rolling)] == owner[GRAM - 1 :]
    return buckets[whole], owner[: len(rolling)][whole]


def _pieces(codes: np.ndarray) -> Iterator[np.ndarray]:
    """Parts of a text of about ``PIECE`` characters, cut where no word is."""
    at = 0
    while len(codes) - at > PIECE:
        gaps = np.flatnonzero(~_letters()[codes[at + PIECE // 2 : at + PIECE]])
        stop = at + PIECE // 2 + int(gaps[-1]) if len(gaps) else at + PIECE
        yield codes[at:stop]
        at = stop
    yield codes[at:]


def gram_counts(rows: DataFrame, bits: int = BITS) -> DataFrame:
    """(lang, bucket, n) over all rows (text, lang)."""

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        sums: dict[str, np.ndarray] = {}
        for frame in frames:
            for lang, texts in frame.groupby("lang")["text"]:
                total = sums.setdefault(lang, np.zeros(1 << bits, np.int64))
                joined, size = [], 0
                for text in texts:
                    joined.append(text)
                    size += len(text)
                    if size > PIECE:
                        for piece in _pieces(_codes(" ".join(joined))):
                            total += np.bincount(word_grams(piece, bits)[0], minlength=1 << bits)
                        joined, size = [], 0
                for piece in _pieces(_codes(" ".join(joined))):
                    total += np.bincount(word_grams(piece, bits)[0], minlength=1 << bits)
        for lang, total in sums.items():
            used = np.flatnonzero(total)
            yield pd.DataFrame({"lang": lang, "bucket": used, "n": total[used]})

    counted = rows.where("text is not null and lang is not null").select("text", "lang").mapInPandas(run, "lang string, bucket long, n long")
    return counted.groupBy("lang", "bucket").agg(F.sum("n").alias("n"))


def _group_file(path: str, number: int) -> str:
    return f"{path}/group-{number:05d}.npz"


def learn(rows: DataFrame, bits: int = BITS, group: int = GROUP) -> tuple[list[int], str]:
    """Write the model of all languages below a new shared folder; the numbers of its files, and the folder.

    A file holds the names of about ``group`` languages in order and their log frequencies as an array (bucket, language).
    """
    spark = rows.sparkSession
    path = scratch_dir(spark, "languages")
    langs = rows.where("lang is not null").select("lang").distinct()
    n_groups = -(-langs.count() // group)
    if not n_groups:
        return [], path

    def pack(key: tuple, found: pd.DataFrame) -> pd.DataFrame:
        found = found.dropna()
        total = np.full(1 << bits, SMOOTHING)
        total[found["bucket"].astype(np.int64)] += found["n"].astype(np.float64)
        return pd.DataFrame({"lang": [key[0]], "model": [np.log(total / total.sum()).astype(np.float32).tobytes()]})

    def place(key: tuple, found: pd.DataFrame) -> pd.DataFrame:
        found = found.sort_values("lang")
        out = io.BytesIO()
        model = np.stack([np.frombuffer(m, np.float32) for m in found["model"]], axis=1)
        np.savez(out, names=np.frombuffer(json.dumps(found["lang"].to_list()).encode(), np.uint8), model=model)
        system, final = fs.FileSystem.from_uri(_group_file(path, key[0]))
        temporary = f"{final}.{TaskContext.get().taskAttemptId()}"
        system.create_dir(os.path.dirname(final), recursive=True)
        with system.open_output_stream(temporary) as stream:
            stream.write(out.getvalue())
        move_into_place(system, temporary, final)
        return pd.DataFrame({"number": [key[0]], "langs": [len(found)]})

    # A language without a word stands in the model too.
    counts = gram_counts(rows, bits).unionByName(langs.selectExpr("lang", "cast(null as long) as bucket", "cast(null as long) as n"))
    packed = counts.groupBy("lang").applyInPandas(pack, "lang string, model binary")
    dealt = packed.withColumn("number", F.pmod(F.xxhash64("lang"), F.lit(n_groups)))
    placed = dealt.groupBy("number").applyInPandas(place, "number long, langs long")
    placed.write.parquet(f"{path}/manifest")
    # One number for each ``group`` languages, about.
    return sorted(r.number for r in spark.read.parquet(f"{path}/manifest").collect()), path


class Model:
    """The files of a model, opened in a task; of many, the last few stay in memory."""

    def __init__(self, groups: list[int], path: str):
        self.groups, self.path = groups, path
        self.load = functools.lru_cache(OPEN_GROUPS)(self._load)

    def _load(self, number: int) -> tuple[list[str], np.ndarray]:
        system, name = fs.FileSystem.from_uri(_group_file(self.path, number))
        with system.open_input_stream(name) as stream:
            arrays = np.load(io.BytesIO(stream.read()))
        return json.loads(arrays["names"].tobytes()), arrays["model"]

    def mixtures(self, texts: list, bits: int) -> list[tuple[list[str], np.ndarray]]:
        """Languages, in order, and proportions of each text."""
        if len(self.groups) == 1:
            names, model = self.load(self.groups[0])
            return [(names, row) for part in _slices(texts, len(names)) for row in mixtures(*_word_scores(part, model, bits))]
        best = [([], np.zeros(0))] * len(texts)
        scores: list = [None] * len(texts)
        for number in self.groups:
            found = self.load(number)
            for i, text in enumerate(texts):
                known, counts = _word_scores([text], found[1], bits)
                if not counts[0]:
                    continue
                names = best[i][0] + found[0]
                known = known if scores[i] is None else np.concatenate([scores[i], known], axis=1)
                order = sorted(range(len(names)), key=names.__getitem__)
                share = mixtures(known[:, order], counts)[0]
                kept = np.flatnonzero(share)
                best[i] = [names[order[j]] for j in kept], share[kept]
                scores[i] = known[:, [order[j] for j in kept]]
        return best


def _slices(texts: list, n_langs: int) -> Iterator[list]:
    """The texts in lists whose words take bounded memory, a single long one excepted."""
    part, size = [], 0
    for text in texts:
        if part and (size + len(text or "")) * n_langs > SCORED:
            yield part
            part, size = [], 0
        part.append(text)
        size += len(text or "")
    if part:
        yield part


def _word_scores(texts: list, model: np.ndarray, bits: int) -> tuple[np.ndarray, np.ndarray]:
    """Log likelihood of every word of ``texts`` per language, and the number of words of each text."""
    scores, counts = [], np.zeros(len(texts), np.int64)

    def add(codes: np.ndarray) -> np.ndarray:
        buckets, words = word_grams(codes, bits)
        n = int(words.max()) + 1 if len(words) else 0
        sums = [np.bincount(words, weights=model[buckets, i], minlength=n) for i in range(model.shape[1])]
        scores.append(np.array(sums, np.float32).reshape(model.shape[1], n).T)
        return n

    pending: list[tuple[int, np.ndarray]] = []

    def flush() -> None:
        if not pending:
            return
        gap = np.array([32], np.uint32)
        joined = np.concatenate([x for _, codes in pending for x in (codes, gap)])
        add(joined)
        for number, codes in pending:
            inside = _letters()[codes]
            counts[number] += int((inside[1:] & ~inside[:-1]).sum()) + int(inside[0]) if len(codes) else 0
        pending.clear()

    size = 0
    for number, text in enumerate(texts):
        codes = _codes(text or "")
        if len(codes) > PIECE:
            flush()
            size = 0
            for piece in _pieces(codes):
                counts[number] += add(piece)
            continue
        pending.append((number, codes))
        size += len(codes)
        if size > PIECE // 4:
            flush()
            size = 0
    flush()
    return (np.concatenate(scores) if scores else np.zeros((0, model.shape[1]), np.float32)), counts


def mixtures(scores: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """Proportions (text, language) of each text with words; zeros for the others. Languages left out have zero."""
    n_langs = scores.shape[1]
    out = np.zeros((len(counts), n_langs))
    has = np.flatnonzero(counts)
    if not len(has) or not n_langs:
        return out
    sizes = counts[has]
    starts = np.concatenate(([0], np.cumsum(sizes)))[:-1]
    top = scores.max(axis=1)
    likely = np.exp((scores - top[:, None]).astype(np.float64))

    def fit(allowed: np.ndarray, docs: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Proportions over ``allowed`` languages, and log likelihoods, of the texts ``docs``."""
        rows = np.concatenate([np.arange(a, a + b) for a, b in zip(starts[docs], sizes[docs], strict=True)]) if len(docs) < len(has) else slice(None)
        words, n = likely[rows], sizes[docs]
        first = np.concatenate(([0], np.cumsum(n)))[:-1]
        share = allowed / allowed.sum(axis=1, keepdims=True)
        for _ in range(STEPS):
            part = words * np.repeat(share, n, axis=0)
            part /= np.maximum(part.sum(axis=1, keepdims=True), 1e-300)
            share = np.add.reduceat(part, first, axis=0) / n[:, None]
        total = np.log(np.maximum((words * np.repeat(share, n, axis=0)).sum(axis=1), 1e-300))
        return share, np.add.reduceat(total, first)

    every = np.arange(len(has))
    full, _ = fit(np.ones((len(has), n_langs)), every)
    order = np.argsort(-full, axis=1, kind="stable")
    chosen = np.zeros((len(has), n_langs))
    chosen[every, order[:, 0]] = 1
    best, height = fit(chosen, every)
    growing = every
    for k in range(1, n_langs):
        # Texts whose next language has next to no part in the mixture of all can gain nothing by it.
        growing = growing[full[growing, order[growing, k]] * sizes[growing] > 0.5]
        if not len(growing):
            break
        larger = chosen[growing]
        larger[np.arange(len(growing)), order[growing, k]] = 1
        share, reached = fit(larger, growing)
        gains = reached - height[growing] > 0.5 * np.log(sizes[growing]) + 1e-9
        growing, share, reached = growing[gains], share[gains], reached[gains]
        chosen[growing], best[growing], height[growing] = larger[gains], share, reached
    out[has] = best
    return out


def predict(docs: DataFrame, groups: list[int], path: str, bits: int = BITS) -> DataFrame:
    """The columns of ``docs`` without text, and lang_pred, score, langs (all languages of the mixture, largest first).

    ``groups``, ``path``: a model that ``learn`` wrote.
    """
    opened = []

    def compute(texts: list) -> list:
        if not opened:
            opened.append(Model(groups, path))
        columns = [], [], []
        for names, share in opened[0].mixtures(texts, bits):
            share = np.round(share, 6)
            found = [(names[i], float(share[i])) for i in np.argsort(-share, kind="stable") if share[i] > 0]
            columns[0].append(found[0][0] if found else UNKNOWN)
            columns[1].append(min(found[0][1], 1.0) if found else 0.0)
            columns[2].append([f"{lang}:{part:.4f}" for lang, part in found])
        return list(columns)

    return map_text(docs, "lang_pred string, score double, langs array<string>", compute)


def held_out(key: str = "doc_id", folds: int = 5) -> Column:
    return (F.crc32(F.coalesce(F.col(key).cast("string"), F.lit(""))) % folds) == 0


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    prepare(spark)
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", "lang")
    rows = docs.select("doc_id", held_out().alias("held_out"), "text")
    return predict(rows, *learn(docs.where(~held_out())))
