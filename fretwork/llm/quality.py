"""Quality classifier by importance resampling.

Two generative models over hashed word 1- and 2-grams, of target text (labelled good and not toxic) and of the raw
corpus, give each document the mean log ratio of its n-grams, so that long texts are not preferred as such. n-grams of one
text are far from independent, so the sum would be much too sure; how many of them the mean is worth is fitted on the labels: the
slope of a logistic curve from mean ratio to good or bad. Mean times slope is the weight, in natural logarithms of odds.
Gumbel noise is added and the ``k`` largest keys are the sample, which draws without replacement in proportion to the weights:
what the models are sure of stays or goes, what lies between is drawn by its odds. ``k`` is the share of good documents
among the labelled ones, times the number of documents.

Raw counts cover all documents. Target counts come from at most about ``FIT_ROWS`` labelled documents, taken by a hash of
the id, so their ids may be broadcast; the curve is fitted on as many. The models have ``2 ** BITS`` entries at any size of input, and each task sends
one count per entry at most. The k-th key is found by counting in bins.

Nulls and ties: a text that is null or has no words has weight 0. Labels with a null quality count for nothing, a null
toxic as 0; of several labels of one document the worst counts. Without any good label nothing is rejected, without any bad
one the slope is ``REFERENCE``. Equal keys
stand or fall together (rows that repeat have equal keys). An empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from fretwork.llm.common import kth_largest, map_text, prepare, row_key, spread, table, without, word_hashes
from fretwork.session import materialize

BITS = 18
FIT_ROWS = 200_000
REFERENCE = 1000
SMOOTHING = 1.0
RIDGE = 0.01
SEED = 5
_SCALE = 1 << 20
# Characters of text whose n-grams a task makes at once.
SLICE = 1 << 18


def grams(texts, bits: int = BITS) -> tuple[np.ndarray, np.ndarray]:
    """Buckets of the 1- and 2-grams of all texts in order, and the number of n-grams of each text."""
    hashes, counts = word_hashes(texts)
    ends = np.cumsum(counts)
    two = np.empty(2 * len(hashes), np.int64)
    two[0::2] = spread(hashes, bits)
    with np.errstate(over="ignore"):
        two[1:-1:2] = spread(hashes[:-1] * np.uint64(0xD6E8FEB86659FD93) + hashes[1:], bits)
    keep = np.ones(len(two), bool)
    keep[2 * ends[counts > 0] - 1] = False
    return two[keep], np.where(counts > 0, 2 * counts - 1, 0)


def _slices(texts) -> Iterator[slice]:
    """Stretches of ``texts`` of about ``SLICE`` characters: the n-grams of a whole batch take many times its bytes."""
    start = size = 0
    for at, text in enumerate(texts):
        size += 0 if text is None else len(text)
        if size >= SLICE:
            yield slice(start, at + 1)
            start, size = at + 1, 0
    if start < len(texts):
        yield slice(start, len(texts))


def count_grams(frames: Iterator[pd.DataFrame], bits: int = BITS) -> tuple[np.ndarray, np.ndarray]:
    """Raw and target counts per bucket of frames (text, target)."""
    raw, target = np.zeros(1 << bits, np.int64), np.zeros(1 << bits, np.int64)
    for frame in frames:
        texts, of_target = frame["text"].tolist(), frame["target"].to_numpy(bool)
        for part in _slices(texts):
            buckets, counts = grams(texts[part], bits)
            raw += np.bincount(buckets, minlength=1 << bits)
            target += np.bincount(buckets[np.repeat(of_target[part], counts)], minlength=1 << bits)
    return raw, target


def mean_ratios(texts: list, ratios: np.ndarray, bits: int = BITS) -> np.ndarray:
    """Mean of ``ratios`` over the n-grams of each text; 0 without n-grams."""
    means, sums = [np.zeros(0)], np.zeros(1)
    for part in _slices(texts):
        buckets, counts = grams(texts[part], bits)
        sums = np.cumsum(np.concatenate((sums[-1:], ratios[buckets])))  # goes on from the slice before, so slices change no digit
        ends = np.cumsum(counts)
        means.append(np.round((sums[ends] - sums[ends - counts]) / np.maximum(counts, 1), 9))
    return np.concatenate(means)


def _gram_counts(docs: DataFrame, bits: int) -> DataFrame:
    """(bucket, raw, target) counts over all rows of ``docs`` (text, target)."""

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        raw, target = count_grams(frames, bits)
        used = np.flatnonzero(raw)
        yield pd.DataFrame({"bucket": used, "raw": raw[used], "target": target[used]})

    counted = docs.mapInPandas(run, "bucket long, raw long, target long")
    return counted.groupBy("bucket").agg(F.sum("raw").alias("raw"), F.sum("target").alias("target"))


def log_ratios(docs: DataFrame, good: DataFrame, bits: int = BITS) -> np.ndarray | None:
    """log p_target / p_raw per bucket; None without target text. ``good``: (doc_id) of bounded size."""
    marked = docs.select("doc_id", "text").join(F.broadcast(good.withColumn("target", F.lit(True))), "doc_id", "left")
    counts = _gram_counts(marked.select("text", F.coalesce("target", F.lit(False)).alias("target")), bits).toPandas()
    raw, target = np.zeros(1 << bits), np.zeros(1 << bits)
    raw[counts["bucket"]], target[counts["bucket"]] = counts["raw"], counts["target"]
    if not target.sum():
        return None
    share = target.sum() / raw.sum()
    return (np.log(target + SMOOTHING) - np.log(raw * share + SMOOTHING)).astype(np.float32)


def _weights(docs: DataFrame, ratios: np.ndarray | None, bits: int) -> DataFrame:
    shared = docs.sparkSession.sparkContext.broadcast(np.zeros(1 << bits, np.float32) if ratios is None else ratios)

    def weights(texts: list) -> list:
        return [mean_ratios(texts, shared.value, bits)]

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), row_key().alias("_row"), "text")
    return map_text(rows, "mean_ratio double", weights)


def fitted_slope(ratios: np.ndarray, good: np.ndarray) -> float:
    """Slope of the logistic curve from ``ratios`` to ``good`` (0 or 1), by Newton's method with a small ridge."""
    if not 0 < good.sum() < len(good):
        return float(REFERENCE)
    slope, shift = 1.0, 0.0
    for _ in range(100):
        p = 1 / (1 + np.exp(-np.clip(slope * ratios + shift, -30, 30)))
        w = p * (1 - p) + 1e-9
        gradient = np.array([((p - good) * ratios).sum() + RIDGE * slope, (p - good).sum()])
        curve = np.array([[(w * ratios * ratios).sum() + RIDGE, (w * ratios).sum()], [(w * ratios).sum(), w.sum()]])
        step = np.linalg.solve(curve, gradient)
        slope, shift = slope - step[0], shift - step[1]
        if abs(step).max() < 1e-9:
            break
    return round(min(max(slope, 1.0), float(REFERENCE)), 6)


def drawn_keys(log_weight: Column, seed: Column) -> Column:
    """Weight plus Gumbel noise, which is a function of the seed and of doc_id and text."""
    uniform = (F.shiftrightunsigned(F.xxhash64(seed, "doc_id", "_row"), 11) + F.lit(0.5)) / F.lit(float(1 << 53))
    return F.round(log_weight - F.log(-F.log(uniform)), 6)


def score(docs: DataFrame, labels: DataFrame, seed: int = SEED, bits: int = BITS, fit_rows: int = FIT_ROWS) -> DataFrame:
    """(doc_id, _row, mean_ratio, log_weight, key, kept) per row of ``docs``."""
    spark = docs.sparkSession
    prepare(spark)
    known = labels.where("doc_id is not null and quality is not null").groupBy("doc_id")
    known = known.agg(F.min("quality").alias("quality"), F.max(F.coalesce("toxic", F.lit(0))).alias("toxic"))
    known = materialize(known, "quality-labels")
    n, n_good = known.agg(F.count(F.lit(1)), F.count(F.when(F.col("quality") == 1, 1))).first()
    rate = min(1.0, fit_rows / max(n, 1))
    drawn = F.pmod(F.xxhash64("doc_id", F.lit(seed)), F.lit(1 << 30)) < int(rate * (1 << 30))
    good = known.where(drawn & (F.col("quality") == 1) & (F.col("toxic") == 0)).select("doc_id")
    ratios = log_ratios(docs, good, bits)

    rows = materialize(_weights(docs, ratios, bits), "quality-ratios")
    told = rows.join(known.where(drawn), "doc_id").select("mean_ratio", (F.col("quality") == 1).alias("good")).toPandas()
    slope = fitted_slope(told["mean_ratio"].to_numpy(float), told["good"].to_numpy(float))
    rows = rows.withColumn("log_weight", F.round(F.col("mean_ratio") * slope, 6))
    rows = rows.withColumn("key", drawn_keys(F.col("log_weight"), F.lit(seed)))
    rows = rows.withColumn("_key", F.floor(F.col("key") * _SCALE))
    if ratios is None:
        return rows.withColumn("kept", F.lit(True)).drop("_key")
    k = round(n_good / n * rows.count())
    least = kth_largest(rows, "_key", k) if k else None
    kept = F.lit(False) if least is None else F.col("_key") >= least
    return rows.withColumn("kept", kept).drop("_key")


def resample(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """The rows of ``docs`` that are drawn."""
    rejected = score(docs, labels).where("not kept").select("doc_id", "_row").distinct()
    return without(docs, rejected)


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return score(docs, table(spark, sf_dir, "labels")).select("doc_id", "log_weight", "key", "kept")
