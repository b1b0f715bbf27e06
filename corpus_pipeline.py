"""From raw documents to token files: each stage is one operator of ``fretwork.llm`` over all rows its predecessor kept.

The stages but the last take and return the columns of documents. ``run`` writes each stage's rows as Parquet below the
shared folder and reads them back for the next one. The last stage writes the token files and returns what it reads back
from them, a row per document of the mixture.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from fretwork.llm import decontamination, mixing, quality, simhash, token_files
from fretwork.llm.common import prepare, table
from fretwork.session import materialize

TOKENIZER = "byte_bpe_50k.json"


def quality_classifier(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the importance resampling draws; the others go."""
    prepare(spark)
    return quality.resample(docs, table(spark, sf_dir, "labels"))


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near-copies stays, the one with the smallest doc_id."""
    prepare(spark)
    return simhash.one_per_group(docs)


def benchmark_decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that overlap no benchmark item."""
    prepare(spark)
    return decontamination.clean(docs, table(spark, sf_dir, "benchmark"))


def source_mixture(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents as often as the mixture of sources takes them; those it does not take go."""
    prepare(spark)
    return mixing.mix(docs)


def token_output(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token files of the mixture: (doc_id, start, n_tokens, ids_crc32, found) per document, read back from them."""
    import public_tokenizers

    prepare(spark)
    return token_files.round_trip(docs, public_tokenizers.path(TOKENIZER))


STAGES = [
    ("quality_classifier", quality_classifier),
    ("near_duplicates", near_duplicates),
    ("benchmark_decontamination", benchmark_decontamination),
    ("source_mixture", source_mixture),
    ("token_output", token_output),
]

# SQL has no XXH64 of shingles, no hashed language models and no tokenizer; tests/llm/test_pipeline.py compares with plain Python.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        docs = materialize(stage(spark, docs, sf_dir), f"pipeline-{name}")
    return STAGES[-1][1](spark, docs, sf_dir)
