"""A corpus from documents to token files: quality, near-copies, benchmark passages, mixture, token ids.

Each stage is written as Parquet in the shared folder and read again by the next.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from ruleweave.llm import decontaminate, near_dedup, quality, source_mix, token_binary
from ruleweave.llm.queries import table
from ruleweave.llm.shared import kept

Stage = Callable[[SparkSession, DataFrame, str], DataFrame]


def good_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rows whose text scores 0.5 or more, by a classifier learnt from the labels."""
    model = quality.fit_quality(docs, table(spark, sf_dir, "labels"))
    return quality.good_quality(docs, model)


def without_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One row of each group of near-copies (five-word shingles, similarity 0.8)."""
    return near_dedup.deduplicated(docs, words=5, threshold=(80, 100), band_rows=4)


def without_benchmark(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rows that hold no passage of the benchmark."""
    return decontaminate.decontaminate(docs, table(spark, sf_dir, "benchmark"))


def mixed_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rows as often as the mixture of sources takes them."""
    return source_mix.mixed(docs)


def token_files(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Writes the token ids and returns each row's place in the files: doc_id, start, n_tokens, ids_crc32."""
    return token_binary.read_token_index(spark, token_binary.write_token_blocks(docs))


STAGES: list[tuple[str, Stage]] = [
    ("quality", good_quality),
    ("near_dedup", without_near_copies),
    ("decontaminate", without_benchmark),
    ("mix", mixed_sources),
    ("tokens", token_files),
]

#: SQL can't express the classifier, the tokenizer or the files; the stages are tested against plain versions.
ORACLE_SQL: str | None = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = kept(stage(spark, docs, sf_dir), f"stage-{name}")
    return STAGES[-1][1](spark, docs, sf_dir)
