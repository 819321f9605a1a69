"""The corpus pipeline: five operators in a row over ``documents``.

Each stage takes all rows its predecessor kept, as a table that was written
and read again, and all but the last return the columns of ``documents``.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from braidql.llm import decontaminate, mixing, neardup, quality, tokenbin
from braidql.llm.storage import materialize


def keep_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose quality score is 0.3 or more."""
    model = quality.fit_on_labels(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))
    name = "__quality"
    return quality.score(docs, model, meta_cols=("n_chars",), out=name).filter(F.col(name) >= 0.3).drop(name)


def keep_one_of_each_group(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each class of near copies, the one of least id."""
    return neardup.drop_near_duplicates(docs)


def keep_uncontaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold no benchmark passage."""
    return decontaminate.drop_contaminated(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def mix_to_weights(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents as often as the mix of sources holds them."""
    return mixing.apply_mix(docs)


def write_token_frames(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token files of what is left; a row for each document, read back from them."""
    return tokenbin.read_tokens(tokenbin.write_tokens(docs), full=False).select("doc_id", "start", "n_tokens", "ids_crc32")


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("quality_classifier", keep_quality),
    ("ngram_jaccard_join", keep_one_of_each_group),
    ("benchmark_decontamination", keep_uncontaminated),
    ("mix_sources", mix_to_weights),
    ("token_frames", write_token_frames),
]

#: Scores, MinHash and byte-pair ids have no SQL form; tests hold each stage against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``, each written and read again before the next."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for i, (name, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if i < len(STAGES) - 1:
            docs = materialize(docs, f"pipeline-{name}")
    return docs
