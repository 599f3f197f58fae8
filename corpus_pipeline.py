"""From raw documents to packed sequences: the stages of the corpus pipeline.

Each stage reads what its predecessor kept, written as Parquet; all but the last return the columns of
documents. Rows with nulls in other columns, extra columns and repeated rows pass through as they are; an
empty table passes every stage.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from perigee.llm import decontaminate, exact_dedup, language, packing, simhash
from perigee.llm.queries import tokenizer_path
from perigee.llm.shared import ensure_checkpoint_dir, held_out, small_batches, unique_name


def language_id(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops texts without a letter and those whose main language isn't clear (less than half sure)."""
    small_batches(spark)
    model = language.fit(docs.where(~held_out(F.col("doc_id"), 5, 0)))
    return language.keep_identified(docs, model, least_score=0.5)


def exact_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps the row of the smallest doc_id of each group of equal texts."""
    return exact_dedup.drop_exact_copies(docs)


def near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps the row of the smallest doc_id of each group of near copies: five words, similarity 0.8."""
    small_batches(spark)
    return simhash.drop_near_copies(docs, shingle=5, similarity=0.8)


def benchmark_passages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops documents in which a window of a benchmark item occurs."""
    return decontaminate.drop_contaminated(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def packed_sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Where each token piece of the remaining documents goes."""
    return packing.pack_documents(docs, tokenizer_path())


STAGES = [
    ("language_id", language_id),
    ("exact_dedup", exact_copies),
    ("simhash_near_dedup", near_copies),
    ("benchmark_decontamination", benchmark_passages),
    ("best_fit_packing", packed_sequences),
]

#: SimHash components and token ids have no SQL; tests/llm/test_pipeline.py has the brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over documents, each written to the shared folder and read again."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    base = f"{ensure_checkpoint_dir(spark).rstrip('/')}/{unique_name('pipeline')}"
    for k, (name, stage) in enumerate(STAGES):
        out = stage(spark, docs, sf_dir)
        if k == len(STAGES) - 1:
            return out
        out.write.parquet(f"{base}/{k}_{name}")
        docs = spark.read.parquet(f"{base}/{k}_{name}")
    return docs
