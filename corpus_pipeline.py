"""The corpus pipeline: documents in, packed token pieces out.

Each stage takes ``(spark, docs, sf_dir)`` and works on all rows of the stage before; its result is written as Parquet
to the shared folder and read again, so a lost executor never costs more than one stage. All stages but the last keep
the columns of ``documents``; ``n_chars`` follows the text.

Defined results: null and empty texts pass the first three stages, hold no tokens for the mix and end there; null
doc_ids are rows like others, which the near-duplicate stage never drops; rows that repeat a doc_id are judged each by its
own text, and equal ones become one; extra columns keep their values. Empty tables give empty results.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from graphloom.llm import mixing, near_dup, packing, pii, toxicity
from graphloom.llm.queries import MIX, learns, mix_levels, tokenizer_path
from graphloom.plans.scratch import Scratch


def _counted(docs: DataFrame) -> DataFrame:
    return docs.withColumn("n_chars", F.length("text").cast("bigint")) if "n_chars" in docs.columns else docs


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Operator 5: documents that score 0.5 or more go."""
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet").select("doc_id", F.col("toxic").alias("label"))
    return toxicity.drop_toxic(docs, labels, learns(5, 0))


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Operator 9: of each group of near duplicates (five words, 0.8) the document of the least id stays."""
    return near_dup.keep_one(docs, shingle_words=5, percent=80)


def redact_personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Operator 8: personal data gives way to its kind in brackets."""
    return _counted(pii.redact(docs))


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Operator 1: target weights by domain, language and source; a document stands once for each epoch it is read in."""
    return _counted(mixing.mix_documents(docs, MIX, mix_levels()))


def pack_tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Operator 6: token pieces in windows of 2048."""
    return packing.pack_documents(docs, tokenizer_path(), end_id=1, window=2048)


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("toxicity", drop_toxic),
    ("near_dup", drop_near_duplicates),
    ("pii", redact_personal_data),
    ("mixing", mix_sources),
    ("packing", pack_tokens),
]

#: A learned classifier and a tokenizer are no SQL.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    scratch = Scratch(spark, "pipeline")
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES:
        before, docs = docs, scratch.table(stage(spark, docs, sf_dir), name, codec="snappy")
        scratch.drop(before)
    return docs
