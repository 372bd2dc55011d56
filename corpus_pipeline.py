"""The corpus pipeline: quality rules, near-duplicate removal, decontamination, secret masking, tokenization.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame; what one stage returns is written and is the next
one's `docs`. All but the last return the columns of `documents`:

* quality: documents that a quality rule rejects go;
* near_duplicates: of each component of near duplicates the document with the least id stays;
* decontaminate: documents with windows of two or more benchmark items go; from others, the words of benchmark
  windows are cut out;
* mask_secrets: secrets in the text are replaced by a mask;
* tokenize: one row per document, with its token ids.

`n_chars` follows the text where a stage changes it. Nulls, repeated rows and empty tables: see the operators.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from parchlake.llm import decontam, nearjoin, pieces, quality, secretscan
from parchlake.llm.common import cut, table


def _counted(df: DataFrame) -> DataFrame:
    return df.withColumn("n_chars", F.length("text").cast(df.schema["n_chars"].dataType)) if "n_chars" in df.columns else df


def stage_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return quality.keep_good(docs)


def stage_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return nearjoin.keep_one(docs)


def stage_decontaminate(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return _counted(decontam.clean(docs, table(spark, sf_dir, "benchmark")))


def stage_mask_secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return _counted(secretscan.redact(docs))


def stage_tokenize(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return pieces.encode_texts(docs, numbers=True, remember=200_000).select("doc_id", "n_tokens", "ids")


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("quality", stage_quality),
    ("near_duplicates", stage_near_duplicates),
    ("decontaminate", stage_decontaminate),
    ("mask_secrets", stage_mask_secrets),
    ("tokenize", stage_tokenize),
]

#: The agenda, the guess costs and the components of whole tables are beyond SQL; tests compare with brute force.
ORACLE_SQL: str | None = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = cut(stage(spark, docs, sf_dir), f"pipeline-{name}")
    return STAGES[-1][1](spark, docs, sf_dir)
