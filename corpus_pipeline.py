"""From raw documents to a training mix, stage by stage.

Each stage takes (spark, docs, sf_dir) and returns a frame, which is written as Parquet and
read again as the next one's documents. All but the last return the columns of documents;
the last returns a row per document kept, with the copies the mix takes of it.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from tablewright.llm.common import remove_at_end
from tablewright.llm.decontaminate import drop_contaminated
from tablewright.llm.languages import keep_languages
from tablewright.llm.mixing import mix_sources
from tablewright.llm.neardup import drop_near_copies
from tablewright.llm.secrets import redact_secrets
from tablewright.session import shared_folder

Stage = Callable[[SparkSession, DataFrame, str], DataFrame]


def language_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents in a language: those without letters, or without a main language, go."""
    return keep_languages(docs)


def near_copies_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of every group of near copies."""
    return drop_near_copies(docs)


def benchmark_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold no test item."""
    return drop_contaminated(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def secrets_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, live secrets cut out of their texts."""
    return redact_secrets(docs)


def mixing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """How often the mix takes each document."""
    return mix_sources(docs)


STAGES: list[tuple[str, Stage]] = [
    ("language id", language_stage),
    ("near copies", near_copies_stage),
    ("benchmark", benchmark_stage),
    ("secrets", secrets_stage),
    ("mix", mixing_stage),
]

#: language scores, search and tilts are not for SQL; tests hold near copies, redactions, best paths,
#: the search and what the mix takes against plain loops
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the documents; what lies between them is in the shared folder until the
    application ends."""
    folder = f"{shared_folder(spark)}/pipeline-{uuid.uuid4().hex}"
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for number, (_, stage) in enumerate(STAGES):
        path = f"{folder}/{number}"
        stage(spark, docs, sf_dir).write.parquet(path)
        docs = spark.read.parquet(path)
    remove_at_end(spark, folder)
    return docs
