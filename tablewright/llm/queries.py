"""The registered queries of this subpackage, each over its whole table, and their SQL twins."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from tablewright.llm.common import read_table

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(run: Callable[[SparkSession, str], DataFrame]) -> Callable[[SparkSession, str], DataFrame]:
    QUERIES[run.__name__] = run
    return run


@query
def op4_license_scans(spark: SparkSession, folder: str) -> DataFrame:
    from tablewright.llm.licenses import find_licenses

    return find_licenses(read_table(spark, folder, "documents"))


@query
def op5_secret_scans(spark: SparkSession, folder: str) -> DataFrame:
    from tablewright.llm.secrets import secret_digest

    return secret_digest(read_table(spark, folder, "documents"))


@query
def op1_mixing_sources(spark: SparkSession, folder: str) -> DataFrame:
    from tablewright.llm.mixing import mix_digest

    return mix_digest(read_table(spark, folder, "documents"))


@query
def op2_language_id(spark: SparkSession, folder: str) -> DataFrame:
    from tablewright.llm.languages import language_digest

    return language_digest(read_table(spark, folder, "documents"))


@query
def op3_token_counts(spark: SparkSession, folder: str) -> DataFrame:
    import public_tokenizers

    from tablewright.llm.tokens import count_tokens

    return count_tokens(read_table(spark, folder, "documents"), str(public_tokenizers.path("word_bpe_49k.json")))


@query
def op7_minhash_near_dedup(spark: SparkSession, folder: str) -> DataFrame:
    from tablewright.llm.neardup import similar_groups

    return similar_groups(read_table(spark, folder, "documents"))


@query
def op10_benchmark_decontamination(spark: SparkSession, folder: str) -> DataFrame:
    from tablewright.llm.decontaminate import find_leaks

    return find_leaks(read_table(spark, folder, "documents"), read_table(spark, folder, "benchmark"))


@query
def op6_exact_top_k(spark: SparkSession, folder: str) -> DataFrame:
    from tablewright.llm.topk import topk_digest

    return topk_digest(read_table(spark, folder, "embeddings"))


def _oracles() -> dict[str, str]:
    from tablewright.llm import collocations, lexical, neardup, secrets, topk

    return {
        "op5_secret_scans": secrets.ORACLE, "op6_exact_top_k": topk.ORACLE, "op7_minhash_near_dedup": neardup.ORACLE,
        "op11_phrase_collocations": collocations.ORACLE, "op12_ranked_lexical_search": lexical.ORACLE,
    }


ORACLES.update(_oracles())


@query
def op8_lm_scoring(spark: SparkSession, folder: str) -> DataFrame:
    from tablewright.llm.lm import lm_digest

    return lm_digest(read_table(spark, folder, "documents"))


@query
def op9_toxicity(spark: SparkSession, folder: str) -> DataFrame:
    from tablewright.llm.toxicity import toxicity_digest

    return toxicity_digest(read_table(spark, folder, "documents"), read_table(spark, folder, "labels"))


@query
def op13_simhash_near_dedup(spark: SparkSession, folder: str) -> DataFrame:
    from tablewright.llm.simhash import fingerprint_groups

    return fingerprint_groups(read_table(spark, folder, "documents"))


@query
def op12_ranked_lexical_search(spark: SparkSession, folder: str) -> DataFrame:
    from tablewright.llm.lexical import search

    return search(read_table(spark, folder, "documents"), read_table(spark, folder, "benchmark"))


@query
def op11_phrase_collocations(spark: SparkSession, folder: str) -> DataFrame:
    from tablewright.llm.collocations import collocations

    return collocations(read_table(spark, folder, "documents"))
