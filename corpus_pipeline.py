"""From raw documents to packed sequences, in five stages; each stage's rows are written and read again by the next."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from taxaspark.llm import language, mix, packing, secrets
from taxaspark.llm.common import Scratch, table
from taxaspark.llm.ngram_join import NgramJoin

#: Documents whose language is told with less certainty than this go.
LEAST_SCORE = 0.5


def identify_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return language.keep_identified(docs, LEAST_SCORE)


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each component stays: of the smallest id, and of its texts there the one of the least hash."""
    return NgramJoin(docs).representatives(docs)


def redact_secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return secrets.redact(docs)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return mix.mix(docs)


def pack_sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return packing.pack(docs)


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("language_id", identify_language),
    ("near_duplicates", drop_near_duplicates),
    ("secret_scan", redact_secrets),
    ("mix_sources", mix_sources),
    ("best_fit_packing", pack_sequences),
]

#: A trained model and a tokenizer decide, which SQL can't express; tests hold run() against a plain version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The rows of the last stage. A stage's tables, and what it read, go as soon as its result is written."""
    others = Scratch.roots()
    scratch = Scratch(spark)
    docs = None
    for _, stage in STAGES:
        before, docs = docs, scratch.keep(stage(spark, table(spark, sf_dir, "documents") if docs is None else docs, sf_dir))
        Scratch.drop_all(but=others | {scratch.root})
        if before is not None:
            scratch.drop(before)
    return docs
