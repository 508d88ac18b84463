"""Corpus pipeline: raw documents to packed training sequences, one operator per stage."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, functions as F

from tidegauge.llm import benchmark, jaccard, language, packing, pii
from tidegauge.llm.common import prepare, table, written
from tidegauge.llm.queries import SEQUENCE_IDS
from tidegauge.llm.vocabularies import WORD_BPE


def recognised(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Language identification, learnt from the labelled documents: texts it rejects go."""
    prepare(spark)
    return language.accepted(docs, language.fit(docs))


def unlike(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """N-gram Jaccard join, five words and 0.8: one document of each group stays."""
    prepare(spark)
    return jaccard.keep_one(docs)


def unseen(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Benchmark decontamination: documents with a test item go."""
    return benchmark.uncontaminated(docs, table(spark, sf_dir, "benchmark"))


def sanitised(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Personal data and terms that disclose it are taken out of the texts; `n_chars` follows the text."""
    return pii.sanitise(docs).withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType))


def packed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Best-fit packing of what is left."""
    prepare(spark)
    return packing.pack(docs, WORD_BPE, SEQUENCE_IDS)


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("language identification", recognised),
    ("n-gram Jaccard join", unlike),
    ("benchmark decontamination", unseen),
    ("personal data", sanitised),
    ("best-fit packing", packed),
]
# Classifier, tokenizer and packing program have no SQL form. Tests hold the join, personal data and packing against plain
# computations, language and decontamination against what must go and what must stay.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over `documents`; each result is written to the shared folder and read by the next stage."""
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = written(spark, stage(spark, docs, sf_dir), name.replace(" ", "-"))
    return STAGES[-1][1](spark, docs, sf_dir)
