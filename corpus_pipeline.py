"""A training-data pipeline over the documents table: five stages, each written and read again."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tremorlake.llm import decontam, language, near_text, packing, quality_model
from tremorlake.llm.common import crc_of_id, stored, table

QUALITY_LEAST = 0.3  #: probability of good quality below which a document goes
LANGUAGE_LEAST = 0.2  #: score below which no language is believed


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose quality score is at least QUALITY_LEAST."""
    model = quality_model.fit(docs, table(spark, sf_dir, "labels"), crc_of_id() % 5 != 0)
    return quality_model.score(docs, model, name="_quality").where(F.col("_quality") >= QUALITY_LEAST).drop("_quality")


def languages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents in which a language is found; those without letters or below LANGUAGE_LEAST go."""
    model = language.fit(docs, crc_of_id() % 4 != 2)
    found = language.identify(docs, model, names=("_lang", "_score", "_spans"))
    return found.where((F.col("_lang") != language.UNKNOWN) & (F.col("_score") >= LANGUAGE_LEAST)).drop("_lang", "_score", "_spans")


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies: texts that share at least 0.8 of their five-word shingles."""
    return near_text.one_of_each_group(docs)


def decontaminate(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold no benchmark item within its edit limit."""
    return decontam.clean(docs, table(spark, sf_dir, "benchmark"))


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token pieces with their sequence and offset."""
    return packing.pack(docs)


STAGES = [("quality classifier", quality), ("language ID", languages), ("near-dedup", near_dedup),
          ("benchmark decontamination", decontaminate), ("best-fit packing", pack)]
#: No SQL: a trained network, Viterbi labels and a genetic search are among the stages.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages, applied to the documents of ``sf_dir``."""
    docs = table(spark, sf_dir, "documents")
    for i, (_, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if i + 1 < len(STAGES):
            docs = stored(docs, f"stage-{i}")
    return docs
