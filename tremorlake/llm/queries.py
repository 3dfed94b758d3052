"""Registered queries of this subpackage and, where SQL can express them, their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tremorlake.llm import decontam, html_text, language, packing, periodic_runs, quality_model, quality_rules, resharding, simhash, token_counts, token_files, vector_codes, vector_packing
from tremorlake.llm.common import crc_of_id, table
from tremorlake.llm.oracles import vector_codes_sql

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    def add(fn):
        QUERIES[name] = fn
        if sql is not None:
            ORACLES[name] = sql
        return fn
    return add


@query("op5_simhash_near_dedup")
def op5(spark: SparkSession, sf_dir: str) -> DataFrame:
    return (simhash.near_groups(table(spark, sf_dir, "documents"))
            .select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id"))


@query("op9_quality_model")
def op9(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    model = quality_model.fit(docs, table(spark, sf_dir, "labels"), crc_of_id() % 5 != 0)
    scored = quality_model.score(docs, model, ["doc_id"])
    return scored.select("doc_id", (crc_of_id() % 5 == 0).alias("held_out"), "score", (F.col("score") >= 0.3).cast("int").alias("predicted"))


@query("op2_language_id")
def op2(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    model = language.fit(docs, crc_of_id() % 4 != 2)
    out = language.identify(docs, model, ["doc_id"])
    return out.select("doc_id", (crc_of_id() % 4 == 2).alias("held_out"), "lang_pred", "score", F.size("lang_spans").alias("n_spans"))


@query("op1_best_fit_packing")
def op1(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(table(spark, sf_dir, "documents"))


@query("op4_decontamination")
def op4(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontam.hits(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


@query("op6_token_counts")
def op6(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_counts.count_tokens(table(spark, sf_dir, "documents"))


@query("op10_token_files")
def op10(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_files.round_trip(table(spark, sf_dir, "documents"))


@query("op7_quality_rules")
def op7(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality_rules.judge(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


@query("op3_flow_resharding")
def op3(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = resharding.reshard(table(spark, sf_dir, "documents"))
    return out.select("doc_id", resharding.size_of().alias("size"), resharding.text_crc().alias("text_crc32"), F.lit("bytes").alias("law"),
                      "shard", "slot", F.lit(None).cast("int").alias("grown_shard"))


@query("op8_html_text")
def op8(spark: SparkSession, sf_dir: str) -> DataFrame:
    return html_text.main_text(table(spark, sf_dir, "pages"), ["page_id", "url"])


@query("op12_vector_codes", vector_codes_sql())
def op12(spark: SparkSession, sf_dir: str) -> DataFrame:
    return vector_codes.code_vectors(table(spark, sf_dir, "embeddings"))


def with_repeats(docs: DataFrame) -> DataFrame:
    """(doc_id, text): one text in ten, by the crc32 h of its id, goes on with its word a + (i - a) mod p from its word a on."""
    h, words = crc_of_id(), F.regexp_extract_all(F.coalesce("text", F.lit("")), F.lit(r"[^\x20\x09-\x0D]+"), F.lit(0))
    g, n = F.floor(h / 10), F.size(words)
    a = (g % n).cast("int")
    p = (F.floor((n - a) / (g % 8 + 3)) + 1).cast("int")
    tail = F.flatten(F.array_repeat(F.slice(words, a + 1, p), F.ceil((n - a) / p).cast("int")))
    repeated = F.array_join(F.slice(F.concat(F.slice(words, 1, a), tail), 1, n), " ")
    return docs.select("doc_id", F.when((h % 10 == 0) & (n > 0), repeated).otherwise(F.col("text")).alias("text"))


@query("op11_periodic_runs")
def op11(spark: SparkSession, sf_dir: str) -> DataFrame:
    return periodic_runs.find_runs(with_repeats(table(spark, sf_dir, "documents")), texts=False).drop("runs")


@query("op13_vector_packing")
def op13(spark: SparkSession, sf_dir: str) -> DataFrame:
    return vector_packing.pack(table(spark, sf_dir, "documents"))
