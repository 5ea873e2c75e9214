"""Registered corpus queries: name -> (callable, check SQL or None)."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

import corpus_pipeline
from tidemark.llm import conversations, embedding_dedup, fingerprints, main_text, mixing, near_dedup, packing, periodic_runs, pii, quality, token_files, toxicity, url_filter
from tidemark.llm.common import table

ENTRIES: dict[str, tuple[Callable[[SparkSession, str], DataFrame], str | None]] = {}


def registered(name: str, sql: str | None = None):
    def keep(fn):
        ENTRIES[name] = (fn, sql)
        return fn

    return keep


@registered("op10_mix_sources", mixing.ORACLE_SQL)
def op10(spark: SparkSession, folder: str) -> DataFrame:
    taken = mixing.mixed(table(spark, folder, "documents").select("doc_id", "source", "text"))
    return taken.select(
        "row.doc_id", "size", "source_size", "target", (F.col("size") * F.col("copies")).alias("taken")
    )


@registered("op2_url_filter", url_filter.ORACLE_SQL)
def op2(spark: SparkSession, folder: str) -> DataFrame:
    pages = table(spark, folder, "pages").select("page_id", "url")
    return url_filter.judged(pages, url_filter.rules_frame(spark))


@registered("op6_fingerprints")
def op6(spark: SparkSession, folder: str) -> DataFrame:
    return fingerprints.fingerprints(table(spark, folder, "documents").select("doc_id", "text"))


@registered("op7_best_fit_packing")
def op7(spark: SparkSession, folder: str) -> DataFrame:
    return packing.packed(table(spark, folder, "documents").select("doc_id", "source", "text"))


@registered("op8_token_files")
def op8(spark: SparkSession, folder: str) -> DataFrame:
    import public_tokenizers

    docs = table(spark, folder, "documents").select("doc_id", "text")
    return token_files.encoded(docs, public_tokenizers.path("byte_bpe_50k.json"))


@registered("op3_embedding_links")
def op3(spark: SparkSession, folder: str) -> DataFrame:
    return embedding_dedup.linked(table(spark, folder, "embeddings").select("vec_id", "embedding"))


@registered("op1_quality")
def op1(spark: SparkSession, folder: str) -> DataFrame:
    labels = table(spark, folder, "labels").select("doc_id", F.col("quality").alias("label"))
    return quality.scored(table(spark, folder, "documents").select("doc_id", "text"), labels)


@registered("op4_personal_data")
def op4(spark: SparkSession, folder: str) -> DataFrame:
    return pii.tagged(table(spark, folder, "documents").select("doc_id", "text"))


@registered("op5_toxicity")
def op5(spark: SparkSession, folder: str) -> DataFrame:
    labels = table(spark, folder, "labels").select("doc_id", F.col("toxic").alias("label"))
    return toxicity.scored(table(spark, folder, "documents").select("doc_id", "text"), labels)


@registered("op9_near_duplicates")
def op9(spark: SparkSession, folder: str) -> DataFrame:
    return near_dedup.classes_of(table(spark, folder, "documents").select("doc_id", "text"))


@registered("op11_html_extraction")
def op11(spark: SparkSession, folder: str) -> DataFrame:
    found = main_text.extracted(table(spark, folder, "pages").select("page_id", "url", "html"))
    return found.select("row.page_id", "row.url", "text", "n_chars")


@registered("op12_periodic_runs")
def op12(spark: SparkSession, folder: str) -> DataFrame:
    return periodic_runs.periodic(table(spark, folder, "documents").select("doc_id", "text"))


@registered("op13_conversation_repair")
def op13(spark: SparkSession, folder: str) -> DataFrame:
    return conversations.repair(table(spark, folder, "conversations").select("conv_id", "turn", "role", "text"))


@registered("pipeline", corpus_pipeline.ORACLE_SQL)
def pipeline(spark: SparkSession, folder: str) -> DataFrame:
    return corpus_pipeline.run(spark, folder)
