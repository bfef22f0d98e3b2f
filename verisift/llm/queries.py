"""One query per training-data operator, over its whole table."""

from __future__ import annotations

from collections.abc import Callable

import corpus_pipeline
from pyspark.sql import DataFrame, SparkSession

from verisift.llm import (bbit, chat, decontaminate, divergence, language, lines, oracles, packing, pii, simhash,
                          source_audit, toxicity, trie, warc)
from verisift.llm.common import importable, table
from verisift.session import scratch_path

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE: dict[str, str] = {
    "op5_content_addressed_warc": oracles.WARC_SQL,
    "op8_distribution_divergence": oracles.DIVERGENCE_SQL,
    "op11_source_divergence": oracles.SOURCE_AUDIT_SQL,
    "op12_prefix_trie": oracles.TRIE_SQL,
    "op13_bbit_minhash": oracles.NEAR_DUPLICATES_SQL,
}


def _query(fn: Callable[[SparkSession, str], DataFrame]) -> Callable[[SparkSession, str], DataFrame]:
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        importable(spark)
        return fn(spark, sf_dir)

    QUERIES[fn.__name__] = run
    return run


@_query
def op8_distribution_divergence(spark: SparkSession, sf_dir: str) -> DataFrame:
    judged = divergence.quality(table(spark, sf_dir, "documents"))
    return judged.select("doc_id", *divergence.BASE, "base_failed", "kept")


@_query
def op4_simhash_ball(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.near_duplicates(table(spark, sf_dir, "documents"))


@_query
def op9_deobfuscated_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pii.scan(table(spark, sf_dir, "documents")).drop("n_added")


@_query
def op5_content_addressed_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = scratch_path(spark, "warc")
    warc.write_archive(table(spark, sf_dir, "pages"), path)
    return warc.read_archive(spark, path).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


@_query
def op7_incremental_chat_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    said = "</s>[INST] ok [/INST]"
    added = spark.createDataFrame([(-7, 0, "user", said), (-7, 1, "assistant", said)],
                                  "conv_id long, turn long, role string, text string")
    turns = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text").union(added)
    return chat.read_back(chat.format_conversations(turns))


@_query
def op6_weak_supervision_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    documents = table(spark, sf_dir, "documents").select("doc_id", "text")
    return toxicity.classify(documents, table(spark, sf_dir, "labels")).drop("text")


@_query
def op10_fuzzy_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    documents = table(spark, sf_dir, "documents").select("doc_id", "text")
    return lines.dedup_lines(documents).select("doc_id", "n_lines", "n_removed", "text")


@_query
def op2_lexical_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(table(spark, sf_dir, "documents"))


@_query
def op3_template_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    documents = table(spark, sf_dir, "documents").select("doc_id", "text")
    return decontaminate.decontaminate(documents, table(spark, sf_dir, "benchmark")).drop("text")


@_query
def op1_language_fusion(spark: SparkSession, sf_dir: str) -> DataFrame:
    return language.identify(table(spark, sf_dir, "documents"), table(spark, sf_dir, "pages"))


@_query
def op11_source_divergence(spark: SparkSession, sf_dir: str) -> DataFrame:
    return source_audit.audit(table(spark, sf_dir, "documents"))


@_query
def op12_prefix_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    paths = trie.paths_of(trie.turns_of(table(spark, sf_dir, "conversations")))
    return trie.nodes_of(trie.rebuilt(paths))


@_query
def op13_bbit_minhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bbit.near_duplicates(table(spark, sf_dir, "documents"))


@_query
def pipeline(spark: SparkSession, sf_dir: str) -> DataFrame:
    return corpus_pipeline.run(spark, sf_dir)
