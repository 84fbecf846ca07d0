"""The queries of the operators of this subpackage, and SQL for those that SQL can express."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession

import corpus_pipeline
from weblake.llm import oracles
from weblake.llm.common import table
from weblake.llm.hmm import hmm_scores
from weblake.llm.licenses import learn_weights, scan_licenses
from weblake.llm.near_dup import near_duplicates
from weblake.llm.mixing import mixed_documents
from weblake.llm.neighbours import nearest
from weblake.llm.packing import packed_documents
from weblake.llm.pages import extract_pages
from weblake.llm.pieces import piece_ids
from weblake.llm.quality import learn_field, line_quality
from weblake.llm.repair import repaired_conversations
from weblake.llm.spelling import spelling_variants
from weblake.llm.substring_dedup import without_repeats
from weblake.llm.toxicity import learn_toxicity, toxicity


def op1_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return scan_licenses(docs, learn_weights(docs))


def op2_pieces(spark: SparkSession, sf_dir: str) -> DataFrame:
    return piece_ids(table(spark, sf_dir, "documents"), public_tokenizers.path("piece_bpe_32k.model"))


def op3_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return toxicity(docs, learn_toxicity(docs, table(spark, sf_dir, "labels")))


def op4_line_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return line_quality(docs, learn_field(docs, table(spark, sf_dir, "labels")))


def op5_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return without_repeats(table(spark, sf_dir, "documents"))


def op6_hmm(spark: SparkSession, sf_dir: str) -> DataFrame:
    return hmm_scores(table(spark, sf_dir, "documents"))


def op7_nearest(spark: SparkSession, sf_dir: str) -> DataFrame:
    return nearest(table(spark, sf_dir, "embeddings"))


def op8_minhash_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(table(spark, sf_dir, "documents"), width=3, percent=85)


def op9_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packed_documents(table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json"))


def op10_page_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return extract_pages(table(spark, sf_dir, "pages"))


def op11_conversation_repair(spark: SparkSession, sf_dir: str) -> DataFrame:
    return repaired_conversations(table(spark, sf_dir, "conversations"))


def op12_spelling_variants(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spelling_variants(table(spark, sf_dir, "documents"))


def op13_source_mixture(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixed_documents(table(spark, sf_dir, "documents"))


def queries() -> dict:
    return {
        "op1_license_scan": op1_license_scan,
        "op2_pieces": op2_pieces,
        "op3_toxicity": op3_toxicity,
        "op4_line_quality": op4_line_quality,
        "op5_substring_dedup": op5_substring_dedup,
        "op6_hmm": op6_hmm,
        "op7_nearest": op7_nearest,
        "op8_minhash_join": op8_minhash_join,
        "op9_packing": op9_packing,
        "op10_page_text": op10_page_text,
        "op11_conversation_repair": op11_conversation_repair,
        "op12_spelling_variants": op12_spelling_variants,
        "op13_source_mixture": op13_source_mixture,
        "pipeline": corpus_pipeline.run,
    }


def oracle_sql() -> dict[str, str]:
    return oracles.statements()
