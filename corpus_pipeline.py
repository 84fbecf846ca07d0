"""A training corpus from ``documents``: quality rules, toxicity, near-dedup, substring dedup, packing.

Each stage takes (spark, docs, sf_dir) and works on every document that the stage before kept; it is
written as Parquet and read again before the next one. All but the last return the columns of
``documents``; the last returns the packed pieces. Documents that quality or toxicity rejects go, one
document of each near-duplicate group stays, repeated passages are cut out of the texts.

Defined results: a document is a row with a doc_id, and rows without one go with the first stage that joins by it (toxicity
or near-dedup, at the latest); null and empty texts base-fail the quality rules and go; very long texts are handled
whole; of rows that repeat a doc_id one is left; an empty table gives an empty result; columns other than
those of ``documents``, whatever their names, are dropped.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from weblake.llm.common import stage, table
from weblake.llm.near_dup import near_duplicates
from weblake.llm.packing import packed_documents
from weblake.llm.quality import learn_field, line_quality
from weblake.llm.substring_dedup import without_repeats
from weblake.llm.toxicity import learn_toxicity, toxicity

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]


def quality_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the line field and the base rules keep."""
    field = learn_field(docs, table(spark, sf_dir, "labels"))
    return line_quality(docs, field, carry=COLUMNS).where("kept").select("carried.*")


def toxicity_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that are not predicted to be toxic."""
    model = learn_toxicity(docs, table(spark, sf_dir, "labels"))
    return toxicity(docs, model, carry=COLUMNS).where("predicted = 0").select("carried.*")


def near_dedup_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document (the smallest doc_id) of each group: five-word shingles, similarity 0.8."""
    kept = near_duplicates(docs, width=5, percent=80).where("kept").select("doc_id")
    return docs.join(kept, "doc_id", "left_semi").select(*COLUMNS)


def substring_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without the passages of 20 words or more that occur earlier; a text may become empty."""
    cut = without_repeats(docs, with_text=True, carry=["lang", "source"])
    return cut.select("doc_id", "text", "carried.*", F.char_length("text").cast("long").alias("n_chars"))


def packing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token pieces in sequences of at most 2048 tokens."""
    return packed_documents(docs, public_tokenizers.path("byte_bpe_50k.json"))


STAGES = [
    ("quality rules", quality_stage),
    ("toxicity", toxicity_stage),
    ("near-dedup", near_dedup_stage),
    ("substring dedup", substring_stage),
    ("best-fit packing", packing_stage),
]

# The fitted models, the tokenizer and the packing are beyond SQL; tests compare with brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``; what lies between two of them is written and read again."""
    docs = table(spark, sf_dir, "documents")
    for name, step in STAGES[:-1]:
        docs = stage(step(spark, docs, sf_dir), name.replace(" ", "-"))
    return STAGES[-1][1](spark, docs, sf_dir)
