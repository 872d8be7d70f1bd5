"""The corpus pipeline: documents to packed training sequences.

Language ID and quality rules reject documents, of near copies one document stays, repeated passages
are cut out, and what is left is packed. Each stage works on all that the one before kept.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from tessera.llm import langid, ngram_join, packing, quality, suffix
from tessera.llm.common import materialize, table
from tessera.llm.queries import tokenizer_path

SHINGLE_WORDS, SIMILARITY = 5, (80, 100)
#: Bytes of a passage that counts as repeated: less than 50 short words have.
PASSAGE_BYTES = 200


def language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Without documents of no identified language. Learns from the labelled documents themselves."""
    return langid.keep_identified(docs, langid.fit(langid.train_split(docs)))


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Without documents that fail the base check or are probably bad."""
    return quality.keep_good(docs)


def near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies."""
    return ngram_join.one_of_each(docs, SHINGLE_WORDS, *SIMILARITY)


def repeated_passages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, without the passages that occur again."""
    return suffix.remove_repeats(docs, PASSAGE_BYTES)


def packed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The place of each document's pieces in sequences of 1,024 tokens."""
    return packing.pack_documents(docs.select("doc_id", "text"), tokenizer_path("byte_bpe_50k.json"))


STAGES = [
    ("language_id", language),
    ("quality_rules", quality_rules),
    ("ngram_jaccard_join", near_copies),
    ("suffix_array_dedup", repeated_passages),
    ("best_fit_packing", packed),
]

#: Its models and the tokenizer can't be written in SQL; the tests compare with brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = materialize(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
