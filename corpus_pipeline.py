"""From raw documents to packed training sequences, in five stages.

Each stage takes (spark, docs, sf_dir) and works on all that its predecessor kept; run() applies them to the
documents of a folder, with a written table between stages.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from trackloom.llm import registry, stages
from trackloom.llm.common import forget, written
from trackloom.session import reach_workers


def identify_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps documents whose language the models accept. Null texts, and texts without a letter, go; repeated rows stay or go together; without any lang all go."""
    reach_workers(spark)
    return stages.keep_identified(docs)


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps one document of each group of near copies (five-word shingles, Jaccard similarity 0.8 or more), the one with the smallest doc_id; texts without words are one group; rows without a doc_id stay."""
    reach_workers(spark)
    return stages.keep_one_of_copies(docs)


def cut_repeated_passages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps all documents, without the bytes of 200-byte strings that occur elsewhere too; a null text becomes empty, and n_chars follows the text."""
    reach_workers(spark)
    return stages.cut_repeats(docs)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Takes documents as often as the mix of sources asks, up to three times, as repeated rows; texts without words go."""
    return stages.take_mix(docs)


def pack_sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Packs all that is left into sequences of 2048 tokens; one row per piece of a document, null texts as empty."""
    reach_workers(spark)
    return registry.packed(docs)


STAGES = [
    ("language identification", identify_language),
    ("near-duplicate removal", drop_near_copies),
    ("repeated passage removal", cut_repeated_passages),
    ("source mixing", mix_sources),
    ("best-fit packing", pack_sequences),
]

#: SQL cannot express trained models, fingerprints or packing; tests hold run() against a plain version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The rows of the last stage. An empty table gives none; columns beside those of documents are left out by the first stage."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for k, (_, stage) in enumerate(STAGES):
        before, docs = docs, stage(spark, docs, sf_dir)
        if k < len(STAGES) - 1:
            docs = written(docs, f"stage{k + 1}")
        if 0 < k < len(STAGES) - 1:
            forget(before)
    return docs
