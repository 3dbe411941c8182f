"""Corpus operators as steps from documents to documents (doc_id, text, lang, source, n_chars)."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from trackloom.llm import langid, mixing, simhash, suffix
from trackloom.llm.common import written

DOCUMENT = ["doc_id", "text", "lang", "source", "n_chars"]


def keep_identified(docs: DataFrame) -> DataFrame:
    """Documents whose language the models accept; they learn from the lang of docs itself. Without any lang nothing is known, and all go."""
    docs = docs.select(*DOCUMENT)
    return langid.identify(docs, langid.train(docs), keep_text=True).where("accepted").select(*DOCUMENT)


def keep_one_of_copies(docs: DataFrame, words: int = 5, least: float = 0.8) -> DataFrame:
    """One document of each group of near copies (word shingles at a Jaccard similarity of `least`), the one with the smallest doc_id.

    Rows without a doc_id stay; equal rows with that smallest doc_id all stay.
    """
    found = simhash.near_copies(docs, words=words, least=least).where("doc_id <> component_id")
    copies = written(found.select("doc_id", "row").distinct(), "copies")
    own = docs.select(*DOCUMENT).withColumn("row", F.xxhash64(F.coalesce("text", F.lit(""))))
    return own.join(copies, ["doc_id", "row"], "left_anti").select(*DOCUMENT)


def cut_repeats(docs: DataFrame, least: int = 200) -> DataFrame:
    """All documents without the bytes that repeat anywhere; a text may become empty. n_chars follows the text."""
    done = suffix.remove_repeats(docs.select(*DOCUMENT), least, as_text=True)
    return done.select("doc_id", F.col("kept").alias("text"), "lang", "source", F.length("kept").cast("long").alias("n_chars"))


def take_mix(docs: DataFrame) -> DataFrame:
    """Documents as often as the mix takes them: none, once, or repeated rows. Rows that share a doc_id are taken equally often."""
    mixed = mixing.mix(docs).where("taken > 0").select(F.col("doc_id").alias("mixed_id"), (F.col("taken") / F.col("size")).cast("int").alias("uses"))
    uses = mixed.groupBy("mixed_id").agg(F.max("uses").alias("uses"))
    own = docs.select(*DOCUMENT)
    joined = own.join(uses, own.doc_id.eqNullSafe(uses.mixed_id))
    return joined.withColumn("use", F.explode(F.sequence(F.lit(1), F.col("uses")))).select(*DOCUMENT)
