"""The queries of this subpackage: each applies one operator to its whole table."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from trackloom.llm import collocations, embeddings, hmm, langid, mixing, packing, prefix_trie, quality, rules, simhash, suffix, tokens, urls
from trackloom.llm.common import id_remainder, written
from trackloom.session import reach_workers


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return reach_workers(spark).read.parquet(f"{sf_dir}/{name}.parquet")


def vocabulary(name: str) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def packed(docs: DataFrame) -> DataFrame:
    """docs packed with the byte-level vocabulary into sequences of 2048."""
    import public_tokenizers

    return packing.pack(docs, vocabulary("byte_bpe_50k.json"), tiktoken_path=vocabulary("byte_bpe_50k.tiktoken"), pattern=public_tokenizers.PATTERN)


def op1_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packed(table(spark, sf_dir, "documents"))


def op2_naive_bayes_svm(spark: SparkSession, sf_dir: str) -> DataFrame:
    labels = table(spark, sf_dir, "labels").select("doc_id", "quality")
    return quality.score_quality(table(spark, sf_dir, "documents"), labels, id_remainder(F.col("doc_id"), 4) == 2)


def op3_embedding_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return embeddings.near_duplicates(table(spark, sf_dir, "embeddings"))


def op4_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rules.quality_rules(table(spark, sf_dir, "documents"))


def op5_suffix_array_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    done = suffix.remove_repeats(table(spark, sf_dir, "documents").select("doc_id", "text"))
    return done.select("doc_id", "n_bytes", "n_removed", "n_spans", F.sha2("kept", 256).alias("kept_sha256"))


def op6_hidden_markov_lm(spark: SparkSession, sf_dir: str) -> DataFrame:
    return hmm.score(table(spark, sf_dir, "documents"), id_remainder(F.col("doc_id"), 10) == 0)


def op7_simhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.near_duplicates(table(spark, sf_dir, "documents"))


def op8_mix_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mix(table(spark, sf_dir, "documents"))


def op9_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return langid.predict_languages(docs, id_remainder(F.col("doc_id"), 3) == 1)


def op10_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tokens.token_counts(table(spark, sf_dir, "documents"), vocabulary("word_bpe_49k.json"))


def op11_url_filters(spark: SparkSession, sf_dir: str) -> DataFrame:
    return urls.judge(table(spark, sf_dir, "pages"), urls.RULES)


def op12_conversation_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    lists = written(prefix_trie.turn_lists(table(spark, sf_dir, "conversations")), "turns")
    return prefix_trie.trie(prefix_trie.branched(lists)).select(*prefix_trie.RESULT)


def op13_phrase_collocations(spark: SparkSession, sf_dir: str) -> DataFrame:
    return collocations.collocations(table(spark, sf_dir, "documents"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {f.__name__: f for f in (op1_best_fit_packing, op2_naive_bayes_svm, op3_embedding_near_dedup, op4_quality_rules, op5_suffix_array_dedup, op6_hidden_markov_lm, op7_simhash_near_dedup, op8_mix_sources, op9_language_id, op10_token_counts, op11_url_filters, op12_conversation_trie, op13_phrase_collocations)}

ORACLES: dict[str, str] = {"op8_mix_sources": mixing.SQL, "op11_url_filters": urls.SQL, "op12_conversation_trie": prefix_trie.SQL, "op13_phrase_collocations": collocations.SQL}
