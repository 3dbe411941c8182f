"""Texts of some megabytes, with and without white space, go whole through every operator that reads documents."""

import random
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from tests.llm.corpus import DOCUMENT, documents, prose, words
from tests.llm.test_operators import tokenizer
from trackloom.llm import collocations, common, hmm, langid, mixing, packing, quality, rules, simhash, suffix, tokens
from trackloom.llm.registry import vocabulary

SYLLABLES = ["the", "on", "er", "ing", "st", "an", "re"]


@pytest.fixture(scope="module")
def rows():
    rng = random.Random(9)
    page = prose(rng, SYLLABLES, 40_000)
    long, solid = " ".join([page, prose(rng, SYLLABLES, 300_000)]), "".join(prose(rng, SYLLABLES, 200_000).split())
    assert len(long) > 2_000_000 and len(solid) > 900_000 and " " not in solid
    return [*documents(40), (500, long, "aa", "s0", 0), (501, solid, "aa", "s1", 0), (502, page, "aa", "s2", 0)]


@pytest.fixture(scope="module")
def docs(spark, rows):
    return spark.createDataFrame(rows, DOCUMENT).repartition(4)


LONG = (500, 501, 502)


def by_id(df):
    return {r.doc_id: r for r in df.where(F.col("doc_id") >= 500).collect()}


def test_packing_and_token_counts(docs, rows):
    tk = tokenizer("byte_bpe_50k.json")
    packed = packing.pack(docs, vocabulary("byte_bpe_50k.json")).where("doc_id >= 500").toPandas()
    for doc_id, text, *_ in rows[-3:]:
        ids = [*tk.encode(text, add_special_tokens=False).ids, 0]
        own = packed[packed.doc_id == doc_id].sort_values("piece")
        assert own.length.sum() == len(ids) and (own.length.iloc[1:] == 2048).all()
        at = own.iloc[len(own) // 2]
        assert at.ids_crc32 == zlib.crc32(np.array(ids[at.start : at.start + at.length], "<u4").tobytes())
    counted = by_id(tokens.token_counts(docs, vocabulary("word_bpe_49k.json")))
    word = tokenizer("word_bpe_49k.json")
    for doc_id, text, *_ in rows[-3:]:
        assert (counted[doc_id].n_bytes, counted[doc_id].n_tokens) == (len(text.encode()), len(word.encode(text, add_special_tokens=False).ids))


def test_rules_and_mixing(docs, rows):
    found, mixed = by_id(rules.quality_rules(docs)), by_id(mixing.mix(docs))
    for doc_id, text, *_ in rows[-3:]:
        n = len(words(text))
        assert (found[doc_id].n_words, found[doc_id].word_chars, mixed[doc_id].size) == (n, sum(map(len, words(text))), n)
        assert mixed[doc_id].taken in (0, n, 2 * n, 3 * n)


def test_repeats_are_cut_from_both_texts(docs, rows):
    """The page stands whole inside the long text, so it goes from both."""
    done = by_id(suffix.remove_repeats(docs.select("doc_id", "text")))
    text = {r[0]: r[1].encode() for r in rows[-3:]}
    assert done[502].n_removed == len(text[502]) and bytes(done[502].kept) == b""
    assert bytes(done[500].kept) == text[500][done[500].n_removed :] and done[500].n_removed >= len(text[502])
    assert done[501].n_bytes == len(text[501]) and done[501].n_removed < 1000


def test_fingerprints_and_copies(docs, rows):
    found = by_id(simhash.near_duplicates(docs))
    for doc_id, text, *_ in rows[-3:]:
        assert found[doc_id].fingerprint == f"{simhash.fingerprint(text, 4, 42) & (2**64 - 1):016x}"
    parts = by_id(simhash.near_copies(docs.where("doc_id >= 500"), leaf=16))
    assert [parts[i].component_id for i in LONG] == list(LONG)


def test_models_read_whole_texts(spark, docs, rows):
    scored = by_id(hmm.score(docs, common.id_remainder(F.col("doc_id"), 10) == 0, start_rounds=2, most_rounds=2, tolerance=0.5))
    for doc_id, text, *_ in rows[-3:]:
        assert scored[doc_id].n_tokens == len(words(text)) + 1 and scored[doc_id].score < 0
    labels = spark.createDataFrame([(i, i % 2) for i in range(30)], "doc_id long, quality int")
    assert all(0 <= r.score <= 1 for r in by_id(quality.score_quality(docs, labels, F.lit(False))).values())
    languages = by_id(langid.predict_languages(docs, F.lit(False)))
    assert languages[500].lang_pred == languages[502].lang_pred == "aa"


def test_phrases_of_a_long_text(docs, rows):
    n = sum(len(words(r[1])) for r in rows if r[2] == "aa")
    found = collocations.collocations(docs.where("lang = 'aa'")).collect()
    assert found and abs(found[0].n - n) <= 200  # punctuation cuts some words of the small texts
