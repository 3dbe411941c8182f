import collections
import hashlib
import math
import random
import zlib

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from tests.llm.corpus import DOCUMENT, LOWER, components, documents, frame, prose, remainder, words
from trackloom.llm import common, embeddings, hmm, langid, mixing, packing, quality, registry, rules, simhash, suffix, tokens

ROWS = documents()


@pytest.fixture(scope="module")
def docs(spark):
    return frame(spark, ROWS)


@pytest.fixture(scope="module")
def empty(spark):
    return spark.createDataFrame([], DOCUMENT)


def tokenizer(name):
    from tokenizers import Tokenizer

    return Tokenizer.from_file(registry.vocabulary(name))


# 1 packing


def test_packing_holds_every_document_once(docs):
    found = registry.packed(docs).toPandas()
    tk = tokenizer("byte_bpe_50k.json")
    ids = {r[0]: tk.encode(r[1] or "", add_special_tokens=False).ids + [0] for r in ROWS}
    assert found.length.sum() == sum(map(len, ids.values()))
    for r in found.itertuples():
        part = ids[r.doc_id][r.start : r.start + r.length]
        assert zlib.crc32(np.array(part, "<u4").tobytes()) == r.ids_crc32
        assert len(ids[r.doc_id]) > 2048 or r.length == len(ids[r.doc_id])
    for _, g in found.sort_values("offset").groupby("sequence_id"):
        assert g.offset.tolist() == [0, *g.length.cumsum()[:-1]]
        assert g.length.sum() <= 2048
    total = sum(map(len, ids.values()))
    assert found.sequence_id.nunique() == -(-total // 2048)
    for _, g in found.groupby("doc_id"):
        g = g.sort_values("piece")
        assert g.piece.tolist() == list(range(len(g))) and (g.length[1:] == 2048).all()


def test_packing_merges_over_rounds(docs):
    few = packing.pack(docs, registry.vocabulary("byte_bpe_50k.json"), items_per_task=7).toPandas()
    assert few.groupby("sequence_id").length.sum().max() <= 2048
    assert len(few) == len(registry.packed(docs).toPandas())


def test_packing_repeated_null_and_empty(spark, empty):
    assert registry.packed(empty).count() == 0
    rows = [(None, None, None, None, None)] * 3 + [(1, "word", None, None, None)] * 2
    found = registry.packed(frame(spark, rows)).toPandas()
    assert len(found) == 5 and found.sequence_id.nunique() == 1 and sorted(found.length) == [1, 1, 1, 2, 2]


@settings(max_examples=150, deadline=None)
@given(st.text(alphabet=st.one_of(st.characters(max_codepoint=0x24F), st.sampled_from(" \n'’—…!?#é<|endoftext|>"), st.characters(exclude_categories=["Cs"]))))
def test_ids_equal_the_tokenizers_library(text):
    import public_tokenizers

    encode = packing.Ids(registry.vocabulary("byte_bpe_50k.json"), registry.vocabulary("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN)
    assert encode(text).tolist() == encode.tokenizer.encode(text, add_special_tokens=False).ids


def test_best_fit_is_tight():
    rng = random.Random(1)
    sizes = [rng.randint(1, 60) for _ in range(500)]
    bins = packing.best_fit(sizes, 100)
    assert sorted(i for b in bins for i in b) == list(range(500))
    assert len(bins) <= -(-sum(sizes) // 100) + 1


# 2 quality


def test_quality_learns_and_ignores_held_out_labels(spark):
    rng = random.Random(2)
    rows, labels = [], []
    for i in range(400):
        good = rng.random() < 0.8
        text = prose(rng, ["the", "on", "er"], 40)
        rows.append((i, text if good else " ".join(w + "$$$" for w in text.split()), None, None, None))
        flip = remainder(i, 4) == 2
        labels.append((i, int(good != flip)))
    rows += [(1000, None, None, None, None), (1001, "", None, None, None)]
    held = common.id_remainder(F.col("doc_id"), 4) == 2
    found = quality.score_quality(frame(spark, rows), spark.createDataFrame(labels, "doc_id long, quality int"), held).toPandas().set_index("doc_id")
    truth = {i: q != (remainder(i, 4) == 2) for i, q in labels}
    assert all(found.held_out[i] == (remainder(i, 4) == 2) for i in truth)
    assert sum(found.predicted[i] == truth[i] for i in truth) > 0.97 * len(truth)
    assert found.score.between(0, 1).all() and found.score[1000] == found.score[1001]
    assert (found.predicted == (found.score >= 0.7)).all()


def test_dual_descent_reaches_the_least_hinge_loss():
    """The primal and dual values meet, so no other weights are better."""
    rng = np.random.default_rng(4)
    x, y = rng.normal(size=(60, 8)), np.where(rng.random(60) < 0.6, 1.0, -1.0)
    x += 0.3 * y[:, None]
    cost = np.where(y > 0, 0.7, 1.3)
    rows = [np.arange(8)] * 60
    w = quality.dual_descent(rows, list(x), y, cost, 8, rounds=3000)
    primal = w @ w / 2 + (cost * np.maximum(0, 1 - y * (x @ w))).sum()
    a = np.linalg.lstsq((x * y[:, None]).T, w, rcond=None)[0]
    assert np.allclose((x * y[:, None]).T @ a, w)
    for step in rng.normal(size=(300, 8)) * 0.02:  # no direction lowers a convex function at its least
        v = w + step
        assert v @ v / 2 + (cost * np.maximum(0, 1 - y * (x @ v))).sum() >= primal - 1e-6


def plain_features(text):
    """Distinct (kind, n-gram) of a text: words, endings, pairs of endings, four-grams of distances to the word's last occurrence."""
    w = words(text)
    last, gaps = {}, []
    for i, x in enumerate(w):
        gaps.append(min(64, i - last[x]) if x in last else 0)
        last[x] = i
    ending = [x.encode()[-3:] for x in w]
    return {("w", x) for x in w} | {("e", x) for x in ending} | {("p", *p) for p in zip(ending, ending[1:])} | {("g", *gaps[i : i + 4]) for i in range(len(gaps) - 3)}


def test_features_are_the_n_grams_of_a_text():
    for _, text, *_ in ROWS[:50]:
        found, plain = quality.features(text), plain_features(text)
        assert len(found) <= len(plain) <= len(found) * 1.02 + 2 and (found < quality.BUCKETS).all()
        both = quality.features((text or "") + " " + (text or ""))
        assert set(quality.features(" ".join(words(text)))) == set(found) and len(both) >= len(found) * 0.5


def test_quality_without_labels_or_rows(spark, docs, empty):
    none = spark.createDataFrame([], "doc_id long, quality int")
    nulls = spark.createDataFrame([(1, None), (None, 1), (2, 0), (2, 1)], "doc_id long, quality int")
    assert quality.score_quality(docs, none, F.lit(False)).count() == len(ROWS)
    assert quality.score_quality(docs, nulls, F.lit(False)).select("score").distinct().count() == 1
    assert quality.score_quality(empty, none, F.lit(False)).count() == 0


# 3 embeddings


def vectors(n=300, width=16, seed=4):
    rng = np.random.default_rng(seed)
    rows = []
    for i in range(n):
        v = rng.normal(size=width)
        if i % 3 == 1:
            v = np.array(rows[-1][1]) + rng.normal(size=width) * 0.02
        if i % 10 == 2:
            v = np.array(rows[rng.integers(i)][1])
        rows.append((i, [float(x) for x in v.astype(np.float32)], i % 2 if i % 29 else None))
    bad = [None, [], [0.0] * width, [float("nan")] * width, [None] * width, [float("inf")] * width, [1.0, 2.0], [2.0, 4.0]]
    return rows + [(n + i, v, 1) for i, v in enumerate(bad)]


def brute_links(rows, least=0.93):
    use = {}
    for i, v, label in rows:
        if label is not None and v and all(x is not None and math.isfinite(x) for x in v) and any(v):
            use[i] = (label, np.array(v) / np.linalg.norm(v))
    close = lambda a, b: a != b and use[a][0] == use[b][0] and len(use[a][1]) == len(use[b][1]) and float(use[a][1] @ use[b][1]) >= least
    return {i: sum(close(i, j) for j in use) for i in use}, components(list(use), close)


@pytest.mark.parametrize("block", [512, 8])
def test_embeddings_against_brute_force(spark, block):
    rows = vectors()
    links, parts = brute_links(rows)
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>, label int").select("*", F.lit(1).alias("node"), F.lit(1).alias("n"))
    found = embeddings.near_duplicates(df, block=block).toPandas().set_index("vec_id")
    assert len(found) == len(rows)
    assert sum(found.n_links[i] for i, *_ in rows) >= 0.99 * sum(links.values())
    assert all(found.n_links[i] <= links.get(i, 0) for i, *_ in rows)
    assert sum(found.component_id[i] == parts.get(i, i) for i, *_ in rows) >= 0.99 * len(rows)
    assert (found.kept == (found.component_id == found.index)).all()


def test_embeddings_crowded_group_and_empty(spark):
    rng = np.random.default_rng(1)
    centre = rng.normal(size=16)
    rows = [(i, [float(x) for x in centre + rng.normal(size=16) * 0.001], 1) for i in range(150)] + [(None, [1.0] * 16, 1)]
    found = embeddings.near_duplicates(spark.createDataFrame(rows, "vec_id long, embedding array<float>, label int"), block=20).toPandas()
    some = found[found.vec_id.notna()]
    assert (some.n_links == 149).all() and (some.component_id == 0).all()
    assert embeddings.near_duplicates(spark.createDataFrame([], "vec_id long, embedding array<float>, label int")).count() == 0


# 4 rules


def base_counts(text):
    w = words(text)
    grams = collections.Counter(tuple(w[i : i + 5]) for i in range(len(w) - 4))
    inside = {k for i in range(len(w) - 4) if grams[tuple(w[i : i + 5])] > 1 for k in range(i, i + 5)}
    seen, twice = set(), 0
    for line in (text or "").split("\n"):
        if words(line):
            twice += line in seen
            seen.add(line)
    return len(w), sum(map(len, w)), sum(c in "#*$%&|<>" for c in text or ""), twice, len(inside)


def test_rules_against_brute_force(docs):
    found = rules.quality_rules(docs).toPandas().set_index("doc_id")
    assert len(found) == len(ROWS)
    for doc_id, text, *_ in ROWS:
        r = found.loc[doc_id]
        expected = base_counts(text)
        assert (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words) == expected
        assert r.base_failed == (expected[0] < 10 or 100 * expected[4] > 20 * expected[0])
        assert r.kept == (not r.base_failed and r.score >= -0.2)


@settings(max_examples=8, deadline=None)
@given(st.lists(st.text(alphabet="ab \n\t#", max_size=60), min_size=1, max_size=12))
def test_rules_on_small_alphabets(spark, texts):
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    found = {r.doc_id: r for r in rules.quality_rules(df).collect()}
    for i, t in enumerate(texts):
        r = found[i]
        assert (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words) == base_counts(t)


def test_rules_score_is_the_mean_ratio(spark):
    rows = [(i, prose(random.Random(i), ["the", "on"], 30) + (" $$$ ###" if i % 4 == 0 else ""), None, None, None) for i in range(40)]
    df = frame(spark, rows)
    weights = rules.ratio_weights(df, rules.plain_prose(F.col("text")), buckets=64)
    grams = df.select("doc_id", rules.buckets_of(rules.words_of(F.col("text")), 3, 64).alias("g")).collect()
    found = {r.doc_id: r.score for r in rules.quality_rules(df, buckets=64).collect()}
    for r in grams:
        assert found[r.doc_id] == pytest.approx(sum(weights[b] for b in r.g) / len(r.g), abs=1e-9)
        assert len(r.g) == 2 * len(words(rows[r.doc_id][1])) - 1


def test_rules_on_an_empty_table(empty):
    assert rules.quality_rules(empty).count() == 0


# 5 suffixes


def plain_cut(rows, least):
    texts = [(r[1] or "").encode() for r in rows]
    seen = collections.Counter(t[i : i + least] for t in texts for i in range(len(t) - least + 1))
    out = []
    for t in texts:
        gone = [False] * len(t)
        for i in range(len(t) - least + 1):
            if seen[t[i : i + least]] > 1:
                gone[i : i + least] = [True] * least
        spans = sum(g and not (k and gone[k - 1]) for k, g in enumerate(gone))
        out.append((len(t), sum(gone), spans, hashlib.sha256(bytes(b for b, g in zip(t, gone) if not g)).hexdigest()))
    return out


@pytest.mark.parametrize("most, segment", [(1 << 10, 1 << 20), (1, 1 << 20), (3, 500)])
def test_suffix_dedup_against_brute_force(spark, monkeypatch, most, segment):
    whole = suffix.repeated_spans
    monkeypatch.setattr(suffix, "repeated_spans", lambda d, least: whole(d, least, most=most, chunk=3000))
    monkeypatch.setattr(suffix, "SEGMENT", segment)
    rows = ROWS + [(ROWS[3][0], *ROWS[3][1:]), (None, ROWS[10][1], None, None, None), (None, prose(random.Random(9), ["ö", "xyz"], 90), None, None, None)]
    done = suffix.remove_repeats(frame(spark, rows)).select("doc_id", "text", "n_bytes", "n_removed", "n_spans", F.sha2("kept", 256).alias("sha")).collect()
    found = collections.Counter((r.doc_id, r.text, r.n_bytes, r.n_removed, r.n_spans, r.sha) for r in done)
    assert found == collections.Counter((r[0], r[1], *x) for r, x in zip(rows, plain_cut(rows, 200)))


def test_common_prefixes_stop_at_the_least_length():
    rng = np.random.default_rng(0)
    v = np.append(rng.integers(1, 3, 400), 0).astype(np.uint8)
    v[50:90] = v[200:240]
    order = suffix.suffix_order(v, 16)
    found = suffix.common_prefixes(v, order, 10)
    turned = [np.roll(v, -k) for k in order]
    for i in range(1, len(v)):
        same = int(np.argmax(turned[i] != turned[i - 1]))
        assert found[i] == (same // 2 * 2 if same < 10 else -1)  # by steps of two, which divide ten


def test_expansion_by_long_steps_finds_all_repeats():
    rng = random.Random(3)
    shared = bytes(rng.randrange(97, 100) for _ in range(500))
    pieces = [bytes(rng.randrange(97, 100) for _ in range(rng.randint(40, 90))) + shared[a : a + rng.randint(20, 200)] for a in rng.choices(range(300), k=40)] + [b"q" * 60, b"xyz" * 20]
    copies = [1] * 41 + [2]
    for least in (40, 24, 20, 15):
        seen = collections.Counter()
        for p, n in zip(pieces, copies):
            for i in range(len(p) - least + 1):
                seen[p[i : i + least]] += n
        flags = suffix.repeated_starts(pieces, copies, least)
        assert [f.tolist() for f in flags] == [[seen[p[i : i + least]] > 1 for i in range(len(p) - least + 1)] for p in pieces]


@pytest.mark.parametrize("most", [1 << 10, 8])
def test_suffix_dedup_of_equal_rows_and_a_common_passage(spark, most):
    """Thousands of equal rows, and a passage that many texts hold at other places: spans are found once."""
    rng = random.Random(1)
    kinds = ["the", "on", "er", "ing", "st"]
    passage, copy = prose(rng, kinds, 90), prose(rng, kinds, 80)
    rows = [(None, copy)] * 5000 + [(i, prose(rng, kinds, rng.randint(2, 60)) + " " + passage + " " + prose(rng, kinds, 30)) for i in range(300)]
    docs = spark.createDataFrame(rows, "id long, text string").withColumn("row", F.xxhash64("text")).fillna(-1, ["id"])
    spans = suffix.repeated_spans(docs.repartition(5), most=most).distinct().groupBy("id").agg(F.sum("number").alias("n"), F.count("*").alias("k"), F.countDistinct("first").alias("d")).collect()
    found = {r.id: r for r in spans}
    assert found[-1].n == len(copy) - 199 and len(found) == 301
    assert all(found[i].k == found[i].d and len(passage) - 199 <= found[i].n <= len(passage) - 199 + 40 for i in range(300))


def test_suffix_dedup_edges(spark, empty):
    assert suffix.remove_repeats(empty).count() == 0
    text = "é" * 150 + "x"
    r = suffix.remove_repeats(spark.createDataFrame([(1, text), (2, text[:-1] + "y"), (3, "é" * 99)], "doc_id long, text string"), as_text=True).collect()
    assert {x.doc_id: x.kept for x in r} == {1: "x", 2: "y", 3: "é" * 99}


# 6 language model


def model_tokens(text):
    return [w.encode() for w in words((text or "").translate(LOWER))] + [None]


def test_language_model_base_and_likelihood(docs):
    held = common.id_remainder(F.col("doc_id"), 10) == 0
    found = hmm.score(docs, held, own_words=40, known_words=60, start_rounds=3).toPandas().set_index("doc_id")
    counts = collections.Counter(t for r in ROWS if remainder(r[0], 10) for t in model_tokens(r[1]))
    n, v = sum(counts.values()), len(counts)
    for r in ROWS:
        x, t = found.loc[r[0]], model_tokens(r[1])
        assert (x.n_tokens, x.train_tokens, x.held_out) == (len(t), n, remainder(r[0], 10) == 0)
        assert x.n_known == sum(counts[w] > 0 for w in t)
        assert x.base_score == pytest.approx(sum(math.log10((counts[w] + 0.1) / (n + 0.1 * (v + 1))) for w in t), rel=1e-9)
    assert found.score.sum() > found.base_score.sum()


def random_model(rng, states, symbols):
    emit = rng.random((symbols, states))
    move = rng.random((states, states))
    start = rng.random(states)
    return hmm.Model(start / start.sum(), move / move.sum(1, keepdims=True), emit / emit.sum(0), [], 0)


def plain_forward(m, symbols):
    """log-likelihood and the state distributions after each symbol."""
    log, states = 0.0, []
    for t, x in enumerate(symbols):
        alpha = (states[-1] @ m.move if t else m.start) * m.emit[x]
        log += math.log(alpha.sum())
        states.append(alpha / alpha.sum())
    return log, states


def test_forward_recursion_and_counts_are_exact(monkeypatch):
    """Short sequences side by side, long ones by chunks, and slabs of few tokens, against a plain recursion."""
    monkeypatch.setattr(hmm, "LONG", 300)
    monkeypatch.setattr(hmm, "SLAB", 600)
    rng = np.random.default_rng(3)
    m = random_model(rng, 3, 7)
    sequences = [rng.integers(0, 7, n) for n in (1, 2, 255, 256, 257, 900, 5, 301, 40, 1300)]
    sums = hmm.Sums.zero(m)
    each = hmm.run(m, sequences, sums)
    want = hmm.Sums.zero(m)
    for s, got in zip(sequences, each):
        log, states = plain_forward(m, s)
        assert got == pytest.approx(log, rel=1e-10)
        beta = np.ones(3)
        for t in range(len(s) - 1, -1, -1):
            gamma = states[t] * beta / (states[t] * beta).sum()
            want.emitted[s[t]] += gamma
            ahead = m.emit[s[t]] * beta
            if t:
                pair = states[t - 1][:, None] * m.move * ahead[None]
                want.moved += pair / pair.sum()
            else:
                want.start += gamma
            beta = m.move @ ahead
            beta /= beta.sum()
    assert sums.total == pytest.approx(each.sum())
    np.testing.assert_allclose(hmm.run(m, sequences), each, rtol=1e-12)
    for name in ("start", "moved", "emitted"):
        np.testing.assert_allclose(getattr(sums, name), getattr(want, name), rtol=1e-8)


def test_score_is_the_likelihood_of_the_trained_model(spark, docs, monkeypatch):
    """The score column end to end: the forward recursion over words with emissions of their own, classes times shares for others."""
    kept, plain = [], hmm.settled
    monkeypatch.setattr(hmm, "settled", lambda *a: kept.append(plain(*a)) or kept[-1])
    held = common.id_remainder(F.col("doc_id"), 10) == 0
    found = hmm.score(docs, held, own_words=40, known_words=60, start_rounds=3).toPandas().set_index("doc_id")
    m = kept[0]
    counts = collections.Counter(t for r in ROWS if remainder(r[0], 10) for t in model_tokens(r[1])[:-1])
    own = {w: i for i, w in enumerate(m.known[: m.own])}
    assert len(own) >= 30
    assert min(counts[w] for w in own) >= max(n for w, n in counts.items() if w not in own)
    size, kinds = collections.Counter(), collections.Counter()
    for w, n in counts.items():
        if w not in own:
            size[hmm.word_class(w)] += n
            kinds[hmm.word_class(w)] += 1
    for r in ROWS:
        words_ = model_tokens(r[1])[:-1]
        log, _ = plain_forward(m, [own.get(w, m.own + hmm.word_class(w)) for w in words_] + [m.own + hmm.CLASSES])
        shares = sum(math.log10((counts[w] + 0.1) / (size[k] + 0.1 * (kinds[k] + 1))) for w in words_ if w not in own for k in [hmm.word_class(w)])
        assert found.loc[r[0]].score == pytest.approx(log / math.log(10) + shares, rel=1e-9)


def test_language_model_sums_to_one_over_short_texts(spark):
    """The first token of a text is one of the symbols, with probabilities that add to one."""
    rng = np.random.default_rng(5)
    m = random_model(rng, 4, 12)
    assert sum(math.exp(t) for t in hmm.run(m, [np.array([s]) for s in range(12)])) == pytest.approx(1)


def test_words_of_texts():
    import pyarrow as pa

    texts = ["a bc  def\tGhij \x0b\x0c\r\n", "", None, "z" * 50, " " * 40, "é" * 30 + " Ä B\x1cc\u00a0d", "\x85 \u3000 x"]
    found, size = hmm.split(pa.array(texts, pa.string()))
    plain = [[w.encode() for w in words((x or "").translate(LOWER))] for x in texts]
    assert found.to_pylist() == sum(plain, []) and size.tolist() == [len(p) for p in plain]


def test_words_of_slices_of_batches():
    """text_batches cuts a batch of many bytes into slices, with and without nulls before them."""
    import pyarrow as pa

    rng = random.Random(7)
    for nulls in (0.0, 0.2):
        texts = [None if rng.random() < nulls else "".join(rng.choice("abcDEF é\n") for _ in range(rng.choice([0, 1, 5, 30, 200]))) for _ in range(400)]
        batch = pa.RecordBatch.from_arrays([pa.array(texts, pa.string())], ["text"])
        cut = [x for b in common.text_batches(iter([batch]), max_bytes=1000) for x in hmm.split(b.column("text"))[0].to_pylist()]
        assert cut == [w.encode() for t in texts for w in words((t or "").translate(LOWER))]


def test_language_model_repeated_rows_and_empty(spark, empty):
    rows = [(1, "a b c", None, None, None)] * 2 + [(2, "x y zz", None, None, None)] * 3 + [(None, "q", None, None, None)]
    found = hmm.score(frame(spark, rows), F.lit(False), known_words=2, own_words=1).collect()
    assert len(found) == 6 and all(r.n_known == r.n_tokens for r in found) and len({(r.doc_id, r.base_score) for r in found}) == 3
    assert hmm.score(empty, F.lit(False)).count() == 0


# 7 SimHash


def plain_fingerprint(text):
    import xxhash

    w = words((text or "").translate(LOWER))
    shingles = [" ".join(w[i : i + 4]) for i in range(len(w) - 3)] or ([" ".join(w)] if w else [])
    h = [xxhash.xxh64_intdigest(s.encode(), 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def test_simhash_against_brute_force(docs):
    found = simhash.near_duplicates(docs).toPandas().set_index("doc_id")
    fp = {r[0]: plain_fingerprint(r[1]) for r in ROWS}
    parts = components(list(fp), lambda a, b: (fp[a] ^ fp[b]).bit_count() <= 4)
    assert {i: f"{v:016x}" for i, v in fp.items()} == found.fingerprint.to_dict()
    assert parts == found.component_id.to_dict()


def grouped(d):
    return sorted(sorted(k for k in d if d[k] == v) for v in set(d.values()))


@pytest.mark.parametrize("leaf", [8, 24, 2000])
def test_tree_links_join_exactly_what_is_close(spark, leaf):
    """Leaves of trees, crowded ones cut into blocks, and one leaf for all give the components of brute force."""
    rng = random.Random(6)
    codes = {rng.getrandbits(64) for _ in range(300)}
    for centre in list(codes)[:4]:
        for _ in range(80):
            codes.add(centre ^ sum(1 << b for b in rng.sample(range(64), rng.randint(1, 6))))
    signed = lambda x: x - (1 << 64) if x >> 63 else x
    rows = [(signed(c), [signed(c)]) for c in codes]
    nodes = spark.createDataFrame(rows, "node long, code array<long>")
    slices = simhash.grown(nodes, simhash.even_slices(3), leaf)
    links = simhash.tree_links(nodes, slices, 4, leaf=leaf)
    assert all(p.levels for p in slices) == (leaf < 100)
    found = {r.node: r.component for r in common.connected_components(links).collect()}
    plain = components([r[0] for r in rows], lambda a, b: ((a ^ b) & (2**64 - 1)).bit_count() <= 4)
    assert grouped({k: found.get(k, k) for k in plain}) == grouped(plain)


def test_leaves_bring_close_values_together():
    """Every pair within one bit on a slice meets in a leaf, and most others do not."""
    rng = np.random.default_rng(8)
    codes = rng.integers(-(2**63), 2**63, (1500, 1))
    codes[750:] = codes[:750] ^ (1 << rng.integers(0, 21, 750))[:, None]
    piece = simhash.even_slices(3)[0]
    simhash.grow(piece, codes, len(codes), 64)
    values = piece.values(codes)
    held = collections.defaultdict(set)
    for i, leaf in zip(*map(np.ndarray.tolist, piece.leaves(codes))):
        held[leaf].add(i)
    together = set()
    for s in held.values():
        together |= {(a, b) for a in s for b in s if a < b}
    assert len(piece.levels) >= 4 and len(together) < 1500 * 1499 / 8
    for a in range(1500):
        for b in np.flatnonzero(np.bitwise_count(values ^ values[a]) <= 1).tolist():
            assert a >= b or (a, b) in together


def test_near_copies_against_brute_force(spark):
    """Components at a shingle similarity of 0.8, from edits of every strength; a miss needs a pair close to 0.8."""
    rng = random.Random(12)
    syllables = ["the", "on", "er", "ing", "st", "an", "re", "lo", "mi"]
    rows = []
    for g in range(30):
        base = prose(rng, syllables, rng.randint(60, 300)).split()
        for k in range(4):
            w = list(base)
            for _ in range(max(k and 1, int(k * len(w) * 0.008))):
                w[rng.randrange(len(w))] = prose(rng, syllables, 1)
            rows.append((len(rows), " ".join(w), None, None, None))
    rows += [(900, rows[5][1], None, None, None), (901, rows[5][1].upper() + " ", None, None, None), (902, None, None, None, None), (903, " ", None, None, None), (904, "one two", None, None, None), (905, "One  two", None, None, None), (None, rows[5][1], None, None, None)]
    found = {r.doc_id: r.component_id for r in simhash.near_copies(frame(spark, rows), leaf=16).collect() if r.doc_id is not None}
    sets = {r[0]: {tuple(w[i : i + min(5, len(w))]) for i in range(max(0, len(w) - min(5, len(w)) + 1))} if w else set() for r in rows if r[0] is not None for w in [words((r[1] or "").translate(LOWER))]}
    jaccard = lambda a, b: len(sets[a] & sets[b]) / len(sets[a] | sets[b]) if sets[a] or sets[b] else 1.0
    plain = components(list(sets), lambda a, b: jaccard(a, b) >= 0.8)
    assert found[900] == found[901] == plain[900] and found[902] == found[903] == 902 and found[904] == found[905] == 904
    pairs = [(a, b) for a in sets for b in sets if a < b and jaccard(a, b) >= 0.8]
    caught = sum(found[a] == found[b] for a, b in pairs)
    assert len(pairs) > 60 and any(jaccard(a, b) < 0.87 for a, b in pairs) and caught >= 0.97 * len(pairs)
    assert all(plain[k] == plain[found[k]] for k in found)
    assert simhash.near_copies(frame(spark, []), leaf=16).count() == 0


@pytest.mark.parametrize("leaf", [16, 1024])
def test_near_copies_behind_a_failing_neighbour(spark, leaf):
    """A short prefix lies nearer to two near copies, by fingerprint, than they to each other: its links fail, theirs must not be lost."""
    rng = random.Random(31)
    fresh = lambda n: [f"{rng.getrandbits(40):x}" for _ in range(n)]
    rows, pairs, cut = [], [], []
    for g in range(160):
        size, wanted = rng.choice([60, 120, 250, 400]), rng.choice([0.805, 0.81, 0.82, 0.83, 0.86, 0.9, 0.95])
        shared = round(2 * wanted / (1 + wanted) * size)  # shingles in both, of `size` each
        a = fresh(size + 4)
        c = a[: shared + 4] + fresh(size - shared)
        b = a[: round(rng.uniform(0.7, 0.79) * size) + 4]
        own = [tuple({tuple(t[i : i + 5]) for i in range(len(t) - 4)}) for t in (a, b, c)]
        jaccard = lambda x, y: len(set(x) & set(y)) / len(set(x) | set(y))
        pairs.append((3 * g, 3 * g + 2, jaccard(own[0], own[2])))
        cut.append(max(jaccard(own[1], own[0]), jaccard(own[1], own[2])))
        rows += [(3 * g + k, " ".join(t), None, None, None) for k, t in enumerate((a, b, c))]
    assert min(p[2] for p in pairs) >= 0.8 and max(cut) < 0.8
    found = {r.doc_id: r.component_id for r in simhash.near_copies(frame(spark, rows), leaf=leaf).collect()}
    lost = [p for p in pairs if found[p[0]] != found[p[1]]]
    assert len(lost) <= 2, lost
    assert all(found[3 * g + 1] == 3 * g + 1 for g in range(160))


def test_simhash_null_repeated_and_empty(spark, empty):
    rows = [(5, None, None, None, None), (None, "", None, None, None), (3, " ", None, None, None), (9, "a b", None, None, None), (9, "a b", None, None, None)]
    found = simhash.near_duplicates(frame(spark, rows)).collect()
    assert sorted((str(r.doc_id), r.component_id) for r in found) == [("3", 3), ("5", 3), ("9", 9), ("9", 9), ("None", 3)]
    assert simhash.near_duplicates(empty).count() == 0


def test_connected_components_of_a_long_path_and_a_star(spark):
    edges = [(i, i + 1) for i in range(100, 160)] + [(1, k) for k in range(2, 60)] + [(7, 7), (None, 3), (200, None)]
    found = {r.node: r.component for r in common.connected_components(spark.createDataFrame(edges, "u long, v long")).collect()}
    assert found == {**{i: 100 for i in range(100, 161)}, **{k: 1 for k in range(1, 60)}}


# 8 mixing


def test_mix_meets_targets(docs):
    found = mixing.mix(docs).toPandas().set_index("doc_id")
    size = {r[0]: len(words(r[1])) for r in ROWS}
    source = {r[0]: r[3] for r in ROWS}
    names = sorted({s for s in source.values() if s is not None}) + [None]
    totals = [sum(size[i] for i in size if source[i] == s) for s in names]
    targets = mixing.water_fill(totals, [1 + k % 3 for k in range(len(names))], sum(size.values()), 3)
    assert sum(targets) == pytest.approx(sum(size.values()))
    for s, total, target in zip(names, totals, targets):
        ids = [i for i in size if source[i] == s]
        assert target <= 3 * total + 1e-9
        assert all(found.source_size[i] == total and found.target[i] == pytest.approx(target) for i in ids)
        assert abs(sum(found.taken[i] for i in ids) - target) <= max(5, 0.02 * target)
    assert all(found["size"][i] == size[i] and 0 <= found.taken[i] <= 3 * size[i] for i in size)
    again = mixing.mix(docs.repartition(5)).toPandas().set_index("doc_id")
    assert again.taken.to_dict() == found.taken.to_dict()


def test_mix_matches_its_sql(spark, docs, tmp_path):
    import duckdb

    docs.select("doc_id", "text", "source").write.parquet(str(tmp_path / "d"))
    con = duckdb.connect()
    con.execute(f"create view documents as select * from read_parquet('{tmp_path}/d/*.parquet')")
    plain = con.execute(mixing.SQL).fetchall()
    found = mixing.mix(docs).select("doc_id", "size", "source_size", "target", "taken").collect()
    assert sorted(map(tuple, found)) == sorted(plain)


def test_flow_over_overlapping_sources():
    # Pattern 0 serves both sources, pattern 1 only the second; the cheap way uses each once before repeating.
    assert mixing.min_cost_flow([100, 100], [[0, 1], [1]], [100, 100], 3) == [100, 100]
    assert mixing.min_cost_flow([100, 40], [[0, 1], [1]], [150, 50], 3) == [160, 40]
    assert mixing.min_cost_flow([10], [[0]], [100], 3) == [30]


def test_mix_of_overlapping_sources(spark):
    rows = [(i, "w " * 10, ["a", "b"] if i % 2 else ["b"]) for i in range(40)]
    found = mixing.mix(spark.createDataFrame(rows, "doc_id long, text string, source array<string>"), F.col("source")).toPandas()
    assert found.taken.sum() == 400 and (found.taken <= 30).all()


def test_mix_edges(spark, empty):
    assert mixing.mix(empty).count() == 0
    nothing = mixing.mix(frame(spark, [(1, None, None, None, None), (2, "", None, "a", None)])).collect()
    assert all(r.taken == 0 and r.size == 0 for r in nothing)


# 9 language


def test_languages_are_told_apart(spark):
    rng = random.Random(8)
    kinds = {"aa": ["the", "on", "er", "ing", "st"], "bb": ["que", "la", "no", "dos", "ir"], "cc": ["sch", "ein", "ung", "ver", "er"]}
    rows = [(i, prose(rng, kinds[k], rng.randint(3, 60)), k, None, None) for i in range(600) for k in [rng.choice(sorted(kinds))]]
    rows += [(900, None, "aa", None, None), (901, "12 …", "aa", None, None), (902, prose(rng, list("zxkjvq"), 50), None, None, None)]
    found = langid.predict_languages(frame(spark, rows), common.id_remainder(F.col("doc_id"), 3) == 1).toPandas().set_index("doc_id")
    held = [r for r in rows[:600] if remainder(r[0], 3) == 1]
    assert sum(found.lang_pred[r[0]] == r[2] for r in held) > 0.97 * len(held)
    assert sum(found.accepted[r[0]] for r in held) > 0.97 * len(held)
    assert found.lang_pred[900] == found.lang_pred[901] == "und" and not found.accepted[902]
    assert found.score.between(0, 1).all()


def test_probabilities_sum_to_one():
    rng = random.Random(1)
    text = prose(rng, ["ab", "ba", "c"], 200)
    rows = np.lib.stride_tricks.sliding_window_view(langid.pad(langid.symbols(text)), langid.ORDER)
    counts = collections.Counter("".join(map(chr, r)) for r in rows)
    m = langid.build([("x", g, n) for g, n in counts.items()])
    for before in ("ab", "abab", "ca", "bc a"):
        seq = langid.symbols(before)
        base = m.log2_probabilities(seq)[0]
        total = sum(2 ** (m.log2_probabilities(np.append(seq, np.uint32(ord(c))))[0] - base) for c in "abc ?")
        assert total == pytest.approx(1)  # "?" stands for all characters never seen


def plain_kneser_ney(counts, alphabet):
    """p(character | three before it) by the textbook recursion, with one discount an order."""
    tables = {4: counts}
    for n in (3, 2, 1):
        tables[n] = collections.Counter(g[1:] for g in tables[n + 1])

    def p(gram):
        n = len(gram)
        if not n:
            return 1 / (alphabet + 1)
        table = tables[n]
        ones, twos = (sum(v == k for v in table.values()) for k in (1, 2))
        d = ones / (ones + 2 * twos) if ones and twos else 0.5
        total = sum(v for g, v in table.items() if g[:-1] == gram[:-1])
        kinds = sum(g[:-1] == gram[:-1] for g in table)
        if not total:
            return p(gram[1:])
        return max(table[gram] - d, 0) / total + d * kinds / total * p(gram[1:])

    return p


def test_probabilities_equal_a_plain_kneser_ney():
    rng = random.Random(4)
    texts = {"x": prose(rng, ["ab", "ba", "c"], 60), "y": prose(rng, ["ad", "b", "ca"], 60)}
    grams = {k: collections.Counter("".join(map(chr, r)) for r in np.lib.stride_tricks.sliding_window_view(langid.pad(langid.symbols(t)), 4)) for k, t in texts.items()}
    m = langid.build([(k, g, n) for k, c in grams.items() for g, n in c.items()])
    alphabet = len({c for c in grams for g in grams[c] for c in g})
    for before in ("abcab", "dacad abc", "zab", "b", "a?c"):
        padded = "   " + before.replace("?", " ")
        for i, k in enumerate(m.languages):
            p = plain_kneser_ney(grams[k], alphabet)
            want = sum(math.log2(p(padded[j : j + 4])) for j in range(len(padded) - 3))
            assert m.log2_probabilities(langid.symbols(before))[i] == pytest.approx(want, rel=1e-9)


def test_calibration_rejects_few_of_the_own_texts():
    rng = random.Random(6)
    kinds = {"x": ["the", "on", "er", "ing"], "y": ["que", "la", "no", "dos"]}
    count = lambda k, n: collections.Counter("".join(map(chr, r)) for _ in range(n) for r in np.lib.stride_tricks.sliding_window_view(langid.pad(langid.symbols(prose(rng, kinds[k], rng.randint(2, 90)))), 4))
    m = langid.build([(k, g, n) for k in kinds for g, n in count(k, 200).items()])
    unseen = lambda n: [(k, m.log2_probabilities(x), len(x)) for k in kinds for _ in range(n) for x in [langid.symbols(prose(rng, kinds[k], rng.randint(2, 90)))]]
    langid.calibrate(m, unseen(100))
    late = unseen(500)
    assert sum(-t[m.languages.index(k)] / n > m.limits(n)[m.languages.index(k)] for k, t, n in late) <= 1000 / 37
    assert not langid.judge(m, prose(rng, list("zxkjvq"), 40))[3] and m.spread[1] > 0


def test_language_edges(spark, docs, empty):
    held = common.id_remainder(F.col("doc_id"), 3) == 1
    assert langid.predict_languages(docs, held).count() == len(ROWS)
    assert langid.predict_languages(empty, held).count() == 0
    unlabelled = frame(spark, [(1, "abc", None, None, None)])
    assert langid.predict_languages(unlabelled, held).first().lang_pred == "und"


# 10 tokens


def test_token_counts_equal_the_library(docs, empty):
    tk = tokenizer("word_bpe_49k.json")
    found = tokens.token_counts(docs, registry.vocabulary("word_bpe_49k.json")).toPandas().set_index("doc_id")
    for r in ROWS:
        n = len(tk.encode(r[1] or "", add_special_tokens=False).ids)
        assert (found.n_tokens[r[0]], found.n_bytes[r[0]], found.over_limit[r[0]]) == (n, len((r[1] or "").encode()), n > 2048)
    assert tokens.token_counts(empty, registry.vocabulary("word_bpe_49k.json")).count() == 0


@settings(max_examples=150, deadline=None)
@given(st.text(alphabet=st.one_of(st.characters(max_codepoint=0x24F), st.sampled_from(" \n'́̈ΣςİA"), st.characters(exclude_categories=["Cs"]))))
def test_counts_of_pieces_add_up(text):
    lengths = tokens.PieceLengths(registry.vocabulary("word_bpe_49k.json"))
    pieces = text.encode().split()
    lengths.learn(set(pieces))
    assert sum(lengths[p] for p in pieces) == len(lengths.tokenizer.encode(text, add_special_tokens=False).ids)


def test_other_tokenizers(docs):
    import sentencepiece

    sp = sentencepiece.SentencePieceProcessor(model_file=registry.vocabulary("piece_bpe_32k.model"))
    found = tokens.token_counts(docs, registry.vocabulary("piece_bpe_32k.model")).collect()
    assert {r.doc_id: r.n_tokens for r in found} == {r[0]: len(sp.encode(r[1] or "")) for r in ROWS}
    whole = tokens.token_counts(docs, registry.vocabulary("byte_bpe_50k.json"), splits_at_space=False).collect()
    tk = tokenizer("byte_bpe_50k.json")
    assert {r.doc_id: r.n_tokens for r in whole} == {r[0]: len(tk.encode(r[1] or "", add_special_tokens=False).ids) for r in ROWS}


def test_words_are_classed_by_their_ends(monkeypatch):
    """Classes and places of words come from Arrow: Python looks at each ending once, whatever the number of words."""
    import pyarrow as pa

    rng, calls, plain = random.Random(4), [], hmm.word_class
    texts = [" ".join(f"{rng.getrandbits(40):x}ab" for _ in range(500)) for _ in range(8)] + ["q é x ab b", None, ""]
    vocabulary = [w.encode() for w in sorted(set(words(texts[0])))] + [b"q", "é".encode()]
    want = {w: i for i, w in enumerate(vocabulary)}
    every = [w.encode() for t in texts for w in words(t or "")]
    for part in (slice(0, None), slice(4000, None)):
        assert hmm.word_classes(pa.array(every, pa.large_binary())[part]).tolist() == [plain(w) for w in every[part]]
    monkeypatch.setattr(hmm, "word_class", lambda w: calls.append(w) or plain(w))
    encoder = hmm.Encoder(vocabulary, 100)
    numbers, size, distinct, place = encoder.numbers(pa.array(texts, pa.string()))
    assert numbers.tolist() == [want.get(w, -1 - plain(w)) for w in every] and size.tolist() == [len(words(t or "")) for t in texts]
    assert [distinct[i].as_py() for i in place] == every
    assert encoder.symbols(numbers).tolist() == [i if (i := want.get(w, 1 << 20)) < 100 else 100 + plain(w) for w in every]
    assert len(calls) <= 2 * len({w[-2:] for w in every})
