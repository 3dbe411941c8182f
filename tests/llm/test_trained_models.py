"""What the trained operators compute, recounted by hand: likelihood ratios, support vectors and rotations."""

import math
import struct

import numpy as np
import pytest
import xxhash
from pyspark.sql import functions as F

from tests.llm.corpus import components, frame, words
from trackloom.llm import embeddings, quality, rules


def signed(x):
    return x - (1 << 64) if x >> 63 else x


def plain_buckets(text, ending, buckets):
    """Buckets of a text's n-grams: hashed word endings, and pairs of neighbours hashed one after the other."""
    ends = [w[-ending:] for w in words(text)]
    one = [signed(xxhash.xxh64_intdigest(e.encode(), 42)) for e in ends]
    two = [signed(xxhash.xxh64_intdigest(struct.pack("<q", b), xxhash.xxh64_intdigest(struct.pack("<q", a), 42))) for a, b in zip(one, one[1:])]
    return [h % buckets for h in one + two]


def test_both_multinomials_and_the_verdict(spark):
    rows = [(i, text, None, None, None) for i, text in enumerate(["the cat sat on the mat and then it ran off again today", "buy $$$ now ### cheap cheap pills $$$ click here for more offers today", "the dog lay on the rug and slept all day long by the fire", "", None, "#### $$$$ %%%% again and again and so on and on and on it goes", "one two"] * 3)]
    size = 256
    found = {r.doc_id: r for r in rules.quality_rules(frame(spark, rows), buckets=size).collect()}
    raw, target = np.zeros(size), np.zeros(size)
    for _, text, *_ in rows:
        t = text or ""
        trusted = not any(c in "#*$%&|<>" for c in t) and sum(c.isupper() for c in t) * 10 < len(t)
        for b in plain_buckets(t, 3, size):
            raw[b] += 1
            target[b] += trusted
    weight = np.round(np.log((target + 1) / (target.sum() + size)) - np.log((raw + 1) / (raw.sum() + size)), 6)
    decided = set()
    for doc_id, text, *_ in rows:
        b = plain_buckets(text or "", 3, size)
        score = float(np.mean(weight[b])) if b else 0.0
        assert found[doc_id].score == pytest.approx(score, abs=1e-9)
        assert found[doc_id].kept == (not found[doc_id].base_failed and score >= -0.2)
        if not found[doc_id].base_failed:
            decided.add(found[doc_id].kept)
    assert decided == {True, False}


def test_windows_repeat_by_whole_hashes_in_a_long_text(spark):
    """A million different words and one window twice: ten words, and no more."""
    text = " ".join(f"w{i}" for i in range(600_000)) + " a b c d e x a b c d e " + " ".join(f"v{i}" for i in range(400_000))
    row = rules.quality_rules(spark.createDataFrame([(1, text)], "doc_id long, text string")).first()
    assert (row.n_words, row.n_repeat_words) == (1_000_011, 10)


def test_ratios_scaling_and_score_of_the_support_vectors():
    """Log-count ratios of the rows of the fit, unit vectors of them, and the logistic curve through margins."""
    rng = np.random.default_rng(7)
    good = rng.random(120) < 0.6
    rows = [np.unique(rng.choice(40, 12) + (20 if g else 0)).astype(np.int32) for g in good]
    model = quality.fit(rows, good)
    kept = np.arange(120) % 5 != 4
    counts = np.ones((2, quality.BUCKETS))
    for i in np.flatnonzero(kept):
        for f in rows[i]:
            counts[int(good[i]), f] += 1
    ratio = np.log(counts[1] / counts[1].sum()) - np.log(counts[0] / counts[0].sum())
    assert np.allclose(model.square, ratio**2)
    used = np.unique(np.concatenate([rows[i] for i in np.flatnonzero(kept)]))
    w = np.zeros_like(ratio)
    w[used] = model.weight[used] / ratio[used]
    for row in rows[:30]:
        x = ratio[row] / np.linalg.norm(ratio[row])
        margin = float(w[row] @ x) + model.bias
        assert model.score(row) == pytest.approx(1 / (1 + math.exp(-(model.slope * margin + model.offset))), abs=1e-6)
    held = np.array([model.score(rows[i]) > 0.5 for i in np.flatnonzero(~kept)])
    assert (held == good[~kept]).mean() > 0.8 and model.slope > 0


def test_features_on_the_driver_are_bounded_in_bytes(spark):
    rows = [(i, " ".join(f"{'g' if i % 2 else 'b'}{i * k % 50}" for k in range(60)), None, None, None) for i in range(200)]
    labels = spark.createDataFrame([(i, i % 2) for i in range(200)], "doc_id long, quality int")
    docs = frame(spark, rows)
    few, all_ = (quality.train(docs, labels, sample_bytes=b) for b in (20_000, 1 << 28))
    assert not np.array_equal(few.weight, all_.weight)
    none = quality.train(docs, labels, sample_bytes=0)
    assert none.weight.any() == False and none.score(np.array([1])) == pytest.approx(0.5)  # noqa: E712


def test_codes_are_balanced_and_find_planted_neighbours(spark):
    """Ten thousand vectors in one label: every bit splits them about in half, and at least 99 % of planted links are found."""
    rng = np.random.default_rng(3)
    width = 32
    base = rng.normal(size=(9000, width)) * np.linspace(0.5, 2.0, width)
    near = base[:1000] + rng.normal(size=(1000, width)) * 0.02 * np.linalg.norm(base[:1000], axis=1, keepdims=True) / 6
    x = np.vstack((base, near)).astype(np.float32)
    unit = x.astype(float) / np.linalg.norm(x.astype(float), axis=1, keepdims=True)
    quantiser = embeddings.fit_quantiser(list(unit[:4096]), len(x))
    bits = (unit @ quantiser.rotations[width] > 0).mean(0)
    assert ((bits > 0.35) & (bits < 0.65)).mean() > 0.95
    close = unit @ unit.T >= 0.93
    np.fill_diagonal(close, False)
    links = close.sum(1)
    assert links[:1000].min() >= 1
    df = spark.createDataFrame([(i, [float(v) for v in row], 1) for i, row in enumerate(x)], "vec_id long, embedding array<float>, label int")
    found = embeddings.near_duplicates(df).toPandas().set_index("vec_id")
    assert (found.n_links.sort_index().to_numpy() <= links).all()
    assert found.n_links.sum() >= 0.99 * links.sum()
    plain = components(list(range(200)), lambda a, b: close[a, b])
    assert all(found.component_id[i] <= plain[i] for i in plain)


def test_buckets_follow_the_crowd_at_any_size():
    """No number of bits is the most: a label of a thousand million vectors gets longer substrings and more tables."""
    sample = list(np.random.default_rng(1).normal(size=(300, 16)))
    made = [embeddings.fit_quantiser(sample, n) for n in (1_000, 1_000_000, 1_000_000_000)]
    assert [q.bits for q in made] == [5, 15, 25]
    assert all(q.tables * (1 - math.acos(0.93) / math.pi) ** q.bits >= 4 for q in made)


@pytest.mark.parametrize("column", ["n_words", "score", "words", "text_", "kept"])
def test_clashing_names_change_nothing(spark, column):
    rows = [(1, "the cat sat on the mat and then it ran off again today", None, None, None)]
    plain = rules.quality_rules(frame(spark, rows, False)).collect()
    assert rules.quality_rules(frame(spark, rows, False).withColumn(column, F.lit("x"))).collect() == plain
