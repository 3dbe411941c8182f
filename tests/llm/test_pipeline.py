import collections
import random

import pytest

import corpus_pipeline
from tests.llm.corpus import DOCUMENT, LOWER, components, documents, frame, prose, words
from tests.llm.test_operators import tokenizer

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]


def rows_of(df):
    return [tuple(r) for r in df.select(*COLUMNS).collect()]


@pytest.fixture(scope="module")
def folder(spark, tmp_path_factory):
    """A documents table with two languages, near copies, a shared passage and a text in neither language."""
    rng = random.Random(21)
    kinds = {"aa": ["the", "on", "er", "ing", "st", "an", "re"], "bb": ["que", "la", "no", "ji", "dos", "u"]}
    passage = prose(rng, kinds["aa"], 70)
    rows = []
    for i in range(150):
        lang = "aa" if i % 3 else "bb"
        text = prose(rng, kinds[lang], rng.randint(40, 160))
        if i % 10 == 1:
            text = f"{text[:200]} {passage} {text[200:]}"
        rows.append((i, text, lang, f"s{i % 3}", len(text)))
    rows += [(200, rows[7][1], "aa", "s0", 0), (201, rows[8][1] + " end", "aa", "s1", 0), (202, prose(rng, list("zxkjvqw"), 80), None, "s2", 0), (203, None, None, None, None)]
    path = tmp_path_factory.mktemp("corpus")
    spark.createDataFrame(rows, DOCUMENT).repartition(3).write.parquet(str(path / "documents.parquet"))
    return str(path), rows


def test_each_stage_against_a_plain_version(spark, folder):
    path, rows = folder
    docs = spark.read.parquet(f"{path}/documents.parquet")
    steps = dict(corpus_pipeline.STAGES)
    assert len(steps) == 5

    kept = steps["language identification"](spark, docs, path)
    assert kept.columns == COLUMNS
    first = rows_of(kept)
    assert {r[0] for r in rows} - {r[0] for r in first} == {202, 203}

    one = steps["near-duplicate removal"](spark, spark.createDataFrame(first, DOCUMENT), path)
    second = rows_of(one)
    sets = {r[0]: {tuple(w[i : i + 5]) for i in range(len(w) - 4)} for r in first for w in [words(r[1].lower())]}
    parts = components(list(sets), lambda a, b: len(sets[a] & sets[b]) >= 0.8 * len(sets[a] | sets[b]))
    assert sorted(second) == sorted(r for r in first if parts[r[0]] == r[0]) and not {200, 201} & {r[0] for r in second}

    third = rows_of(steps["repeated passage removal"](spark, spark.createDataFrame(second, DOCUMENT), path))
    raw = {r[0]: r[1].encode() for r in second}
    seen = collections.Counter(t[i : i + 200] for t in raw.values() for i in range(len(t) - 199))
    for doc_id, text, *_, n_chars in third:
        t = raw[doc_id]
        gone = {k for i in range(len(t) - 199) if seen[t[i : i + 200]] > 1 for k in range(i, i + 200)}
        assert text == bytes(b for k, b in enumerate(t) if k not in gone).decode("utf-8", "ignore") and n_chars == len(text)
    assert len(third) == len(second) and sum(len(r[1]) for r in third) < sum(len(r[1]) for r in second)

    fourth = rows_of(steps["source mixing"](spark, spark.createDataFrame(third, DOCUMENT), path))
    size = {r[0]: len(words(r[1])) for r in third}
    uses = collections.Counter(r[0] for r in fourth)
    assert set(fourth) <= set(third) and max(uses.values()) <= 3
    total = collections.Counter()
    for r in third:
        total[r[3]] += uses[r[0]] * size[r[0]]
    all_words = sum(size.values())
    sources = sorted(total)
    whole = {s: sum(size[r[0]] for r in third if r[3] == s) for s in sources}
    for s, weight in zip(sources, (1, 2, 3)):
        assert total[s] == pytest.approx(min(all_words * weight / 6, 3 * whole[s]), abs=max(size.values()))

    packed = steps["best-fit packing"](spark, spark.createDataFrame(fourth, DOCUMENT), path).toPandas()
    tk = tokenizer("byte_bpe_50k.json")
    assert packed.length.sum() == sum(len(tk.encode(r[1], add_special_tokens=False).ids) + 1 for r in fourth)
    assert packed.groupby("sequence_id").length.sum().max() <= 2048


def test_run_equals_the_stages_in_turn(spark, folder):
    path, _ = folder
    docs = spark.read.parquet(f"{path}/documents.parquet")
    for _, stage in corpus_pipeline.STAGES:
        docs = stage(spark, docs, path)
    key = lambda df: sorted(map(tuple, df.select("doc_id", "piece", "start", "length", "ids_crc32").collect()))
    assert key(corpus_pipeline.run(spark, path)) == key(docs)


def test_stages_on_hard_rows_and_nothing(spark):
    """Null and empty texts, texts without words or letters, repeated rows, null columns and clashing names, each with its stated result."""
    rows = documents(20)
    rows += [rows[0], rows[20]]  # repeated rows, one with a null text
    text = {r[0]: r[1] or "" for r in rows}
    steps = dict(corpus_pipeline.STAGES)
    run = lambda name: steps[name](spark, frame(spark, rows), "")

    kept = rows_of(run("language identification"))
    assert set(kept) <= set(rows) and not any(all(not c.isalpha() for c in r[1] or "") for r in kept)
    assert collections.Counter(kept)[rows[0]] in (0, 2) and len(kept) > len(rows) / 2

    sets = {i: {tuple(w[k : k + min(5, len(w))]) for k in range(len(w) - min(5, len(w)) + 1)} for i, t in text.items() for w in [words(t.translate(LOWER))]}
    sets = {i: s if words(text[i]) else set() for i, s in sets.items()}
    parts = components(list(sets), lambda a, b: len(sets[a] & sets[b]) >= 0.8 * len(sets[a] | sets[b]))
    assert collections.Counter(rows_of(run("near-duplicate removal"))) == collections.Counter(r for r in rows if parts[r[0]] == r[0])

    raw = [(r[0], (r[1] or "").encode()) for r in rows]
    seen = collections.Counter(t[i : i + 200] for _, t in raw for i in range(len(t) - 199))
    cut = {}
    for doc_id, t in raw:
        gone = {k for i in range(len(t) - 199) if seen[t[i : i + 200]] > 1 for k in range(i, i + 200)}
        cut[doc_id] = bytes(b for k, b in enumerate(t) if k not in gone).decode("utf-8", "ignore")
    third = rows_of(run("repeated passage removal"))
    assert len(third) == len(rows) and all(r[1] == cut[r[0]] and r[4] == len(r[1]) for r in third)

    mixed = collections.Counter(rows_of(run("source mixing")))
    times = collections.Counter(rows)
    assert set(mixed) <= set(rows) and all(words(r[1] or "") and n <= 3 * times[r] for r, n in mixed.items()) and mixed

    packed = run("best-fit packing").toPandas()
    assert packed.groupby("doc_id").piece.min().eq(0).all() and set(packed.doc_id) == set(text)
    assert (packed[packed.doc_id == 20].length == 1).all() and (packed.doc_id == 20).sum() == 2
    for name, stage in corpus_pipeline.STAGES:
        assert stage(spark, spark.createDataFrame([], DOCUMENT), "").count() == 0, name
