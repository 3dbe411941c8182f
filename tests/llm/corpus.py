"""Small documents with the hard cases in them, and plain versions of what the operators compute."""

import random
import re
import zlib

WORD = re.compile(r"[^\x20\x09-\x0D]+")
DOCUMENT = "doc_id long, text string, lang string, source string, n_chars long"
LOWER = {c: c + 32 for c in range(65, 91)}


def words(text):
    return WORD.findall(text or "")


def remainder(doc_id, modulus):
    return zlib.crc32(str(doc_id).encode()) % modulus


def prose(rng, syllables, n):
    return " ".join("".join(rng.choice(syllables) for _ in range(rng.randint(1, 4))) for _ in range(n))


def documents(n=60, seed=3):
    """(doc_id, text, lang, source, n_chars): prose in two made-up languages, copies, repeats and odd rows."""
    rng = random.Random(seed)
    kinds = {"aa": ["the", "on", "er", "ing", "st", "an", "re"], "bb": ["qué", "lä", "ño", "ji", "dos", "ü"]}
    rows = []
    shared = prose(rng, kinds["aa"], 60)
    for i in range(n):
        lang = "aa" if i % 3 else "bb"
        text = prose(rng, kinds[lang], rng.randint(5, 150)).capitalize() + "."
        if i % 7 == 3:
            text = text[: len(text) // 2] + " " + shared + " " + text[len(text) // 2 :]
        if i % 11 == 5 and rows:
            text = rows[rng.randrange(len(rows))][1]
        if i % 13 == 6 and rows:
            text = (rows[-1][1] or "") + " End."
        if i % 17 == 4:
            text = "\n".join([text[:40]] * 6)
        if i % 19 == 7:
            text = " ".join(w + "###" for w in text.split())
        rows.append((i, text, lang, f"s{i % 4}" if i % 5 else None, len(text)))
    rows += [(n, None, None, None, None), (n + 1, "", "aa", "", 0), (n + 2, " \n\t\x0b ", None, "s1", 5), (n + 3, "one", "aa", "s1", 3)]
    rows += [(n + 4, "12 34 !? …", "aa", "s2", 10), (n + 5, prose(rng, kinds["aa"], 4000), "aa", "s0", 0), (n + 6, "a" * 700, "aa", "é", 700)]
    rows += [(n + 7, "\x00 b\x1cc d e f <|endoftext|> <|startoftext|> İ ǅ ́x", "bb", "s3", 1)]
    return rows


def frame(spark, rows, clash=True):
    """The rows as a DataFrame, with further columns whose names clash with those of results."""
    from pyspark.sql import functions as F

    df = spark.createDataFrame(rows, DOCUMENT).repartition(3)
    names = ["score", "size", "key", "id", "row", "spans", "kept", "fp", "label", "piece", "word", "c0", "words", "target"]
    return df.select("*", *(F.lit(7).alias(c) for c in names)) if clash else df


def components(items, linked):
    """{item: smallest item reachable} for a symmetric predicate."""
    label = {i: i for i in items}
    changed = True
    while changed:
        changed = False
        for a in items:
            for b in items:
                if label[a] != label[b] and linked(a, b):
                    label[a] = label[b] = min(label[a], label[b])
                    changed = True
    return label
