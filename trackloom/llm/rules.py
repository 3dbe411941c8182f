"""Quality rules in DataFrame functions alone: surface counts, then a hashed n-gram likelihood ratio.

Every text is measured inside its own row, so nothing but one count per n-gram bucket is shuffled. Two
multinomials over hashed n-grams are counted over all documents: the trusted target (documents that a
given condition trusts) and the raw corpus. A document's score is the mean over its n-grams of
log(p_target / p_raw); it is kept at or above a fixed threshold.
"""

from __future__ import annotations

import math
from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

SPACE = r"[\x20\x09-\x0D]+"
NOT_SYMBOLS = r"[^#*$%&|<>]+"
WINDOW = 5


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """body(value) with value computed once, also where body uses it inside other lambdas."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def words_of(text: Column) -> Column:
    return F.array_remove(F.split(F.coalesce(text, F.lit("")), SPACE), "")


def _adjacent(ordered: Column) -> Column:
    """Positions, in order, of the entries (hash, position) whose hash a neighbour shares; entries are sorted."""
    hash_at = lambda i: F.get(ordered, i)["h"]
    marked = F.transform(ordered, lambda x, i: F.when((hash_at(i - 1) == x["h"]) | (hash_at(i + 1) == x["h"]), x["i"]))
    return F.sort_array(F.filter(marked, lambda x: x.isNotNull()))


def repeated_words(hashes: Column) -> Column:
    """Number of words inside windows of five words that the text has twice or more; hashes: one per word.

    Windows are equal if all 64 bits of their hashes are.
    """
    n = F.size(hashes)
    windows = F.transform(F.sequence(F.lit(0), n - WINDOW), lambda i: F.xxhash64(*(F.get(hashes, i + k) for k in range(WINDOW))))

    def counted(w: Column) -> Column:
        found = let(F.sort_array(F.transform(w, lambda x, i: F.struct(x.alias("h"), i.alias("i")))), _adjacent)
        covered = let(found, lambda at: F.aggregate(F.transform(at, lambda x, i: F.least(F.coalesce(F.get(at, i + 1) - x, F.lit(WINDOW)), F.lit(WINDOW))), F.lit(0).cast("long"), lambda a, x: a + x))
        return F.when(F.size(F.array_distinct(w)) == F.size(w), F.lit(0).cast("long")).otherwise(covered)

    return F.when(n <= WINDOW, F.lit(0).cast("long")).otherwise(let(windows, counted))


def duplicate_lines(text: Column) -> Column:
    """Lines that have a word and equal an earlier line."""
    lines = F.filter(F.split(text, "\n"), lambda x: x.rlike(r"[^\x20\x09-\x0D]"))
    return let(lines, lambda x: (F.size(x) - F.size(F.array_distinct(x))).cast("long"))


def buckets_of(words: Column, ending: int, buckets: int) -> Column:
    """Buckets of the hashed n-grams of a text: each word's last characters (0: whole words), and each pair of neighbours."""
    unit = lambda w: F.xxhash64(w if not ending else F.substring(w, -ending, ending))
    bucket = lambda h: F.pmod(h, F.lit(buckets)).cast("int")
    return let(
        F.transform(words, unit),
        lambda h: F.concat(F.transform(h, bucket), F.transform(F.slice(h, 2, F.greatest(F.size(h) - 1, F.lit(0))), lambda x, i: bucket(F.xxhash64(F.get(h, i), x)))),
    )


def plain_prose(text: Column) -> Column:
    """The default trust: no symbols, no line twice, and fewer than a tenth of the characters capital."""
    t = F.coalesce(text, F.lit(""))
    lines = F.split(t, "\n")
    capitals = F.length(F.regexp_replace(t, r"\P{Lu}+", ""))
    return (F.length(F.regexp_replace(t, NOT_SYMBOLS, "")) == 0) & (F.size(lines) == F.size(F.array_distinct(lines))) & (capitals * 10 < F.length(t))


def ratio_weights(docs: DataFrame, trusted: Column, *, ending: int = 3, buckets: int = 1 << 14, smooth: float = 1.0) -> list[float]:
    """log(p_target / p_raw) of each bucket, counted over all documents; one count per bucket reaches the driver."""
    # The condition is computed before the rows multiply.
    hashed = docs.select(trusted.alias("trusted"), buckets_of(words_of(F.col("text")), ending, buckets).alias("buckets"))
    grams = hashed.select("trusted", F.explode("buckets").alias("bucket"))
    counts = grams.groupBy("bucket").agg(F.count("*").alias("raw"), F.count_if("trusted").alias("target")).collect()
    raw, target = sum(r["raw"] for r in counts), sum(r["target"] for r in counts)
    weights = [math.log((smooth / (target + smooth * buckets)) / (smooth / (raw + smooth * buckets)))] * buckets
    for r in counts:
        weights[r["bucket"]] = math.log((r["target"] + smooth) / (target + smooth * buckets)) - math.log((r["raw"] + smooth) / (raw + smooth * buckets))
    return [round(w, 6) for w in weights]


def quality_rules(docs: DataFrame, trusted: Column | None = None, *, threshold: float = -0.2, ending: int = 3, buckets: int = 1 << 14) -> DataFrame:
    """Counts and verdict for every row of docs (doc_id, text).

    Returns doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, kept, score.
    trusted: condition on docs' columns that marks the target documents (plain_prose by default).
    A null text has no words and fails the base; a null trusted counts as false; a text without n-grams
    scores 0; a score equal to the threshold is kept; a long text is measured whole, in memory of about 100 bytes a word;
    repeated rows each give a row; an empty table gives an empty table; other columns are
    ignored, whatever their names.
    """
    trusted = F.coalesce(plain_prose(F.col("text")) if trusted is None else trusted, F.lit(False))
    weights = ratio_weights(docs, trusted, ending=ending, buckets=buckets)
    table = F.split(F.lit(",".join(map(repr, weights))), ",").cast("array<double>")
    text = F.coalesce(F.col("text"), F.lit(""))
    split = docs.select("doc_id", text.alias("text"), words_of(F.col("text")).alias("words"))
    ratio = let(buckets_of(F.col("words"), ending, buckets), lambda g: F.when(F.size(g) == 0, 0.0).otherwise(F.aggregate(g, F.lit(0.0), lambda a, x: a + F.get(table, x)) / F.size(g)))
    measured = split.select(
        "doc_id",
        F.size("words").cast("long").alias("n_words"),
        F.length(F.array_join("words", "")).cast("long").alias("word_chars"),
        F.length(F.regexp_replace("text", NOT_SYMBOLS, "")).cast("long").alias("n_symbols"),
        duplicate_lines(F.col("text")).alias("n_dup_lines"),
        let(F.transform(F.col("words"), lambda w: F.xxhash64(w)), repeated_words).alias("n_repeat_words"),
        ratio.alias("score"),
    )
    failed = (F.col("n_words") < 10) | (100 * F.col("n_repeat_words") > 20 * F.col("n_words"))
    judged = measured.withColumn("base_failed", failed)
    return judged.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", (~F.col("base_failed") & (F.col("score") >= threshold)).alias("kept"), "score")
