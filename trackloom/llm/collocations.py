"""Phrase collocations by pivot partitioning (MG-FSM): each n-gram is counted where its rarest word is sent.

A first pass counts words. A second pass takes every word as a pivot and sends the fragment of text around it
that its n-grams can lie in: up to three words to either side, cut at the ends of a piece and at the first
word that is rarer than the pivot, because an n-gram with such a word belongs to that one. Words too
rare for any frequent phrase cut all fragments. An n-gram's pivot is the leftmost of its rarest words, so
each occurrence lies in exactly one fragment, and the task that holds a pivot's fragments has its n-grams'
whole counts: it emits only frequent ones. Equal fragments of a batch travel once, with a count. A pivot with
so many occurrences that its fragments would fill a task sends the n-grams themselves, each to the
shard that its hash names, where they are counted whole as well.

How rare a word is comes from a count-min sketch of the word counts, whose size is fixed: any order that all
tasks share gives right counts, and an estimate never lies below the count, so nothing frequent is cut.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from trackloom.llm.common import text_batches, whole_groups, written

#: Lower-cases A-Z; ends of pieces become line feeds and tabs spaces.
PLAIN = bytes(c + 32 if 65 <= c <= 90 else 10 if c in b".,;:!?\n\x0b\x0c\r" else 32 if c == 9 else c for c in range(256))

#: Counters of a sketch that travel to the driver as one row.
BLOCK = 4096


def split_words(texts: list[bytes]) -> tuple[pa.DictionaryArray, np.ndarray]:
    """All words of the texts in their order, and for each the number of its piece; texts end pieces."""
    plain = np.frombuffer(b"\n".join(texts).translate(PLAIN), np.uint8)
    line = plain == 10
    inside = ~(line | (plain == 32))
    starts = np.flatnonzero(inside & ~np.concatenate(([False], inside[:-1])))
    ends = np.flatnonzero(inside & ~np.concatenate((inside[1:], [False]))) + 1
    offsets = np.concatenate(([0], np.cumsum(ends - starts)))
    words = pa.LargeStringArray.from_buffers(len(starts), pa.py_buffer(offsets.astype(np.int64)), pa.py_buffer(plain[inside]))
    return words.dictionary_encode(), np.cumsum(line)[starts] if len(starts) else np.zeros(0, np.int64)


def by_language(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[str, list[bytes]]]:
    """(lang, texts) of each batch of rows (lang, text: binary)."""
    for batch in text_batches(batches):
        langs = batch.column("lang").dictionary_encode()
        codes = langs.indices.to_numpy()
        texts = batch.column("text")
        for code, lang in enumerate(langs.dictionary.to_pylist()):
            yield lang, texts.take(pa.array(np.flatnonzero(codes == code))).to_pylist()


def plain_documents(docs: DataFrame) -> DataFrame:
    return docs.select(F.coalesce("lang", F.lit("und")).alias("lang"), F.coalesce("text", F.lit("")).cast("binary").alias("text"))


def word_counts(docs: DataFrame) -> DataFrame:
    """lang, word, n (long) of every word of docs (text, lang); null lang counts as `und`."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for lang, texts in by_language(batches):
            words, _ = split_words(texts)
            n = np.bincount(words.indices.to_numpy(), minlength=len(words.dictionary)).astype(np.int64)
            yield pa.RecordBatch.from_arrays([pa.array([lang] * len(n), pa.string()), words.dictionary.cast(pa.string()), pa.array(n)], ["lang", "word", "n"])

    return plain_documents(docs).mapInArrow(count, "lang string, word string, n long").groupBy("lang", "word").agg(F.sum("n").alias("n"))


def hashes(lang: str, words: pa.Array) -> np.ndarray:
    import xxhash

    seed = xxhash.xxh64_intdigest(lang.encode())
    return np.fromiter((xxhash.xxh64_intdigest(w.encode(), seed) for w in words.to_pylist()), np.uint64, len(words))


def cells(found: np.ndarray, width: int) -> tuple[np.ndarray, np.ndarray]:
    """Places of hashes in the two rows of a sketch; width is a power of two."""
    mask = np.uint64(width - 1)
    return (found & mask).astype(np.int64), ((found >> np.uint64(32)) & mask).astype(np.int64) + width


def sketch(words: DataFrame, width: int) -> np.ndarray:
    """Count-min sketch (two rows of width counters) of words (lang, word, n); what reaches the driver is bounded by its size."""

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = np.zeros(2 * width, np.int64)
        for batch in batches:
            langs = batch.column("lang").dictionary_encode()
            codes, n = langs.indices.to_numpy(), batch.column("n").to_numpy()
            for code, lang in enumerate(langs.dictionary.to_pylist()):
                at = np.flatnonzero(codes == code)
                for place in cells(hashes(lang, batch.column("word").take(pa.array(at))), width):
                    np.add.at(held, place, n[at])
        some = np.flatnonzero(held)
        yield pa.RecordBatch.from_arrays([pa.array(some.astype(np.int32)), pa.array(held[some])], ["cell", "n"])

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for table in whole_groups(batches, ["block"], 1 << 16):
            blocks, cell, n = (table.column(c).to_numpy() for c in ("block", "cell", "n"))
            for block in np.unique(blocks):
                held = np.zeros(BLOCK, np.int64)
                held[cell[blocks == block] % BLOCK] = n[blocks == block]
                yield pa.RecordBatch.from_arrays([pa.array([block], pa.int32()), pa.array([held.tobytes()])], ["block", "counts"])

    found = words.mapInArrow(add, "cell int, n long").groupBy("cell").agg(F.sum("n").alias("n")).withColumn("block", F.expr(f"cast(cell div {BLOCK} as int)"))
    out = np.zeros(2 * width, np.int64)
    for row in found.repartition("block").sortWithinPartitions("block").mapInArrow(pack, "block int, counts binary").collect():
        out[row["block"] * BLOCK :][:BLOCK] = np.frombuffer(row["counts"], np.int64)
    return out


def mixed(rows: np.ndarray) -> np.ndarray:
    """A hash of each row of whole numbers."""
    out = np.zeros(len(rows), np.uint64)
    for k in range(rows.shape[1]):
        out = (out ^ rows[:, k].astype(np.uint64)) * np.uint64(0x9E3779B97F4A7C15)
        out ^= out >> np.uint64(29)
    return out


def same_rows(rows: np.ndarray, n: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(position of one of each kind, sum of n) of equal rows of small integers.

    Rows are sorted by a hash; where two different rows share one (next to never), a kind may appear more than once.
    """
    if not len(rows):
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    order = np.argsort(mixed(rows))
    first = np.flatnonzero(np.concatenate(([True], (rows[order[1:]] != rows[order[:-1]]).any(1))))
    return order[first], np.add.reduceat(n[order], first)


def joined(words: pa.Array, ids: np.ndarray, lengths: np.ndarray) -> pa.Array:
    """Words by ids, so many a row, joined by spaces."""
    offsets = pa.array(np.concatenate(([0], np.cumsum(lengths))).astype(np.int32))
    return pc.binary_join(pa.ListArray.from_arrays(offsets, words.cast(pa.string()).take(pa.array(ids))), " ")


def around(words: pa.DictionaryArray, piece: np.ndarray, rare: np.ndarray, least: int, reach: int) -> tuple[np.ndarray, np.ndarray]:
    """Fragments as rows of 2 * reach + 1 word ids, the pivot's in the middle and -1 where there is none, and their counts.

    rare holds a word's estimated count by id.
    """
    ids = words.indices.to_numpy().astype(np.int32)
    n = rare[ids]
    at = np.flatnonzero(n >= least)
    rows = np.full((len(at), 2 * reach + 1), -1, np.int32)
    rows[:, reach] = ids[at]
    own, lines = n[at], piece[at]
    for sign in (-1, 1):
        ok = np.ones(len(at), bool)
        for k in range(1, reach + 1):
            there = at + sign * k
            ok &= (there >= 0) & (there < len(ids))
            there = np.where(ok, there, 0)
            ok &= piece[there] == lines
            ok &= (n[there] > own) if sign < 0 else (n[there] >= own)
            rows[ok, reach + sign * k] = ids[there[ok]]
    rows = rows[(rows[:, reach - 1] >= 0) | (rows[:, reach + 1] >= 0)]
    kinds, count = same_rows(rows, np.ones(len(rows), np.int64))
    return rows[kinds], count


def fragments(docs: DataFrame, counts: np.ndarray, *, least: int, longest: int, heavy: int) -> DataFrame:
    """lang, shard, at, text, n: fragments by their pivot's shard, with the pivot's place `at` in the text and how often
    the fragment was met; whole n-grams of heavy pivots have at = -1."""
    held = docs.sparkSession.sparkContext.broadcast(counts)
    reach, fields = longest - 1, "lang string, shard int, at int, text string, n long"
    names = ["lang", "shard", "at", "text", "n"]

    def batch_of(lang: str, words: pa.Array, rows: np.ndarray, shard: np.ndarray, at: np.ndarray, n: np.ndarray) -> pa.RecordBatch:
        some = rows >= 0
        texts = joined(words, rows[some], some.sum(1)).cast(pa.string())
        return pa.RecordBatch.from_arrays([pa.array([lang] * len(rows), pa.string()), pa.array(shard.astype(np.int32)), pa.array(at.astype(np.int32)), texts, pa.array(n.astype(np.int64))], names)

    def spread(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sketched = held.value
        width = len(sketched) // 2
        for lang, texts in by_language(batches):
            words, piece = split_words(texts)
            known = hashes(lang, words.dictionary)
            a, b = cells(known, width)
            rare = np.minimum(sketched[a], sketched[b])
            rows, n = around(words, piece, rare, least, reach)
            full = rare[rows[:, reach]] > heavy
            light = rows[~full]
            yield batch_of(lang, words.dictionary, light, known[light[:, reach]] >> np.uint64(33), (light[:, :reach] >= 0).sum(1), n[~full])
            for k in range(2, longest + 1):
                for j in range(k):
                    part, count = rows[full, reach - j : reach - j + k], n[full]
                    whole = (part >= 0).all(1)
                    kinds, count = same_rows(part[whole], count[whole])
                    part = part[whole][kinds]
                    yield batch_of(lang, words.dictionary, part, mixed(known[part]) >> np.uint64(33), np.full(len(part), -1), count)

    return plain_documents(docs).mapInArrow(spread, fields)

def windows(at: np.ndarray, lengths: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """(row, first word) of the k-grams that hold a row's pivot; of a row with at = -1, the row itself."""
    rows, first = [np.flatnonzero((at < 0) & (lengths == k))], [np.zeros(0, np.int64)]
    first[0] = np.zeros(len(rows[0]), np.int64)
    for j in range(k):
        some = np.flatnonzero((at >= j) & (at - j + k <= lengths))
        rows.append(some)
        first.append(at[some] - j)
    return np.concatenate(rows), np.concatenate(first)


def mined(texts: pa.Array, at: np.ndarray, n: np.ndarray, least: int, longest: int) -> Iterator[tuple[int, pa.Array, np.ndarray]]:
    """(k, phrases, counts) of the k-grams that pivots own at least `least` times, from the whole fragments of these pivots."""
    split = pc.split_pattern(texts, " ")
    starts, lengths = split.offsets.to_numpy()[:-1], np.diff(split.offsets.to_numpy())
    words = split.flatten().dictionary_encode()
    ids = words.indices.to_numpy().astype(np.int64)
    bits = max(1, len(words.dictionary).bit_length())
    for k in range(2, longest + 1):
        row, first = windows(at, lengths, k)
        if not len(row):
            continue
        begin = starts[row] + first
        key, used = ids[begin], bits
        for j in range(1, k):
            if used + bits > 63:  # number what has been joined so far
                _, key = np.unique(key, return_inverse=True)
                used = int(key.max()).bit_length()
            key, used = (key << bits) | ids[begin + j], used + bits
        order = np.argsort(key, kind="stable")
        edges = np.flatnonzero(np.concatenate(([True], key[order][1:] != key[order][:-1])))
        total = np.add.reduceat(n[row][order], edges)
        often = total >= least
        found = begin[order[edges[often]]]
        if len(found):
            flat = ids[(found[:, None] + np.arange(k)).ravel()]
            yield k, joined(words.dictionary, flat, np.full(len(found), k)), total[often]


def frequent_phrases(docs: DataFrame, counts: np.ndarray, *, least: int, longest: int, heavy: int) -> DataFrame:
    """lang, phrase, k, a: all phrases of 2 to `longest` words that occur at least `least` times, each from the one task that owns it."""

    def mine(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for table in whole_groups(batches, ["lang", "shard"], 1 << 18):
            langs = table.column("lang").combine_chunks().dictionary_encode()
            codes = langs.indices.to_numpy()
            for code, lang in enumerate(langs.dictionary.to_pylist()):
                part = table.filter(pa.array(codes == code)).combine_chunks()
                for k, phrases, total in mined(part.column("text").combine_chunks(), part.column("at").to_numpy(), part.column("n").to_numpy(), least, longest):
                    m = len(total)
                    yield pa.RecordBatch.from_arrays([pa.array([lang] * m, pa.string()), phrases.cast(pa.string()), pa.array(np.full(m, k, np.int32)), pa.array(total)], ["lang", "phrase", "k", "a"])

    parts = fragments(docs, counts, least=least, longest=longest, heavy=heavy)
    return parts.repartition("lang", "shard").sortWithinPartitions("lang", "shard").mapInArrow(mine, "lang string, phrase string, k int, a long")


def with_count(df: DataFrame, counts: DataFrame, total: int, part: str, name: str) -> DataFrame:
    """df with the count of the phrase in column `part` as `name`.

    Phrases with more than a 4,096th of all words are met by broadcast, the others by a shuffle: the counts of one length
    sum to `total` at most, so there are fewer than 4,096 of them a length.
    """
    often = F.col("f") * 4096 > F.lit(total)
    big = F.broadcast(counts.where(often).select(F.col("lang").alias("big_lang"), F.col("part").alias("big_part"), F.col("f").alias("big_f")))
    rest = counts.where(~often).select("lang", F.col("part").alias("key"), F.col("f").alias("rest_f"))
    met = df.join(big, (df.lang == big.big_lang) & (df[part] == big.big_part), "left")
    # A key with a leading space equals no phrase: those rows have their count, and are dealt out evenly.
    key = F.when(F.col("big_f").isNull(), F.col(part)).otherwise(F.concat(F.lit(" "), F.pmod(F.xxhash64("phrase", "cut"), F.lit(4096)).cast("string")))
    out = met.withColumn("key", key).join(rest, ["lang", "key"], "left")
    return out.withColumn(name, F.coalesce("big_f", "rest_f")).drop("key", "big_lang", "big_part", "big_f", "rest_f")


def joined_words(words: str, start: Column | int, length: Column | int) -> Column:
    return F.array_join(F.slice(F.col(words), start, length), " ")


def collocations(docs: DataFrame, *, least: int = 30, longest: int = 4, inside: int = 80, top: int = 2000, width: int = 1 << 20, heavy: int = 1 << 20) -> DataFrame:
    """The `top` collocations of each lang: lang, rank, phrase, a, l, r, n, score.

    docs has text and lang; further columns are ignored. A null lang is `und`, a null or empty text has no words,
    repeated rows count as often as they occur, and an empty table, or a lang without a candidate, gives no rows. Texts are
    taken whole; of a long one, memory follows its words (about 100 bytes each). Candidates are phrases of 2 to `longest` words with a >= `least`. The lowest
    score floor(2000000 * a / (l + r)) over a candidate's cuts counts, ties to the earliest cut. One that lies
    in a longer candidate with at least `inside` per cent of its count is dropped. Ties of score and a go by the phrase's bytes.

    width is that of the sketch of word counts (16 bytes each, on the driver and in tasks); heavy is the number of
    occurrences above which a pivot's n-grams are dealt out singly. Neither changes a result.
    """
    words = written(word_counts(docs), "words")
    total = int(words.agg(F.sum("n")).first()[0] or 0)
    grams = frequent_phrases(docs, sketch(words, width), least=least, longest=longest, heavy=heavy)
    grams = written(grams, "phrases")

    singles = words.where(F.col("n") >= least).select("lang", F.col("word").alias("part"), F.col("n").alias("f"))
    counts = singles.unionByName(grams.where(F.col("k") < longest).select("lang", F.col("phrase").alias("part"), F.col("a").alias("f")))
    cut = grams.withColumn("words", F.split("phrase", " ")).withColumn("cut", F.explode(F.sequence(F.lit(1), F.col("k") - 1)))
    cut = cut.select("lang", "phrase", "a", "cut", joined_words("words", 1, F.col("cut")).alias("head"), joined_words("words", F.col("cut") + 1, F.col("k") - F.col("cut")).alias("tail"))
    cut = with_count(with_count(cut, counts, total, "head", "l"), counts, total, "tail", "r")
    score = F.expr("cast((cast(a as decimal(20,0)) * 2000000) div (cast(l as decimal(20,0)) + r) as long)")
    scored = cut.withColumn("score", score).groupBy("lang", "phrase").agg(F.first("a").alias("a"), F.min(F.struct("score", "cut", "l", "r")).alias("low"))

    longer = grams.where("k > 2").withColumn("words", F.split("phrase", " "))
    longer = longer.withColumn("size", F.explode(F.sequence(F.lit(2), F.col("k") - 1))).withColumn("from", F.explode(F.sequence(F.lit(1), F.col("k") - F.col("size") + 1)))
    covers = longer.select("lang", joined_words("words", F.col("from"), F.col("size")).alias("phrase"), F.col("a").alias("b")).groupBy("lang", "phrase").agg(F.max("b").alias("b"))
    alone = scored.join(covers, ["lang", "phrase"], "left").where(F.col("b").isNull() | (F.col("b").cast("decimal(20,0)") * 100 < F.col("a").cast("decimal(20,0)") * inside))

    found = alone.select("lang", "phrase", "a", "low.l", "low.r", "low.score")
    order = [F.col("score").desc(), F.col("a").desc(), F.col("phrase")]
    some = found.withColumn("slot", F.pmod(F.xxhash64("phrase"), F.lit(1024)))
    some = some.withColumn("rank", F.row_number().over(Window.partitionBy("lang", "slot").orderBy(*order))).where(F.col("rank") <= top)
    best = some.withColumn("rank", F.row_number().over(Window.partitionBy("lang").orderBy(*order)).cast("long")).where(F.col("rank") <= top)
    sizes = words.groupBy("lang").agg(F.sum("n").alias("n"))
    return best.join(sizes, "lang").select("lang", "rank", "phrase", "a", "l", "r", "n", "score")


#: The same over `documents` in SQL.
SQL = r"""
with docs as (
  select row_number() over () as id, coalesce(lang, 'und') as lang,
    translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') as text
  from documents
), pieces as (
  select lang, list_filter(regexp_split_to_array(piece, '[ 	]+'), lambda x: x <> '') as w
  from (select lang, unnest(regexp_split_to_array(text, '[.,;:!?
-
]')) as piece from docs)
), grams as (
  select lang, k, phrase, count(*) as f
  from (
    select lang, k, array_to_string(w[i : i + k - 1], ' ') as phrase
    from (select lang, w, k, unnest(range(1, len(w) - k + 2)) as i from pieces, (select unnest([1, 2, 3, 4]) as k) where len(w) >= k)
  ) group by all
), sizes as (
  select lang, sum(f) as n from grams where k = 1 group by lang
), candidates as (
  select lang, k, phrase, f as a, string_split(phrase, ' ') as w from grams where k > 1 and f >= 30
), cuts as (
  select c.lang, c.phrase, c.a, cut, h.f as l, t.f as r, (2000000::hugeint * c.a) // (h.f::hugeint + t.f) as score
  from (select *, unnest(range(1, k)) as cut from candidates) c
  join grams h on h.lang = c.lang and h.phrase = array_to_string(c.w[1 : cut], ' ')
  join grams t on t.lang = c.lang and t.phrase = array_to_string(c.w[cut + 1 :], ' ')
), scored as (
  select * from cuts qualify row_number() over (partition by lang, phrase order by score, cut) = 1
), covers as (
  select lang, array_to_string(w[i : i + size - 1], ' ') as phrase, max(a) as b
  from (select *, unnest(range(1, k - size + 2)) as i from (select *, unnest(range(2, k)) as size from candidates))
  group by all
), kept as (
  select s.* from scored s left join covers c using (lang, phrase) where c.b is null or 100 * c.b < 80 * s.a
)
select lang, rank, phrase, a, l, r, n::bigint as n, score::bigint as score
from (select *, row_number() over (partition by lang order by score desc, a desc, phrase) as rank from kept) join sizes using (lang)
where rank <= 2000
"""
