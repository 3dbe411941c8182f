"""A hidden Markov language model over words.

Latent states emit words; states and transitions are learnt by Baum-Welch. A bounded, hash-chosen sample
gives the starting point only; full rounds then add up expected counts over every training document, a
vector per partition, until the likelihood of all of them settles. Counts over every training document
decide which words get an emission of their own. Words without an emission of
their own are emitted as one of a few classes, then drawn within the class by their corpus counts. Counts
of the commonest words are known to every task (a bounded table); all rarer words meet their counts by a
shuffle, whose size follows the corpus. Likelihoods are exact, by the scaled forward recursion over many texts
at once; a very long text is cut into chunks whose scaled transition products, for all states before them,
are chained, so its chunks go side by side too.
"""

from __future__ import annotations

import warnings
import zlib
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from trackloom.llm.common import forget, text_batches, written

#: Classes of words that have no emission of their own, by their last two bytes.
CLASSES = 16
CHUNK = 256
#: Tokens of a text beyond which it is cut into chunks, and tokens whose states are held at once.
LONG, SLAB = 4096, 1 << 17
#: Steps after which state vectors are scaled again; an emission is seldom below 1e-7.
SCALED = 4
ALPHA = 0.1


def split(texts: pa.Array) -> tuple[pa.Array, np.ndarray]:
    """All words of an array of texts with A-Z lower-cased, as binary, and how many each text has."""
    # Lower-cased before the cast: of a slice of a batch Arrow lower-cases wrong bytes after it.
    texts = pc.fill_null(pc.ascii_lower(texts).cast(pa.large_string()), "")
    lists = pc.ascii_split_whitespace(texts)
    words, size = lists.flatten(), pc.list_value_length(lists).to_numpy()
    some = pc.greater(pc.binary_length(words), 0).to_numpy(zero_copy_only=False)  # white space at an end leaves an empty word
    size = np.bincount(np.repeat(np.arange(len(size)), size)[some], minlength=len(size))
    return words.filter(pa.array(some)).cast(pa.large_binary()), size


def word_class(word: bytes) -> int:
    return zlib.crc32(word[-2:]) % CLASSES


def word_classes(words: pa.Array) -> np.ndarray:
    """word_class of each of an array of binary words."""
    tails = pc.dictionary_encode(pc.binary_slice(words, -2))
    kinds = np.array([word_class(x) for x in tails.dictionary.to_pylist()], np.int32)
    return kinds[tails.indices.to_numpy()] if len(words) else np.zeros(0, np.int32)


@dataclass
class Model:
    start: np.ndarray  # (states,)
    move: np.ndarray  # (states, states)
    emit: np.ndarray  # (symbols, states); the last symbol is the end
    known: list[bytes] = field(default_factory=list)
    own: int = 0


def emissions(counts: np.ndarray, plain: np.ndarray, strength: float = 50.0) -> np.ndarray:
    """Emission probabilities from expected counts (symbols, states), smoothed towards the plain distribution."""
    return (counts + strength * plain[:, None]) / (counts.sum(0) + strength)


@dataclass
class Sums:
    """Expected counts: first states, transitions, emissions, and the log-likelihood."""

    start: np.ndarray
    moved: np.ndarray
    emitted: np.ndarray
    total: float = 0.0

    @classmethod
    def zero(cls, model: Model) -> Sums:
        return cls(np.zeros_like(model.start), np.zeros_like(model.move), np.zeros_like(model.emit))


class Columns:
    """Stretches of a flat array of symbols, side by side: the longest first, so that each step works on a leading part.

    Values of all steps stand in one array, step after step; edges tells where each begins.
    """

    def __init__(self, model: Model, flat: np.ndarray, begin: np.ndarray, length: np.ndarray):
        self.model, self.order = model, np.argsort(-length, kind="stable")
        begin, length = begin[self.order], length[self.order]
        self.steps = int(length[0]) if len(length) else 0
        self.active = np.searchsorted(-length, -np.arange(self.steps), side="left")
        self.edges = np.concatenate(([0], np.cumsum(self.active)))
        self.column = np.arange(self.edges[-1]) - np.repeat(self.edges[:-1], self.active)
        self.symbol = flat.take(begin.take(self.column) + np.repeat(np.arange(self.steps), self.active)).astype(np.intp)
        self.emit = model.emit.take(self.symbol, 0)

    def forward(self, before: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Log-likelihood of each stretch after the state distributions before it; the scaled states after each step, and their scales."""
        states, scales = np.empty_like(self.emit), np.ones(len(self.symbol))
        now, edges, move, ones = before[self.order], self.edges.tolist(), self.model.move, np.ones(len(self.model.start))
        for t in range(self.steps):
            a, b = edges[t], edges[t + 1]
            new = states[a:b]
            np.matmul(now[: b - a], move, out=new)
            new *= self.emit[a:b]
            if t % SCALED == SCALED - 1:
                np.matmul(new, ones, out=scales[a:b])
                new /= scales[a:b, None]
            now = new
        log = np.bincount(self.column, np.log(scales), len(self.order))
        total = np.empty_like(log)
        total[self.order] = log + np.log(states[self.final()].sum(1))
        return total, states, scales

    def final(self) -> np.ndarray:
        """Where each column's last step stands."""
        length = np.bincount(self.column, minlength=len(self.order))
        return self.edges[length - 1] + np.arange(len(self.order))

    def products(self) -> tuple[np.ndarray, np.ndarray]:
        """Per stretch the scaled product of its (move, emit) steps and its log scale."""
        k, n = len(self.model.start), len(self.order)
        m, log = np.repeat(np.eye(k)[None], n, 0), np.zeros(n)
        moved, edges = np.empty_like(m), self.edges.tolist()
        for t in range(self.steps):
            a = edges[t + 1] - edges[t]
            np.matmul(m[:a].reshape(a * k, k), self.model.move, out=moved[:a].reshape(a * k, k))
            np.multiply(moved[:a], self.emit[edges[t] : edges[t + 1], None, :], out=m[:a])
            if t % SCALED == SCALED - 1:
                scale = m[:a].max((1, 2))
                m[:a] /= scale[:, None, None]
                log[:a] += np.log(scale)
        out, logs = np.empty_like(m), np.empty(n)
        out[self.order], logs[self.order] = m, log
        return out, logs

    def expect(self, before: np.ndarray, after: np.ndarray, sums: Sums) -> tuple[np.ndarray, np.ndarray]:
        """Adds expected transitions and emissions; returns log-likelihoods and the backward vectors before the stretches."""
        log, states, scales = self.forward(before)
        move, edges, ones = self.model.move, self.edges.tolist(), np.ones(len(self.model.start))
        gamma, ahead = np.empty_like(states), np.empty_like(states)  # states seen from both sides; backward vectors with each step's emission
        now, turned = after[self.order], np.ascontiguousarray(move.T)
        for t in range(self.steps - 1, -1, -1):
            a, b = edges[t], edges[t + 1]
            later = now[: b - a]
            np.multiply(states[a:b], later, out=gamma[a:b])
            np.multiply(self.emit[a:b], later, out=ahead[a:b])
            np.matmul(ahead[a:b], turned, out=later)
            if t % SCALED == 0:
                later /= (later @ ones)[:, None]
        mass = gamma @ ones
        gamma /= mass[:, None]
        for s in range(len(move)):
            sums.emitted[:, s] += np.bincount(self.symbol, gamma[:, s], len(sums.emitted))
        # A step's past, moved and times ahead, adds up to its states' mass before they were scaled.
        ahead /= (mass * scales)[:, None]
        first = edges[min(1, self.steps)]
        pairs = before[self.order[:first]].T @ ahead[:first]
        pairs += states.take(np.arange(first, len(states)) - np.repeat(self.active[:-1], self.active[1:]), 0).T @ ahead[first:]
        sums.moved += move * pairs
        out = np.empty_like(now)
        out[self.order] = now / now.sum(1, keepdims=True)
        return log, out


def slabs(length: np.ndarray) -> Iterator[np.ndarray]:
    """Positions in order, in groups of about SLAB tokens."""
    group = np.cumsum(length) // SLAB
    edges = np.flatnonzero(np.concatenate(([True], group[1:] != group[:-1], [True])))
    for a, b in zip(edges[:-1].tolist(), edges[1:].tolist()):
        yield np.arange(a, b)


def run(model: Model, each: list[np.ndarray], sums: Sums | None = None) -> np.ndarray:
    """Log-likelihood of each sequence (not empty); sums gets the expected counts."""
    flat = np.concatenate(each)
    length = np.array([len(s) for s in each])
    begin = np.cumsum(length) - length
    state = model.start * model.emit[flat[begin]]
    scale = state.sum(1)
    state /= scale[:, None]
    total, back = np.log(scale), np.ones_like(state)
    begin, length = begin + 1, length - 1

    short = np.flatnonzero((length > 0) & (length <= LONG))
    short = short[np.argsort(length[short], kind="stable")]
    for part in slabs(length[short]) if len(short) else ():
        at = short[part]
        columns = Columns(model, flat, begin[at], length[at])
        if sums is None:
            total[at] += columns.forward(state[at])[0]
        else:
            log, back[at] = columns.expect(state[at], np.ones((len(at), state.shape[1])), sums)
            total[at] += log
    for i in np.flatnonzero(length > LONG).tolist():
        starts = np.arange(0, length[i], CHUNK)
        sizes = np.minimum(CHUNK, length[i] - starts)
        before, after = np.empty((len(starts), state.shape[1])), np.ones((len(starts), state.shape[1]))
        product, log = (np.concatenate(x) for x in zip(*(Columns(model, flat, begin[i] + starts[p], sizes[p]).products() for p in slabs(sizes))))
        now = state[i]
        for j in range(len(starts)):
            before[j] = now
            now = now @ product[j]
            total[i] += np.log(now.sum()) + log[j]
            now = now / now.sum()
        if sums is None:
            continue
        for j in range(len(starts) - 1, 0, -1):
            after[j - 1] = product[j] @ after[j]
            after[j - 1] /= after[j - 1].sum()
        for part in slabs(sizes):
            _, first = Columns(model, flat, begin[i] + starts[part], sizes[part]).expect(before[part], after[part], sums)
            if part[0] == 0:
                back[i] = first[0]
    if sums is not None:
        gamma = state * back
        gamma /= gamma.sum(1, keepdims=True)
        sums.start += gamma.sum(0)
        np.add.at(sums.emitted, flat[begin - 1], gamma)
        sums.total += float(total.sum())
    return total


class Encoder:
    """Words as numbers: the place of a known word, -1 - class for others."""

    def __init__(self, known: list[bytes], own: int):
        self.known, self.own = pa.array(known, pa.large_binary()), own
        # The symbol of each known word, then of each class, so that numbers below zero find theirs too.
        self.table = np.concatenate((np.arange(own), own + word_classes(self.known[own:]), np.arange(own + CLASSES - 1, own - 1, -1))).astype(np.int32)

    def numbers(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray, pa.Array, np.ndarray]:
        """Numbers of all words of texts, how many words each text has, the distinct words and each word's place there."""
        words, size = split(texts)
        coded = pc.dictionary_encode(words)
        found = pc.fill_null(pc.index_in(coded.dictionary, self.known), -1).to_numpy()
        of = np.where(found >= 0, found, -1 - word_classes(coded.dictionary)).astype(np.int32)
        place = coded.indices.to_numpy()
        return of[place] if len(place) else np.zeros(0, np.int32), size, coded.dictionary, place

    def symbols(self, numbers: np.ndarray) -> np.ndarray:
        return self.table[numbers]

    @property
    def end(self) -> int:
        return self.own + CLASSES


def sequences(encoder: Encoder, lists: pa.ListArray) -> list[np.ndarray]:
    """Symbols of each row's numbers, then the end."""
    flat = encoder.symbols(lists.flatten().to_numpy())
    edges = np.concatenate(([0], np.cumsum(pc.list_value_length(lists).to_numpy())))
    return [np.append(flat[a:b], np.int32(encoder.end)) for a, b in zip(edges[:-1].tolist(), edges[1:].tolist())]


def number_batches(batches: Iterator[pa.RecordBatch], most: int = 1 << 21) -> Iterator[pa.RecordBatch]:
    """Arrow batches cut so that their numbers are about most at most (or one row)."""
    for batch in batches:
        group = np.cumsum(pc.list_value_length(batch.column(batch.schema.get_field_index("numbers"))).to_numpy()) // most
        edges = np.flatnonzero(np.concatenate(([True], group[1:] != group[:-1], [True])))
        for a, b in zip(edges[:-1].tolist(), edges[1:].tolist()):
            yield batch.slice(a, b - a)


def encoded(docs: DataFrame, known: list[bytes], own: int) -> DataFrame:
    """doc_id, key, held_out, numbers, rare (each unknown word with its count) for every row of docs (doc_id, key, held_out, text)."""
    held = docs.sparkSession.sparkContext.broadcast(known)

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = Encoder(held.value, own)
        for batch in text_batches(batches):
            numbers, size, words, place = encoder.numbers(batch.column("text"))
            row, unknown = np.repeat(np.arange(len(size)), size), numbers < 0
            pair, times = np.unique(row[unknown] * len(words) + place[unknown], return_counts=True)
            rare = pa.StructArray.from_arrays([words.take(pa.array(pair % max(1, len(words)))).cast(pa.binary()), pa.array(times, pa.int32())], ["word", "n"])
            sizes = ((size, pa.array(numbers)), (np.bincount(pair // max(1, len(words)), minlength=len(size)), rare))
            lists = [pa.ListArray.from_arrays(np.concatenate(([0], np.cumsum(n))).astype(np.int32), y) for n, y in sizes]
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in ("doc_id", "key", "held_out")), *lists], ["doc_id", "key", "held_out", "numbers", "rare"])

    fields = "doc_id long, key long, held_out boolean, numbers array<int>, rare array<struct<word: binary, n: int>>"
    return docs.select("doc_id", "key", "held_out", "text").mapInArrow(encode, fields)


def start_model(texts: list[str | None], known: list[bytes], own: int, states: int, rounds: int) -> Model:
    """Baum-Welch on a bounded sample, from emissions perturbed at random with a fixed seed."""
    encoder = Encoder(known, own)
    end = encoder.end
    numbers, size, *_ = encoder.numbers(pa.array(texts or [""], pa.string()))
    seen = [np.append(x, np.int32(end)) for x in np.split(encoder.symbols(numbers), np.cumsum(size)[:-1])]
    plain = np.bincount(np.concatenate(seen), minlength=end + 1) + 0.5
    plain /= plain.sum()
    rng = np.random.default_rng(17)
    emit = plain[:, None] * rng.uniform(0.5, 1.5, (end + 1, states))
    move = np.full((states, states), 0.3 / states) + 0.7 * np.eye(states)
    model = Model(np.full(states, 1 / states), move, emit / emit.sum(0), known, own)
    for _ in range(rounds):
        sums = Sums.zero(model)
        run(model, seen, sums)
        model = updated(model, sums, plain)
    return model


def updated(model: Model, sums: Sums, plain: np.ndarray) -> Model:
    """The model re-estimated from expected counts."""
    start = (sums.start + 0.1) / (sums.start + 0.1).sum()
    move = (sums.moved + 0.1) / (sums.moved + 0.1).sum(1, keepdims=True)
    return Model(start, move, emissions(sums.emitted, plain), model.known, model.own)


def full_round(train: DataFrame, model: Model) -> Sums:
    """Expected counts over all training rows (numbers), and their log-likelihood; partitions send sums of a fixed size."""
    held = train.sparkSession.sparkContext.broadcast(model)
    states = len(model.start)

    def expect(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = held.value
        encoder, sums = Encoder(m.known, m.own), Sums.zero(m)
        for batch in number_batches(batches):
            run(m, sequences(encoder, batch.column("numbers")), sums)
        used = np.flatnonzero(sums.emitted.sum(1))
        rows = [*sums.moved, sums.start, np.full(states, sums.total / states), *sums.emitted[used]]
        at = np.concatenate((-1 - np.arange(states + 2), used))
        yield pa.RecordBatch.from_arrays([pa.array(at, pa.int32()), *(pa.array(np.array([r[s] for r in rows])) for s in range(states))], ["at", *(f"s{s}" for s in range(states))])

    columns = [f"s{s}" for s in range(states)]
    sent = train.select("numbers").mapInArrow(expect, "at int, " + ", ".join(f"{c} double" for c in columns))
    table = sent.groupBy("at").agg(*(F.sum(c).alias(c) for c in columns)).toPandas()
    out, at, values = Sums.zero(model), table["at"].to_numpy(), table[columns].to_numpy()
    for j in range(states):
        out.moved[j] = values[at == -1 - j].sum(0)
    out.start[:] = values[at == -1 - states].sum(0)
    out.total = float(values[at == -2 - states].sum())
    out.emitted[at[at >= 0]] = values[at >= 0]
    return out


def settled(train: DataFrame, model: Model, plain: np.ndarray, tolerance: float, most_rounds: int) -> Model:
    """Full rounds until one raises the log-likelihood of all training rows by less than tolerance of itself."""
    before = None
    for _ in range(most_rounds):
        sums = full_round(train, model)
        model = updated(model, sums, plain)
        if before is not None and sums.total - before <= tolerance * abs(before):
            return model
        before = sums.total
    warnings.warn(f"the likelihood still rose by more than {tolerance} of itself after {most_rounds} rounds", stacklevel=2)
    return model


def word_counts(train: DataFrame) -> DataFrame:
    """word, n, class of every distinct word of train."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in text_batches(batches):
            found = pc.value_counts(split(batch.column("text"))[0])
            words = found.field("values")
            yield pa.RecordBatch.from_arrays([words.cast(pa.binary()), found.field("counts"), pa.array(word_classes(words))], ["word", "n", "class"])

    return train.select("text").mapInArrow(count, "word binary, n long, class int").groupBy("word").agg(F.sum("n").alias("n"), F.first("class").alias("class"))


def common_words(words: DataFrame, most: int) -> pd.DataFrame:
    """word, n, class of the commonest words, most at most, by falling n: all above a count that a histogram of counts gives.

    Counts from 1024 on fall into bins of about one per cent, so a few thousand bins reach the driver.
    """
    level = F.when(F.col("n") < 1024, F.col("n")).otherwise(1024 + F.floor(64 * (F.log2("n") - 10))).cast("long")
    bins = words.groupBy(level.alias("level")).agg(F.count("*").alias("words")).toPandas().sort_values("level", ascending=False)
    fit = bins[bins["words"].cumsum() <= most]["level"]
    least = int(fit.min()) if len(fit) else 1 << 62
    return words.where(level >= least).toPandas().sort_values(["n", "word"], ascending=[False, True])


def rare_sums(table: DataFrame) -> DataFrame:
    """Per row key: sum of log10(c + alpha) and number of seen ones over the rare words of an encoded table.

    Words are counted by an aggregation, and their counts meet the rows by a join, which adaptive execution splits at
    a word of many rows.
    """
    rows = table.select("doc_id", "key", "held_out", F.explode("rare").alias("r")).select("doc_id", "key", "r.word", "r.n", F.when(~F.col("held_out"), F.col("r.n")).alias("train"))
    counts = rows.groupBy("word").agg(F.coalesce(F.sum("train"), F.lit(0)).alias("c"))
    counted = rows.join(counts, "word")
    return counted.groupBy("doc_id", "key").agg(F.sum(F.col("n") * F.log10(F.col("c") + F.lit(ALPHA))).alias("rare_log"), F.sum(F.when(F.col("c") > 0, F.col("n")).otherwise(0)).alias("rare_known"))


def score(docs: DataFrame, held_out: Column, *, states: int = 6, own_words: int = 1 << 14, known_words: int = 1 << 17, sample: int = 1500, sample_chars: int = 1 << 14, start_rounds: int = 15, tolerance: float = 1e-3, most_rounds: int = 60) -> DataFrame:
    """doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score for every row of docs (doc_id, text).

    Learns from all rows where held_out is false. sample (documents, the first sample_chars of each) bounds
    what the starting model looks at and nothing else; words, counts and the rounds that end within tolerance
    use all training rows. Words with equal counts are ordered by their bytes. A long text is encoded in parts and scored whole. A null text
    is empty and holds one end token. Repeated rows each count and each give a row; a null doc_id stays
    null; an empty table gives an empty table; other columns are ignored. Without any training row the
    scores are those of an untrained model.
    """
    spark = docs.sparkSession
    own = docs.select("doc_id", "text", F.xxhash64(F.col("doc_id").cast("string"), F.col("text")).alias("key"), held_out.alias("held_out"))
    train = own.where(~F.col("held_out"))
    near = F.xxhash64(F.col("doc_id").cast("string"), F.lit("sample"))
    total = train.count()
    chosen = lambda n: train.where(F.pmod(near, F.lit(1 << 30)) < F.lit(int(min(1.0, n / max(total, 1)) * (1 << 30))))

    words = written(word_counts(train), "words")
    top = common_words(words, known_words)
    known, counts = [bytes(w) for w in top["word"]], top["n"].to_numpy(np.int64)
    own_count = min(own_words, len(known))
    by_class = words.groupBy("class").agg(F.sum("n").alias("n"), F.count("*").alias("kinds")).collect()
    classes, kinds = np.zeros(CLASSES, np.int64), np.zeros(CLASSES, np.int64)
    for r in by_class:
        classes[r["class"]], kinds[r["class"]] = r["n"], r["kinds"]
    train_tokens, distinct = int(classes.sum()) + total, int(kinds.sum()) + (total > 0)
    first = top["class"].to_numpy(np.int64)[:own_count]
    classes -= np.bincount(first, counts[:own_count], CLASSES).astype(np.int64)
    kinds -= np.bincount(first, minlength=CLASSES)
    forget(words)
    model = start_model([r["text"] for r in chosen(sample).orderBy("key").select(F.substring("text", 1, sample_chars).alias("text")).collect()], known, own_count, states, start_rounds)
    plain = np.concatenate((counts[:own_count], classes, [total])) + 0.5
    plain = plain / plain.sum()
    table = written(encoded(own, known, own_count), "encoded")
    model = settled(table.where(~F.col("held_out")), model, plain, tolerance, most_rounds)

    rare = written(rare_sums(table), "rare")
    within = np.log10(classes + ALPHA * (kinds + 1))  # log of each class's mass
    mass = float(np.log10(train_tokens + ALPHA * (distinct + 1)))
    held = spark.sparkContext.broadcast((model, np.log10(counts + ALPHA), within, float(np.log10(total + ALPHA)), int(total > 0)))

    def likelihood(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m, logs, classes_log, end_log, end_seen = held.value
        encoder = Encoder(m.known, m.own)
        for batch in number_batches(batches):
            lists = batch.column("numbers")
            flat, size = lists.flatten().to_numpy(), pc.list_value_length(lists).to_numpy()
            row, symbol = np.repeat(np.arange(len(size)), size), encoder.symbols(flat)
            add = lambda chosen, values: np.bincount(row[chosen], values, len(size))
            hit, classed = flat >= 0, symbol >= m.own
            both = hit & classed
            inner = add(both, logs[flat[both]]) - add(classed, classes_log[symbol[classed] - m.own])
            chain = run(m, sequences(encoder, lists)) / np.log(10)
            new = [pa.array((size + 1).astype(np.int64)), pa.array(add(hit, None) + end_seen), pa.array(add(hit, logs[flat[hit]]) + end_log), pa.array(chain + inner)]
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in ("doc_id", "key", "held_out")), *new], ["doc_id", "key", "held_out", "n_tokens", "known", "base", "chain"])

    scored = table.select("doc_id", "key", "held_out", "numbers").mapInArrow(likelihood, "doc_id long, key long, held_out boolean, n_tokens long, known long, base double, chain double")
    scored = written(scored, "scored")
    forget(table)
    times = scored.groupBy("doc_id", "key").agg(F.count("*").alias("times"))
    shared = rare.join(times, rare.key.eqNullSafe(times.key) & rare.doc_id.eqNullSafe(times.doc_id)).select(rare.doc_id.alias("r_id"), rare.key.alias("r_key"), (F.col("rare_log") / F.col("times")).alias("rare_log"), (F.col("rare_known") / F.col("times")).cast("long").alias("rare_known"))
    both = scored.join(shared, F.col("doc_id").eqNullSafe(F.col("r_id")) & (F.col("key") == F.col("r_key")), "left")
    extra = F.coalesce(F.col("rare_log"), F.lit(0.0))
    return both.select(
        "doc_id",
        "held_out",
        "n_tokens",
        (F.col("known") + F.coalesce("rare_known", F.lit(0))).alias("n_known"),
        F.lit(train_tokens).cast("long").alias("train_tokens"),
        (F.col("base") + extra - F.col("n_tokens") * F.lit(mass)).alias("base_score"),
        (F.col("chain") + extra).alias("score"),
    )
