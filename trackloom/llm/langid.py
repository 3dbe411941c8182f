"""Language identification by interpolated Kneser-Ney character models.

Each language has a character model of up to four characters. Counts come from a bounded, hash-chosen
sample of labelled documents per language; the models' probabilities stand side by side in one sorted
array of n-gram hashes per order, so a text looks every n-gram up once for all languages. The language
with the lowest cross-entropy per character wins. Rejection and score are calibrated on labelled documents
that the models did not see: a text is rejected whose cross-entropy is far above what they have at its
length, and one temperature makes posteriors as sure as they are right.
"""

from __future__ import annotations

import math
import random
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from trackloom.llm.common import text_batches

ORDER = 4
UNKNOWN = "und"
_factors = random.Random(7)
FACTORS = [np.array([_factors.getrandbits(64) | 1 for _ in range(n)], np.uint64) for n in range(1, ORDER + 1)]
_letters: list[np.ndarray] = []


def letters() -> np.ndarray:
    if not _letters:
        _letters.append(np.array([chr(c).isalpha() for c in range(0x110000)]))
    return _letters[0]


def symbols(text: str) -> np.ndarray:
    """Lower-case letters of a text as code points, every run of other characters as one space; empty without letters."""
    points = np.frombuffer(text.lower().encode("utf-32-le", "surrogatepass"), np.uint32)
    letter = letters()[points]
    if not letter.any():
        return np.zeros(0, np.uint32)
    keep = letter.copy()
    keep[1:] |= letter[:-1]
    return np.where(letter, points, 32).astype(np.uint32)[keep]


def gram_hashes(padded: np.ndarray, n: int, back: int = 0) -> np.ndarray:
    """Hashes of the n-grams that end `back` places before each symbol after the padding of ORDER - 1 spaces."""
    out = np.zeros(len(padded) - ORDER + 1, np.uint64)
    for k, factor in enumerate(FACTORS[n - 1]):
        first = ORDER - n + k - back
        out += padded[first : first + len(out)].astype(np.uint64) * factor
    return out ^ (out >> np.uint64(29))


def pad(seq: np.ndarray) -> np.ndarray:
    return np.concatenate((np.full(ORDER - 1, 32, np.uint32), seq))


class SortedHashes:
    """A sorted array of distinct 64-bit hashes with an index by leading bits."""

    def __init__(self, keys: np.ndarray):
        self.size = len(keys)
        self.keys = np.append(keys, np.uint64(2**64 - 1))
        bits = max(1, min(20, int(len(keys)).bit_length() + 1))
        self.shift = np.uint64(64 - bits)
        self.start = np.searchsorted(keys, np.arange(1 << bits, dtype=np.uint64) << self.shift).astype(np.int32)

    def find(self, hashes: np.ndarray) -> np.ndarray:
        """Position of each hash, or -1."""
        at = self.start[hashes >> self.shift]
        while True:
            below = (self.keys[at] < hashes) & (at < self.size)
            if not below.any():
                break
            at = at + below
        return np.where((self.keys[at] == hashes) & (at < self.size), at, -1)


@dataclass
class Model:
    """languages; per order the sorted hashes with log2 probabilities, and log2 back-off weights of contexts."""

    languages: list[str]
    grams: list[SortedHashes]
    logp: list[np.ndarray]
    backoff: list[np.ndarray]
    #: log2 probability of a character that no model knows, a language's smallest; then what calibration sets.
    floor: np.ndarray
    mean: np.ndarray | None = None
    #: Variance of the cross-entropy, over languages: a constant part and one that falls with the length.
    spread: np.ndarray | None = None
    temperature: float = 1.0
    deviations: float = 6.0

    def limits(self, length: int) -> np.ndarray:
        """Cross-entropy beyond which a text of so many symbols is rejected."""
        if self.mean is None:
            return np.full(len(self.languages), np.inf)
        return self.mean + self.deviations * np.sqrt(self.spread[0] + self.spread[1] / length)

    def log2_probabilities(self, seq: np.ndarray) -> np.ndarray:
        """Sum over the symbols of log2 p, one value per language."""
        padded, total = pad(seq), np.zeros(len(self.languages))
        positions = np.arange(len(seq))
        for n in range(ORDER, 0, -1):
            at = self.grams[n - 1].find(gram_hashes(padded, n)[positions] if n < ORDER else gram_hashes(padded, n))
            hit = at >= 0
            counts = np.bincount(at[hit], minlength=0)
            seen = np.flatnonzero(counts)
            total += counts[seen] @ self.logp[n - 1][seen]
            positions = positions[~hit]
            if not len(positions):
                return total
            if n > 1:  # what the longer context gives up, where it is known
                context = self.grams[n - 2].find(gram_hashes(padded, n - 1, 1)[positions])
                known = np.where((context < 0) & (positions == 0), self.grams[n - 2].size, context)
                known = known[known >= 0]
                total += self.backoff[n - 2][known].sum(0)
        return total + len(positions) * self.floor


def build(counts: list[tuple[str, str, int]]) -> Model:
    """Interpolated Kneser-Ney models from counts of (language, n-gram of ORDER characters)."""
    languages = sorted({c[0] for c in counts})
    number = {x: i for i, x in enumerate(languages)}
    lang = np.array([number[c[0]] for c in counts])
    chars = np.frombuffer("".join(c[1] for c in counts).encode("utf-32-le", "surrogatepass"), np.uint32).reshape(-1, ORDER)
    weight = np.array([c[2] for c in counts], float)
    n_langs, alphabet = len(languages), len(np.unique(chars)) + 1
    tables: list[tuple] = []
    for n in range(ORDER, 0, -1):
        if n < ORDER:  # continuation counts: distinct longer n-grams that end so
            chars = chars[:, 1:]
            weight = np.ones(len(chars))
        code = np.array([hash_rows(chars, n)]).T
        both, first, inverse = np.unique(np.column_stack((code, lang.astype(np.uint64))), axis=0, return_index=True, return_inverse=True)
        weight = np.bincount(inverse.ravel(), weight)
        chars, lang = chars[first], lang[first]
        tables.append((chars, lang, weight))
    tables.reverse()
    grams, logp, backoff, lower = [], [], [], None
    floor = 1.0 / alphabet
    for n, (chars, lang, weight) in enumerate(tables, 1):
        keys, inverse = np.unique(hash_rows(chars, n), return_inverse=True)
        inverse = inverse.ravel()
        first = np.zeros(len(keys), int)
        first[inverse] = np.arange(len(inverse))
        discount = np.array([kneser_discount(weight[lang == i]) for i in range(n_langs)])
        left = np.maximum(weight - discount[lang], 0)
        if n == 1:
            total, kinds = np.bincount(lang, weight, n_langs), np.bincount(lang, minlength=n_langs)
            unseen = gamma = discount * kinds / np.maximum(total, 1)
            p = np.tile(gamma * floor, (len(keys), 1))
            p[inverse, lang] += left / total[lang]
        else:
            context = grams[-1].find(hash_rows(chars[:, :-1], n - 1))
            contexts = grams[-1].size
            total, kinds = np.zeros((contexts + 1, n_langs)), np.zeros((contexts + 1, n_langs))
            np.add.at(total, (context, lang), weight)
            np.add.at(kinds, (context, lang), 1)
            gamma = np.where(total > 0, discount * kinds / np.maximum(total, 1e-9), 1.0)
            # The last row is the start of a text, which no shorter n-gram ends with.
            backoff.append(np.log2(np.maximum(gamma, 1e-12)))
            # The row's context and ending are the same for every language that has the n-gram.
            rows = chars[first]
            p = gamma[grams[-1].find(hash_rows(rows[:, :-1], n - 1))] * lower[grams[-1].find(hash_rows(rows[:, 1:], n - 1))]
            p[inverse, lang] += left / total[context, lang]
        grams.append(SortedHashes(keys))
        logp.append(np.log2(p))
        lower = p
    return Model(languages, grams, logp, backoff, np.log2(unseen * floor))


def hash_rows(chars: np.ndarray, n: int) -> np.ndarray:
    out = (chars.astype(np.uint64) * FACTORS[n - 1]).sum(1, dtype=np.uint64)
    return out ^ (out >> np.uint64(29))


def kneser_discount(weight: np.ndarray) -> float:
    once, twice = (weight == 1).sum(), (weight == 2).sum()
    return float(once / (once + 2 * twice)) if once and twice else 0.5


def judge(model: Model, text: str | None) -> tuple[str, float, float | None, bool]:
    """Language, posterior score, cross-entropy in bits a character, and whether the text is accepted."""
    seq = symbols(text or "")
    if not len(seq) or not model.languages:
        return UNKNOWN, 0.0, None, False
    total = model.log2_probabilities(seq)
    best = int(np.argmax(total))
    entropy = -total[best] / len(seq)
    posterior = 1 / np.exp2(np.maximum((total - total[best]) / model.temperature, -1000)).sum()
    accepted = entropy <= model.limits(len(seq))[best]
    return model.languages[best], float(posterior), float(entropy), bool(accepted)


def calibrate(model: Model, seen: list[tuple[str, np.ndarray, int]]) -> None:
    """Sets mean, spread and temperature from (lang, total log2 probability per language, symbols) of texts the model did not see.

    The limit lies `deviations` above the mean: by Cantelli's inequality it rejects 1 / (1 + deviations^2) of a
    language's own texts at most, whatever their distribution.
    """
    number = {x: i for i, x in enumerate(model.languages)}
    seen = [(number[lang], total, n) for lang, total, n in seen if lang in number and n]
    if not seen:
        return
    lang, total, n = (np.array(x) for x in zip(*seen))
    entropy = -total[np.arange(len(lang)), lang] / n
    model.mean = np.array([np.average(entropy[lang == i], weights=n[lang == i]) if (lang == i).any() else np.inf for i in range(len(number))])
    square = (entropy - model.mean[lang]) ** 2
    # square = constant + slope / n, both not negative, where short texts weigh less.
    x, weight = 1 / n, n / (1 + n / 200)
    slope = max(0.0, np.cov(x, square, aweights=weight)[0, 1] / max(np.cov(x, aweights=weight), 1e-18)) if len(x) > 1 else 0.0
    constant = max(1e-4, np.average(square - slope * x, weights=weight))
    model.spread = np.array([constant, slope])

    def loss(t: float) -> float:
        z = (total - total.max(1, keepdims=True)) / t
        return float((np.log2(np.exp2(np.maximum(z, -1000)).sum(1)) - z[np.arange(len(lang)), lang]).sum())

    model.temperature = min((2 ** (k / 4) for k in range(49)), key=loss)


def train(docs: DataFrame, *, per_language: int = 1500, deviations: float = 6.0) -> Model:
    """A model of every non-null lang of docs (doc_id, text, lang).

    per_language bounds the sample: about so many documents of a language, those with the lowest hashes. Four
    in five of them are counted; the fifth calibrates. A text is rejected if its cross-entropy is more than so
    many deviations above the mean of the calibrating texts, at its length.
    """
    spark = docs.sparkSession
    usable = docs.select("doc_id", "text", "lang").where("text is not null and lang is not null")
    shares = {r["lang"]: min(1.0, per_language / r["n"]) for r in usable.groupBy("lang").agg(F.count("*").alias("n")).collect()}
    nothing = Model([], [], [], [], np.zeros(0))
    if not shares:
        return nothing
    share = F.create_map(*(F.lit(x) for pair in shares.items() for x in pair))[F.col("lang")]
    drawn = usable.where(F.pmod(F.xxhash64(F.col("doc_id").cast("string"), F.lit("sample")), F.lit(1 << 20)) < share * (1 << 20))
    fifth = F.pmod(F.xxhash64("text", F.lit("calibrate")), F.lit(5)) == 0
    sample, unseen = drawn.where(~fifth), drawn.where(fifth)

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in text_batches(batches):
            seen: dict[tuple[str, str], int] = {}
            by: dict[str, list[np.ndarray]] = {}
            for lang, text in zip(batch.column("lang").to_pylist(), batch.column("text").to_pylist()):
                by.setdefault(lang, []).append(np.lib.stride_tricks.sliding_window_view(pad(symbols(text)), ORDER) if len(symbols(text)) else np.zeros((0, ORDER), np.uint32))
            for lang, views in by.items():
                rows = np.concatenate(views)
                _, first, n = np.unique(hash_rows(rows, ORDER), return_index=True, return_counts=True)
                for i, k in zip(first.tolist(), n.tolist()):
                    gram = rows[i].tobytes().decode("utf-32-le", "surrogatepass")
                    seen[lang, gram] = seen.get((lang, gram), 0) + k
            yield pa.RecordBatch.from_arrays([pa.array([k[0] for k in seen], pa.string()), pa.array([k[1] for k in seen], pa.string()), pa.array(list(seen.values()), pa.int64())], ["lang", "gram", "n"])

    grams = sample.mapInArrow(count, "lang string, gram string, n long").groupBy("lang", "gram").agg(F.sum("n").alias("n"))
    table = grams.toPandas().sort_values(["lang", "gram"])
    if not len(table):
        return nothing
    model = build(list(zip(table["lang"], table["gram"], table["n"])))
    model.deviations = deviations
    held = spark.sparkContext.broadcast(model)

    def measure(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in text_batches(batches):
            texts = [symbols(x) for x in batch.column("text").to_pylist()]
            totals = [held.value.log2_probabilities(x).tolist() for x in texts]
            yield pa.RecordBatch.from_arrays([batch.column("lang"), pa.array(totals, pa.list_(pa.float64())), pa.array(list(map(len, texts)), pa.int64())], ["lang", "total", "n"])

    measured = unseen.select("lang", "text").mapInArrow(measure, "lang string, total array<double>, n long").collect()
    calibrate(model, [(r["lang"], np.array(r["total"]), r["n"]) for r in measured])
    return model


def identify(docs: DataFrame, model: Model, *, keep_text: bool = False) -> DataFrame:
    """doc_id, lang_pred, score, entropy, accepted for every row of docs (doc_id, text).

    A null text, or one without a letter, is `und` with score 0 and not accepted. Repeated rows each give
    a row, an empty table an empty table; a null doc_id stays null; other columns are ignored, or kept with
    keep_text, but for those that have a new one's name. A long text is read whole, at about 100 bytes of
    memory a character.
    """
    held = docs.sparkSession.sparkContext.broadcast(model)

    def predict(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in text_batches(batches):
            found = [judge(held.value, x) for x in batch.column("text").to_pylist()]
            kinds = (pa.string(), pa.float64(), pa.float64(), pa.bool_())
            new = [pa.array([f[i] for f in found], kind) for i, kind in enumerate(kinds)]
            own = batch.columns if keep_text else [batch.column("doc_id")]
            names = batch.schema.names if keep_text else ["doc_id"]
            yield pa.RecordBatch.from_arrays([*own, *new], [*names, "lang_pred", "score", "entropy", "accepted"])

    source = docs.drop("lang_pred", "score", "entropy", "accepted") if keep_text else docs.select("doc_id", "text")
    own = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in source.schema) if keep_text else "doc_id long"
    return source.mapInArrow(predict, f"{own}, lang_pred string, score double, entropy double, accepted boolean")


def predict_languages(docs: DataFrame, held_out: Column) -> DataFrame:
    """doc_id, held_out, lang_pred, score: trained on the rows where held_out is false, applied to all."""
    model = train(docs.where(~held_out))
    return identify(docs, model).withColumn("held_out", held_out).select("doc_id", "held_out", "lang_pred", "score", "entropy", "accepted")
