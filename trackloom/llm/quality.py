"""Quality classification with naive Bayes support vectors.

A text's features are indicators of hashed n-grams: words, word endings, pairs of neighbouring endings, and
four-grams of the distances to each word's last occurrence. Indicators are scaled by the log-count ratio of
the two classes; a linear hinge-loss model over the scaled indicators is fitted by dual coordinate descent,
and its margins are calibrated on labelled rows that the fit did not see. Fit and ratios use a bounded,
hash-chosen sample of labelled rows; every row of the table is scored, from its whole text alone.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from trackloom.llm.common import forget, text_batches, written

BUCKETS = 1 << 18
#: Odd factors that mix the hashes of an n-gram's parts.
MIX = [np.uint64(f) for f in (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0x27D4EB2F165667C5, 0xD6E8FEB86659FD93)]


def grams(parts: np.ndarray, n: int) -> np.ndarray:
    """Hashes of the runs of n parts."""
    count = max(0, len(parts) - n + 1)
    return sum((parts[k : k + count] * MIX[k] for k in range(n)), np.zeros(count, np.uint64))


def features(text: str | None) -> np.ndarray:
    """Distinct feature numbers of a text, below BUCKETS."""
    words = (text or "").encode().split()
    whole = np.fromiter(map(zlib.crc32, words), np.uint64, len(words))
    ending = np.fromiter((zlib.crc32(w[-3:]) for w in words), np.uint64, len(words))
    # The sequence of words that tells which of them came before, n words ago: its n-grams show repetition.
    _, first = np.unique(whole, return_inverse=True)
    last = np.full(len(words), -1)
    order = np.argsort(first, kind="stable")
    again = first[order][1:] == first[order][:-1]
    last[order[1:][again]] = order[:-1][again]
    gap = np.where(last >= 0, np.minimum(np.arange(len(words)) - last, 64), 0).astype(np.uint64)
    found = np.concatenate((grams(whole, 1), grams(ending, 1) * MIX[4], grams(ending, 2), grams(gap, 4) * MIX[4] + MIX[1]))
    return np.unique(((found >> np.uint64(23)) % np.uint64(BUCKETS)).astype(np.int32))


@dataclass
class Model:
    """Margin of a text: sum of weight over its features, by the norm of its ratios, plus bias."""

    weight: np.ndarray
    square: np.ndarray
    bias: float
    slope: float
    offset: float

    def score(self, found: np.ndarray) -> float:
        norm = float(np.sqrt(self.square[found].sum())) or 1.0
        margin = float(self.weight[found].sum()) / norm + self.bias
        return float(1 / (1 + np.exp(-np.clip(self.slope * margin + self.offset, -500, 500))))


def dual_descent(rows: list[np.ndarray], values: list[np.ndarray], y: np.ndarray, cost: np.ndarray, size: int, rounds: int = 12) -> np.ndarray:
    """Weights of a linear model with hinge loss, by dual coordinate descent (Hsieh et al., 2008); row i's dual value stays within 0 and cost[i]."""
    w, a = np.zeros(size), np.zeros(len(rows))
    q = np.array([float(v @ v) for v in values])
    rng = np.random.default_rng(5)
    for _ in range(rounds):
        for i in rng.permutation(len(rows)):
            x, v = rows[i], values[i]
            gradient = y[i] * float(w[x] @ v) - 1
            new = min(max(a[i] - gradient / q[i], 0.0), cost[i])
            if new != a[i]:
                w[x] += (new - a[i]) * y[i] * v
                a[i] = new
    return w


def calibrate(margin: np.ndarray, good: np.ndarray) -> tuple[float, float]:
    """Slope and offset of a logistic curve through margins, by Newton steps with a light penalty."""
    x = np.column_stack((margin, np.ones(len(margin))))
    target = np.where(good, (good.sum() + 1) / (good.sum() + 2), 1 / ((~good).sum() + 2))
    b = np.array([1.0, 0.0])
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(x @ b, -30, 30)))
        gradient = x.T @ (p - target) + 1e-3 * b
        step = np.linalg.solve((x * (p * (1 - p))[:, None]).T @ x + 1e-3 * np.eye(2), gradient)
        b = b - step
        if np.abs(step).max() < 1e-8:
            break
    return float(b[0]), float(b[1])


def fit(rows: list[np.ndarray], good: np.ndarray, smooth: float = 1.0, cost: float = 1.0) -> Model:
    """The model of labelled feature rows; every fifth one is left for calibration. One class or no rows: a constant."""
    size = BUCKETS
    if not len(rows) or good.all() or not good.any():
        share = (good.sum() + 1) / (len(rows) + 2)
        return Model(np.zeros(size), np.zeros(size), 0.0, 1.0, float(np.log(share / (1 - share))))
    kept = np.arange(len(rows)) % 5 != 4
    if good[kept].all() or not good[kept].any() or len(rows) < 50:
        kept[:] = True
    counts = [np.full(size, smooth), np.full(size, smooth)]
    for i in np.flatnonzero(kept):
        counts[int(good[i])][rows[i]] += 1
    ratio = np.log(counts[1] / counts[1].sum()) - np.log(counts[0] / counts[0].sum())
    bias_at = size
    unit = lambda v: np.append(v / (np.sqrt(v @ v) or 1.0), 1.0).astype(np.float32)
    values = [unit(ratio[r]) for r in rows]
    placed = [np.append(r, np.int32(bias_at)) for r in rows]
    y = np.where(good, 1.0, -1.0)
    rarer = {1.0: 1.0, -1.0: good[kept].sum() / max(1, (~good[kept]).sum())}
    chosen = np.flatnonzero(kept)
    w = dual_descent([placed[i] for i in chosen], [values[i] for i in chosen], y[chosen], cost * np.array([min(10.0, rarer[v]) for v in y[chosen]]), size + 1)
    rest = np.flatnonzero(~kept) if not kept.all() else chosen
    margin = np.array([float(w[placed[i]] @ values[i]) for i in rest])
    slope, offset = calibrate(margin, good[rest])
    return Model(w[:-1] * ratio, ratio**2, float(w[-1]), slope, offset)


def train(docs: DataFrame, labels: DataFrame, *, label: str = "quality", sample: int = 12_000, sample_bytes: int = 1 << 28) -> Model:
    """The model of docs (doc_id, text) labelled 0 or 1 in labels (doc_id, label).

    sample bounds the labelled rows that the fit sees: those with the lowest hashes of doc_id, equal ones by doc_id; sample_bytes
    bounds their features on the driver, in the same order. Null labels, and ids labelled both ways, are left out. Every text's features are taken whole.
    """
    once = labels.where(F.col(label).isNotNull() & F.col("doc_id").isNotNull()).groupBy("doc_id").agg(F.min(label).alias("low"), F.max(label).alias("high")).where("low = high")
    order = F.xxhash64(F.col("doc_id").cast("string"), F.lit("label"))
    chosen = once.select("doc_id", F.col("low").alias("label"), order.alias("order")).orderBy("order", "doc_id").limit(sample)

    def extract(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in text_batches(batches):
            found = pa.array([features(x).astype("<i4").tobytes() for x in batch.column("text").to_pylist()], pa.binary())
            yield pa.RecordBatch.from_arrays([batch.column("order"), batch.column("label"), found], ["order", "label", "found"])

    # At most `sample` rows of 20 bytes are broadcast.
    joined = docs.select("doc_id", "text").join(F.broadcast(chosen), "doc_id").select("order", F.col("label").cast("int").alias("label"), "text")
    drawn = written(joined.mapInArrow(extract, "order long, label int, found binary"), "labelled")
    sizes = sorted(map(tuple, drawn.select("order", F.length("found").alias("size")).collect()))
    held = np.cumsum([size for _, size in sizes]) <= sample_bytes
    table = drawn.where(F.col("order") <= F.lit(sizes[int(held.sum()) - 1][0] if held.any() else -(1 << 63))).toArrow()
    forget(drawn)
    rows = sorted(zip(table["order"].to_pylist(), table["label"].to_pylist(), table["found"].to_pylist()))
    del table
    return fit([np.frombuffer(found, "<i4") for _, _, found in rows], np.array([label == 1 for _, label, _ in rows], bool))


def classify(docs: DataFrame, model: Model, threshold: float = 0.7) -> DataFrame:
    """doc_id, score, predicted for every row of docs (doc_id, text).

    A null or empty text has no features and gets the model's constant; a long text is read whole, in about 40 bytes of memory a character; repeated rows each give a row; a
    null doc_id stays null; an empty table gives an empty table; other columns are ignored.
    """
    held = docs.sparkSession.sparkContext.broadcast(model)

    def predict(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in text_batches(batches):
            scores = [held.value.score(features(x)) for x in batch.column("text").to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(scores, pa.float64())], ["doc_id", "score"])

    scored = docs.select("doc_id", "text").mapInArrow(predict, "doc_id long, score double")
    return scored.withColumn("predicted", (F.col("score") >= threshold).cast("int"))


def score_quality(docs: DataFrame, labels: DataFrame, held_out: Column) -> DataFrame:
    """doc_id, held_out, score, predicted; labels count only where held_out, a condition on doc_id, is false."""
    model = train(docs, labels.where(~held_out))
    return classify(docs, model).select("doc_id", held_out.alias("held_out"), "score", "predicted")
