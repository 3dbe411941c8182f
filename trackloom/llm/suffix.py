"""Removal of byte strings that repeat anywhere in the corpus, by suffix structures over content shards.

Every string of the least length has one anchor: the smallest hash among its grams. Strings with one
anchor stand in a row (a run), and equal strings have equal anchors at equal places, so runs that share an
anchor's hash hold all that can match: an anchor is a shard. Anchors that occur once are dropped; of the
others, equal runs enter once, with their count. Each task joins the runs of its shards into a text, sorts
its suffixes, and takes the Burrows-Wheeler transform through breadth-first backward extension, some symbols
at a time: common prefixes come out by increasing value, and the expansion stops at the least length.
Suffixes that got no value by then share that length with a neighbour. Every verdict on a string comes from
there and goes back to all runs with the same bytes. A shard that is too large for a task (a passage in a
large part of all documents) is cut into parts by the distance to the anchor, and these by the bytes that
all strings of a part share; what is still too large is cut finer.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from trackloom.llm.common import forget, text_batches, written

GRAM = 40
_u = np.uint64
_random = np.random.default_rng(2024)
BYTE = _random.integers(1, 2**63, 256, dtype=np.uint64) | _u(1)
STEP = _random.integers(1, 2**63, 8, dtype=np.uint64) | _u(1)
BASE = 0x9E3779B97F4A7C15
POSITION = _u((1 << 28) - 1)
#: Bytes of a text that are looked at together; longer ones are taken in turn, overlapping.
SEGMENT = 1 << 20
#: A byte that no UTF-8 text holds ends each piece.
END = 0xFF
_powers: dict[int, tuple[np.ndarray, np.ndarray]] = {}


def powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """BASE and its inverse to the powers 0, 1, ... (modulo 2^64), at least n of each."""
    size = 1 << max(12, int(n).bit_length())
    if size not in _powers:
        _powers.clear()
        out = []
        for b in (BASE, pow(BASE, -1, 1 << 64)):
            p = np.full(size, b, np.uint64)
            p[0] = 1
            out.append(np.cumprod(p, dtype=np.uint64))
        _powers[size] = (out[0], out[1])
    return _powers[size]


def mixed(x: np.ndarray) -> np.ndarray:
    x = x ^ (x >> _u(31))
    x *= _u(0xD6E8FEB86659FD93)
    x ^= x >> _u(29)
    return x


class Hashes:
    """Rolling content hashes of a byte array."""

    def __init__(self, data: np.ndarray):
        h = BYTE[data]
        for k in range(3):
            h = h[: -(1 << k)] * STEP[k] + h[1 << k :]
        self.eight = h
        e = mixed(h)
        up, self.down = powers(len(data) + 1)
        self.prefix = np.zeros(len(e) + 1, np.uint64)
        np.cumsum(e * up[: len(e)], out=self.prefix[1:])

    def grams(self) -> np.ndarray:
        """Hashes of all strings of GRAM bytes."""
        h = self.eight
        for k in range(3, 5):
            h = h[: -(1 << k)] * STEP[k] + h[1 << k :]
        return mixed(h[: len(h) - 8] * STEP[6] + self.eight[32:])

    def of(self, start: np.ndarray, end: np.ndarray) -> np.ndarray:
        """Hashes of the strings [start, end), each at least 8 bytes long."""
        h = (self.prefix[end - 7] - self.prefix[start]) * self.down[start]
        return mixed(h ^ (end - start).astype(np.uint64) * _u(0xC2B2AE3D27D4EB4F))


def runs(texts: list[bytes], least: int) -> tuple[np.ndarray, ...]:
    """Runs of all texts: owner, packed place in it (see place()), anchor's hash, content hash."""
    lengths = np.array([len(t) for t in texts], np.int64)
    data = np.frombuffer(b"".join(texts), np.uint8)
    n = len(data) - least + 1
    if n <= 0 or lengths.max() < least:
        return tuple(np.zeros(0, t) for t in (np.int64, np.int64, np.uint64, np.uint64))
    hashes = Hashes(data)
    grams = hashes.grams()
    low = (grams & ~POSITION) | np.arange(len(grams), dtype=np.uint64)
    wide, have = least - GRAM + 1, 1
    while 2 * have <= wide:
        low = np.minimum(low[:-have], low[have:])
        have *= 2
    if wide > have:
        low = np.minimum(low[: have - wide], low[wide - have :])
    anchor = (low & POSITION).astype(np.int64)
    ends = np.cumsum(lengths)
    whole = np.arange(n) + least <= np.repeat(ends, lengths)[:n]
    change = np.flatnonzero(np.concatenate(([True], (anchor[1:] != anchor[:-1]) | (whole[1:] != whole[:-1]))))
    count = np.diff(np.append(change, n))
    keep = whole[change]
    start, count = change[keep], count[keep]
    owner = np.searchsorted(ends, start, side="right")
    place = (start - (ends - lengths)[owner]) << 24 | (anchor[start] - start) << 12 | (count - 1)
    return owner, place, grams[anchor[start]], hashes.of(start, start + count + least - 1)


def unpacked(place: int) -> tuple[int, int, int]:
    """Start of a run, distance from there to its anchor, number of its strings."""
    return place >> 24, place >> 12 & 4095, (place & 4095) + 1


def packed(v: np.ndarray, width: int) -> np.ndarray:
    """width bytes from each position of a cyclic text on, as one number."""
    key = np.zeros(len(v), np.uint64)
    for k in range(width):
        key = key << _u(8) | np.roll(v, -k)
    return key


def sorted_places(key: np.ndarray, bits: int) -> np.ndarray:
    """Positions of keys of so many bits in ascending order; sorting key and position as one number is the faster way."""
    wide = int(len(key)).bit_length()
    if bits + wide > 64:
        return np.argsort(key)
    both = key.astype(np.uint64) << _u(wide) | np.arange(len(key), dtype=np.uint64)
    both.sort()
    return (both & _u((1 << wide) - 1)).astype(np.int64)


def suffix_order(v: np.ndarray, depth: int) -> np.ndarray:
    """Positions of a cyclic text of bytes, sorted by at least depth leading bytes (prefix doubling)."""
    n = len(v)
    used = np.bincount(v, minlength=256) > 0
    wide, each = int(n).bit_length(), max(1, int(used.sum() - 1).bit_length())
    have = (64 - wide) // each
    code = (np.cumsum(used) - 1).astype(np.uint64)[v]
    key, bits = np.zeros(n, np.uint64), have * each
    for k in range(have):
        key = key << _u(each) | np.roll(code, -k)
    while True:
        order = sorted_places(key, bits)
        rank = np.empty(n, np.int64)
        ordered = key[order]
        rank[order] = np.cumsum(np.concatenate(([0], ordered[1:] != ordered[:-1])))
        if have >= depth or rank[order[-1]] == n - 1:
            return order
        key, bits = rank << wide | np.roll(rank, -have), 2 * wide
        have *= 2


def common_prefixes(v: np.ndarray, order: np.ndarray, least: int) -> np.ndarray:
    """Common prefix of each sorted suffix with the one before it, in whole steps; -1 stands for least or more.

    Backward extension of intervals, breadth first (Beller et al., 2013), by a step of several bytes (the
    largest of 8, 4, 2, 1 that divides least): a round of depth d extends the intervals found in the round
    before by every step that precedes them, and gives the right ends that have no value yet the value d.
    """
    n, step = len(v), min(8, least & -least)
    wide = int(n).bit_length()
    rank = np.empty(n, np.int64)
    rank[order] = np.arange(n)
    before = np.roll(packed(v, step), step)[order]  # the step that precedes each sorted suffix
    forward = np.roll(rank, step)[order]  # where the suffix longer by it stands
    value = np.full(n + 1, -1, np.int32)
    value[0] = value[n] = 0
    left, right = np.array([0]), np.array([n])
    for depth in range(0, least, step):
        size = right - left
        inner = np.repeat(left - (np.cumsum(size) - size), size) + np.arange(size.sum())
        which = np.repeat(np.arange(len(size)), size)
        at = sorted_places(forward[inner], wide)
        place, symbol, which = forward[inner][at], before[inner][at], which[at]
        last = np.flatnonzero(np.concatenate(((symbol[1:] != symbol[:-1]) | (which[1:] != which[:-1]), [True])))
        first = np.concatenate(([0], last[:-1] + 1))
        left, right = place[first], place[last] + 1
        new = (value[right] == -1) | ((depth == 0) & (right == n))
        left, right = left[new], right[new]
        value[right] = np.where(right == n, 0, depth)
        if not len(left):
            break
    return value


def repeated_starts(pieces: list[bytes], copies: list[int], least: int) -> list[np.ndarray]:
    """For each piece, which of its strings of the least length start more than once in the pieces, each of which counts copies times."""
    sizes = np.array([len(p) + 1 for p in pieces])
    end = bytes([END])
    v = np.frombuffer(end.join(pieces) + end, np.uint8)
    order = suffix_order(v, least)
    long = common_prefixes(v, order, least) == -1
    again = np.zeros(len(v), bool)
    again[order] = long[:-1] | long[1:]
    again |= np.repeat(np.array(copies) > 1, sizes)
    begin = np.cumsum(sizes) - sizes
    return [again[b : b + s - least] for b, s in zip(begin.tolist(), sizes.tolist())]


def true_spans(flags: np.ndarray) -> list[tuple[int, int]]:
    """(first, number) of each maximal run of true flags."""
    edge = np.flatnonzero(np.diff(np.concatenate(([0], flags.astype(np.int8), [0]))))
    return list(zip(edge[::2].tolist(), (edge[1::2] - edge[::2]).tolist()))


def repeated_spans(docs: DataFrame, least: int = 200, *, most: int = 400, chunk: int = 1 << 17) -> DataFrame:
    """For docs (id, row, text): id, row, first, number: starts of strings of least bytes that repeat, once for equal rows.

    id and row are not null and name a row's content; rows with equal id and row are equal. most is the
    number of different runs in a shard that a task takes; chunk the bytes of shards taken together.
    """
    assert 2 * GRAM <= least < 4096

    def emit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in text_batches(batches, 1 << 19):
            for texts, rows, base in segments(batch.column("text").to_pylist(), least):
                owner, place, key, content = runs(texts, least)
                at = pa.array(rows[owner])
                place = place + (base[owner] << 24)
                yield pa.RecordBatch.from_arrays([pa.array(key.view(np.int64)), pa.array(content.view(np.int64)), batch.column("id").take(at), batch.column("row").take(at), pa.array(place)], ["shard", "content", "id", "row", "span"])

    found = docs.select("id", "row", "text").mapInArrow(emit, "shard long, content long, id long, row long, span long")
    found = written(found, "runs")
    counts = written(found.groupBy("shard", "content").agg(F.count("*").alias("copies")), "counts")
    shards = counts.groupBy("shard").agg(F.sum("copies").alias("uses"), F.count("*").alias("kinds")).where("uses > 1").select("shard", "kinds")
    matched = written(found.join(counts.join(shards, "shard"), ["shard", "content"]), "matched")
    forget(found, counts)

    kinds = matched.groupBy("shard", "content").agg(F.max("copies").alias("copies"), F.max("kinds").alias("kinds"), F.min(F.struct("id", "row", "span")).alias("one"))
    wanted = kinds.groupBy(F.col("one.id").alias("id"), F.col("one.row").alias("row")).agg(F.collect_list(F.struct("shard", "content", "copies", "kinds", "one.span")).alias("wanted"))
    sources = docs.select("id", "row", "text").join(wanted, ["id", "row"])

    def fetch(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in text_batches(batches, 1 << 19):
            rows = []
            for text, want in zip(batch.column("text").to_pylist(), batch.column("wanted").to_pylist()):
                raw = text.encode()
                for w in want:
                    a, ahead, n = unpacked(w["span"])
                    rows.append((w["shard"], w["content"], w["copies"], w["kinds"], ahead, raw[a : a + n + least - 1]))
            columns = list(zip(*rows)) if rows else [()] * 6
            types = (*[pa.int64()] * 5, pa.binary())
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, types)], ["shard", "content", "copies", "kinds", "ahead", "bytes"])

    pieces = written(sources.mapInArrow(fetch, PIECE), "pieces")
    verdicts = written(judged(pieces, least, most, chunk, (least - GRAM + 4) // 4), "verdicts")
    forget(pieces)
    spans = matched.select("shard", "content", "id", "row", F.shiftrightunsigned("span", 24).alias("start")).join(verdicts, ["shard", "content"])
    return spans.select("id", "row", (F.col("start") + F.col("first")).alias("first"), "number")


#: Different runs of a shard: copies of it in the corpus, kinds in its shard, distance from its first string to the anchor.
PIECE = "shard long, content long, copies long, kinds long, ahead long, bytes binary"


def segments(texts: list[str | None], least: int) -> Iterator[tuple[list[bytes], np.ndarray, np.ndarray]]:
    """Texts of up to SEGMENT bytes at once, with each one's row and place in it; every string of least bytes is in one of them, once."""
    held, rows, base, size = [], [], [], 0
    for i, text in enumerate(texts):
        raw = (text or "").encode()
        for a in range(0, max(1, len(raw) - least + 1), SEGMENT):
            if size and size + len(raw) - a > SEGMENT:
                yield held, np.array(rows), np.array(base)
                held, rows, base, size = [], [], [], 0
            held.append(raw[a : a + SEGMENT + least - 1])
            rows.append(i)
            base.append(a)
            size += len(held[-1])
    if held:
        yield held, np.array(rows), np.array(base)


def judged(pieces: DataFrame, least: int, most: int, chunk: int, width: int) -> DataFrame:
    """shard, content, first, number of the strings of pieces (see PIECE) that repeat, by expansion within shards.

    Shards of more than most pieces are cut: into parts of width strings at fixed distances from the anchor,
    so that equal strings are in parts of one place, and by the bytes that all strings of a part hold. At a
    width of one a part is a string, and pieces of a shard are equal; so cutting ends.
    """

    def expand(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def of(rows: list[tuple]) -> pa.RecordBatch:
            flags = repeated_starts([r[3] for r in rows], [r[2] for r in rows], least)
            out = [(r[0], r[1], a, n) for r, f in zip(rows, flags) for a, n in true_spans(f)]
            columns = list(zip(*out)) if out else [()] * 4
            return pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in columns], ["shard", "content", "first", "number"])

        held: list[tuple] = []
        size = 0
        for batch in batches:
            for r in zip(*(batch.column(c).to_pylist() for c in ("shard", "content", "copies", "bytes"))):
                if size >= chunk and r[0] != held[-1][0]:
                    yield of(held)
                    held, size = [], 0
                held.append(r)
                size += len(r[3])
        if held:
            yield of(held)

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for shard, content, copies, ahead, raw in zip(*(batch.column(c).to_pylist() for c in ("shard", "content", "copies", "ahead", "bytes"))):
                hashes, n = Hashes(np.frombuffer(raw, np.uint8)), len(raw) - least + 1
                spot = (ahead - np.arange(n)) // width  # by the distance from each string's start to the anchor
                a = np.flatnonzero(np.concatenate(([True], spot[1:] != spot[:-1])))
                b = np.append(a[1:], n)
                middle = ahead - spot[a] * width  # where the last string of a whole part would start
                core = hashes.of(middle, middle + least - width + 1)
                place = mixed(core + spot[a].astype(np.uint64) * _u(BASE) + _u(shard % (1 << 64))).view(np.int64)
                whole = hashes.of(a, b + least - 1).view(np.int64)
                rows += [(int(k), int(w), copies, shard, content, i, ahead - i, raw[i : j + least - 1]) for k, w, i, j in zip(place, whole, a.tolist(), b.tolist())]
            columns = list(zip(*rows)) if rows else [()] * 8
            types = (*[pa.int64()] * 7, pa.binary())
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, types)], ["shard", "content", "copies", "of", "whole", "start", "ahead", "bytes"])

    few = pieces.where(F.col("kinds") <= most).select("shard", "content", "copies", "bytes")
    plain = few.repartition("shard").sortWithinPartitions("shard").mapInArrow(expand, "shard long, content long, first long, number long")
    if not pieces.where(F.col("kinds") > most).limit(1).count():
        return plain
    large = pieces.where(F.col("kinds") > most).select("shard", "content", "copies", "ahead", "bytes")
    parts = written(large.mapInArrow(cut, "shard long, content long, copies long, of long, whole long, start long, ahead long, bytes binary"), "parts")
    kinds = parts.groupBy("shard", "content").agg(F.sum("copies").alias("copies"), F.first(F.struct("ahead", "bytes")).alias("one"))
    kinds = written(kinds.select("shard", "content", "copies", "one.ahead", "one.bytes"), "kinds")
    live = kinds.groupBy("shard").agg(F.sum("copies").alias("uses"), F.count("*").alias("kinds")).where("uses > 1").select("shard", "kinds")
    finer = written(judged(kinds.join(live, "shard").select("shard", "content", "copies", "kinds", "ahead", "bytes"), least, most, chunk, max(1, width // 4)), "verdicts")
    back = parts.select("shard", "content", "of", "whole", "start").join(finer, ["shard", "content"])
    return plain.unionByName(back.select(F.col("of").alias("shard"), F.col("whole").alias("content"), (F.col("start") + F.col("first")).alias("first"), "number"))


def covered(spans: list[dict], least: int) -> list[tuple[int, int]]:
    """Maximal (start, end) that strings of least bytes cover, for spans of their starts."""
    out: list[tuple[int, int]] = []
    for s in sorted(spans, key=lambda s: s["first"]):
        a, b = s["first"], s["first"] + s["number"] + least - 1
        if out and a <= out[-1][1]:
            out[-1] = (out[-1][0], max(b, out[-1][1]))
        else:
            out.append((a, b))
    return out


def remove_repeats(docs: DataFrame, least: int = 200, *, as_text: bool = False) -> DataFrame:
    """Every row of docs (doc_id, text and any other columns) with kept (bytes left), n_bytes, n_removed, n_spans.

    as_text: kept is text, without the parts of characters that a cut left.

    A byte goes if a string of least bytes covers it that also starts anywhere else in the table, in the same
    text too; strings are judged on the input. A null text is empty. Repeated rows count as documents of
    their own, so each loses what both hold. A null doc_id is an id like any other. An empty table gives an
    empty table. A column that has one of the new names is replaced.
    """
    new = ["kept", "n_bytes", "n_removed", "n_spans"]
    source = docs.drop(*new)
    names = {c: f"c{i}" for i, c in enumerate(source.columns)}
    own = source.select(*(F.col(f"`{c}`").alias(n) for c, n in names.items()))
    id_, text = F.col(names["doc_id"]), F.coalesce(F.col(names["text"]), F.lit(""))
    keyed = own.withColumn("id", F.coalesce(id_.cast("long"), F.lit(-(1 << 62)))).withColumn("row", F.xxhash64(id_.cast("string"), text))
    spans = repeated_spans(keyed.select("id", "row", text.alias("text")), least)
    # Equal rows share their spans, which each of them found.
    listed = spans.groupBy("id", "row").agg(F.collect_set(F.struct("first", "number")).alias("spans"))
    joined = keyed.join(listed, ["id", "row"], "left").drop("id", "row")

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at = names["text"]
        for batch in text_batches(batches, 1 << 20, at):
            kept, numbers = [], []
            spans_of = batch.column("spans")
            for i, raw in enumerate(batch.column(at).to_pylist()):
                data = (raw or "").encode()
                gone = covered(spans_of[i].as_py() or [], least)
                edges = [0, *(x for span in gone for x in span), len(data)]
                kept.append(b"".join(data[a:b] for a, b in zip(edges[::2], edges[1::2])))
                numbers.append((len(data), sum(b - a for a, b in gone), len(gone)))
            left = pa.array([k.decode("utf-8", "ignore") for k in kept], pa.string()) if as_text else pa.array(kept, pa.binary())
            columns = [left, *(pa.array([n[k] for n in numbers], pa.int64()) for k in range(3))]
            rest = [batch.column(n) for n in names.values()]
            yield pa.RecordBatch.from_arrays([*rest, *columns], [*names.values(), *new])

    fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in own.schema)
    done = joined.mapInArrow(cut, f"{fields}, kept {'string' if as_text else 'binary'}, n_bytes long, n_removed long, n_spans long")
    return done.select(*(F.col(n).alias(c) for c, n in names.items()), *new)
