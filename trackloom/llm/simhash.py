"""SimHash near-duplicates: fingerprints of word shingles, searched through vantage-point trees.

Equal fingerprints are one node. Fingerprints are cut into ranges of bits, and some ranges together are a slice; two
fingerprints that lie close together lie within a small inner radius of each other on one slice at least. On each slice a
vantage-point tree partitions the nodes: every level holds a vantage point sampled from the fingerprints and their
median distance to it, and sends a node to the near side, the far side, or both where the triangle inequality allows
partners on either. The wider the inner radius, the more nodes go to both sides at every level, so their number of
leaves grows with a power of the corpus; slices are chosen so that it is zero for the stated radius, and
the leaves a fingerprint is in are few at any size. The tree deepens with the number of nodes, and its leaves are the
shards that tasks compare. A leaf that near copies crowd is cut into blocks, and each pair of blocks is a task of its own. What
leaves a task are the links of a spanning forest, nearest first: never all pairs of a group.

`near_copies` reaches a stated shingle similarity, where fingerprints differ in so many bits that triangle
bounds prune next to nothing. It samples bits instead: nodes that agree on all bits of a sample share a
leaf, there are as many samples as the chance of a miss asks for, and an exact check of every link on the two
texts' shingle sets follows.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass
from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from trackloom.llm.common import connected_components, forget, text_batches, whole_groups, written

BITS = 64


def shingle_hashes(text: str, words: int, seed: int) -> np.ndarray:
    """XXH64 of the word shingles of a text lower-cased in A-Z, repeats included; none without words."""
    import xxhash

    found = text.encode().lower().split()
    if not found:
        return np.zeros(0, np.uint64)
    joined, ends = b" ".join(found), np.cumsum(np.fromiter(map(len, found), np.int64, len(found)) + 1) - 1
    starts = np.concatenate(([0], ends[:-1] + 1))
    k = min(words, len(found))
    digest = xxhash.xxh64_intdigest
    pairs = zip(starts[: len(found) - k + 1].tolist(), ends[k - 1 :].tolist())
    return np.fromiter((digest(joined[a:b], seed) for a, b in pairs), np.uint64, len(found) - k + 1)


def majority(hashes: np.ndarray) -> int:
    """The bits that more than half of the hashes have set, as a signed 64-bit integer."""
    ones = np.zeros(BITS, np.int64)
    for i in range(0, len(hashes), 1 << 14):
        part = hashes[i : i + (1 << 14)].astype("<u8").view(np.uint8).reshape(-1, 8)
        ones += np.unpackbits(part, axis=1, bitorder="little").sum(0, dtype=np.int64)
    return int(np.packbits(2 * ones > len(hashes), bitorder="little").view("<i8")[0])


def fingerprint(text: str, words: int = 4, seed: int = 42) -> int:
    """SimHash of the word shingles (repeats included) of one text; 0 without words."""
    return majority(shingle_hashes(text, words, seed))


def remixed(hashes: np.ndarray, k: int) -> np.ndarray:
    """Hashes turned into others, as good as independent, for the k-th further fingerprint."""
    h = hashes + np.uint64((0x9E3779B97F4A7C15 * k) & (2**64 - 1))
    h = (h ^ (h >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    h = (h ^ (h >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return h ^ (h >> np.uint64(31))


def codes(text: str, words: int, count: int, seed: int = 42) -> list[int]:
    """count fingerprints of the set of word shingles of one text; zeros without words."""
    hashes = np.unique(shingle_hashes(text, words, seed))
    return [majority(remixed(hashes, k)) for k in range(count)]


def fingerprints(docs: DataFrame, words: int = 4, seed: int = 42) -> DataFrame:
    """doc_id and fp (the 64 bits as a signed long) of every row; null texts count as empty."""

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in text_batches(batches):
            fps = [fingerprint(x or "", words, seed) for x in batch.column("text").to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(fps, pa.int64())], ["doc_id", "fp"])

    return docs.select("doc_id", "text").mapInArrow(encode, "doc_id long, fp long")


@dataclass
class Slice:
    """Some ranges of bits (first, last exclusive) of a code's first word, and their tree: (vantage point, near distance) by level.

    Nodes within inner of each other on these bits share a leaf.
    """

    ranges: list[tuple[int, int]]
    levels: list[tuple[int, int]]
    inner: int = 1

    def values(self, codes: np.ndarray) -> np.ndarray:
        word, out = codes[:, 0].view(np.uint64), np.zeros(len(codes), np.uint64)
        for first, last in self.ranges:
            width = np.uint64(last - first)
            out = (out << width) | (word >> np.uint64(first)) & ((np.uint64(1) << width) - np.uint64(1))
        return out.astype(np.uint32)

    def leaves(self, codes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(position, leaf) of every leaf that a code overlaps."""
        values, at, path = self.values(codes), np.arange(len(codes)), np.zeros(len(codes), np.int64)
        for level in self.levels:
            near, far = side(values[at], level, self.inner)
            at, path = np.concatenate((at[near], at[far])), np.concatenate((path[near] * 2, path[far] * 2 + 1))
        return at, path


@dataclass
class Sample:
    """Some bits of the codes, which name a leaf; of the pairs there, those within inner on the first word are looked at."""

    bits: list[int]
    inner: int

    def values(self, codes: np.ndarray) -> np.ndarray:
        return codes[:, 0].view(np.uint64)

    def leaves(self, codes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(position, leaf) of every code."""
        path = np.zeros(len(codes), np.int64)
        for b in self.bits:
            path = path * 2 + (codes[:, b // BITS] >> (b % BITS) & 1)
        return np.arange(len(codes)), path


def even_slices(each: int, inner: int = 1, together: int = 1) -> list[Slice]:
    """A code's bits in so many ranges, and all choices of so many of these ranges together."""
    edges = [BITS * i // each for i in range(each + 1)]
    return [Slice(list(chosen), [], inner) for chosen in combinations(zip(edges, edges[1:]), together)]


def exact_slices(nodes: int, radius: int, leaf: int) -> list[Slice]:
    """Slices on one of which, at least, two codes within radius are equal, with bits enough to part so many nodes into leaves.

    radius differing bits lie in as many of radius + k ranges at most, so the other k are equal. A node is in one leaf of
    each tree: with radius 4 in 5 leaves up to some millions of nodes, in 15 up to some thousand millions, then in 35.
    """
    k = 1
    while nodes / 2.0 ** (BITS * k / (radius + k)) > leaf and BITS * (k + 1) / (radius + k + 1) <= 32:
        k += 1
    return even_slices(radius + k, 0, k)


def bit_samples(nodes: int, words: int, leaf: int, same: float, miss: float, inner: int) -> list[Sample]:
    """Samples of bits that leave about leaf of so many nodes together, and part a pair that agrees on a bit with
    chance `same` in all of them with chance `miss` at most."""
    size = max(1, math.ceil(math.log2(max(2, nodes / leaf))))
    rng = np.random.default_rng(23)
    count = math.ceil(math.log(miss) / math.log1p(-(same**size)))
    return [Sample(sorted(rng.choice(BITS * words, size, replace=False).tolist()), inner) for _ in range(count)]


def side(values: np.ndarray, level: tuple[int, int], inner: int) -> tuple[np.ndarray, np.ndarray]:
    """Which values go to the near and which to the far side; those that the bounds cannot tell apart go to both.

    Two values within `inner` of each other differ by no more in their distance to the vantage point, so
    they meet on one side.
    """
    far = np.bitwise_count(values ^ np.uint32(level[0]))
    return far <= level[1] + inner, far > level[1]


def together(path: np.ndarray) -> float:
    """How many others of a sample a row meets in its leaf, on average."""
    _, size = np.unique(path, return_counts=True)
    return float((size * (size - 1.0)).sum() / max(1, len(path)))


def grow(piece: Slice, sample: np.ndarray, nodes: int, leaf: int) -> None:
    """Levels of a slice's tree, until a node of so many meets about `leaf` others in its leaves.

    A level takes, of a few sampled points and distances, those that leave the fewest of the sample together, given the levels
    above: not those that halve all nodes best, as values that one level parts badly would stay together.
    """
    inner, values, rng = piece.inner, piece.values(sample), np.random.default_rng(11 + piece.ranges[0][0])
    at, path = np.arange(len(values)), np.zeros(len(values), np.int64)
    met = together(path)
    while met * nodes / max(1, len(values)) > leaf and len(piece.levels) < 56:
        best = None
        for point in rng.choice(values, 4):
            middle = int(np.median(np.bitwise_count(values[at] ^ point)))
            for near in {middle - (inner + 1) // 2, middle - (inner + 1) // 2 - 1, middle - (inner + 1) // 2 + 1}:
                a, b = side(values[at], (int(point), near), inner)
                parted = np.concatenate((path[a] * 2, path[b] * 2 + 1))
                # Fewer rows together, at the price of more rows.
                weight = together(parted) * len(parted)
                if best is None or weight < best[0]:
                    best = (weight, (int(point), near), np.concatenate((at[a], at[b])), parted)
        if together(best[3]) > 0.98 * met:
            break
        piece.levels.append(best[1])
        at, path = best[2:]
        met = together(path)


NONE = np.uint8(255)


def forest(d: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Links of a spanning forest, nearest first (Boruvka's rounds), from a symmetric matrix of distances; NONE is no link."""
    n = len(d)
    label, u, v = np.arange(n), [np.zeros(0, int)], [np.zeros(0, int)]
    while True:
        nearest = d.argmin(1)
        off = d[np.arange(n), nearest]
        order = np.lexsort((np.arange(n), off, label))
        first = order[np.concatenate(([True], label[order][1:] != label[order][:-1]))]
        first = first[off[first] < NONE]
        if not len(first):
            return np.concatenate(u), np.concatenate(v)
        u.append(first)
        v.append(nearest[first])
        for i, j in zip(first.tolist(), nearest[first].tolist()):
            if label[i] != label[j]:
                low, high = sorted((label[i], label[j]))
                label[label == high] = low
        d[label[:, None] == label[None, :]] = NONE


def close_pairs(codes: np.ndarray, values: np.ndarray, own: np.ndarray, i: int, j: int, radius: int, inner: int) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """(position, position, differing bits) of the pairs within radius between blocks i and j of a leaf, some rows at a time."""
    a, b = np.flatnonzero(own == i), np.flatnonzero(own == j)
    for k in range(0, len(a), 256):
        rows = a[k : k + 256]
        x, y = np.nonzero(np.bitwise_count(values[rows][:, None] ^ values[b][None, :]) <= inner)
        x, y = rows[x], b[y]
        if i == j:
            x, y = x[x < y], y[x < y]
        far = np.bitwise_count((codes[x] ^ codes[y]).view(np.uint64)).sum(1, dtype=np.int64)
        yield tuple(z[far <= radius] for z in (x, y, far))


def compare(codes: np.ndarray, values: np.ndarray, own: np.ndarray, i: int, j: int, radius: int, inner: int) -> tuple[np.ndarray, np.ndarray]:
    """Forest of the links within radius between blocks i and j of a leaf."""
    d = np.full((len(codes), len(codes)), NONE)
    for x, y, far in close_pairs(codes, values, own, i, j, radius, inner):
        d[x, y] = d[y, x] = np.minimum(far, 254)
    some = np.flatnonzero((d < NONE).any(1))
    u, v = forest(d[np.ix_(some, some)]) if len(some) else (some, some)
    return some[u], some[v]


KEY = ["tree", "leaf", "i", "j"]


def grown(nodes: DataFrame, slices: list[Slice], leaf: int, sample: int = 1 << 14) -> list[Slice]:
    """Slices with trees for all nodes (node, code). sample bounds the codes that vantage points are drawn from."""
    drawn = nodes.select("code").orderBy(F.xxhash64("node", F.lit("vantage"))).limit(sample).toPandas()
    seen = np.array(drawn["code"].tolist(), np.int64).reshape(len(drawn), -1 if len(drawn) else 1)
    total = nodes.count()
    for piece in slices:
        grow(piece, seen, total, leaf)
    return slices


def placed_nodes(nodes: DataFrame, trees: list[Slice] | list[Sample], words: int, carried: tuple[str, ...] = ()) -> DataFrame:
    """A row (tree, leaf, node, w0 and on: its code, carried columns of longs) for each leaf of each tree that a node overlaps."""
    held = nodes.sparkSession.sparkContext.broadcast(trees)
    names = ["tree", "leaf", "node", *(f"w{k}" for k in range(words)), *carried]

    def spread(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for start in range(0, batch.num_rows, 4096):
                part = batch.slice(start, 4096)
                code = part.column("code").flatten().to_numpy().reshape(part.num_rows, -1)
                others = [part.column(c).to_numpy() for c in ("node", *carried)]
                for k, tree in enumerate(held.value):
                    at, path = tree.leaves(code)
                    own = [pa.array(code[at, w]) for w in range(words)]
                    rest = [pa.array(x[at]) for x in others]
                    yield pa.RecordBatch.from_arrays([pa.array(np.full(len(at), k, np.int32)), pa.array(path), rest[0], *own, *rest[1:]], names)

    fields = "tree int, leaf long, " + ", ".join(f"{n} long" for n in names[2:])
    return nodes.select("node", "code", *carried).mapInArrow(spread, fields)


def leaf_tasks(placed: DataFrame, crowded: DataFrame) -> DataFrame:
    """placed (a written table) with own (a node's block of its leaf) and i, j: one row for each pair of blocks that a node's block is in."""
    rest = placed.columns[2:]
    cut = placed.join(crowded, ["tree", "leaf"], "left").withColumn("blocks", F.coalesce("blocks", F.lit(1)))
    cut = cut.withColumn("own", F.pmod(F.xxhash64("node"), F.col("blocks")).cast("int"))
    others = F.transform(F.sequence(F.lit(0), F.col("blocks") - 1), lambda k: F.struct(F.least(k, F.col("own")).alias("i"), F.greatest(k, F.col("own")).alias("j")))
    return cut.select("tree", "leaf", "own", *rest, F.explode(others).alias("p")).select("tree", "leaf", "p.i", "p.j", "own", *rest)


def crowded_leaves(placed: DataFrame, leaf: int) -> DataFrame:
    """tree, leaf and blocks of the leaves with more than four times `leaf` nodes."""
    sizes = placed.groupBy("tree", "leaf").agg(F.count("*").alias("size")).where(F.col("size") > 4 * leaf)
    return sizes.select("tree", "leaf", F.ceil(F.col("size") / (2 * leaf)).cast("int").alias("blocks"))


def each_task(batches: Iterator[pa.RecordBatch], words: int, rows: int = 1 << 17) -> Iterator[tuple[pa.Table, int, int, int, np.ndarray, np.ndarray]]:
    """(rows, tree, i, j, codes, own) of each pair of blocks, from rows sorted by KEY."""
    for table in whole_groups(batches, KEY, rows):
        keys = [table.column(c).to_numpy() for c in KEY]
        change = np.ones(table.num_rows, bool)
        change[1:] = np.any([k[1:] != k[:-1] for k in keys], axis=0)
        edges = np.append(np.flatnonzero(change), table.num_rows)
        own = table.column("own").to_numpy()
        code = np.column_stack([table.column(f"w{k}").to_numpy() for k in range(words)])
        for s, e in zip(edges[:-1].tolist(), edges[1:].tolist()):
            if e - s > 1:
                yield table.slice(s, e - s), int(keys[0][s]), int(keys[2][s]), int(keys[3][s]), code[s:e], own[s:e]


def links_of(u: list[np.ndarray], v: list[np.ndarray]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(np.concatenate([np.zeros(0, np.int64), *x])) for x in (u, v)], ["u", "v"])


def tree_links(nodes: DataFrame, trees: list[Slice] | list[Sample], radius: int, *, words: int = 1, leaf: int = 1024) -> DataFrame:
    """Links (u, v) between nodes (node, code: array of so many longs) at `radius` differing bits or fewer, for all pairs that
    share a leaf and lie within inner there: of each leaf a spanning forest, so links join all that those pairs connect.

    node is distinct and not null. leaf is the number of nodes that a leaf should hold; one of more than four
    times that is cut into blocks.
    """
    held = nodes.sparkSession.sparkContext.broadcast(trees)
    placed = written(placed_nodes(nodes, trees, words), "placed")
    crowded = written(crowded_leaves(placed, leaf), "crowded")

    def link(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows, tree, i, j, code, own in each_task(batches, words):
            x, y = compare(code, held.value[tree].values(code), own, i, j, radius, held.value[tree].inner)
            node = rows.column("node").to_numpy()
            yield links_of([node[x]], [node[y]])

    found = leaf_tasks(placed, crowded).repartition(*KEY).sortWithinPartitions(*KEY).mapInArrow(link, "u long, v long")
    links = written(found.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct(), "links")
    forget(placed, crowded)
    return links


def disputed(nodes: DataFrame, trees: list[Slice] | list[Sample], radius: int, *, words: int = 1, leaf: int = 1024) -> DataFrame:
    """Rows of leaf_tasks of those nodes (node, code, label) that lie within radius of one with another label there.

    What leaves a task is a row a node, not the pairs.
    """
    held = nodes.sparkSession.sparkContext.broadcast(trees)
    placed = written(placed_nodes(nodes, trees, words, ("label",)), "placed")
    crowded = written(crowded_leaves(placed, leaf), "crowded")
    tasks = leaf_tasks(placed, crowded)

    def pick(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows, tree, i, j, code, own in each_task(batches, words):
            label, met = rows.column("label").to_numpy(), np.zeros(len(code), bool)
            for x, y, _ in close_pairs(code, held.value[tree].values(code), own, i, j, radius, held.value[tree].inner):
                other = label[x] != label[y]
                met[x[other]] = met[y[other]] = True
            yield from rows.filter(pa.array(met)).to_batches()

    found = written(tasks.repartition(*KEY).sortWithinPartitions(*KEY).mapInArrow(pick, tasks.schema), "disputed")
    forget(placed, crowded)
    return found


def root(parents: dict[int, int], label: int) -> int:
    while parents.setdefault(label, label) != label:
        parents[label] = label = parents[parents[label]]
    return label


def settled(open_rows: DataFrame, sets: DataFrame, trees: list[Slice] | list[Sample], radius: int, least: float, *, words: int = 1) -> DataFrame:
    """Links (u, v) that join what disputed rows left apart: pairs within radius whose sets (node, hashes: sorted, distinct) have a
    Jaccard similarity of `least` or more. Of each pair of blocks a spanning forest over labels leaves the task."""
    held = open_rows.sparkSession.sparkContext.broadcast(trees)

    def judge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows, tree, i, j, code, own in each_task(batches, words, 1 << 12):
            node, label = rows.column("node").to_numpy(), rows.column("label").to_numpy()
            hashes = rows.column("hashes").combine_chunks()
            flat, offsets = hashes.values.to_numpy(), hashes.offsets.to_numpy()
            sets_ = [flat[a:b] for a, b in zip(offsets[:-1], offsets[1:])]
            parents: dict[int, int] = {}
            u, v = [], []
            for x, y, far in close_pairs(code, held.value[tree].values(code), own, i, j, radius, held.value[tree].inner):
                for k in np.argsort(far, kind="stable").tolist():
                    p, q = int(x[k]), int(y[k])
                    one, two = root(parents, int(label[p])), root(parents, int(label[q]))
                    if one != two and jaccard(sets_[p], sets_[q], least):
                        parents[one] = two
                        u.append(node[p : p + 1])
                        v.append(node[q : q + 1])
            yield links_of(u, v)

    tasks = open_rows.join(sets, "node").repartition(*KEY).sortWithinPartitions(*KEY)
    found = tasks.mapInArrow(judge, "u long, v long")
    return written(found.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct(), "settled")


def near_duplicates(docs: DataFrame, *, words: int = 4, seed: int = 42, radius: int = 4, leaf: int = 1024) -> DataFrame:
    """doc_id, fingerprint (16 hex digits) and component_id (smallest doc_id reachable) of every row.

    Fingerprints within radius are linked, exactly: see exact_slices. Null and empty texts, and texts without words, have fingerprint zero and link like any other. A row
    with a null doc_id is fingerprinted but names no component: its component_id is that of the others,
    or null if it has none. Repeated rows each give a row. An empty table gives an empty table. Further
    columns are ignored. A long text is hashed whole, at about 30 bytes of memory a word.
    """
    prints = written(fingerprints(docs, words, seed), "prints")
    nodes = written(prints.groupBy("fp").agg(F.min("doc_id").alias("first")), "nodes")
    coded = nodes.select(F.col("fp").alias("node"), F.array("fp").alias("code"))
    links = tree_links(coded, grown(coded, exact_slices(nodes.count(), radius, leaf), leaf), radius, leaf=leaf)
    parts = connected_components(links)
    named = nodes.join(parts, nodes.fp == parts.node, "left").select("fp", "first", F.coalesce("component", "fp").alias("component"))
    named = written(named, "named")
    forget(nodes, links)
    smallest = named.groupBy("component").agg(F.min("first").alias("component_id"))
    classes = named.join(smallest, "component").select("fp", "component_id")
    return prints.join(classes, "fp").select("doc_id", F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), "component_id")


def shingle_set(text: str, words: int) -> set[bytes]:
    found = text.encode().lower().split()
    k = min(words, len(found))
    return {b" ".join(found[i : i + k]) for i in range(len(found) - k + 1)} if found else set()


def similarity(a: str, b: str, words: int) -> float:
    """Jaccard similarity of the word shingle sets of two texts; 1 if both have none."""
    x, y = shingle_set(a, words), shingle_set(b, words)
    both = len(x & y)
    return both / (len(x) + len(y) - both) if x or y else 1.0


def jaccard(a: np.ndarray, b: np.ndarray, least: float) -> bool:
    """Whether two sorted arrays of distinct values have this similarity; two empty ones have."""
    if min(len(a), len(b)) < least * max(len(a), len(b)):
        return False
    both = len(np.intersect1d(a, b, assume_unique=True))
    return both >= least * (len(a) + len(b) - both)


def apart(least: float, bits: int, deviations: float = 3.5) -> int:
    """Differing bits that a pair of shingle sets of equal sizes at this Jaccard similarity stays within, but for chance."""
    p = math.acos(2 * least / (1 + least)) / math.pi
    return math.ceil(bits * p + deviations * math.sqrt(bits * p * (1 - p)))


def near_copies(docs: DataFrame, *, words: int = 5, least: float = 0.8, miss: float = 0.005, count: int = 3, leaf: int = 1024) -> DataFrame:
    """doc_id, row (hash of the text) and component_id of every row of docs (doc_id, text): components of pairs whose
    word shingle sets have a Jaccard similarity of `least` or more.

    count fingerprints of 64 bits a text: a pair at the least similarity is missed with chance `miss`, closer
    pairs more seldom. Links are checked on the whole texts before they count. First come the forests that are nearest by
    fingerprint; since a link of theirs may fail where a farther pair would not, what they leave apart is looked at
    again: every node within reach of one of another component brings its hashed shingles to the leaf, where all such
    pairs are checked. Texts with equal codes are copies. Texts without
    words (null, empty) are copies of each other. component_id is the smallest doc_id reachable; a row with a
    null doc_id names no component and gets null. Repeated rows each give a row, an empty table gives an
    empty table, other columns are ignored.
    """

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in text_batches(batches):
            found = [codes(x or "", words, count) for x in batch.column("text").to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("row"), pa.array(found, pa.list_(pa.int64()))], ["doc_id", "row", "code"])

    own = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text")).withColumn("row", F.xxhash64("text"))
    prints = written(own.mapInArrow(encode, "doc_id long, row long, code array<long>").withColumn("node", F.xxhash64("code")), "prints")
    one = F.min(F.struct(F.col("doc_id").isNull().alias("missing"), "doc_id", "row"))
    nodes = written(prints.groupBy("node").agg(F.first("code").alias("code"), one.alias("one")).select("node", "code", F.col("one.doc_id").alias("first"), F.col("one.row").alias("row")), "nodes")
    trees = bit_samples(nodes.count(), count, leaf, 1 - math.acos(2 * least / (1 + least)) / math.pi, miss, apart(least, BITS))
    reach = apart(least, BITS * count)
    links = tree_links(nodes.select("node", "code"), trees, reach, words=count, leaf=leaf)

    def texts_of(wanted: DataFrame) -> DataFrame:
        """node and the text of one row of each of these nodes."""
        ones = nodes.join(wanted, "node", "left_semi").select("node", F.col("first").alias("w_id"), F.col("row").alias("w_row"))
        return own.join(ones, F.col("doc_id").eqNullSafe(F.col("w_id")) & (F.col("row") == F.col("w_row"))).select("node", "text").dropDuplicates(["node"])

    linked = links.select(F.col("u").alias("node")).unionByName(links.select(F.col("v").alias("node"))).distinct()
    texts = written(texts_of(linked), "texts")

    def check(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in text_batches(batches, column="a"):
            good = [similarity(a, b, words) >= least for a, b in zip(batch.column("a").to_pylist(), batch.column("b").to_pylist())]
            yield batch.select(["u", "v"]).filter(pa.array(good, pa.bool_()))

    def hashed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in text_batches(batches):
            found = [np.unique(shingle_hashes(x, words, 42)).view(np.int64) for x in batch.column("text").to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column("node"), pa.array(found, pa.list_(pa.int64()))], ["node", "hashes"])

    pairs = links.join(texts.select(F.col("node").alias("u"), F.col("text").alias("a")), "u").join(texts.select(F.col("node").alias("v"), F.col("text").alias("b")), "v")
    sure = written(pairs.select("u", "v", "a", "b").mapInArrow(check, "u long, v long"), "sure")
    forget(links, texts)
    parts = connected_components(sure)
    labelled = written(nodes.join(parts, "node", "left").select("node", "code", F.coalesce("component", "node").alias("label")), "labelled")
    open_rows = disputed(labelled, trees, reach, words=count, leaf=leaf)
    sets = written(texts_of(open_rows.select("node").distinct()).mapInArrow(hashed, "node long, hashes array<long>"), "sets")
    more = settled(open_rows, sets, trees, reach, least, words=count)
    forget(open_rows, sets, labelled)
    parts = connected_components(sure.unionByName(more))
    named = nodes.join(parts, "node", "left").select("node", "first", F.coalesce("component", "node").alias("component"))
    smallest = named.groupBy("component").agg(F.min("first").alias("component_id"))
    classes = written(named.join(smallest, "component").select("node", "component_id"), "classes")
    forget(nodes, sure, more)
    return prints.join(classes, "node").select("doc_id", "row", F.when(F.col("doc_id").isNotNull(), F.col("component_id")).alias("component_id"))
