"""Near-duplicate embeddings: iterative quantisation, multi-index Hamming tables, exact reranking.

A rotation that makes binary codes balanced is learnt on a bounded sample (PCA, then alternating codes and
rotation). Every vector is coded; the code is cut into substrings, and each substring is a table whose
equal values retrieve candidates of the same label. Candidates are reranked by the cosine of the original
vectors in double precision. Equal vectors are one node with a count. A pair is taken only in the first
table that it shares, and what leaves a task is one count per vector and the links that join components,
never all pairs. A crowded bucket is cut into blocks, and each pair of blocks is a task of its own.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from trackloom.llm.common import connected_components, written

KEY = ["label", "width", "tab", "value", "i", "j"]


@dataclass
class Quantiser:
    """Per vector width: rotations whose signs are the code's bits."""

    rotations: dict[int, np.ndarray]
    bits: int
    tables: int

    def substrings(self, x: np.ndarray) -> np.ndarray:
        """(rows, tables) integer values of the code's substrings."""
        width = x.shape[1]
        turn = self.rotations[width] if width in self.rotations else fallback(width, self.bits * self.tables)
        code = (x @ turn > 0)[:, : self.bits * self.tables].reshape(len(x), self.tables, self.bits)
        return (code.astype(np.int64) << np.arange(self.bits)).sum(2).astype(np.int32)


def fallback(width: int, total: int) -> np.ndarray:
    """Random directions for a width that the sample lacks."""
    return np.random.default_rng(width).normal(size=(width, total))


def learn_rotation(x: np.ndarray, total: int, rounds: int = 25) -> np.ndarray:
    """Iterative quantisation: as many rotations, each from another random start, as total bits need.

    The vectors are not centred: cosines are angles at the origin, so the cutting planes pass through it.
    """
    _, vectors = np.linalg.eigh(x.T @ x)
    turns, width = [], x.shape[1]
    for k in range(-(-total // width)):
        v = x @ vectors
        r, _ = np.linalg.qr(np.random.default_rng(k).normal(size=(width, width)))
        for _ in range(rounds):
            u, _, w = np.linalg.svd(np.where(v @ r > 0, 1.0, -1.0).T @ v)
            r = (u @ w).T
        turns.append(vectors @ r)
    return np.hstack(turns)


def fit_quantiser(sample: list[np.ndarray], crowd: int, per_bucket: int = 32, closeness: float = 0.93, certainty: float = 4.0) -> Quantiser:
    """bits of a substring so that a bucket holds about per_bucket of crowd vectors; tables so that a pair at
    cosine closeness shares about `certainty` of them on average, and so is missed with chance exp(-certainty).

    Two codes that differ in fewer bits than there are tables agree on one substring at least (pigeonhole), so buckets
    of equal substrings are the multi-index lookup of that radius. bits grow with the logarithm of the largest label, and tables
    with its 0.18th power, so buckets stay as small at any size.
    """
    bits = max(4, math.ceil(math.log2(max(2, crowd / per_bucket))))
    same = 1 - math.acos(closeness) / math.pi
    tables = math.ceil(certainty / same**bits)
    by: dict[int, list] = {}
    for v in sample:
        by.setdefault(len(v), []).append(v)
    rotations = {}
    for width, rows in by.items():
        x = np.array(rows)
        x /= np.linalg.norm(x, axis=1, keepdims=True)
        rotations[width] = learn_rotation(x, bits * tables)
    return Quantiser(rotations, bits, tables)


def block_links(x: np.ndarray, subs: np.ndarray, count: np.ndarray, block: np.ndarray, tab: int, i: int, j: int, least: float) -> tuple[np.ndarray, np.ndarray]:
    """Of one bucket (or pair of blocks): links of each row, weighted by copies, and the row each is joined to."""
    a = np.flatnonzero(block == i)
    b = np.flatnonzero(block == j)
    close = x[a] @ x[b].T >= least
    for t in range(tab):  # a pair belongs to the first table that it shares
        close &= subs[a, t][:, None] != subs[b, t][None, :]
    links, join = np.zeros(len(x), np.int64), np.arange(len(x))
    if i == j:
        np.fill_diagonal(close, False)
        links[a] += close @ count[b]
    else:
        links[a] += close @ count[b]
        links[b] += close.T @ count[a]
    some = np.flatnonzero(close.any(1))
    todo = set(some.tolist())
    while todo:  # components, by sweeping rows of the matrix
        root = min(todo)
        rows, cols = np.zeros(len(a), bool), np.zeros(len(b), bool)
        rows[root] = True
        while True:
            cols = close[rows].any(0)
            grown = rows | close[:, cols].any(1)
            if i == j:
                grown |= cols
            if (grown == rows).all():
                break
            rows = grown
        join[a[rows]] = a[root]
        join[b[cols]] = a[root]
        todo -= set(np.flatnonzero(rows).tolist())
    return links, join


def near_duplicates(vectors: DataFrame, *, least: float = 0.93, sample: int = 4096, block: int = 512) -> DataFrame:
    """vec_id, n_links, component_id, kept for every row of vectors (vec_id, embedding, label).

    Vectors link within one label and one width. Rows with a null vec_id or label, and vectors that are
    null, empty, zero or hold null or non-finite components, link with nothing: n_links 0, component_id
    the row's own id. Repeated rows count as vectors of their own. An empty table gives an empty table;
    other columns are ignored. sample bounds what the rotation is learnt on; every vector is indexed.
    """
    value = F.col("embedding").cast("array<double>")
    fine = F.forall(value, lambda v: v.isNotNull() & ~F.isnan(v) & (F.abs(v) < float("inf"))) & F.exists(value, lambda v: v != 0)
    usable = F.coalesce(F.col("vec_id").isNotNull() & F.col("label").isNotNull() & fine, F.lit(False))
    node = F.when(usable, F.xxhash64(F.col("label"), F.hash("embedding"), F.col("embedding")))
    rows = vectors.select("vec_id", "label", "embedding").withColumn("node", node)
    nodes = rows.where("node is not null").groupBy("node").agg(F.min("vec_id").alias("first"), F.count("*").alias("n"), F.first("label").alias("label"), F.first("embedding").alias("embedding"))
    nodes = written(nodes.withColumn("width", F.size("embedding")), "nodes")

    crowd = nodes.groupBy("label", "width").count().agg(F.max("count")).first()[0] or 0
    chosen = nodes.select("node", "embedding").orderBy("node").limit(sample).toPandas()
    quantiser = fit_quantiser([np.array(v, float) for v in chosen["embedding"]], crowd, closeness=least)
    held = vectors.sparkSession.sparkContext.broadcast(quantiser)

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for start in range(0, batch.num_rows, 4096):
                part = batch.slice(start, 4096)
                widths = part.column("width").to_numpy()
                flat = part.column("embedding").flatten().to_numpy(zero_copy_only=False).astype(float)
                begin = np.cumsum(widths) - widths
                for w in np.unique(widths):
                    at = np.flatnonzero(widths == w)
                    x = flat[begin[at][:, None] + np.arange(w)]
                    subs = held.value.substrings(x / np.linalg.norm(x, axis=1, keepdims=True))
                    pick = part.take(pa.array(at))
                    values = pa.ListArray.from_arrays(np.arange(len(at) + 1, dtype=np.int32) * subs.shape[1], pa.array(subs.ravel()))
                    yield pa.RecordBatch.from_arrays([*(pick.column(c) for c in ("node", "n", "label", "width", "embedding")), values], ["node", "n", "label", "width", "embedding", "subs"])

    kind = dict(nodes.dtypes)
    fields = f"node long, n long, label {kind['label']}, width int, embedding {kind['embedding']}, subs array<int>"
    coded = written(nodes.select("node", "n", "label", "width", "embedding").mapInArrow(encode, fields), "codes")
    spots = coded.select("*", F.posexplode("subs").alias("tab", "value"))
    crowded = written(coded.select("label", "width", F.posexplode("subs").alias("tab", "value")).groupBy("label", "width", "tab", "value").agg(F.count("*").alias("size")).where(F.col("size") > block), "crowded")
    sized = spots.join(crowded, ["label", "width", "tab", "value"], "left")
    blocks = F.coalesce(F.ceil(F.col("size") / block), F.lit(1)).cast("int")
    placed = sized.withColumn("blocks", blocks).withColumn("own", F.pmod(F.xxhash64("node"), F.col("blocks")).cast("int"))
    pairs = F.transform(F.sequence(F.lit(0), F.col("blocks") - 1), lambda k: F.struct(F.least(k, F.col("own")).alias("i"), F.greatest(k, F.col("own")).alias("j")))
    tasks = placed.select("node", "n", "label", "width", "embedding", "subs", "tab", "value", "own", F.explode(pairs).alias("p")).select("*", "p.i", "p.j").drop("p")

    def link(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def of(table: pa.Table) -> pa.RecordBatch:
            keys = [table.column(c).to_numpy() for c in KEY]
            change = np.ones(table.num_rows, bool)
            change[1:] = np.any([k[1:] != k[:-1] for k in keys], axis=0)
            edges = np.append(np.flatnonzero(change), table.num_rows)
            node, count, own = (table.column(c).to_numpy() for c in ("node", "n", "own"))
            width, subs = keys[1], table.column("subs").combine_chunks().flatten().to_numpy().reshape(table.num_rows, -1)
            flat = table.column("embedding").combine_chunks().flatten().to_numpy()
            begin = np.cumsum(width) - width
            out: list[list] = [[], [], []]
            for s, e in zip(edges[:-1].tolist(), edges[1:].tolist()):
                if e - s < 2:
                    continue
                x = flat[begin[s] : begin[s] + (e - s) * width[s]].astype(float).reshape(e - s, width[s])
                x /= np.linalg.norm(x, axis=1, keepdims=True)
                links, join = block_links(x, subs[s:e], count[s:e], own[s:e], int(keys[2][s]), int(keys[4][s]), int(keys[5][s]), least)
                some = np.flatnonzero(links)
                for o, v in zip(out, (node[s + some], links[some], node[s + join[some]])):
                    o.append(v)
            return pa.RecordBatch.from_arrays([pa.array(np.concatenate([*o, np.zeros(0, np.int64)])) for o in out], ["node", "links", "root"])

        kept: list[pa.RecordBatch] = []
        rows_held = 0
        for batch in batches:
            kept.append(batch)
            rows_held += batch.num_rows
            if rows_held < 30_000:
                continue
            table = pa.Table.from_batches(kept)
            same = np.all([table.column(c).to_numpy() == table.column(c)[-1].as_py() for c in KEY], axis=0)
            cut = int(np.argmax(same))
            if cut:
                yield of(table.slice(0, cut))
            kept = table.slice(cut).to_batches()
            rows_held = table.num_rows - cut
        if kept:
            yield of(pa.Table.from_batches(kept))

    found = written(tasks.repartition(*KEY).sortWithinPartitions(*KEY).mapInArrow(link, "node long, links long, root long"), "links")
    linked = found.groupBy("node").agg(F.sum("links").alias("links"))
    parts = connected_components(found.select(F.col("node").alias("u"), F.col("root").alias("v")))
    named = nodes.select("node", "first", "n").join(parts, "node", "left").join(linked, "node", "left")
    named = written(named.select("node", "first", "n", F.coalesce("component", "node").alias("component"), F.coalesce("links", F.lit(0)).alias("links")), "named")
    smallest = named.groupBy("component").agg(F.min("first").alias("component_id"))
    classes = named.join(smallest, "component").select("node", (F.col("links") + F.col("n") - 1).alias("n_links"), "component_id")
    joined = rows.select("vec_id", "node").join(classes, "node", "left")
    component = F.coalesce("component_id", "vec_id")
    return joined.select("vec_id", F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"), component.alias("component_id"), F.coalesce(F.col("vec_id") == component, F.lit(False)).alias("kept"))
