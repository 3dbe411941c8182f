"""What the corpus operators share: written intermediate tables, hashes and connected components."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from trackloom.shared import _forget, forget, shared_folder, written  # noqa: F401

#: One word of a text: a run of anything but ASCII white space.
WORD = r"[^\x20\x09-\x0D]+"


def id_remainder(column: Column, modulus: int) -> Column:
    """crc32 of an id written as text, modulo modulus; a null id counts as empty text."""
    return F.crc32(F.coalesce(column.cast("string"), F.lit("")).cast("binary")) % modulus


def text_batches(batches: Iterator[pa.RecordBatch], max_bytes: int = 8 << 20, column: str = "text") -> Iterator[pa.RecordBatch]:
    """Arrow batches cut so that a text column holds about max_bytes at most (or one row)."""
    for batch in batches:
        texts = batch.column(batch.schema.get_field_index(column))
        start, size = 0, 0
        for i, length in enumerate(pc.binary_length(texts).to_pylist()):
            if size and size + (length or 0) > max_bytes:
                yield batch.slice(start, i - start)
                start, size = i, 0
            size += length or 0
        if start < batch.num_rows:
            yield batch.slice(start)


def whole_groups(batches: Iterator[pa.RecordBatch], keys: list[str], rows: int) -> Iterator[pa.Table]:
    """Tables of about so many rows, or one group, cut where a key changes; the batches are sorted by their keys."""
    kept: list[pa.RecordBatch] = []
    held = 0
    for batch in batches:
        kept.append(batch)
        held += batch.num_rows
        if held < rows:
            continue
        table = pa.Table.from_batches(kept)
        same = pa.array([True] * held)
        for key in keys:
            column = table.column(key)
            same = pc.and_(same, pc.equal(column, column[-1]))
        open_from = pc.index(same, True).as_py()
        if open_from:
            yield table.slice(0, open_from)
        kept = table.slice(open_from).to_batches()
        held -= open_from
    if held:
        yield pa.Table.from_batches(kept)


def meet(df: DataFrame, side: DataFrame, key: str, rows: str, parts: int = 4096) -> DataFrame:
    """df, left-joined with side (one row a key) on key; a null key meets nothing.

    side[rows] is the number of rows of df with that key, or more. Keys with over a 4,096th of their sum are met by
    broadcast, so there are fewer than 4,096 of them at any size; other rows meet theirs by a shuffle. Rows that need
    none there are dealt out evenly. The columns of side but key and rows are added.
    """
    total = side.agg(F.sum(F.col(rows).cast("decimal(38,0)"))).first()[0] or 0
    names = [c for c in side.columns if c not in (key, rows)]
    often = F.col(rows) * parts > F.lit(total)
    big = F.broadcast(side.where(often).select(F.col(key).alias("big_key"), F.struct(*names).alias("big")))
    rest = side.where(~often).select(F.lit(0).alias("rest_slot"), F.col(key).alias("rest_key"), F.struct(*names).alias("rest"))
    met = df.join(big, df[key] == big.big_key, "left")
    here = F.col(key).isNotNull() & F.col("big_key").isNull()
    met = met.withColumn("own_slot", F.when(here, 0).otherwise(F.pmod(F.xxhash64(*df.columns), F.lit(parts)).cast("int") + 1)).withColumn("own_key", F.when(here, F.col(key)))
    out = met.join(rest, (met.own_slot == rest.rest_slot) & (met.own_key == rest.rest_key), "left")
    return out.select(*df.columns, *[F.coalesce(F.col("big")[c], F.col("rest")[c]).alias(c) for c in names])


def connected_components(edges: DataFrame, rounds: int = 60) -> DataFrame:
    """Components of undirected links (u, v): returns (node, component), component the smallest node.

    Alternates the large-star and small-star steps of Kiveris et al. (2014): each is one aggregation
    by node and one join. The aggregation is partial before its shuffle; the joins bring a hub's links
    together, which adaptive execution splits where they are large. Nodes without links do not appear; null ends and loops are ignored; an empty input gives an empty table. Every round is
    written to the shared folder.
    """
    links = edges.select(F.col("u").alias("u"), F.col("v").alias("v")).where("u is not null and v is not null and u <> v")
    links = written(links.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct(), "links")
    before = None
    for _ in range(rounds):
        both = links.unionByName(links.select(F.col("v").alias("u"), F.col("u").alias("v")))
        low = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = both.join(low, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        down = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(down, "u").select("u", "v", "m")
        step = small.where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v")).unionByName(down.select("u", F.col("m").alias("v"))).distinct()
        after = written(step, "links")
        _forget(links)
        links = after
        state = links.agg(F.count("*").alias("n"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)")).alias("h")).first()
        if state == before:
            break
        before = state
    else:
        raise RuntimeError(f"components did not settle in {rounds} rounds")
    roots = links.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct()
    return links.select(F.col("u").alias("node"), F.col("v").alias("component")).unionByName(roots)
