"""Best-fit packing of tokenized documents into sequences of a fixed capacity.

Hierarchical residual packing. Every input partition packs its own pieces best-fit in decreasing order;
bins that are full but for a small slack leave at once, with their contents. The others become items of
the next round: far fewer partitions, each taking the bins of several, fit them again, until one small
set is left. A bin carries its contents, which are bounded by its capacity.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from trackloom.llm.common import forget, text_batches, written

PIECE = pa.struct([("doc_id", pa.int64()), ("piece", pa.int32()), ("start", pa.int64()), ("length", pa.int64()), ("ids_crc32", pa.int64())])
BIN = pa.schema([("fill", pa.int64()), ("members", pa.list_(PIECE))])
BIN_DDL = "fill long, members array<struct<doc_id:long,piece:int,start:long,length:long,ids_crc32:long>>"
#: Texts of only these characters get the same ids from both libraries; any other text goes to tokenizers itself.
PLAIN = "\t\n\r\x20-\x7e¡-¬®-ɏ–—‘-”…€"


class Ids:
    """Ids as the tokenizers file gives them, without added special tokens.

    tiktoken_path: the same vocabulary as ranks. Texts of plain characters that hold no special string
    are then encoded by tiktoken, which gives equal ids four times as fast.
    """

    def __init__(self, tokenizer_path: str, tiktoken_path: str | None, pattern: str | None):
        import re

        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(tokenizer_path)
        self.tokenizer.no_truncation()
        self.tokenizer.no_padding()
        self.encoding = None
        if tiktoken_path:
            import base64

            import tiktoken

            with open(tiktoken_path, "rb") as lines:
                ranks = {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, lines)}
            self.encoding = tiktoken.Encoding("same", pat_str=pattern, mergeable_ranks=ranks, special_tokens={})
            specials = [t.content for t in self.tokenizer.get_added_tokens_decoder().values()]
            self.odd = re.compile("|".join([f"[^{PLAIN}]", *map(re.escape, specials)]))

    def __call__(self, text: str) -> np.ndarray:
        if self.encoding is not None and not self.odd.search(text):
            return np.array(self.encoding.encode_ordinary(text), "<u4")
        return np.array(self.tokenizer.encode_batch_fast([text], add_special_tokens=False)[0].ids, "<u4")


def cut(doc_id: int | None, ids: np.ndarray, capacity: int) -> list[tuple]:
    """Pieces of one document: one if it fits, else full ones after a first that takes the remainder."""
    first = (len(ids) - 1) % capacity + 1
    edges = [0, *range(first, len(ids) + 1, capacity)]
    return [(doc_id, k, a, b - a, zlib.crc32(ids[a:b].tobytes())) for k, (a, b) in enumerate(zip(edges, edges[1:]))]


def best_fit(sizes: list[int], capacity: int) -> list[list[int]]:
    """Best-fit decreasing: positions of the items in each bin. Open bins are found by residual in a bit set."""
    open_bins: list[list[int]] = [[] for _ in range(capacity + 1)]
    residuals, bins = 0, []
    for i in sorted(range(len(sizes)), key=lambda i: (-sizes[i], i)):
        size = sizes[i]
        fitting = residuals >> size
        if fitting:
            left = size + (fitting & -fitting).bit_length() - 1
            b = open_bins[left].pop()
            if not open_bins[left]:
                residuals ^= 1 << left
            bins[b].append(i)
            left -= size
        else:
            b, left = len(bins), capacity - size
            bins.append([i])
        if left:
            open_bins[left].append(b)
            residuals |= 1 << left
    return bins


def _fit(items: list[tuple[int, list]], capacity: int) -> pa.RecordBatch:
    bins = best_fit([size for size, _ in items], capacity)
    fills = [sum(items[i][0] for i in b) for b in bins]
    return pa.RecordBatch.from_arrays([pa.array(fills, pa.int64()), pa.array([[m for i in b for m in items[i][1]] for b in bins], BIN.field("members").type)], schema=BIN)


def pack(
    docs: DataFrame,
    tokenizer_path: str,
    *,
    capacity: int = 2048,
    end_id: int = 0,
    tiktoken_path: str | None = None,
    pattern: str | None = None,
    slack: int = 4,
    items_per_task: int = 50_000,
) -> DataFrame:
    """Sequences of at most capacity tokens that hold every document of docs (doc_id, text) once.

    Returns a row per piece: doc_id, piece, start, length, ids_crc32, sequence_id, offset. Only documents
    longer than capacity (end_id included) are cut. A null text is an empty one, of end_id alone; a null
    doc_id stays null; repeated rows are packed each; an empty table gives an empty table; further
    columns are ignored. slack: bins with so few free places are not opened again. items_per_task: bins
    fitted by one task of a round at most; it bounds memory, and the tail of the tree to one task.
    """
    spark = docs.sparkSession

    def first(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode, items = Ids(tokenizer_path, tiktoken_path, pattern), []
        for batch in text_batches(batches, 4 << 20):
            for doc_id, text in zip(batch.column("doc_id").to_pylist(), batch.column("text").to_pylist()):
                ids = np.append(encode(text or ""), np.array([end_id], "<u4"))
                items += [(p[3], [dict(zip(("doc_id", "piece", "start", "length", "ids_crc32"), p))]) for p in cut(doc_id, ids, capacity)]
            if len(items) >= items_per_task:
                yield _fit(items, capacity)
                items = []
        if items:
            yield _fit(items, capacity)

    def again(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        items = []
        for batch in batches:
            items += list(zip(batch.column("fill").to_pylist(), batch.column("members").to_pylist()))
            if len(items) >= 2 * items_per_task:
                yield _fit(items, capacity)
                items = []
        if items:
            yield _fit(items, capacity)

    bins = written(docs.select("doc_id", "text").mapInArrow(first, BIN_DDL), "bins")
    full, open_count = [bins.where(F.col("fill") >= capacity - slack)], None
    while True:
        rest = bins.where(F.col("fill") < capacity - slack)
        count = rest.count()
        # A set that one task holds, and that did not shrink by a hundredth since, is as tight as it gets.
        if not count or (open_count is not None and (open_count <= items_per_task or count > 0.99 * open_count)):
            full.append(rest)
            break
        open_count = count
        tasks = -(-count // items_per_task)
        bins = written(rest.repartition(tasks).mapInArrow(again, BIN_DDL), "bins")
        full.append(bins.where(F.col("fill") >= capacity - slack))
    sequences = full[0]
    for more in full[1:]:
        sequences = sequences.unionByName(more)
    before = "cast(aggregate(slice(members, 1, i), 0L, (n, x) -> n + x.length) as long) as offset"
    member = "m.doc_id as doc_id, m.piece as piece, m.start as start, m.length as length, m.ids_crc32 as ids_crc32"
    placed = sequences.select(F.monotonically_increasing_id().alias("sequence_id"), F.expr(f"transform(members, (m, i) -> struct({member}, {before}))").alias("members"))
    return placed.select("sequence_id", F.inline("members")).select("doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset")
