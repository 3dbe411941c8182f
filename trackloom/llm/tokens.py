"""Token counts: Arrow batches in, lengths out.

Texts are cut at ASCII white space, where this kind of tokenizer (one that drops white space before it
merges) never joins what stands on both sides. Each distinct piece of a batch is encoded once, in calls
balanced by bytes, and only lengths leave the function. A piece without white space is passed whole.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from trackloom.llm.common import text_batches

#: Bytes of encoded pieces that a worker remembers at most (each some 150 more); only speed depends on it.
REMEMBERED = 400_000 * 160
#: Bytes of text in one call of the tokenizer.
CALL_BYTES = 256 << 10


class PieceLengths(dict):
    """Number of tokens of each piece, for a tokenizer file of the tokenizers library."""

    def __init__(self, path: str):
        super().__init__()
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.tokenizer.no_truncation()
        self.tokenizer.no_padding()
        self.bytes = 0

    def learn(self, pieces: set[bytes]) -> None:
        new = [p for p in pieces if p not in self]
        size = sum(map(len, new)) + 150 * len(new)
        if self and self.bytes + size > REMEMBERED:
            self.clear()
            self.bytes, new = 0, list(pieces)
            size = sum(map(len, new)) + 150 * len(new)
        self.bytes += size
        call, size = [], 0
        for piece in [*new, None]:
            if call and (piece is None or size + len(piece) > CALL_BYTES):
                encoded = self.tokenizer.encode_batch_fast([p.decode() for p in call], add_special_tokens=False)
                self.update(zip(call, map(len, encoded)))
                call, size = [], 0
            if piece is not None:
                call.append(piece)
                size += len(piece)


class SentencePieceLengths:
    """Token counts of whole texts by a sentencepiece model, whose pieces do cross white space."""

    def __init__(self, path: str):
        import sentencepiece

        self.model = sentencepiece.SentencePieceProcessor(model_file=path)

    def counts(self, texts: list[str]) -> list[int]:
        return [len(x) for x in self.model.encode(texts, num_threads=1)]


def token_counts(docs: DataFrame, tokenizer_path: str, limit: int = 2048, *, splits_at_space: bool = True) -> DataFrame:
    """doc_id, n_bytes, n_tokens, over_limit for every row of docs (doc_id, text).

    tokenizer_path: a .json of tokenizers or a .model of sentencepiece, readable on every executor.
    splits_at_space: the tokenizer drops white space before merging, so texts may be cut there.
    A null text counts as empty; a null doc_id stays null; repeated rows each give a row; an empty
    table gives an empty table; other columns are ignored. A long text is encoded whole where it has no white
    space, and else by its words, each of them once.
    """

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        if tokenizer_path.endswith(".model"):
            whole, lengths = SentencePieceLengths(tokenizer_path), None
        else:
            lengths = PieceLengths(tokenizer_path)
        for batch in text_batches(batches, 4 << 20):
            texts = [x or "" for x in batch.column("text").to_pylist()]
            if lengths is None:
                sizes, tokens = [len(x.encode()) for x in texts], whole.counts(texts)
            elif not splits_at_space:
                sizes = [len(x.encode()) for x in texts]
                tokens = [len(x) for x in lengths.tokenizer.encode_batch_fast(texts, add_special_tokens=False)]
            else:
                raw = [x.encode() for x in texts]
                sizes = [len(x) for x in raw]
                pieces = [x.split() for x in raw]
                lengths.learn(set().union(*pieces))
                tokens = [sum(map(lengths.__getitem__, p)) for p in pieces]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(sizes, pa.int64()), pa.array(tokens, pa.int64())], ["doc_id", "n_bytes", "n_tokens"])

    counted = docs.select("doc_id", "text").mapInArrow(count, "doc_id long, n_bytes long, n_tokens long")
    return counted.withColumn("over_limit", F.col("n_tokens") > limit)
