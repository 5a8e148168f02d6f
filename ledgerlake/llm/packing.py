"""Packing by power-of-two decomposition.

A document's ids and one end id are cut into pieces whose lengths are powers
of two: whole sequences of ``LENGTH`` first, then the binary digits of the
rest, from large to small. Each piece is a sequence by itself, in the bucket of
its length, so no sequence crosses documents and none needs padding.

Sequence ids need no global count: bucket, partition and row number are put
together in 63 bits. Equal lengths are therefore consecutive, and a task that
runs again gives the same ids.

Defined cases: a null or empty text has the end id alone; rows that share a
doc_id, repeated ones too, are packed each for itself; a very long text is
encoded whole and cut into as many sequences as it needs; an empty table gives
an empty table; further columns, whatever their names, are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ledgerlake.llm.bpe import SPLIT_SOURCE, ByteBpe, public_vocabulary
from ledgerlake.llm.tables import columns
from ledgerlake.llm.words import slices

LENGTH = 2048
END_ID = 1
_BUCKET, _PARTITION = 58, 34  # lowest bit of the bucket and of the partition in a sequence id
_KIND = "doc_id long, start long, length long, tokens binary, doc_tokens long, bucket int, sequence_id long, offset long"


class Encoder:
    """The ids the tokenizers library gives for a byte-level vocabulary file.

    Where a vocabulary's merges are in the order of its ids, the tiktoken
    library gives the same ids from the vocabulary as ranks, several times as
    fast and in linear time however long a run without white space is. Other
    vocabularies are encoded by the tokenizers library; the text plays no part.
    """

    def __init__(self, path: str):
        import tiktoken
        self.path = path
        bpe = ByteBpe(path)
        ranks = {s: i for i, s in enumerate(bpe.strings) if s and i not in bpe.added.values()}
        self.fast = tiktoken.Encoding("file", pat_str=SPLIT_SOURCE, mergeable_ranks=ranks, special_tokens=bpe.added)
        self.ordered = list(bpe.merges.values()) == sorted(bpe.merges.values(), key=lambda m: m[1])
        self._library = None

    def library(self):
        if self._library is None:
            import os
            os.environ["TOKENIZERS_PARALLELISM"] = "false"
            from tokenizers import Tokenizer
            self._library = Tokenizer.from_file(self.path)
            self._library.no_truncation()
            self._library.no_padding()
        return self._library

    def ids(self, text: str) -> np.ndarray:
        if not self.ordered:
            return np.array(self.library().encode(text, add_special_tokens=False).ids, "<u4")
        return self.fast.encode_to_numpy(text, allowed_special="all").astype("<u4", copy=False)


_encoders: dict[str, Encoder] = {}


def _encoder(path: str) -> Encoder:
    if path not in _encoders:  # once a worker process
        _encoders[path] = Encoder(path)
    return _encoders[path]


def cuts(n: int, length: int = LENGTH) -> list[int]:
    """Powers of two that sum to n, none over ``length``, from large to small."""
    return [length] * (n // length) + [1 << b for b in range(length.bit_length() - 1, -1, -1) if n % length >> b & 1]


def _pack(path: str, length: int, end_id: int):
    tail = np.array([end_id], "<u4").tobytes()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = _encoder(path)
        context = TaskContext.get()
        high = (context.partitionId() if context else 0) << _PARTITION
        count = 0
        for batch in batches:
            for part in slices(batch, "text"):
                rows, starts, sizes, tokens, totals = [], [], [], [], []
                for row, text in enumerate(part.column("text").to_pylist()):
                    ids = encoder.ids(text or "").tobytes() + tail
                    at = 0
                    for n in cuts(len(ids) // 4, length):
                        rows.append(row)
                        starts.append(at)
                        sizes.append(n)
                        tokens.append(ids[4 * at:4 * (at + n)])
                        totals.append(len(ids) // 4)
                        at += n
                bucket = np.log2(sizes).astype(np.int64)
                sequence = (bucket << _BUCKET) + high + np.arange(count, count + len(rows))
                count += len(rows)
                yield pa.RecordBatch.from_arrays(
                    [part.column("doc_id").take(pa.array(rows, pa.int64())), pa.array(starts, pa.int64()),
                     pa.array(sizes, pa.int64()), pa.array(tokens, pa.binary()), pa.array(totals, pa.int64()),
                     pa.array(bucket.astype(np.int32)), pa.array(sequence), pa.array(np.zeros(len(rows), np.int64))],
                    [x.split()[0] for x in _KIND.split(", ")])

    return run


def pack(docs: DataFrame, vocabulary: str | None = None, length: int = LENGTH, end_id: int = END_ID) -> DataFrame:
    """Pieces: doc_id, start, length, tokens (little-endian unsigned 32-bit ids), doc_tokens, bucket, sequence_id, offset."""
    if length & (length - 1) or length < 1 or length > 1 << 30:
        raise ValueError("the sequence length must be a power of two")
    docs = columns(docs, ["doc_id", "text"]).withColumn("doc_id", F.col("doc_id").cast("long"))
    return docs.mapInArrow(_pack(vocabulary or public_vocabulary(), length, end_id), _KIND)
