"""Byte-level BPE encoding and decoding.

Encoding. A text is cut at added tokens, then into pieces that no merge can
cross. In each piece the symbols form a doubly linked list; the merge ranks of
neighbouring pairs wait in a priority queue, and an entry whose symbols have
changed since is stale and skipped. Decoding concatenates the vocabulary
strings of the ids and maps them back to bytes.

Stretches are cut first at single spaces whose neighbours are both no white
space of any kind: the split pattern never joins across such a space, so a word
and its leading space are encoded alike wherever they stand, and a bounded
table keeps the frequent ones. What lies between goes through the split
pattern itself, runs of other white space included.

Defined cases: a null or empty text has no ids and decodes to an empty text; a
text of any length is encoded whole; repeated rows are encoded each; an empty
table gives an empty table; further columns, whatever their names, are ignored.
"""

from __future__ import annotations

import heapq
import json
import re
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ledgerlake.llm.tables import columns
from ledgerlake.llm.words import slices

# The split pattern of byte-level vocabularies (fixed value); white space is Unicode White_Space.
SPLIT = (r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\p{White_Space}\p{L}\p{N}]+"
         r"|\p{White_Space}+(?![^\p{White_Space}])|\p{White_Space}+")
SPLIT_SOURCE = SPLIT.replace(r"[^\p{White_Space}]", r"\S").replace(r"\p{White_Space}", r"\s")
# White space beside the space and the line break.
OTHER_SPACES = [chr(c) for c in range(0x3001) if chr(c).isspace() and chr(c) not in " \n"]
KEPT_PIECES = 300_000  # encoded pieces a worker keeps


def public_vocabulary(name: str = "byte_bpe_50k.json") -> str:
    import public_tokenizers
    return public_tokenizers.path(name)


def byte_symbols() -> dict[int, str]:
    """The printable character that stands for each byte: itself if printable, else the next from U+0100 on."""
    plain = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    others = [b for b in range(256) if b not in plain]
    return {b: chr(b) for b in plain} | {b: chr(0x100 + i) for i, b in enumerate(others)}


class ByteBpe:
    """A vocabulary file of the tokenizers library, read as ranks and ids."""

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        vocab = spec["model"]["vocab"]
        self.added = {t["content"]: t["id"] for t in spec.get("added_tokens", [])}
        symbols = byte_symbols()
        self.byte_ids = [vocab[symbols[b]] for b in range(256)]
        self.merges = {}
        for rank, pair in enumerate(spec["model"]["merges"]):
            a, b = pair if isinstance(pair, list) else pair.split(" ")
            self.merges[vocab[a], vocab[b]] = (rank, vocab[a + b])
        back = {ord(c): b for b, c in symbols.items()}
        self.strings = [b""] * (max([*vocab.values(), *self.added.values()]) + 1)
        for text, i in vocab.items():
            self.strings[i] = bytes(back[ord(c)] for c in text)
        for text, i in self.added.items():
            self.strings[i] = text.encode("utf-8")
        self._split = regex.compile(SPLIT)

    def merge(self, word: bytes) -> list[int]:
        """The ids of one piece of the split pattern."""
        ids = [self.byte_ids[b] for b in word]
        n = len(ids)
        if n < 2:
            return ids
        merges = self.merges
        before, after = list(range(-1, n - 1)), list(range(1, n + 1))
        after[-1] = -1
        queue = []
        for i in range(n - 1):
            m = merges.get((ids[i], ids[i + 1]))
            if m:
                queue.append((m[0], i, ids[i], ids[i + 1], m[1]))
        heapq.heapify(queue)
        while queue:
            _, i, a, b, new = heapq.heappop(queue)
            j = after[i]
            if ids[i] != a or j < 0 or ids[j] != b:
                continue  # stale
            ids[i], ids[j] = new, -1
            k = after[i] = after[j]
            if k >= 0:
                before[k] = i
                m = merges.get((new, ids[k]))
                if m:
                    heapq.heappush(queue, (m[0], i, new, ids[k], m[1]))
            h = before[i]
            if h >= 0:
                m = merges.get((ids[h], new))
                if m:
                    heapq.heappush(queue, (m[0], h, ids[h], new, m[1]))
        return [i for i in ids if i >= 0]

    def encode_piece(self, piece: str) -> list[int]:
        word = piece[1:] if piece[:1] == " " else piece
        if word.isascii() and word.isalpha():  # one piece of the pattern
            return self.merge(piece.encode("ascii"))
        return [i for p in self._split.findall(piece) for i in self.merge(p.encode("utf-8"))]

    def decode(self, ids) -> str:
        return b"".join(map(self.strings.__getitem__, ids)).decode("utf-8", errors="replace")


class PieceTable:
    """Encodes texts piece by piece to little-endian unsigned 32-bit ids; keeps the pieces met first."""

    def __init__(self, encode: Callable[[list[str]], list[list[int]]], added: dict[str, int], keep: int = KEPT_PIECES):
        self.encode, self.keep = encode, keep
        self.first: dict[str, bytes] = {}  # pieces without a leading space
        self.spaced: dict[str, bytes] = {}  # pieces after one space
        self.added = {t: np.array([i], "<u4").tobytes() for t, i in added.items()}
        self.cut = re.compile("(" + "|".join(re.escape(t) for t in sorted(added, key=len, reverse=True)) + ")") if added else None
        # Python's white space holds all of Unicode's and four control characters: a space beside those is not cut at
        self.space = re.compile(r"(?<=\S) (?=\S)")

    def _look_up(self, pieces: list[str], table: dict[str, bytes], lead: str) -> list[bytes]:
        try:
            return [table[p] for p in pieces]
        except KeyError:
            new = list({p for p in pieces if p not in table})
            extra = {p: np.array(ids, "<u4").tobytes()
                     for p, ids in zip(new, self.encode([lead + p for p in new]), strict=True)}
            if len(table) + len(extra) <= self.keep:
                table.update(extra)
                return [table[p] for p in pieces]
            return [table.get(p) or extra[p] for p in pieces]

    def _segment(self, text: str) -> list[bytes]:
        even = (text[:1] != " " != text[-1:] and "  " not in text and " \n" not in text and "\n " not in text
                and not any(c in text for c in OTHER_SPACES))
        pieces = text.split(" ") if even else self.space.split(text)
        return self._look_up(pieces[:1], self.first, "") + self._look_up(pieces[1:], self.spaced, " ")

    def ids(self, text: str) -> bytes:
        if not text:
            return b""
        if self.cut is None or not self.cut.search(text):
            return b"".join(self._segment(text))
        out = []
        for part in self.cut.split(text):
            if part:
                out += [self.added[part]] if part in self.added else self._segment(part)
        return b"".join(out)


_tables: dict[str, tuple[ByteBpe, PieceTable]] = {}


def _table(path: str) -> tuple[ByteBpe, PieceTable]:
    if path not in _tables:  # once a worker process
        bpe = ByteBpe(path)
        _tables[path] = bpe, PieceTable(lambda pieces: [bpe.encode_piece(p) for p in pieces], bpe.added)
    return _tables[path]


def _encode(path: str, decoded: bool):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe, table = _table(path)
        for batch in batches:
            for part in slices(batch, "text"):
                ids = [table.ids(t or "") for t in part.column("text").to_pylist()]
                offsets = np.r_[0, np.cumsum([len(x) // 4 for x in ids])].astype(np.int32)
                flat = np.frombuffer(b"".join(ids), "<u4").astype(np.int32)
                cols = [part.column("doc_id"), pa.ListArray.from_arrays(pa.array(offsets), pa.array(flat))]
                if decoded:
                    cols.append(pa.array([bpe.decode(np.frombuffer(x, "<u4").tolist()) for x in ids], pa.string()))
                yield pa.RecordBatch.from_arrays(cols, ["doc_id", "ids", "decoded"][:len(cols)])

    return run


def encode(docs: DataFrame, vocabulary: str | None = None, decoded: bool = False) -> DataFrame:
    """doc_id and ids (array<int>) of every text; with ``decoded`` also the text that the ids give back."""
    kind = "doc_id long, ids array<int>" + ", decoded string" * decoded
    docs = columns(docs, ["doc_id", "text"]).withColumn("doc_id", F.col("doc_id").cast("long"))
    return docs.mapInArrow(_encode(vocabulary or public_vocabulary(), decoded), kind)


def decode(encoded: DataFrame, vocabulary: str | None = None) -> DataFrame:
    """doc_id and text of rows (doc_id, ids); null ids give an empty text."""
    path = vocabulary or public_vocabulary()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe, _ = _table(path)
        for batch in batches:
            texts = [bpe.decode(x or []) for x in batch.column("ids").to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(texts, pa.string())], ["doc_id", "text"])

    return columns(encoded, ["doc_id", "ids"]).withColumn("doc_id", F.col("doc_id").cast("long")).mapInArrow(
        run, "doc_id long, text string")
