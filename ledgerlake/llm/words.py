"""Words of Arrow text columns as numpy arrays: boundaries, 64-bit hashes, hashes of word windows.

A word is ``[^\\x20\\x09-\\x0D]+``. The separators are ASCII, so the UTF-8 bytes
can be split directly. A window's hash is taken from prefix sums of a
polynomial, so it costs the same for any window length.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

U = np.uint64
MASK = (1 << 64) - 1
# Odd multipliers (fixed values, any odd numbers do).
BYTE_BASE = 0x9E3779B97F4A7C15
WORD_BASES = (0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9)
LENGTH_FACTOR = 0xD6E8FEB86659FD93
CHUNK = 1 << 17  # bytes or words hashed at a time: bounds the prefix arrays
SLICE_BYTES = 2 << 20  # text handled at a time inside an Arrow batch

_powers: dict[int, np.ndarray] = {}


def mix(x: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser (multiply and xor-shift rounds)."""
    x = x ^ (x >> U(30))
    x = x * U(0xBF58476D1CE4E5B9)
    x = x ^ (x >> U(27))
    x = x * U(0x94D049BB133111EB)
    return x ^ (x >> U(31))


def powers(base: int, n: int) -> np.ndarray:
    """base**0 .. base**n modulo 2**64."""
    have = _powers.get(base)
    if have is None or len(have) <= n:
        size = max(n + 1, CHUNK + 1)
        have = np.empty(size, U)
        have[0] = 1
        k = 1
        while k < size:
            m = min(k, size - k)
            have[k:k + m] = have[:m] * U(pow(base, k, 1 << 64))
            k += m
        if size <= 4 * CHUNK:
            _powers[base] = have
    return have


def ranged_hash(values: np.ndarray, starts: np.ndarray, ends: np.ndarray, base: int) -> np.ndarray:
    """Polynomial hash of values[starts[i]:ends[i]] for sorted starts, in chunks of bounded size."""
    out = np.empty(len(starts), U)
    inverse = pow(base, -1, 1 << 64)
    i = 0
    while i < len(starts):
        low = int(starts[i])
        j = max(i + 1, int(np.searchsorted(starts, low + CHUNK)))
        high = int(ends[i:j].max())
        part = values[low:high].astype(U)
        sums = np.zeros(len(part) + 1, U)
        np.cumsum(part * powers(base, len(part))[:len(part)], out=sums[1:])
        s, e = starts[i:j] - low, ends[i:j] - low
        out[i:j] = (sums[e] - sums[s]) * powers(inverse, len(part))[s]
        i = j
    return out


class Words:
    """The words of a slice of documents."""

    def __init__(self, texts: pa.Array, lower: bool = False):
        if isinstance(texts, pa.ChunkedArray):
            texts = texts.combine_chunks()
        if texts.null_count:
            texts = texts.fill_null("")
        wide = pa.types.is_large_string(texts.type)
        offsets = np.frombuffer(texts.buffers()[1], np.int64 if wide else np.int32)
        offsets = offsets[texts.offset:texts.offset + len(texts) + 1].astype(np.int64)
        data = texts.buffers()[2]
        raw = np.frombuffer(data, np.uint8)[offsets[0]:offsets[-1]] if data is not None else np.empty(0, np.uint8)
        self.offsets = offsets - offsets[0]
        if lower:
            raw = np.where((raw >= 65) & (raw <= 90), raw + np.uint8(32), raw)
        self.raw = raw
        n = len(raw)
        inside = ~((raw == 32) | ((raw >= 9) & (raw <= 13)))
        first, last = inside.copy(), inside.copy()
        if n:
            first[1:] &= ~inside[:-1]
            last[:-1] &= ~inside[1:]
            edge = self.offsets[:-1][self.offsets[:-1] < n]
            first[edge] = inside[edge]
            edge = self.offsets[1:][self.offsets[1:] > 0] - 1
            last[edge] = inside[edge]
        self.starts = np.flatnonzero(first)
        self.ends = np.flatnonzero(last) + 1
        # word range of document d: bounds[d] .. bounds[d + 1]
        self.bounds = np.searchsorted(self.starts, self.offsets)

    def __len__(self) -> int:
        return len(self.starts)

    def hashes(self, seed: int = 0) -> np.ndarray:
        h = ranged_hash(self.raw.astype(np.uint16) + np.uint16(1), self.starts, self.ends, (BYTE_BASE + 2 * seed) & MASK)
        return mix(h + (self.ends - self.starts).astype(U) * U(LENGTH_FACTOR) + U(seed))

    def words(self, doc: int) -> list[bytes]:
        return self.text(doc).split()

    def text(self, doc: int) -> bytes:
        return self.raw[self.offsets[doc]:self.offsets[doc + 1]].tobytes()


def window_hashes(words: np.ndarray, at: np.ndarray, length: int, which: int) -> np.ndarray:
    """Hash of words[p:p + length] for each sorted position p of ``at``."""
    return mix(ranged_hash(words, at, at + length, WORD_BASES[which]))


def slices(batch: pa.RecordBatch, column: str, limit: int = SLICE_BYTES) -> Iterator[pa.RecordBatch]:
    """``batch`` in runs of rows with at most ``limit`` bytes of text each (a longer text comes alone)."""
    at, size = 0, 0
    lengths = pc.binary_length(batch.column(column)).fill_null(0).to_pylist() if len(batch) else []
    for i, n in enumerate(lengths):
        if size and size + n > limit:
            yield batch.slice(at, i - at)
            at, size = i, 0
        size += n
    if at < len(batch):
        yield batch.slice(at)
