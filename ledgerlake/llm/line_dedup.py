"""Line dedup: lines that many documents hold go from all of them.

A line's key is the line without ``[\\x20\\x09-\\x0D]`` at both ends and with
A-Z lower-cased. A key of at least one code point found in ``min_documents``
documents or more loses its lines: all of them, or with ``keep_first`` all but
the first (smallest doc_id, then position).

Method. Lines travel as 96-bit hashes, never as text. Hashes are uniform, so
fixed cuts of the hash range are the partitions (no sampling pass), each
sorted by hash, document and position. One pass over a sorted partition
streams the first occurrences of a key in each document and counts them; it
holds the rows of fewer than ``min_documents`` documents of one key at a time.
Decisions come back as one compressed bitmap a document; only ``drop_lines``
reads text again.

Skew. A key that an Arrow batch finds in ``min_documents`` documents is decided
in the task: one representative row goes to the key's partition, the others
travel dealt by document. A line that a third of all documents hold sends one
row a batch.

Defined cases: a null or empty text is one empty line, which stays, as do all
lines of white space; rows that share a doc_id (null is a value here) are one
document, however often they are repeated; a very long text or line is handled
in slices; an empty table gives an empty table; further columns, whatever
their names, are ignored.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ledgerlake.llm.tables import columns
from ledgerlake.llm.words import BYTE_BASE, LENGTH_FACTOR, U, mix, ranged_hash, slices

MIN_DOCUMENTS = 10
SLICE = 1 << 20
# state of a line row: to be counted; decided in its batch, stands for the others; decided or a head row, passes through
OPEN, HEAD, THROUGH = 0, 1, 2

_LINES = "key long, tail int, doc long, ver long, pos int, state byte"
_BITMAPS = "doc_id long, ver long, n_lines long, n_dropped long, keep binary"
_KEPT = "doc_id long, n_lines long, n_dropped long, text string"
_NO_ID = -(1 << 63)


def _split(texts: pa.Array):
    """Lines per text, and the key hashes of all lines in text order (tail: 32 further bits; filled: has a key)."""
    offsets = np.frombuffer(texts.buffers()[1], np.int32)[texts.offset:texts.offset + len(texts) + 1].astype(np.int64)
    data = texts.buffers()[2]
    raw = np.frombuffer(data, np.uint8)[offsets[0]:offsets[-1]] if data is not None else np.empty(0, np.uint8)
    offsets = offsets - offsets[0]
    breaks = np.flatnonzero(raw == 10)
    starts = np.sort(np.concatenate([offsets[:-1], breaks + 1]))
    ends = np.sort(np.concatenate([breaks, offsets[1:]]))
    n_lines = np.searchsorted(breaks, offsets[1:]) - np.searchsorted(breaks, offsets[:-1]) + 1
    ink = np.flatnonzero(~((raw == 32) | ((raw >= 9) & (raw <= 13))))
    a, b = np.searchsorted(ink, starts), np.searchsorted(ink, ends)
    filled = b > a
    first, stop = ink[a[filled]], ink[b[filled] - 1] + 1
    values = np.where((raw >= 65) & (raw <= 90), raw + np.uint8(32), raw).astype(np.uint16) + np.uint16(1)
    size = (stop - first).astype(U) * U(LENGTH_FACTOR)
    key = mix(ranged_hash(values, first, stop, BYTE_BASE) + size)
    tail = (mix(ranged_hash(values, first, stop, BYTE_BASE + 6) + size) >> U(32)).astype(np.uint32)
    return n_lines, key, tail, filled


def _line_rows(min_documents: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not len(batch):
                continue
            counts, keys, tails, places, done = [], [], [], [], 0
            for part in slices(batch, "text", SLICE):
                n, key, tail, filled = _split(part.column("text"))
                at = np.flatnonzero(filled)
                row = np.repeat(np.arange(len(n)), n)
                pos = np.arange(len(row)) - np.repeat(np.cumsum(n) - n, n)
                counts.append(n)
                keys.append(key)
                tails.append(tail)
                places.append(np.stack([row[at] + done, pos[at]]))
                done += len(part)
            n, key, tail = np.concatenate(counts), np.concatenate(keys), np.concatenate(tails)
            row, pos = np.concatenate(places, axis=1)
            ids, vers = batch.column("doc").to_numpy(), batch.column("ver").to_numpy()
            doc = ids[row]
            state = np.zeros(len(key), np.int8)
            if len(key):
                order = np.lexsort((pos, doc, tail, key))
                k, t, d = key[order], tail[order], doc[order]
                new = np.r_[True, (k[1:] != k[:-1]) | (t[1:] != t[:-1])]
                heads = np.flatnonzero(new)
                seen = new | np.r_[True, d[1:] != d[:-1]]  # first occurrence of the key in a document
                decided = np.add.reduceat(seen.astype(np.int64), heads) >= min_documents
                ranks = np.where(np.repeat(decided, np.diff(np.r_[heads, len(k)])), THROUGH, OPEN)
                ranks[heads[decided]] = HEAD
                state[order] = ranks
            dealt = mix(ids.astype(U))  # what needs no meeting is dealt by document
            key = np.where(state == THROUGH, dealt[row], key)
            yield _rows(key, tail, doc, vers[row], pos, state)
            # a head row a document carries its number of lines
            yield _rows(dealt, np.zeros(len(n), np.uint32), ids, vers, -n, np.full(len(n), THROUGH, np.int8))

    return run


def _rows(key, tail, doc, ver, pos, state) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays(
        [pa.array(key.view(np.int64)), pa.array(tail.view(np.int32)), pa.array(doc), pa.array(ver), pa.array(pos.astype(np.int32)),
         pa.array(state)], ["key", "tail", "doc", "ver", "pos", "state"])


def _stream(min_documents: int, keep_first: bool):
    """Sorted rows to the (doc, ver, pos) of lines to drop, and the head rows as they are."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, settled = None, None  # rows of an open key that reached the batch's end; the decided key that did
        for batch in batches:
            state = batch.column("state").to_numpy()
            through = state == THROUGH
            if through.any():
                yield _drops(batch.filter(pa.array(through)))
            rows = batch.filter(pa.array(~through))
            if not len(rows):
                continue
            if held is not None:
                rows = pa.Table.from_batches([held, rows]).combine_chunks().to_batches()[0]
                held = None
            key, tail, doc, state = (rows.column(c).to_numpy() for c in ("key", "tail", "doc", "state"))
            new = np.r_[True, (key[1:] != key[:-1]) | (tail[1:] != tail[:-1])]
            heads = np.flatnonzero(new)
            size = np.diff(np.r_[heads, len(key)])
            seen = new | np.r_[True, doc[1:] != doc[:-1]]
            decided = (np.add.reduceat(seen.astype(np.int64), heads) >= min_documents) | (np.maximum.reduceat(state, heads) == HEAD)
            goes_on = settled == (key[0], tail[0])
            decided[0] |= goes_on
            drop = np.repeat(decided, size)
            if keep_first:
                drop[heads[1 if goes_on else 0:]] = False
            settled = (key[-1], tail[-1]) if decided[-1] else None
            if not decided[-1]:
                held = rows.slice(int(heads[-1]))
            if drop.any():
                yield _drops(rows.filter(pa.array(drop)))

    return run


def _drops(rows: pa.RecordBatch) -> pa.RecordBatch:
    return rows.select(["doc", "ver", "pos"])


def _to_bitmaps(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        n = batch.column("n_lines").to_numpy()
        keep, gone = [], []
        for size, at in zip(n.tolist(), batch.column("dropped"), strict=True):
            bits = np.ones(size, bool)
            bits[at.values.to_numpy()] = False
            keep.append(zlib.compress(np.packbits(bits).tobytes()))
            gone.append(len(at))
        yield pa.RecordBatch.from_arrays(
            [batch.column("doc_id"), batch.column("ver"), batch.column("n_lines"), pa.array(gone, pa.int64()), pa.array(keep, pa.binary())],
            ["doc_id", "ver", "n_lines", "n_dropped", "keep"])


def _apply(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        texts = []
        for text, n, gone, keep in zip(batch.column("text"), batch.column("n_lines").to_pylist(),
                                       batch.column("n_dropped").to_pylist(), batch.column("keep"), strict=True):
            if gone:
                bits = np.unpackbits(np.frombuffer(zlib.decompress(keep.as_py()), np.uint8), count=n).astype(bool).tolist()
                texts.append("\n".join(line for line, stays in zip(text.as_py().split("\n"), bits, strict=True) if stays))
            else:
                texts.append(text.as_py())
        yield pa.RecordBatch.from_arrays(
            [batch.column("doc_id"), batch.column("n_lines"), batch.column("n_dropped"), pa.array(texts, pa.string())],
            ["doc_id", "n_lines", "n_dropped", "text"])


def _versions(docs: DataFrame) -> DataFrame:
    docs = columns(docs, ["doc_id", "text"])
    text = F.coalesce(F.col("text"), F.lit(""))
    return docs.select(F.col("doc_id").cast("long"), text.alias("text"), F.xxhash64(text).alias("ver"))


def keep_bitmaps(docs: DataFrame, min_documents: int = MIN_DOCUMENTS, keep_first: bool = False) -> DataFrame:
    """One row a document version: doc_id, ver (xxhash64 of the text), n_lines, n_dropped, keep.

    ``keep`` is a zlib-compressed bitmap, bit i (from the high end of byte 0)
    set if line i stays. A null doc_id comes back null.
    """
    partitions = int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    lines = (_versions(docs).withColumn("doc", F.coalesce("doc_id", F.lit(_NO_ID))).select("doc", "ver", "text")
             .mapInArrow(_line_rows(min_documents), _LINES))
    # the hash range in equal cuts: its upper 31 bits, scaled
    cut = F.shiftrightunsigned("key", 33) * F.lit(partitions)
    drops = (lines.repartitionById(partitions, F.shiftright(cut, 31).cast("int"))
             .sortWithinPartitions("key", "tail", "doc", "ver", "pos")
             .mapInArrow(_stream(min_documents, keep_first), "doc long, ver long, pos int"))
    per_doc = drops.groupBy("doc", "ver").agg(
        (-F.min("pos")).cast("long").alias("n_lines"),
        F.collect_set(F.when(F.col("pos") >= 0, F.col("pos"))).alias("dropped"))
    doc_id = F.when(F.col("doc") != _NO_ID, F.col("doc"))
    return per_doc.select(doc_id.alias("doc_id"), "ver", "n_lines", "dropped").mapInArrow(_to_bitmaps, _BITMAPS)


def drop_lines(docs: DataFrame, bitmaps: DataFrame) -> DataFrame:
    """doc_id, n_lines, n_dropped and the text of the lines that ``bitmaps`` keep, joined by a line break."""
    own = bitmaps.withColumnRenamed("doc_id", "_id").withColumnRenamed("ver", "_ver")
    rows = _versions(docs)
    both = rows.join(own, rows["doc_id"].eqNullSafe(own["_id"]) & (rows["ver"] == own["_ver"]))
    return both.select("doc_id", "text", "n_lines", "n_dropped", "keep").mapInArrow(_apply, _KEPT)


def sql(table: str = "documents", min_documents: int = MIN_DOCUMENTS) -> str:
    """The per-document counts and the kept text's digest as DuckDB SQL."""
    white = "chr(32) || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)"
    upper = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
    return f"""
WITH d AS (SELECT row_number() OVER () AS rid, doc_id, string_split(coalesce(text, ''), chr(10)) AS l FROM {table}),
line AS (SELECT rid, doc_id, unnest(l) AS x, unnest(range(1, len(l) + 1)) AS p FROM d),
keyed AS (SELECT *, translate(trim(x, {white}), '{upper}', '{upper.lower()}') AS k FROM line),
often AS (SELECT k FROM keyed WHERE k <> '' GROUP BY k
          HAVING count(DISTINCT doc_id) + max(CASE WHEN doc_id IS NULL THEN 1 ELSE 0 END) >= {min_documents}),
kept AS (SELECT rid, string_agg(x, chr(10) ORDER BY p) AS t, count(*) AS c FROM keyed ANTI JOIN often USING (k) GROUP BY rid)
SELECT doc_id, len(l)::BIGINT AS n_lines, (len(l) - coalesce(c, 0))::BIGINT AS n_dropped, sha256(coalesce(t, '')) AS kept_sha256
FROM d LEFT JOIN kept USING (rid)"""
