"""Substring dedup over difference-cover anchors.

A window is ``window`` consecutive words. A word goes if a window covering it
also starts in a document with a smaller doc_id.

Method. ``COVER`` is a difference cover modulo ``PERIOD``: for any two
positions i and j some shift below PERIOD brings both to cover positions. So
two equal windows, wherever they start, contain one aligned pair of equal
anchors (runs of ``window - PERIOD + 1`` words at cover positions). Only
anchors are hashed and shuffled at first, six in 31 positions. A window can be
repeated only if an anchor inside it is shared with another document; shared
anchors are extended to the windows around them, confirmed by 96 bits of two hashes.

Only texts with a shared anchor are read again for their windows, and texts go
through a shuffle twice: to meet their shared anchors and to meet their cuts.

Skew. Equal anchors of one Arrow batch, and equal windows of one slice of text,
are settled in the task: the smallest doc_id goes to the shuffle and the others
are decided already. A passage that a third of all documents hold sends one row
a batch.

Defined cases: a null or empty text has no words; rows with a null doc_id are
returned but neither remove words nor lose any; rows that share a doc_id,
repeated rows included, never remove words of each other; a text shorter than
the window loses nothing; a very long text is hashed in chunks; an empty table
gives an empty table; further columns, whatever their names, are ignored unless
``carry`` names them.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from itertools import compress

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ledgerlake.llm.tables import columns, written
from ledgerlake.llm.words import U, Words, mix, slices, window_hashes

WINDOW = 50
# A perfect difference set: each non-zero residue modulo 31 is a difference of two members once (fixed values).
PERIOD = 31
COVER = (0, 1, 3, 8, 12, 18)

_MARKS = "key long, doc_id long, pos int, known boolean"
_SPANS = "k1 long, k2 int, stop int, doc_id long, ver int, start int"  # stop 0: an open window, else known spans


def _anchors(window: int):
    length = window - PERIOD + 1
    cover = np.zeros(PERIOD, bool)
    cover[list(COVER)] = True

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keys, rows, at = [], [], []
            done = 0
            for part in slices(batch, "text"):
                w = Words(part.column("text"))
                h = w.hashes()
                size = np.diff(w.bounds)
                inside = np.arange(len(w)) - np.repeat(w.bounds[:-1], size)
                left = np.repeat(size, size) - inside
                pick = np.flatnonzero(cover[inside % PERIOD] & (left >= length) & (np.repeat(size, size) >= window))
                keys.append(window_hashes(h, pick, length, 0))
                rows.append(np.repeat(np.arange(len(size)), size)[pick] + done)
                at.append(inside[pick])
                done += len(part)
            if not done or not sum(map(len, keys)):
                continue
            key, row, pos = np.concatenate(keys), np.concatenate(rows), np.concatenate(at)
            ids = batch.column("doc_id").to_numpy(zero_copy_only=False)[row].astype(np.int64)
            order = np.lexsort((ids, key))
            first = np.flatnonzero(np.r_[True, np.diff(key[order]) != 0])
            stop = np.r_[first[1:], len(key)]
            by_id = ids[order]
            known, head = np.empty(len(key), bool), np.zeros(len(key), bool)
            known[order] = np.repeat(by_id[first] != by_id[stop - 1], stop - first)
            head[order[first]] = True
            # what is known and is not the group's one representative needs no meeting: deal it by document
            routed = known & ~head
            key = np.where(routed, mix(ids.astype(U)), key).view(np.int64)
            # rows leave in text order: neighbours share most bytes and compress well
            yield pa.RecordBatch.from_arrays(
                [pa.array(key), pa.array(ids), pa.array(pos.astype(np.int32)), pa.array(known)],
                ["key", "doc_id", "pos", "known"])

    return run


def _candidates(n: int, marks: np.ndarray, window: int) -> np.ndarray:
    """Starts of the windows that hold a shared anchor."""
    if n < window:
        return np.empty(0, np.int64)
    have = np.zeros(n + 1, np.int32)
    have[marks[marks < n]] = 1
    sums = np.r_[0, np.cumsum(have)]
    starts = np.arange(n - window + 1)
    return np.flatnonzero(sums[starts + PERIOD] > sums[starts])


def _windows(window: int):
    """The windows around shared anchors; what a slice of text shows to be repeated leaves as whole spans."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, "text"):
                w = Words(part.column("text"))
                marks = part.column("marks")
                starts = [_candidates(int(w.bounds[d + 1] - w.bounds[d]), marks[d].values.to_numpy(), window)
                          for d in range(len(part))]
                pos = np.concatenate(starts)
                if not len(pos):
                    continue
                row = np.repeat(np.arange(len(part)), [len(s) for s in starts])
                place = pos + w.bounds[row]
                a = window_hashes(w.hashes(0), place, window, 0)
                b = (window_hashes(w.hashes(1), place, window, 1) >> U(32)).astype(np.uint32)
                ids = part.column("doc_id").to_numpy()[row]
                ver = part.column("ver").to_numpy()[row]
                order = np.lexsort((ids, b, a))
                first = np.flatnonzero(np.r_[True, (np.diff(a[order]) != 0) | (np.diff(b[order]) != 0)])
                least = np.empty(len(a), np.int64)
                least[order] = np.repeat(ids[order][first], np.diff(np.r_[first, len(a)]))
                gone = ids > least
                keep = ~gone
                # rows leave in text order: neighbours share most bytes and compress well
                yield _span_batch(a[keep].view(np.int64), b[keep].view(np.int32), ids[keep], ver[keep], pos[keep], np.zeros(keep.sum()))
                if gone.any():
                    row, pos, ids, ver = row[gone], pos[gone], ids[gone], ver[gone]
                    head = np.r_[True, (row[1:] != row[:-1]) | (pos[1:] != pos[:-1] + 1)]
                    last = np.r_[head[1:], True]
                    ids = ids[head]
                    yield _span_batch(mix(ids.astype(U)).view(np.int64), np.zeros(len(ids), np.int32), ids, ver[head],
                                      pos[head], pos[last] + 1)

    return run


def _span_batch(k1, k2, ids, ver, start, stop) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays(
        [pa.array(k1), pa.array(k2), pa.array(stop.astype(np.int32)), pa.array(ids), pa.array(ver), pa.array(start.astype(np.int32))],
        ["k1", "k2", "stop", "doc_id", "ver", "start"])


def _remove(window: int, keep_layout: bool, carry: list[str]):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, "text"):
                w = Words(part.column("text"))
                spans = part.column("spans")
                given = part.column("text")
                sizes = np.diff(w.bounds)
                removed, texts, cut = [], [], []
                for d, n in enumerate(sizes.tolist()):
                    if not spans[d].is_valid:
                        removed.append(0)
                        cut.append([])
                        texts.append(given[d].as_py() if keep_layout else b" ".join(w.words(d)).decode("utf-8"))
                        continue
                    depth = np.zeros(n + 1, np.int32)
                    flat = spans[d].values
                    # a span of window starts covers the words up to the last window's end
                    np.add.at(depth, flat.field(0).to_numpy(), 1)
                    np.add.at(depth, np.minimum(flat.field(1).to_numpy() + window - 1, n), -1)
                    keep = np.cumsum(depth)[:n] == 0
                    removed.append(n - int(keep.sum()))
                    edge = np.diff(np.r_[1, keep.astype(np.int8), 1])
                    ranges = list(zip(np.flatnonzero(edge == -1).tolist(), np.flatnonzero(edge == 1).tolist(), strict=True))
                    cut.append([{"start": s, "stop": e} for s, e in ranges])
                    texts.append(_without(w, d, keep, ranges, keep_layout))
                yield pa.RecordBatch.from_arrays(
                    [part.column("doc_id"), pa.array(sizes.astype(np.int64)), pa.array(removed, pa.int64()),
                     pa.array(cut, pa.list_(pa.struct([("start", pa.int32()), ("stop", pa.int32())]))),
                     pa.array(texts, pa.string()), *[part.column(f"carry_{i}") for i in range(len(carry))]],
                    ["doc_id", "n_words", "n_removed", "removed", "text", *[f"carry_{i}" for i in range(len(carry))]])

    return run


def _without(w: Words, d: int, keep: np.ndarray, ranges: list[tuple[int, int]], keep_layout: bool) -> str:
    if not keep_layout:
        return b" ".join(compress(w.words(d), keep.tolist())).decode("utf-8")
    text, base, a = w.text(d), int(w.offsets[d]), int(w.bounds[d])
    out, at = [], 0
    for s, e in ranges:  # each removed run goes with the white space after it
        out.append(text[at:int(w.starts[a + s]) - base])
        at = int(w.starts[a + e]) - base if a + e < w.bounds[d + 1] else len(text)
    return b"".join([*out, text[at:]]).decode("utf-8")


def remove_repeated_passages(docs: DataFrame, window: int = WINDOW, keep_layout: bool = False,
                             carry: Sequence[str] = ()) -> DataFrame:
    """``docs`` (doc_id, text) without the words of windows that start in a smaller document too.

    Returns doc_id, n_words, n_removed, removed (array of word ranges
    start..stop), text: the kept words joined by one space, or the text with
    the removed ranges cut out if ``keep_layout``, and the columns ``carry``
    of ``docs`` (other names than those) as they are.
    """
    if window < PERIOD + 8:
        raise ValueError(f"window must be {PERIOD + 8} words at least")
    carry = list(carry)
    text = F.coalesce(F.col("text"), F.lit(""))
    docs = columns(docs, ["doc_id", "text", *carry]).select(
        F.col("doc_id").cast("long"), F.hash(text).alias("ver"),  # ver tells texts under one doc_id apart
        text.alias("text"), *[F.col(f"`{c}`").alias(f"carry_{i}") for i, c in enumerate(carry)])
    known = docs.where("doc_id is not null").select("doc_id", "ver", "text")
    marks = known.select("doc_id", "text").mapInArrow(_anchors(window), _MARKS)
    group = Window.partitionBy("key")
    # written: the shuffles behind these two tables are gone before the next one starts
    shared = (marks.withColumn("_lo", F.min("doc_id").over(group)).withColumn("_hi", F.max("doc_id").over(group))
              .withColumn("_any", F.max("known").over(group))
              .where("known or _any or _lo <> _hi")
              .groupBy("doc_id").agg(F.collect_set("pos").alias("marks")))
    shared = written(shared, "passages-anchors")
    least = F.min(F.when(F.col("stop") == 0, F.col("doc_id"))).over(Window.partitionBy("k1", "k2"))
    end = F.when(F.col("stop") == 0, F.col("start") + 1).otherwise(F.col("stop"))
    spans = (known.join(shared, "doc_id").select("doc_id", "ver", "text", "marks").mapInArrow(_windows(window), _SPANS)
             .withColumn("_least", least).where((F.col("stop") > 0) | (F.col("doc_id") > F.col("_least")))
             .groupBy("doc_id", "ver").agg(F.collect_set(F.struct("start", end.alias("stop"))).alias("spans")))
    spans = written(spans, "passages-spans")
    kinds = dict(docs.dtypes)
    out = "doc_id long, n_words long, n_removed long, removed array<struct<start:int,stop:int>>, text string"
    out += "".join(f", carry_{i} {kinds[f'carry_{i}']}" for i in range(len(carry)))
    # the texts grow with the documents, so neither side of this join is ever broadcast
    cut = docs.hint("merge").join(spans, ["doc_id", "ver"], "left").mapInArrow(_remove(window, keep_layout, carry), out)
    return cut.withColumnsRenamed({f"carry_{i}": c for i, c in enumerate(carry)})


def sql(table: str = "documents", window: int = WINDOW) -> str:
    """The per-document counts and the kept words' digest as DuckDB SQL."""
    return f"""
WITH d AS (SELECT row_number() OVER () AS rid, doc_id, regexp_extract_all(coalesce(text, ''), '[^\\x20\\x09-\\x0D]+') AS w FROM {table}),
win AS (SELECT rid, doc_id, i, md5(array_to_string(w[i:i + {window - 1}], ' ')) AS k FROM
        (SELECT rid, doc_id, w, unnest(range(1, len(w) - {window - 2})) AS i FROM d WHERE len(w) >= {window})),
first AS (SELECT k, min(doc_id) AS m FROM win GROUP BY k),
hit AS (SELECT rid, i FROM win JOIN first USING (k) WHERE doc_id > m),
gone AS (SELECT DISTINCT rid, unnest(range(i, i + {window})) AS p FROM hit),
word AS (SELECT rid, unnest(w) AS x, unnest(range(1, len(w) + 1)) AS p FROM d),
kept AS (SELECT rid, string_agg(x, ' ' ORDER BY p) AS t, count(*) AS c FROM word ANTI JOIN gone USING (rid, p) GROUP BY rid)
SELECT doc_id, len(w)::BIGINT AS n_words, (len(w) - coalesce(c, 0))::BIGINT AS n_removed, sha256(coalesce(t, '')) AS kept_sha256
FROM d LEFT JOIN kept USING (rid)"""
