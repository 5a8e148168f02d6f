"""Hard-negative mining with Strassen products of integer tiles and mergeable heaps.

For each anchor: its positives, the ``n_positives`` other rows of its label
with the highest scores, and for each positive the ``n_negatives`` best rows of
other labels whose score lies in a window relative to the positive's score:
low * positive <= 100 * negative <= high * positive (low, high in per cent).
Scores are integer inner products of floor(scale * x); ties go to smaller ids.

Method. Anchors and candidates meet in tiles of a block and a stripe. Products
of tiles are Strassen's recursion on int64 matrices padded with zeros: seven
half-size products and exact integer additions. Integer arithmetic modulo
2**64 is a ring, so each score that fits 64 bits is exact whatever the
intermediate sums do. First only tiles of one label are multiplied, for the
positives; then all tiles for the windows. A task holds one block of anchors
with their heaps and streams its stripe of candidates through them; heaps are
sorted arrays of the k best and merge. The heaps of all stripes are merged by
a ranked window, which limits itself before the shuffle.

Skew. A label's rows are dealt over as many stripes as its size asks for, so a
label with a third of all rows is many tasks of the same size.

Defined cases: rows with a null id, label or vector or with a null or
non-finite component take no part; of rows that share an id the one with the
smallest (label, vector) stands; rows whose vectors differ in length do not
meet; empty vectors have score 0; an anchor without another row of its label
has no positive and gives no row; a block whose norms allow scores of 2**62 is
multiplied in Python integers, and a score beyond 64 bits is an error; an empty
table gives an empty table; further columns, whatever their names, are ignored.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ledgerlake.llm.tables import columns, salted_left_join, written

SCALE = 256
POSITIVES, NEGATIVES = 5, 10
LOW, HIGH = 30, 90  # per cent of the positive's score
ANCHOR_BLOCK = 4096
STRIPE = 65536  # candidates a task streams through a block of anchors
TILE = 1024  # candidates, and anchors, multiplied at a time
LEAF = 16  # Strassen stops when a side is not longer
NONE = np.iinfo(np.int64).min


def strassen(a: np.ndarray, b: np.ndarray, leaf: int = LEAF) -> np.ndarray:
    """The product of integer matrices (m x d) and (d x n), exact modulo 2**64 (or without bound for object arrays)."""
    m, d = a.shape
    n = b.shape[1]
    halvings, least = 0, min(m, d, n)
    while least > leaf:
        least, halvings = -(-least // 2), halvings + 1
    unit = 1 << halvings
    return _recurse(_padded(a, unit), _padded(b, unit), halvings)[:m, :n]


def _padded(x: np.ndarray, unit: int) -> np.ndarray:
    out = np.zeros([-(-n // unit) * unit for n in x.shape], x.dtype)
    out[:x.shape[0], :x.shape[1]] = x
    return out


def _recurse(a: np.ndarray, b: np.ndarray, halvings: int) -> np.ndarray:
    if not halvings:
        return a @ b
    (m, d), n = (x // 2 for x in a.shape), b.shape[1] // 2
    a11, a12, a21, a22 = a[:m, :d], a[:m, d:], a[m:, :d], a[m:, d:]
    b11, b12, b21, b22 = b[:d, :n], b[:d, n:], b[d:, :n], b[d:, n:]
    p1 = _recurse(a11 + a22, b11 + b22, halvings - 1)
    p2 = _recurse(a21 + a22, b11, halvings - 1)
    p3 = _recurse(a11, b12 - b22, halvings - 1)
    p4 = _recurse(a22, b21 - b11, halvings - 1)
    p5 = _recurse(a11 + a12, b22, halvings - 1)
    p6 = _recurse(a21 - a11, b11 + b12, halvings - 1)
    p7 = _recurse(a12 - a22, b21 + b22, halvings - 1)
    out = np.empty((2 * m, 2 * n), p1.dtype)
    out[:m, :n] = p1 + p4 - p5 + p7
    out[:m, n:] = p3 + p5
    out[m:, :n] = p2 + p4
    out[m:, n:] = p1 - p2 + p3 + p6
    return out


def tile_scores(a: np.ndarray, c: np.ndarray) -> np.ndarray:
    """Integer inner products of the rows of two float matrices of whole numbers."""
    largest = np.sqrt((a * a).sum(axis=1).max(initial=0)) * np.sqrt((c * c).sum(axis=1).max(initial=0))
    if largest < 2.0**62 and max(np.abs(a).max(initial=0), np.abs(c).max(initial=0)) < 2.0**62:
        return strassen(a.astype(np.int64), c.astype(np.int64).T)
    whole = np.frompyfunc(int, 1, 1)
    return strassen(whole(a), whole(c).T).astype(np.int64)


class Heaps:
    """One bounded heap a row: the k best (score, id), best first; ties to smaller ids."""

    def __init__(self, rows: int, k: int):
        self.score = np.full((rows, k), NONE)
        self.id = np.full((rows, k), np.iinfo(np.int64).max)

    def merge(self, score: np.ndarray, ids: np.ndarray, at: slice = slice(None)) -> None:
        """Take further entries into the rows ``at``; entries of score NONE are empty."""
        k = self.score.shape[1]
        score, ids = np.hstack([self.score[at], score]), np.hstack([self.id[at], ids])
        order = np.argsort(ids, axis=1, kind="stable")
        score, ids = np.take_along_axis(score, order, 1), np.take_along_axis(ids, order, 1)
        order = np.argsort(~score, axis=1, kind="stable")[:, :k]  # ~x falls as x rises and cannot overflow
        self.score[at], self.id[at] = np.take_along_axis(score, order, 1), np.take_along_axis(ids, order, 1)


def _vectors(col: pa.Array, rows: np.ndarray, scale: int) -> np.ndarray:
    """The chosen rows of a list column, all of one length, as whole numbers in doubles."""
    flat = col.take(pa.array(rows)).flatten().to_numpy(zero_copy_only=False)
    return np.floor(scale * flat.reshape(len(rows), -1 if len(flat) else 0))


class _PositiveBlock:
    """The best other rows of one label."""

    fields = ("anchor_id", "positive_id", "positive_score")

    def __init__(self, rows: pa.RecordBatch, k: int):
        self.ids = rows.column("id").to_numpy()
        self.heaps = Heaps(len(self.ids), k)

    def take(self, at: slice, scores: np.ndarray, ids: np.ndarray, labels: np.ndarray) -> None:
        own = self.ids[at, None] == ids[None, :]
        scores = np.where(own, NONE, scores)
        # ids rise within a tile, so equal scores are already in the right order
        best = np.argsort(~scores, axis=1, kind="stable")[:, :self.heaps.score.shape[1]]
        self.heaps.merge(np.take_along_axis(scores, best, 1), ids[best], at)

    def result(self) -> pa.RecordBatch:
        full = self.heaps.score != NONE
        row, _ = np.nonzero(full)
        return pa.RecordBatch.from_arrays(
            [pa.array(self.ids[row]), pa.array(self.heaps.id[full]), pa.array(self.heaps.score[full])], list(self.fields))


class _WindowBlock:
    """Per anchor and positive, the best rows of other labels within the window of scores."""

    fields = ("anchor_id", "place", "negative_id", "negative_score")

    def __init__(self, rows: pa.RecordBatch, k: int):
        self.ids = rows.column("id").to_numpy()
        self.labels = rows.column("label").to_numpy()
        low, high = rows.column("low").to_pylist(), rows.column("high").to_pylist()
        width = max(map(len, low))
        self.low = np.array([x + [0] * (width - len(x)) for x in low], np.int64)
        self.high = np.array([x + [-1] * (width - len(x)) for x in high], np.int64)  # an empty window
        self.heaps = [Heaps(len(self.ids), k) for _ in range(width)]

    def take(self, at: slice, scores: np.ndarray, ids: np.ndarray, labels: np.ndarray) -> None:
        scores = np.where(self.labels[at, None] == labels[None, :], NONE, scores)
        order = np.argsort(~scores, axis=1, kind="stable")
        falling = np.take_along_axis(scores, order, 1)
        for place, heaps in enumerate(self.heaps):
            low, high = self.low[at, place], self.high[at, place]
            k = heaps.score.shape[1]
            reach = (falling > high[:, None]).sum(axis=1)[:, None] + np.arange(k)
            inside = np.minimum(reach, falling.shape[1] - 1)
            found = np.take_along_axis(falling, inside, 1)
            fits = (reach < falling.shape[1]) & (found >= low[:, None]) & (found != NONE)
            if fits.any():
                heaps.merge(np.where(fits, found, NONE), ids[np.take_along_axis(order, inside, 1)], at)

    def result(self) -> pa.RecordBatch:
        out = []
        for place, heaps in enumerate(self.heaps):
            full = heaps.score != NONE
            row, _ = np.nonzero(full)
            out.append([self.ids[row], np.full(len(row), place, np.int32), heaps.id[full], heaps.score[full]])
        return pa.RecordBatch.from_arrays([pa.array(np.concatenate(x)) for x in zip(*out, strict=True)], list(self.fields))


def _tiles(block: Callable[[pa.RecordBatch, int], object], k: int, scale: int, keys: list[str]):
    """Stream sorted groups: the anchors of a block (side 0), then its candidates."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, anchors, state, mine = None, [], None, None
        for batch in batches:
            cols = [batch.column(c).to_numpy() for c in keys]
            side = batch.column("side").to_numpy()
            cut = np.flatnonzero(np.any([c[1:] != c[:-1] for c in [*cols, side]], axis=0)) + 1 if len(batch) else []
            for a, b in zip([0, *cut], [*cut, len(batch)], strict=True):
                if a == b:
                    continue
                here = tuple(int(c[a]) for c in cols)
                if here != key:
                    if state is not None:
                        yield state.result()
                    key, anchors, state = here, [], None
                rows = batch.slice(a, b - a)
                if side[a] == 0:
                    anchors.append(rows)
                    continue
                if state is None:
                    if not anchors:
                        continue  # no anchor of this block: nothing to look for
                    own = pa.Table.from_batches(anchors).combine_chunks().to_batches()[0]
                    state, anchors = block(own, k), []
                    mine = _vectors(own.column("v"), np.arange(len(own)), scale)
                ids, labels = rows.column("id").to_numpy(), rows.column("label").to_numpy()
                order = np.argsort(ids, kind="stable")
                for at in range(0, len(order), TILE):
                    pick = order[at:at + TILE]
                    theirs = _vectors(rows.column("v"), pick, scale)
                    for low in range(0, len(mine), TILE):
                        part = slice(low, min(low + TILE, len(mine)))
                        state.take(part, tile_scores(mine[part], theirs), ids[pick], labels[pick])
        if state is not None:
            yield state.result()

    return run


def usable(vectors: DataFrame, label: Column, vector_col: str) -> DataFrame:
    """(id, label, v, dim) of the rows that take part, one an id."""
    finite = F.forall("v", lambda x: F.coalesce(F.abs(x) < float("inf"), F.lit(False)))
    return (columns(vectors.withColumn("_label", label.cast("long")), ["vec_id", "_label", vector_col])
            .select(F.col("vec_id").cast("long").alias("id"), F.col("_label").alias("label"),
                    F.col(f"`{vector_col}`").cast("array<double>").alias("v"))
            .where(F.col("id").isNotNull() & F.col("label").isNotNull() & F.col("v").isNotNull() & finite)
            .groupBy("id").agg(F.min(F.struct("label", "v")).alias("r"))
            .select("id", "r.label", "r.v", F.size("r.v").alias("dim")))


def _meet(anchors: DataFrame, rows: DataFrame, by: list[str], kernel, out: str) -> DataFrame:
    """Each block of anchors with each stripe of the candidates that agree with it in ``by``, in one task."""
    spark = rows.sparkSession
    cores = spark.sparkContext.defaultParallelism
    sizes = (rows.groupBy(*by).agg(F.count(F.lit(1)).alias("n"))
             .join(anchors.groupBy(*by).agg(F.count(F.lit(1)).alias("m")), by)
             .select(*by, F.ceil(F.col("m") / ANCHOR_BLOCK).cast("int").alias("blocks"),
                     F.greatest(F.ceil(F.col("n") / STRIPE), F.least(F.ceil(F.col("n") / TILE), F.lit(cores))).cast("int").alias("stripes")))
    place = lambda n: F.pmod(F.xxhash64("id"), n).cast("int")
    every = lambda n: F.explode(F.sequence(F.lit(0), n - 1))
    sized = lambda df: salted_left_join(df, sizes, by, F.col("id")).where("blocks is not null")
    none = F.lit(None).cast("array<long>")
    payload = [c for c in ("id", "label", "v") if c not in by]
    left = (sized(anchors).withColumn("block", place(F.col("blocks"))).withColumn("stripe", every(F.col("stripes")))
            .select(*by, "block", "stripe", F.lit(0).alias("side"), *payload, "low", "high"))
    right = (sized(rows).withColumn("stripe", place(F.col("stripes"))).withColumn("block", every(F.col("blocks")))
             .select(*by, "block", "stripe", F.lit(1).alias("side"), *payload, none.alias("low"), none.alias("high")))
    keys = [*by, "block", "stripe"]
    return (left.unionByName(right).repartition(*keys).sortWithinPartitions(*keys, "side")
            .mapInArrow(kernel(keys), out))


def hard_negatives(vectors: DataFrame, is_anchor: Column, label: Column | None = None, n_positives: int = POSITIVES,
                   n_negatives: int = NEGATIVES, low: int = LOW, high: int = HIGH, scale: int = SCALE,
                   vector_col: str = "embedding") -> DataFrame:
    """anchor_id, positive_id, rank, negative_id, positive_score, negative_score.

    ``is_anchor`` is a condition on the column ``id``; ``label`` an expression
    over ``vectors`` (default: its column label).
    """
    label = F.col("label") if label is None else label
    rows = written(usable(vectors, label, vector_col), "negatives-rows")
    none = F.lit(None).cast("array<long>")
    anchors = rows.where(is_anchor).withColumn("low", none).withColumn("high", none)
    pairs = _meet(anchors, rows, ["dim", "label"],
                  lambda keys: _tiles(_PositiveBlock, n_positives, scale, keys),
                  "anchor_id long, positive_id long, positive_score long")
    best = Window.partitionBy("anchor_id").orderBy(F.col("positive_score").desc(), "positive_id")
    positives = written(pairs.withColumn("place", F.row_number().over(best) - 1).where(F.col("place") < n_positives),
                        "negatives-positives")
    # whole bounds of the window; decimals cannot overflow
    score = F.col("positive_score").cast("decimal(20,0)")
    bounds = positives.select("anchor_id", "place", F.ceil(score * low / 100).cast("long").alias("low"),
                              F.floor(score * high / 100).cast("long").alias("high"))
    windows = bounds.groupBy("anchor_id").agg(F.array_sort(F.collect_list(F.struct("place", "low", "high"))).alias("w")).select(
        F.col("anchor_id").alias("id"), F.col("w.low").alias("low"), F.col("w.high").alias("high"))
    found = _meet(rows.where(is_anchor).join(windows, "id"), rows, ["dim"],
                  lambda keys: _tiles(_WindowBlock, n_negatives, scale, keys),
                  "anchor_id long, place int, negative_id long, negative_score long")
    first = Window.partitionBy("anchor_id", "place").orderBy(F.col("negative_score").desc(), "negative_id")
    ranked = found.withColumn("rank", F.row_number().over(first)).where(F.col("rank") <= n_negatives)
    return ranked.join(positives, ["anchor_id", "place"]).select(
        "anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score")


def sql(table: str = "embeddings", every: int = 100) -> str:
    """The mined rows as DuckDB SQL, with the labels moved where vec_id is divisible by 7."""
    return f"""
WITH v AS (SELECT vec_id AS id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label,
           [floor({SCALE} * x::DOUBLE) for x in embedding] AS e FROM {table}
           WHERE vec_id IS NOT NULL AND label IS NOT NULL AND embedding IS NOT NULL
           AND len([x for x in embedding if x IS NULL OR NOT isfinite(x::DOUBLE)]) = 0
           QUALIFY row_number() OVER (PARTITION BY vec_id ORDER BY CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END, embedding) = 1),
s AS (SELECT a.id AS anchor_id, a.label AS al, c.id, c.label AS cl,
      CASE WHEN len(a.e) = 0 THEN 0 ELSE list_dot_product(a.e, c.e)::BIGINT END AS score
      FROM v a JOIN v c ON a.id % {every} = 0 AND a.id <> c.id AND len(a.e) = len(c.e)),
p AS (SELECT anchor_id, id AS positive_id, score AS positive_score FROM s WHERE al = cl
      QUALIFY row_number() OVER (PARTITION BY anchor_id ORDER BY score DESC, id) <= {POSITIVES}),
n AS (SELECT p.*, s.id AS negative_id, s.score AS negative_score FROM p JOIN s USING (anchor_id)
      WHERE al <> cl AND {LOW} * positive_score <= 100 * score AND 100 * score <= {HIGH} * positive_score)
SELECT anchor_id, positive_id, row_number() OVER (PARTITION BY anchor_id, positive_id ORDER BY negative_score DESC, negative_id)::INTEGER AS rank,
  negative_id, positive_score, negative_score
FROM n QUALIFY rank <= {NEGATIVES}"""
