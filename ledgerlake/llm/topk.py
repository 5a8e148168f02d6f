"""Exact top-k search by columnar branch and bound.

Candidates lie in cells: classes of like norm, dealt by hash into stripes. A
task holds a block of queries with their heaps of the k best and streams a
cell's candidates through them in tiles, kept vertically, a few dimensions to a
slab. For a query, inner products are accumulated slab by slab, those first in
which the query has most of its mass; what the other slabs can add is bounded
by the product of the remaining norms, and candidates whose bound stays below
the query's threshold are compacted away. After a quarter of the slabs the most
promising candidates are scored in full, which raises the threshold; every tile
raises it further.

Search runs twice: first each query meets one stripe of the class with the
largest norms, which gives it a threshold of its own; then the other cells, but
only those whose largest norm times the query's norm reaches its threshold. A
cell is copied to a block of queries only if one of them may find something in
it (a stated query set against all rows, in blocks).

Components are integers, floor(scale * x) of x as double. In doubles scores are
exact while they stay below 2**52; beyond, doubles with a margin for their
rounding choose the survivors, and those are scored in Python integers (a score
beyond 64 bits is an error).

Defined cases: rows with a null id or vector, or with a null or non-finite
component, take no part; repeated rows count once; vectors of another length
than the query's are no candidates; a query never finds its own id; an empty
table gives an empty table; further columns, whatever their names, are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ledgerlake.llm.tables import columns, written

QUERY_BLOCK = 2048
STRIPE = 65536  # candidates of a cell
TILE = 4096  # candidates a query looks at together
CLASSES = 8  # of norms
DIMENSIONS = 8  # of a slab
SEEDS = 16  # candidates scored in full after a quarter of the slabs
SCALE = 256
EXACT = 2.0**52


class Tile:
    """Candidates in vertical layout: whole numbers in doubles, dimensions x rows, with the mass of each slab."""

    def __init__(self, ids: np.ndarray, vectors: np.ndarray):
        self.ids, self.vectors = ids, np.ascontiguousarray(vectors.T)
        n = len(self.vectors)
        self.slabs = [slice(a, min(a + DIMENSIONS, n)) for a in range(0, n, DIMENSIONS)]
        square = self.vectors * self.vectors
        self.mass = np.array([square[s].sum(axis=0) for s in self.slabs]).reshape(len(self.slabs), len(ids))
        self.largest = float(np.sqrt(self.mass.sum(axis=0).max(initial=0)))


class Query:
    """A query, its k best so far and the score below which nothing matters."""

    def __init__(self, own: int, vector: np.ndarray, low: int | None, k: int):
        self.own, self.vector, self.low, self.k = own, vector, low, k
        self.best: list[tuple[int, int]] = []  # (-score, id)
        self.norm = float(np.sqrt(vector @ vector))
        self.steps = 0  # multiply-adds

    def threshold(self) -> float:
        full = -self.best[-1][0] if len(self.best) == self.k else None
        known = [x for x in (full, self.low) if x is not None]
        return max(known) if known else -np.inf

    def take(self, ids, scores) -> None:
        self.best = sorted({*self.best, *zip((-s for s in scores), ids, strict=True)})[:self.k]

    def look(self, tile: Tile) -> None:
        """Find what the tile adds to the best."""
        exact = self.norm * tile.largest < EXACT
        margin = 1e-6 if exact else 1e-12 * self.norm * tile.largest
        if self.norm * tile.largest * (1 + 1e-9) + margin < self.threshold():
            return
        mass = np.array([self.vector[s] @ self.vector[s] for s in tile.slabs])
        order = np.argsort(-mass, kind="stable")
        left = np.sqrt(np.r_[np.cumsum(mass[order][::-1])[::-1][1:], 0])
        alive = np.flatnonzero(tile.ids != self.own)
        part, rest = np.zeros(len(alive)), tile.mass.sum(axis=0)[alive]
        for i, slab in enumerate(order):
            s = tile.slabs[slab]
            every = len(alive) == len(tile.ids)
            part = part + self.vector[s] @ (tile.vectors[s] if every else tile.vectors[s, alive])
            rest = rest - (tile.mass[slab] if every else tile.mass[slab, alive])
            self.steps += (s.stop - s.start) * len(alive)
            if i == len(order) // 4 and i + 1 < len(order) and len(alive) > 2 * SEEDS:
                seeds = alive[np.argpartition(-part, SEEDS)[:SEEDS]]
                self.steps += len(self.vector) * len(seeds)
                self._score(tile, seeds, exact)
            bound = part + left[i] * np.sqrt(np.maximum(rest, 0)) * (1 + 1e-9) + margin
            keep = bound >= self.threshold()
            if not keep.all():
                alive, part, rest = alive[keep], part[keep], rest[keep]
        if len(alive) > self.k and exact:
            alive = alive[np.lexsort((tile.ids[alive], -part))[:self.k + len(self.best)]]
        self._score(tile, alive, exact)

    def _score(self, tile: Tile, rows: np.ndarray, exact: bool) -> None:
        if exact:
            scores = (self.vector @ tile.vectors[:, rows]).astype(np.int64).tolist()
        else:
            own = [int(x) for x in self.vector]
            scores = [sum(a * int(b) for a, b in zip(own, tile.vectors[:, r], strict=True)) for r in rows.tolist()]
        self.take(tile.ids[rows].tolist(), scores)


def _vectors(col: pa.Array, scale: int) -> np.ndarray:
    flat = col.flatten().to_numpy(zero_copy_only=False)
    return np.floor(scale * flat.reshape(len(col), -1 if len(flat) else 0))


def _search(k: int, scale: int):
    """Stream sorted cells: the queries of a block (side 0), then the cell's candidates."""

    def results(queries: list[Query]) -> pa.RecordBatch:
        rows = [(q.own, i, -s) for q in queries for s, i in q.best]
        cols = zip(*rows, strict=True) if rows else ([], [], [])
        return pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in cols], ["query_id", "vec_id", "score"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, queries, held = None, [], []

        def flush():
            if held and queries:
                rows = pa.Table.from_batches(held).combine_chunks().to_batches()[0]
                tile = Tile(rows.column("vec_id").to_numpy(), _vectors(rows.column("v"), scale))
                for q in queries:
                    q.look(tile)
            held.clear()

        for batch in batches:
            marks = [batch.column(c).to_numpy() for c in ("dim", "class", "stripe", "block", "side")]
            cut = np.flatnonzero(np.any([c[1:] != c[:-1] for c in marks], axis=0)) + 1 if len(batch) else []
            for a, b in zip([0, *cut], [*cut, len(batch)], strict=True):
                if a == b:
                    continue
                here = tuple(int(c[a]) for c in marks[:4])
                if here != key:
                    flush()
                    if queries:
                        yield results(queries)
                    key, queries = here, []
                rows = batch.slice(a, b - a)
                if marks[4][a] == 0:
                    lows = rows.column("low").to_pylist()
                    queries += [Query(i, v, low, k) for i, v, low in
                                zip(rows.column("vec_id").to_pylist(), _vectors(rows.column("v"), scale), lows, strict=True)]
                else:
                    for at in range(0, len(rows), TILE):
                        held.append(rows.slice(at, TILE))
                        if sum(map(len, held)) >= TILE:
                            flush()
        flush()
        if queries:
            yield results(queries)

    return run


def usable(vectors: DataFrame, vector_col: str = "embedding") -> DataFrame:
    """(vec_id, v) of the rows that take part, each once."""
    v = columns(vectors, ["vec_id", vector_col]).select(F.col("vec_id").cast("long"), F.col(f"`{vector_col}`").cast("array<double>").alias("v"))
    finite = F.forall("v", lambda x: F.coalesce(F.abs(x) < float("inf"), F.lit(False)))
    return v.where(F.col("vec_id").isNotNull() & F.col("v").isNotNull() & finite).distinct()


def _meet(queries: DataFrame, candidates: DataFrame, cells: DataFrame, k: int, scale: int) -> DataFrame:
    """Each cell's candidates with the blocks of queries (with ``low``) that may find something in it."""
    may = F.col("low").isNull() | (F.col("norm") * F.col("largest") * (1 + 1e-9) + 1 >= F.col("low"))
    left = (queries.join(cells.withColumnRenamed("dim", "_dim"), F.col("dim") == F.col("_dim")).where(may)
            .withColumn("block", F.pmod(F.xxhash64("vec_id"), F.col("blocks")).cast("int"))
            .select("dim", "class", "stripe", "block", F.lit(0).alias("side"), "vec_id", "v", "low"))
    # a row a cell and block: written, so that its size is known before candidates would be shuffled to meet it
    pairs = written(left.select("dim", "class", "stripe", "block").distinct(), "topk-pairs")
    right = candidates.join(pairs, ["dim", "class", "stripe"]).select(
        "dim", "class", "stripe", "block", F.lit(1).alias("side"), "vec_id", "v", F.lit(None).cast("long").alias("low"))
    cell = ["dim", "class", "stripe", "block"]
    return (left.unionByName(right).repartition(*cell).sortWithinPartitions(*cell, "side")
            .mapInArrow(_search(k, scale), "query_id long, vec_id long, score long"))


def top_k(vectors: DataFrame, query_filter, k: int = 5, scale: int = SCALE, vector_col: str = "embedding") -> DataFrame:
    """query_id, rank, vec_id, score: the k largest inner products of each row that passes ``query_filter``, ties to smaller ids."""
    square = F.aggregate("v", F.lit(0.0), lambda a, x: a + F.floor(scale * x).cast("double") * F.floor(scale * x).cast("double"))
    rows = written(usable(vectors, vector_col).withColumn("norm", F.sqrt(square)).withColumn("dim", F.size("v")), "topk-rows")
    cores = rows.sparkSession.sparkContext.defaultParallelism
    steps = [i / CLASSES for i in range(1, CLASSES)]
    # a row a vector length: class limits, and how many stripes and blocks of queries its rows ask for
    dims = rows.groupBy("dim").agg(F.count(F.lit(1)).alias("n"), F.count_if(query_filter).alias("m"),
                                   F.percentile_approx("norm", steps, 1000).alias("limits")).where("m > 0")
    dims = written(dims.select("dim", "limits", F.ceil(F.col("m") / QUERY_BLOCK).cast("int").alias("blocks")), "topk-dims")
    above = lambda x: F.size(F.filter("limits", lambda y: y < x))
    classed = written(rows.join(dims, "dim").withColumn("class", above(F.col("norm"))).drop("limits"), "topk-classed")
    sizes = classed.groupBy("dim", "class").agg(F.count(F.lit(1)).alias("n"), F.max("norm").alias("largest"))
    stripes = F.greatest(F.ceil(F.col("n") / STRIPE), F.least(F.ceil(F.col("n") / TILE), F.lit(cores))).cast("int")
    sizes = written(sizes.select("dim", "class", "largest", stripes.alias("stripes")), "topk-cells")
    spread = F.pmod(F.xxhash64("vec_id"), F.col("stripes")).cast("int")
    candidates = classed.join(sizes.drop("largest"), ["dim", "class"]).withColumn("stripe", spread).select("dim", "class", "stripe", "vec_id", "v")
    cells = sizes.withColumn("stripe", F.explode(F.sequence(F.lit(0), F.col("stripes") - 1))).select("dim", "class", "stripe", "largest")
    first = (F.col("class") == F.max("class").over(Window.partitionBy("dim"))) & (F.col("stripe") == 0)
    cells = cells.withColumn("first", first)
    queries = classed.where(query_filter).select("dim", "blocks", "norm", "vec_id", "v")
    start = written(_meet(queries.withColumn("low", F.lit(None).cast("long")), candidates, cells.where("first"), k, scale), "topk-start")
    order = Window.partitionBy("query_id").orderBy(F.col("score").desc(), "vec_id")
    best = lambda found: found.distinct().withColumn("rank", F.row_number().over(order))
    lows = best(start).where(F.col("rank") == k).select(F.col("query_id").alias("_id"), F.col("score").alias("low"))
    known = queries.join(lows, F.col("vec_id") == F.col("_id"), "left").drop("_id")
    found = _meet(known, candidates, cells.where("not first"), k, scale)
    return best(start.unionByName(found)).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


def sql(table: str = "embeddings", k: int = 5, every: int = 50) -> str:
    return f"""
WITH v AS (SELECT DISTINCT vec_id, [floor({SCALE} * x::DOUBLE) for x in embedding] AS e FROM {table}
           WHERE vec_id IS NOT NULL AND embedding IS NOT NULL
           AND len([x for x in embedding if x IS NULL OR NOT isfinite(x::DOUBLE)]) = 0),
s AS (SELECT DISTINCT q.vec_id AS query_id, c.vec_id, CASE WHEN len(q.e) = 0 THEN 0 ELSE list_dot_product(q.e, c.e)::BIGINT END AS score
      FROM v q JOIN v c ON q.vec_id % {every} = 0 AND q.vec_id <> c.vec_id AND len(q.e) = len(c.e)),
r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id)::INTEGER AS rank FROM s)
SELECT query_id, rank, vec_id, score FROM r WHERE rank <= {k}"""
