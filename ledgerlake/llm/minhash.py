"""Near-duplicate documents by an inverted join of MinHash signature coordinates, confirmed on full shingle sets.

A document's set is its distinct ``shingle``-word shingles (A-Z lower-cased).
Two sets are linked if 100 * intersection >= 100 * threshold * union, exactly.

Method.
1. Each distinct set gets a signature of ``COORDINATES`` minima. Equal sets
   form one class, and only one row of a class goes on.
2. Every class is posted under its (coordinate, value) pairs. Pairs that one
   class alone holds are skipped, they cannot collide.
3. Prefix: a pair with ``MATCHES`` collisions must share a posting among the
   COORDINATES - MATCHES + 1 rarest of each side, so the long lists are
   skipped and only those rarest postings are merged.
4. Inside one list collisions are counted over whole signatures, and pairs at
   or above MATCHES are joined to families. A list yields a spanning forest,
   never all its pairs, and a list over LIST_BLOCK long is dealt in pairs of
   blocks.
5. Inside a family the full sets are compared; families over SET_BLOCK
   shingles are dealt in pairs of blocks. The links found (again a spanning
   forest) give the components.

At a similarity of 0.8 a pair has fewer than MATCHES of COORDINATES collisions
with a probability of 3e-7; every link that is returned is confirmed exactly
(sets of 64-bit shingle hashes).

Defined cases: a null or empty text has an empty set and is linked with
nothing; a text with fewer words than a shingle has one shingle, the whole
sequence; rows that share a doc_id are one document, all of one component; a
row with a null doc_id has a null component and is kept; a very long text is
signed from its distinct shingles, whole; an empty table gives an empty table;
further columns, whatever their names, are ignored.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ledgerlake.llm.components import components
from ledgerlake.llm.tables import columns, salted_left_join, written
from ledgerlake.llm.words import WORD_BASES, U, Words, mix, ranged_hash, slices

SHINGLE = 2
THRESHOLD = 0.8
COORDINATES = 64
MATCHES = 34
LIST_BLOCK = 4096
SET_BLOCK = 1_000_000
SLICE = 1 << 20

_SIGNED = "doc_id long, n_shingles long, s1 long, s2 long, sig array<int>, sig8 binary"


def _sets(w: Words, size: int) -> list[np.ndarray]:
    """Per document the sorted distinct shingle hashes."""
    h = w.hashes()
    lengths = np.diff(w.bounds)
    out = []
    at = np.arange(len(h) - size + 1) if len(h) >= size else np.empty(0, np.int64)
    grams = mix(ranged_hash(h, at, at + size, WORD_BASES[0]))
    for d, n in enumerate(lengths.tolist()):
        a = int(w.bounds[d])
        if n >= size:
            out.append(np.unique(grams[a:a + n - size + 1]))
        elif n:
            out.append(mix(ranged_hash(h, np.array([a]), np.array([a + n]), WORD_BASES[1])))
        else:
            out.append(np.empty(0, U))
    return out


def _sign(size: int, coordinates: int) -> Callable:
    rnd = np.random.default_rng(20)
    mult = rnd.integers(1, 1 << 63, coordinates, dtype=np.uint64) * U(2) + U(1)
    plus = rnd.integers(0, 1 << 63, coordinates, dtype=np.uint64)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, "text", SLICE):
                sets = _sets(Words(part.column("text"), lower=True), size)
                n = np.array([len(s) for s in sets], np.int64)
                full = np.flatnonzero(n)
                sig = np.zeros((len(part), coordinates), np.uint32)
                s1, s2 = np.zeros(len(part), U), np.zeros(len(part), U)
                if len(full):
                    flat = np.concatenate([sets[i] for i in full])
                    first = np.r_[0, np.cumsum(n[full])[:-1]]
                    for k in range(coordinates):
                        sig[full, k] = np.minimum.reduceat(((flat ^ plus[k]) * mult[k]) >> U(32), first)
                    s1[full] = np.add.reduceat(mix(flat + U(1)), first)
                    s2[full] = np.add.reduceat(mix(flat ^ plus[0]), first)
                flat_sig = pa.array(sig.view(np.int32).ravel())
                offsets = pa.array(np.arange(len(part) + 1, dtype=np.int32) * coordinates)
                small = sig.astype(np.uint8)
                yield pa.RecordBatch.from_arrays(
                    [part.column("doc_id"), pa.array(n), pa.array(s1.view(np.int64)), pa.array(s2.view(np.int64)),
                     pa.ListArray.from_arrays(offsets, flat_sig), pa.array([r.tobytes() for r in small], pa.binary())],
                    ["doc_id", "n_shingles", "s1", "s2", "sig", "sig8"])

    return run


def _by_key(batches: Iterator[pa.RecordBatch], keys: list[str]) -> Iterator[pa.Table]:
    """The groups of a stream that is sorted by ``keys``; a group may span batches."""
    held: list[pa.RecordBatch] = []
    last = None
    for batch in batches:
        if not len(batch):
            continue
        cols = [batch.column(k).to_numpy(zero_copy_only=False) for k in keys]
        cut = np.flatnonzero(np.any([c[1:] != c[:-1] for c in cols], axis=0)) + 1
        for a, b in zip([0, *cut.tolist()], [*cut.tolist(), len(batch)], strict=True):
            key = tuple(c[a] for c in cols)
            if held and key != last:
                yield pa.Table.from_batches(held)
                held = []
            held.append(batch.slice(a, b - a))
            last = key
    if held:
        yield pa.Table.from_batches(held)


def _forest(n: int, matches: Callable[[int, np.ndarray], np.ndarray]) -> list[tuple[int, int]]:
    """A spanning forest over 0..n-1; matches(x, rest) says which of rest x is joined to."""
    rest = np.arange(n)
    out = []
    while len(rest) > 1:
        seed, rest = int(rest[0]), rest[1:]
        front = [seed]
        while front and len(rest):
            x = front.pop()
            hit = matches(x, rest)
            if hit.any():
                found = rest[hit].tolist()
                out += [(x, y) for y in found]
                front += found
                rest = rest[~hit]
    return out


def _merge_lists(need: int, threshold: float):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for group in _by_key(batches, ["token", "b1", "b2"]):
            group = group.combine_chunks()
            if len(group) < 2:
                continue
            at = np.argsort(group.column("rep").to_numpy(), kind="stable")
            ids = group.column("rep").to_numpy()[at]
            size = group.column("n").to_numpy()[at].astype(np.float64)
            sig = np.frombuffer(b"".join(group.column("sig8").to_pylist()), np.uint8).reshape(len(group), -1)[at]

            def alike(x, rest, sig=sig, size=size):
                fits = np.minimum(size[rest], size[x]) >= threshold * np.maximum(size[rest], size[x]) - 1e-6
                fits[fits] = (sig[rest[fits]] == sig[x]).sum(axis=1) >= need
                return fits

            edges = _forest(len(ids), alike)
            if edges:
                a, b = np.array(edges).T
                yield pa.RecordBatch.from_arrays([pa.array(ids[a]), pa.array(ids[b])], ["a", "b"])

    return run


def _pack_sets(size: int):
    """The full sets of the members; repeated rows of a document stand next to each other and go as one."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, "text", SLICE):
                sets = [s.tobytes() for s in _sets(Words(part.column("text"), lower=True), size)]
                place = zip(*(part.column(c).to_pylist() for c in ("family", "b1", "b2", "rep")), sets, strict=True)
                first = list({p: i for i, p in reversed(list(enumerate(place)))}.values())
                rows = part.select(["family", "b1", "b2", "rep"]).take(pa.array(first))
                yield pa.RecordBatch.from_arrays([*rows.columns, pa.array([sets[i] for i in first], pa.binary())],
                                                 ["family", "b1", "b2", "rep", "shingles"])

    return run


def _confirm(per_cent: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for group in _by_key(batches, ["family", "b1", "b2"]):
            if len(group) < 2:
                continue
            ids = group.column("rep").to_numpy()
            sets = [np.frombuffer(x.as_buffer(), U) for x in group.column("shingles")]
            size = np.array([len(s) for s in sets], np.int64)
            flat = np.concatenate(sets)
            values, local = np.unique(flat, return_inverse=True)
            del flat
            first = np.r_[0, np.cumsum(size)]
            state = {"n": -1}
            mark = np.zeros(len(values), np.int32)

            def linked(x, rest, size=size, local=local, first=first, state=state, mark=mark):
                if state["n"] != len(rest):  # keep the rest's shingles in one run
                    state["n"] = len(rest)
                    state["flat"] = np.concatenate([local[first[y]:first[y + 1]] for y in rest.tolist()])
                    state["first"] = np.r_[0, np.cumsum(size[rest])[:-1]]
                own = local[first[x]:first[x + 1]]
                mark[own] = 1
                both = np.add.reduceat(mark[state["flat"]], state["first"])
                mark[own] = 0
                return 100 * both >= per_cent * (size[rest] + size[x] - both)

            edges = _forest(len(ids), linked)
            if edges:
                a, b = np.array(edges).T
                yield pa.RecordBatch.from_arrays([pa.array(ids[a]), pa.array(ids[b])], ["a", "b"])

    return run


def near_duplicates(docs: DataFrame, shingle: int = SHINGLE, threshold: float = THRESHOLD) -> DataFrame:
    """doc_id, n_shingles, component_id (smallest doc_id reachable over links), kept (doc_id = component_id)."""
    per_cent = round(100 * threshold)
    docs = columns(docs, ["doc_id", "text"]).withColumn("doc_id", F.col("doc_id").cast("long"))
    signed = written(docs.mapInArrow(_sign(shingle, COORDINATES), _SIGNED), "minhash-signed")
    classes = written(signed.where("doc_id is not null and n_shingles > 0").groupBy("s1", "s2", "n_shingles")
                      .agg(F.min("doc_id").alias("rep"), F.first("sig").alias("sig"), F.first("sig8").alias("sig8")),
                      "minhash-classes")
    # below this size two different sets cannot reach the threshold
    least = next(n for n in range(1, 1001) if 100 * n >= per_cent * (n + 1))
    active = classes.where(F.col("n_shingles") >= least)
    # a doc_id with several texts stands for several classes, so postings go by class (s1), links by document (rep)
    posted = active.select("s1", F.posexplode("sig").alias("k", "v")).select(
        "s1", (F.shiftleft(F.col("k").cast("long"), 32) + F.col("v").cast("long")).alias("token"))
    shared = posted.groupBy("token").agg(F.count(F.lit(1)).alias("df")).where("df > 1")
    prefix = (posted.join(shared, "token")
              .groupBy("s1").agg(F.sort_array(F.collect_list(F.struct("df", "token"))).alias("posts"))
              .where(F.size("posts") >= MATCHES)
              .select("s1", F.slice("posts", 1, F.size("posts") - MATCHES + 1).alias("posts")))
    blocks = F.ceil(F.col("df") / LIST_BLOCK).cast("int")
    own = F.pmod(F.xxhash64("rep"), F.col("nb")).cast("int")
    lists = (active.select("rep", "s1", F.col("n_shingles").alias("n"), "sig8").join(prefix, "s1")
             .select("rep", "n", "sig8", F.explode("posts").alias("p"))
             .select(F.col("p.token").alias("token"), F.col("p.df").alias("df"), "rep", "n", "sig8")
             .withColumn("nb", blocks).transform(lambda d: _block_pairs(d, own))
             .select("token", "b1", "b2", "rep", "n", "sig8"))
    near = (lists.repartition("token", "b1", "b2").sortWithinPartitions("token", "b1", "b2")
            .mapInArrow(_merge_lists(MATCHES, threshold), "a long, b long"))
    families = written(components(near, "minhash-families").select(F.col("node").alias("rep"), F.col("component").alias("family"))
                       .join(classes.groupBy("rep").agg(F.sum("n_shingles").alias("n")), "rep"), "minhash-family-sizes")
    sizes = families.groupBy("family").agg(F.ceil(F.sum("n") / SET_BLOCK).cast("int").alias("nb"))
    placed = families.join(sizes, "family").transform(lambda d: _block_pairs(d, own)).select("family", "b1", "b2", "rep")
    # the members grow with the documents, so their side is never broadcast, at any size
    sets = (docs.where("doc_id is not null").hint("merge").join(placed.withColumnRenamed("rep", "doc_id"), "doc_id")
            .select("family", "b1", "b2", F.col("doc_id").alias("rep"), "text")
            .mapInArrow(_pack_sets(shingle), "family long, b1 int, b2 int, rep long, shingles binary"))
    links = (sets.repartition("family", "b1", "b2").sortWithinPartitions("family", "b1", "b2")
             .mapInArrow(_confirm(per_cent), "a long, b long"))
    of_several = _of_several_classes(signed, classes)
    found = components(links.unionByName(of_several), "minhash-links")
    of_class = classes.join(found.withColumnRenamed("node", "rep"), "rep", "left").select(
        "s1", "s2", "n_shingles", F.coalesce("component", "rep").alias("component_id"))
    full = salted_left_join(signed.where("n_shingles > 0").select("doc_id", "n_shingles", "s1", "s2"), of_class,
                            ["s1", "s2", "n_shingles"], F.col("doc_id"), grows=True).select("doc_id", "n_shingles", "component_id")
    component_of = found.select(F.col("node").alias("doc_id"), F.col("component").alias("component_id"))
    empty = signed.where("n_shingles = 0").select("doc_id", "n_shingles").join(component_of.hint("merge"), "doc_id", "left")
    component = F.when(F.col("doc_id").isNotNull(), F.coalesce("component_id", "doc_id"))
    return full.unionByName(empty).select("doc_id", "n_shingles", component.alias("component_id"),
                                          F.coalesce(component == F.col("doc_id"), F.lit(True)).alias("kept"))


def _of_several_classes(signed: DataFrame, classes: DataFrame) -> DataFrame:
    """Links (a, b) between a doc_id whose rows lie in several classes and the representatives of those classes."""
    key = F.struct("s1", "s2", "n_shingles")
    known = signed.where("doc_id is not null")
    several = known.groupBy("doc_id").agg(F.min(key).alias("lo"), F.max(key).alias("hi")).where("lo <> hi").select("doc_id")
    rows = known.select("doc_id", "s1", "s2", "n_shingles").join(several, "doc_id", "left_semi").distinct()
    return rows.join(classes.select("s1", "s2", "n_shingles", "rep"), ["s1", "s2", "n_shingles"]).select(
        F.col("doc_id").alias("a"), F.col("rep").alias("b"))


def _block_pairs(df: DataFrame, own) -> DataFrame:
    """Each row once per block pair it takes part in: nb blocks, pairs (b1 <= b2)."""
    return (df.withColumn("_b", own).withColumn("_j", F.explode(F.sequence(F.lit(0), F.col("nb") - 1)))
            .withColumn("b1", F.least("_b", "_j")).withColumn("b2", F.greatest("_b", "_j")).drop("_b", "_j"))


def sql(table: str = "documents", threshold: float = THRESHOLD) -> str:
    """The components over 2-word shingles as DuckDB SQL (all pairs that share a shingle)."""
    upper = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
    return f"""
WITH RECURSIVE d AS (SELECT row_number() OVER () AS rid, doc_id,
  regexp_extract_all(translate(coalesce(text, ''), '{upper}', '{upper.lower()}'), '[^\\x20\\x09-\\x0D]+') AS w FROM {table}),
s AS (SELECT DISTINCT rid, w[i] || ' ' || w[i + 1] AS s FROM (SELECT rid, w, unnest(range(1, len(w))) AS i FROM d WHERE len(w) >= 2)
      UNION ALL SELECT rid, w[1] FROM d WHERE len(w) = 1),
n AS (SELECT rid, count(*) AS n FROM s GROUP BY rid),
pair AS (SELECT a.rid AS x, b.rid AS y, count(*) AS c FROM s a JOIN s b ON a.s = b.s AND a.rid < b.rid GROUP BY ALL),
link AS (SELECT dx.doc_id AS a, dy.doc_id AS b FROM pair JOIN n nx ON nx.rid = x JOIN n ny ON ny.rid = y
         JOIN d dx ON dx.rid = x JOIN d dy ON dy.rid = y WHERE 100 * c >= {round(100 * threshold)} * (nx.n + ny.n - c)),
twoway AS (SELECT a, b FROM link UNION SELECT b, a FROM link),
reach(a, b) AS (SELECT a, b FROM twoway UNION SELECT r.a, e.b FROM reach r JOIN twoway e ON r.b = e.a),
comp AS (SELECT a, least(a, min(b)) AS c FROM reach GROUP BY a)
SELECT doc_id, coalesce(n, 0)::BIGINT AS n_shingles, CASE WHEN doc_id IS NOT NULL THEN coalesce(c, doc_id) END AS component_id,
  coalesce(coalesce(c, doc_id) = doc_id, true) AS kept
FROM d LEFT JOIN n USING (rid) LEFT JOIN comp ON comp.a = d.doc_id"""
