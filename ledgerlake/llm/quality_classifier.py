"""Quality scores from compression with dictionaries of good and of bad text.

Two zstandard dictionaries are built from labelled text, one from each class.
The whole text is compressed with either, in runs of ``RUN`` bytes. The difference of the two sizes, over their
sum, says which class it resembles; the logarithm of the smaller size over the
text's own length tells text that repeats itself. A logistic curve fitted on
labelled rows outside the dictionaries turns both into a probability.

Learning uses a bounded sample of labelled rows: ``DICTIONARY_ROWS`` and
``FIT_ROWS`` a class, in the order of a hash of doc_id, with at most
``SAMPLE_BYTES`` of text a class for the dictionaries; a text longer than its
share of them gives ``RUNS`` runs spread evenly from its start to its end.
Scores take the whole text and nothing but the text.

Defined cases: a null or empty text is scored as an empty one; without
labelled rows of both classes every score is 0.5; repeated labels of one
document count once (the larger one); of different texts under one doc_id the
smallest is learnt from, and each is scored; a very long text is compressed run
by run; an empty table gives an empty table; further columns, whatever their
names, are ignored.
"""

from __future__ import annotations

import math
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ledgerlake.llm.tables import columns
from ledgerlake.llm.words import slices

DICTIONARY_ROWS = 800
FIT_ROWS = 1000
SAMPLE_BYTES = 4 << 20
DICTIONARY_BYTES = 256 << 10
RUN = 4 << 10
RUNS = 4  # of a long text in the dictionaries
LEVEL = 3


@dataclass(frozen=True)
class Model:
    good: bytes
    bad: bytes
    weights: tuple[float, ...]  # constant, difference, compressibility; empty: nothing was learnt

    def features(self):
        packers = []
        for data in (self.good, self.bad):
            d = zstandard.ZstdCompressionDict(data, dict_type=zstandard.DICT_TYPE_RAWCONTENT)
            d.precompute_compress(level=LEVEL)
            packers.append(zstandard.ZstdCompressor(dict_data=d, write_content_size=False, write_checksum=False))

        def of(text: str | None) -> tuple[float, float]:
            raw = (text or "").encode("utf-8")
            # in runs, so that the dictionaries weigh as much in a long text as in a short one
            runs = [raw[i:i + RUN] for i in range(0, len(raw), RUN)] or [b""]
            g, b = (sum(len(p.compress(x)) for x in runs) for p in packers)
            return (b - g) / (b + g), math.log(min(g, b) / (len(raw) + 16))

        return of

    def score(self, difference: float, size: float) -> float:
        if not self.weights:
            return 0.5
        z = self.weights[0] + self.weights[1] * difference + self.weights[2] * size
        return 1 / (1 + math.exp(-max(-30.0, min(30.0, z))))


def held_out(doc_id):
    """Rows that nothing is learnt from."""
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 3 == 1, F.lit(False))


def _spread_runs(text, limit: int):
    """The text, or if it is longer than ``limit`` characters RUNS runs of it, evenly spread, a line break between them."""
    size, spare = limit // RUNS, F.length(text) - limit // RUNS
    runs = [text.substr(F.floor(spare * i / (RUNS - 1)).cast("int") + 1, F.lit(size)) for i in range(RUNS)]
    return F.when(F.length(text) <= limit, text).otherwise(F.concat_ws("\n", *runs))


def _dictionary(texts: list[str], size: int) -> bytes:
    """An equal share of each sampled text, spread over it in runs, up to ``size`` bytes."""
    if not texts:
        return b""
    share = max(64, size // len(texts))
    parts = []
    for t in texts:
        raw = t.encode("utf-8")
        runs = max(1, min(4, len(raw) // max(1, share)))
        step = max(1, len(raw) // runs)
        parts += [raw[i * step:i * step + share // runs] for i in range(runs)]
    return b"".join(parts)[-size:]


def _logistic(x: np.ndarray, y: np.ndarray, ridge: float = 1e-2) -> np.ndarray:
    """Weights of a ridge logistic regression with balanced classes, by Newton steps."""
    x = np.c_[np.ones(len(x)), x]
    weight = np.where(y == 1, 0.5 / max(1, y.sum()), 0.5 / max(1, (1 - y).sum())) * len(y)
    w = np.zeros(x.shape[1])
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        gradient = x.T @ (weight * (p - y)) + ridge * w
        step = np.linalg.solve((x * (weight * p * (1 - p))[:, None]).T @ x + ridge * np.eye(len(w)), gradient)
        w = w - step
        if np.abs(step).max() < 1e-8:
            break
    return w


def train(docs: DataFrame, labels: DataFrame) -> Model:
    """Learn from the labelled rows (doc_id, quality) that are not held out."""
    spark = docs.sparkSession
    known = (columns(labels, ["doc_id", "quality"]).where("doc_id is not null and quality in (0, 1)")
             .where(~held_out(F.col("doc_id"))).groupBy("doc_id").agg(F.max("quality").alias("quality")))
    size = DICTIONARY_ROWS + FIT_ROWS
    picked: list[tuple[int, int, bool]] = []
    for q in (0, 1):  # a bounded sample: at most ``size`` ids a class
        ids = [r.doc_id for r in known.where(F.col("quality") == q).orderBy(F.xxhash64("doc_id"), "doc_id").limit(size).collect()]
        cut = min(DICTIONARY_ROWS, (len(ids) + 1) // 2)
        picked += [(i, q, n < cut) for n, i in enumerate(ids)]
    if {q for _, q, _ in picked} != {0, 1}:
        return Model(b"", b"", ())
    chosen = F.broadcast(spark.createDataFrame(picked, "doc_id long, quality int, in_dictionary boolean"))
    rows = (columns(docs, ["doc_id", "text"]).withColumn("text", F.coalesce("text", F.lit("")))
            .join(chosen, "doc_id").groupBy("doc_id", "quality", "in_dictionary").agg(F.min("text").alias("text")))
    texts = (rows.where("in_dictionary").select("doc_id", "quality", _spread_runs(F.col("text"), SAMPLE_BYTES // DICTIONARY_ROWS).alias("text"))
             .orderBy(F.xxhash64("doc_id"), "doc_id").collect())
    # a line that several sampled texts share tells nothing of either class
    shared = Counter(line for r in texts for line in set(r.text.split("\n")))
    own = lambda text: "\n".join(x for x in text.split("\n") if shared[x] == 1)
    good, bad = ([own(r.text) for r in texts if r.quality == q] for q in (1, 0))
    model = Model(_dictionary(good, DICTIONARY_BYTES), _dictionary(bad, DICTIONARY_BYTES), ())
    fit = (rows.where("not in_dictionary").select("doc_id", "quality", "text")
           .mapInArrow(_measure(model, ["quality"]), "quality int, difference double, size double").collect())
    if not fit:
        return model
    x, y = np.array([(r.difference, r.size) for r in fit]), np.array([r.quality for r in fit])
    order = np.lexsort((y, x[:, 1], x[:, 0]))  # sums in one order, whatever the tasks' order was
    return Model(model.good, model.bad, tuple(_logistic(x[order], y[order]).tolist()))


def _measure(model: Model, keep: list[str], scored: bool = False):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        of = model.features()
        for batch in batches:
            for part in slices(batch, "text"):
                f = [of(t) for t in part.column("text").to_pylist()]
                cols = [part.column(c) for c in keep] + [pa.array([x[i] for x in f], pa.float64()) for i in (0, 1)]
                names = [*keep, "difference", "size"]
                if scored:
                    cols.append(pa.array([model.score(*x) for x in f], pa.float64()))
                    names.append("score")
                yield pa.RecordBatch.from_arrays(cols, names)

    return run


def score(docs: DataFrame, model: Model) -> DataFrame:
    """doc_id, difference, size and score (0 to 1) of every row of ``docs`` (doc_id, text)."""
    docs = columns(docs, ["doc_id", "text"]).withColumn("doc_id", F.col("doc_id").cast("long"))
    return docs.mapInArrow(_measure(model, ["doc_id"], True), "doc_id long, difference double, size double, score double")
