"""Held-out accuracy on 10,000 documents, the score formula by hand, and the defined cases."""

import math
import random
import zlib

import pytest
import zstandard
from pyspark.sql import functions as F

from ledgerlake.llm import quality_classifier as Q
from ledgerlake.llm import queries

SF = "/root/testdata/sf0.01"


def test_held_out_accuracy(spark):
    big = "/root/testdata/sf0.1"  # sf0.01 holds out 14 bad documents, too few to measure a rate
    out = queries.op5_quality_classifier(spark, big).join(spark.read.parquet(f"{big}/labels.parquet"), "doc_id").collect()
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 3 == 1) for r in out)
    held = [r for r in out if r.held_out]
    assert sum(r.predicted == r.quality for r in held) >= 0.95 * len(held)
    good, bad = ([r.score for r in held if r.quality == q] for q in (1, 0))
    assert sum(g > b for g in good for b in bad) >= 0.97 * len(good) * len(bad)
    assert all(0 <= r.score <= 1 and r.predicted == int(r.score >= 0.5) for r in out)


def test_edges(spark):
    docs = spark.createDataFrame([(1, None, 0), (2, "", 0), (2, "", 0), (None, "some text here.", 1), (4, "w " * 200000, 1)],
                                 "doc_id long, text string, quality int")
    labels = spark.createDataFrame([(1, 1, "x"), (1, 1, "x"), (None, 0, "y")], "doc_id long, quality int, text string")
    none = Q.train(docs, labels)
    assert [r.score for r in Q.score(docs, none).collect()] == [0.5] * 5
    model = Q.train(spark.read.parquet(f"{SF}/documents.parquet"), spark.read.parquet(f"{SF}/labels.parquet"))
    assert model == Q.train(spark.read.parquet(f"{SF}/documents.parquet").repartition(5), spark.read.parquet(f"{SF}/labels.parquet"))
    got = Q.score(docs, model).collect()
    assert len(got) == 5 and all(0 <= r.score <= 1 for r in got) and got[0].score == got[1].score
    assert Q.score(docs.limit(0), model).collect() == [] and Q.train(docs.limit(0), labels.limit(0)).weights == ()
    assert docs.select(Q.held_out(F.col("doc_id")).alias("h")).collect()[3].h is False


def test_score_formula_on_given_dictionaries(spark):
    """Brute force: sizes of whole texts, in runs, under each dictionary; their difference and length through the curve."""
    rnd = random.Random(6)
    words = lambda pool, n: " ".join(rnd.choice(pool) for _ in range(n))
    fine, poor = [f"prose{i}" for i in range(60)], [f"spam{i}!!" for i in range(60)]
    model = Q.Model(words(fine, 900).encode(), words(poor, 900).encode(), (0.3, 25.0, -0.7))
    texts = [words(fine, 50), words(poor, 50), words(fine + poor, 3000), "", None, "ü" * 5000, "x"]

    def size(dictionary, raw):
        d = zstandard.ZstdCompressionDict(dictionary, dict_type=zstandard.DICT_TYPE_RAWCONTENT)
        return sum(len(zstandard.ZstdCompressor(level=3, dict_data=d, write_content_size=False).compress(raw[i:i + 4096]))
                   for i in range(0, max(len(raw), 1), 4096))

    got = {r.doc_id: r for r in Q.score(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string"), model).collect()}
    for i, t in enumerate(texts):
        raw = (t or "").encode()
        g, b = size(model.good, raw), size(model.bad, raw)
        z = 0.3 + 25.0 * (b - g) / (b + g) - 0.7 * math.log(min(g, b) / (len(raw) + 16))
        assert got[i].score == pytest.approx(1 / (1 + math.exp(-z)), abs=1e-12)
    assert got[0].difference > 0 > got[1].difference


def test_a_long_text_gives_runs_from_start_to_end(spark):
    docs = spark.createDataFrame([("abcdefghijklmnopqrstuvwxyz0123456789",), ("short",), ("",)], "text string")
    runs = [r[0] for r in docs.select(Q._spread_runs(F.col("text"), 16)).collect()]
    assert runs == ["abcd\nklmn\nvwxy\n6789", "short", ""]
    rows = [(1, "b"), (1, "a"), (2, "c")]
    labels = spark.createDataFrame([(i, i % 2) for i in range(30)], "doc_id long, quality int")
    both = [Q.train(spark.createDataFrame(x, "doc_id long, text string"), labels) for x in (rows, rows[::-1])]
    assert both[0] == both[1]
