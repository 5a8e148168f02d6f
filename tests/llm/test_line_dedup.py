"""Line dedup against a plain version; bitmaps, batches, skew and defined cases."""

import random
import zlib
from collections import defaultdict

import duckdb
import numpy as np
import pandas as pd
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from ledgerlake.llm import line_dedup as L

WHITE = " \t\n\v\f\r"
LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def key_of(line):
    return line.strip(WHITE).translate(LOWER)


def brute(rows, least=10, keep_first=False):
    holders, first = defaultdict(set), {}
    for d, t in sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0)):
        for p, line in enumerate((t or "").split("\n")):
            holders[key_of(line)].add(d)
            first.setdefault(key_of(line), (d, p))
    out = []
    for d, t in rows:
        lines = (t or "").split("\n")
        kept = [x for p, x in enumerate(lines) if not key_of(x) or len(holders[key_of(x)]) < least
                or (keep_first and first[key_of(x)] == (d, p))]
        out.append((d, len(lines), len(lines) - len(kept), "\n".join(kept)))
    return sorted(out, key=str)


def run(spark, rows, parts=5, **kw):
    df = spark.createDataFrame([(d, t, "x", 1) for d, t in rows], "doc_id long, text string, ver string, keep int").repartition(parts)
    return sorted((tuple(r) for r in L.drop_lines(df, L.keep_bitmaps(df, **kw)).collect()), key=str)


def corpus(n=120, seed=3):
    rnd = random.Random(seed)
    common = ["Home | About", "© 2024 Ägypten É", "read more", "  Read More\t", "rare\x0bline", "\x1f edge \x1f", "İstanbul", "x" * 5000]
    rows = []
    for i in range(n):
        lines = [rnd.choice(common) if rnd.random() < .5 else f"own {rnd.randrange(400)}" for _ in range(rnd.randrange(12))]
        rows.append((i, "\n".join(["the hot line", *lines, "", " \r"][rnd.randrange(2):])))
    return [*rows, (3, "read more\nother"), rows[7], rows[7], (None, "read more"), (None, None), (500, ""), (501, "\n\n"), (502, None),
            (503, "THE HOT LINE"), (504, "the hot line" + "\nthe hot line" * 50)]


@pytest.mark.parametrize("kw", [{}, {"min_documents": 2}, {"min_documents": 30}])
def test_matches_plain_version(spark, kw):
    rows = corpus()
    assert run(spark, rows, **kw) == brute(rows, kw.get("min_documents", 10))


def test_first_occurrence_can_stay(spark):
    rows = [(d, t) for d, t in dict(corpus()).items()]
    assert run(spark, rows, min_documents=2, keep_first=True) == brute(rows, 2, True)


def test_small_batches_and_few_partitions(spark, monkeypatch):
    """Keys that span Arrow batches of the sorted stream, and batches that decide nothing alone."""
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "7")
    monkeypatch.setattr(L, "SLICE", 64)
    try:
        rows = corpus(60)
        assert run(spark, rows) == brute(rows)
        assert run(spark, rows, min_documents=9) == brute(rows, 9)
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")


def test_a_hot_line_sends_one_row_a_batch():
    n = 5000
    batch = pa.RecordBatch.from_arrays([pa.array(np.arange(n)), pa.array(np.arange(n)), pa.array(["hot"] * n)], ["doc", "ver", "text"])
    rows = pa.Table.from_batches(list(L._line_rows(10)(iter([batch])))).to_pandas()
    assert (rows.state == L.HEAD).sum() == 1 and (rows.state == L.OPEN).sum() == 0
    assert len(rows) == 2 * n and rows[rows.state == L.THROUGH].key.nunique() == n


def test_bitmaps_and_empty_table(spark):
    rows = [(i, "a\nhot\nb") for i in range(12)]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    got = L.keep_bitmaps(df).where("doc_id = 4").first()
    assert (got.n_lines, got.n_dropped) == (3, 3) and np.unpackbits(np.frombuffer(zlib.decompress(got.keep), np.uint8)).sum() == 0
    assert run(spark, []) == []


def test_sql(spark):
    rows = corpus(80)
    documents = pd.DataFrame({"doc_id": pd.array([d for d, _ in rows], "Int64"), "text": [t for _, t in rows]})  # noqa: F841
    df = spark.createDataFrame(rows, "doc_id long, text string")
    ours = L.drop_lines(df, L.keep_bitmaps(df)).select("doc_id", "n_lines", "n_dropped", F.sha2("text", 256)).collect()
    assert sorted(duckdb.sql(L.sql()).fetchall(), key=str) == sorted((tuple(r) for r in ours), key=str)
