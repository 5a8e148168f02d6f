"""Strassen products against plain ones, mined rows against brute force and SQL."""

import math
import random

import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F

from ledgerlake.llm import hard_negatives as H


def moved_label():
    return F.when(F.col("vec_id") % 7 == 0, (F.col("label").cast("long") + 1) % 10).otherwise(F.col("label"))


def brute(rows, every=100):
    by_id = {}
    for i, v, label in rows:
        if i is None or v is None or label is None or any(x is None or not math.isfinite(x) for x in v):
            continue
        label = (label + 1) % 10 if i % 7 == 0 else label
        by_id[i] = min(by_id.get(i, (label, v)), (label, v))
    e = {i: (label, [math.floor(256 * x) for x in v]) for i, (label, v) in by_id.items()}
    out = []
    for a, (label, v) in e.items():
        if a % every:
            continue
        scored = sorted((-sum(x * y for x, y in zip(v, w, strict=True)), i, m) for i, (m, w) in e.items() if i != a and len(w) == len(v))
        for ps, p, _ in [x for x in scored if x[2] == label][:5]:
            fits = [(i, -s) for s, i, m in scored if m != label and 30 * -ps <= 100 * -s <= 90 * -ps][:10]
            out += [(a, p, r + 1, i, -ps, s) for r, (i, s) in enumerate(fits)]
    return sorted(out)


def run(spark, rows, parts=4):
    df = spark.createDataFrame([(i, v, m, 1, 2) for i, v, m in rows], "vec_id long, embedding array<double>, label int, id int, dim int")
    return sorted(tuple(r) for r in H.hard_negatives(df.repartition(parts), F.col("id") % 100 == 0, moved_label()).collect())


def data(n, dims, seed, spread=0.2, labels=4):
    rnd = random.Random(seed)
    rows = [(i, [rnd.gauss(0.03, spread) for _ in range(dims)], rnd.randrange(labels) if i % 3 else 0) for i in range(0, 10 * n, 10)]
    return [*rows, rows[3], rows[3], (rows[10][0], rows[5][1], 2), (1, list(rows[0][1]), 1), (2, list(rows[0][1]), 1), (3, list(rows[0][1]), 0),
            (None, rows[1][1], 0), (4, None, 0), (5, rows[1][1], None), (6, [None] * dims, 0), (8, [float("nan")] * dims, 0),
            (9, [float("-inf")] * dims, 0), (11, [1.0], 0), (5000100, [0.5], 0), (5000200, [0.5], 0), (5000300, [0.2], 3), (100100100, [], 1),
            (200, [], 1), (13, [], 2), (-100, [rnd.gauss(0, 1) for _ in range(dims)], 0), (-7, [rnd.gauss(0, 1) for _ in range(dims)], 1)]


@pytest.mark.parametrize("m,d,n", [(1, 1, 1), (3, 64, 5), (17, 33, 70), (64, 64, 64), (100, 7, 129), (33, 0, 40), (200, 96, 17)])
def test_strassen(m, d, n):
    rnd = np.random.default_rng(m + d + n)
    a, b = rnd.integers(-(1 << 62), 1 << 62, (m, d)), rnd.integers(-(1 << 62), 1 << 62, (d, n))
    assert (H.strassen(a, b, 2) == a @ b).all() and H.strassen(a, b).shape == (m, n)
    assert (H.strassen(a.astype(object), b.astype(object), 4) == a.astype(object) @ b.astype(object)).all()


def test_heaps_merge_like_one_sort():
    rnd = np.random.default_rng(2)
    score, ids = rnd.integers(-3, 3, (6, 40)), np.tile(rnd.permutation(40), (6, 1))
    whole, halves, other = H.Heaps(6, 7), H.Heaps(6, 7), H.Heaps(6, 7)
    whole.merge(score, ids)
    halves.merge(score[:, :25], ids[:, :25])
    other.merge(score[:, 25:], ids[:, 25:])
    halves.merge(other.score, other.id)
    assert (halves.score == whole.score).all() and (halves.id == whole.id).all()
    assert [list(zip(-s, i, strict=True)) for s, i in zip(whole.score, whole.id, strict=True)] == [
        sorted(zip(-s, i, strict=True))[:7] for s, i in zip(score, ids, strict=True)]


@pytest.mark.parametrize("seed,dims,spread", [(1, 20, .2), (2, 3, .02), (3, 40, 1.0)])
def test_matches_brute_force(spark, seed, dims, spread, monkeypatch):
    monkeypatch.setattr(H, "TILE", 37)
    monkeypatch.setattr(H, "STRIPE", 50)
    monkeypatch.setattr(H, "ANCHOR_BLOCK", 5)
    rows = data(260, dims, seed, spread)
    got = run(spark, rows)
    assert got == brute(rows) and got


def test_large_components(spark):
    rows = [(i, [None if x is None else x * 2.0**21 for x in v], m) if v and i != 8 and i != 9 else (i, v, m) for i, v, m in data(60, 8, 5)]
    assert run(spark, rows) == brute(rows)


def test_empty_and_sql(spark):
    assert run(spark, []) == []
    rows = [r for r in data(150, 12, 8) if not r[1] or r[0] != 8]
    con = duckdb.connect()
    con.execute("create table embeddings (vec_id bigint, embedding double[], label integer)")
    con.executemany("insert into embeddings values (?, ?, ?)", rows)
    assert sorted(con.execute(H.sql()).fetchall()) == brute(rows)
