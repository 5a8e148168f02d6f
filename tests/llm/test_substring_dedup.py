"""Substring dedup against a brute-force version."""

import hashlib
import random
import re

import pytest

from ledgerlake.llm.substring_dedup import remove_repeated_passages

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def brute(rows, window):
    first = {}
    for doc, text in rows:
        w = WORD.findall(text or "")
        for i in range(len(w) - window + 1):
            key = tuple(w[i:i + window])
            if doc is not None:
                first[key] = min(first.get(key, doc), doc)
    out = []
    for doc, text in rows:
        w = WORD.findall(text or "")
        gone = [False] * len(w)
        for i in range(len(w) - window + 1):
            if doc is not None and first[tuple(w[i:i + window])] < doc:
                gone[i:i + window] = [True] * window
        out.append((doc, len(w), sum(gone), " ".join(x for x, g in zip(w, gone, strict=True) if not g)))
    return sorted(out, key=str)


def run(spark, rows, **more):
    df = spark.createDataFrame([(i, t, "x", 1) for i, t in rows], "doc_id long, text string, key string, pos int")
    got = remove_repeated_passages(df.repartition(5), **more).collect()
    return sorted([(r.doc_id, r.n_words, r.n_removed, r.text) for r in got], key=str)


def corpus(seed, n=60, vocab=4000):
    rnd = random.Random(seed)
    word = lambda: f"w{rnd.randrange(vocab)}é"
    passages = [[word() for _ in range(rnd.choice([49, 50, 51, 70, 130]))] for _ in range(6)]
    rows = []
    for i in range(n):
        parts = []
        for _ in range(rnd.randrange(5)):
            parts += [word() for _ in range(rnd.randrange(80))]
            if rnd.random() < 0.6:
                parts += rnd.choice(passages)
        rows.append((i * 3, rnd.choice([" ", "\n", " \t "]).join(parts)))
    rows += [(1, rows[5][1]), (500, rows[7][1]), (500, rows[7][1]), (501, None), (502, ""), (503, " \n "),
             (None, rows[9][1]), (504, "x " * 300), (2, "x " * 120), (505, " ".join(passages[0] * 3)),
             (506, " ".join(passages[1])), (506, " ".join(passages[2] + ["q"]))]
    return rows


@pytest.mark.parametrize("seed", [1, 2])
def test_matches_brute_force(spark, seed):
    rows = corpus(seed)
    assert run(spark, rows) == brute(rows, 50)


def test_long_text_and_other_window(spark):
    rows = [(1, " ".join(f"a{i % 997}" for i in range(60000))), (2, "z " + " ".join(f"a{i % 997}" for i in range(500)) + " q")]
    assert run(spark, rows, window=40) == brute(rows, 40)


def test_empty_table(spark):
    assert run(spark, []) == []


def test_layout_is_kept(spark):
    p = " ".join(f"p{i}" for i in range(60))
    rows = [(1, p), (2, f"head\tone\n{p}\ntail  two")]
    got = {r[0]: r[3] for r in run(spark, rows, keep_layout=True)}
    assert got == {1: p, 2: "head\tone\ntail  two"}
    assert hashlib.sha256(got[1].encode()).hexdigest()
