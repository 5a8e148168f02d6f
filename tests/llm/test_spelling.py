"""Word counts, neighbourhoods, near pairs and groups against plain versions and SQL."""

import random
import re
import zlib
from collections import Counter

import duckdb
import numpy as np
import pandas as pd
import pytest

from ledgerlake.llm import spelling as S

LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def counts(rows, noise=31):
    c = Counter()
    for d, t in rows:
        for run in re.findall("[A-Za-zÀ-ÿ]+", t or ""):
            run = run.translate(LOWER)
            h = zlib.crc32(f"{d}:{run}".encode())
            if d is not None and noise and h % noise == 0:
                i = h % len(run)
                run = run[:i] + run[i + 1:]
            c[run] += 1
    return {w: n for w, n in c.items() if len(w) >= 7 and n >= 2}


def one_edit(a, b):
    if len(a) > len(b):
        a, b = b, a
    if len(a) == len(b):
        return sum(x != y for x, y in zip(a, b, strict=True)) == 1
    return len(b) - len(a) == 1 and any(b[:i] + b[i + 1:] == a for i in range(len(b)))


def groups(words):
    near = {w: [v for v in words if one_edit(w, v)] for w in words}
    form = {}
    for w, vs in near.items():
        best = min(vs, key=lambda v: (-words[v], v), default=None)
        form[w] = best if best is not None and words[best] >= 10 * words[w] else None
    out = []
    for w in words:
        root = w
        while form[root] is not None:
            root = form[root]
        out.append((w, form[w], root, words[w], len(near[w]), words[form[w]] if form[w] else None))
    return sorted(out)


def corpus(n=150, seed=5):
    rnd = random.Random(seed)
    base = ["recommendation", "necessary", "français", "Überschrift", "ÀÉÎõüÿ÷×", "aaaaaaaa", "abababab", "possible", "possibles", "mmmmmmm"]
    def spoil(w):
        i, x = rnd.randrange(len(w)), rnd.choice("abcxyzé÷ÿ")
        return rnd.choice([w[:i] + w[i + 1:], w[:i] + x + w[i:], w[:i] + x + w[i + 1:]])
    rows = []
    for i in range(n):
        words = [rnd.choice(base) for _ in range(40)] + [spoil(rnd.choice(base)) for _ in range(6)] + [spoil(spoil(base[0])), "x1y2", "ĀĂĄ"]
        rnd.shuffle(words)
        rows.append((i, rnd.choice([" ", "\n", "-", "1"]).join(words)))
    return [*rows, (3, rows[3][1]), rows[5], rows[5], (None, rows[0][1]), (-4, rows[1][1]), (900, None), (901, ""),
            (902, ("q" * 500 + " ") * 2 + "q" * 501 + " " + "q" * 501 + " " + ("r" * 64 + " " + "r" * 65 + " ") * 2)]


def frame(spark, rows):
    return spark.createDataFrame([(d, t, "x", 5) for d, t in rows], "doc_id long, text string, word string, n int").repartition(5)


def test_counts(spark, monkeypatch):
    monkeypatch.setattr(S, "FLUSH", 30)
    rows = corpus()
    assert dict(map(tuple, S.word_counts(frame(spark, rows)).collect())) == counts(rows)
    assert dict(map(tuple, S.word_counts(frame(spark, rows), noise=0).collect())) == counts(rows, 0)


@pytest.mark.parametrize("symbols", [2, 3, 8])
def test_neighbourhood_is_whole_and_each_entry_once(symbols, monkeypatch):
    monkeypatch.setattr(S, "CHUNK", 10)
    words = ["abc", "aab", "zzzzzz", "éàü", "a"]
    reduced = ["".join(chr(97 + ord(c) % symbols) for c in w) for w in words]
    letters = [chr(97 + i) for i in range(symbols)]
    got = [np.concatenate(x) for x in zip(*S.neighbourhood(words, symbols), strict=True)]
    for i, w in enumerate(reduced):
        want = {w} | {w[:j] + w[j + 1:] for j in range(len(w))} | {w[:j] + x + w[j:] for j in range(len(w) + 1) for x in letters} | {
            w[:j] + x + w[j + 1:] for j in range(len(w)) for x in letters}
        mine = got[0][got[1] == i]
        assert len(mine) == len(set(mine.tolist())) == len(want)
        # the hash of a neighbour is the hash of that reduced word: map it back to letters of the same symbol
        spelt = ["".join(chr(next(c for c in range(97, 97 + symbols) if c % symbols == ord(x) - 97)) for x in v) for v in want if v]
        base = np.concatenate([k for k, _ in S.neighbourhood(spelt, symbols, whole=False)])
        assert set(base.tolist()) <= set(mine.tolist())


def test_groups_match_plain_version(spark, monkeypatch):
    rows = corpus()
    got = sorted((tuple(r) for r in S.variant_groups(S.word_counts(frame(spark, rows))).collect()), key=lambda r: r[0])
    assert got == groups(counts(rows))
    assert any(r[1] and r[2] != r[1] for r in got) or len({r[2] for r in got}) < len(got)


def test_chains_and_long_words(spark):
    words = {"aaaaaaaa": 1, "aaaaaaab": 10, "aaaaaabb": 100, "aaaaabbb": 1000, "aaaabbbb": 10000, "aaaaaaac": 10, "b" * 64: 20, "b" * 65: 2,
             "c" * 70: 50, "c" * 69 + "d": 3, "c" * 71: 5, "d" * 3000: 2, "d" * 2999: 30, "é" * 64: 9, "é" * 63: 9}
    df = spark.createDataFrame(list(words.items()), "word string, n long")
    assert sorted((tuple(r) for r in S.variant_groups(df).collect()), key=lambda r: r[0]) == groups(words)


def test_empty(spark):
    assert S.variant_groups(S.word_counts(frame(spark, []))).collect() == []


def test_sql(spark):
    rows = [r for r in corpus(80) if r[0] is not None]
    documents = pd.DataFrame({"doc_id": [d for d, _ in rows], "text": [t for _, t in rows]})  # noqa: F841
    got = duckdb.sql(S.sql()).fetchall()
    assert sorted(got) == groups(counts(rows))
