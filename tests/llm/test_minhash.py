"""Near-duplicate classes against all pairs of full sets."""

import random
import re

from ledgerlake.llm import minhash

WORD = re.compile(r"[^\x20\x09-\x0D]+")
LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def shingles(text, size=2):
    w = WORD.findall((text or "").translate(LOWER))
    return frozenset(tuple(w[i:i + size]) for i in range(len(w) - size + 1)) if len(w) >= size else frozenset([tuple(w)] if w else [])


def brute(rows, size=2, per_cent=80):
    sets = [shingles(t, size) for _, t in rows]
    parent = {i: i for i, _ in rows if i is not None}

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a in range(len(rows)):
        for b in range(a):
            if rows[a][0] is None or rows[b][0] is None or not sets[a] or not sets[b]:
                continue
            if 100 * len(sets[a] & sets[b]) >= per_cent * len(sets[a] | sets[b]):
                x, y = sorted((root(rows[a][0]), root(rows[b][0])))
                parent[y] = x
    return sorted([(i, len(s), None if i is None else root(i), i is None or root(i) == i)
                   for (i, _), s in zip(rows, sets, strict=True)], key=str)


def run(spark, rows, **more):
    df = spark.createDataFrame([(i, t, "x") for i, t in rows], "doc_id long, text string, rep string").repartition(4)
    return sorted([tuple(r) for r in minhash.near_duplicates(df, **more).collect()], key=str)


def corpus(seed):
    rnd = random.Random(seed)
    words = lambda n: [f"{rnd.choice('abAB')}{rnd.randrange(900)}ü" for _ in range(n)]
    rows = []
    for base in range(12):
        text = words(rnd.choice([3, 5, 6, 12, 40, 200, 400]))
        for _ in range(rnd.choice([1, 2, 5, 25])):
            copy = [w if rnd.random() > rnd.choice([0, 0.02, 0.05, 0.12]) else rnd.choice(words(1)) for w in text]
            rows.append((rnd.randrange(10_000_000), " ".join(copy)))
    rows += [(7, rows[0][1]), (8, rows[0][1].upper()), (9, None), (10, ""), (11, " \n"), (12, "one"), (13, "ONE"), (14, "two"),
             (None, rows[0][1]), (15, "the the the the the"), (16, "the the"), (17, "a b c d e"), (18, "a b c d e f"), (18, "a b c d e f")]
    return rows


def test_matches_all_pairs(spark):
    for seed in (1, 2):
        rows = corpus(seed)
        assert run(spark, rows) == brute(rows)


def test_blocks_find_the_same_links(spark, monkeypatch):
    monkeypatch.setattr(minhash, "LIST_BLOCK", 5)
    monkeypatch.setattr(minhash, "SET_BLOCK", 900)
    rows = corpus(3)
    assert run(spark, rows) == brute(rows)


def test_five_word_shingles_and_empty_table(spark):
    rows = corpus(4)
    assert run(spark, rows, shingle=5) == brute(rows, 5)
    assert run(spark, []) == []


def test_rows_of_one_doc_id_are_one_document(spark):
    a, b, c = "a b c d e f g", "p q r s t u v w", "k l m n o p"
    rows = [(1, b), (5, b), (5, a), (9, a), (9, None), (20, ""), (20, c), (21, c), (30, None), (30, " ")]
    got = run(spark, rows)
    assert got == brute(rows)
    assert {d: comp for d, _, comp, _ in got} == {1: 1, 5: 1, 9: 1, 20: 20, 21: 20, 30: 30}


def test_shared_doc_ids_match_all_pairs(spark):
    rnd = random.Random(11)
    rows = [(rnd.randrange(40) if i is not None else None, t) for i, t in corpus(5)]
    assert run(spark, rows) == brute(rows)
