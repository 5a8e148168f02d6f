"""Spelling variant grouping by one-edit neighbourhoods over a reduced alphabet.

Two words are near if they differ by exactly one inserted, deleted or replaced
code point. A word's form is its near word with the largest count (ties: the
smallest in code-point order) if that count is ``ratio`` times its own or more;
its root is the last word reached by following forms.

Method. Every letter is hashed to one of ``SYMBOLS`` symbols (its code point
modulo SYMBOLS), so a word becomes a reduced word. If two words are near, their
reduced words are equal or one edit apart: each word generates the whole
one-edit neighbourhood of its reduced word, some 16 entries a letter instead of
100 and more over the letters themselves, and a join with the reduced
vocabulary finds the candidates, which are verified on the original strings.
Entries travel as 64-bit hashes, each taken from prefix sums in constant time;
an equal hash of different reduced words only costs one more verification. The
join runs in ``PASSES`` slices of the hashes, one after the other, so that only
a slice of the neighbourhoods is on disk at a time.

Counts come from whole texts: one Counter a task combines before the shuffle,
so a word with a third of all occurrences sends one row a flush.

Words over LONG code points (a neighbourhood grows with the length and so would
its copies of the word) travel as a digest; they join their strings back for
the same verification.

Defined cases: a null or empty text has no words; a row with a null doc_id
counts, its words lose no letter; repeated rows count again; very long texts
are walked, not listed; an empty table gives an empty table; further columns,
whatever their names, are ignored.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator
from operator import itemgetter
from zlib import crc32

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ledgerlake.llm.tables import columns, drop_written, written, written_at
from ledgerlake.llm.words import LENGTH_FACTOR, MASK, U, mix

MIN_LENGTH, MIN_COUNT, RATIO = 7, 2, 10
NOISE = 31  # every NOISE-th pair of document and word loses a letter
SYMBOLS = 8
PASSES = 4
LONG = 64
FLUSH = 200_000  # distinct words a task holds
CHUNK = 1 << 16  # letters whose neighbourhoods are generated at a time
BASE = 0x9E3779B97F4A7C15


def _count(min_length: int, noise: int):
    run_of_letters = re.compile("[a-zÀ-ÿ]{%d,}" % min_length)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total: Counter = Counter()
        for batch in batches:
            for doc, text in zip(batch.column("doc_id").to_pylist(), batch.column("text"), strict=True):
                if not text.is_valid:
                    continue
                lower = text.as_buffer().to_pybytes().lower().decode("utf-8")  # bytes.lower: A-Z only
                own = Counter(map(itemgetter(0), run_of_letters.finditer(lower)))
                if noise and doc is not None:
                    start = crc32(b"%d:" % doc)
                    for word in [w for w in own if crc32(w.encode(), start) % noise == 0]:
                        n = own.pop(word)
                        at = crc32(word.encode(), start) % len(word)
                        if len(word) > min_length:
                            total[word[:at] + word[at + 1:]] += n
                total.update(own)
                if len(total) > FLUSH:
                    yield _counts(total)
                    total = Counter()
        yield _counts(total)

    return run


def _counts(total: Counter) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(total.keys(), pa.string()), pa.array(total.values(), pa.int64())], ["word", "n"])


def word_counts(docs: DataFrame, min_length: int = MIN_LENGTH, min_count: int = MIN_COUNT, noise: int = NOISE) -> DataFrame:
    """(word, n): maximal runs of Latin letters, A-Z lower-cased, of ``min_length`` code points and ``min_count`` occurrences.

    With ``noise``, the word of a document loses the letter h % length if
    ``noise`` divides h, the crc32 of ``<doc_id>:<word>``; 0 for none.
    """
    docs = columns(docs, ["doc_id", "text"]).withColumn("doc_id", F.col("doc_id").cast("long"))
    return (docs.mapInArrow(_count(min_length, noise), "word string, n long")
            .groupBy("word").agg(F.sum("n").alias("n")).where(F.col("n") >= min_count))


def _powers(n: int) -> np.ndarray:
    out = np.ones(n + 1, U)
    out[1:] = U(BASE)
    return np.multiply.accumulate(out)


def neighbourhood(words: list[str], symbols: int = SYMBOLS, whole: bool = True) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(hash, index of word): the reduced words themselves and, if ``whole``, all their one-edit neighbours, each once."""
    size = np.array([len(w) for w in words], np.int64)
    letters = np.frombuffer("".join(words).encode("utf-32-le"), np.uint32)
    sym = (letters % np.uint32(symbols)).astype(U) + U(1)
    off = np.r_[0, np.cumsum(size)]
    power = _powers(int(size.max(initial=0)) + 1)
    back = U(pow(BASE, -1, MASK + 1))
    ended = lambda h, n: mix(h + n.astype(U) * U(LENGTH_FACTOR))
    row = np.repeat(np.arange(len(words)), size)
    term = sym * power[np.arange(len(sym)) - off[row]]
    sums = np.r_[U(0), np.cumsum(term)]
    total = sums[off[1:]] - sums[off[:-1]]
    yield ended(total, size), np.arange(len(words))
    if not whole:
        return
    for low in range(0, len(sym), CHUNK):
        at = slice(low, low + CHUNK)
        r, s, t = row[at], sym[at], term[at]
        pos = np.arange(low, low + len(r)) - off[r]
        n, p = size[r], power[pos]
        before = sums[low:low + len(r)] - sums[off[r]]
        rest = total[r] - before
        # of equal neighbours only the first place counts: one that does not follow the same symbol
        previous = np.where(pos > 0, sym[np.arange(low, low + len(r)) - 1], U(0))
        new = previous != s
        yield ended(before + (rest - t) * back, n - 1)[new], r[new]
        for x in np.arange(1, symbols + 1).astype(U):
            other = s != x
            yield ended(before + x * p + rest - t, n)[other], r[other]
            new = previous != x
            yield ended(before + x * p + rest * U(BASE), n + 1)[new], r[new]
    filled = np.flatnonzero(size > 0)
    last = np.zeros(len(words), U)
    last[filled] = sym[off[1:][filled] - 1]
    for x in np.arange(1, symbols + 1).astype(U):  # insertions at the end
        new = last != x
        yield ended(total + x * power[size], size + 1)[new], np.flatnonzero(new)


def _entries(whole: bool, symbols: int, part: int, parts: int):
    """Rows (key, name): the hashes of slice ``part`` with the name of the word that they come from."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            words, names = batch.column("word").to_pylist(), batch.column("name")
            start = 0
            while start < len(words):  # a run of words of bounded length
                stop, length = start + 1, len(words[start])
                while stop < len(words) and length + len(words[stop]) <= CHUNK:
                    length += len(words[stop])
                    stop += 1
                for key, own in neighbourhood(words[start:stop], symbols, whole):
                    if parts > 1:
                        mine = key % U(parts) == U(part)
                        key, own = key[mine], own[mine]
                    if len(key):
                        yield pa.RecordBatch.from_arrays([pa.array(key.view(np.int64)), names.take(pa.array(own + start))], ["key", "name"])
                start = stop

    return run


def _candidates(words: DataFrame, symbols: int, part: int, parts: int) -> DataFrame:
    """(word, near) names of words whose reduced words are equal or one edit apart."""
    kind = "key long, name string"
    probes = words.mapInArrow(_entries(True, symbols, part, parts), kind).withColumnRenamed("name", "word")
    vocabulary = words.mapInArrow(_entries(False, symbols, part, parts), kind).withColumnRenamed("name", "near")
    # the vocabulary is hashed a partition at a time; the neighbourhoods stream past it and are never sorted
    return probes.join(vocabulary.hint("shuffle_hash"), "key").where("word <> near").select("word", "near")


def near_pairs(vocabulary: DataFrame, symbols: int = SYMBOLS, passes: int = PASSES, long: int = LONG) -> DataFrame:
    """(word, near) for all near words, in both directions, from a table of distinct words (column word)."""
    words = vocabulary.select("word")
    length = F.char_length("word")
    short = words.where(length <= long).withColumn("name", F.col("word"))
    one_edit = F.levenshtein("word", "near", 1) == 1
    parts = [written(_candidates(short, symbols, p, passes).where(one_edit), "spelling-pairs") for p in range(passes)]
    rest = words.where(length >= long).withColumn("name", F.sha2("word", 256))
    named = lambda a, b: rest.select(F.col("name").alias(a), F.col("word").alias(b))
    found = (_candidates(rest, symbols, 0, 1).select(F.col("word").alias("_a"), F.col("near").alias("_b")).distinct()
             .join(named("_a", "word"), "_a").join(named("_b", "near"), "_b").select("word", "near")
             .where(F.greatest(F.char_length("word"), F.char_length("near")) > long).where(one_edit))
    out = written(found, "spelling-pairs")
    for part in parts:
        out = out.unionByName(part)
    return out


def _roots(forms: DataFrame) -> DataFrame:
    """(word, root) of the words that have a form; each round doubles the length of the path behind ``root``."""
    spark = forms.sparkSession
    paths, path = written_at(forms.select("word", F.col("form").alias("root")), "spelling-roots")
    while True:
        ahead = paths.select(F.col("word").alias("root"), F.col("root").alias("_next"))
        before = path
        step, path = written_at(paths.join(ahead, "root", "left").select("word", F.coalesce("_next", "root").alias("root"),
                                                                         F.col("_next").isNotNull().alias("_moved")), "spelling-roots")
        drop_written(spark, before)
        paths = step.select("word", "root")
        if step.where("_moved").isEmpty():
            return paths


def variant_groups(vocabulary: DataFrame, ratio: int = RATIO, symbols: int = SYMBOLS) -> DataFrame:
    """word, form, root, n, n_near, form_n from a table (word, n) of distinct words.

    Counts grow ``ratio``-fold along forms, so paths are short (19 steps at
    the most for 64-bit counts) and never circles.
    """
    if ratio < 2:
        raise ValueError("ratio must be 2 at least")
    words = written(columns(vocabulary, ["word", "n"]), "spelling-words")
    pairs = near_pairs(words, symbols)
    best = (pairs.join(words.select(F.col("word").alias("near"), F.col("n").alias("near_n")), "near")
            .groupBy("word").agg(F.count(F.lit(1)).alias("n_near"), F.min(F.struct((-F.col("near_n")).alias("m"), F.col("near"))).alias("b")))
    has = -F.col("b.m") >= ratio * F.col("n")
    judged = written(words.join(best, "word", "left").select(
        "word", "n", F.coalesce("n_near", F.lit(0)).cast("long").alias("n_near"),
        F.when(has, F.col("b.near")).alias("form"), F.when(has, -F.col("b.m")).alias("form_n")), "spelling-forms")
    roots = _roots(judged.where("form is not null"))
    return judged.join(roots, "word", "left").select(
        "word", "form", F.coalesce("root", "word").alias("root"), "n", "n_near", "form_n")


def sql(table: str = "documents") -> str:
    """The groups as DuckDB SQL; crc32 byte by byte, near words by shared deletions, letters moved to single bytes for levenshtein."""
    upper = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
    low, high = MIN_LENGTH, MIN_COUNT
    return f"""
WITH RECURSIVE crc AS MATERIALIZED (SELECT list(list_reduce(list_prepend(i, range(0, 8)), lambda a, b: CASE WHEN a & 1 = 1 THEN xor(a >> 1, 3988292384) ELSE a >> 1 END)
            ORDER BY i) AS t FROM range(0, 256) r(i)),
run AS (SELECT doc_id, w, count(*) AS c FROM (SELECT doc_id, unnest(regexp_extract_all(
          translate(text, '{upper}', '{upper.lower()}'), '[a-zÀ-ÿ]{{{low},}}')) AS w FROM {table}) GROUP BY ALL),
hashed AS (SELECT doc_id, w, c, xor(list_reduce(list_prepend(4294967295::BIGINT, [(strpos('0123456789ABCDEF', x[2 * j - 1]) - 1) * 16 + strpos('0123456789ABCDEF', x[2 * j]) - 1
             FOR j IN range(1, len(x) // 2 + 1)]), lambda a, b: xor(a >> 8, t[(xor(a, b) & 255) + 1])), 4294967295) AS h
           FROM (SELECT *, hex(doc_id || ':' || w) AS x FROM run), crc),
spoilt AS (SELECT CASE WHEN h % {NOISE} = 0 THEN w[:(h % len(w))] || w[(h % len(w)) + 2:] ELSE w END AS word, c FROM hashed),
word AS MATERIALIZED (SELECT word, sum(c)::BIGINT AS n FROM spoilt WHERE len(word) >= {low} GROUP BY word HAVING sum(c) >= {high}),
del AS (SELECT DISTINCT word, unnest(list_append([word[:i - 1] || word[i + 1:] FOR i IN range(1, len(word) + 1)], word)) AS k FROM word),
bytes AS (SELECT array_to_string([chr(i::INTEGER) FOR i IN range(192, 256)], '') AS a, array_to_string([chr(i::INTEGER) FOR i IN range(32, 96)], '') AS b),
pair AS (SELECT DISTINCT x.word, y.word AS near FROM del x JOIN del y ON x.k = y.k AND x.word <> y.word),
near AS (SELECT word, near FROM pair, bytes WHERE levenshtein(translate(word, a, b), translate(near, a, b)) = 1),
best AS (SELECT near.word, near, w.n AS near_n, count(*) OVER (PARTITION BY near.word) AS n_near FROM near JOIN word w ON w.word = near
         QUALIFY row_number() OVER (PARTITION BY near.word ORDER BY w.n DESC, near) = 1),
judged AS MATERIALIZED (SELECT word, n, coalesce(n_near, 0)::BIGINT AS n_near, CASE WHEN near_n >= {RATIO} * n THEN near END AS form,
           CASE WHEN near_n >= {RATIO} * n THEN near_n END AS form_n FROM word LEFT JOIN best USING (word)),
path(word, tip, depth) AS (SELECT word, word, 0 FROM judged UNION ALL
         SELECT path.word, form, depth + 1 FROM path JOIN judged ON judged.word = path.tip WHERE form IS NOT NULL),
root AS (SELECT word, arg_max(tip, depth) AS root FROM path GROUP BY word)
SELECT word, form, root, n, n_near, form_n FROM judged JOIN root USING (word)"""
