"""Line-first quality rules, in DataFrame functions only.

Each line is judged on its own: navigation (separator-ridden menus), symbol
noise, shouting, boilerplate phrases, and missing punctuation (of any script;
scripts that use none are exempt). Failing lines are removed. A document that loses more than ``MAX_LOST`` per cent of its
characters is rejected, and so is one that fails the base rules: fewer than 50
words, or more than half of its words in repeated 3-word windows.

Repeated windows are found per row: the 64-bit hashes of the windows are
sorted in an array and equal neighbours kept, so nothing is shuffled.

Defined cases: a null or empty text has no words and fails the base rules;
lines without a word are kept and lose nothing; every row is judged alone, so
repeated rows get equal verdicts and a very long text costs its own length (its
sorted windows); an empty table gives an empty table; columns with the names of
the results are replaced (see ``line_first``).
"""

from __future__ import annotations

from functools import reduce
from operator import or_

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

MIN_WORDS = 50
MAX_REPEATED = 50  # per cent of the words
MAX_LOST = 50  # per cent of the text's characters, in failing lines
MIN_SHOUTED = 5  # words of a line without a lower-case letter
WORD = r"[^\x20\x09-\x0D]+"
SPACES = " \t\n\x0b\f\r"
SYMBOLS = r"[#*$%&|<>]"
SEPARATORS = r"[|»›•·]"
# A line of prose holds a mark: any punctuation (Unicode Po, so every script's own) but these, which menus and code use too.
NO_STOPS = "\"#%&'*/@\\§¶·"
# Scripts that write sentences without marks: Thai, Lao, Tibetan, Myanmar, Khmer.
UNMARKED = "[\u0e00-\u109f\u1780-\u17ff]"
# Fixed phrases of page furniture, in the corpus' four languages.
BOILERPLATE = ("all rights reserved", "back to top", "click here to", "cookie policy", "enable javascript", "lorem ipsum",
               "privacy policy", "sign up for our", "skip to content", "skip to main content", "subscribe to our",
               "terms of service", "terms of use", "use of cookies", "uses cookies", "we use cookies",
               "abonnez-vous à notre", "aller au contenu", "conditions d'utilisation", "nous utilisons des cookies",
               "politique de confidentialité", "tous droits réservés",
               "alle rechte vorbehalten", "wir verwenden cookies", "zum inhalt springen", "zurück nach oben",
               "política de privacidad", "saltar al contenido", "todos los derechos reservados", "utilizamos cookies")
MAX_BARE = 12  # words a line without a mark may have


def _says_boilerplate(text: Column) -> Column:
    low = F.lower(text)
    return reduce(or_, [F.contains(low, F.lit(x)) for x in BOILERPLATE])


def _line_facts(line: Column) -> Column:
    return F.struct(line.alias("line"), F.regexp_count(line, F.lit(WORD)).alias("n"),
                    F.regexp_count(line, F.lit(SEPARATORS)).alias("separators"),
                    F.regexp_count(line, F.lit(SYMBOLS)).alias("symbols"))


def _line_fails(f: Column, boilerplate: Column) -> Column:
    """True for a line that a rule removes; a line without a word never fails. boilerplate: the text has such a phrase."""
    line, n = f["line"], f["n"]
    navigation = (f["separators"] >= 2) & (f["separators"] * 4 >= n)
    noise = f["symbols"] * 10 > F.length(line)
    shouting = (n >= MIN_SHOUTED) & ~line.rlike(r"\p{Ll}") & line.rlike(r"\p{Lu}")
    marked = F.translate(line, NO_STOPS, "").rlike(r"\p{Po}") | line.rlike(UNMARKED)
    bare = (n > MAX_BARE) & ~marked
    phrase = F.when(boilerplate, _says_boilerplate(line)).otherwise(F.lit(False))
    return (n > 0) & (navigation | noise | shouting | bare | phrase)


def _repeated(df: DataFrame) -> DataFrame:
    """n_repeat_words from _w: words inside 3-word windows that occur twice or more."""
    w = F.col("_w")
    n = F.size(w)
    windows = F.when(n >= 3, F.transform(F.sequence(F.lit(0), n - 3), lambda i: F.xxhash64(w[i], w[i + 1], w[i + 2])))
    df = df.withColumn("_h", F.coalesce(windows, F.array().cast("array<bigint>")))
    h = F.col("_h")
    pairs = F.sort_array(F.transform(h, lambda x, i: F.struct(x.alias("x"), i.alias("i"))))
    none = F.array().cast("array<struct<x:bigint,i:int>>")
    df = df.withColumn("_s", F.when(F.size(F.array_distinct(h)) < F.size(h), pairs).otherwise(none))
    s = F.col("_s")
    twin = lambda e, j: F.coalesce(F.get(s, j - 1)["x"] == e["x"], F.lit(False)) | F.coalesce(
        F.get(s, j + 1)["x"] == e["x"], F.lit(False))
    df = df.withColumn("_p", F.sort_array(F.transform(F.filter(s, twin), lambda e: e["i"])))
    p = F.col("_p")
    covered = F.aggregate(F.transform(p, lambda x, j: F.least(F.lit(3), F.coalesce(F.get(p, j + 1) - x, F.lit(3)))),
                          F.lit(0).cast("bigint"), lambda a, x: a + x)
    return df.withColumn("n_repeat_words", covered)


def line_first(docs: DataFrame, text_col: str = "text") -> DataFrame:
    """Every row of ``docs`` with its counts, verdicts and cleaned text.

    Added columns: n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words,
    n_removed_lines, lost_chars (long), base_failed, kept (boolean) and
    clean_text; columns of these names in ``docs`` are replaced, and ones named
    like the helpers (_t, _w, _h, _s, _p, _bp, _facts, _full, _good) are dropped.
    """
    out = docs.withColumn("_t", F.coalesce(F.col(f"`{text_col}`"), F.lit("")))
    t = F.col("_t")
    trimmed = F.trim(t, F.lit(SPACES))
    out = out.withColumn("_w", F.when(trimmed == "", F.array().cast("array<string>")).otherwise(
        F.split(trimmed, r"[\x20\x09-\x0D]+")))
    out = _repeated(out).withColumn("n_words", F.size("_w").cast("long"))
    out = out.withColumn("word_chars", F.length(F.array_join("_w", "")).cast("long")).drop("_w", "_h", "_s", "_p")
    out = out.withColumn("_bp", _says_boilerplate(t))
    out = out.withColumn("_facts", F.transform(F.split(t, "\n", -1), _line_facts))
    out = out.withColumn("_full", F.transform(F.filter("_facts", lambda f: f["n"] > 0), lambda f: f["line"]))
    out = out.withColumn("n_dup_lines", (F.size("_full") - F.size(F.array_distinct("_full"))).cast("long"))
    symbols = F.aggregate(F.transform("_facts", lambda f: f["symbols"]), F.lit(0).cast("long"), lambda a, x: a + x)
    out = out.withColumn("n_symbols", symbols)
    out = out.withColumn("_good", F.transform(F.filter("_facts", lambda f: ~_line_fails(f, F.col("_bp"))), lambda f: f["line"]))
    out = out.withColumn("n_removed_lines", (F.size("_facts") - F.size("_good")).cast("long"))
    out = out.withColumn("clean_text", F.when(F.col("n_removed_lines") == 0, t).otherwise(F.array_join("_good", "\n")))
    chars = lambda lines: F.aggregate(F.transform(lines, F.length), F.lit(0).cast("long"), lambda a, x: a + x)
    out = out.withColumn("lost_chars", F.when(F.col("n_removed_lines") == 0, F.lit(0).cast("long")).otherwise(
        chars(F.transform("_facts", lambda f: f["line"])) - chars(F.col("_good"))))
    out = out.withColumn("base_failed", (F.col("n_words") < MIN_WORDS)
                         | (100 * F.col("n_repeat_words") > MAX_REPEATED * F.col("n_words")))
    out = out.withColumn("kept", ~F.col("base_failed") & (100 * F.col("lost_chars") <= MAX_LOST * F.length(t)))
    return out.drop("_t", "_bp", "_facts", "_full", "_good")


def sql(table: str = "documents") -> str:
    """The same counts and verdicts as DuckDB SQL."""
    spaces = "chr(32)||chr(9)||chr(10)||chr(11)||chr(12)||chr(13)"
    count = lambda x, pattern: f"len(regexp_extract_all({x}, '{pattern}'))"
    quoted = lambda x: "'" + x.replace("'", "''") + "'"
    phrases = " OR ".join(f"contains(lower(line), {quoted(x)})" for x in BOILERPLATE)
    bare = f"length(translate(t, {spaces}, ''))"
    return f"""
WITH d AS (SELECT row_number() OVER () AS rid, doc_id, coalesce(text, '') AS t FROM {table}),
w AS (SELECT rid, doc_id, t, regexp_extract_all(t, '{WORD}') AS w, string_split(t, chr(10)) AS ls FROM d),
g AS (SELECT rid, i, w[i] || chr(32) || w[i + 1] || chr(32) || w[i + 2] AS g FROM
      (SELECT rid, w, unnest(range(1, len(w) - 1)) AS i FROM w WHERE len(w) >= 3)),
twice AS (SELECT rid, i FROM (SELECT rid, i, count(*) OVER (PARTITION BY rid, g) AS c FROM g) WHERE c > 1),
rep AS (SELECT rid, count(*) AS r FROM (SELECT DISTINCT rid, unnest([i, i + 1, i + 2]) AS p FROM twice) GROUP BY rid),
lines AS (SELECT rid, unnest(ls) AS line FROM w),
f AS (SELECT rid, line, {count('line', WORD)} AS nw, {count('line', SEPARATORS)} AS ns, {count('line', SYMBOLS)} AS ny FROM lines),
j AS (SELECT rid, line, nw, nw > 0 AND ((ns >= 2 AND ns * 4 >= nw) OR ny * 10 > length(line) OR {phrases}
        OR (nw >= {MIN_SHOUTED} AND NOT regexp_matches(line, '\\p{{Ll}}') AND regexp_matches(line, '\\p{{Lu}}'))
        OR (nw > {MAX_BARE} AND NOT regexp_matches(translate(line, {quoted(NO_STOPS)}, ''), '\\p{{Po}}')
            AND NOT regexp_matches(line, '{UNMARKED}'))) AS bad FROM f),
l AS (SELECT rid, sum(CASE WHEN bad THEN length(line) ELSE 0 END) AS lost,
      count(*) FILTER (nw > 0) - count(DISTINCT line) FILTER (nw > 0) AS dup FROM j GROUP BY rid),
o AS (SELECT doc_id, len(w)::BIGINT AS n_words, {bare}::BIGINT AS word_chars, {count('t', SYMBOLS)}::BIGINT AS n_symbols,
      dup::BIGINT AS n_dup_lines, coalesce(r, 0)::BIGINT AS n_repeat_words, lost, length(t) AS size
      FROM w JOIN l USING (rid) LEFT JOIN rep USING (rid))
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words,
  (n_words < {MIN_WORDS} OR 100 * n_repeat_words > {MAX_REPEATED} * n_words) AS base_failed,
  NOT (n_words < {MIN_WORDS} OR 100 * n_repeat_words > {MAX_REPEATED} * n_words) AND 100 * lost <= {MAX_LOST} * size AS kept
FROM o"""
