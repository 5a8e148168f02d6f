"""Line rules against a plain Python version and the DuckDB SQL."""

import random
import re
from collections import Counter

import duckdb
import pandas as pd
from pyspark.sql import functions as F

from ledgerlake.llm import line_rules as R

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def rows():
    rnd = random.Random(3)
    word = lambda: rnd.choice(["alpha", "beta", "gamma", "delta", "épsilon", "zeta", "straße", "x*"]) + str(rnd.randrange(40))
    line = lambda n, end=".": " ".join(word() for _ in range(n)) + end
    out = [line(80), line(30) + "\n" + line(30), "", None, " \n\t ", "a a a a", "a b", "a b c", "same " * 80,
           "\n".join([line(60), "Home | About | News | Help", "Home | About | News | Help", ""]),
           "\n".join([line(40), " ".join(word().upper() for _ in range(60)) + "!!"]),
           "\n".join(["We use cookies. See our Privacy Policy.", line(70), line(70)]),
           " ".join(word() + "###" for _ in range(90)) + ".", line(60) * 2, "one two three " * 4 + line(80),
           line(20, "") + "\n" + line(80), line(20, " / » @x") + "\n" + line(80), line(60, "؟"), line(60, " ।"), line(20, " ไทย") + "\n" + line(60),
           line(60, "！") + "\nTous droits réservés, conditions d'utilisation.", "\x0b" + line(55) + "\r\n　" + line(10) + "\u0085x", line(9000)]
    return [(i % 21, t) for i, t in enumerate(out)] + [(None, out[0])]


def counts(text):
    text = text or ""
    w = WORD.findall(text)
    g = [tuple(w[i:i + 3]) for i in range(len(w) - 2)]
    c = Counter(g)
    hit = {p for i, x in enumerate(g) if c[x] > 1 for p in (i, i + 1, i + 2)}
    lines = [x for x in text.split("\n") if WORD.search(x)]
    base = len(w) < 50 or 100 * len(hit) > 50 * len(w)
    return len(w), sum(map(len, w)), sum(x in "#*$%&|<>" for x in text), len(lines) - len(set(lines)), len(hit), base


NAMES = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed"]


def test_counts_and_sql(spark):
    data = rows()
    df = spark.createDataFrame([(i, t, "k") for i, t in data], "doc_id long, text string, kept string")
    got = R.line_first(df).select("doc_id", *NAMES, "kept").collect()
    want = [(i, *counts(t)) for i, t in data]
    assert Counter(tuple(r)[:-1] for r in got) == Counter(want)
    documents = pd.DataFrame({"doc_id": pd.array([i for i, _ in data], "Int64"), "text": [t for _, t in data]})  # noqa: F841
    sql = duckdb.connect().execute(R.sql()).fetchall()
    assert Counter(map(tuple, got)) == Counter(sql)


def test_lines_are_removed_and_losers_rejected(spark):
    data = {r.doc_id: r for r in R.line_first(spark.createDataFrame(rows()[:-1], "doc_id long, text string")).collect()}
    assert "|" not in data[9].clean_text and data[9].n_removed_lines == 2 and data[9].kept
    assert not data[10].kept and not data[10].base_failed
    assert "Privacy" not in data[11].clean_text and data[11].kept
    assert not data[12].kept and data[2].clean_text == ""


def test_prose_of_every_script_is_kept(spark):
    say = lambda words, mark: "\n".join(" ".join(f"{w}{i * 7 + k}" for k, w in enumerate(words * 3)) + mark for i in range(8))
    texts = {"arabic": say(["كتاب", "مدينة", "طريق", "بيت", "شمس"], "؟"), "hindi": say(["किताब", "शहर", "रास्ता", "घर", "सूरज"], "।"),
             "chinese": say(["书", "城市", "道路", "房子", "太阳"], "！"), "amharic": say(["ቤት", "ከተማ", "መንገድ", "ፀሐይ", "ውሃ"], "።"),
             "thai": say(["บ้าน", "เมือง", "ถนน", "น้ำ", "ฟ้า"], ""), "none": say(["house", "city", "road", "water", "sky"], "")}
    out = R.line_first(spark.createDataFrame(list(texts.items()), "lang string, text string")).collect()
    assert {r.lang: (r.kept, r.n_removed_lines) for r in out} == {k: (k != "none", 8 * (k == "none")) for k in texts}


def test_clashing_names(spark):
    names = ["n_words", "clean_text", "lost_chars", "_t", "_facts", "_w", "extra"]
    df = spark.createDataFrame([(i, t) for i, t in rows()], "doc_id long, text string")
    clash = df.select("*", *[F.lit("x").alias(n) for n in names])
    out = R.line_first(clash)
    assert set(out.columns) == {*R.line_first(df).columns, "extra"}
    assert Counter(out.drop("extra").select(*R.line_first(df).columns).collect()) == Counter(R.line_first(df).collect())


def test_empty_table(spark):
    assert R.line_first(spark.createDataFrame([], "doc_id long, text string")).collect() == []


def test_no_python_in_the_plan(spark):
    df = R.line_first(spark.createDataFrame([(1, "a")], "doc_id long, text string"))
    plan = df._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Arrow" not in plan and "Exchange" not in plan
