"""The pipeline against a brute-force version of its stages."""

import random
import re
import sys
from pathlib import Path

import numpy as np
from tokenizers import Tokenizer

sys.path.insert(0, str(Path(__file__).parent))

import corpus_pipeline as P  # noqa: E402
import test_minhash  # noqa: E402
import test_substring_dedup  # noqa: E402
from ledgerlake.llm import bpe, packing, secret_ledger  # noqa: E402
from ledgerlake.llm.line_rules import line_first  # noqa: E402

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def corpus():
    rnd = random.Random(8)
    word = lambda: rnd.choice("abcdefgh") + str(rnd.randrange(700))
    text = lambda n: " ".join(word() for _ in range(n)) + "."
    passage, base = text(70), text(200)
    out = [(i * 2, text(rnd.randrange(60, 160))) for i in range(20)]
    out += [(100 + i, " ".join(w if rnd.random() > 0.01 else word() for w in base.split())) for i in range(8)]
    out += [(200 + i, f"{text(60)}\n{passage}\n{text(30)}") for i in range(6)]
    out += [(300, "password=b7db7aa4a5fcc78305 " + text(80)), (301, "too short"), (302, "same " * 100), (303, None), (304, ""),
            (305, text(60) + "\nHome | News | About | More"), (306, passage), (0, out[0][1]), (0, out[0][1]), (307, " ".join([text(50)] * 2)),
            (None, passage), (400, text(9000)), (2, text(75)), (4, text(90))]
    return out


def brute(spark, rows):
    df = spark.createDataFrame([(i, r[0], r[1]) for i, r in enumerate(rows)], "n long, doc_id long, text string")
    docs = [(rows[r.n][0], r.clean_text) for r in line_first(df).orderBy("n").collect() if r.kept]  # tested by its own SQL
    kept = {r[0] for r in test_minhash.brute(docs) if r[3]}
    docs = list({d: t for d, t in sorted((x for x in docs if x[0] is not None), reverse=True) if d in kept}.items()) + [
        x for x in docs if x[0] is None]
    left = {r[0]: r for r in test_substring_dedup.brute([x for x in docs if x[0] is not None], 50)}
    docs = [(d, left[d][3]) for d in left if left[d][2] == 0 or left[d][2] < left[d][1]] + [x for x in docs if x[0] is None]
    out = []
    for d, t in docs:
        spans, at, parts = secret_ledger.scan(t, secret_ledger.RULES), 0, []
        for _, s, e in spans:
            if s >= at:
                parts += [t[at:s], "[SECRET]"]
            at = max(at, e)
        out.append((d, "".join(parts) + t[at:]))
    return sorted(out, key=str)


def words(rows):
    return sorted([(d, " ".join(WORD.findall(t))) for d, t in rows], key=str)


def frame(spark, rows):
    return spark.createDataFrame([(d, t, "en", None, 0, "z") for d, t in rows],
                                 "doc_id long, text string, lang string, source string, n_chars long, kept string").repartition(3)


def test_pipeline_matches_brute_force(spark, tmp_path):
    rows = corpus()
    docs = frame(spark, rows)
    for name, stage in P.STAGES[:-1]:
        docs = stage(spark, docs, "")
        assert docs.columns == P.COLUMNS, name
        docs.write.parquet(str(tmp_path / name))
        docs = spark.read.parquet(str(tmp_path / name))
    got = docs.collect()
    want = brute(spark, rows)
    assert words([(r.doc_id, r.text) for r in got]) == words(want)
    assert all(r.n_chars == len(r.text) and r.lang == "en" for r in got)
    frame(spark, rows).write.parquet(str(tmp_path / "documents.parquet"))
    pieces = P.run(spark, str(tmp_path)).collect()
    library = Tokenizer.from_file(bpe.public_vocabulary())
    ids = {r.doc_id: [*library.encode(r.text, add_special_tokens=False).ids, 1] for r in got}
    for d, want_ids in ids.items():
        mine = sorted((r for r in pieces if r.doc_id == d), key=lambda r: r.start)
        assert b"".join(bytes(r.tokens) for r in mine) == np.array(want_ids, "<u4").tobytes()
        assert [r.length for r in mine] == packing.cuts(len(want_ids))


def test_empty_table_and_registration(spark, tmp_path):
    frame(spark, []).limit(0).write.parquet(str(tmp_path / "documents.parquet"))
    assert P.run(spark, str(tmp_path)).collect() == []
    import __spark_entry__ as E
    names = E.queries()
    assert "pipeline" in names and sum(n.startswith("op") for n in names) == 13
