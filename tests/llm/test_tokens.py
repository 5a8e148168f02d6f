"""BPE and packing against the tokenizers library."""

import itertools
import random
import zlib

import numpy as np
import pytest
from tokenizers import Tokenizer

from ledgerlake.llm import bpe, packing

TEXTS = ["", None, " ", "  ", "a", " a", "a ", "a  b", "a \n b", "foo\n bar", "foo \nbar", "x\n\n\ty ", "it's we're I'LL 's ' s",
         "Straße über çà ñ 東京 タワー 123 ²³ ¼ ½x", "a b  c\u0085d\x1ce \x1f f", "é ​ 👩‍👩‍👧 ok", "<|endoftext|>",
         "a<|endoftext|> b <|endoftext|>", "<|endoftext|", "x" * 5000, "ab" * 3000 + " " + "!" * 700, "thetheothe " * 50,
         "\x00\x01", "1234567890" * 40, " \t\n\x0b\f\r ", "ﬁ Ⅷ ª º × ÷", "don't  stop\n\n  now"]


@pytest.fixture(scope="module")
def library():
    return Tokenizer.from_file(bpe.public_vocabulary())


def random_texts(n):
    rnd = random.Random(5)
    parts = ["the", "ing", " ", "  ", "\n", "é", "ß", "'s", "'", "9", "2024", ".", ",", "!!", "***", "東", " ", "<|endoftext|>", "a", "Q", "\t"]
    return ["".join(rnd.choice(parts) for _ in range(rnd.randrange(60))) for _ in range(n)]


def frame(spark, texts):
    rows = [(i, t, "x", "y", 5) for i, t in enumerate(texts)]  # columns that share names with results
    return spark.createDataFrame(rows, "doc_id long, text string, ids string, tokens string, start int").repartition(3)


def test_ids_and_round_trip(spark, library, monkeypatch):
    texts = TEXTS + random_texts(300)
    got = {r.doc_id: r for r in bpe.encode(frame(spark, texts), decoded=True).collect()}
    for i, t in enumerate(texts):
        want = library.encode(t or "", add_special_tokens=False).ids
        assert got[i].ids == want, repr(t)
        assert got[i].decoded == (t or "") == library.decode(want, skip_special_tokens=False)
    back = {r.doc_id: r.text for r in bpe.decode(bpe.encode(frame(spark, texts))).collect()}
    assert back == {i: t or "" for i, t in enumerate(texts)}


def test_full_table_still_encodes(library):
    own = bpe.ByteBpe(bpe.public_vocabulary())
    table = bpe.PieceTable(lambda p: [own.encode_piece(x) for x in p], own.added, keep=3)
    for t in random_texts(80):
        assert np.frombuffer(table.ids(t), "<u4").tolist() == library.encode(t, add_special_tokens=False).ids


def test_every_short_mix_of_white_space(library):
    """All strings up to length 6 of a letter, a digit and four kinds of white space, and random longer ones."""
    alphabet = "a1 \u00a0\t\n"
    texts = ["".join(x) for n in range(7) for x in itertools.product(alphabet, repeat=n)]
    rnd = random.Random(3)
    wide = alphabet + " \u3000\u2028\x1cb.'é"
    texts += ["".join(rnd.choice(wide) for _ in range(rnd.randrange(7, 40))) for _ in range(20_000)]
    texts.append("Prix : \xa0 \xa0 12 euros")
    _, table = bpe._table(bpe.public_vocabulary())
    for t, want in zip(texts, library.encode_batch(texts, add_special_tokens=False), strict=True):
        assert np.frombuffer(table.ids(t), "<u4").tolist() == want.ids, repr(t)


def test_packing(spark, library):
    texts = [*TEXTS, "word " * 5000, *random_texts(100)]
    rows = packing.pack(frame(spark, texts)).collect()
    assert len({r.sequence_id for r in rows}) == len(rows)
    for i, t in enumerate(texts):
        ids = [*library.encode(t or "", add_special_tokens=False).ids, 1]
        mine = sorted((r for r in rows if r.doc_id == i), key=lambda r: r.start)
        assert [r.start for r in mine] == np.r_[0, np.cumsum([r.length for r in mine])][:-1].tolist()
        assert b"".join(bytes(r.tokens) for r in mine) == np.array(ids, "<u4").tobytes()
        assert all(r.length == 1 << r.bucket <= 2048 and r.offset == 0 and r.doc_tokens == len(ids) for r in mine)
        assert sum(zlib.crc32(bytes(r.tokens)) >= 0 for r in mine) == len(mine)
        assert sorted((r.length for r in mine), reverse=True) == packing.cuts(len(ids))


def test_long_runs_and_unusual_text(library):
    fast = packing.Encoder(bpe.public_vocabulary())
    rnd = random.Random(9)
    odd = ["".join(chr(rnd.choice([rnd.randrange(32, 127), rnd.randrange(0x20, 0x500), rnd.randrange(0x2000, 0x3100), rnd.randrange(0x10000, 0x1F700)]))
                   for _ in range(200)) for _ in range(300)]
    assert fast.ordered
    for t in [*TEXTS, *odd, *random_texts(500), "x" * 250_000, "!?" * 60_000 + " end",
              "".join(rnd.choice("abcdefghijé") for _ in range(150_000)), " " * 120_000 + "x", "1" * 110_000]:
        assert fast.ids(t or "").tolist() == library.encode(t or "", add_special_tokens=False).ids


def test_repeated_rows(spark):
    df = spark.createDataFrame([(1, "one text")] * 3 + [(1, "other"), (None, None)], "doc_id long, text string")
    assert sorted(len(r.ids) for r in bpe.encode(df).collect()) == [0, 1, 2, 2, 2]
    assert sum(r.length for r in packing.pack(df).collect()) == 3 * 3 + 2 + 1


def test_empty_tables(spark):
    assert bpe.encode(frame(spark, []).limit(0)).collect() == [] and packing.pack(frame(spark, []).limit(0)).collect() == []
