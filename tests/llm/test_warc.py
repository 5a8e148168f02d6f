"""Archives: exact round trip, revisits, and the merged order."""

import gzip
import random
from collections import Counter
from pathlib import Path

import duckdb
import pandas as pd

from ledgerlake.llm import queries, warc


def rows():
    rnd = random.Random(2)
    big = ["é" * 600 + str(i) for i in range(3)]
    out = [(i, rnd.choice([f"http://www.a{i % 3}.Example.org:80/p/{i % 5}?q=1#x", "https://b.net", "ftp://u:p@c.d.e/x/Y"]),
            rnd.choice([*big, "small", "x" * 999, "y" * 1000, "", None, "a\r\n\r\n\r\n\r\nWARC/1.0\r\n\r\n" * 60]))
           for i in range(80)]
    return out + [(200, None, "no url" * 300), (201, "http://x/\r\nEvil: 1", "t"), (None, "http://n", big[0]), (79, *out[79][1:]), (900, "http://h/", "h" * 3_000_000)]


def frame(spark):
    return spark.createDataFrame([(*r, 5) for r in rows()], "page_id long, url string, html string, digest int").repartition(4)


def test_round_trip_and_types(spark):
    path = warc.write_archives(frame(spark))
    got = warc.read_archives(spark, path).collect()
    want = rows()
    assert len(got) == len(want)
    html = {(i, h or "") for i, _, h in want}
    for r in got:
        if r.record_type == "response":
            assert (r.page_id, r.payload) in html
        else:
            assert r.payload == "" and (r.page_id, next(h for i, _, h in want if i == r.refers_to)) in html
    raw = b"".join(gzip.decompress(p.read_bytes()) for p in sorted(Path(path).glob("*.gz")))
    assert raw.count(b"WARC-Type: ") >= len(want) and b"\r\nEvil" not in raw


def test_query_agrees_with_sql(spark, tmp_path):
    frame(spark).write.parquet(str(tmp_path / "pages.parquet"))
    got = Counter(tuple(r) for r in queries.op2_warc(spark, str(tmp_path)).collect())
    pages = pd.DataFrame({"page_id": pd.array([r[0] for r in rows()], "Int64"), "html": [r[2] for r in rows()]})  # noqa: F841
    assert got == Counter(duckdb.connect().execute(warc.sql()).fetchall())


def test_histories_are_globally_ordered(spark):
    captures = warc.read_archives(spark, warc.write_archives(frame(spark)), with_payload=False)
    got = warc.capture_histories(captures, 6).collect()
    key = lambda r: (r.url_key, r.captured_at, r.page_id is not None, r.page_id or 0)
    merged = sorted(got, key=lambda r: (r.range_id, r.position))
    assert [key(r) for r in merged] == sorted(map(key, got)) and len(got) == len(rows())


def test_archives_and_ranges_are_bounded(spark, monkeypatch):
    monkeypatch.setattr(warc, "FILE_BYTES", 200_000)
    monkeypatch.setattr(warc, "RANGE_ROWS", 25)
    page = [(i, "http://one.example/" if i % 3 else f"http://h{i}/", "t" * 4000 + str(i)) for i in range(300)]
    df = spark.createDataFrame(page + [page[7]] * 100, "page_id long, url string, html string").repartition(3)
    path = warc.write_archives(df)
    assert len(list(Path(path).glob("*.gz"))) >= 400 * 4000 // 200_000
    got = warc.capture_histories(warc.read_archives(spark, path, with_payload=False)).collect()
    assert len(got) == 400 and len({r.range_id for r in got}) >= 12 and max(Counter(r.range_id for r in got).values()) <= 75
    merged = sorted(got, key=lambda r: (r.range_id, r.position))
    key = lambda r: (r.url_key, r.captured_at, r.page_id)
    assert [key(r) for r in merged] == sorted(map(key, got))


def test_loser_tree():
    rnd = random.Random(1)
    for k in (0, 1, 2, 3, 5, 8, 13):
        runs = [sorted(rnd.randrange(50) for _ in range(rnd.randrange(9))) for _ in range(k)]
        assert list(warc.LoserTree(runs, lambda x: x)) == sorted(x for r in runs for x in r)


def test_url_keys_and_empty(spark):
    assert warc.url_key("https://www.Example.org:443/A?b#c") == "org,example)/a?b"
    assert warc.url_key("") == ")/"
    path = warc.write_archives(frame(spark).limit(0))
    assert warc.capture_histories(warc.read_archives(spark, path)).collect() == []
