"""WARC archives of pages: writing with revisit records, reading, and a merged capture index.

Writing. Each page becomes one record; the payload is the html in UTF-8 behind
a short HTTP head. Of records with equal payloads of ``LEAST`` bytes or more
(same SHA-1, SHA-256 and length) the one with the largest page_id is the
response and the others are revisits without a payload that refer to it.
Spark's text writer puts the records into gzip files: a record ends with two
line breaks, which is the writer's line separator.

Reading. Files are parsed by Content-Length; the digest of each payload is
taken again and must agree with the record's.

An archive holds FILE_BYTES of payload on average (``binaryFile`` reads one as
a cell), so a task's memory does not grow with the pages' number.

Index. Every archive gives a locally sorted run of captures. The runs are
dealt by range of (URL key, timestamp, page_id, file, offset), RANGE_ROWS
captures a range, and in each range a loser tree merges them k ways. Ranges are
in order, so (range_id, position) orders all captures; a URL with a large part
of all captures, or one row repeated often, spans several ranges.

Defined cases: a null html is an empty payload; a null url has an empty key; a
null page_id is always a response; rows with one page_id and one payload are
all responses; line breaks in a url are percent-encoded; a very long payload
has an archive of its own size; an empty table gives no captures; further
columns, whatever their names, are ignored.
"""

from __future__ import annotations

import hashlib
import re
import zlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ledgerlake.llm.tables import columns, salted_left_join, written
from ledgerlake.session import scratch_path

LEAST = 1000
FILE_BYTES = 64 << 20  # of payload in an archive, on average
RANGE_ROWS = 20_000  # captures that one task merges
EPOCH = 1_700_000_000  # captures without a time are one second apart, by page_id
_END = "\r\n"
_CAPTURE = ("url_key string, captured_at string, page_id long, url string, record_type string, payload_bytes long, "
            "payload_digest string, refers_to long, file string, record_offset long, payload string")


def _classified(pages: DataFrame, least: int) -> DataFrame:
    """payload, its digest and length, and for revisits the response's page_id and url."""
    p = columns(pages, ["page_id", "url", "html"]).select(
        F.col("page_id").cast("long").alias("page_id"),
        F.regexp_replace(F.regexp_replace("url", "\r", "%0D"), "\n", "%0A").alias("url"),
        F.coalesce("html", F.lit("")).alias("payload"))
    p = p.withColumn("digest", F.sha1("payload")).withColumn("bytes", F.octet_length("payload").cast("long"))
    light = p.where(F.col("bytes") >= least).select("page_id", "url", "digest", "bytes", F.sha2("payload", 256).alias("d2"))
    key = ["digest", "d2", "bytes"]
    kept = (light.where("page_id is not null").groupBy(*key).agg(
        F.max(F.struct("page_id", F.coalesce("url", F.lit("")).alias("url"))).alias("k"), F.min("page_id").alias("lo"))
        .where("k.page_id <> lo"))
    # a payload that many pages share is dealt over several tasks
    again = (salted_left_join(light, kept, key, F.col("page_id")).where(F.col("page_id") < F.col("k.page_id"))
             .select("page_id", "digest", F.col("k.page_id").alias("refers_to"), F.col("k.url").alias("refers_url")).distinct())
    return p.join(again, ["page_id", "digest"], "left")


def _head(name: str, value) -> object:
    return F.when(value.isNotNull(), F.concat(F.lit(f"{name}: "), value.cast("string"), F.lit(_END))).otherwise(F.lit(""))


def _record_id(page, digest):
    h = F.md5(F.concat_ws("|", page.cast("string"), digest))
    part = lambda a, n: F.substring(h, a, n)
    return F.concat(F.lit("<urn:uuid:"), F.concat_ws("-", part(1, 8), part(9, 4), part(13, 4), part(17, 4), part(21, 12)), F.lit(">"))


def write_archives(pages: DataFrame, path: str | None = None, least: int = LEAST) -> str:
    """Write one WARC record per row of ``pages`` (page_id, url, html) to gzip files in ``path``; returns the folder."""
    path = path or scratch_path(pages.sparkSession, "warc")
    p = _classified(pages, least)
    revisit = F.col("refers_to").isNotNull()
    http = F.concat(F.lit("HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: "),
                    F.col("bytes").cast("string"), F.lit("\r\n\r\n"))
    date = F.date_format(F.timestamp_seconds(F.lit(EPOCH) + F.pmod(F.coalesce("page_id", F.lit(0)), F.lit(10**9))),
                         "yyyy-MM-dd'T'HH:mm:ss'Z'")
    length = F.length(http) + F.when(revisit, F.lit(0)).otherwise(F.col("bytes"))
    record = F.concat(
        F.lit("WARC/1.0\r\n"), _head("WARC-Type", F.when(revisit, F.lit("revisit")).otherwise(F.lit("response"))),
        _head("WARC-Record-ID", _record_id(F.col("page_id"), F.col("digest"))), _head("WARC-Date", date),
        _head("WARC-Target-URI", F.col("url")), _head("WARC-Payload-Digest", F.concat(F.lit("sha1:"), F.col("digest"))),
        _head("X-Page-Id", F.col("page_id")),
        F.when(revisit, F.concat(
            F.lit("WARC-Profile: http://netpreserve.org/warc/1.0/revisit/identical-payload-digest\r\n"),
            _head("WARC-Refers-To", _record_id(F.col("refers_to"), F.col("digest"))),
            _head("WARC-Refers-To-Target-URI", F.col("refers_url")), _head("X-Refers-To-Page-Id", F.col("refers_to")))
               ).otherwise(F.lit("")),
        F.lit("Content-Type: application/http; msgtype=response\r\nContent-Length: "), length.cast("string"), F.lit("\r\n\r\n"),
        http, F.when(revisit, F.lit("")).otherwise(F.col("payload")))
    mean = pages.agg(F.avg(F.octet_length("html"))).first()[0] or 0
    (p.select(record.alias("value")).write.option("lineSep", "\r\n\r\n").option("compression", "gzip")
     .option("maxRecordsPerFile", max(1, int(FILE_BYTES // (mean + 512)))).text(path))
    return path


def url_key(url: str) -> str:
    """Sort-friendly form: the host's labels reversed, then path and query; no scheme, port, user, www or fragment."""
    m = re.match(r"(?:[A-Za-z][A-Za-z0-9+.-]*:)?(?://)?(?:[^/?#@]*@)?([^/?#:]*)(?::\d*)?([^#]*)", url)
    host, rest = m[1].lower(), m[2] or "/"
    host = host.removeprefix("www.")
    return ",".join(reversed(host.split("."))) + ")" + rest.lower()


class _Inflated:
    """Sequential reads of a gzip file's content without holding all of it."""

    def __init__(self, data: memoryview, step: int = 1 << 20):
        self.data, self.step, self.at = data, step, 0
        self.inflate = zlib.decompressobj(31)
        self.held = bytearray()
        self.offset = 0

    def more(self) -> bool:
        while self.at < len(self.data):
            out = self.inflate.decompress(bytes(self.data[self.at:self.at + self.step]))
            self.at += self.step
            if self.inflate.eof and self.inflate.unused_data:  # the next gzip member
                self.at -= len(self.inflate.unused_data) + max(0, self.at - len(self.data))
                self.inflate = zlib.decompressobj(31)
            if out:
                self.held += out
                return True
        return False

    def until(self, mark: bytes) -> bytes | None:
        seen = 0
        while (i := self.held.find(mark, max(0, seen - len(mark)))) < 0:
            seen = len(self.held)
            if not self.more():
                return None
        return self.take(i + len(mark))

    def take(self, n: int) -> bytes:
        while len(self.held) < n and self.more():
            pass
        out = bytes(self.held[:n])
        del self.held[:n]
        self.offset += len(out)
        return out


def records(data: memoryview) -> Iterator[tuple[dict[str, str], bytes, int]]:
    """(fields, block, offset in the inflated file) of each record of a gzip archive."""
    source = _Inflated(data)
    while True:
        at = source.offset
        head = source.until(b"\r\n\r\n")
        if head is None:
            if source.held:
                raise ValueError(f"unreadable bytes at {at}")
            return
        lines = head.decode("utf-8").split("\r\n")
        if not lines[0].startswith("WARC/"):
            raise ValueError(f"no record at {at}")
        fields = {k.lower(): v.strip() for k, _, v in (x.partition(":") for x in lines[1:] if x)}
        size = int(fields["content-length"])
        block = source.take(size)
        if len(block) != size or source.take(4) != b"\r\n\r\n":
            raise ValueError(f"record at {at} is cut short")
        yield fields, block, at


def _captures(with_payload: bool):
    names = [x.split()[0] for x in _CAPTURE.split(", ")]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for file, data in zip(batch.column("path").to_pylist(), batch.column("content"), strict=True):
                run_rows = []
                for fields, block, at in records(memoryview(data.as_buffer())):
                    http, _, payload = block.partition(b"\r\n\r\n")
                    digest = fields["warc-payload-digest"].removeprefix("sha1:")
                    kind = fields["warc-type"]
                    size = int(re.search(rb"(?i)content-length: *(\d+)", http)[1])
                    if kind == "response" and (len(payload) != size or hashlib.sha1(payload).hexdigest() != digest):
                        raise ValueError(f"payload of the record at {at} in {file} does not agree with its digest")
                    page, refers = fields.get("x-page-id"), fields.get("x-refers-to-page-id")
                    url = fields.get("warc-target-uri")
                    run_rows.append((url_key(url or ""), fields["warc-date"], page and int(page), url, kind, size, digest,
                                     refers and int(refers), file, at, payload.decode("utf-8") if with_payload else None))
                run_rows.sort(key=_order)  # the archive's run
                for i in range(0, len(run_rows), 2000):
                    yield pa.RecordBatch.from_arrays(
                        [pa.array(c, t) for c, t in zip(zip(*run_rows[i:i + 2000], strict=True), _TYPES, strict=True)], names)

    return run


_TYPES = [pa.int64() if x.endswith("long") else pa.string() for x in _CAPTURE.split(", ")]


def _order(row):
    return row[0], row[1], row[2] is not None, row[2] or 0, row[9]


def read_archives(spark: SparkSession, path: str, with_payload: bool = True) -> DataFrame:
    """One row per record of the archives in ``path``; each archive's rows are a sorted run."""
    files = spark.read.format("binaryFile").option("pathGlobFilter", "*.gz").load(path).select("path", "content")
    return files.mapInArrow(_captures(with_payload), _CAPTURE)


class LoserTree:
    """K-way merge of sorted runs: each inner node keeps the loser of its match, the winner goes up."""

    def __init__(self, runs: list[list], key):
        self.runs, self.key = runs, key
        self.at = [0] * len(runs)
        self.k = max(1, len(runs))
        self.tree = [-1] * self.k
        for i in range(len(runs)):
            self._play(i)

    def _head(self, i: int):
        run = self.runs[i]
        return (0, self.key(run[self.at[i]]), i) if self.at[i] < len(run) else (1, None, i)

    def _less(self, a: int, b: int) -> bool:
        x, y = self._head(a), self._head(b)
        return x[0] < y[0] or x[0] == y[0] and (x[0] == 1 and a < b or x[0] == 0 and x[1:] < y[1:])

    def _play(self, i: int) -> None:
        node = (i + self.k) // 2
        while node > 0:
            other = self.tree[node]
            if other < 0:
                self.tree[node] = i
                return
            if self._less(other, i):
                self.tree[node], i = i, other
            node //= 2
        self.tree[0] = i

    def __iter__(self):
        if not self.runs:
            return
        while True:
            i = self.tree[0]
            if self.at[i] >= len(self.runs[i]):
                return
            yield self.runs[i][self.at[i]]
            self.at[i] += 1
            self._play(i)


def _merge(names: list[str], types: list[pa.DataType]):
    key = [names.index(x) for x in ("url_key", "captured_at", "page_id", "record_offset", "file")]

    def order(row):
        u, t, p, o, f = (row[i] for i in key)
        return u, t, p is not None, p or 0, f, o

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext
        runs: dict[str, list] = {}
        file = names.index("file")
        for batch in batches:  # sorted by archive: each archive's part of this range is one run
            for row in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                runs.setdefault(row[file], []).append(row)
        here, position, out = TaskContext.get().partitionId(), 0, []

        def send():
            cols = [pa.array(c, t) for c, t in zip(zip(*out, strict=True), types, strict=True)]
            first = position - len(out)
            return pa.RecordBatch.from_arrays(
                [*cols, pa.array([here] * len(out), pa.int32()), pa.array(range(first, position), pa.int64())],
                [*names, "range_id", "position"])

        for row in LoserTree(list(runs.values()), order):
            out.append(row)
            position += 1
            if len(out) == 5000:
                yield send()
                out = []
        if out:
            yield send()

    return run


def capture_histories(captures: DataFrame, ranges: int | None = None) -> DataFrame:
    """The captures in global order: range_id and position sort them by URL key, time and page_id."""
    spark = captures.sparkSession
    runs = written(captures.drop("payload"), "warc-runs")  # read twice: range bounds, then the merge
    ranges = ranges or max(1, -(-runs.count() // RANGE_ROWS))
    schema = runs.schema
    types = [pa.int64() if f.dataType.simpleString() == "bigint" else pa.string() for f in schema]
    kind = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in schema) + ", range_id int, position long"
    return (runs.repartitionByRange(ranges, "url_key", "captured_at", "page_id", "file", "record_offset")
            .sortWithinPartitions("file", "url_key", "captured_at", "page_id", "record_offset")
            .mapInArrow(_merge([f.name for f in schema], types), kind))


def sql(table: str = "pages", least: int = LEAST) -> str:
    return f"""
WITH p AS (SELECT page_id, coalesce(html, '') AS h FROM {table}),
k AS (SELECT h, max(page_id) AS k FROM p WHERE strlen(h) >= {least} GROUP BY h)
SELECT page_id, strlen(h)::BIGINT AS payload_bytes, sha1(h) AS payload_digest,
  CASE WHEN page_id < k THEN 'revisit' ELSE 'response' END AS record_type,
  CASE WHEN page_id < k THEN k END AS refers_to
FROM p LEFT JOIN k USING (h)"""
