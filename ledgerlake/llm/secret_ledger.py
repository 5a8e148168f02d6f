"""Secret scans over an incremental blob ledger.

Every version of a file is addressed by the SHA-256 of its content. The ledger
holds, per blob, which rules at which version have been applied and what they
found. A run scans only pairs of blob and rule version that the ledger lacks,
appends them, and joins the findings back to every path that has the blob.

A rule has a gate, a short pattern that each match contains. Gates run in the
JVM on whole texts where they lie; a blob that passes no gate is entered
without findings and never leaves its task. Of the others one copy a blob is
sent to the scan.

Offsets are code points, the end is exclusive. Defined cases: a null content
is an empty one; repeated rows are separate paths of one blob; a very long
content is scanned whole, once a blob; an empty table enters nothing; of columns
with clashing names see ``findings``.
"""

from __future__ import annotations

import re
from collections.abc import Iterator, Sequence
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ledgerlake.llm.tables import salted_left_join
from ledgerlake.session import scratch_path


@dataclass(frozen=True)
class Rule:
    """A kind of secret. ``group`` is the part that must have ``least`` characters; gate: Java and Python syntax."""

    kind: str
    version: int
    pattern: str
    gate: str
    group: int = 0
    least: int = 1
    any_case: bool = False

    @property
    def key(self) -> str:
        return f"{self.kind}@{self.version}"


# Kinds and patterns (fixed values).
BASE = (
    Rule("assign", 1, r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""",
         r"(?i)(password|passwd|secret|token|api_?key)[\"']?\x20*[:=]", 2, 8, True),
    Rule("access", 1, r"AKIA[A-Z0-9]+", r"AKIA[A-Z0-9]{12}", 0, 16),
    Rule("hex", 1, r"[0-9a-f]{32,}", r"[0-9a-f]{32}", 0, 32),
)
# Added by the method; formats that hardly occur by chance.
ADDED = (
    Rule("private_key", 1, r"-----BEGIN [A-Z ]{0,20}PRIVATE KEY-----[A-Za-z0-9+/=\s]*(?:-----END [A-Z ]{0,20}PRIVATE KEY-----)?",
         r"PRIVATE KEY-----"),
    Rule("forge_token", 1, r"gh[pousr]_[A-Za-z0-9]{36,}", r"gh[pousr]_[A-Za-z0-9]{36}"),
    Rule("web_token", 1, r"eyJ[A-Za-z0-9_-]{10,}\.eyJ[A-Za-z0-9_-]{10,}\.[A-Za-z0-9_-]{10,}", r"eyJ[A-Za-z0-9_-]{10}"),
)
RULES = BASE + ADDED

FINDINGS = "array<struct<kind:string,start:int,stop:int>>"
LEDGER = f"blob binary, rules array<string>, findings {FINDINGS}"


def scan(text: str, rules: Sequence[Rule]) -> list[tuple[str, int, int]]:
    """Leftmost non-overlapping matches of each rule, by start, then in the order of the rules."""
    out = []
    for order, r in enumerate(rules):
        flags = re.ASCII | (re.IGNORECASE if r.any_case else 0)
        for m in re.finditer(r.pattern, text, flags):
            if len(m[r.group]) >= r.least:
                out.append((m.start(), order, m.end()))
    return [(rules[o].kind, s, e) for s, o, e in sorted(out)]


def _scan_batches(rules: Sequence[Rule]):
    kind = pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int32()), ("stop", pa.int32())]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = []
            for text, keys in zip(batch.column("content").to_pylist(), batch.column("todo").to_pylist(), strict=True):
                todo = [r for r in rules if r.key in keys]
                found.append([{"kind": k, "start": s, "stop": e} for k, s, e in scan(text, todo)])
            yield pa.RecordBatch.from_arrays([batch.column("blob"), pa.array(found, kind)], ["blob", "findings"])

    return run


def _blob(content: Column) -> Column:
    return F.unhex(F.sha2(content, 256))


def empty_ledger(spark) -> DataFrame:
    return spark.createDataFrame([], LEDGER)


def unseen(versions: DataFrame, ledger: DataFrame, rules: Sequence[Rule] = RULES) -> DataFrame:
    """(blob, todo): the blobs of ``versions`` with the rule versions the ledger has not applied to them."""
    wanted = F.array(*[F.lit(r.key) for r in rules])
    blobs = versions.select(_blob(F.coalesce("content", F.lit(""))).alias("blob")).distinct()
    seen = ledger.groupBy("blob").agg(F.array_distinct(F.flatten(F.collect_list("rules"))).alias("_seen"))
    return (blobs.join(seen, "blob", "left")
            .select("blob", F.array_except(wanted, F.coalesce("_seen", F.array().cast("array<string>"))).alias("todo"))
            .where(F.size("todo") > 0))


def ledger_entries(versions: DataFrame, ledger: DataFrame, rules: Sequence[Rule] = RULES) -> DataFrame:
    """The rows to append to the ledger: every unseen pair of blob and rule version, with what was found."""
    todo = unseen(versions, ledger, rules)
    content = F.coalesce(F.col("content"), F.lit(""))
    gate = F.lit(False)
    for r in rules:
        gate = gate | content.rlike(r.gate)
    suspects = (versions.select(content.alias("content")).where(gate)
                .select(_blob(F.col("content")).alias("blob"), "content").dropDuplicates(["blob"]))
    found = suspects.join(todo, "blob").mapInArrow(_scan_batches(rules), f"blob binary, findings {FINDINGS}")
    return todo.join(found, "blob", "left").select(
        "blob", F.col("todo").alias("rules"), F.coalesce("findings", F.array().cast(FINDINGS)).alias("findings"))


def update_ledger(versions: DataFrame, path: str | None = None, rules: Sequence[Rule] = RULES) -> str:
    """Append what ``versions`` (any path columns, and content) adds to the ledger folder; returns the folder."""
    spark = versions.sparkSession
    new = path is None
    path = path or scratch_path(spark, "secret-ledger")
    ledger = empty_ledger(spark) if new else spark.read.schema(LEDGER).parquet(path)
    ledger_entries(versions, ledger, rules).write.mode("append").option("compression", "zstd").parquet(path)
    return path


def findings(versions: DataFrame, ledger: DataFrame, rules: Sequence[Rule] = RULES) -> DataFrame:
    """Every row of ``versions`` with ``findings``: those of its blob under the given rule versions, by start.

    Also added: ``blob``. Columns of these two names in ``versions`` are replaced.
    """
    kinds = [r.kind for r in rules]
    keys = F.array(*[F.lit(r.key) for r in rules])
    order = F.array(*[F.lit(k) for k in kinds])
    live = ledger.where((F.size("findings") > 0) & F.arrays_overlap("rules", keys))
    per_blob = (live.select("blob", "rules", F.explode("findings").alias("f"))
                .select("blob", "f", F.filter("rules", lambda k: F.startswith(k, F.concat(F.col("f.kind"), F.lit("@")))).alias("_by"))
                .where(F.arrays_overlap("_by", keys))
                .groupBy("blob").agg(F.sort_array(F.collect_set(F.struct(
                    F.col("f.start").alias("start"), F.array_position(order, F.col("f.kind")).alias("o"),
                    F.col("f.stop").alias("stop"), F.col("f.kind").alias("kind")))).alias("_f"))
                .select("blob", F.transform("_f", lambda f: F.struct(f["kind"], f["start"], f["stop"])).cast(FINDINGS).alias("findings")))
    named = versions.drop("findings").withColumn("blob", _blob(F.coalesce("content", F.lit(""))))
    spread = F.monotonically_increasing_id()
    out = salted_left_join(named, per_blob, ["blob"], spread)
    return out.withColumn("findings", F.coalesce("findings", F.array().cast(FINDINGS)))


def spans_text(found: Column) -> Column:
    """kind:start:stop of each finding, comma-joined."""
    return F.array_join(F.transform(found, lambda f: F.concat_ws(":", f["kind"], f["start"].cast("string"), f["stop"].cast("string"))), ",")


def redact(text: Column, found: Column, mark: str = "[SECRET]") -> Column:
    """``text`` with every finding (sorted by start; overlaps count once) replaced by ``mark``."""
    start = F.struct(F.lit(0).alias("at"), F.lit("").alias("out"))
    cut = F.aggregate(found, start, lambda a, f: F.when(f["start"] >= a["at"], F.struct(
        f["stop"].alias("at"), F.concat(a["out"], F.substring(text, a["at"] + 1, f["start"] - a["at"]), F.lit(mark)).alias("out")))
        .otherwise(F.struct(F.greatest(a["at"], f["stop"]).alias("at"), a["out"].alias("out"))))
    return F.when(F.size(found) == 0, text).otherwise(F.concat(cut["out"], F.substring(text, cut["at"] + 1, F.length(text))))
