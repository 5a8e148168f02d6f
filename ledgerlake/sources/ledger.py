"""Ledger exports (S1-S4, S6): CSV sheets with a preamble, mapped by position.

An export file holds four preamble rows (title, blank cells, export note,
header) and then one record per row; columns are positional in the table's
order without ``id``. Loading keeps the rows whose first cell is not falsy
(null, ``''`` or ``0``), casts strictly with ``try_cast`` and sends rows with
an uncastable cell to a rejects frame instead of failing the job.

Preamble rows are found without a single-task read: only rows of each file's
first split (``_metadata.file_block_start = 0``) can be preamble; their
position comes from ``monotonically_increasing_id`` minus the file's first
id in that split. The CSV reader skips blank lines, so the blank ones among a
file's first four lines are counted from the text and taken off.

A line break inside a quoted cell needs the reader's ``multiLine`` mode, in
which a file is one task. Files are routed one by one: those with a line that
leaves a quote open go there, all others stay splittable, and the two results
are united. Rows with another number of cells than the table has columns are
rejects.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ledgerlake import schemas as S
from ledgerlake.functions import normalise as N
from ledgerlake.plans.joins import rank_by

PREAMBLE_ROWS = 4
BLANK_LINE = r"^[ \t\r]*\z"  # in text files


def _positional_schema(table: str) -> T.StructType:
    n = len(S.payload_schema(table).fields)
    return T.StructType([T.StructField(f"_c{i}", T.StringType(), True) for i in range(n)])


def _position(df: DataFrame) -> DataFrame:
    """``df`` of a file source with ``_line``: 0-based in its file's first split, null past it.

    The starts are one row per file, as the driver's own file listing holds
    them, so they are sent to the rows: a join by key would shuffle every row
    by its file's path.
    """
    df = df.select("*", F.col("_metadata.file_path").alias("_file"), F.col("_metadata.file_block_start").alias("_block"),
                   F.monotonically_increasing_id().alias("_mono"))
    first = (df.where(F.col("_block") == 0).groupBy(F.col("_file").alias("_f0"))
             .agg(F.min("_mono").alias("_start")))
    j = df.join(F.broadcast(first), (F.col("_file") == F.col("_f0")) & (F.col("_block") == 0), "left")
    return j.withColumn("_line", F.col("_mono") - F.col("_start")).drop("_f0", "_start")


def read_ledger_lines(spark: SparkSession, path: str, table: str) -> DataFrame:
    """All CSV rows of the export files under ``path`` with ``_file``, ``_line`` and ``_skip``.

    ``_line`` is the 0-based row in the file (null past split 0), ``_skip`` the
    file's preamble rows the reader has not skipped itself, ``_order`` a sortable
    position, ``_ragged`` marks a row with a wrong number of cells.
    """
    text = spark.read.option("recursiveFileLookup", "true").text(path)
    schema = T.StructType([*_positional_schema(table).fields, T.StructField("_ragged", T.StringType())])
    broken, early_blanks = files_with_breaks(text), has_early_blanks(text)

    def read(multi_line: bool) -> DataFrame:
        rows = (spark.read.schema(schema).option("header", "false").option("mode", "PERMISSIVE")
                .option("columnNameOfCorruptRecord", "_ragged").option("multiLine", str(multi_line).lower())
                .option("escape", '"').option("recursiveFileLookup", "true").csv(path))
        # a condition on the file's path prunes the listing: the other files are not opened
        here = F.col("_metadata.file_path").isin(broken)
        return _position(rows.where(here if multi_line else ~here) if broken else rows)

    raw = read(False).unionByName(read(True)) if broken else read(False)
    skip = F.lit(PREAMBLE_ROWS).cast("bigint")
    if early_blanks:
        blank = (_position(text).where((F.col("_line") < PREAMBLE_ROWS) & F.col("value").rlike(BLANK_LINE))
                 .groupBy(F.col("_file").alias("_f1")).agg(F.count(F.lit(1)).alias("_blank")))
        raw = raw.join(F.broadcast(blank), F.col("_file") == F.col("_f1"), "left")
        skip = PREAMBLE_ROWS - F.coalesce("_blank", F.lit(0))
    return (raw.withColumn("_skip", skip)
            .withColumn("_order", F.struct("_file", "_block", "_mono")).drop("_f1", "_blank"))


def files_with_breaks(text: DataFrame) -> list[str]:
    """The files (a ``text`` read) with a cell that goes on after a line break: some line leaves a quote open.

    Names of files only, as the driver's own file listing holds them.
    """
    open_quote = F.regexp_count("value", F.lit('"')) % 2 == 1
    return sorted(r[0] for r in text.where(F.col("value").contains('"') & open_quote).select("_metadata.file_path").distinct().collect())


def has_early_blanks(text: DataFrame) -> bool:
    """Is any line of a file's first split blank? Only then the blank ones in the preamble are counted."""
    return not text.where((F.col("_metadata.file_block_start") == 0) & F.col("value").rlike(BLANK_LINE)).select(F.lit(1)).isEmpty()


def file_profile(spark: SparkSession, path: str, table: str, n: int = 6) -> DataFrame:
    """S4 over raw exports: per file its rows' number and the first ``n`` rows, preamble included, in all cells.

    Columns file, row_count, rn (from 1), cells (one text a row, cells parted by
    ``|``, empty cells empty). A row's place comes from its position in the
    file's first split, so nothing is sorted; a first split with fewer than
    ``n`` rows shows those. Blank lines are no rows.
    """
    lines = read_ledger_lines(spark, path, table)
    counts = lines.groupBy(F.col("_file").alias("file")).agg(F.count(F.lit(1)).alias("row_count"))
    cells = [F.coalesce(F.col(f.name), F.lit("")) for f in _positional_schema(table).fields]
    head = lines.where(F.col("_line") < n).select(
        F.col("_file").alias("file"), (F.col("_line") + 1).alias("rn"), F.concat_ws("|", *cells).alias("cells"))
    return head.join(counts, "file").select("file", "row_count", "rn", "cells")


def load_ledger(spark: SparkSession, path: str, table: str, assign_ids: bool = True,
                id_offset: int = 0) -> tuple[DataFrame, DataFrame]:
    """``(rows, rejects)`` of one table's export files.

    Date columns go through ``parse_ledger_date`` (numeric text is a serial
    day number). With ``assign_ids`` rows get ids ``id_offset + 1 …`` in file
    and line order (``rank_by``: sorted, checkpointed, per-partition offsets).
    """
    fields = list(S.payload_schema(table).fields)
    lines = read_ledger_lines(spark, path, table)
    first = F.col("_c0")
    body = lines.where(F.col("_line").isNull() | (F.col("_line") >= F.col("_skip")))
    # a sheet's number 0 is an empty first cell; other text that reads as 0 (000, 0D) is a value
    body = body.where(first.isNotNull() & (first != "") & ~first.rlike(r"^-?0(\.0+)?\z"))
    dates = set(S.DATE_COLUMNS.get(table, ()))
    # a projection of its own: a number is used several times, and would be parsed as often
    body = body.select("*", *[N.number(f"_c{i}").alias(f"_n{i}") for i, f in enumerate(fields) if f.name in dates])
    typed, bad = [], [F.when(F.col("_ragged").isNotNull(), F.lit("cell_count"))]
    for i, f in enumerate(fields):
        rawc = F.col(f"_c{i}")
        if f.name in dates:
            v = N.parse_ledger_date(rawc, as_number=f"_n{i}")
            bad.append(F.when(N.bad_serial(rawc, f"_n{i}"), F.lit(f.name)))
        elif isinstance(f.dataType, T.StringType):
            v = rawc
        else:
            v = F.trim(rawc).try_cast(f.dataType)
            bad.append(F.when(rawc.isNotNull() & (F.trim(rawc) != "") & v.isNull(), F.lit(f.name)))
        typed.append(v.alias(f.name))
    reason = F.coalesce(*bad)
    checked = body.select("_order", "_file", *typed, reason.alias("_reject"))
    rejects = checked.where(F.col("_reject").isNotNull()).select(
        "_file", *[f.name for f in fields], F.col("_reject").alias("reason"))
    good = checked.where(F.col("_reject").isNull()).drop("_reject")
    if assign_ids:
        ranked = rank_by(good, "_order", "_rank")
        rows = ranked.select((F.col("_rank") + F.lit(id_offset)).cast("bigint").alias("id"),
                             *[f.name for f in fields])
    else:
        rows = good.select(*[f.name for f in fields])
    return rows, rejects


def export_ledger(df: DataFrame, table: str, path: str, files: int, title: str, order_by: str = "id",
                  spread: Column | None = None) -> None:
    """Write ``df`` as ledger CSV files (preamble + positional records), ``files`` files in parallel.

    Rows are spread over ``files`` buckets by ``spread`` (default: a hash of
    ``order_by``), modulo ``files``; each bucket is one task and one file (``partitionBy`` on the bucket) holding its four
    preamble lines and its rows in ``order_by`` order. Lines are made with
    ``to_csv`` so quoting follows the CSV reader.
    """
    fields = [f.name for f in S.payload_schema(table).fields]
    n = len(fields)
    records = df.select(
        F.pmod(F.xxhash64(F.col(order_by)) if spread is None else spread, F.lit(files)).cast("bigint").alias("_bucket"),
        F.lit(1).alias("_kind"), F.col(order_by).cast("bigint").alias("_ord"),
        F.to_csv(F.struct(*[F.col(c).cast("string").alias(c) for c in fields]), {"escape": '"'}).alias("value"))
    spark = df.sparkSession
    pre_lines = [title, "," * (n - 1), "exported," + "," * (n - 2), ",".join(fields)]
    pre = spark.range(files).select(
        F.col("id").alias("_bucket"), F.lit(0).alias("_kind"),
        F.posexplode(F.array(*[F.lit(x) for x in pre_lines])).alias("_ord", "value"))
    pre = pre.select("_bucket", "_kind", F.col("_ord").cast("bigint"), "value")
    (records.unionByName(pre).repartition(files, "_bucket")
     .sortWithinPartitions("_bucket", "_kind", "_ord").select("_bucket", "value")
     .write.mode("errorifexists").partitionBy("_bucket").text(path))


def source_profile(sources: dict[str, tuple[DataFrame, str, str]], n: int = 6) -> DataFrame:
    """Per source: row count and the first ``n`` rows' labels.

    ``sources`` maps a name to ``(frame, order column, label column)``. The
    first rows come from ``orderBy(...).limit(n)`` (a distributed top-k), so
    no source is ever gathered into one task; counts are plain aggregates.
    Columns: source, row_count, rn, label.
    """
    parts = []
    for name, (df, order_col, label_col) in sources.items():
        cnt = df.agg(F.count(F.lit(1)).alias("row_count"))
        top = (df.select(F.col(order_col).alias("_o"), F.col(label_col).cast("string").alias("label"))
               .orderBy("_o", "label").limit(n))
        ranked = top.select(F.lit(name).alias("source"), "label",
                            F.row_number().over(Window.orderBy("_o", "label")).cast("bigint").alias("rn"))
        parts.append(ranked.join(cnt.select(F.lit(name).alias("source"), "row_count"), "source"))
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


def to_json_lines(df: DataFrame) -> DataFrame:
    """Each row as one JSON object (``value``), ready for ``write.text``."""
    return df.select(F.to_json(F.struct("*")).alias("value"))


def import_ledgers(spark: SparkSession, store, paths: dict[str, str]) -> dict[str, int]:
    """Load each table's export into the store once.

    The guard is per table (a table with rows in the store is skipped), so an
    import interrupted after some tables is completed by the next run, and an
    empty table does not block its import. Rows that could not be loaded are
    published beside each table as ``<table>_rejects``. Returns the rows loaded
    per table.
    """
    present = {t for t in paths if t in store.manifest() and not store.read(t).limit(1).isEmpty()}
    tables: dict[str, DataFrame] = {}
    for table, path in paths.items():
        if table not in present:
            tables[table], tables[f"{table}_rejects"] = load_ledger(spark, path, table)
    if tables:
        store.publish(tables)
    return {t: store.read(t).count() for t in tables if not t.endswith("_rejects")}
