"""Written intermediate tables and skew-safe joins shared by the operators."""

from __future__ import annotations

import threading
from collections.abc import Iterable, Iterator
from contextlib import contextmanager

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ledgerlake.session import scratch_path

# Shuffle files of a finished write are of no further use: the written table
# is what later stages read, also after an executor is lost.
_CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


_writers: dict[int, tuple[int, str | None]] = {}  # session: writes under way, the setting before the first
_lock = threading.Lock()


@contextmanager
def _cleaning(spark: SparkSession) -> Iterator[None]:
    """The setting holds while any write is under way, in whatever thread, and is put back after the last."""
    with _lock:
        n, before = _writers.get(id(spark), (0, spark.conf.get(_CLEANUP, None)))
        _writers[id(spark)] = n + 1, before
        spark.conf.set(_CLEANUP, "true")
    try:
        yield
    finally:
        with _lock:
            n, before = _writers.pop(id(spark))
            if n > 1:
                _writers[id(spark)] = n - 1, before
            elif before is None:
                spark.conf.unset(_CLEANUP)
            else:
                spark.conf.set(_CLEANUP, before)


def written(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` as Parquet under the shared checkpoint folder and read it back (cuts the lineage)."""
    return written_at(df, name)[0]


def written_at(df: DataFrame, name: str) -> tuple[DataFrame, str]:
    """``written``, with the folder, for tables that are dropped once nothing reads them any more."""
    spark = df.sparkSession
    path = scratch_path(spark, name)
    with _cleaning(spark):
        df.write.option("compression", "zstd").parquet(path)
    return spark.read.schema(df.schema).parquet(path), path


def drop_written(spark: SparkSession, path: str) -> None:
    """Remove a written table that no frame in use reads."""
    folder = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    folder.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(folder, True)


def salted_left_join(big: DataFrame, unique: DataFrame, keys: list[str], spread: Column, salts: int = 16,
                     grows: bool = False) -> DataFrame:
    """Left join of ``big`` with ``unique`` (one row a key) where one key may hold a large part of ``big``.

    ``big``'s rows are dealt over ``salts`` sub-keys by ``spread``; each row of
    the unique side is repeated once per sub-key, so a hot key is shared by
    ``salts`` tasks and no row is multiplied. Both sides reach the join by a
    shuffle of their own, so AQE's skew join splits what is still too large.
    ``grows``: the unique side grows
    with the data and is never broadcast, whatever its size seems to be before
    it is repeated.
    """
    left = big.withColumn("_salt", F.pmod(F.xxhash64(spread), F.lit(salts)).cast("int"))
    right = unique.withColumn("_salt", F.explode(F.sequence(F.lit(0), F.lit(salts - 1))))
    return left.join(right.hint("merge") if grows else right, [*keys, "_salt"], "left").drop("_salt")


def columns(df: DataFrame, names: Iterable[str]) -> DataFrame:
    """Only ``names`` of ``df``; further columns never reach an operator's plan."""
    return df.select(*[F.col(f"`{n}`") for n in names])
