"""Connected components by alternating large-star and small-star rounds over written edge tables."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ledgerlake.llm.tables import drop_written, salted_left_join, written_at

SALTS = 8


def _with_least(edges: DataFrame, least: DataFrame) -> DataFrame:
    """Each edge with its node's minimum; a hub's edges are dealt over SALTS tasks."""
    return salted_left_join(edges, least, ["a"], F.col("b"), SALTS, grows=True)


def _large_star(edges: DataFrame) -> DataFrame:
    both = edges.unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
    least = both.groupBy("a").agg(F.min("b").alias("m")).select("a", F.least("a", "m").alias("m"))
    return (_with_least(both, least).where("b > a").select(F.col("b").alias("a"), F.col("m").alias("b"))
            .where("a <> b").distinct())


def _small_star(edges: DataFrame) -> DataFrame:
    down = edges.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).where("a <> b")
    least = down.groupBy("a").agg(F.min("b").alias("m"))
    moved = _with_least(down, least).where("b <> m").select(F.col("b").alias("a"), F.col("m").alias("b"))
    return moved.unionByName(least.select("a", F.col("m").alias("b"))).where("a <> b").distinct()


def components(edges: DataFrame, name: str = "components", max_rounds: int = 60) -> DataFrame:
    """(a, b) links of long ids -> (node, component): the smallest id reachable, for every id in a link.

    Each round is two star steps of grouped minima (combined before the
    shuffle, so a hub costs one row a task) and a salted join back. A round's
    edges are written, so a lost executor costs one round. Self links and
    repeated links are allowed; null ends are dropped. Rounds grow with the
    logarithm of the longest path; ``max_rounds`` is beyond any table's size,
    and going over it is an error, never a partial result.
    """
    edges = edges.select(F.col("a").cast("long"), F.col("b").cast("long")).where("a is not null and b is not null and a <> b")
    spark = edges.sparkSession
    edges, path = written_at(edges.distinct(), name)  # the steps below read the links several times
    mark = None
    for _ in range(max_rounds):
        before = path
        edges, path = written_at(_small_star(_large_star(edges)), name)
        drop_written(spark, before)
        now = edges.agg(F.count(F.lit(1)), F.bit_xor(F.xxhash64("a", "b")), F.sum(F.hash("a", "b").cast("long"))).first()
        if now == mark:
            break
        mark = now
    else:
        raise RuntimeError(f"components did not settle in {max_rounds} rounds")
    return edges.select(F.col("a").alias("node"), F.col("b").alias("component")).unionByName(
        edges.select(F.col("b").alias("node"), F.col("b").alias("component"))).distinct()
