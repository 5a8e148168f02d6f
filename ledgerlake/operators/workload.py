"""Employee workload (J1) and workload levels (R2)."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ledgerlake import schemas as S
from ledgerlake.functions import normalise as N
from ledgerlake.operators import metrics as M

COUNT_COLUMNS = ("total_projects", "in_progress", "negotiating", "early", "lost")


def employee_workload(employees: DataFrame, projects: DataFrame, surname_mode: str = "ascii") -> DataFrame:
    """Every employee with the project counts of its surname; ``active = total - lost``.

    Projects are pre-aggregated per staff value first (partial + final
    aggregation, so a hot staff value is combined map-side), then the small
    per-staff result is left-joined to employees. Namesakes share the counts.
    Order: active descending, then id.
    """
    counts = M.workload_counts(projects).withColumnRenamed("total", "total_projects")
    emp = employees.withColumn("surname", N.surname("name", surname_mode))
    j = emp.join(counts, emp.surname == counts.staff, "left").drop(counts.staff)
    filled = j.select(*emp.columns, *[N.zero_if_null(c).cast("bigint").alias(c) for c in COUNT_COLUMNS])
    return (filled.withColumn("active", F.col("total_projects") - F.col("lost"))
            .orderBy(F.desc("active"), F.asc("id")))


def workload_level(total: str = "total_projects"):
    """R2: 0 → none, 1 → light, 2-3 → normal, 4 or more → busy."""
    t = F.col(total)
    return (F.when(t <= 0, F.lit(S.LEVEL_NONE)).when(t == 1, F.lit(S.LEVEL_LIGHT))
            .when(t <= 3, F.lit(S.LEVEL_NORMAL)).otherwise(F.lit(S.LEVEL_BUSY)))


def workload_levels(workload: DataFrame, base: str = "total_projects") -> DataFrame:
    return workload.withColumn("level", workload_level(base))
