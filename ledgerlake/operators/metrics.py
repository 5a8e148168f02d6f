"""Dashboard aggregates (A1-A9) and derived rankings / lists.

All aggregates are conditional sums in one ``agg`` so each table is scanned
once; Spark plans them as partial (map-side) + final hash aggregation, so a
hot group (one status or one staff holding a third of the rows) is combined
inside every task before the shuffle and never lands whole on one reducer.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ledgerlake import schemas as S
from ledgerlake.functions import normalise as N
from ledgerlake.plans.joins import rank_by


def tagged_union(projects: DataFrame, invoices: DataFrame) -> DataFrame:
    """Projects and invoices as one frame with an ``_is_project`` flag, for single-pass KPIs."""
    p = projects.select(F.lit(True).alias("_is_project"), "status", "contract_amount", "estimate_amount",
                        F.lit(None).cast("string").alias("payment_status"), F.lit(None).cast("bigint").alias("amount"))
    i = invoices.select(F.lit(False).alias("_is_project"), F.lit(None).cast("string").alias("status"),
                        F.lit(None).cast("bigint").alias("contract_amount"),
                        F.lit(None).cast("bigint").alias("estimate_amount"), "payment_status", "amount")
    return p.unionByName(i)


def kpi_aggregates() -> list:
    """A1's aggregate expressions over ``tagged_union``."""
    isp = F.col("_is_project")
    return [
        N.count_if(isp & N.is_contracted()).alias("contracted_count"),
        N.sum_if(isp & N.is_contracted(), "contract_amount").alias("contracted_total"),
        N.count_if(isp & N.is_pipeline()).alias("pipeline_count"),
        N.sum_if(isp & N.is_pipeline(), "estimate_amount").alias("pipeline_total"),
        N.count_if(isp & N.is_lost()).alias("lost_count"),
        N.count_if(isp).alias("total_projects"),
        N.sum_if(~isp & N.is_paid(), "amount").alias("paid_amount"),
        N.sum_if(~isp & N.is_unpaid(), "amount").alias("unpaid_amount"),
    ]


def kpi_summary(projects: DataFrame, invoices: DataFrame) -> DataFrame:
    """A1: one row of headline KPIs over projects and invoices.

    The two tables are tagged and unioned so a single aggregation (one
    partial aggregate per input partition, one tiny final merge) yields the
    row; the reference's five scans become one pass and no join is needed.
    """
    return tagged_union(projects, invoices).agg(*kpi_aggregates())


def kpi_parts(table: str):
    """A1 of one table (projects or invoices) per bucket, as a derivation for a ``TableStore``: rows (id, its KPIs)."""
    names = {"projects": KPI_COLUMNS[:6], "invoices": KPI_COLUMNS[6:]}[table]

    def derive(rows: DataFrame) -> DataFrame:
        aggregates = dict(zip(KPI_COLUMNS, kpi_aggregates(), strict=True))
        return rows.withColumn("_is_project", F.lit(table == "projects")).groupBy(F.col("_bucket").alias("id")).agg(*[aggregates[n] for n in names])

    return derive


def kpi_from_parts(projects: DataFrame, invoices: DataFrame) -> DataFrame:
    """A1 from the per-bucket parts of both tables: a few numbers a bucket are summed, no row of the tables is read."""
    parts = projects.unionByName(invoices, allowMissingColumns=True)
    return parts.agg(*[F.coalesce(F.sum(c), F.lit(0)).cast("bigint").alias(c) for c in KPI_COLUMNS])


KPI_COLUMNS = ("contracted_count", "contracted_total", "pipeline_count", "pipeline_total",
               "lost_count", "total_projects", "paid_amount", "unpaid_amount")


def _count_total(df: DataFrame, key: str) -> DataFrame:
    return df.groupBy(key).agg(
        F.count(F.lit(1)).alias("count"),
        F.coalesce(F.sum(N.effective_amount()), F.lit(0)).cast("bigint").alias("total"),
    )


def by_status(projects: DataFrame) -> DataFrame:
    """A2: count and effective-amount total per status (null is its own group), count desc."""
    return _count_total(projects, "status").orderBy(F.desc("count"))


def by_type(projects: DataFrame) -> DataFrame:
    """A3: count and effective-amount total per work type, total desc."""
    return _count_total(projects, "work_type").orderBy(F.desc("total"))


def monthly_contracted(projects: DataFrame) -> DataFrame:
    """A4: contracted projects with a contract date per month label; total is null when all amounts are."""
    return (projects.where(N.is_contracted() & F.col("contract_date").isNotNull())
            .groupBy(N.month_label("contract_date").alias("month"))
            .agg(F.count(F.lit(1)).alias("count"), F.sum("contract_amount").cast("bigint").alias("total"))
            .orderBy("month"))


def workload_counts(projects: DataFrame) -> DataFrame:
    """A5: per staff value, projects by status class (完了 counts only in total)."""
    st = F.col("status")
    return projects.where(F.col("staff").isNotNull()).groupBy("staff").agg(
        F.count(F.lit(1)).alias("total"),
        N.count_if(st == S.STATUS_CONTRACTED).alias("in_progress"),
        N.count_if(st.isin(S.STATUS_QUOTED, S.STATUS_NEGOTIATING)).alias("negotiating"),
        N.count_if(st.isin(S.STATUS_SURVEYED, S.STATUS_FIRST_VISIT)).alias("early"),
        N.count_if(st == S.STATUS_LOST).alias("lost"),
    )


def staff_performance(projects: DataFrame, won_statuses: tuple[str, ...] = (S.STATUS_CONTRACTED,)) -> DataFrame:
    """Per staff value: projects, won deals and won revenue, revenue desc.

    ``won_statuses`` defaults to the served rule (契約済 only); pass
    (契約済, 完了) for the documented variant.
    """
    won = F.col("status").isin(*won_statuses)
    return (projects.where(F.col("staff").isNotNull()).groupBy("staff").agg(
        F.count(F.lit(1)).alias("total"),
        N.count_if(won).alias("contracted"),
        N.sum_if(won, "contract_amount").alias("revenue"),
    ).orderBy(F.desc("revenue")))


def staff_ranking(performance: DataFrame) -> DataFrame:
    """Rank, win rate and revenue share over the staff performance rows.

    Staff is free text, so the number of its values has no bound: ranks come
    from ``rank_by`` (range-partitioned sort, per-partition offsets) and the
    revenue total is a scalar subquery. Ties on revenue rank by staff; a null
    revenue ranks last.
    """
    total = performance.agg(F.sum("revenue").alias("_total")).scalar()
    order = F.struct(F.col("revenue").isNull(), -F.col("revenue"), F.col("staff"))
    return rank_by(performance.withColumn("_order", order), "_order", "rank", narrow=True).select(
        "rank",
        "staff", "total", "contracted", "revenue",
        F.try_divide(F.col("contracted").cast("double"), F.nullif(F.col("total"), F.lit(0)).cast("double"))
        .alias("win_rate"),
        F.try_divide(F.col("revenue").cast("double"),
                     F.nullif(total, F.lit(0)).cast("double")).alias("revenue_share"),
    )


def invoice_kpis(invoices: DataFrame) -> DataFrame:
    """Paid total, unpaid total and invoice count over all invoices."""
    return invoices.agg(
        N.sum_if(N.is_paid(), "amount").alias("paid_total"),
        N.sum_if(N.is_unpaid(), "amount").alias("unpaid_total"),
        F.count(F.lit(1)).alias("invoice_count"),
    )


def distinct_values(projects: DataFrame, customers: DataFrame, invoices: DataFrame) -> DataFrame:
    """Pick-list values with their row counts: (field, value, n).

    Each table is turned to long form with ``stack`` (no extra scan per field)
    and the union is grouped once.
    """
    p = projects.select(F.stack(F.lit(2), F.lit("work_type"), "work_type", F.lit("status"), "status")
                        .alias("field", "value"))
    c = customers.select(F.lit("source").alias("field"), F.col("source").alias("value"))
    i = invoices.select(F.lit("payment_status").alias("field"), F.col("payment_status").alias("value"))
    return (p.unionByName(c).unionByName(i).where(F.col("value").isNotNull())
            .groupBy("field", "value").agg(F.count(F.lit(1)).alias("n")))


def project_list(projects: DataFrame, status: str | None = None, work_type: str | None = None) -> DataFrame:
    """Projects, optionally filtered by status and work type, id descending.

    ``None`` or ``''`` means no filter; an unknown value gives an empty result.
    Filters are plain equality so they push into the parquet scan.
    """
    df = projects
    if status:
        df = df.where(F.col("status") == F.lit(status))
    if work_type:
        df = df.where(F.col("work_type") == F.lit(work_type))
    return df.withColumn("probability", N.trim_probability("probability")).orderBy(F.desc("id"))


def recent_projects(projects: DataFrame, n: int = 10) -> DataFrame:
    """The first ``n`` rows of the project list (top-k by id, no full sort)."""
    return project_list(projects).limit(n)


def invoice_list(invoices: DataFrame, tie_break: str = "id") -> DataFrame:
    """Invoices by billing date *as text*, descending, nulls last; ties on ``tie_break``."""
    return invoices.orderBy(F.desc_nulls_last("billing_date"), F.asc(tie_break))


def unassigned_projects(projects: DataFrame) -> DataFrame:
    """Projects without staff."""
    return projects.where(F.col("staff").isNull())


def id_list(df: DataFrame) -> DataFrame:
    """A whole table in id order."""
    return df.orderBy("id")
