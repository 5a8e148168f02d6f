"""Data-quality checks (Q1-Q5), the audits re-expressed as queries."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ledgerlake import schemas as S
from ledgerlake.functions import normalise as N
from ledgerlake.operators import metrics as M


def reconcile_kpis(projects: DataFrame, invoices: DataFrame, served: DataFrame | None = None) -> DataFrame:
    """Q1: recompute KPI figures from the row lists and compare with a served summary.

    ``served`` is the one-row KPI frame that was published (default: A1 computed
    now); ``expected`` comes from the lists alone, so a wrong summary shows.

    Rows ``(metric, expected, actual, ok)``:
    - contracted_total, paid_amount, total_projects: list sums (missing amount
      counts 0) vs the summary;
    - unpaid_amount: the audit's rule (anything not paid, null included) vs the
      summary (null excluded), so it fails exactly when the null bucket holds money;
    - unpaid_null_status_amount: that null bucket vs the gap it explains;
    - by_status_contracted_total: the KPI (contract amounts only) vs the by-status
      total of 契約済, which falls back to the estimate where the contract is missing;
    - status_classes_sum: total projects vs contracted + pipeline + lost + 完了 + null.
    The lists are one aggregation over the tagged union of both tables (one
    pass, partial aggregation per task), joined to the served row (one row
    each), then ``stack`` to long form.
    """
    isp = F.col("_is_project")
    st = F.col("status")
    amt = F.coalesce(F.col("amount"), F.lit(0))
    row = M.tagged_union(projects, invoices).agg(
        N.count_if(isp).alias("list_projects"),
        N.sum_if(isp & N.is_contracted(), F.coalesce(F.col("contract_amount"), F.lit(0))).alias("list_contracted"),
        N.sum_if(isp & N.is_contracted(), N.effective_amount()).alias("by_status_contracted"),
        N.count_if(isp & (st == S.STATUS_DONE)).alias("done_count"),
        N.count_if(isp & st.isNull()).alias("null_status_count"),
        N.sum_if(~isp & N.is_paid(), amt).alias("list_paid"),
        N.sum_if(~isp & F.coalesce(N.is_unpaid(), F.lit(True)), amt).alias("list_unpaid"),
        N.sum_if(~isp & F.col("payment_status").isNull(), amt).alias("null_bucket"),
    )
    served = M.kpi_summary(projects, invoices) if served is None else served
    row = row.withColumn("_one", F.lit(1)).join(served.select(*M.KPI_COLUMNS).limit(1).withColumn("_one", F.lit(1)), "_one")
    c = F.col
    triples = [
        ("contracted_total", c("list_contracted"), c("contracted_total")),
        ("paid_amount", c("list_paid"), c("paid_amount")),
        ("unpaid_amount", c("list_unpaid"), c("unpaid_amount")),
        ("unpaid_null_status_amount", c("null_bucket"), c("list_unpaid") - c("unpaid_amount")),
        ("total_projects", c("list_projects"), c("total_projects")),
        ("by_status_contracted_total", c("contracted_total"), c("by_status_contracted")),
        ("status_classes_sum", c("total_projects"),
         c("contracted_count") + c("pipeline_count") + c("lost_count") + c("done_count") + c("null_status_count")),
    ]
    args = [x for name, e, a in triples for x in (F.lit(name), e.cast("bigint"), a.cast("bigint"))]
    return (row.select(F.stack(F.lit(len(triples)), *args).alias("metric", "expected", "actual"))
            .withColumn("ok", F.col("expected").eqNullSafe(F.col("actual"))))


def domain_violations(projects: DataFrame, invoices: DataFrame, customers: DataFrame) -> DataFrame:
    """Q2: values outside the allowed sets, with counts: (field, value, n). Null counts as outside."""
    def bad(df: DataFrame, field: str, allowed: tuple[str, ...]) -> DataFrame:
        inside = F.coalesce(F.col(field).isin(*allowed), F.lit(False))
        return df.where(~inside).select(F.lit(field).alias("field"), F.col(field).alias("value"))
    return (bad(projects, "status", S.PROJECT_STATUSES)
            .unionByName(bad(invoices, "payment_status", S.PAYMENT_STATUSES))
            .unionByName(bad(customers, "building_type", S.BUILDING_TYPES))
            .groupBy("field", "value").agg(F.count(F.lit(1)).alias("n")))


DATE_CLASSES = (
    ("slash_padded", r"^[0-9]{4}/[0-9]{2}/[0-9]{2}$"),
    ("slash_unpadded", r"^[0-9]{4}/[0-9]{1,2}/[0-9]{1,2}$"),
    ("iso", r"^[0-9]{4}-[0-9]{2}-[0-9]{2}$"),
)


def date_format_class(c: Column) -> Column:
    """null / slash_padded / slash_unpadded / iso / other."""
    expr = F.when(c.isNull(), F.lit("null"))
    for name, pattern in DATE_CLASSES:
        expr = expr.when(c.rlike(pattern), F.lit(name))
    return expr.otherwise(F.lit("other"))


def date_formats(tables: dict[str, DataFrame]) -> DataFrame:
    """Q3: rows per date-format class and column: (column, format_class, n).

    Each table's date columns go to long form with ``stack`` (one scan per
    table), then one grouped count.
    """
    parts = []
    for table, df in tables.items():
        cols = [c for c in S.DATE_COLUMNS.get(table, ()) if c in df.columns]
        if not cols:
            continue
        args = [x for c in cols for x in (F.lit(f"{table}.{c}"), F.col(c))]
        parts.append(df.select(F.stack(F.lit(len(cols)), *args).alias("column", "value")))
    u = parts[0]
    for p in parts[1:]:
        u = u.unionByName(p)
    return (u.groupBy(F.col("column"), date_format_class(F.col("value")).alias("format_class"))
            .agg(F.count(F.lit(1)).alias("n")))


def orphan_staff(projects: DataFrame, customers: DataFrame, employees: DataFrame,
                 surname_mode: str = "ascii") -> DataFrame:
    """Q4: staff values (per source table, with counts) that match no employee surname.

    Staff values are counted first, so the anti join sees one row per
    (source, staff) against the distinct surnames.
    """
    staff = (projects.select(F.lit("projects").alias("source"), "staff")
             .unionByName(customers.select(F.lit("customers").alias("source"), "staff"))
             .where(F.col("staff").isNotNull())
             .groupBy("source", "staff").agg(F.count(F.lit(1)).alias("n")))
    names = employees.select(N.surname("name", surname_mode).alias("staff")).distinct()
    return staff.join(names, "staff", "left_anti")


def check_output_contract(df: DataFrame, required: tuple[str, ...]) -> list[str]:
    """Q5: required columns missing from a result's schema (empty list = contract holds)."""
    have = set(df.columns)
    return [c for c in required if c not in have]


def contract_report(results: dict[str, tuple[DataFrame, tuple[str, ...]]]) -> DataFrame:
    """Q5 with what is behind the columns: per result and required column whether it is there, its rows and its nulls.

    ``results`` maps a name to (frame, required columns). One aggregate a
    result; a missing column has null counts.
    """
    parts = []
    for name, (df, required) in results.items():
        have = [c for c in required if c in df.columns]
        counts = df.agg(F.count(F.lit(1)).alias("_n"), *[F.count_if(F.col(c).isNull()).alias(f"_null_{c}") for c in have])
        rows = F.array(*[F.struct(
            F.lit(c).alias("column"), F.lit(c in have).alias("present"),
            (F.col("_n") if c in have else F.lit(None)).cast("bigint").alias("n_rows"),
            (F.col(f"_null_{c}") if c in have else F.lit(None)).cast("bigint").alias("n_null")) for c in required])
        parts.append(counts.select(F.lit(name).alias("result"), F.explode(rows).alias("r")).select("result", "r.*"))
    return reduce(DataFrame.unionByName, parts)


KPI_CONTRACT = M.KPI_COLUMNS
PERFORMANCE_CONTRACT = ("staff", "total", "contracted", "revenue")
