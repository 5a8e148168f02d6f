"""Filters, searches and row validation.

All predicates are built-in column expressions: equality filters push into
the parquet scan, ``contains`` runs inside whole-stage codegen.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ledgerlake import schemas as S
from ledgerlake.functions import normalise as N


def _contains(col: str, text: str, case_sensitive: bool) -> Column:
    c = F.col(col)
    if case_sensitive:
        return F.coalesce(c.contains(F.lit(text)), F.lit(False))
    return F.coalesce(F.lower(c).contains(F.lit(text.lower())), F.lit(False))


def text_search(df: DataFrame, text: str, columns: tuple[str, ...], case_sensitive: bool = True) -> DataFrame:
    """Rows where any of ``columns`` contains ``text`` (literal, not a pattern). Empty text: all rows."""
    if not text:
        return df
    cond = _contains(columns[0], text, case_sensitive)
    for c in columns[1:]:
        cond = cond | _contains(c, text, case_sensitive)
    return df.where(cond)


def project_search(projects: DataFrame, text: str, case_sensitive: bool = True) -> DataFrame:
    """P5: text in project name or customer name."""
    return text_search(projects, text, ("name", "customer_name"), case_sensitive)


def customer_search(customers: DataFrame, text: str, case_sensitive: bool = True) -> DataFrame:
    """Text in customer name or address."""
    return text_search(customers, text, ("name", "address"), case_sensitive)


def staff_options(employees: DataFrame, text: str = "", case_sensitive: bool = True) -> DataFrame:
    """The staff picker: an "unassigned" choice first, then matching employees by id.

    Columns: ``ord`` (0 for unassigned, 1 for employees), ``id``, ``label``,
    ``surname`` (the value stored in ``staff``; null for unassigned).
    """
    matches = text_search(employees, text, ("name",), case_sensitive).select(
        F.lit(1).cast("bigint").alias("ord"), "id", F.col("name").alias("label"),
        N.surname("name", "ascii").alias("surname"))
    unassigned = matches.sparkSession.range(1).select(
        F.lit(0).cast("bigint").alias("ord"), F.lit(None).cast("bigint").alias("id"),
        F.lit(S.UNASSIGNED_LABEL).alias("label"), F.lit(None).cast("string").alias("surname"))
    return unassigned.unionByName(matches).orderBy("ord", "id")


def invoices_by_payment(invoices: DataFrame, payment_status: str | None) -> DataFrame:
    """Invoices with one payment state (no filter when empty)."""
    if not payment_status:
        return invoices
    return invoices.where(F.col("payment_status") == F.lit(payment_status))


def pipeline_projects(projects: DataFrame) -> DataFrame:
    """Open deals (null status excluded, as ``NOT IN`` does)."""
    return projects.where(N.is_pipeline())


def project_by_id(projects: DataFrame, id_: int) -> DataFrame:
    """One row by id (a pushed-down equality)."""
    return projects.where(F.col("id") == F.lit(id_).cast("bigint"))


# P9 -------------------------------------------------------------------------
def garbled_field(fields: list[str], prefix: str = "") -> Column:
    """Name of the first text field (in the fixed check order) holding ``??``, else null.

    ``fields`` are the columns present; ``prefix`` addresses struct members
    (for example ``payload.``).
    """
    present = [f for f in S.GARBLE_FIELDS if f in fields]
    hits = [F.when(F.col(prefix + f).rlike(S.GARBLE_PATTERN), F.lit(f)) for f in present]
    return F.coalesce(*hits, F.lit(None).cast("string")) if hits else F.lit(None).cast("string")


def garbled_rows(df: DataFrame, prefix: str = "") -> DataFrame:
    """Rows with garbled text, with the first offending field as ``garbled_field``."""
    fields = _field_names(df, prefix)
    return df.withColumn("garbled_field", garbled_field(fields, prefix)).where(F.col("garbled_field").isNotNull())


def _field_names(df: DataFrame, prefix: str) -> list[str]:
    if not prefix:
        return df.columns
    struct = df.schema[prefix.rstrip(".")].dataType
    return [f.name for f in struct.fields]


# P10 ------------------------------------------------------------------------
def missing_required(table: str, prefix: str = "") -> Column:
    """Name of the first required field that is null or ``''`` (blanks-only passes), else null."""
    hits = [F.when(F.coalesce(F.col(prefix + f), F.lit("")) == "", F.lit(f)) for f in S.REQUIRED_FIELDS[table]]
    return F.coalesce(*hits, F.lit(None).cast("string"))
