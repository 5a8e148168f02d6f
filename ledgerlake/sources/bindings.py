"""Business tables as views over the driver's star-schema parquet tables.

These are the test bindings of FIXTURES.md §4: ``projects`` from orders ⋈
customer, ``employees`` from supplier ⋈ nation, ``customers`` from customer,
``invoices`` from lineitem, and keyed change sets from orders / supplier.
Every expression is deterministic; the same rules are written as DuckDB SQL
in ``ledgerlake.plans.oracle`` for the correctness check.

The only joins are to dimension tables on their keys (customer, nation);
Catalyst prunes unused columns into the parquet scan and AQE picks the join
strategy from runtime sizes (a broadcast only when the measured side is below
``spark.sql.adaptive.autoBroadcastJoinThreshold``).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ledgerlake import schemas as S


def read_table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


def staff_code(n: Column) -> Column:
    """``Supplier#`` + the number left-padded to nine digits: a supplier-name-shaped staff value."""
    return F.concat(F.lit("Supplier#"), F.lpad(n.cast("string"), 9, "0"))


def _slash_date(ts: Column) -> Column:
    return F.date_format(ts, "yyyy/M/d")


def _iso_date(ts: Column) -> Column:
    return F.date_format(ts, "yyyy-MM-dd")


def _null(type_: str = "string") -> Column:
    return F.lit(None).cast(type_)


def project_status(k: Column, orderstatus: Column) -> Column:
    o_status = F.element_at(
        F.array(*[F.lit(s) for s in (S.STATUS_FIRST_VISIT, S.STATUS_SURVEYED, S.STATUS_NEGOTIATING, S.STATUS_QUOTED)]),
        (k % 4 + 1).cast("int"))
    return (
        F.when(k % 101 == 0, _null())
        .when(orderstatus == "F", F.when(k % 3 == 0, S.STATUS_DONE).otherwise(S.STATUS_CONTRACTED))
        .when(orderstatus == "O", o_status)
        .when(orderstatus == "P", F.when(k % 2 == 0, S.STATUS_LOST).otherwise(S.STATUS_NEGOTIATING))
    )


def projects(spark: SparkSession, sf_dir: str) -> DataFrame:
    o = read_table(spark, sf_dir, "orders").select(
        "o_orderkey", "o_custkey", "o_orderstatus", "o_totalprice", "o_orderdate", "o_orderpriority")
    c = read_table(spark, sf_dir, "customer").select("c_custkey", "c_name", "c_nationkey")
    k = F.col("o_orderkey")
    j = o.join(c, o.o_custkey == c.c_custkey, "inner").withColumn(
        "status", project_status(k, F.col("o_orderstatus")))
    closed = F.col("status").isin(S.STATUS_CONTRACTED, S.STATUS_DONE)
    visit = F.when(k % 7 == 0, _null()).otherwise(_iso_date(F.col("o_orderdate")))
    return j.select(
        k.alias("id"),
        F.concat(F.lit("Project#"), k.cast("string")).alias("name"),
        F.col("c_name").alias("customer_name"),
        F.col("c_nationkey").cast("string").alias("address"),
        F.col("o_orderpriority").alias("work_type"),
        F.when(k % 17 == 0, _null()).otherwise(staff_code(F.col("o_custkey") % 70)).alias("staff"),
        F.col("status"),
        F.when(k % 5 == 0, _null()).when(k % 5 == 1, F.lit("100.0"))
        .otherwise(((k % 5) * 10).cast("string")).alias("probability"),
        F.floor(F.col("o_totalprice") * 1.05).cast("bigint").alias("estimate_amount"),
        visit.alias("first_visit"),
        visit.alias("scheduled_start"),
        F.when(closed & (k % 19 != 0),
               F.when(k % 2 == 0, _slash_date(F.col("o_orderdate"))).otherwise(_iso_date(F.col("o_orderdate"))))
        .alias("contract_date"),
        F.when(closed & (k % 13 != 0), F.floor(F.col("o_totalprice")).cast("bigint")).alias("contract_amount"),
        _null().alias("note"),
    )


def employees(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = read_table(spark, sf_dir, "supplier").select("s_suppkey", "s_name", "s_nationkey")
    n = read_table(spark, sf_dir, "nation").select("n_nationkey", "n_name")
    sep = F.when(F.col("s_suppkey") % 2 == 0, F.lit(" ")).otherwise(F.lit("　"))
    return s.join(n, s.s_nationkey == n.n_nationkey, "inner").select(
        F.col("s_suppkey").alias("id"),
        F.concat(F.col("s_name"), sep, F.col("n_name")).alias("name"),
        F.col("n_name").alias("department"),
        *[_null().alias(c) for c in ("role", "qualification", "extension", "mobile", "email")],
    )


def customers(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = read_table(spark, sf_dir, "customer").select("c_custkey", "c_name", "c_nationkey", "c_mktsegment")
    return c.select(
        F.col("c_custkey").alias("id"),
        F.col("c_name").alias("name"),
        F.col("c_nationkey").cast("string").alias("address"),
        F.col("c_mktsegment").alias("building_type"),
        _null("int").alias("age_years"),
        _null().alias("phone"),
        _null().alias("email"),
        F.col("c_mktsegment").alias("source"),
        staff_code(F.col("c_custkey") % 70).alias("staff"),
        _null().alias("note"),
    )


def invoices(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Invoices without an ``id`` column: (l_orderkey, l_linenumber) is not unique in the data."""
    li = read_table(spark, sf_dir, "lineitem").select(
        "l_orderkey", "l_partkey", "l_linenumber", "l_extendedprice", "l_returnflag", "l_shipdate")
    ok, ln = F.col("l_orderkey"), F.col("l_linenumber")
    pay = (
        F.when((ln % 7 == 0) & (ok % 3 == 0), _null())
        .when(F.col("l_returnflag") == "A", F.lit(S.PAYMENT_PAID))
        .when(F.col("l_returnflag") == "N", F.lit(S.PAYMENT_UNPAID))
        .when(F.col("l_returnflag") == "R", F.lit(S.PAYMENT_WAITING))
    )
    return li.select(
        F.concat(F.lit("INV-"), ok.cast("string"), F.lit("-"), ln.cast("string")).alias("invoice_no"),
        F.concat(F.lit("Project#"), ok.cast("string")).alias("project_name"),
        _null().alias("customer_name"),
        _null().alias("billing_type"),
        F.when(ok % 2 == 0, _slash_date(F.col("l_shipdate"))).otherwise(_iso_date(F.col("l_shipdate")))
        .alias("billing_date"),
        F.when(F.col("l_partkey") % 23 == 0, _null("bigint"))
        .otherwise(F.floor(F.col("l_extendedprice")).cast("bigint")).alias("amount"),
        _null().alias("due_date"),
        pay.alias("payment_status"),
        _null().alias("payment_date"),
        _null().alias("note"),
    )


def services(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = read_table(spark, sf_dir, "part").select("p_partkey", "p_name", "p_brand", "p_type", "p_retailprice")
    return p.select(
        F.col("p_partkey").alias("id"), F.col("p_name").alias("name"), F.col("p_brand").alias("category"),
        F.floor("p_retailprice").cast("bigint").alias("standard_price"), F.col("p_type").alias("unit"),
        _null().alias("duration"), _null().alias("note"))


def estimates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Estimate lines; the id is no key ((l_orderkey, l_linenumber) is not unique), it only orders an export."""
    li = read_table(spark, sf_dir, "lineitem").select(
        "l_orderkey", "l_partkey", "l_linenumber", "l_quantity", "l_extendedprice", "l_shipdate")
    ok, ln = F.col("l_orderkey"), F.col("l_linenumber")
    return li.select(
        (ok * 8 + ln).alias("id"),
        F.concat(F.lit("Q-"), ok.cast("string"), F.lit("-"), ln.cast("string")).alias("quote_no"),
        _null().alias("customer_name"),
        F.concat(F.lit("Project#"), ok.cast("string")).alias("title"),
        F.concat(F.lit("Service#"), F.col("l_partkey").cast("string")).alias("service"),
        F.col("l_quantity").alias("qty"),
        F.floor(F.try_divide("l_extendedprice", "l_quantity")).cast("bigint").alias("unit_price"),
        F.floor("l_extendedprice").cast("bigint").alias("subtotal"),
        F.when(ok % 2 == 0, _slash_date(F.col("l_shipdate"))).otherwise(_iso_date(F.col("l_shipdate"))).alias("created_date"),
        _null().alias("expiry_date"), _null().alias("note"))


# --- change sets ------------------------------------------------------------
UNKNOWN_ID_OFFSET = 10_000_000


def project_changes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Keyed change set over projects, one change per order key ``k`` (seq = k).

    k % 10: 0 assign staff (every third one blank → unassign), 1 full update
    (every other one without customer_name → rejected), 2 delete, 3 create,
    4 update with a garbled name, 5 update of an unknown id; 6-9 no change.
    Updates carry the whole row: status moves to 契約済 with a contract amount
    and an ISO contract date; fields left out become null.

    Each payload field is its own CASE on ``k % 10`` (not a CASE over whole
    structs), so field accesses stay small inside generated code.
    """
    p = projects(spark, sf_dir)
    k = F.col("id")
    r = k % 10
    upd = r.isin(1, 4, 5)
    upd_or_create = r.isin(1, 3, 4, 5)
    c = F.col
    fields = {
        "name": F.when(r.isin(1, 5), c("name")).when(r == 4, F.concat(F.lit("??"), c("name")))
        .when(r == 3, F.concat(F.lit("New#"), k.cast("string"))),
        "customer_name": F.when(upd, F.when(k % 20 == 11, F.lit("")).otherwise(c("customer_name")))
        .when(r == 3, c("customer_name")),
        "address": F.when(upd_or_create, c("address")),
        "work_type": F.when(upd_or_create, c("work_type")),
        "staff": F.when(r == 0, F.when(k % 3 == 0, F.lit("")).otherwise(staff_code(F.floor(k / 10) % 70)))
        .when(upd, c("staff")).when(r == 3, F.when(k % 4 == 3, F.lit("")).otherwise(c("staff"))),
        "status": F.when(upd, F.lit(S.STATUS_CONTRACTED))
        .when(r == 3, F.when(k % 20 == 3, F.lit("")).otherwise(F.lit(S.STATUS_NEGOTIATING))),
        "probability": F.when(upd, F.lit("100")).when(r == 3, F.lit("0")),
        "estimate_amount": F.when(upd_or_create, c("estimate_amount")),
        "first_visit": F.when(upd_or_create, c("first_visit")),
        "scheduled_start": F.when(upd, c("scheduled_start")),
        "contract_date": F.when(upd, F.coalesce(c("first_visit"), F.lit(""))),
        "contract_amount": F.when(upd, F.coalesce(c("contract_amount"), c("estimate_amount")))
        .when(r == 3, F.lit(0).cast("bigint")),
        "note": F.when(upd_or_create, F.lit("")),
    }
    payload = F.struct(*[fields[f.name].cast(f.dataType).alias(f.name)
                         for f in S.payload_schema("projects").fields])
    return p.where(r <= 5).select(
        k.alias("seq"),
        F.when(r == 0, "assign_staff").when(r == 2, "delete").when(r == 3, "create")
        .when(r <= 5, "update").alias("op"),
        F.when(r == 3, _null("bigint")).when(r == 5, k + UNKNOWN_ID_OFFSET).otherwise(k).alias("id"),
        payload.alias("payload"),
    )


def employee_deletes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Employee change set: delete every employee whose key is a multiple of 9 (seq = key)."""
    e = employees(spark, sf_dir)
    return e.where(F.col("id") % 9 == 0).select(
        F.col("id").alias("seq"), F.lit("delete").alias("op"), F.col("id"),
        _null(S.payload_schema("employees").simpleString()).alias("payload"))


def keyed_invoices(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The invoices with an id: one row per invoice number (the largest value of each column)."""
    inv = invoices(spark, sf_dir)
    part = F.split("invoice_no", "-")
    rest = [f.name for f in S.INVOICES.fields if f.name not in ("id", "invoice_no")]
    return inv.groupBy("invoice_no").agg(*[F.max(c).alias(c) for c in rest]).select(
        (part[1].cast("bigint") * 8 + part[2].cast("bigint")).alias("id"), "invoice_no", *rest)


# Per table: the field that gets garbled, the text field sent as ''.
CHANGED_FIELDS = {"employees": ("name", "email"), "customers": ("name", "note"), "invoices": ("project_name", "note")}


def table_changes(base: DataFrame, table: str) -> DataFrame:
    """Change set with refs over employees, customers or invoices, one change per id ``k`` (seq = k).

    k % 12: 0 full update (invoices: paid, amount 0), 1 update (every other one without the last required
    field → rejected; invoices without a payment state, customers with staff ''), 2 delete, 3 create, 4 garbled update,
    5 update of an unknown id, 6 assign staff (not an operation of these tables), 7 create with the ref ``R<k>``,
    8 update by the ref ``R<k - 1>``, 9 delete by the ref ``R<k - 2>`` (every other one without → rejected);
    10 and 11 no change. Bodies are the stored row.
    """
    k = F.col("id")
    r = k % 12
    first, last = S.REQUIRED_FIELDS[table][0], S.REQUIRED_FIELDS[table][-1]
    garbled, blank = CHANGED_FIELDS[table]
    fields = {}
    for f in S.payload_schema(table).fields:
        v = F.col(f.name)
        if f.name == blank:
            v = F.lit("")
        if f.name == first:
            v = F.when(r.isin(3, 7), F.concat(F.lit("New#"), v)).when(r == 8, F.concat(F.lit("Ref#"), v)).otherwise(v)
        if f.name == garbled:
            v = F.when(r == 4, F.concat(F.lit("??"), v)).otherwise(v)
        if f.name == last:
            v = F.when(k % 24 == 1, F.lit("")).otherwise(v)
        if f.name == "payment_status":
            v = F.when(r == 0, F.lit(S.PAYMENT_PAID)).when(r == 1, _null()).when(r == 3, F.lit("")).otherwise(v)
        if f.name == "amount":
            v = F.when(r == 0, F.lit(0)).otherwise(v)
        if f.name == "age_years":
            v = k % 3
        if f.name == "staff":
            v = F.when(r == 1, F.lit("")).otherwise(v)
        fields[f.name] = F.when(r.isin(0, 1, 3, 4, 5, 7, 8), v).cast(f.dataType).alias(f.name)
    return base.where(r < 10).select(
        k.alias("seq"),
        F.when(r.isin(2, 9), "delete").when(r.isin(3, 7), "create").when(r == 6, "assign_staff").otherwise("update").alias("op"),
        F.when(r.isin(3, 7, 8, 9), _null("bigint")).when(r == 5, -k).otherwise(k).alias("id"),
        F.when(r == 7, k).when(r == 8, k - 1).when(k % 24 == 9, k - 2).cast("string").alias("_n"),
        F.struct(*fields.values()).alias("payload"),
    ).withColumn("ref", F.concat(F.lit("R"), F.col("_n"))).drop("_n")
