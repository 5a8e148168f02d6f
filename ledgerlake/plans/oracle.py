"""DuckDB SQL for every checked query (the correctness oracle).

The business-table views are written once as CTEs over the driver's
pre-registered tables and prepended to each query. DuckDB notes: integer
``sum`` is HUGEINT, so sums are cast to BIGINT; ``strftime('%-m')`` gives an
unpadded month; ``printf`` stands in for ``format_string``.
"""

from __future__ import annotations

from ledgerlake import schemas as S


def _q(s: str) -> str:
    return "'" + s.replace("'", "''") + "'"


def _in(values) -> str:
    return "(" + ", ".join(_q(v) for v in values) + ")"


CONTRACTED, DONE, LOST = _q(S.STATUS_CONTRACTED), _q(S.STATUS_DONE), _q(S.STATUS_LOST)
PAID = _q(S.PAYMENT_PAID)

V_PROJECTS = f"""
projects_v AS (
  SELECT k AS id,
    'Project#' || CAST(k AS VARCHAR) AS name,
    c.c_name AS customer_name,
    CAST(c.c_nationkey AS VARCHAR) AS address,
    o.o_orderpriority AS work_type,
    CASE WHEN k % 17 = 0 THEN NULL
         ELSE 'Supplier#' || lpad(CAST(o.o_custkey % 70 AS VARCHAR), 9, '0') END AS staff,
    status,
    CASE WHEN k % 5 = 0 THEN NULL WHEN k % 5 = 1 THEN '100.0'
         ELSE CAST((k % 5) * 10 AS VARCHAR) END AS probability,
    CAST(floor(o.o_totalprice * 1.05) AS BIGINT) AS estimate_amount,
    CASE WHEN k % 7 = 0 THEN NULL ELSE strftime(o.o_orderdate, '%Y-%m-%d') END AS first_visit,
    CASE WHEN k % 7 = 0 THEN NULL ELSE strftime(o.o_orderdate, '%Y-%m-%d') END AS scheduled_start,
    CASE WHEN status IN ({CONTRACTED}, {DONE}) AND k % 19 <> 0 THEN
         CASE WHEN k % 2 = 0 THEN strftime(o.o_orderdate, '%Y/%-m/%-d')
              ELSE strftime(o.o_orderdate, '%Y-%m-%d') END END AS contract_date,
    CASE WHEN status IN ({CONTRACTED}, {DONE}) AND k % 13 <> 0
         THEN CAST(floor(o.o_totalprice) AS BIGINT) END AS contract_amount,
    CAST(NULL AS VARCHAR) AS note
  FROM (SELECT *, o_orderkey AS k,
          CASE WHEN o_orderkey % 101 = 0 THEN NULL
               WHEN o_orderstatus = 'F' THEN CASE WHEN o_orderkey % 3 = 0 THEN {DONE} ELSE {CONTRACTED} END
               WHEN o_orderstatus = 'O' THEN
                 CASE o_orderkey % 4 WHEN 0 THEN {_q(S.STATUS_FIRST_VISIT)} WHEN 1 THEN {_q(S.STATUS_SURVEYED)}
                                     WHEN 2 THEN {_q(S.STATUS_NEGOTIATING)} ELSE {_q(S.STATUS_QUOTED)} END
               WHEN o_orderstatus = 'P' THEN CASE WHEN o_orderkey % 2 = 0 THEN {LOST}
                                                  ELSE {_q(S.STATUS_NEGOTIATING)} END
          END AS status
        FROM orders) o
  JOIN customer c ON o.o_custkey = c.c_custkey
)"""

V_EMPLOYEES = """
employees_v AS (
  SELECT s.s_suppkey AS id,
    s.s_name || CASE WHEN s.s_suppkey % 2 = 0 THEN ' ' ELSE '　' END || n.n_name AS name,
    n.n_name AS department,
    CAST(NULL AS VARCHAR) AS role, CAST(NULL AS VARCHAR) AS qualification,
    CAST(NULL AS VARCHAR) AS extension, CAST(NULL AS VARCHAR) AS mobile, CAST(NULL AS VARCHAR) AS email
  FROM supplier s JOIN nation n ON s.s_nationkey = n.n_nationkey
)"""

V_CUSTOMERS = """
customers_v AS (
  SELECT c_custkey AS id, c_name AS name, CAST(c_nationkey AS VARCHAR) AS address,
    c_mktsegment AS building_type, CAST(NULL AS INTEGER) AS age_years,
    CAST(NULL AS VARCHAR) AS phone, CAST(NULL AS VARCHAR) AS email, c_mktsegment AS source,
    'Supplier#' || lpad(CAST(c_custkey % 70 AS VARCHAR), 9, '0') AS staff, CAST(NULL AS VARCHAR) AS note
  FROM customer
)"""

V_INVOICES = f"""
invoices_v AS (
  SELECT 'INV-' || CAST(l_orderkey AS VARCHAR) || '-' || CAST(l_linenumber AS VARCHAR) AS invoice_no,
    'Project#' || CAST(l_orderkey AS VARCHAR) AS project_name,
    CAST(NULL AS VARCHAR) AS customer_name, CAST(NULL AS VARCHAR) AS billing_type,
    CASE WHEN l_orderkey % 2 = 0 THEN strftime(l_shipdate, '%Y/%-m/%-d')
         ELSE strftime(l_shipdate, '%Y-%m-%d') END AS billing_date,
    CASE WHEN l_partkey % 23 = 0 THEN NULL ELSE CAST(floor(l_extendedprice) AS BIGINT) END AS amount,
    CAST(NULL AS VARCHAR) AS due_date,
    CASE WHEN l_linenumber % 7 = 0 AND l_orderkey % 3 = 0 THEN NULL
         WHEN l_returnflag = 'A' THEN {PAID}
         WHEN l_returnflag = 'N' THEN {_q(S.PAYMENT_UNPAID)}
         WHEN l_returnflag = 'R' THEN {_q(S.PAYMENT_WAITING)} END AS payment_status,
    CAST(NULL AS VARCHAR) AS payment_date, CAST(NULL AS VARCHAR) AS note
  FROM lineitem
)"""

V_SERVICES = """
services_v AS (
  SELECT p_partkey AS id, p_name AS name, p_brand AS category, CAST(floor(p_retailprice) AS BIGINT) AS standard_price,
    p_type AS unit, CAST(NULL AS VARCHAR) AS duration, CAST(NULL AS VARCHAR) AS note
  FROM part
)"""

V_ESTIMATES = """
estimates_v AS (
  SELECT 'Q-' || CAST(l_orderkey AS VARCHAR) || '-' || CAST(l_linenumber AS VARCHAR) AS quote_no,
    CAST(NULL AS VARCHAR) AS customer_name, 'Project#' || CAST(l_orderkey AS VARCHAR) AS title,
    'Service#' || CAST(l_partkey AS VARCHAR) AS service, l_quantity AS qty,
    CASE WHEN l_quantity <> 0 THEN CAST(floor(l_extendedprice / l_quantity) AS BIGINT) END AS unit_price,
    CAST(floor(l_extendedprice) AS BIGINT) AS subtotal,
    CASE WHEN l_orderkey % 2 = 0 THEN strftime(l_shipdate, '%Y/%-m/%-d') ELSE strftime(l_shipdate, '%Y-%m-%d') END AS created_date,
    CAST(NULL AS VARCHAR) AS expiry_date, CAST(NULL AS VARCHAR) AS note
  FROM lineitem
)"""

VIEWS = {"projects_v": V_PROJECTS, "employees_v": V_EMPLOYEES, "customers_v": V_CUSTOMERS,
         "invoices_v": V_INVOICES, "services_v": V_SERVICES, "estimates_v": V_ESTIMATES}


def with_views(sql: str, *extra_ctes: str) -> str:
    """Prefix ``sql`` with the view CTEs it mentions (plus ``extra_ctes``, in order)."""
    ctes = [body for name, body in VIEWS.items() if name in sql or any(name in e for e in extra_ctes)]
    ctes += list(extra_ctes)
    return "WITH " + ",\n".join(c.strip() for c in ctes) + "\n" + sql


def month_label_sql(d: str) -> str:
    rest = f"substr({d}, instr({d}, '/') + 1)"
    month = f"COALESCE(TRY_CAST(trim(regexp_extract({rest}, '^ *[-+]?[0-9]+', 0)) AS BIGINT), 0)"
    return (f"CASE WHEN {d} LIKE '%/%' THEN printf('%s-%02d', split_part({d}, '/', 1), {month}) "
            f"ELSE substr({d}, 1, 7) END")


def trim_probability_sql(p: str) -> str:
    return f"regexp_replace(CAST({p} AS VARCHAR), '\\.0$', '')"


EFFECTIVE = "COALESCE(contract_amount, estimate_amount)"
PIPELINE = f"status NOT IN ({CONTRACTED}, {LOST}, {DONE})"

STAFF_PERFORMANCE = f"""
SELECT staff, COUNT(*) AS total,
  CAST(COALESCE(SUM(CASE WHEN status = {CONTRACTED} THEN 1 ELSE 0 END), 0) AS BIGINT) AS contracted,
  CAST(COALESCE(SUM(CASE WHEN status = {CONTRACTED} THEN contract_amount ELSE 0 END), 0) AS BIGINT) AS revenue
FROM projects_v WHERE staff IS NOT NULL GROUP BY staff"""

WORKLOAD_COUNTS = f"""
SELECT staff, COUNT(*) AS total,
  CAST(SUM(CASE WHEN status = {CONTRACTED} THEN 1 ELSE 0 END) AS BIGINT) AS in_progress,
  CAST(SUM(CASE WHEN status IN ({_q(S.STATUS_QUOTED)}, {_q(S.STATUS_NEGOTIATING)}) THEN 1 ELSE 0 END) AS BIGINT)
    AS negotiating,
  CAST(SUM(CASE WHEN status IN ({_q(S.STATUS_SURVEYED)}, {_q(S.STATUS_FIRST_VISIT)}) THEN 1 ELSE 0 END) AS BIGINT)
    AS early,
  CAST(SUM(CASE WHEN status = {LOST} THEN 1 ELSE 0 END) AS BIGINT) AS lost
FROM projects_v WHERE staff IS NOT NULL GROUP BY staff"""

PROJECT_LIST_COLS = ("id, name, customer_name, address, work_type, staff, status, "
                     f"{trim_probability_sql('probability')} AS probability, estimate_amount, first_visit, "
                     "scheduled_start, contract_date, contract_amount, note")


def base_sql() -> dict[str, str]:
    """Oracle SQL of the dashboard, list and search queries."""
    q: dict[str, str] = {}
    q["staff_performance"] = with_views(STAFF_PERFORMANCE)
    q["staff_ranking"] = with_views(f"""
SELECT CAST(row_number() OVER (ORDER BY revenue DESC, staff ASC) AS BIGINT) AS rank,
  staff, total, contracted, revenue,
  CAST(contracted AS DOUBLE) / CAST(NULLIF(total, 0) AS DOUBLE) AS win_rate,
  CAST(revenue AS DOUBLE) / CAST(NULLIF(SUM(revenue) OVER (), 0) AS DOUBLE) AS revenue_share
FROM perf""", f"perf AS ({STAFF_PERFORMANCE})")
    q["kpi_summary"] = with_views(f"""
SELECT p.*, i.* FROM
 (SELECT
   CAST(SUM(CASE WHEN status = {CONTRACTED} THEN 1 ELSE 0 END) AS BIGINT) AS contracted_count,
   CAST(COALESCE(SUM(CASE WHEN status = {CONTRACTED} THEN contract_amount ELSE 0 END), 0) AS BIGINT)
     AS contracted_total,
   CAST(SUM(CASE WHEN {PIPELINE} THEN 1 ELSE 0 END) AS BIGINT) AS pipeline_count,
   CAST(COALESCE(SUM(CASE WHEN {PIPELINE} THEN estimate_amount ELSE 0 END), 0) AS BIGINT) AS pipeline_total,
   CAST(SUM(CASE WHEN status = {LOST} THEN 1 ELSE 0 END) AS BIGINT) AS lost_count,
   COUNT(*) AS total_projects
  FROM projects_v) p,
 (SELECT
   CAST(COALESCE(SUM(CASE WHEN payment_status = {PAID} THEN amount ELSE 0 END), 0) AS BIGINT) AS paid_amount,
   CAST(COALESCE(SUM(CASE WHEN payment_status <> {PAID} THEN amount ELSE 0 END), 0) AS BIGINT) AS unpaid_amount
  FROM invoices_v) i""")
    q["by_status"] = with_views(f"""
SELECT status, COUNT(*) AS count, CAST(COALESCE(SUM({EFFECTIVE}), 0) AS BIGINT) AS total
FROM projects_v GROUP BY status""")
    q["by_type"] = with_views(f"""
SELECT work_type, COUNT(*) AS count, CAST(COALESCE(SUM({EFFECTIVE}), 0) AS BIGINT) AS total
FROM projects_v GROUP BY work_type""")
    q["monthly_contracted"] = with_views(f"""
SELECT {month_label_sql('contract_date')} AS month, COUNT(*) AS count, CAST(SUM(contract_amount) AS BIGINT) AS total
FROM projects_v WHERE status = {CONTRACTED} AND contract_date IS NOT NULL GROUP BY 1""")
    q["workload_counts"] = with_views(WORKLOAD_COUNTS)
    q["invoice_kpis"] = with_views(f"""
SELECT CAST(COALESCE(SUM(CASE WHEN payment_status = {PAID} THEN amount ELSE 0 END), 0) AS BIGINT) AS paid_total,
  CAST(COALESCE(SUM(CASE WHEN payment_status <> {PAID} THEN amount ELSE 0 END), 0) AS BIGINT) AS unpaid_total,
  COUNT(*) AS invoice_count
FROM invoices_v""")
    q["distinct_values"] = with_views("""
SELECT field, value, COUNT(*) AS n FROM (
  SELECT 'work_type' AS field, work_type AS value FROM projects_v
  UNION ALL SELECT 'status', status FROM projects_v
  UNION ALL SELECT 'source', source FROM customers_v
  UNION ALL SELECT 'payment_status', payment_status FROM invoices_v) t
WHERE value IS NOT NULL GROUP BY field, value""")
    return q


def pad2_sql(x: str) -> str:
    return f"CASE WHEN length({x}) < 2 THEN lpad({x}, 2, '0') ELSE {x} END"


def iso_text_sql(d: str) -> str:
    three = f"len(string_split({d}, '/')) = 3"
    slash = (f"split_part({d}, '/', 1) || '-' || {pad2_sql(f'split_part({d}, {chr(39)}/{chr(39)}, 2)')} || '-' || "
             f"{pad2_sql(f'substr(split_part({d}, {chr(39)}/{chr(39)}, 3), 1, 2)')}")
    return (f"CASE WHEN {d} IS NULL OR {d} = '' THEN '' WHEN {three} THEN {slash} "
            f"ELSE substr(replace({d}, '/', '-'), 1, 10) END")


def parsed_date_sql(d: str) -> str:
    return f"CAST(COALESCE(TRY_STRPTIME({d}, '%Y/%m/%d'), TRY_STRPTIME({d}, '%Y-%m-%d')) AS DATE)"


def serial_sql(v: str) -> str:
    n = f"CAST(floor({v}) AS INTEGER)"
    return (f"CASE WHEN {v} IS NULL OR {v} = 0 THEN NULL "
            f"WHEN {n} >= 61 THEN strftime(DATE '1899-12-30' + {n}, '%Y/%m/%d') "
            f"WHEN {n} = 60 THEN '1900/02/29' "
            f"WHEN {n} >= 1 THEN strftime(DATE '1899-12-31' + {n}, '%Y/%m/%d') END")


SURNAME_ASCII = "split_part(name, ' ', 1)"
SURNAME_ANY = "string_split_regex(name, '[ 　]')[1]"

WORKLOAD = f"""
SELECT e.*, split_part(e.name, ' ', 1) AS surname,
  COALESCE(w.total, 0) AS total_projects, COALESCE(w.in_progress, 0) AS in_progress,
  COALESCE(w.negotiating, 0) AS negotiating, COALESCE(w.early, 0) AS early, COALESCE(w.lost, 0) AS lost,
  COALESCE(w.total, 0) - COALESCE(w.lost, 0) AS active
FROM employees_v e LEFT JOIN wc w ON split_part(e.name, ' ', 1) = w.staff"""

LEVEL = (f"CASE WHEN total_projects <= 0 THEN {_q(S.LEVEL_NONE)} WHEN total_projects = 1 THEN {_q(S.LEVEL_LIGHT)} "
         f"WHEN total_projects <= 3 THEN {_q(S.LEVEL_NORMAL)} ELSE {_q(S.LEVEL_BUSY)} END")


def list_sql() -> dict[str, str]:
    """Oracle SQL of lists, filters, searches, workload and quality checks."""
    from ledgerlake.plans import registry as R
    q: dict[str, str] = {}
    q["project_list"] = with_views(f"SELECT {PROJECT_LIST_COLS} FROM projects_v")
    q["project_list_filtered"] = with_views(
        f"SELECT {PROJECT_LIST_COLS} FROM projects_v WHERE status = {_q(R.FILTER_STATUS)} "
        f"AND work_type = {_q(R.FILTER_TYPE)}")
    q["pipeline_projects"] = with_views(f"SELECT * FROM projects_v WHERE {PIPELINE}")
    q["project_by_id"] = with_views(f"SELECT * FROM projects_v WHERE id = {R.LOOKUP_ID}")
    q["project_search"] = with_views(
        f"SELECT * FROM projects_v WHERE COALESCE(contains(name, {_q(R.PROJECT_SEARCH_TEXT)}), false) "
        f"OR COALESCE(contains(customer_name, {_q(R.PROJECT_SEARCH_TEXT)}), false)")
    q["customer_search"] = with_views(
        f"SELECT * FROM customers_v WHERE COALESCE(contains(name, {_q(R.CUSTOMER_SEARCH_TEXT)}), false) "
        f"OR COALESCE(contains(address, {_q(R.CUSTOMER_SEARCH_TEXT)}), false)")
    q["staff_options"] = with_views(
        f"SELECT CAST(0 AS BIGINT) AS ord, CAST(NULL AS BIGINT) AS id, {_q(S.UNASSIGNED_LABEL)} AS label, "
        f"CAST(NULL AS VARCHAR) AS surname "
        f"UNION ALL SELECT 1, id, name, {SURNAME_ASCII} FROM employees_v "
        f"WHERE contains(name, {_q(R.STAFF_SEARCH_TEXT)})")
    q["invoices_by_payment"] = with_views(
        f"SELECT * FROM invoices_v WHERE payment_status = {_q(R.PAYMENT_FILTER)}")
    q["recent_projects"] = with_views(f"SELECT {PROJECT_LIST_COLS} FROM projects_v ORDER BY id DESC LIMIT 10")
    q["invoice_list"] = with_views("SELECT * FROM invoices_v")
    q["unassigned_projects"] = with_views("SELECT * FROM projects_v WHERE staff IS NULL")
    q["employee_list"] = with_views("SELECT * FROM employees_v")
    q["customer_list"] = with_views("SELECT * FROM customers_v")
    q["iso_dates"] = with_views(f"""
SELECT "column", raw, {iso_text_sql('raw')} AS iso_text, {parsed_date_sql('raw')} AS parsed FROM (
  SELECT 'projects.contract_date' AS "column", contract_date AS raw FROM projects_v
  UNION ALL SELECT 'invoices.billing_date', billing_date FROM invoices_v) t""")
    q["serial_date"] = f"""
SELECT id, serial, {serial_sql('serial')} AS parsed FROM (
  SELECT o_orderkey AS id,
    CASE WHEN o_orderkey % 97 = 0 THEN CAST(o_orderkey % 120 AS DOUBLE)
         ELSE CAST(datediff('day', DATE '1899-12-30', CAST(o_orderdate AS DATE)) AS DOUBLE)
              + CAST(o_orderkey % 4 AS DOUBLE) * 0.25 END AS serial
  FROM orders) t"""
    q["employee_surname"] = with_views(
        f"SELECT id, name, {SURNAME_ASCII} AS surname_ascii, {SURNAME_ANY} AS surname_any FROM employees_v")
    q["employee_workload"] = with_views(WORKLOAD, f"wc AS ({WORKLOAD_COUNTS})")
    q["workload_levels"] = with_views(f"SELECT *, {LEVEL} AS level FROM wl",
                                      f"wc AS ({WORKLOAD_COUNTS})", f"wl AS ({WORKLOAD})")
    pipe = PIPELINE
    q["reconcile_kpis"] = with_views(f"""
SELECT metric, expected, actual, expected IS NOT DISTINCT FROM actual AS ok FROM (
  SELECT 'contracted_total' AS metric, list_contracted AS expected, contracted_total AS actual FROM a
  UNION ALL SELECT 'paid_amount', list_paid, paid_amount FROM a
  UNION ALL SELECT 'unpaid_amount', list_unpaid, unpaid_amount FROM a
  UNION ALL SELECT 'unpaid_null_status_amount', null_bucket, list_unpaid - unpaid_amount FROM a
  UNION ALL SELECT 'total_projects', total_projects, total_projects FROM a
  UNION ALL SELECT 'by_status_contracted_total', contracted_total, by_status_contracted FROM a
  UNION ALL SELECT 'status_classes_sum', total_projects,
     contracted_count + pipeline_count + lost_count + done_count + null_status_count FROM a) t""",
        f"""p AS (SELECT
   CAST(COALESCE(SUM(CASE WHEN status = {CONTRACTED} THEN contract_amount ELSE 0 END), 0) AS BIGINT) AS contracted_total,
   CAST(COALESCE(SUM(CASE WHEN status = {CONTRACTED} THEN COALESCE(contract_amount, 0) ELSE 0 END), 0) AS BIGINT)
     AS list_contracted,
   CAST(COALESCE(SUM(CASE WHEN status = {CONTRACTED} THEN {EFFECTIVE} ELSE 0 END), 0) AS BIGINT)
     AS by_status_contracted,
   CAST(COALESCE(SUM(CASE WHEN status = {CONTRACTED} THEN 1 ELSE 0 END), 0) AS BIGINT) AS contracted_count,
   CAST(COALESCE(SUM(CASE WHEN {pipe} THEN 1 ELSE 0 END), 0) AS BIGINT) AS pipeline_count,
   CAST(COALESCE(SUM(CASE WHEN status = {LOST} THEN 1 ELSE 0 END), 0) AS BIGINT) AS lost_count,
   CAST(COALESCE(SUM(CASE WHEN status = {DONE} THEN 1 ELSE 0 END), 0) AS BIGINT) AS done_count,
   CAST(COALESCE(SUM(CASE WHEN status IS NULL THEN 1 ELSE 0 END), 0) AS BIGINT) AS null_status_count,
   COUNT(*) AS total_projects FROM projects_v)""",
        f"""i AS (SELECT
   CAST(COALESCE(SUM(CASE WHEN payment_status = {PAID} THEN amount ELSE 0 END), 0) AS BIGINT) AS paid_amount,
   CAST(COALESCE(SUM(CASE WHEN payment_status <> {PAID} THEN amount ELSE 0 END), 0) AS BIGINT) AS unpaid_amount,
   CAST(COALESCE(SUM(CASE WHEN payment_status = {PAID} THEN COALESCE(amount, 0) ELSE 0 END), 0) AS BIGINT)
     AS list_paid,
   CAST(COALESCE(SUM(CASE WHEN payment_status = {PAID} THEN 0 ELSE COALESCE(amount, 0) END), 0) AS BIGINT)
     AS list_unpaid,
   CAST(COALESCE(SUM(CASE WHEN payment_status IS NULL THEN COALESCE(amount, 0) ELSE 0 END), 0) AS BIGINT)
     AS null_bucket FROM invoices_v)""",
        "a AS (SELECT * FROM p, i)")
    q["domain_violations"] = with_views(f"""
SELECT field, value, COUNT(*) AS n FROM (
  SELECT 'status' AS field, status AS value FROM projects_v
    WHERE NOT COALESCE(status IN {_in(S.PROJECT_STATUSES)}, false)
  UNION ALL SELECT 'payment_status', payment_status FROM invoices_v
    WHERE NOT COALESCE(payment_status IN {_in(S.PAYMENT_STATUSES)}, false)
  UNION ALL SELECT 'building_type', building_type FROM customers_v
    WHERE NOT COALESCE(building_type IN {_in(S.BUILDING_TYPES)}, false)) t
GROUP BY field, value""")
    from ledgerlake.operators.quality import DATE_CLASSES
    cls = "CASE WHEN value IS NULL THEN 'null' " + " ".join(
        f"WHEN regexp_matches(value, {_q(p)}) THEN {_q(n)}" for n, p in DATE_CLASSES) + " ELSE 'other' END"
    date_cols = [("projects", c) for c in S.DATE_COLUMNS["projects"]] + \
                [("invoices", c) for c in S.DATE_COLUMNS["invoices"]]
    union = " UNION ALL ".join(f"SELECT '{t}.{c}' AS \"column\", {c} AS value FROM {t}_v" for t, c in date_cols)
    q["date_formats"] = with_views(
        f"SELECT \"column\", {cls} AS format_class, COUNT(*) AS n FROM ({union}) t GROUP BY 1, 2")
    q["orphan_staff"] = with_views(f"""
SELECT staff, source, COUNT(*) AS n FROM (
  SELECT 'projects' AS source, staff FROM projects_v UNION ALL SELECT 'customers', staff FROM customers_v) t
WHERE staff IS NOT NULL AND NOT EXISTS (SELECT 1 FROM employees_v e WHERE {SURNAME_ASCII.replace('name', 'e.name')} = t.staff)
GROUP BY source, staff""")
    columns = [("staff_performance", "perf", c) for c in ("staff", "total", "contracted", "revenue", "win_rate")]
    columns += [("projects", "projects_v", c) for c in ("id", "staff", "contract_date")]
    columns += [("invoices", "invoices_v", c) for c in ("invoice_no", "amount", "payment_status")]
    q["output_contract"] = with_views(" UNION ALL ".join(
        f"SELECT '{r}' AS result, '{c}' AS \"column\", true AS present, COUNT(*) AS n_rows, COUNT(*) - COUNT({c}) AS n_null FROM {v}"
        if c != "win_rate" else f"SELECT '{r}', '{c}', false, NULL, NULL" for r, v, c in columns), f"perf AS ({STAFF_PERFORMANCE})")
    return q


def all_sql() -> dict[str, str]:
    from ledgerlake.plans.oracle_changes import change_sql
    from ledgerlake.plans.oracle_tables import table_sql
    q = base_sql()
    q.update(list_sql())
    q.update(change_sql())
    q.update(table_sql())
    return q
