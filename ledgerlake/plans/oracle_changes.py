"""DuckDB oracle SQL for the change-set queries (validation, folds, creates, cascades)."""

from __future__ import annotations

from ledgerlake import schemas as S
from ledgerlake.plans.oracle import _q, with_views
from ledgerlake.sources.bindings import UNKNOWN_ID_OFFSET

FIELDS = [f.name for f in S.payload_schema("projects").fields]
NUMERIC = {f.name for f in S.payload_schema("projects").fields if f.dataType.simpleString() != "string"}
UPD = "r IN (1, 4, 5)"

# The project change set (same rules as ``bindings.project_changes``), payload flattened.
V_CHANGES = f"""
changes_v AS (
  SELECT k AS seq,
    CASE r WHEN 0 THEN 'assign_staff' WHEN 1 THEN 'update' WHEN 2 THEN 'delete' WHEN 3 THEN 'create'
           ELSE 'update' END AS op,
    CASE WHEN r = 3 THEN NULL WHEN r = 5 THEN k + {UNKNOWN_ID_OFFSET} ELSE k END AS id,
    CASE WHEN r IN (1, 5) THEN name WHEN r = 4 THEN '??' || name WHEN r = 3 THEN 'New#' || CAST(k AS VARCHAR) END
      AS name,
    CASE WHEN {UPD} THEN CASE WHEN k % 20 = 11 THEN '' ELSE customer_name END
         WHEN r = 3 THEN customer_name END AS customer_name,
    CASE WHEN {UPD} OR r = 3 THEN address END AS address,
    CASE WHEN {UPD} OR r = 3 THEN work_type END AS work_type,
    CASE WHEN r = 0 THEN CASE WHEN k % 3 = 0 THEN ''
                              ELSE 'Supplier#' || lpad(CAST((k // 10) % 70 AS VARCHAR), 9, '0') END
         WHEN {UPD} THEN staff
         WHEN r = 3 THEN CASE WHEN k % 4 = 3 THEN '' ELSE staff END END AS staff,
    CASE WHEN {UPD} THEN {_q(S.STATUS_CONTRACTED)}
         WHEN r = 3 THEN CASE WHEN k % 20 = 3 THEN '' ELSE {_q(S.STATUS_NEGOTIATING)} END END AS status,
    CASE WHEN {UPD} THEN '100' WHEN r = 3 THEN '0' END AS probability,
    CASE WHEN {UPD} OR r = 3 THEN estimate_amount END AS estimate_amount,
    CASE WHEN {UPD} OR r = 3 THEN first_visit END AS first_visit,
    CASE WHEN {UPD} THEN scheduled_start END AS scheduled_start,
    CASE WHEN {UPD} THEN COALESCE(first_visit, '') END AS contract_date,
    CASE WHEN {UPD} THEN COALESCE(contract_amount, estimate_amount) WHEN r = 3 THEN CAST(0 AS BIGINT) END
      AS contract_amount,
    CASE WHEN {UPD} OR r = 3 THEN '' END AS note
  FROM (SELECT *, id AS k, id % 10 AS r FROM projects_v) p
  WHERE r <= 5
)"""


def normalised_sql(op: str, alias: str = "") -> str:
    """F6/F7 of one change row as a select list."""
    a = f"{alias}." if alias else ""
    out = []
    for f in FIELDS:
        c = a + f
        if f in S.REQUIRED_FIELDS["projects"] or (f == "status" and op == "update"):
            v = c
        elif f == "status" and op == "create":
            v = f"COALESCE(NULLIF({c}, ''), {_q(S.CREATE_DEFAULTS['projects']['status'])})"
        elif f in NUMERIC:
            v = f"NULLIF({c}, 0)"
        else:
            v = f"NULLIF({c}, '')"
        out.append(f"{v} AS {f}")
    return ", ".join(out)


def garbled_sql() -> str:
    hits = [f"CASE WHEN regexp_matches({f}, {_q(S.GARBLE_PATTERN)}) THEN {_q(f)} END"
            for f in S.GARBLE_FIELDS if f in FIELDS]
    return "COALESCE(" + ", ".join(hits) + ")"


def missing_sql() -> str:
    hits = [f"CASE WHEN COALESCE({f}, '') = '' THEN {_q(f)} END" for f in S.REQUIRED_FIELDS["projects"]]
    return "COALESCE(" + ", ".join(hits) + ")"


CHECKED = f"""
checked AS (
  SELECT *, CASE
    WHEN op IS NULL OR op NOT IN ('create', 'update', 'delete', 'assign_staff') THEN 'bad_op'
    WHEN op IN ('update', 'delete', 'assign_staff') AND id IS NULL THEN 'missing_id'
    WHEN op IN ('create', 'update', 'assign_staff') AND {garbled_sql()} IS NOT NULL
      THEN 'garbled:' || {garbled_sql()}
    WHEN op IN ('create', 'update') AND {missing_sql()} IS NOT NULL THEN 'required:' || {missing_sql()}
  END AS rej
  FROM ch
)"""

VERDICTS = """
verdicts AS (
  SELECT c.*,
    CASE WHEN c.rej IS NOT NULL THEN c.rej
         WHEN c.op <> 'create' AND p.id IS NULL THEN 'unknown_id'
         WHEN c.op <> 'create' AND c.seq > d.fd THEN 'after_delete' END AS reason,
    CASE WHEN c.rej IS NOT NULL THEN 'rejected'
         WHEN c.op <> 'create' AND (p.id IS NULL OR c.seq > d.fd) THEN 'unmatched'
         ELSE 'accepted' END AS verdict
  FROM checked c
  LEFT JOIN (SELECT id FROM projects_v) p ON c.id = p.id
  LEFT JOIN (SELECT id, min(seq) AS fd FROM checked WHERE rej IS NULL AND op = 'delete' GROUP BY id) d
    ON c.id = d.id
)"""


def _ch(op: str | None) -> str:
    where = f" WHERE op = {_q(op)}" if op else ""
    return f"ch AS (SELECT * FROM changes_v{where})"


def apply_sql(op: str | None) -> str:
    """The projects table after the accepted changes (all, or one op)."""
    cols = []
    for f in FIELDS:
        if f == "staff":
            cols.append("CASE WHEN a.seq IS NOT NULL AND (u.seq IS NULL OR a.seq > u.seq) THEN a.staff "
                        "WHEN u.seq IS NOT NULL THEN u.staff ELSE p.staff END AS staff")
        else:
            cols.append(f"CASE WHEN u.seq IS NOT NULL THEN u.{f} ELSE p.{f} END AS {f}")
    body = f"""
SELECT p.id, {', '.join(cols)}
FROM projects_v p
LEFT JOIN (SELECT v.id, v.seq, {normalised_sql('update', 'v')} FROM acc v
           JOIN (SELECT id, max(seq) AS s FROM acc WHERE op = 'update' GROUP BY id) l ON v.seq = l.s) u
  ON p.id = u.id
LEFT JOIN (SELECT v.id, v.seq, NULLIF(v.staff, '') AS staff FROM acc v
           JOIN (SELECT id, max(seq) AS s FROM acc WHERE op = 'assign_staff' GROUP BY id) l ON v.seq = l.s) a
  ON p.id = a.id
WHERE p.id NOT IN (SELECT id FROM acc WHERE op = 'delete')
UNION ALL
SELECT (SELECT COALESCE(max(id), 0) FROM projects_v) + row_number() OVER (ORDER BY seq) AS id,
  {normalised_sql('create')}
FROM acc WHERE op = 'create'"""
    return with_views(body, *apply_ctes(op))


def apply_ctes(op: str | None) -> list[str]:
    return [V_CHANGES, _ch(op), CHECKED, VERDICTS, "acc AS (SELECT * FROM verdicts WHERE verdict = 'accepted')"]


def applied_body(op: str | None) -> str:
    """The body of ``apply_sql`` (after its CTEs), for use as a CTE."""
    full = apply_sql(op)
    return full[full.index("\nSELECT p.id"):]


def change_sql() -> dict[str, str]:
    q: dict[str, str] = {}
    q["normalised_changes"] = with_views(
        f"SELECT seq, op, id, {normalised_sql('create')} FROM changes_v WHERE op = 'create' "
        f"UNION ALL SELECT seq, op, id, {normalised_sql('update')} FROM changes_v WHERE op = 'update'", V_CHANGES)
    q["garbled_rows"] = with_views(
        f"SELECT seq, op, id, {garbled_sql()} AS garbled_field FROM changes_v WHERE {garbled_sql()} IS NOT NULL",
        V_CHANGES)
    q["validate_changes"] = with_views("SELECT seq, op, id, verdict, reason FROM verdicts",
                                       V_CHANGES, _ch(None), CHECKED, VERDICTS)
    q["unmatched_changes"] = with_views("SELECT seq, op, id, reason FROM verdicts WHERE verdict = 'unmatched'",
                                        V_CHANGES, _ch(None), CHECKED, VERDICTS)
    q["duplicate_changes"] = with_views("""
SELECT seq, op, id, verdict, reason FROM verdicts
UNION ALL SELECT seq, op, id, 'rejected', 'duplicate_seq' FROM verdicts WHERE seq % 4 = 0 OR (op = 'create' AND seq % 7 = 0)
UNION ALL SELECT seq, 'delete', seq, 'rejected', 'duplicate_seq' FROM verdicts WHERE op = 'create' AND seq % 3 = 0""",
                                        V_CHANGES, _ch(None), CHECKED, VERDICTS)
    q["apply_duplicate_changes"] = apply_sql(None)
    q["apply_creates"] = with_views(f"""
SELECT (SELECT COALESCE(max(id), 0) FROM projects_v) + row_number() OVER (ORDER BY seq) AS id,
  {normalised_sql('create')}
FROM verdicts WHERE verdict = 'accepted' AND op = 'create'""", V_CHANGES, _ch("create"), CHECKED, VERDICTS)
    q["apply_updates"] = apply_sql("update")
    q["apply_deletes"] = apply_sql("delete")
    q["assign_staff"] = apply_sql("assign_staff")
    q["apply_change_set"] = apply_sql(None)
    from ledgerlake.plans.oracle import CONTRACTED, LOST, PAID, PIPELINE
    q["stream_kpis"] = with_views(f"""
SELECT p.*, i.* FROM
 (SELECT
   CAST(SUM(CASE WHEN status = {CONTRACTED} THEN 1 ELSE 0 END) AS BIGINT) AS contracted_count,
   CAST(COALESCE(SUM(CASE WHEN status = {CONTRACTED} THEN contract_amount ELSE 0 END), 0) AS BIGINT)
     AS contracted_total,
   CAST(SUM(CASE WHEN {PIPELINE} THEN 1 ELSE 0 END) AS BIGINT) AS pipeline_count,
   CAST(COALESCE(SUM(CASE WHEN {PIPELINE} THEN estimate_amount ELSE 0 END), 0) AS BIGINT) AS pipeline_total,
   CAST(SUM(CASE WHEN status = {LOST} THEN 1 ELSE 0 END) AS BIGINT) AS lost_count,
   COUNT(*) AS total_projects
  FROM applied) p,
 (SELECT
   CAST(COALESCE(SUM(CASE WHEN payment_status = {PAID} THEN amount ELSE 0 END), 0) AS BIGINT) AS paid_amount,
   CAST(COALESCE(SUM(CASE WHEN payment_status <> {PAID} THEN amount ELSE 0 END), 0) AS BIGINT) AS unpaid_amount
  FROM invoices_v) i""", *apply_ctes(None), f"applied AS ({applied_body(None)})")
    q["stream_kpis_incremental"] = q["stream_kpis"]
    q["ledger_load_breaks"] = with_views(f"""
SELECT {', '.join(f if f != 'note' else "CASE WHEN id % 100 = 0 THEN 'first \"line\"' || chr(10) || name END AS note" for f in FIELDS)}
FROM projects_v""")
    files = []
    for table in ("projects", "employees", "customers"):
        names = [f.name for f in S.payload_schema(table).fields]
        cells = " || '|' || ".join(f"COALESCE(CAST({c} AS VARCHAR), '')" for c in names)
        bars = "|" * (len(names) - 1)
        head = [f"{table} ledger{bars}", bars, f"exported{bars}", "|".join(names)]
        files.append(f"""
SELECT '{table}/' || b AS file, 4 + COUNT(*) OVER (PARTITION BY b) AS row_count,
  4 + row_number() OVER (PARTITION BY b ORDER BY id) AS rn, {cells} AS cells
FROM (SELECT *, id % (SELECT GREATEST(3, CAST(CEIL(COUNT(*) / 50000) AS BIGINT)) FROM {table}_v) AS b FROM {table}_v) t
QUALIFY rn <= 6
UNION ALL
SELECT '{table}/' || b, 4 + n, p.rn, p.cells
FROM (SELECT id % (SELECT GREATEST(3, CAST(CEIL(COUNT(*) / 50000) AS BIGINT)) FROM {table}_v) AS b, COUNT(*) AS n FROM {table}_v GROUP BY 1) t,
  (VALUES {", ".join(f"({i}, {_q(x)})" for i, x in enumerate(head, 1))}) p(rn, cells)""")
    q["file_profile"] = with_views(" UNION ALL ".join(files))
    cells = {t: " || '|' || ".join(f"COALESCE(CAST({f.name} AS VARCHAR), '-')" for f in S.payload_schema(t).fields) for t in S.TABLES}
    q["ledger_load_all"] = with_views(" UNION ALL ".join(f"SELECT '{t}' AS source, {c} AS cells FROM {t}_v" for t, c in cells.items()))
    q["import_once"] = with_views("SELECT 'employees' AS source, name FROM employees_v UNION ALL SELECT 'services', name FROM services_v")
    q["json_lines"] = with_views(f"SELECT id, {', '.join(FIELDS)} FROM projects_v")
    q["ledger_load"] = with_views(f"SELECT {', '.join(FIELDS)} FROM projects_v")
    q["ledger_rejects"] = with_views("SELECT name, 'estimate_amount' AS reason FROM projects_v WHERE id % 11 = 0")
    q["stream_rejects"] = with_views(
        "SELECT 'projects' AS \"table\", seq, op, id, verdict, reason FROM verdicts WHERE verdict <> 'accepted'",
        V_CHANGES, _ch(None), CHECKED, VERDICTS)
    prof = []
    for src, order, label in (("projects", "id", "name"), ("employees", "id", "name"),
                              ("customers", "id", "name"), ("invoices", "invoice_no", "invoice_no")):
        prof.append(f"""SELECT * FROM (
  SELECT '{src}' AS source, CAST(row_number() OVER (ORDER BY {order}, CAST({label} AS VARCHAR)) AS BIGINT) AS rn,
    CAST({label} AS VARCHAR) AS label, COUNT(*) OVER () AS row_count FROM {src}_v) t WHERE rn <= 6""")
    q["source_profile"] = with_views(" UNION ALL ".join(prof))
    surname_any = "string_split_regex(name, '[ 　]')[1]"
    q["cascade_null"] = with_views(f"""
SELECT 'projects' AS source, id, CASE WHEN staff IN (SELECT s FROM gone) THEN NULL ELSE staff END AS staff
FROM projects_v
UNION ALL
SELECT 'customers', id, CASE WHEN staff IN (SELECT s FROM gone) THEN NULL ELSE staff END FROM customers_v
UNION ALL
SELECT 'employees', id, NULL FROM employees_v WHERE id % 9 <> 0""",
        f"gone AS (SELECT DISTINCT {surname_any} AS s FROM employees_v WHERE id % 9 = 0)")
    return q
