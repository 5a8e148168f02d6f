"""DuckDB oracle SQL for the change sets over employees, customers and invoices, refs included."""

from __future__ import annotations

from ledgerlake import schemas as S
from ledgerlake.plans.oracle import _q, with_views

PAID, UNPAID = _q(S.PAYMENT_PAID), _q(S.PAYMENT_UNPAID)

FIELDS = {t: [f.name for f in S.payload_schema(t).fields] for t in ("employees", "customers", "invoices")}

V_KEYED_INVOICES = f"""
keyed_invoices_v AS (
  SELECT CAST(split_part(invoice_no, '-', 2) AS BIGINT) * 8 + CAST(split_part(invoice_no, '-', 3) AS BIGINT) AS id, invoice_no,
    {", ".join(f"max({c}) AS {c}" for c in FIELDS["invoices"] if c != "invoice_no")}
  FROM invoices_v GROUP BY invoice_no
)"""

VIEW = {"employees": "employees_v", "customers": "customers_v", "invoices": "keyed_invoices_v"}

# What the change set sends, where it is not the stored value (r = id % 12).
SENT = {
    "employees": {
        "name": "CASE WHEN r IN (3, 7) THEN 'New#' || name WHEN r = 8 THEN 'Ref#' || name WHEN r = 4 THEN '??' || name "
                "WHEN id % 24 = 1 THEN '' ELSE name END",
        "email": "''",
    },
    "customers": {
        "name": "CASE WHEN r IN (3, 7) THEN 'New#' || name WHEN r = 8 THEN 'Ref#' || name WHEN r = 4 THEN '??' || name "
                "WHEN id % 24 = 1 THEN '' ELSE name END",
        "note": "''",
        "age_years": "CAST(id % 3 AS INTEGER)",
        "staff": "CASE WHEN r = 1 THEN '' ELSE staff END",
    },
    "invoices": {
        "invoice_no": "CASE WHEN r IN (3, 7) THEN 'New#' || invoice_no WHEN r = 8 THEN 'Ref#' || invoice_no ELSE invoice_no END",
        "project_name": "CASE WHEN r = 4 THEN '??' || project_name WHEN id % 24 = 1 THEN '' ELSE project_name END",
        "note": "''",
        "amount": "CASE WHEN r = 0 THEN 0 ELSE amount END",
        "payment_status": f"CASE WHEN r = 0 THEN {PAID} WHEN r = 1 THEN NULL WHEN r = 3 THEN '' ELSE payment_status END",
    },
}

# Garbled and missing fields, first hit first; what is stored of a sent value.
REFUSED = {
    "employees": ("CASE WHEN name LIKE '%??%' THEN 'garbled:name' END", "CASE WHEN COALESCE(name, '') = '' THEN 'required:name' END"),
    "customers": ("CASE WHEN name LIKE '%??%' THEN 'garbled:name' END", "CASE WHEN COALESCE(name, '') = '' THEN 'required:name' END"),
    "invoices": ("CASE WHEN project_name LIKE '%??%' THEN 'garbled:project_name' END",
                 "CASE WHEN COALESCE(invoice_no, '') = '' THEN 'required:invoice_no' "
                 "WHEN COALESCE(project_name, '') = '' THEN 'required:project_name' END"),
}
STORED = {"name": "name", "invoice_no": "invoice_no", "project_name": "project_name",
          "payment_status": f"COALESCE(NULLIF(payment_status, ''), {UNPAID})",
          "amount": "NULLIF(amount, 0)", "age_years": "NULLIF(age_years, 0)"}


def verdict_ctes(table: str) -> list[str]:
    view, garbled, missing = VIEW[table], *REFUSED[table]
    sent = ", ".join(f"CASE WHEN r IN (0, 1, 3, 4, 5, 7, 8) THEN {SENT[table].get(c, c)} END AS {c}" for c in FIELDS[table])
    p = table  # CTE names of one table
    return [*([V_KEYED_INVOICES] if table == "invoices" else []), f"""
{p}_ch AS (
  SELECT id AS seq,
    CASE WHEN r IN (2, 9) THEN 'delete' WHEN r IN (3, 7) THEN 'create' WHEN r = 6 THEN 'assign_staff' ELSE 'update' END AS op,
    CASE WHEN r IN (3, 7, 8, 9) THEN NULL WHEN r = 5 THEN -id ELSE id END AS id,
    'R' || CAST(CASE WHEN r = 7 THEN id WHEN r = 8 THEN id - 1 WHEN id % 24 = 9 THEN id - 2 END AS VARCHAR) AS ref, {sent}
  FROM (SELECT *, id % 12 AS r FROM {view}) t WHERE r < 10
)""", f"""
{p}_checked AS (
  SELECT *, CASE WHEN op = 'assign_staff' THEN 'bad_op'
    WHEN op <> 'create' AND id IS NULL AND ref IS NULL THEN 'missing_id'
    WHEN op <> 'delete' AND {garbled} IS NOT NULL THEN {garbled}
    WHEN op <> 'delete' AND {missing} IS NOT NULL THEN {missing} END AS rej
  FROM {p}_ch
)""", f"""
{p}_verdicts AS (
  SELECT c.*, CASE WHEN rej IS NOT NULL THEN 'rejected' WHEN why IS NOT NULL THEN 'unmatched' ELSE 'accepted' END AS verdict,
    COALESCE(rej, why) AS reason
  FROM (SELECT c.*, CASE WHEN rej IS NOT NULL OR op = 'create' THEN NULL
      WHEN id IS NOT NULL AND id NOT IN (SELECT id FROM {view}) THEN 'unknown_id'
      WHEN id IS NULL AND ref NOT IN (SELECT ref FROM {p}_checked WHERE op = 'create' AND rej IS NULL AND ref IS NOT NULL)
        THEN 'unknown_ref' END AS why
    FROM {p}_checked c) c
)"""]


def apply_sql(table: str) -> str:
    """The table after its set: no row of it has two updates, and refs are deleted after their last use."""
    fields = FIELDS[table]
    stored = ", ".join(f"{STORED.get(c) or f"NULLIF({c}, '')"} AS {c}" for c in fields)
    kept = ", ".join(f"CASE WHEN u.seq IS NULL THEN b.{c} ELSE u.{c} END AS {c}" for c in fields)
    v = f"{table}_verdicts"
    body = f"""
SELECT b.id, {kept}
FROM (SELECT id, NULL AS ref, {', '.join(fields)} FROM {VIEW[table]}
      UNION ALL SELECT (SELECT COALESCE(max(id), 0) FROM {VIEW[table]}) + row_number() OVER (ORDER BY seq), ref, {stored}
      FROM {v} WHERE verdict = 'accepted' AND op = 'create') b
LEFT JOIN (SELECT COALESCE(CAST(id AS VARCHAR), ref) AS k, seq, {stored} FROM {v} WHERE verdict = 'accepted' AND op = 'update') u
  ON u.k = COALESCE(b.ref, CAST(b.id AS VARCHAR))
WHERE COALESCE(b.ref, CAST(b.id AS VARCHAR)) NOT IN (
  SELECT COALESCE(CAST(id AS VARCHAR), ref) FROM {v} WHERE verdict = 'accepted' AND op = 'delete')"""
    return with_views(body, *verdict_ctes(table))


def table_sql() -> dict[str, str]:
    q = {"apply_employee_changes": apply_sql("employees"), "apply_customer_changes": apply_sql("customers"),
         "apply_invoice_changes": apply_sql("invoices")}
    q["table_change_verdicts"] = with_views(
        " UNION ALL ".join(f"SELECT '{t}' AS source, seq, op, id, ref, verdict, reason FROM {t}_verdicts" for t in FIELDS),
        *[cte for t in FIELDS for cte in verdict_ctes(t)])
    return q
