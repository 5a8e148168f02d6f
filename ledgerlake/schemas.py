"""Table schemas and the fixed vocabulary of the business data.

Every table has a BIGINT ``id`` and string columns; money is whole yen held as
BIGINT so sums are exact and independent of partitioning.
"""

from __future__ import annotations

from pyspark.sql import types as T

_S = T.StringType()
_L = T.LongType()


def _struct(*fields: tuple[str, T.DataType]) -> T.StructType:
    return T.StructType([T.StructField(n, t, True) for n, t in fields])


EMPLOYEES = _struct(
    ("id", _L), ("name", _S), ("department", _S), ("role", _S), ("qualification", _S),
    ("extension", _S), ("mobile", _S), ("email", _S),
)

CUSTOMERS = _struct(
    ("id", _L), ("name", _S), ("address", _S), ("building_type", _S), ("age_years", T.IntegerType()),
    ("phone", _S), ("email", _S), ("source", _S), ("staff", _S), ("note", _S),
)

PROJECTS = _struct(
    ("id", _L), ("name", _S), ("customer_name", _S), ("address", _S), ("work_type", _S),
    ("staff", _S), ("status", _S), ("probability", _S), ("estimate_amount", _L),
    ("first_visit", _S), ("scheduled_start", _S), ("contract_date", _S),
    ("contract_amount", _L), ("note", _S),
)

ESTIMATES = _struct(
    ("id", _L), ("quote_no", _S), ("customer_name", _S), ("title", _S), ("service", _S),
    ("qty", T.DoubleType()), ("unit_price", _L), ("subtotal", _L),
    ("created_date", _S), ("expiry_date", _S), ("note", _S),
)

INVOICES = _struct(
    ("id", _L), ("invoice_no", _S), ("project_name", _S), ("customer_name", _S),
    ("billing_type", _S), ("billing_date", _S), ("amount", _L), ("due_date", _S),
    ("payment_status", _S), ("payment_date", _S), ("note", _S),
)

SERVICES = _struct(
    ("id", _L), ("name", _S), ("category", _S), ("standard_price", _L),
    ("unit", _S), ("duration", _S), ("note", _S),
)

TABLES: dict[str, T.StructType] = {
    "employees": EMPLOYEES,
    "customers": CUSTOMERS,
    "projects": PROJECTS,
    "estimates": ESTIMATES,
    "invoices": INVOICES,
    "services": SERVICES,
}

# Ledger columns whose text holds a date (raw text is kept; parsing is a separate column).
DATE_COLUMNS: dict[str, tuple[str, ...]] = {
    "projects": ("first_visit", "scheduled_start", "contract_date"),
    "estimates": ("created_date", "expiry_date"),
    "invoices": ("billing_date", "due_date", "payment_date"),
}


def payload_schema(table: str) -> T.StructType:
    """Columns of ``table`` without ``id``: the payload of a change row."""
    return T.StructType([f for f in TABLES[table].fields if f.name != "id"])


def change_schema(table: str) -> T.StructType:
    """A change row: ``(seq, op, id, payload)``; op is create/update/delete/assign_staff."""
    return T.StructType([
        T.StructField("seq", _L, True),
        T.StructField("op", _S, True),
        T.StructField("id", _L, True),
        T.StructField("payload", payload_schema(table), True),
    ])


# --- Fixed values (must equal the business rules of the original dashboard) ---
# Project statuses, in workflow order.
STATUS_FIRST_VISIT = "初回訪問済"
STATUS_SURVEYED = "現地調査済"
STATUS_NEGOTIATING = "商談中"
STATUS_QUOTED = "見積提出済"
STATUS_CONTRACTED = "契約済"
STATUS_DONE = "完了"
STATUS_LOST = "失注"
PROJECT_STATUSES = ("初回訪問済", "現地調査済", "商談中", "見積提出済", "契約済", "完了", "失注")

# Invoice payment states; only PAID counts as paid, any other non-null value is unpaid.
PAYMENT_UNPAID = "未入金"
PAYMENT_WAITING = "入金待ち"
PAYMENT_PAID = "入金済"
PAYMENT_STATUSES = ("未入金", "入金待ち", "入金済")

# Customer building types offered by the entry form.
BUILDING_TYPES = ("戸建て", "マンション", "アパート", "事務所・店舗", "その他")

# Workload level labels: no projects, light, normal, busy.
LEVEL_NONE = "担当なし"
LEVEL_LIGHT = "余裕あり"
LEVEL_NORMAL = "通常"
LEVEL_BUSY = "多忙"

# Label of the "no staff" choice in the staff picker.
UNASSIGNED_LABEL = "未割当"

# Text fields checked for garbled text (two or more consecutive '?'), in report order.
GARBLE_FIELDS = ("name", "address", "note", "staff", "customer_name", "project_name",
                 "building_type", "source", "work_type", "billing_type")
GARBLE_PATTERN = r"[?]{2,}"

# Required fields per table on create and full update.
REQUIRED_FIELDS: dict[str, tuple[str, ...]] = {
    "projects": ("name", "customer_name"),
    "invoices": ("invoice_no", "project_name"),
    "employees": ("name",),
    "customers": ("name",),
}

# Defaults filled when the value is missing: on project create only; on invoice create and update.
CREATE_DEFAULTS: dict[str, dict[str, str]] = {
    "projects": {"status": "初回訪問済"},
    "invoices": {"payment_status": "未入金"},
}
UPDATE_DEFAULTS: dict[str, dict[str, str]] = {
    "invoices": {"payment_status": "未入金"},
}
# --- end of fixed values ---

# Tables that carry a ``staff`` column holding an employee surname.
STAFF_TABLES = ("projects", "customers")
