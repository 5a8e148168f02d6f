from pyspark.sql import functions as F

from ledgerlake.operators import metrics as M
from ledgerlake.operators import workload as W
from tests.conftest import make

PROJECTS = [
    dict(id=1, name="p1", customer_name="c", status="契約済", staff="山田", contract_amount=100, estimate_amount=120,
         contract_date="2024/3/5", work_type="外装"),
    dict(id=2, name="p2", customer_name="c", status="契約済", staff="山田", contract_amount=None, estimate_amount=50,
         contract_date="2024-03-09", work_type="外装"),
    dict(id=3, name="p3", customer_name="c", status="商談中", staff="鈴木", estimate_amount=70, work_type="内装"),
    dict(id=4, name="p4", customer_name="c", status="失注", staff="鈴木", estimate_amount=30, work_type="内装"),
    dict(id=5, name="p5", customer_name="c", status=None, staff=None, estimate_amount=10),
    dict(id=6, name="p6", customer_name="c", status="完了", staff="鈴木", contract_amount=40, estimate_amount=45,
         contract_date="2024/4/1"),
    dict(id=7, name="p7", customer_name="c", status="契約済", staff="田中", contract_amount=None, estimate_amount=5,
         contract_date="2024/5/1", probability="100.0"),
    dict(id=8, name="p8", customer_name="c", status="初回訪問済", staff="田中", estimate_amount=0),
]
INVOICES = [
    dict(id=1, invoice_no="i1", project_name="p1", payment_status="入金済", amount=100, billing_date="2024/3/5"),
    dict(id=2, invoice_no="i2", project_name="p1", payment_status="未入金", amount=30, billing_date="2024-03-06"),
    dict(id=3, invoice_no="i3", project_name="p1", payment_status="入金待ち", amount=None, billing_date=None),
    dict(id=4, invoice_no="i4", project_name="p1", payment_status=None, amount=7, billing_date="2024/12/1"),
]


def test_kpi_summary(spark):
    row = M.kpi_summary(make(spark, "projects", PROJECTS), make(spark, "invoices", INVOICES)).first().asDict()
    assert row == dict(contracted_count=3, contracted_total=100, pipeline_count=2, pipeline_total=70, lost_count=1,
                       total_projects=8, paid_amount=100, unpaid_amount=30)


def test_kpi_summary_empty(spark):
    row = M.kpi_summary(make(spark, "projects", []), make(spark, "invoices", [])).first().asDict()
    assert all(v == 0 for v in row.values())


def test_by_status_laws(spark):
    p = make(spark, "projects", PROJECTS)
    rows = {r["status"]: (r["count"], r["total"]) for r in M.by_status(p).collect()}
    assert sum(c for c, _ in rows.values()) == len(PROJECTS)
    assert rows["契約済"] == (3, 100 + 50 + 5)  # falls back to the estimate
    assert rows[None] == (1, 10)


def test_monthly_contracted_null_total(spark):
    rows = {r["month"]: (r["count"], r["total"]) for r in M.monthly_contracted(make(spark, "projects", PROJECTS)).collect()}
    assert rows == {"2024-03": (2, 100), "2024-05": (1, None)}


def test_staff_ranking(spark):
    rows = M.staff_ranking(M.staff_performance(make(spark, "projects", PROJECTS))).collect()
    by = {r["staff"]: r for r in rows}
    assert by["山田"]["rank"] == 1 and by["山田"]["revenue"] == 100 and by["山田"]["revenue_share"] == 1.0
    assert by["田中"]["win_rate"] == 0.5 and by["鈴木"]["contracted"] == 0
    assert sorted(r["rank"] for r in rows) == [1, 2, 3]


def test_won_statuses_variant(spark):
    rows = M.staff_performance(make(spark, "projects", PROJECTS), won_statuses=("契約済", "完了")).collect()
    assert {r["staff"]: r["revenue"] for r in rows}["鈴木"] == 40


def test_workload_namesakes_and_levels(spark):
    emps = make(spark, "employees", [dict(id=1, name="山田 太郎"), dict(id=2, name="山田 花子"),
                                     dict(id=3, name="鈴木　一郎"), dict(id=4, name="田中 次郎")])
    wl = W.workload_levels(W.employee_workload(emps, make(spark, "projects", PROJECTS)))
    rows = {r["id"]: r for r in wl.collect()}
    assert rows[1]["total_projects"] == rows[2]["total_projects"] == 2
    assert rows[3]["total_projects"] == 0 and rows[3]["level"] == "担当なし"  # U+3000 is not split in workload
    assert rows[4]["early"] == 1 and rows[4]["in_progress"] == 1 and rows[4]["active"] == 2
    assert rows[1]["level"] == "通常"
    assert [r["id"] for r in wl.collect()][:2] == [1, 2]


def test_project_list_filters(spark):
    p = make(spark, "projects", PROJECTS)
    assert [r["id"] for r in M.project_list(p, status="契約済").collect()] == [7, 2, 1]
    assert M.project_list(p, status="契約済", work_type="外装").count() == 2
    assert M.project_list(p, status="unknown").count() == 0
    assert M.project_list(p, status="").count() == len(PROJECTS)
    assert M.project_list(p).where(F.col("id") == 7).first()["probability"] == "100"
    assert [r["id"] for r in M.recent_projects(p, 3).collect()] == [8, 7, 6]


def test_invoice_list_text_order(spark):
    ids = [r["id"] for r in M.invoice_list(make(spark, "invoices", INVOICES)).collect()]
    assert ids == [1, 4, 2, 3]  # text order: slash above dash in one year, "3" above "12"; null last
