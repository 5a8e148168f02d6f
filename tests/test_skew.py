"""Hot keys: one id / one staff value holding a third of all rows must give whole, exact results."""

from pyspark.sql import functions as F

from ledgerlake.operators import changes as C
from ledgerlake.operators import metrics as M
from ledgerlake.operators import workload as W
from tests.conftest import changes, make


def test_hot_id_in_change_set(spark):
    base = [dict(id=i, name=f"p{i}", customer_name="c", staff="s", status="商談中") for i in range(1, 301)]
    rows = [(s, "update", 7, dict(name=f"v{s}", customer_name="c", staff="hot")) for s in range(1, 301)]
    rows += [(1000 + i, "assign_staff", i, dict(staff="x")) for i in range(1, 301) if i != 7]
    rows += [(2000 + i, "create", None, dict(name=f"n{i}", customer_name="c")) for i in range(300)]
    new, v = C.apply_change_set(make(spark, "projects", base), changes(spark, "projects", rows), "projects")
    got = {r["id"]: r for r in new.collect()}
    assert len(got) == 600 and got[7]["name"] == "v300" and got[7]["staff"] == "hot"
    assert all(got[i]["staff"] == "x" for i in range(1, 301) if i != 7)
    assert sorted(i for i in got if i > 300) == list(range(301, 601))
    assert got[301]["name"] == "n0" and got[600]["name"] == "n299"
    assert v.where(F.col("verdict") == "accepted").count() == len(rows)


def test_hot_staff_value(spark):
    rows = [dict(id=i, name=f"p{i}", customer_name="c", status="契約済" if i % 2 else "失注",
                 staff="山田" if i % 3 == 0 else f"s{i % 5}", contract_amount=i) for i in range(1, 901)]
    p = make(spark, "projects", rows)
    perf = {r["staff"]: r for r in M.staff_performance(p).collect()}
    hot = [r for r in rows if r["staff"] == "山田"]
    assert perf["山田"]["total"] == len(hot) == 300
    assert perf["山田"]["revenue"] == sum(r["contract_amount"] for r in hot if r["status"] == "契約済")
    emps = make(spark, "employees", [dict(id=1, name="山田 太郎"), dict(id=2, name="山田 次郎")])
    wl = {r["id"]: r for r in W.employee_workload(emps, p).collect()}
    assert wl[1]["total_projects"] == wl[2]["total_projects"] == 300
    assert wl[1]["lost"] == sum(1 for r in hot if r["status"] == "失注")
